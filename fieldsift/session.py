"""Session settings the operators are designed for, and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


def build_session(app_name: str = "fieldsift", master: str | None = None) -> SparkSession:
    """A session with adaptive execution; cluster settings come from spark-submit."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # A repeated key in a JSON object: the last value counts.
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


@cache
def _local_base() -> str:
    """One temporary folder for this process, removed when it ends."""
    base = tempfile.mkdtemp(prefix="fieldsift-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


#: Run folders that this process named, oldest first.
_NAMED: list[str] = []


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names it.  Only a session on one machine may leave it unset
    and gets a local temporary folder; on a cluster executors would not see each other's.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_base()
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _NAMED.append(folder)
    return folder


def remove_run_folders(spark: SparkSession, since: int = 0) -> int:
    """Delete the run folders that this process named, and say how many.

    For the end of a job, when no result that reads them is needed any more.  ``since`` is
    an earlier ``len`` of them (``named_run_folders``), to keep older ones.
    """
    from fieldsift.sources.store import Store

    gone = _NAMED[since:]
    del _NAMED[since:]
    for folder in gone:
        Store(spark, folder).delete(folder)
    return len(gone)


def named_run_folders() -> int:
    return len(_NAMED)
