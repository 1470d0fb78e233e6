"""Committed output: several tables that appear together, or not at all.

An attempt writes its parts into a folder of its own below the target.  Every finished part
leaves a note with what was counted while it was written.  When all parts are there, one
small marker that names the attempt is put beside the attempts; that is the moment of
publication, and no data is moved for it, so it is the same on file systems and object stores.
Readers follow the marker and never see an attempt that has none.

A job that is run again after its driver was lost carries on: with the same ``run`` name the
finished parts of its attempt stay, an unfinished part is written anew, and other attempts
without a marker are removed.  One writer at a time publishes to a target.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldsift.sources.store import Store

MARKER = "published.json"
_ATTEMPT = "attempt-"


class NotPublished(FileNotFoundError):
    """Nothing has been published at this path."""


class Publication:
    """One attempt to publish parts at ``path``.

    ``mode`` is ``error`` (a published target stays and the attempt fails at once) or
    ``overwrite`` (the new parts replace it at the moment of publication).  An attempt of the
    published ``run`` has nothing to do: its parts count as finished.
    """

    def __init__(
        self, spark: SparkSession, path: str, *, run: str | None = None, mode: str = "error"
    ) -> None:
        if mode not in ("error", "overwrite"):
            raise ValueError(f"Unknown mode: {mode}")
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode
        self.store = Store(spark, path)
        self.run = run or uuid.uuid4().hex
        self.folder = f"{self.path}/{_ATTEMPT}{self.run}"
        self.facts: dict[str, dict] = {}
        published = self._published()
        self.done = published is not None and published["run"] == self.run
        if self.done:
            self.facts = published["parts"]
        elif published is not None and mode == "error":
            raise FileExistsError(f"Already published: {self.path}")
        else:
            self._remove_attempts(self.run, published and published["run"])

    def _published(self) -> dict | None:
        marker = f"{self.path}/{MARKER}"
        return json.loads(self.store.read(marker)) if self.store.exists(marker) else None

    def _remove_attempts(self, *kept: str | None) -> None:
        names = {f"{_ATTEMPT}{run}" for run in kept}
        for name in self.store.names(self.path):
            if name.startswith(_ATTEMPT) and name not in names:
                self.store.delete(f"{self.path}/{name}")

    def part(
        self,
        name: str,
        rows: DataFrame | Callable[[], DataFrame],
        write: Callable[[DataFrame, str], None],
        **counted,
    ) -> dict:
        """Write one part unless it is finished; what was counted on the way.

        ``counted`` are aggregate Columns over the rows; they are observed while the rows are
        written, so nothing is read again.  ``rows`` is also counted.
        """
        note = f"{self.folder}/{name}.done"
        if self.done:
            return self.facts[name]
        if self.store.exists(note):
            self.facts[name] = json.loads(self.store.read(note))
            return self.facts[name]
        folder = f"{self.folder}/{name}"
        self.store.delete(folder)  # what a lost driver left
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        frame = rows() if callable(rows) else rows
        counts = {"rows": F.count(F.lit(1)), **counted}
        write(frame.observe(seen, *[c.alias(n) for n, c in counts.items()]), folder)
        self.facts[name] = {key: value or 0 for key, value in seen.get.items()}
        self.store.write(note, json.dumps(self.facts[name]))
        return self.facts[name]

    def publish(self) -> dict[str, dict]:
        """Make the attempt the published one; what was counted, by part."""
        if not self.done:
            marker = f"{self.path}/{MARKER}"
            if self.mode == "overwrite":
                self.store.delete(marker)
            self.store.write(marker, json.dumps({"run": self.run, "parts": self.facts}))
            self.done = True
            self._remove_attempts(self.run)
        return self.facts


def published(spark: SparkSession, path: str) -> dict:
    """The marker of a path: its run and, by part, what was counted."""
    marker = f"{path.rstrip('/')}/{MARKER}"
    store = Store(spark, path)
    if not store.exists(marker):
        raise NotPublished(path)
    return json.loads(store.read(marker))


def published_folder(spark: SparkSession, path: str, part: str) -> str:
    """Where the rows of a published part lie."""
    marker = published(spark, path)
    if part not in marker["parts"]:
        raise NotPublished(f"{path}: {part}")
    return f"{path.rstrip('/')}/{_ATTEMPT}{marker['run']}/{part}"
