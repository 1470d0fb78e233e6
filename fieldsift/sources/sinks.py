"""Output tables.

Every sink writes in parallel and publishes its parts together (``sources/publish.py``): a
reader sees a finished output or none, and a job that runs again after a lost driver carries
on.  ``run`` names the job run, ``mode`` says what happens to an earlier output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift.operators.reports import TOTALS_SCHEMA, total_counts
from fieldsift.sources.publish import Publication, published_folder


def json_record(*columns: str) -> Column:
    """A row as one JSON object that keeps its nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _json_with_nulls(rows: DataFrame, folder: str) -> None:
    rows.write.option("ignoreNullFields", "false").json(folder)


def _json(rows: DataFrame, folder: str) -> None:
    rows.write.json(folder)


def _parquet(rows: DataFrame, folder: str) -> None:
    rows.write.parquet(folder)


def _publish(rows: DataFrame, path: str, part: str, write, run: str | None, mode: str) -> dict:
    publication = Publication(rows.sparkSession, path, run=run, mode=mode)
    publication.part(part, rows, write)
    return publication.publish()


def write_json_records(
    records: DataFrame, path: str, *, run: str | None = None, mode: str = "error"
) -> dict:
    """Records as JSON lines, nulls kept."""
    return _publish(records, path, "records", _json_with_nulls, run, mode)


def write_batch_report(
    items: DataFrame, path: str, *, run: str | None = None, mode: str = "error"
) -> dict:
    """Items as JSON rows, and their totals as one row.

    An item lists only the keys it has, like the report of a single run.  The totals are
    observed while the items are written: no document is processed and no item read twice.
    """
    spark = items.sparkSession
    publication = Publication(spark, path, run=run, mode=mode)
    counts = publication.part("items", items, _json, **total_counts())
    names = [field.split()[0] for field in TOTALS_SCHEMA.split(", ")]
    publication.part(
        "totals",
        lambda: spark.createDataFrame([tuple(counts[n] for n in names)], TOTALS_SCHEMA).coalesce(1),
        _json,
    )
    return publication.publish()


def read_batch_report(spark: SparkSession, path: str, items_schema) -> tuple[DataFrame, DataFrame]:
    """Items and totals of the published report."""
    items = spark.read.schema(items_schema).json(published_folder(spark, path, "items"))
    totals = spark.read.schema(TOTALS_SCHEMA).json(published_folder(spark, path, "totals"))
    return items, totals


def write_quarantine(
    rejected: DataFrame, path: str, *, run: str | None = None, mode: str = "error"
) -> dict:
    """Dump path and text of the documents the gate rejected."""
    rows = rejected.select("source_path", "dump_path", "extracted_text")
    return _publish(rows, path, "rejected", _parquet, run, mode)


def write_render_rows(
    rows: DataFrame, path: str, *, run: str | None = None, mode: str = "error"
) -> dict:
    """The flat render columns, ready for a template."""
    return _publish(rows, path, "rows", _parquet, run, mode)
