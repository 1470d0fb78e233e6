"""Statuses, batch items and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift import schemas

# Fixed value: why a batch without context or template does nothing.
SKIP_REASON = "batch generation not implemented (missing context/template)"


def exit_code(status: Column) -> Column:
    """0 for success, 2 for documents without text, 3 for context errors, else 1."""
    return (
        F.when(status == schemas.OK, 0)
        .when(status == schemas.NON_TEXT, 2)
        .when(status == schemas.CONTEXT_ERROR, 3)
        .otherwise(1)
    )


def batch_item(pdf: Column, status: Column, output: Column, error: Column) -> list[Column]:
    """A2: an item names its output, its error or the reason it was skipped."""
    skipped, ok = status == schemas.SKIPPED, status == schemas.OK
    return [
        pdf.alias("pdf"),
        F.when(ok | skipped, status).otherwise(F.lit(schemas.ERROR)).alias("status"),
        F.when(ok, output).alias("output"),
        F.when(~ok & ~skipped, error).alias("error"),
        F.when(skipped, F.lit(SKIP_REASON)).alias("reason"),
    ]


TOTALS_SCHEMA = "processed bigint, errors bigint, skipped bigint"


def total_counts() -> dict[str, Column]:
    """A1: what is counted over the items of a batch."""
    status = F.col("status")
    return {
        "processed": F.count_if(status == schemas.OK),
        "errors": F.count_if(status == schemas.ERROR),
        "skipped": F.count_if(status == schemas.SKIPPED),
    }


def batch_totals(items: DataFrame) -> DataFrame:
    """A1: one row with the counts of processed, failed and skipped documents.

    A report that writes its items observes the same counts on the way and needs no
    second pass (``sources/sinks.py``).
    """
    return items.agg(*[count.alias(name) for name, count in total_counts().items()])


def shared_outputs(items: DataFrame) -> DataFrame:
    """Output paths that several documents of a batch would write to."""
    return (
        items.where(F.col("output").isNotNull())
        .groupBy("output")
        .agg(F.count(F.lit(1)).alias("documents"))
        .where(F.col("documents") > 1)
    )
