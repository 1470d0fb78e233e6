"""Keeping expensive columns from being computed twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate_once(rows: DataFrame, *passed: str) -> DataFrame:
    """The same rows, with every column but ``passed`` computed exactly once.

    Catalyst pushes a filter below the projections it depends on by copying their
    expressions into the filter.  For a cascade of text work that repeats all of it,
    and as each step uses the one before several times, the copy can grow without
    bound.  Columns that come out of a generator are not substituted that way, so
    the columns pass through a one-element ``inline``: no shuffle, one row in, one
    row out.  Filters on the ``passed`` columns still reach the scan.
    """
    computed = [c for c in rows.columns if c not in passed]
    return rows.select(*passed, F.inline(F.array(F.struct(*computed)))).select(*rows.columns)
