"""Attaching a dimension row to documents without trusting the key distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SALTS = 4


def lookup(
    docs: DataFrame,
    dimension: DataFrame,
    *,
    key: Column,
    dimension_key: str,
    spread_by: Column,
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Left join to a dimension; its keys must be unique, a repeated one repeats documents.

    No broadcast is forced: Spark broadcasts the dimension when its size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.  In the shuffled
    case one key may hold a large part of all documents; adaptive execution then
    splits the documents of that key over several tasks.  Where that is switched off,
    ``salts`` does the same by hand: documents are spread over that many copies of
    each dimension row.  Rows without a key match nothing and are spread over all tasks.
    """
    left = docs.withColumns({"_lookup_key": key})
    right = dimension.withColumnRenamed(dimension_key, "_dimension_key")
    on = left["_lookup_key"] == right["_dimension_key"]
    if salts > 1:
        spot = F.xxhash64(spread_by)
        dealt = F.when(F.col("_lookup_key").isNotNull(), F.pmod(spot, F.lit(salts))).otherwise(spot)
        left = left.withColumn("_salt", dealt)
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
        right = right.withColumn("_copy", copies)
        on = on & (left["_salt"] == right["_copy"])
    joined = left.join(right, on, "left")
    return joined.drop("_lookup_key", "_dimension_key", "_salt", "_copy")


def only_row(dimension: DataFrame, value: Column) -> Column:
    """The one dimension row as a scalar subquery, null if there is none.

    No join is needed to attach it.  A second row fails the query: none is picked.
    """
    return dimension.select(value.alias("value")).scalar()
