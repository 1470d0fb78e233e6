"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.common import stored


def _checked(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))
    ).first()
    return row[0], int(row[1])


def roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node but the roots; the root is the least node reachable.

    ``links`` has two columns of numbers.  Each round hangs the larger neighbours of a
    node below its least neighbour, then the smaller ones, with aggregates and joins that
    can be split where a node has very many neighbours; rounds end when nothing moves.
    """
    a, b = links.columns
    edges = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    seen = _checked(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v > m").selectExpr("v AS u", "m AS v")
        edges = stored(
            moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges"
        )
        now = _checked(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
