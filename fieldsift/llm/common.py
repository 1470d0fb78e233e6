"""Helpers shared by the operators: reading tables, cutting lineage, row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift.session import run_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write rows to the cluster's shared folder and read them again.

    The result has no lineage but its files, so a lost executor costs no earlier work,
    and every later read sees the same rows.
    """
    folder = run_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns the operators read, whatever else the table has."""
    return docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )


#: So many ids at most are sent to all tasks: 16 MB packed, about 80 MB as a hashed table.
SENT_IDS = 1 << 21


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``gone``, a stored table of distinct ids in one column.

    The ids are counted first.  Up to ``SENT_IDS`` go to the tasks, and no text is moved; more
    are joined by id.  Rows with a null id stay.
    """
    (name,) = gone.columns
    listed = F.broadcast(gone) if gone.count() <= SENT_IDS else gone
    return docs.join(listed, docs["doc_id"].cast("long") == F.col(name), "left_anti")


def crc_class(doc_id: str, modulus: int) -> F.Column:
    """crc32 of the decimal id, modulo ``modulus``; a null id has class null."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(modulus)


def drawn(key: str, share: float) -> F.Column:
    """Whether a row is in a share of all rows, by a hash of its key."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) < F.lit(int(min(1.0, share) * (1 << 40)))


def parts(rows: int, each: int, least: int = 1) -> int:
    """How many parts hold ``each`` rows: a count that grows with the data, not a cap."""
    return max(least, -(-rows // each))


def numbered(rows: DataFrame, key: str, order: list[str], slices: int) -> DataFrame:
    """Rows with ``rank``: their gapless number from 0 within ``key``.

    A key may hold a third of all rows, so its rows are dealt to ``slices`` by a hash of
    ``order``.  Each slice is numbered on its own, and the counts of the slices before it
    are added: a window over ``slices`` small rows a key.
    """
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    counts = sliced.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.selectExpr(
        key,
        "_slice",
        f"sum(_rows) OVER (PARTITION BY {key} ORDER BY _slice) - _rows AS _before",
    )
    joined = sliced.join(before, [key, "_slice"])
    inner = ", ".join(order)
    return joined.selectExpr(
        "* EXCEPT (_slice, _before)",
        f"_before + row_number() OVER (PARTITION BY {key}, _slice ORDER BY {inner}) - 1"
        " AS rank",
    )
