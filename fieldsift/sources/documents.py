"""Input tables: document texts and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_folder(
    spark: SparkSession, folder: str, *, pattern: str = "*.pdf", recursive: bool = False
) -> DataFrame:
    """``source_path, text`` for the files of a folder whose names match.

    The files hold extracted text.  Like a plain directory listing, sub-folders are
    not entered unless asked for, and names are matched case-sensitively.  Spark's reader
    leaves out names that begin with ``_`` or ``.`` and replaces bytes that are no UTF-8;
    ``sources/listing.py`` has a row with a status for every name.
    """
    return (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .text(folder, wholetext=True)
        .select(_plain_path().alias("source_path"), F.col("value").alias("text"))
    )


def read_json_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, content`` of JSON files, one record per file, left unparsed."""
    return spark.read.text(paths, wholetext=True).select(
        _plain_path().alias("path"), F.col("value").alias("content")
    )


def _plain_path():
    """File path without the scheme of a local file."""
    return F.regexp_replace(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))),
        r"^file:/+",
        "/",
    )


def spread(docs: DataFrame, partitions: int) -> DataFrame:
    """Give a few large input splits to more tasks before heavy row-wise work.

    Only for inputs with fewer splits than cores, such as one file with a single
    row group; a large table is already cut finely enough by the scan.
    """
    return docs.repartition(partitions)
