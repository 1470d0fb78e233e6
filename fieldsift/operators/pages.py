"""Page assembly: page rows to document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_pages(
    pages: DataFrame,
    *,
    document: str = "source_path",
    page: str = "page_no",
    text: str = "text",
) -> DataFrame:
    """One row per document, its pages joined by LF in page order.

    Texts cross the network once.  A document's pages meet in one task, as its text is
    one value there anyway.  A missing page text is an empty page.
    """
    piece = F.struct(
        F.col(page).cast("long").alias("position"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    grouped = pages.groupBy(document).agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
    return grouped.select(
        document, F.array_join(F.col("_pieces")["text"], "\n").alias("text")
    )
