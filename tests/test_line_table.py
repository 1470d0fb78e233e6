"""The in-row and the line-table form of ranking agree."""

from conftest import DATA
from pyspark.sql import functions as F

from fieldsift.functions import scoring
from fieldsift.functions.text import meaningful_lines
from fieldsift.operators import line_table
from fieldsift.operators.extract import rank_description_lines, rank_material_lines
from fieldsift.queries.registry import raw_documents, raw_sheets


def sorts(frame):
    """Whether the plan sorts: SortAggregate, SortMergeJoin or Sort."""
    return "Sort" in frame._jdf.queryExecution().executedPlan().toString()


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_material_ranking(spark):
    for docs, key in (
        (raw_documents(spark, str(DATA)), "doc_id"),
        (raw_sheets(spark, str(DATA)), "sheet_id"),
    ):
        columns = (key, "candidates", "score", "line")
        in_row = rank_material_lines(docs, key).where("line IS NOT NULL")
        table = line_table.top_material_lines(docs, key)
        assert not sorts(table)
        assert rows(in_row, *columns) == rows(table, *columns) != []


def test_description_ranking(spark):
    for docs, key in (
        (raw_documents(spark, str(DATA)), "doc_id"),
        (raw_sheets(spark, str(DATA)), "sheet_id"),
    ):
        first = F.get(meaningful_lines(F.col("raw_text")), F.lit(0))
        docs = docs.withColumn("material_type", first)
        columns = (key, "viable_lines", "score", "description")
        in_row = rank_description_lines(docs, key).where("description IS NOT NULL")
        table = line_table.top_description_lines(docs, key)
        assert not sorts(table)
        assert rows(in_row, *columns) == rows(table, *columns)


def test_single_line_scores_equal_the_table_scores(spark):
    docs = raw_sheets(spark, str(DATA)).withColumn("material_type", F.lit("typ ac"))
    lines = line_table.line_property_table(docs, "sheet_id", "material_type")
    line, low = F.col("line"), F.lower("line")
    single = line_table.line_table(docs, "sheet_id").select(
        "sheet_id",
        "line_no",
        scoring.material_score(line, low).alias("m"),
        scoring.description_score(line, low, F.lit("typ ac")).alias("d"),
    )
    assert rows(single, "sheet_id", "line_no", "m") == rows(
        line_table.material_line_scores(lines, "sheet_id"), "sheet_id", "line_no", "score"
    )
    assert rows(single, "sheet_id", "line_no", "d") == rows(
        line_table.description_line_scores(lines, "sheet_id"), "sheet_id", "line_no", "score"
    )
