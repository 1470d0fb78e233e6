"""Queries with checking SQL against DuckDB, and the pipeline's stages in a row."""

import duckdb
import pytest
from conftest import DATA

import corpus_pipeline
from fieldsift.llm.queries import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = connection.sql(CHECKS[name]).df()
    got = QUERIES[name](spark, str(DATA)).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(frame):
        frame = frame[columns].astype(object).where(frame[columns].notna(), None)
        whole = lambda x: int(x) if isinstance(x, float) and x.is_integer() else x
        return sorted(str([whole(x) for x in row]) for row in frame.values.tolist())

    assert rows(got) == rows(want)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(DATA))
        assert kept.columns == docs.columns, name
        kept = kept.cache()
        assert 0 < kept.count() <= docs.count()
        docs = kept
    pieces = corpus_pipeline.pack(spark, docs, str(DATA))
    assert pieces.select("doc_id").distinct().count() == docs.count()
