"""What the plans of registered queries must not contain."""

import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from fieldsift.operators.lookup import lookup
from fieldsift.queries.registry import QUERIES
from fieldsift.vocab import DEFAULT_VOCABULARY


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def plan(spark, name, kind="optimizedPlan"):
    return getattr(QUERIES[name](spark, str(DATA))._jdf.queryExecution(), kind)().toString()


@pytest.mark.parametrize("name", ["a1_batch_totals", "a2_batch_items", "e2_generate", "c6_warnings"])
def test_verdicts_do_not_pay_for_descriptions(spark, name):
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    text = plan(spark, name)
    last_resort = DEFAULT_VOCABULARY.description_placeholder
    assert last_resort not in text and last_resort in plan(spark, "t19_extract_sheets")
    generated = [line for line in text.splitlines() if "Generate inline" in line]
    assert generated and not any("n_chars" in line or "raw_text AS" in line for line in generated)


@pytest.mark.parametrize("name", ["p8_approval", "c8_exit_code"])
def test_approvals_read_materials_once_and_join_once(spark, no_broadcast, name):
    text = plan(spark, name, "executedPlan")
    assert len(re.findall(r"FileScan parquet[^\n]*part\.parquet", text)) == 1
    exchanged = [
        line for line in text.splitlines() if "Exchange hashpartitioning" in line
    ]
    # Materials and contexts, one exchange each; the third belongs to the contexts' own plan.
    assert 2 <= len(exchanged) <= 3
    assert text.count("SortMergeJoin") == 1


def test_pages_cross_the_network_once(spark):
    text = plan(spark, "s2_page_assembly", "executedPlan")
    assert text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["t19_extract_documents", "p8_approval"])
def test_no_hidden_shuffle(spark, name):
    assert "RoundRobin" not in plan(spark, name, "executedPlan")


@pytest.mark.parametrize("salts", [1, 16])
def test_lookup_with_hot_and_null_keys(spark, no_broadcast, salts):
    docs = spark.range(600).select(
        "id", F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 3 == 1, "hot").otherwise("none")).alias("k")
    )
    known = spark.createDataFrame([("hot", 1), (None, 2), ("cold", 3)], "name string, v int")
    found = lookup(
        docs, known, key=F.col("k"), dimension_key="name", spread_by=F.col("id"), salts=salts
    )
    assert found.columns == ["id", "k", "v"]
    counts = {(r.k, r.v): r.n for r in found.groupBy("k", "v").agg(F.count("*").alias("n")).collect()}
    assert counts == {(None, None): 200, ("hot", 1): 200, ("none", None): 200}
