"""Word lists from a table against the same lists in the plan."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fieldsift.functions import scoring
from fieldsift.operators import extract, line_table, vocabularies
from fieldsift.vocab import DEFAULT_VOCABULARY as USUAL

OTHER = replace(
    USUAL,
    excluded_prefixes=("art", "farbe (ral)"),
    excluded_headers=("datenblatt",),
    noise_phrases=("gmbh", "seite "),
    material_keywords=("dämmplatte", "schraube"),
    description_noise=("gmbh", "preis"),
    description_keywords=("für innen",),
)
PIECES = (
    "Dämmplatte für innen", "Datenblatt", "Art: X-12", "Art", "Artikel 7", "Farbe (RAL) 9010",
    "Muster GmbH Seite 3", "Schraube M8 verzinkt für Holz und Stahl", "AB-12", "GROSS", "a",
    "lange Zeile ohne ein bekanntes Wort darin und noch mehr", "[x] (y) .*", "Preis 3,50",
)


def texts():
    rng = random.Random(9)
    usual = [w for f in vocabularies.LISTS for w in getattr(USUAL, f)]
    for k in range(240):
        lines = [" ".join(rng.choices(PIECES + tuple(usual), k=rng.randint(1, 3))) for _ in range(6)]
        yield k, rng.choice(["usual", "other", "unknown", None]), "\n".join(lines)
    yield 900, "other", ""
    yield 901, "other", None


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(texts()), "k int, name string, raw_text string").cache()


def attached(spark, docs, salts=4):
    words = vocabularies.vocabulary_table(spark, {"usual": USUAL, "other": OTHER})
    extra = [("other", "noise_phrases", "gmbh"), ("other", "no_such_list", "x")]
    extra += [("other", "noise_phrases", None), (None, "noise_phrases", "a")]
    words = words.unionByName(spark.createDataFrame(extra, vocabularies.SCHEMA))
    return vocabularies.attach_vocabulary(
        docs, words, vocabulary="name", spread_by="k", default="usual", salts=salts
    )


def expected(docs, form):
    """The same with literals in the plan, documents split by vocabulary."""
    other = F.coalesce(F.col("name") == "other", F.lit(False))
    return {*form(docs.where(other), OTHER), *form(docs.where(~other), USUAL)}


def scores(docs, vocab, *keys):
    lines = line_table.line_property_table(docs.withColumn("m", F.lit("GROSS")), "k", "m", *keys, vocab=vocab)
    low = F.lower("m")
    return {
        tuple(r)
        for r in lines.select(
            "k",
            "line_no",
            scoring.material_row_score(F.col("row")),
            scoring.description_row_score(F.col("row"), low, vocab),
            scoring.candidate_row(F.col("row"), vocab),
        ).collect()
    }


def best(docs, vocab, *keys):
    rows = extract.rank_material_lines(docs, "k", *keys, vocab=vocab).drop(*keys)
    return {tuple(r) for r in rows.collect()}


@pytest.mark.parametrize("form", [scores, best])
def test_lists_of_a_table_score_like_lists_in_the_plan(spark, docs, form):
    own = vocabularies.vocabulary_of(F.col("word_lists"))
    got = form(attached(spark, docs), own, "word_lists")
    assert got and got == expected(docs, form)


def test_candidates_of_a_table(spark, docs):
    own = vocabularies.vocabulary_of(F.col("word_lists"))
    low = F.lower(F.element_at(F.split("raw_text", "\n"), 1))
    got = attached(spark, docs).select("k", scoring.is_candidate(low, own)).collect()
    wanted = expected(docs, lambda d, v: {tuple(r) for r in d.select("k", scoring.is_candidate(low, v)).collect()})
    assert {tuple(r) for r in got} == wanted


def test_missing_lists_unknown_names_and_empty_tables(spark, docs):
    part = spark.createDataFrame([("other", "material_keywords", "b"), ("usual", "material_keywords", "a")], vocabularies.SCHEMA)

    def lists(words):
        rows = vocabularies.attach_vocabulary(docs, words, vocabulary="name", spread_by="k", default="usual")
        assert rows.count() == docs.count() and rows.columns == [*docs.columns, "word_lists"]
        return {(r["name"], *r.word_lists.material_keywords) for r in rows.collect()}, rows

    found, rows = lists(part)
    assert found == {("other", "b"), ("usual", "a"), ("unknown", "a"), (None, "a")}
    assert rows.where(F.size("word_lists.noise_phrases") != 0).count() == 0
    assert lists(part.limit(0))[0] == {("other",), ("usual",), ("unknown",), (None,)}
    assert attached(spark, docs.limit(0)).count() == 0


def test_documents_are_not_moved_for_small_lists(spark, docs):
    words = vocabularies.vocabulary_table(spark, {"usual": USUAL, "other": OTHER})
    rows = vocabularies.attach_vocabulary(docs, words, vocabulary="name", spread_by="k", default="usual")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
