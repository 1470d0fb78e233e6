"""JSON records, context resolution, approvals and templates."""

import json

import pytest
from pyspark.sql import functions as F

from fieldsift.operators.approval import (
    attachments_text,
    needed_contexts,
    resolve_contexts,
    select_attachments,
)
from fieldsift.operators.pages import assemble_pages
from fieldsift.operators.records import read_contexts, read_materials
from fieldsift.operators.templates import fill_template, split_templates

COMPLETE = {
    "investor_name": "Investor",
    "project_title": "Project",
    "contractor_name": "Contractor",
    "manufacturer": "Hager",
    "estimated_quantity": "10 szt.",
    "planned_delivery_date": "2026-01-01",
    "planned_installation_date": "2026-01-10",
    "prepared_by_name": "Jan Kowalski",
    "prepared_by_role": "Engineer",
}


def contexts(spark, files):
    return read_contexts(spark.createDataFrame(files, "path string, content string"))


@pytest.mark.parametrize(
    ("path", "content", "status", "error"),
    [
        ("a.json", json.dumps(COMPLETE), "ok", None),
        ("a.JSON", json.dumps(COMPLETE | {"more": {"x": 1}}), "ok", None),
        ("a.json", None, "context_error", "Context file not found: a.json"),
        ("a.json", "{", "context_error", "Invalid JSON context file."),
        ("a.json", "[]", "context_error", "Context data must be a mapping."),
        ("a.json", '"x"', "context_error", "Context data must be a mapping."),
        ("a.txt", "{}", "context_error", "Unsupported context format: .txt"),
        ("a", "{}", "context_error", "Unsupported context format: "),
        ("a.yml", "a: b", "context_error", "PyYAML is not installed. Install the yaml extra."),
        (
            "a.json",
            json.dumps(COMPLETE | {"manufacturer": 5, "output_dir": [], "attachments": ["a", 1]}),
            "invalid_data",
            "Invalid or incomplete input data: output_dir: Input should be a valid string; "
            "manufacturer: Input should be a valid string; "
            "attachments.1: Input should be a valid string",
        ),
        (
            "a.json",
            json.dumps({k: v for k, v in COMPLETE.items() if k != "project_title"}),
            "invalid_data",
            "Invalid or incomplete input data: project_title: Field required",
        ),
    ],
)
def test_read_contexts(spark, path, content, status, error):
    row = contexts(spark, [(path, content)]).head()
    assert (row.context_status, row.context_error) == (status, error)
    assert (row.context is not None) == (status == "ok")


@pytest.mark.parametrize(
    "content",
    [
        json.dumps(COMPLETE) + " x",
        json.dumps(COMPLETE) * 2,
        json.dumps(COMPLETE) + "}",
        json.dumps(COMPLETE) + "]",
        json.dumps(COMPLETE) + ", 1",
        "1, " + json.dumps(COMPLETE),
    ],
)
def test_a_context_file_is_one_json_value(spark, content):
    row = contexts(spark, [("c.json", content)]).head()
    assert row.context_status == "context_error" and "Invalid JSON" in row.context_error


def test_the_last_of_repeated_keys_counts(spark):
    twice = json.dumps(COMPLETE)[:-1] + ', "investor_name": "Last"}'
    row = contexts(spark, [("c.json", twice)]).head()
    assert row.context_status == "ok" and row.context.investor_name == "Last"


def test_read_materials(spark):
    files = [
        ("ok", '{"material_type": "M", "description": "D", "attachments": ["Spec A"]}'),
        ("bad", '{"material_type": null}'),
        ("list", "[1]"),
    ]
    rows = {
        r.path: r for r in read_materials(spark.createDataFrame(files, "path string, content string")).collect()
    }
    assert rows["ok"].material.asDict() == {
        "source_path": None, "raw_text": None, "material_type": "M", "description": "D",
        "attachments": ["Spec A"],
    }
    assert rows["bad"].error == (
        "Invalid or incomplete input data: material_type: Input should be a valid string; "
        "description: Field required"
    )
    assert rows["list"].status == "invalid_data"


@pytest.mark.parametrize("salts", [1, 5])
def test_context_precedence(spark, salts):
    good = json.dumps(COMPLETE)
    known = contexts(
        spark,
        [("given.json", good), ("near/context.json", good), ("broken/context.json", "{"), ("work/context.json", good)],
    )
    docs = spark.createDataFrame(
        [
            ("near/a.pdf", "given.json"), ("near/b.pdf", "absent.json"), ("near/c.pdf", None),
            ("far/d.pdf", None), ("broken/e.pdf", None),
        ],
        "source_path string, wanted string",
    )

    def resolved(folder):
        rows = resolve_contexts(
            docs, known, explicit_path="wanted", working_folder=folder, salts=salts
        ).collect()
        return {r.source_path: (r.context_path, r.context_status, r.context_error) for r in rows}

    got = resolved("work")
    assert got["near/a.pdf"] == ("given.json", "ok", None)
    assert got["near/b.pdf"] == (
        "absent.json", "context_error", "Context file not found: absent.json"
    )
    assert got["near/c.pdf"] == ("near/context.json", "ok", None)
    assert got["far/d.pdf"] == ("work/context.json", "ok", None)
    # The nearer context exists, so its defect counts.
    assert got["broken/e.pdf"][1:] == ("context_error", "Invalid JSON context file.")
    nowhere = resolved("elsewhere")["far/d.pdf"]
    assert nowhere[0] is None and "Add context.json next to the PDF" in nowhere[2]


def test_only_needed_contexts_are_parsed_and_each_once(spark, tmp_path):
    good = json.dumps(COMPLETE)
    files = [
        ("given.json", good), ("near/context.json", good), ("broken/context.json", "{"),
        ("work/context.json", good), ("other/context.json", good), ("near/given.json", good),
    ]
    spark.createDataFrame(files, "path string, content string").write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    docs = spark.createDataFrame(
        [("near/a.pdf", "given.json"), ("near/b.pdf", None), ("near/c.pdf", None),
         ("broken/e.pdf", None), ("far/d.pdf", None), (None, None), ("near/a.pdf", "absent.json")],
        "source_path string, wanted string",
    )
    options = {"explicit_path": "wanted", "working_folder": "work"}
    known = needed_contexts(docs, files, **options)
    assert {r.context_path for r in known.collect()} == {
        "given.json", "near/context.json", "broken/context.json", "work/context.json"
    }
    resolved = resolve_contexts(docs, known, **options)
    whole = resolve_contexts(docs, read_contexts(files), **options)
    assert sorted(map(str, resolved.collect())) == sorted(map(str, whole.collect()))
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in plan and "EqualTo(context_path,work/context.json)" in plan


def test_no_document_needs_no_context_but_the_usual_one(spark):
    files = spark.createDataFrame(
        [("context.json", "{"), ("a/context.json", "{")], "path string, content string"
    )
    docs = spark.createDataFrame([], "source_path string")
    assert [r.context_path for r in needed_contexts(docs, files).collect()] == ["context.json"]
    assert needed_contexts(docs, files.limit(0)).count() == 0


def test_threads_do_not_disturb_each_others_parsing(spark):
    from concurrent.futures import ThreadPoolExecutor

    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    twice = json.dumps(COMPLETE)[:-1] + ', "manufacturer": "Last"}'
    with ThreadPoolExecutor(8) as pool:
        rows = list(pool.map(lambda _: contexts(spark, [("a.json", twice)]).head(), range(16)))
    assert {r.context.manufacturer for r in rows} == {"Last"}
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("salts", [1, 16])
def test_lookup_of_a_hot_key_is_whole_when_shuffled(spark, salts):
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("hot/"), "id"))
        .otherwise(F.concat(F.lit("d"), "id", F.lit("/x")))
        .alias("source_path")
    )
    known = contexts(spark, [("hot/context.json", json.dumps(COMPLETE)), ("d3/context.json", "{")])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = resolve_contexts(docs, known, salts=salts).groupBy("context_path").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {r.context_path: r["count"] for r in counts} == {
        "hot/context.json": 2000, "d3/context.json": 1, None: 999
    }


def test_attachments(spark):
    rows = spark.createDataFrame(
        [(["Attachment 1", "Attachment 2"], ["Spec A"]), ([], ["Spec A"]), ([], [])],
        "c array<string>, m array<string>",
    )
    got = rows.select(attachments_text(select_attachments(F.col("c"), F.col("m")))).collect()
    assert [r[0] for r in got] == ["1. Attachment 1\n2. Attachment 2", "1. Spec A", "—"]


@pytest.mark.parametrize(
    ("template", "expected"),
    [
        ("{{ a }}-{{b}}", "x$1\\-{{ a }}"),
        ("no names", "no names"),
        ("{{ unknown }}{{\ta }}", "x$1\\"),
        ("{{ a }}\n{{ a }}\n", "x$1\\\nx$1\\\n"),
        ("{ a } {{ }} {{ a b }}", "{ a } {{ }} {{ a b }}"),
    ],
)
def test_fill_template_never_rescans_values(spark, template, expected):
    rows = split_templates(
        spark.createDataFrame([("t", template)], "template_path string, template_text string")
    )
    values = F.create_map(F.lit("a"), F.lit("x$1\\"), F.lit("b"), F.lit("{{ a }}"))
    assert rows.select(fill_template(F.col("template"), values)).head()[0] == expected


def test_page_assembly_in_blocks(spark):
    pages = [("d", n, None if n % 7 == 0 else f"p{n}") for n in range(1, 1000)] + [("e", 4, "x")]
    rows = spark.createDataFrame(pages, "source_path string, page_no int, text string")
    got = {r.source_path: r.text for r in assemble_pages(rows.repartition(5)).collect()}
    assert got["e"] == "x"
    assert got["d"] == "\n".join("" if n % 7 == 0 else f"p{n}" for n in range(1, 1000))
