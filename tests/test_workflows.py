"""Workflows end to end, sources and sinks."""

import json

import pytest
from test_records import COMPLETE, contexts

from fieldsift.operators.reports import batch_totals, shared_outputs
from fieldsift.plans.workflows import (
    ContextNotUsable,
    batch_documents,
    generate_approvals,
    parse_documents,
    require_context,
)
from fieldsift.session import run_folder
from fieldsift.sources import sinks
from fieldsift.sources.documents import read_json_files, read_text_folder
from fieldsift.sources.publish import published_folder

LABELLED = "Material type: Cork mat\nDescription: Mat below parquet floors.\nOrder number: 12"
MISSING = "Producent: Lumen Wschód\nDescription: Ceiling lamp.\nTyp: LW-3"


def table(spark, rows, columns):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split()))


@pytest.fixture(scope="module")
def docs(spark):
    return table(
        spark,
        [("in/a.pdf", LABELLED), ("in/b.pdf", "abc 123"), ("in/c.pdf", MISSING)],
        "source_path text",
    )


@pytest.fixture(scope="module")
def templates(spark):
    return table(
        spark, [("t.txt", "{{ material_type }}|{{ manufacturer }}|{{ attachments_text }}")],
        "template_path template_text",
    )


def test_parse_messages_and_exit_codes(docs):
    rows = {r.source_path: r for r in parse_documents(docs, min_chars=20, debug=True).collect()}
    assert [rows[f"in/{n}.pdf"].exit_code for n in "abc"] == [0, 2, 1]
    assert rows["in/b.pdf"].message.splitlines() == [
        "PDF wygląda na skan (brak warstwy tekstowej).",
        "Zeskanuj do PDF z OCR / użyj wersji programu z OCR (planowane).",
        "Zapisano podgląd ekstrakcji: in/b_extracted.txt",
    ]
    assert rows["in/b.pdf"].diagnostics_text is None
    assert "material_type.fallback_selection: no_candidates" in rows["in/c.pdf"].diagnostics_text
    assert rows["in/c.pdf"].diagnostics_text.startswith("Parser diagnostics:\n- ")


def test_generate_status_precedence(spark, templates):
    good = json.dumps(COMPLETE)
    known = contexts(
        spark, [("in/context.json", good), ("bad/context.json", "{}"), ("odd/context.json", "[")]
    )
    rows = [
        ("in/ok.pdf", LABELLED, None, "t.txt"),
        ("in/scan.pdf", "abc", "gone.json", "t.txt"),
        ("in/missing.pdf", MISSING, "gone.json", "t.txt"),
        ("in/gone.pdf", LABELLED, "gone.json", "t.txt"),
        ("bad/invalid.pdf", LABELLED, None, "t.txt"),
        ("odd/json.pdf", LABELLED, None, "t.txt"),
        ("in/template.pdf", LABELLED, None, "none.txt"),
        ("far/scan.pdf", "abc", None, "t.txt"),
    ]
    docs = table(spark, rows, "source_path text wanted template_path")
    got = {
        r.source_path: r
        for r in generate_approvals(
            docs, known, templates, explicit_context="wanted", min_chars=20
        ).collect()
    }
    assert {k: (r.status, r.exit_code) for k, r in got.items()} == {
        "in/ok.pdf": ("ok", 0),
        "in/scan.pdf": ("non_text", 2),
        "in/missing.pdf": ("parse_error", 1),
        "in/gone.pdf": ("context_error", 3),
        "bad/invalid.pdf": ("invalid_data", 1),
        "odd/json.pdf": ("context_error", 3),
        "in/template.pdf": ("template_not_found", 1),
        "far/scan.pdf": ("context_error", 3),
    }
    assert got["in/ok.pdf"].output == "in/ok.docx"
    assert got["in/ok.pdf"].rendered == "Cork mat|Hager|—"
    assert got["in/template.pdf"].error == "Template not found: none.txt"
    assert all(r.rendered is None for k, r in got.items() if k != "in/ok.pdf")


def test_batch(spark, docs, templates):
    context = require_context(contexts(spark, [("c.json", json.dumps(COMPLETE))]))
    items = batch_documents(
        docs, "out", context=context, templates=templates, template_path="t.txt", min_chars=20
    )
    rows = {r.pdf: r for r in items.collect()}
    assert rows["in/a.pdf"].output == "out/a.docx" and rows["in/a.pdf"].error is None
    assert rows["in/b.pdf"].error == "PDF text too short: 7 chars (min 20)."
    assert rows["in/c.pdf"].error == "Missing required fields: material_type"
    assert batch_totals(items).head().asDict() == {"processed": 1, "errors": 2, "skipped": 0}

    absent = batch_documents(
        docs, "out", context=context, templates=templates, template_path="no.txt", min_chars=20
    )
    assert absent.where("pdf = 'in/a.pdf'").head().error == "Template not found: no.txt"

    skipped = batch_documents(docs, "out", context=context)
    assert batch_totals(skipped).head().asDict() == {"processed": 0, "errors": 0, "skipped": 3}
    assert "trim(" not in skipped._jdf.queryExecution().optimizedPlan().toString()


def test_batch_stops_on_an_unusable_context(spark):
    with pytest.raises(ContextNotUsable, match="Invalid JSON context file"):
        require_context(contexts(spark, [("c.json", "{")]))


@pytest.mark.parametrize(
    "files", [[], [("a.json", "{")], [(p, json.dumps(COMPLETE)) for p in ("a.json", "b.json")]]
)
def test_batch_needs_exactly_one_valid_context(spark, docs, templates, files):
    found = contexts(spark, files or [("a.json", "{}")])
    with pytest.raises(ContextNotUsable):
        batch_documents(
            docs,
            "out",
            context=found if files else found.limit(0),
            templates=templates,
            template_path="t.txt",
        )


def test_two_templates_of_one_path_are_not_picked_from(spark, docs, templates):
    context = contexts(spark, [("c.json", json.dumps(COMPLETE))])
    items = batch_documents(
        docs, "out", context=context, templates=templates.union(templates), template_path="t.txt"
    )
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        items.collect()


def test_work_folder_is_shared_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        run_folder(Session(), "x")
    Session.conf["spark.checkpoint.dir"] = "hdfs:///shared"
    assert run_folder(Session(), "x").startswith("hdfs:///shared/x-")


def test_shared_outputs(spark):
    items = table(spark, [("o/a",), ("o/b",), ("o/a",), (None,), (None,)], "output")
    assert [tuple(r) for r in shared_outputs(items).collect()] == [("o/a", 2)]


def test_text_folder_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a b+c.pdf", "two.pdf", "UPPER.PDF", "note.txt", "sub/inner.pdf"):
        (tmp_path / name).write_text(f"{name}\nł", encoding="utf-8")
    rows = {r.source_path: r.text for r in read_text_folder(spark, str(tmp_path)).collect()}
    assert rows == {
        f"{tmp_path}/a b+c.pdf": "a b+c.pdf\nł", f"{tmp_path}/two.pdf": "two.pdf\nł"
    }


def test_json_files_and_sinks(spark, tmp_path, docs):
    (tmp_path / "context.json").write_text(json.dumps(COMPLETE), encoding="utf-8")
    files = read_json_files(spark, str(tmp_path / "context.json"))
    assert files.head().path == str(tmp_path / "context.json")

    rows = table(spark, [("a", None)], "x y")
    sinks.write_json_records(rows, str(tmp_path / "records"))
    written = published_folder(spark, str(tmp_path / "records"), "records")
    assert spark.read.text(written).head()[0] == '{"x":"a","y":null}'
    assert rows.select(sinks.json_record("x", "y")).head()[0] == '{"x":"a","y":null}'

    items = batch_documents(docs, "out").drop("rendered")
    sinks.write_batch_report(items, str(tmp_path / "report"))
    totals = published_folder(spark, str(tmp_path / "report"), "totals")
    assert json.loads(spark.read.text(totals).head()[0]) == {"processed": 0, "errors": 0, "skipped": 3}
    items = published_folder(spark, str(tmp_path / "report"), "items")
    written = [json.loads(r[0]) for r in spark.read.text(items).collect()]
    assert sorted(w["pdf"] for w in written) == ["in/a.pdf", "in/b.pdf", "in/c.pdf"]
    assert set(written[0]) == {"pdf", "status", "reason"}
