"""Every listed name is a row, whatever it holds."""

import os

import pytest
from pyspark.sql import functions as F

from fieldsift.plans.workflows import batch_folder
from fieldsift.sources.listing import list_documents, usable


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("listing")
    for name in ("a b+c.pdf", "_under.pdf", ".dot.pdf", "UPPER.PDF", "note.txt", "ł%20.pdf"):
        (root / name).write_text(f"{name}\nł", encoding="utf-8")
    (root / "empty.pdf").write_bytes(b"")
    (root / "bytes.pdf").write_bytes("zażółć".encode() + b"\xff\xfe")
    (root / "folder.pdf").mkdir()
    (root / "folder.pdf" / "_inner.pdf").write_text("inner")
    os.symlink(root / "gone", root / "dangling.pdf")
    return root


def by_name(rows, folder):
    return {os.path.relpath(r.source_path, folder): r for r in rows.collect()}


def test_every_name_is_a_row(spark, folder):
    rows = by_name(list_documents(spark, str(folder), slices=3), folder)
    assert {n: r.status for n, r in rows.items()} == {
        "a b+c.pdf": "ok", "_under.pdf": "ok", ".dot.pdf": "ok", "ł%20.pdf": "ok", "empty.pdf": "ok",
        "bytes.pdf": "not_utf8", "folder.pdf": "not_a_file", "dangling.pdf": "unreadable",
    }
    assert rows["_under.pdf"].text == "_under.pdf\nł" and rows["empty.pdf"].text == ""
    assert rows["_under.pdf"].size == 13 and rows["_under.pdf"].modified is not None
    assert rows["bytes.pdf"].text is None
    assert rows["bytes.pdf"].error == f"Not UTF-8 at byte 10: {folder}/bytes.pdf"


def test_pattern_folders_and_names_only(spark, folder):
    inner = by_name(list_documents(spark, f"file://{folder}", pattern="_*.pdf", recursive=True), folder)
    assert {n: r.text for n, r in inner.items()} == {
        "_under.pdf": "_under.pdf\nł", "folder.pdf/_inner.pdf": "inner"
    }
    names = list_documents(spark, str(folder), pattern="*", content=False)
    assert names.count() == 10 and names.where("text IS NOT NULL").count() == 0
    assert list_documents(spark, str(folder), pattern="*.none").count() == 0


def test_many_files_are_read_once_each(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"{'_.'[k % 2]}{k}.pdf").write_text(f"text {k}")
    listed = usable(list_documents(spark, str(tmp_path), slices=7))
    assert listed.rdd.getNumPartitions() == 7
    assert listed.select(F.count("*"), F.count_distinct("text")).head()[:] == (300, 300)


def test_a_folder_without_context_is_skipped_unread(spark, folder):
    items = batch_folder(spark, str(folder), "out")
    assert {r.status for r in items.collect()} == {"skipped"} and items.count() == 8


def test_no_such_folder(spark, tmp_path):
    with pytest.raises(Exception, match="none"):
        list_documents(spark, str(tmp_path / "none")).count()
