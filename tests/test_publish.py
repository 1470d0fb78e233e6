"""Parts appear together; a job that runs again carries on."""

import json

import pytest
from pyspark.sql import functions as F

from fieldsift.session import named_run_folders, remove_run_folders, run_folder
from fieldsift.sources import sinks
from fieldsift.sources.publish import NotPublished, Publication, published, published_folder
from fieldsift.sources.store import Store

ITEMS = "pdf string, status string, output string, error string, reason string"


@pytest.fixture(scope="module")
def items(spark):
    status = ["ok", "error", "skipped", "ok"]
    return spark.createDataFrame(
        [(f"{k}.pdf", status[k % 4], None, None, None) for k in range(40)], ITEMS
    ).repartition(3)


class Lost(Exception):
    """The driver is gone."""


def lose_before(monkeypatch, part):
    whole = Publication.part

    def until(self, name, *rest, **counted):
        if name == part:
            raise Lost
        return whole(self, name, *rest, **counted)

    monkeypatch.setattr(Publication, "part", until)


def test_a_driver_lost_between_items_and_totals(spark, items, tmp_path, monkeypatch):
    path = str(tmp_path / "report")
    with monkeypatch.context() as patched:
        lose_before(patched, "totals")
        with pytest.raises(Lost):
            sinks.write_batch_report(items, path, run="r1")
    with pytest.raises(NotPublished):
        sinks.read_batch_report(spark, path, ITEMS)

    # The finished items stay; only the totals are written, from what was observed.
    counted = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: counted.add(1) or x, "string")
    again = items.withColumn("pdf", seen("pdf"))
    facts = sinks.write_batch_report(again, path, run="r1")
    assert counted.value == 0
    assert facts["items"] == {"rows": 40, "processed": 20, "errors": 10, "skipped": 10}
    got, totals = sinks.read_batch_report(spark, path, ITEMS)
    assert got.count() == 40 and tuple(totals.head()) == (20, 10, 10)

    # The same run again does nothing, another one must say that it replaces the report.
    assert sinks.write_batch_report(again, path, run="r1") == facts and counted.value == 0
    with pytest.raises(FileExistsError):
        sinks.write_batch_report(items, path)
    sinks.write_batch_report(items.limit(5), path, mode="overwrite")
    assert sinks.read_batch_report(spark, path, ITEMS)[0].count() == 5


def test_a_driver_lost_within_a_part(spark, items, tmp_path):
    path = str(tmp_path / "rows")

    def half(rows, folder):
        rows.limit(7).write.parquet(folder)
        raise Lost

    first = Publication(spark, path, run="a")
    with pytest.raises(Lost):
        first.part("rows", items, half)
    # Another run removes what is left of it and is not disturbed.
    second = Publication(spark, path, run="b")
    assert Store(spark, path).names(path) == []
    second.part("rows", items, lambda rows, folder: rows.write.parquet(folder))
    assert second.publish()["rows"]["rows"] == 40
    assert spark.read.parquet(published_folder(spark, path, "rows")).count() == 40
    assert published(spark, path)["run"] == "b"


def test_the_published_output_stays_until_the_next_is_whole(spark, items, tmp_path):
    path = str(tmp_path / "rows")
    sinks.write_render_rows(items, path, run="old")
    new = Publication(spark, path, run="new", mode="overwrite")
    new.part("rows", items.limit(3), lambda rows, folder: rows.write.parquet(folder))
    assert spark.read.parquet(published_folder(spark, path, "rows")).count() == 40
    new.publish()
    assert spark.read.parquet(published_folder(spark, path, "rows")).count() == 3
    assert sorted(Store(spark, path).names(path)) == ["attempt-new", "published.json"]


def test_empty_rows_are_counted(spark, items, tmp_path):
    facts = sinks.write_batch_report(items.where("1 = 0"), str(tmp_path / "r"))
    assert facts["items"] == {"rows": 0, "processed": 0, "errors": 0, "skipped": 0}


def test_items_are_scanned_once(spark, items, tmp_path):
    counted = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: counted.add(1) or x, "string")
    sinks.write_batch_report(items.withColumn("pdf", seen("pdf")), str(tmp_path / "r"))
    assert counted.value == 40


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write(f"{tmp_path}/x", json.dumps({"ł": 1}))
    assert json.loads(store.read(f"{tmp_path}/x")) == {"ł": 1}
    assert store.names(str(tmp_path)) == ["x"] and store.names(f"{tmp_path}/none") == []
    store.delete(f"{tmp_path}/x")
    assert not store.exists(f"{tmp_path}/x")


def test_run_folders_are_removed(spark, items):
    before = named_run_folders()
    folder = run_folder(spark, "gone")
    items.write.parquet(folder)
    assert Store(spark, folder).exists(folder)
    assert remove_run_folders(spark, before) == 1 and named_run_folders() == before
    assert not Store(spark, folder).exists(folder)
