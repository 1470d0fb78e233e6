"""Benchmark decontamination with one Aho-Corasick automaton.

Questions and answers are normalised to lower-case words, and every run of ``window``
words (or a shorter item as a whole) is a pattern of one automaton.  A document is
normalised once and scanned once; matches are mapped back to words and, for the documents
that have any, to offsets in the original text.

The automaton goes to every task, so the patterns of one pass are bounded by
``PASS_BYTES``; a larger benchmark is split into passes by window, and the hits of a
document are united afterwards.  No item, window or document is left out.

Defined results: a null or wordless text has no words and no hits; a null or wordless
item has no windows; repeated items count once by id; windows of items without an id are hits, but no
id is listed or counted for them; an empty benchmark hits nothing.
Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.common import id_and_text, parts, stored

WINDOW = 10
PASS_BYTES = 16 << 20
#: Word bytes: digits, letters and everything outside ASCII.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NORMAL = bytes(
    (c | 0x20 if 65 <= c <= 90 else c) if _WORD.match(bytes([c])) else 0x20 for c in range(256)
)

HIT_SCHEMA = (
    "doc_id long, row long, n_words long, first_words array<long>, last_words array<long>, "
    "begins array<long>, ends array<long>, items array<string>"
)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def item_windows(items: Iterable[tuple[str, str | None]], window: int) -> dict[str, list[str]]:
    """Pattern -> ids of the items that have it; spaces around keep whole words."""
    found: dict[str, set[str]] = {}
    for item, text in items:
        words = normal_words(text)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            pattern = b" " + b" ".join(words[k : k + window]) + b" "
            found.setdefault(pattern.decode("latin-1"), set()).add(item)
    return {p: sorted(i for i in ids if i is not None) for p, ids in found.items()}


def _windows(items: DataFrame, window: int) -> DataFrame:
    """All windows as rows (pattern, item_ids), made where the items are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            found = item_windows(zip(rows["item_id"], rows["text"], strict=True), window)
            yield pa.RecordBatch.from_pydict(
                {
                    "pattern": pa.array(list(found), pa.string()),
                    "item_ids": pa.array(list(found.values()), pa.list_(pa.string())),
                }
            )

    rows = items.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return (
        rows.mapInArrow(run, "pattern string, item_ids array<string>")
        .select("pattern", F.explode_outer("item_ids").alias("item_id"))
        .groupBy("pattern")
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    )


def _passes(windows: DataFrame) -> int:
    """How many passes keep patterns and their item ids within PASS_BYTES each."""
    ids = F.length(F.array_join("item_ids", ",")) + 16 * F.size("item_ids")
    return parts(windows.agg(F.sum(F.length("pattern") + 48 + ids)).first()[0] or 0, PASS_BYTES)


_automata: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, windows: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    """Built once a Python worker; only the last pass is held."""
    if key not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for pattern, ids in windows:
            made.add_word(pattern, (len(pattern), ids))
        made.make_automaton()
        _automata[key] = made
    return _automata[key]


def _scan_text(text: str | None, automaton) -> tuple[int, list, list, list, list, list]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.translate(_NORMAL).split()
    firsts, lasts, items = [], [], set()
    if words and len(automaton):
        scanned = (b" " + b" ".join(words) + b" ").decode("latin-1")
        hits = [(end, size, ids) for end, (size, ids) in automaton.iter(scanned)]
        if hits:
            begins = np.cumsum([1] + [len(w) + 1 for w in words])
            for end, size, ids in hits:
                firsts.append(int(np.searchsorted(begins, end - size + 2)))
                lasts.append(int(np.searchsorted(begins, end + 1)) - 1)
                items.update(ids)
    if not firsts:
        return len(words), [], [], [], [], []
    spans = united(sorted(zip(firsts, lasts, strict=True)))
    # Offsets in characters of the original: bytes of words, then bytes to characters.
    places = [m.span() for m in _WORD.finditer(data)]
    chars = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    begins = [int(chars[places[a][0]]) - 1 for a, _ in spans]
    ends = [int(chars[places[b][1] - 1]) for _, b in spans]
    return len(words), [a for a, _ in spans], [b for _, b in spans], begins, ends, sorted(items)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans of words, both ends included, with overlaps merged."""
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def _one_pass(docs: DataFrame, shared, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared.value)
        for batch in batches:
            found = [_scan_text(t.as_py(), automaton) for t in batch.column(1)]
            columns = [list(c) for c in zip(*found, strict=True)] or [[] for _ in range(6)]
            kinds = [pa.int64()] + [pa.list_(pa.int64())] * 4 + [pa.list_(pa.string())]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["n_words", "first_words", "last_words", "begins", "ends", "items"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *arrays], ["doc_id", "row", *names]
            )

    return docs.mapInArrow(run, HIT_SCHEMA)


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: word count, hit spans (words; characters of the text) and items.

    ``begins`` and ``ends`` are character offsets, the end not included.
    """
    windows = stored(_windows(items, window), "windows")
    passes = _passes(windows)
    texts = id_and_text(docs).withColumn("row", F.monotonically_increasing_id())
    found = None
    for k in range(passes):
        # At most PASS_BYTES of patterns, on the average over hash classes.
        own = windows.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k)
        held = [(r["pattern"], list(r["item_ids"])) for r in own.collect()]
        shared = docs.sparkSession.sparkContext.broadcast(held)
        part = _one_pass(texts, shared, uuid.uuid4().hex)
        if passes > 1:  # the driver holds the windows of one pass only
            part = stored(part, "hits")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found if passes == 1 else _united_passes(found)


def _united_passes(found: DataFrame) -> DataFrame:
    """The hits of several passes over the same rows, put together by row."""

    def merge(rows):
        spans = sorted(
            {
                (a, b): (x, y)
                for r in rows.itertuples()
                for a, b, x, y in zip(r.first_words, r.last_words, r.begins, r.ends, strict=True)
            }.items()
        )
        starts = {a: x for (a, _), (x, _) in spans}
        stops = {b: y for (_, b), (_, y) in spans}
        whole = united([s for s, _ in spans])
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].iloc[:1],
                "row": rows["row"].iloc[:1],
                "n_words": rows["n_words"].iloc[:1],
                "first_words": [[a for a, _ in whole]],
                "last_words": [[b for _, b in whole]],
                "begins": [[starts[a] for a, _ in whole]],
                "ends": [[stops[b] for _, b in whole]],
                "items": [sorted({i for v in rows["items"] for i in v})],
            }
        )

    clean = found.groupBy("row").agg(F.max(F.size("first_words")).alias("n")).where("n = 0")
    hit = found.where(F.size("first_words") > 0)
    dirty = hit.join(hit.select("row").distinct(), "row").select(found.columns)
    merged = dirty.groupBy("row").applyInPandas(merge, HIT_SCHEMA)
    rest = found.join(clean, "row", "left_semi").dropDuplicates(["row"])
    return merged.unionByName(rest)


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest columns of a scan, one row per document."""
    none = hashlib.sha256(b"").hexdigest()
    hits = scan(docs, items, window)
    words = F.transform(
        F.arrays_zip("first_words", "last_words"),
        lambda s: s["last_words"] - s["first_words"] + 1,
    )
    n_hit = F.aggregate(words, F.lit(0).cast("long"), lambda total, x: total + x)
    ids = F.array_join("items", ",")
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.when(F.size("items") == 0, F.lit(none)).otherwise(F.sha2(ids, 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "begins",
        "ends",
    )


def cleaned(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any hit, decided and kept in one scan of the text."""
    spark = docs.sparkSession
    names, schema = docs.columns, docs.schema
    at = names.index("text")
    windows = stored(_windows(items, window), "windows")
    passes = _passes(windows)
    left = docs
    for k in range(passes):
        own = windows.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k)
        held = [(r["pattern"], list(r["item_ids"])) for r in own.collect()]
        shared = spark.sparkContext.broadcast(held)

        def run(batches, shared=shared, key=uuid.uuid4().hex):
            automaton = _automaton(key, shared.value)
            for batch in batches:
                free = [not _scan_text(t.as_py(), automaton)[1] for t in batch.column(at)]
                yield batch.filter(pa.array(free, pa.bool_()))

        left = left.mapInArrow(run, schema)
        if passes > 1:
            left = stored(left, "free")
            shared.destroy()
    return left
