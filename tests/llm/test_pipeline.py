"""The whole pipeline on a small corpus with planted cases, against brute force."""

import random
import re
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fieldsift.llm import quality, sharding
from fieldsift.llm.queries import tokenizer_path
from pyspark.sql import functions as F

# Columns beside those of documents carry names that the operators use for themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _digest string, row long"
CAPACITY, END = 1024, 2


def prose(rng, n):
    words = [f"w{rng.randrange(4000):04d}"[: rng.randrange(3, 6)] + "aeiou"[rng.randrange(5)] for _ in range(n)]
    return " ".join(w + "." * (k % 12 == 11) for k, w in enumerate(words)).capitalize() + "."


def junk(rng, n):
    return " ".join("".join(rng.choices("#$%&*<>|~0123456789", k=9)) for _ in range(n))


def corpus():
    rng = random.Random(20)
    good = {k: prose(rng, rng.randrange(60, 260)) for k in range(300)}
    bad = {k: junk(rng, rng.randrange(60, 260)) for k in range(1000, 1120)}
    clean = dict(good)
    items = [("long", prose(rng, 30)), ("short", "Seven little foxes sing."), ("none", "?!"), (None, prose(rng, 14)), ("null", None)]

    def with_passage(k, passage):
        head, tail = good[k].split(" ")[:30], good[k].split(" ")[30:]
        clean.pop(k)
        good[k] = " ".join([*head, passage, *tail])

    passage = items[0][1].split(" ")
    with_passage(10, " ".join(passage[7:17]).upper())
    with_passage(11, "seven LITTLE foxes -- sing")
    with_passage(12, items[3][1])
    with_passage(13, " ".join(passage[3:12]))  # nine words are no window
    exact, near = {}, {}
    for k in range(400, 460):  # copies of a few, one of them very often
        exact[k] = good[20] if k < 440 else good[21 + k % 5]
    for k in range(500, 540):  # a chain of close texts
        parts = (near.get(k - 1) or good[30]).split(" ")
        parts[(k * 7) % len(parts)] = f"word{k}"
        near[k] = " ".join(parts)
    half = good[31].split(" ")
    near[560] = " ".join(half[: len(half) // 2]) + " " + prose(rng, len(half) // 2)
    long = {600: prose(rng, 9000)}
    rows = {**good, **bad, **exact, **near, **long, 700: "", 701: None}
    table = [(k, t, "en", f"s{k % 3}", len(t or ""), f"mark {k}", k) for k, t in rows.items()]
    table += [(5, *table[5][1:]), (None, prose(rng, 80), None, None, None, "no id", 1)]
    labels = [(k, int(k < 1000), 0) for k in [*good, *bad]]
    return table, items, labels, set(bad), set(clean)


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def near_classes(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {k: top(k) for k in ids}


def contaminated(text, items):
    def words(s):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)

    windows = set()
    for _, item in items:
        own = words(item)
        windows |= {tuple(own[k : k + 10]) for k in range(max(1, len(own) - 9))} if own else set()
    own = words(text)
    return any(tuple(own[k : k + len(w)]) == w for w in windows for k in range(len(own) - len(w) + 1))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    table, items, labels, _, _ = corpus()
    base = str(tmp_path_factory.mktemp("corpus"))
    frames = {
        "documents": spark.createDataFrame(table, SCHEMA).repartition(5),
        "benchmark": spark.createDataFrame(items, "item_id string, text string"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{base}/{name}.parquet")
    return base


def test_run_against_brute_force(spark, folder):
    table, items, labels, bad, clean = corpus()
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]

    taught = [(t[1], q) for t in table for k, q, _ in labels if t[0] == k and zlib.crc32(str(k).encode()) % 4 != 2]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    learned = quality.learned(docs, spark.read.parquet(f"{folder}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    scores = learned.scores(quality.feature_rows([t[1] for t in table]))
    right = sum((s >= quality.THRESHOLD) == (t[0] < 1000) for t, s in zip(table, scores, strict=True) if t[0] in bad | clean)
    assert taught and right >= 0.99 * len(bad | clean)
    accepted = {(t[0], t[1]) for t, s in zip(table, scores, strict=True) if s >= quality.THRESHOLD}

    by_text = defaultdict(list)
    for k, t in accepted:
        by_text[t or ""].append(k)
    distinct = {max(ids, key=lambda k: (k is not None, k or 0)): t for t, ids in by_text.items()}
    nameless = {k: t for k, t in distinct.items() if k is None}
    named = {k: t for k, t in distinct.items() if k is not None}
    classes = near_classes(named)
    kept = {k: t for k, t in named.items() if classes[k] == k} | nameless
    kept = {k: t for k, t in kept.items() if not contaminated(t, items)}

    assert {p["doc_id"] for p in pieces} == set(kept)
    assert not set(kept) & (bad | {10, 11, 12}) and 13 in kept and 560 in kept and 600 in kept
    assert len(set(kept) & clean) >= 0.9 * len(clean)

    tokenizer = Tokenizer.from_file(tokenizer_path())
    sequences, own = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        own[p["doc_id"]].append(p)
    for k, text in kept.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, END]
        parts = sorted(own[k], key=lambda p: p["piece"])
        assert [p["start"] for p in parts] == [sum(q["length"] for q in parts[:n]) for n in range(len(parts))]
        assert sum(p["length"] for p in parts) == len(ids)
        for p in parts:
            raw = b"".join(i.to_bytes(4, "little") for i in ids[p["start"] : p["start"] + p["length"]])
            assert zlib.crc32(raw) == p["ids_crc32"]
    for held in sequences.values():
        ends = 0
        for offset, length in sorted(held):
            assert offset == ends
            ends += length
        assert ends <= CAPACITY
    total = sum(p["length"] for p in pieces)
    assert len(sequences) <= 1.05 * -(-total // CAPACITY) + 1


def test_stages_keep_all_columns_of_their_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns, name
        assert all(r["_digest"] in (f"mark {r['doc_id']}", "no id") for r in kept.collect()), name


def test_run_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_is_a_bijection_of_unit_steps(spark, dimensions, bits):
    side = 1 << bits
    cells = [F.floor(F.col("id") / side**k) % side for k in range(dimensions)]
    rows = spark.range(side**dimensions).select(*[c.alias(f"c{k}") for k, c in enumerate(cells)])
    index = sharding.hilbert_index([F.col(f"c{k}") for k in range(dimensions)], bits)
    got = sorted((r["at"], [r[f"c{k}"] for k in range(dimensions)]) for r in rows.withColumn("at", index).collect())
    assert [at for at, _ in got] == list(range(side**dimensions))
    for (_, a), (_, b) in zip(got, got[1:], strict=False):
        assert sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1
