"""Hard negatives, sketch near-duplicates and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldsift.llm import hard_negatives, periodic, queries, setsketch

DOCS = "doc_id long, text string, row long, regs string, runs int, key long, node long"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# ---- periodic runs


def brute_runs(seq, least=12):
    found = []
    for q in range(1, len(seq) // 2 + 1):
        i = q
        while i < len(seq):
            if seq[i] != seq[i - q]:
                i += 1
                continue
            begin = i
            while i < len(seq) and seq[i] == seq[i - q]:
                i += 1
            start, end = begin - q, i
            shorter = (all(seq[k] == seq[k - p] for k in range(start + p, end)) for p in range(1, q))
            if end - start >= max(least, 2 * q) and not any(shorter):
                found.append((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        kind = rng.randrange(4)
        if kind == 0:
            yield [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(90))]
        elif kind == 1:
            unit = [rng.randrange(rng.choice([2, 40])) for _ in range(rng.randrange(1, 45))]
            yield (unit * rng.randrange(1, 7))[: rng.randrange(1, 200)]
        elif kind == 2:
            out = []
            while len(out) < 150:
                out += [rng.randrange(3) for _ in range(rng.randrange(1, 12))] * rng.randrange(1, 9)
            yield out
        else:
            block = [0] * rng.randrange(1, 30)
            out = (block + [1]) * rng.randrange(1, 6) + block
            for _ in range(rng.randrange(3)):
                out[rng.randrange(len(out))] = 2
            yield out


@pytest.mark.parametrize("least", [2, 3, 7, 12])
def test_runs_of_sequences(least):
    for seq in sequences(least, 250):
        assert periodic.runs_of(np.array(seq, np.int64), least) == brute_runs(seq, least), seq


def test_long_periods_and_long_texts():
    rng = random.Random(5)
    for period in (31, 32, 33, 255, 256, 257, 700):
        unit = [rng.randrange(50) for _ in range(period)]
        seq = [60] + unit * 3 + [61] + unit[:5]
        assert periodic.runs_of(np.array(seq, np.int64)) == brute_runs(seq)
    assert periodic.runs_of(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    unit = list(range(40))
    assert periodic.runs_of(np.array(unit * 3000, np.int64)) == [(0, 120_000, 40)]


@pytest.fixture(scope="module")
def run_docs(spark):
    texts = [" ".join(map(str, s)) for s in sequences(77, 160)]
    texts += [None, "", " \n\t", "a", "A a " * 9, "a\x85a " * 20, "ü ł " * 8, "x " * 30_000]
    rows = [(k, t, 1, "r", 2, 3, 4) for k, t in enumerate(texts)]
    rows += [rows[3], (None, "b c " * 10, 1, "r", 2, 3, 4)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def test_periodic_runs(run_docs):
    texts = Counter((r.doc_id, r.text) for r in run_docs.collect())
    got = periodic.periodic_runs(run_docs).collect()
    assert len(got) == sum(texts.values())
    by_id = {i: t for i, t in texts}
    for r in got:
        seq = words(by_id[r.doc_id])
        if len(seq) > 1000:
            assert [tuple(x) for x in r.runs] == [(0, len(seq), 1)] and r.collapsed == "x"
            continue
        want = brute_runs(seq)
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(seq)
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for k, w in enumerate(seq) if k not in gone)
    assert periodic.periodic_runs(run_docs.limit(0)).collect() == []


def test_query_of_periodic_runs(spark, run_docs, tmp_path):
    run_docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    by_id = {r.doc_id: r.text for r in run_docs.collect()}
    some = 0
    for r in got:
        seq = words(by_id[r.doc_id])
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and seq:
            n, g = len(seq), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            seq = [seq[i] if i < a else seq[a + (i - a) % p] for i in range(n)]
            some += 1
        if len(seq) > 1000:
            continue
        want = brute_runs(seq)
        text = "".join(f"{s},{n},{q}\n" for s, n, q in want)
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r.n_runs == len(want)
        assert r.runs_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        kept = " ".join(w for k, w in enumerate(seq) if k not in gone)
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert some > 5


# ---- sketches


def random_sets(rng, n, similarity):
    shared = round(2 * n * similarity / (1 + similarity))
    pool = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
    return [np.unique(pool[:n]), np.unique(pool[n - shared :])]


@pytest.mark.parametrize("n", [1, 3, 40, 700, 9000])
def test_sketches_merge_and_estimate(n):
    rng = np.random.default_rng(n)
    one, two = random_sets(rng, n, 0.5)
    sketch = setsketch.sketches([one, two, np.union1d(one, two), np.zeros(0, np.uint64)])
    assert (sketch[2] == setsketch.merged(sketch[0], sketch[1])).all()
    assert (sketch[3] == 0).all()
    # The same set gives the same sketch, alone or beside others.
    assert (setsketch.sketches([two])[0] == sketch[1]).all()


def test_registers_follow_their_law():
    """The least point of n shingles in a register is exponential with rate n * RATE."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, 50, dtype=np.uint64)) for _ in range(300)]
    values = setsketch.sketches(sets).ravel()
    for value in range(int(np.percentile(values, 5)), int(np.percentile(values, 95))):
        # A register is at least v when the least point is at most BASE ** (1 - v).
        want = 1 - np.exp(-50 * setsketch.RATE * setsketch.BASE ** (1.0 - value))
        assert abs((values >= value).mean() - want) < 0.012


def test_joint_estimate_and_pruning():
    rng = np.random.default_rng(2)
    size = np.array([400.0])
    for similarity in (0.2, 0.5, 0.7, 0.85, 0.95):
        found, kept = [], []
        for _ in range(40):
            sketch = setsketch.sketches(random_sets(rng, 400, similarity))
            counts = setsketch._compared(sketch[:1], sketch[1:])
            found.append(setsketch.estimated(*counts, size, size)[0])
            kept.append(setsketch.possible(*counts, size, size, 85)[0])
        assert abs(np.mean(found) - similarity) < 0.03
        if similarity >= 0.85:
            assert all(kept)
        if similarity <= 0.5:
            assert not any(kept)


def brute_groups(texts, size, percent):
    def shingles(text):
        ws = words((text or "").translate({k: k + 32 for k in range(65, 91)}))
        if not ws:
            return set()
        return {tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))}

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and both:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 150))) for _ in range(90)]
    for k in range(120):  # chains: a copy of a copy with one more word changed
        parts = texts[rng.choice([5, 6, len(texts) - 1, len(texts) - 2])].split()
        parts[rng.randrange(len(parts))] = f"x{k}"
        texts.append(" ".join(parts))
    texts += [texts[3]] * 6 + [texts[4].upper(), None, "", " \t", "one", "ONE ", "a b c", "a b  c"]
    texts.append(" ".join(f"w{rng.randrange(5000)}" for _ in range(30_000)))
    texts.append(texts[-1] + " more")
    return texts


@pytest.mark.parametrize("size,percent", [(5, 85), (3, 70)])
def test_near_duplicates(spark, near_texts, size, percent):
    rows = [(k, t, 1, "r", 2, 3, 4) for k, t in enumerate(near_texts)]
    docs = spark.createDataFrame([*rows, rows[7], (None, "zzz", 1, "r", 2, 3, 4)], DOCS).repartition(6)
    got = setsketch.near_duplicates(docs, size, percent).collect()
    assert len(got) == len(rows) + 2
    sizes, groups = brute_groups(near_texts, size, percent)
    for r in got:
        if r.doc_id is None:
            assert (r.n_shingles, r.component_id) == (1, None)
        else:
            assert (r.n_shingles, r.component_id) == (sizes[r.doc_id], groups[r.doc_id]), r
    assert len(set(groups)) < len(groups) - 60


def test_buckets_of_several_groups_are_cut(spark, near_texts, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK_ROWS", 3)
    docs = spark.createDataFrame(list(enumerate(near_texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(docs).collect()}
    assert got == dict(enumerate(brute_groups(near_texts, 5, 85)[1]))
    assert setsketch.near_duplicates(docs.limit(0)).collect() == []


# ---- hard negatives


def test_curve_is_a_walk_through_all_cells():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.indices([1 << bits] * dims).reshape(dims, -1).T
        place = hard_negatives.hilbert(grid, bits)
        assert sorted(place) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(4)
    rows, anchors = rng.integers(-300, 300, (500, 7)), rng.integers(-300, 300, (20, 7))
    low, high = hard_negatives.bounds(anchors, rows.min(0)[None], rows.max(0)[None])
    scores = anchors @ rows.T
    assert (scores >= low).all() and (scores <= high).all()


def brute_negatives(rows, low_percent=80, positives=5, negatives=5):
    """Rows (id, label, vector, anchor); repeated rows count as rows of their own."""
    whole = []
    for number, (i, label, vector, anchor) in enumerate(rows):
        if i is None or label is None or vector is None:
            continue
        if any(x is None or not np.isfinite(x) for x in vector):
            continue
        q = [int(np.floor(256 * float(x))) for x in vector]
        if sum(x * x for x in q) >= 1 << 56:
            continue
        whole.append((i, label, q, anchor, number))
    out = Counter()
    for i, label, q, anchor, number in whole:
        if not anchor:
            continue
        scored = [
            (-sum(x * y for x, y in zip(q, w)), j, other)
            for j, other, w, _, n in whole
            if n != number
        ]
        for p, j, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fits = sorted(
                s for s in scored if s[2] != label and low_percent * -p <= 100 * -s[0] <= 100 * -p
            )
            for rank, (s, k, _) in enumerate(fits[:negatives], 1):
                out[i, j, rank, k, -p, -s] += 1
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    rows = []
    for k in range(900):
        v = rng.normal(0, 0.2, 6) + (0.9 if k % 4 == 0 else 0.0)
        rows.append((k, int(rng.integers(0, 3)) if k % 3 else 0, v.tolist(), k % 20 == 0))
    for k in range(900, 930):  # ties
        rows.append((k, k % 2, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0], k % 20 == 0))
    rows += [
        (931, None, [1.0] * 6, True), (932, 1, None, True), (933, 1, [1.0, None] * 3, True),
        (934, 1, [float("nan")] * 6, True), (935, 1, [float("inf")] * 6, False),
        (None, 1, [1.0] * 6, False), (936, 1, [], True), (937, 1, [1e30] * 6, True),
        (938, 0, [0.7, 0.1], True), (939, 99, [0.4] * 6, True), (940, 1, [-3e4, 2e4] * 3, True),
        (941, 0, [3e4, -2e4] * 3, False), (942, 0, [-3e4, 2e4] * 3, False),
    ]
    return rows + [rows[0], rows[1], rows[900]]


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, vectors, small, monkeypatch):
    if small:  # many pages, blocks and slices
        monkeypatch.setattr(hard_negatives, "PAGE_ROWS", 8)
        monkeypatch.setattr(hard_negatives, "BLOCKS", 9)
        monkeypatch.setattr(hard_negatives, "SLICE_ANCHORS", 7)
    rows = spark.createDataFrame(
        [(*r, 1, 2, 3) for r in vectors],
        "vec_id long, label int, embedding array<double>, ask boolean, anchor int, block int, page int",
    ).repartition(4)
    got = Counter(tuple(r) for r in hard_negatives.mined(rows, F.col("ask")).collect())
    assert got == brute_negatives(vectors)
    assert sum(got.values()) > 300


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mined(none, F.col("vec_id") % 100 == 0).collect() == []


def test_sets_by_marks_and_by_join(spark, near_texts, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(near_texts)) + [(None, near_texts[5])] * 2,
                                 "doc_id long, text string")
    monkeypatch.setattr(setsketch, "MARKED", 0)
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(docs).collect()}
    assert got.pop(None) == 5
    assert got == dict(enumerate(brute_groups(near_texts, 5, 85)[1]))


def test_parities_bound_the_difference():
    rng = np.random.default_rng(6)
    sets = []
    for n in (5, 40, 50, 900, 1000, 6000):
        for similarity in (0.6, 0.84, 0.87, 1.0):
            sets += random_sets(rng, n, similarity)
    held = setsketch.Parities(pa.array([setsketch.parities(s) for s in sets], pa.binary()))
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    size = np.array([len(s) for s in sets])
    gone = setsketch.too_different(held, i, held, j, size[i], size[j], 85)
    some = 0
    for a, b, ruled_out in zip(i, j, gone):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 85 * (size[a] + size[b] - both):
            assert not ruled_out
        some += ruled_out
    assert some > len(gone) // 3
