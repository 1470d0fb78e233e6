"""MinHash near-duplicates by SetSketch registers, down to groups of linked documents.

A document is its set of distinct word shingles; two link when 100 * intersection is at
least ``percent`` * union.  Equal sets are one entry from the start.

*Sketch.*  Every shingle sends a Poisson process of points to ``REGISTERS`` registers; a
register keeps the least point it receives, as the truncated logarithm
``floor(1 - log(least) / log(BASE))`` in one byte.  Registers of a union are the larger of
the registers, so sketches merge, and two sets agree in a register about as often as their
Jaccard similarity.  A shingle stops as soon as its next point lies above the largest kept
one, so it costs a few points, not one for each register.

*Bands.*  Sets that agree in all registers of one of the bands are candidates.  A band has
as many registers as let a pair at the bound miss all bands with a chance of 10^-8 at most:
at similarity 0.85 there are 42 bands of six, and the chance is 2 in 10^9.

*Joint estimate.*  With the known set sizes, the numbers of larger, smaller and equal
registers of a pair have a likelihood for each similarity.  A pair goes on unless some
similarity below the bound is e^20 times likelier than all from the bound upwards, a chance
of about one in 10^9 for a pair that links.

*Verification.*  What goes on is decided on the whole sets.  Before these are fetched, the
parities of both sets in hashed cells, two to four times as many as shingles, are compared:
the number of cells that differ is at most the size of the difference, so too many of them
rule a link out for certain.

*Large buckets.*  As groups are asked for, not pairs, first each set of a bucket is verified
against the bucket's least one: in a few bands, then in all where the two are not in one group
yet.  Only buckets that then still hold several groups are looked at again, block against
block, with registers at hand: first each set against the likeliest one of another group,
then every pair of different groups whose estimate passes.  No link between groups is left
out, and copies are never expanded into all their pairs.

Defined results: a null or wordless text has no shingles and links with nothing; a text of
fewer words than a shingle is one shingle; equal texts and equal ids are rows of one group
each; rows with a null id are grouped like others, a group of them alone has a null class;
an empty table gives no rows.  Columns other than id and text are ignored.  Shingles are
compared as 64-bit hashes, whole sets as 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.common import id_and_text, stored
from fieldsift.llm.components import roots
from fieldsift.llm.shingles import blocks, mix, shingle_sets

SHINGLE = 5
PERCENT = 85
REGISTERS = 256
MISSED = 1e-8
BASE = 1.1
RATE = 20.0
LOG_BASE = float(np.log(BASE))
CERTAIN = 20.0
BLOCK_ROWS = 2_048
ROUND_POINTS = 1 << 20
MARKED = 1 << 21
FIRST_BANDS = 3
MOST_CELLS = 1 << 13

_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRID = np.linspace(0.0, 1.0, 201)


# ---- sketches


def _points(seeds: np.ndarray, done: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The next ``many`` gaps of each shingle's process and the registers they go to."""
    which = (np.arange(1, many + 1, dtype=np.uint64)[None, :] + done[:, None].astype(np.uint64)) * _STEP
    bits = mix(seeds[:, None] + which)
    unit = ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53
    return -np.log(unit) / (RATE * REGISTERS), (bits & np.uint64(REGISTERS - 1)).astype(np.int64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``REGISTERS`` bytes per set; an empty set has zeros."""
    least = np.full((len(sets), REGISTERS), np.inf)
    flat = least.reshape(-1)
    sizes = np.array([len(s) for s in sets], np.int64)
    # Sets of like size take as many points a shingle at once as mostly fill all registers.
    needed = np.maximum(1, np.ceil(9.0 * REGISTERS / np.maximum(sizes, 1))).astype(np.int64)
    step = 1 << np.ceil(np.log2(needed)).astype(np.int64)
    for many in np.unique(step[sizes > 0]).tolist():
        own = np.flatnonzero((step == many) & (sizes > 0))
        seeds = np.concatenate([sets[k] for k in own])
        owner = np.repeat(own, sizes[own])
        done = np.zeros(len(seeds), np.int64)
        reached = np.zeros(len(seeds))
        while len(seeds):
            alive = np.ones(len(seeds), bool)
            rows = max(1, ROUND_POINTS // many)
            for begin in range(0, len(seeds), rows):
                some = slice(begin, begin + rows)
                gaps, register = _points(seeds[some], done[some], many)
                at = np.cumsum(gaps, axis=1) + reached[some][:, None]
                np.minimum.at(flat, (owner[some][:, None] * REGISTERS + register).ravel(), at.ravel())
                reached[some] = at[:, -1]
            done += many
            limit = np.full(len(sets), np.inf)
            limit[own] = least[own].max(axis=1)
            alive = reached < limit[owner]
            seeds, owner, done, reached = seeds[alive], owner[alive], done[alive], reached[alive]
    with np.errstate(divide="ignore"):
        values = np.floor(1.0 - np.log(least) / LOG_BASE)
    return np.clip(np.where(np.isfinite(values), values, 0), 0, 255).astype(np.uint8)


def merged(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(one, two)


# ---- joint estimate


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / LOG_BASE


def log_likelihoods(
    larger: np.ndarray, smaller: np.ndarray, n: np.ndarray, m: np.ndarray
) -> np.ndarray:
    """For pairs of sets of sizes n and m, a row of log likelihoods over the grid.

    ``larger`` and ``smaller`` count the registers of the first set above and below those
    of the second.  Similarities that the sizes rule out have minus infinity.
    """
    u = (n / (n + m))[:, None]
    v = 1.0 - u
    most = np.minimum(u / v, v / u)
    j = np.minimum(_GRID[None, :], most)
    above, below = _share(u - v * j), _share(v - u * j)
    equal = np.maximum(1.0 - above - below, 1e-12)
    counts = (larger[:, None], smaller[:, None], (REGISTERS - larger - smaller)[:, None])
    total = sum(
        c * np.log(np.maximum(p, 1e-12)) for c, p in zip(counts, (above, below, equal), strict=True)
    )
    return np.where(_GRID[None, :] <= most + 0.005, total, -np.inf)


def estimated(larger: np.ndarray, smaller: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of each pair."""
    return _GRID[np.argmax(log_likelihoods(larger, smaller, n, m), axis=1)]


def possible(
    larger: np.ndarray, smaller: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int
) -> np.ndarray:
    """Which pairs may reach the similarity: sizes allow it and the likelihood does."""
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    found = np.zeros(len(n), bool)
    at = np.flatnonzero(fits)
    for some in np.array_split(at, len(at) // 20_000 + 1):
        if len(some):
            logs = log_likelihoods(larger[some], smaller[some], n[some], m[some])
            high = logs[:, _GRID >= percent / 100 - 0.005].max(axis=1)
            found[some] = high + CERTAIN >= logs.max(axis=1)
    return found


def most_apart(percent: int) -> int:
    """The largest number of differing registers of a pair that may reach the similarity."""
    sizes = np.arange(percent, 101, dtype=np.float64)

    def any_possible(apart: int) -> bool:
        larger = np.tile(np.arange(apart + 1, dtype=np.float64), len(sizes))
        n = np.repeat(sizes, apart + 1)
        return bool(possible(larger, apart - larger, n, np.full(len(n), 100.0), percent).any())

    low, high = 0, REGISTERS
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if any_possible(middle) else (low, middle - 1)
    return low


# ---- parities, a certain bound


def parities(hashes: np.ndarray) -> bytes:
    """Parities of a set in ``MOST_CELLS`` hashed cells at most."""
    cells = 64
    while cells < 2 * len(hashes) and cells < MOST_CELLS:
        cells *= 2
    counts = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """The parities of many sets; wider ones are folded to the other side's width."""

    def __init__(self, column) -> None:
        held = column.to_pylist()
        self.width = np.array([len(b) for b in held], np.int64) // 8
        self.start = np.cumsum(self.width) - self.width
        self.words = np.frombuffer(b"".join(held), np.uint64)

    def folded(self, rows: np.ndarray, width: int) -> np.ndarray:
        found = np.zeros((len(rows), width), np.uint64)
        for own in np.unique(self.width[rows]).tolist():
            at = np.flatnonzero(self.width[rows] == own)
            words = self.words[self.start[rows[at]][:, None] + np.arange(own)]
            found[at] = np.bitwise_xor.reduce(words.reshape(len(at), own // width, width), axis=1)
        return found


def too_different(
    one: Parities, i: np.ndarray, two: Parities, j: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int
) -> np.ndarray:
    """Which pairs of rows ``i`` and ``j``, sets of sizes n and m, cannot link."""
    shared = -(-percent * (n + m) // (100 + percent))  # the least intersection of a link
    width = np.minimum(one.width[i], two.width[j])
    found = np.zeros(len(i), bool)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        for some in np.array_split(at, len(at) * w // 500_000 + 1):
            differ = np.bitwise_count(one.folded(i[some], w) ^ two.folded(j[some], w)).sum(axis=1)
            found[some] = differ > (n + m - 2 * shared)[some]
    return found


# ---- stored sets and candidates

_SKETCH = "row long, doc_id long, n long, high long, low long, regs binary, cells binary"
_KEYS = ["high", "low", "n"]


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    both = [
        [mix(s ^ np.uint64(k)).sum(dtype=np.uint64) for k in (0x6A09E667, 0xBB67AE85)] for s in sets
    ]
    return np.array(both, np.uint64).reshape(-1, 2).view(np.int64)


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """Stored row per document: set size, 128-bit signature, registers and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for block in blocks(t.as_py() for t in batch.column(1)):
                sets = shingle_sets(block, size)
                both = _signatures(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2).slice(done, len(block)),
                        batch.column(0).slice(done, len(block)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(both[:, 0], pa.int64()),
                        pa.array(both[:, 1], pa.int64()),
                        pa.array([r.tobytes() for r in sketches(sets)], pa.binary()),
                        pa.array([parities(s) for s in sets], pa.binary()),
                    ],
                    ["row", "doc_id", "n", "high", "low", "regs", "cells"],
                )
                done += len(block)

    rows = id_and_text(docs).withColumn("row", F.monotonically_increasing_id())
    return stored(rows.mapInArrow(run, _SKETCH), "sketches")


def band_rows(percent: int) -> int:
    """How many registers make a band; seven of them and the band's number fill a key."""
    share = percent / 100
    fits = [r for r in range(1, 8) if (1 - share**r) ** (REGISTERS // r) <= MISSED]
    return max(fits, default=1)


def _buckets(nodes: DataFrame, rows: int) -> DataFrame:
    """Stored (key, node) of the bands that at least two different sets agree in."""
    bands = REGISTERS // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.num_rows
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8)
            parts = regs.reshape(many, REGISTERS)[:, : bands * rows].reshape(many, bands, rows)
            packed = np.zeros((many, bands), np.uint64)
            for k in range(rows):
                packed = packed << np.uint64(8) | parts[:, :, k]
            # The registers' bytes and the number of the band.
            keys = packed << np.uint64(8) | np.arange(bands, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.ravel().view(np.int64), pa.int64()),
                    pa.array(np.repeat(batch.column(0).to_numpy(), bands), pa.int64()),
                ],
                ["key", "node"],
            )

    keys = nodes.select("node", "regs").mapInArrow(run, "key long, node long")
    shared = (
        keys.groupBy("key")
        .agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("head"))
        .where("many > 1")
    )
    return stored(keys.join(shared, "key").select("key", "node", "many", "head"), "buckets")


def _compared(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    larger = (one > two).sum(axis=1).astype(np.float64)
    return larger, (one < two).sum(axis=1).astype(np.float64)


def _whole(docs: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """Stored (node, hashes): the whole sets of ``ends`` (node, doc_id, high, low, n).

    The sets are made anew from the texts of these documents, as storing them all would take
    twice the space of the texts.  Marks of their ids, a broadcast of 16 MB at most, keep
    other texts out but for a sixty-fourth part; beyond ``MARKED`` ids a semi join does.
    """
    many = ends.count()
    texts = id_and_text(docs)
    wanted = np.zeros(0, np.uint8)
    if many <= MARKED:
        slots = 1 << max(10, (32 * many).bit_length())
        texts = texts.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int"))
        own = ends.select(F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("slot"))
        marks = np.zeros(slots, bool)
        marks[own.distinct().toArrow().column(0).to_numpy()] = True
        wanted = np.packbits(marks)
    else:
        ids = ends.select(F.col("doc_id").alias("id")).distinct()
        texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").withColumn(
            "slot", F.lit(-1)
        )
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            column, at = batch.column(0), batch.column(1).to_numpy()
            if len(marks):
                hit = marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
                column = column.filter(pa.array(hit.astype(bool)))
            for block in blocks(t.as_py() for t in column):
                sets = shingle_sets(block, size)
                both = _signatures(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(both[:, 0], pa.int64()),
                        pa.array(both[:, 1], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    [*_KEYS, "hashes"],
                )

    made = texts.select("text", "slot").mapInArrow(run, "high long, low long, n long, hashes binary")
    # Repeated rows give one set once.
    sets = made.join(ends.select("node", *_KEYS), _KEYS).select("node", "hashes")
    return stored(sets.dropDuplicates(["node"]), "whole")


def _verified(
    pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int, percent: int
) -> DataFrame:
    """Stored pairs (a, b) that are similar enough by their whole sets.

    First sizes, registers and parities of both ends decide which pairs are read at all.
    """

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, REGISTERS)
                for k in (4, 5)
            )
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            good = possible(*_compared(one, two), n.astype(np.float64), m.astype(np.float64), percent)
            rows = np.flatnonzero(good)
            cells = Parities(batch.column(6)), Parities(batch.column(7))
            good[rows] = ~too_different(cells[0], rows, cells[1], rows, n[rows], m[rows], percent)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both = np.concatenate(
                    [np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)]
                )
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    short = sets.select("node", "n", "regs", "cells")
    sized = pairs.join(short.toDF("b", "m", "regs_b", "cells_b"), "b").join(
        short.toDF("a", "n", "regs_a", "cells_a"), "a"
    )
    likely = stored(
        sized.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
        .select("a", "b", "n", "m", "regs_a", "regs_b", "cells_a", "cells_b")
        .mapInArrow(estimate, "a long, b long"),
        "likely",
    )
    ends = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    named = sets.select("node", "doc_id", *_KEYS).join(ends, "node", "left_semi")
    whole = _whole(docs, stored(named, "ends"), size)
    # The member's set travels to the other end's; one set a pair crosses the network.
    return stored(
        likely.join(whole.toDF("b", "set_b"), "b")
        .join(whole.toDF("a", "set_a"), "a")
        .select("a", "b", "set_a", "set_b")
        .mapInArrow(check, "a long, b long"),
        "links",
    )


# ---- buckets that hold several groups


def _between(lists: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Distinct possible pairs (a, b) of different groups within a (key, part)."""
    apart = most_apart(percent)

    def evaluate(table: pa.Table) -> pa.RecordBatch:
        node, group, side = (table[c].to_numpy() for c in ("node", "group", "side"))
        whole = table["n"].to_numpy()
        n = whole.astype(np.float64)
        cells = Parities(table["cells"])
        regs = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint8).reshape(-1, REGISTERS)
        key, part = table["key"].to_numpy(), table["part"].to_numpy()
        begins = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        ends = np.append(begins[1:], len(key))
        found: list[np.ndarray] = []
        for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
            own = group[begin:end]
            if (own == own[0]).all():
                continue
            for i in range(begin, end - 1):
                rest = np.arange(i + 1, end)
                rest = rest[
                    (group[rest] != group[i])
                    & ((side[rest] != side[i]) | (side[rest] == 0))
                    & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))
                ]
                if not len(rest):
                    continue
                differ = (regs[rest] != regs[i]).sum(axis=1)
                rest, differ = rest[differ <= apart], differ[differ <= apart]
                own = np.full(len(rest), i)
                near = ~too_different(cells, own, cells, rest, whole[own], whole[rest], percent)
                rest, differ = rest[near], differ[near]
                if not len(rest):
                    continue
                if nearest:
                    rest = rest[[int(np.argmin(differ))]]
                one = np.broadcast_to(regs[i], (len(rest), REGISTERS))
                sizes = np.full(len(rest), n[i])
                rest = rest[possible(*_compared(one, regs[rest]), sizes, n[rest], percent)]
                if len(rest):
                    found.append(np.stack([np.full(len(rest), node[i]), node[rest]], axis=1))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 20_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key, part = table["key"].to_numpy(), table["part"].to_numpy()
            changes = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]))
            if len(changes):
                end = int(changes[-1]) + 1
                yield evaluate(table.slice(0, end).combine_chunks())
                held = table.slice(end).combine_chunks().to_batches()
        if held:
            yield evaluate(pa.Table.from_batches(held).combine_chunks())

    return (
        lists.select("key", "part", "side", "node", "group", "n", "regs", "cells")
        .repartition("key", "part")
        .sortWithinPartitions("key", "part")
        .mapInArrow(run, "a long, b long")
        .distinct()
    )


def _heads(buckets: DataFrame, found: DataFrame | None) -> DataFrame:
    """Distinct pairs (a, b) of a bucket's least set and another one of its sets.

    Without groups ``found`` only of the first bands, with them of different groups only.
    """
    pairs = buckets.where("head <> node").select("key", F.col("head").alias("a"), F.col("node").alias("b"))
    if found is None:
        return pairs.where(F.col("key").bitwiseAND(F.lit(255)) < FIRST_BANDS).select("a", "b").distinct()
    of = {e: found.select(F.col("node").alias(e), F.col("root").alias(f"root_{e}")) for e in "ab"}
    named = pairs.select("a", "b").distinct().join(of["b"], "b", "left").join(of["a"], "a", "left")
    return named.where(
        F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    ).select("a", "b")


def _lists(buckets: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """Buckets that hold several groups, with registers, cut into pairs of blocks.

    A part is a pair of blocks of ``BLOCK_ROWS`` sets, or one block with itself.
    """
    named = buckets.join(
        found.select("node", F.col("root").alias("group")), "node", "left"
    ).withColumn("group", F.coalesce("group", "node"))
    several = (
        named.groupBy("key")
        .agg(F.min("group").alias("least"), F.max("group").alias("most"))
        .where("least <> most")
        .select("key")
    )
    blocks_ = F.ceil(F.col("many") / BLOCK_ROWS).cast("int")
    cut = (
        named.join(several, "key")
        .withColumn("cuts", blocks_)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select(
            "key",
            "node",
            "group",
            (F.least("own", "other") * F.col("cuts") + F.greatest("own", "other"))
            .cast("long")
            .alias("part"),
            F.when(F.col("own") == F.col("other"), 0)
            .when(F.col("own") < F.col("other"), 1)
            .otherwise(2)
            .alias("side"),
        )
    )
    return cut.join(sets.select("node", "n", "regs", "cells"), "node")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles`` and ``component_id``, the least id of its group."""
    rows = _sketched(docs, size)
    # One entry for equal sets, with the registers of any of them: they are the same.
    sets = stored(
        rows.where("n > 0")
        .groupBy(*_KEYS)
        .agg(
            F.min("row").alias("node"), F.min("doc_id").alias("doc_id"),
            F.first("regs").alias("regs"), F.first("cells").alias("cells"),
        ),
        "sets",
    )
    buckets = _buckets(sets, band_rows(percent))
    links, found = None, None
    for step in ("first heads", "all heads", "nearest", "every pair"):
        if step in ("first heads", "all heads"):
            pairs = _heads(buckets, found)
        else:
            pairs = _between(_lists(buckets, sets, found), percent, step == "nearest")
        more = _verified(pairs, docs, sets, size, percent)
        if links is None or more.limit(1).count():
            links = more if links is None else links.unionByName(more)
            found = stored(roots(links), "roots")
    rooted = sets.select("node", "doc_id", *_KEYS).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = rooted.join(least, "root").select(*_KEYS, "component_id")
    linked = rows.where("n > 0").join(ids, _KEYS).select("doc_id", "n", "component_id")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("n", "n_shingles")
