"""Exact n-gram Jaccard join by set relations, down to groups of linked documents.

A document is its set of distinct word shingles; two link when 100 * intersection is at
least 85 * union.  Equal sets are one entry from the start.

*Order.*  Shingles are put in one order for all sets: rare ones first, those found in many
documents last.  The counts come from all documents; as many of the most frequent ones as
fit a fixed table are told apart, the rest go by hash.  Any order gives the same result.

*Index lists.*  Linked sets share a shingle among the first of each, so every set enters
the lists of those shingles with its position.  Lists are sorted by what is left of a set
behind its position and skipped in blocks: once that is too little for the overlap a link
needs, no later block can hold a partner.  A list longer than ``BLOCK_ROWS`` is cut, and
each pair of its blocks is a task of its own.

*Answers from answers.*  A set carries the parities of its shingles in hashed cells, at
most ``MOST_CELLS``, so a very long text does not carry a long row into each of its lists.  The
number of cells in which two sets differ is at most the size of their difference, and it
is a distance.  For a set close to one whose distances in the list are already known, only
those partners are looked at that the triangle inequality leaves over.  And as groups are
asked for, not pairs, a long list first links each set to its nearest one; sets that are
then known to be in one group are not compared again.

*Check.*  Every remaining pair is decided on its whole sets, fetched by the ids of the
documents that occur in pairs.

Defined results: a null or wordless text has no shingles and links with nothing; a text of
fewer words than a shingle is one shingle; equal texts and equal ids are rows of one group;
an empty table gives no rows.  Columns other than id and text are ignored.  Shingles and
sets are compared as 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.common import id_and_text, stored, without_ids
from fieldsift.llm.components import roots
from fieldsift.llm.counts import bucket_bits, frequent, least_count
from fieldsift.llm.shingles import blocks, mix, shingle_sets

SHINGLE = 4
PERCENT = 85
FREQUENT = 500_000
LEAST_FREQUENT = 8
SHORT_LIST = 32
BLOCK_ROWS = 8_192
DOCS_A_BUCKET = 64
SEEN_BITS_A_BUCKET = 1 << 15
SEEN_BITS = 1 << 27
FETCH_SLOTS = 1 << 22
MOST_CELLS = 1 << 13
#: What a Python worker holds at once: shingles to count, bytes of text, bytes of index lists.
_FLUSH = 1_000_000
_TEXT_BYTES = 1 << 18
_LIST_BYTES = 1 << 23

SET_SCHEMA = (
    "doc_id long, row long, n int, sig long, tokens array<long>, places array<int>, bits binary"
)


def needed(a, b, percent: int):
    """The least intersection of linked sets of these sizes (numbers or arrays)."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def set_sig(hashes: np.ndarray) -> int:
    total = mix(hashes ^ np.uint64(0x6A09E667F3BCC909)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


def parity_bits(hashes: np.ndarray) -> bytes:
    """Parities of the shingles in hashed cells; about half as many cells as shingles."""
    cells = 64
    while 2 * cells < len(hashes) and cells < MOST_CELLS:
        cells *= 2
    counts = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


# ---- counts of shingles over all documents


def _counted(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """Stored (bucket, seen, keys, counts): which shingles occur twice, which often.

    Shingles travel as packed 32-bit numbers, a row for a bucket and task.  What a task has
    several times goes once, with its count, so a frequent shingle stays small in its bucket.
    """
    shift = np.uint64(32 - bits)
    cells = min(SEEN_BITS_A_BUCKET, SEEN_BITS >> bits)

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held)
        held.clear()
        keys >>= shift
        keys.sort()
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        times = np.diff(np.append(begins, len(keys))).astype(np.uint32)
        keys = keys[begins]
        del begins
        bucket = (keys >> np.uint64(32)).astype(np.int32)
        own = np.unique(bucket)

        def packed(which: np.ndarray, values: np.ndarray) -> pa.Array:
            cuts = np.searchsorted(bucket[which], own[1:])
            return pa.array([x.tobytes() for x in np.split(values[which], cuts)], pa.binary())

        low, again = keys.astype(np.uint32), times > 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(own, pa.int32()),
                packed(~again, low),
                packed(again, low),
                packed(again, times),
            ],
            ["bucket", "once", "again", "times"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for block in blocks((t.as_py() for t in batch.column(0)), _TEXT_BYTES):
                found = [s for s in shingle_sets(block, size) if len(s)]
                held += found
                total += sum(map(len, found))
                if total >= _FLUSH:
                    yield pack(held)
                    total = 0
        if held:
            yield pack(held)

    def count(rows):
        once, again, times = (
            np.frombuffer(b"".join(rows[c]), np.uint32) for c in ("once", "again", "times")
        )
        keys, found = np.unique(once, return_counts=True)
        if len(again):
            keys, found = np.append(keys, again), np.append(found, times)
            order = np.argsort(keys, kind="stable")
            keys, found = keys[order], found[order]
            begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, found = keys[begins], np.add.reduceat(found, begins)
        bucket = int(rows["bucket"].iloc[0])
        seen = np.zeros(cells, np.uint8)
        twice = keys[found >= 2].astype(np.uint64)
        seen[(twice * np.uint64(cells) >> np.uint64(32)).astype(np.int64)] = 1
        often = found >= LEAST_FREQUENT
        whole = keys[often].astype(np.uint64) | np.uint64(bucket << 32)
        return pd.DataFrame(
            {
                "bucket": [bucket],
                "seen": [np.packbits(seen).tobytes()],
                "keys": [whole.tobytes()],
                "counts": [found[often].astype(np.int64).tobytes()],
            }
        )

    packed = id_and_text(docs).select("text").mapInArrow(
        run, "bucket int, once binary, again binary, times binary"
    )
    return stored(
        packed.groupBy("bucket").applyInPandas(
            count, "bucket int, seen binary, keys binary, counts binary"
        ),
        "shingle_counts",
    )


class Order:
    """The order of shingles, of fixed size: frequent ones by count, and who occurs twice."""

    def __init__(self, counted: DataFrame, bits: int) -> None:
        self.shift = np.uint64(32 - bits)
        self.cells = min(SEEN_BITS_A_BUCKET, SEEN_BITS >> bits)
        self.seen = np.zeros((1 << bits, self.cells // 8), np.uint8)
        # SEEN_BITS of marks and FREQUENT keys at most.
        self.keys, self.counts = frequent(counted, least_count(counted, FREQUENT))
        marks = counted.select("bucket", "seen").toArrow()
        for bucket, seen in zip(*marks.columns, strict=True):
            self.seen[bucket.as_py()] = np.frombuffer(seen.as_py(), np.uint8)
        self.quick = np.zeros(1 << 22, bool)
        self.quick[(self.keys << self.shift >> np.uint64(42)).astype(np.int64)] = True

    def prefix(self, hashes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The first shingles of a sorted set that others have too, and their positions."""
        if not len(hashes):
            return hashes, np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.quick[(hashes >> np.uint64(42)).astype(np.int64)])
        length = prefix_length(len(hashes), percent)
        first = hashes[: length + len(maybe)]
        if len(maybe) and len(self.keys):
            keys = hashes[maybe] >> self.shift
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            if hit.any():
                counts = np.zeros(len(hashes), np.int64)
                counts[maybe[hit]] = self.counts[at[hit]]
                first = hashes[np.argsort(counts, kind="stable")]
        first = first[:length]
        keys = first >> self.shift
        cell = ((keys & np.uint64(0xFFFFFFFF)) * np.uint64(self.cells) >> np.uint64(32)).astype(np.int64)
        marks = self.seen[(keys >> np.uint64(32)).astype(np.int64), cell >> 3]
        places = np.flatnonzero(marks >> (7 - (cell & 7)).astype(np.uint8) & 1)
        return first[places], places


def _sets(docs: DataFrame, order: Order, size: int, percent: int) -> DataFrame:
    """Stored row per document: set size, signature, prefix and parity bits."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            n, sig, tokens, places, bits = [], [], [], [], []
            for block in blocks((t.as_py() for t in batch.column(1)), _TEXT_BYTES):
                for found in shingle_sets(block, size):
                    first, at = own.prefix(found, percent)
                    n.append(len(found))
                    sig.append(set_sig(found))
                    tokens.append(first.view(np.int64))
                    places.append(at.astype(np.int32))
                    bits.append(parity_bits(found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(n, pa.int32()),
                    pa.array(sig, pa.int64()),
                    pa.array(tokens, pa.list_(pa.int64())),
                    pa.array(places, pa.list_(pa.int32())),
                    pa.array(bits, pa.binary()),
                ],
                ["doc_id", "row", "n", "sig", "tokens", "places", "bits"],
            )

    rows = id_and_text(docs).withColumn("row", F.monotonically_increasing_id())
    sets = stored(rows.mapInArrow(run, SET_SCHEMA), "sets")
    shared.destroy()  # up to 28 MB that the driver and every executor would go on to hold
    return sets


# ---- pairs within index lists


class Entries:
    """Rows of index lists: set, size, position, group and parity cells."""

    def __init__(self, table: pa.Table) -> None:
        self.sig = table["sig"].to_numpy()
        self.n = table["n"].to_numpy().astype(np.int64)
        self.left = self.n - table["place"].to_numpy().astype(np.int64)
        self.group = table["group"].to_numpy()
        self.side = table["side"].to_numpy()
        # The bytes of all cells as Arrow holds them, one after the other.
        bits = pa.concat_arrays(table["bits"].chunks)
        _, ends, cells = bits.buffers()
        ends = np.frombuffer(ends, np.int32)[bits.offset : bits.offset + len(bits) + 1]
        self.start, self.width = ends[:-1].astype(np.int64) // 8, np.diff(ends).astype(np.int64) // 8
        self.words = np.frombuffer(cells, np.uint64, ends[-1] // 8)

    def cells(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Cells of entries of this width, or of twice as many folded into as many."""
        at = self.start[rows][:, None] + np.arange(width)
        found = self.words[at]
        wide = self.width[rows] == 2 * width
        if wide.any():
            found[wide] ^= self.words[at[wide] + width]
        return found

    def admitted(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs can link by size, position and group; and their allowed difference."""
        need = needed(self.n[i], self.n[j], percent)
        smaller = np.minimum(self.n[i], self.n[j])
        fits = (
            (need <= smaller)
            & (np.minimum(self.left[i], self.left[j]) >= need)
            & (self.group[i] != self.group[j])
            & ((self.side[i] != self.side[j]) | (self.side[i] == 0))
        )
        return fits, self.n[i] + self.n[j] - 2 * need

    def passing(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose parity cells do not rule out a link."""
        fits, allowed = self.admitted(i, j, percent)
        i, j, allowed = i[fits], j[fits], allowed[fits]
        width = np.minimum(self.width[i], self.width[j])
        good = np.zeros(len(i), bool)
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            for some in np.array_split(at, len(at) * w // 500_000 + 1):
                differ = self.cells(i[some], w) ^ self.cells(j[some], w)
                good[some] = np.bitwise_count(differ).sum(axis=1) <= allowed[some]
        return i[good], j[good]


def short_lists(entries: Entries, token: np.ndarray, percent: int) -> list[tuple]:
    """Passing pairs of lists of at most SHORT_LIST rows, all lists at once."""
    found = []
    for step in range(1, SHORT_LIST):
        i = np.flatnonzero(token[:-step] == token[step:])
        if not len(i):
            break
        found.append(entries.passing(i, i + step, percent))
    return found


def long_list(entries: Entries, rows: np.ndarray, percent: int, nearest: bool) -> list[tuple]:
    """Passing pairs of one long list; with ``nearest``, one partner for each set."""
    # Blocks by what is left behind the position: later blocks cannot reach the overlap
    # that even the smallest set of the list needs.
    order = rows[np.argsort(-entries.left[rows], kind="stable")]
    least = int(entries.n[order].min())
    enough = needed(least, (percent * least + 99) // 100, percent)
    heads = entries.left[order[:: SHORT_LIST]]
    order = order[: int((heads >= enough).sum()) * SHORT_LIST]
    found: list[tuple] = []
    best: dict[int, tuple[int, int]] = {}
    for width in np.unique(entries.width[order]).tolist():
        pool = order[(entries.width[order] == width) | (entries.width[order] == 2 * width)]
        if len(pool) < 2:
            continue
        cells = entries.cells(pool, width)
        narrow = entries.width[pool] == width
        leader, known, ranked = -1, None, None
        for s in range(len(pool) - 1):
            n = int(entries.n[pool[s]])
            most = 2 * n * (100 - percent) // percent + 2  # no partner differs in more
            gap = int(np.bitwise_count(cells[s] ^ cells[leader]).sum()) if leader >= 0 else most
            if leader < 0 or 2 * gap > most:
                leader, gap = s, 0
                known = np.bitwise_count(cells ^ cells[s]).sum(axis=1).astype(np.int64)
                ranked = np.argsort(known, kind="stable")
                values = known[ranked]
            # |d(leader, x) - d(leader, s)| <= d(s, x)
            near = ranked[
                np.searchsorted(values, gap - most) : np.searchsorted(values, gap + most, "right")
            ]
            near = near[(near > s) & (narrow[near] | narrow[s])]
            if not len(near):
                continue
            i = np.full(len(near), pool[s])
            fits, allowed = entries.admitted(i, pool[near], percent)
            near, allowed = near[fits], allowed[fits]
            apart = (
                known[near]
                if leader == s
                else np.bitwise_count(cells[near] ^ cells[s]).sum(axis=1).astype(np.int64)
            )
            near, apart = near[apart <= allowed], apart[apart <= allowed]
            if not len(near):
                continue
            if nearest:
                for x, d in zip(pool[near].tolist(), apart.tolist(), strict=True):
                    if d < best.get(x, (1 << 60, 0))[0]:
                        best[x] = (d, int(pool[s]))
            else:
                found.append((np.full(len(near), pool[s]), pool[near]))
    if best:
        found.append((np.array([s for _, s in best.values()]), np.array(list(best))))
    return found


_LIST_COLUMNS = ["token", "part", "sig", "n", "place", "group", "side", "bits"]


def _pairs(lists: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Distinct passing pairs (a, b) of the lists, a < b; a list is a (token, part)."""

    def evaluate(table: pa.Table) -> pa.RecordBatch:
        entries = Entries(table)
        token, part = table["token"].to_numpy(), table["part"].to_numpy()
        begins = np.flatnonzero(
            np.append(True, (token[1:] != token[:-1]) | (part[1:] != part[:-1]))
        )
        sizes = np.diff(np.append(begins, len(token)))
        number = np.repeat(np.arange(len(begins)), sizes)
        # Rows of long lists get numbers of their own, so they pair with nothing here.
        long = sizes > SHORT_LIST
        single = np.where(long[number], -1 - np.arange(len(number)), number)
        found = short_lists(entries, single, percent)
        for begin, size in zip(begins[long].tolist(), sizes[long].tolist(), strict=True):
            found += long_list(entries, np.arange(begin, begin + size), percent, nearest)
        i = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        j = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
        a, b = entries.sig[i], entries.sig[j]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], ["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 100_000 and sum(b.nbytes for b in held) < _LIST_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            token, part = table["token"].to_numpy(), table["part"].to_numpy()
            changes = np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1]))
            if len(changes):
                end = int(changes[-1]) + 1
                yield evaluate(table.slice(0, end).combine_chunks())
                held = table.slice(end).combine_chunks().to_batches()
        if held:
            yield evaluate(pa.Table.from_batches(held).combine_chunks())

    return (
        lists.select(_LIST_COLUMNS)
        .repartition("token", "part")
        .sortWithinPartitions("token", "part")
        .mapInArrow(run, "a long, b long")
        .distinct()
    )


def _lists(sets: DataFrame, firsts: DataFrame) -> DataFrame:
    """Stored index lists of at least two different sets, with parity cells."""
    own = sets.join(firsts.select(F.col("rep").alias("row")), "row", "left_semi").where("n > 0")
    entries = own.select(
        "sig", "n", F.explode(F.arrays_zip("tokens", "places")).alias("e")
    ).select(F.col("e.tokens").alias("token"), "sig", "n", F.col("e.places").alias("place"))
    counts = entries.groupBy("token").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    kept = entries.join(counts, "token").join(own.select("sig", "bits"), "sig")
    return stored(kept.select("token", "many", "sig", "n", "place", "bits"), "lists")


def _cut(lists: DataFrame) -> DataFrame:
    """Long lists in blocks of BLOCK_ROWS; a part is a pair of blocks, or one with itself."""
    blocks_ = F.ceil(F.col("many") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    return (
        lists.withColumn("blocks", blocks_)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn(
            "part",
            F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other"),
        )
        # Entries of one block face those of the other; in a block with itself, all.
        .withColumn(
            "side",
            F.when(F.col("own") == F.col("other"), 0)
            .when(F.col("own") < F.col("other"), 1)
            .otherwise(2),
        )
        .drop("blocks", "own", "other")
    )


# ---- exact check of pairs


def _fetched(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(sig, hashes) of the sets in ``nodes`` (sig, doc_id), made anew from their texts.

    Marks of the wanted ids, of fixed size, keep other texts from being worked on.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FETCH_SLOTS)).cast("int")
    wanted = np.zeros(FETCH_SLOTS, bool)
    found = nodes.select(slot.alias("slot")).distinct().toArrow()
    wanted[found.column(0).to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            at = batch.column(1).to_numpy()
            hit = marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            texts = batch.column(0).filter(pa.array(hit.astype(bool)))
            for block in blocks((t.as_py() for t in texts), _TEXT_BYTES):
                sets = shingle_sets(block, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([set_sig(s) for s in sets], pa.int64()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["sig", "hashes"],
                )

    made = id_and_text(docs).select("text", slot.alias("slot")).mapInArrow(
        run, "sig long, hashes array<long>"
    )
    return made.join(nodes.select("sig"), "sig", "left_semi").dropDuplicates(["sig"])


def _links(docs: DataFrame, pairs: DataFrame, firsts: DataFrame, size: int, percent: int) -> DataFrame:
    """Stored pairs whose whole sets are similar enough."""
    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    nodes = stored(firsts.join(ends, "sig").select("sig", "doc_id"), "nodes")
    sets = stored(_fetched(docs, nodes, size), "fetched")

    # Row by row: batches of thousands of rows with two whole sets would not fit a worker.
    shared = F.size(F.array_intersect("set_a", "set_b"))
    both = F.size("set_a") + F.size("set_b")
    compared = (
        pairs.join(sets.toDF("a", "set_a"), "a")
        .join(sets.toDF("b", "set_b"), "b")
        .select("a", "b", shared.cast("long").alias("shared"), both.cast("long").alias("both"))
    )
    good = 100 * F.col("shared") >= percent * (F.col("both") - F.col("shared"))
    return stored(compared.where(good).select("a", "b"), "links")


def components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: row, set size and the least doc_id of its group of linked documents."""
    bits = bucket_bits(docs.count(), DOCS_A_BUCKET)
    # The driver holds the order no longer than it takes to make the sets.
    sets = _sets(docs, Order(_counted(docs, size, bits), bits), size, percent)
    firsts = stored(
        sets.where("n > 0")
        .groupBy("sig")
        .agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("rep")),
        "firsts",
    )
    lists = _lists(sets, firsts)
    short = lists.where(F.col("many") <= SHORT_LIST).select(
        "*", F.lit(0).cast("long").alias("part"), F.lit(0).alias("side")
    )
    long = _cut(lists.where(F.col("many") > SHORT_LIST))
    everything = short.unionByName(long).withColumn("group", F.col("sig"))
    links = _links(docs, _pairs(everything, percent, True), firsts, size, percent)
    found = roots(links)
    if lists.where(F.col("many") > SHORT_LIST).limit(1).count():
        found = stored(found, "roots")
        grouped = long.join(
            found.select(F.col("node").alias("sig"), F.col("root").alias("group")), "sig", "left"
        ).withColumn("group", F.coalesce("group", "sig"))
        more = _links(docs, _pairs(grouped, percent, False), firsts, size, percent)
        if more.limit(1).count():
            found = roots(links.unionByName(more))
    rooted = firsts.join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
        "root", F.coalesce("root", "sig")
    )
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = rooted.join(least, "root").select("sig", "component_id")
    linked = sets.where("n > 0").join(ids, "sig").select("doc_id", "row", "n", "component_id")
    alone = sets.where("n = 0").select("doc_id", "row", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "doc_id", "row", F.col("n").cast("long").alias("n_shingles"), "component_id"
    )


def representatives(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does.

    That is the document with the least id.  Rows with one id are one document and stay or go
    together; rows with a null id stay.
    """
    groups = components(docs, size, percent).where("doc_id <> component_id")
    name = f"gone_{uuid.uuid4().hex}"  # no column of the table has such a name
    gone = stored(groups.select(F.col("doc_id").alias(name)).distinct(), "gone")
    return without_ids(docs, gone)
