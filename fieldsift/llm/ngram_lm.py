"""Language-model scores from a hashed maximum-entropy model.

The next word is drawn by steps down a tree of classes, ``WAYS`` ways at each node.  The root
holds ``WAYS - 1`` classes of the most frequent words, and one way to the next tier, which
holds ``WAYS`` times as many words, one level deeper; and so on.  So frequent words are two
steps away, and the tree grows with the words that occur ``NAMED`` times and are in the word
table.  The last way of the last tier stands for all other words, which share its probability
by their counts plus one, one more part being left for words never seen.  The scores of all
possible next words sum to one.

Every step is a softmax over the ways of its node: the logarithm of their counts, plus weights
of hashed features of what came before: the last word, the last two words together, and the
word before last with the last one skipped, each together with the node.  The number of weights
grows with the training tokens, a row of them for every ``TOKENS_A_ROW``, up to
``MOST_ROW_BITS`` (32 MB), as each task holds them; the word table takes a ``TYPES_A_WORD``-th
part of the vocabulary, up to what three tiers hold.

Counts are exact and cover all training tokens: tasks count, packed counts meet by hash
bucket.  Words frequent enough for the word table get their count from it while a
text is scored; the others are looked up by bucket and summed per document.

Training covers all training documents once.  They are dealt to ``ROUNDS`` rounds; in each,
every task starts from the same weights and makes gradient steps over its documents of the
round; the steps of all tasks are averaged, weighted by tokens, block by block of the weights,
and summed over ``_TASKS_A_SUM`` tasks first, so no task gets the steps of all others.

Defined results: a null or empty text is its end token alone; without training rows every
score is 0; a null id is a training row; equal ids are scored one by one; an empty table
gives no rows.  Columns other than id and text are ignored.  Words are compared as 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.common import id_and_text, stored
from fieldsift.llm.counts import bucket_bits, by_bucket, frequent, least_count
from fieldsift.llm.shingles import blocks, mix, words

WAYS = 32
NAMED = 16
TOKENS_A_ROW = 2048
LEAST_ROW_BITS, MOST_ROW_BITS = 16, 18
TYPES_A_WORD = 16
#: Words of the tiers below each other; the table never holds more than all of them.
TIERS = tuple((WAYS - 1) * WAYS**t for t in (1, 2, 3))
LEAST_TABLE, MOST_TABLE = 1 << 17, sum(TIERS)
ROUNDS = 2
STEP = 4096
RATE, DAMPING = 4.0, 32.0
DOCS_A_BUCKET = 256
_END = np.uint64(0xE4D0E4D0E4D0E4D1)
_START = np.uint64(0x57A8757A8757A871)
_SALTS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
_FLUSH = 2_000_000
_WEIGHT_BLOCKS = 64
_TASKS_A_SUM = 256
#: Logits stay within these bounds, so no softmax overflows; the least stands for no words.
_BOUND = 60.0
_SHORT = 8
_LN10 = np.log(10)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts with an end token after each, and where each text begins."""
    hashes, first = words(texts)
    return np.insert(hashes, first[1:], _END), first + np.arange(len(first))


def contexts(sequence: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Hashed features of what stands before each token, an array for each kind."""
    last = np.concatenate([[_START], sequence[:-1]])
    last[first[:-1]] = _START
    before = np.concatenate([[_START], last[:-1]])
    before[first[:-1]] = _START
    salts = [np.uint64(s) for s in _SALTS]
    kinds = (
        last * salts[0],
        last * salts[1] + mix(before * salts[2]),
        before * salts[3],
    )
    return [mix(k) for k in kinds]


@cache
def _scratch() -> list[np.ndarray]:
    """Memory that the steps of a process use again and again."""
    return [np.empty((STEP, WAYS), np.float32) for _ in range(3)]


def segment_sums(
    rows: np.ndarray, order: np.ndarray, begins: np.ndarray, many: np.ndarray, held: np.ndarray,
    out: np.ndarray,
) -> np.ndarray:
    """Sums of runs of ``rows[order]``; the runs come long ones first, then by falling length.

    Short runs are summed position by position, those that go on being the first so many;
    long ones by a reduction.  ``held`` is scratch memory of as many rows.
    """
    np.take(rows, order[begins], axis=0, out=out, mode="clip")
    longer = np.cumsum(np.bincount(np.minimum(many, _SHORT + 1), minlength=_SHORT + 2)[:1:-1])[::-1]
    long = int(longer[-1])
    for k, end in enumerate(longer[:-1].tolist(), 1):
        if end == long:
            break
        more = np.take(rows, order[begins[long:end] + k], axis=0, out=held[long:end], mode="clip")
        out[long:end] += more
    if long:
        starts = np.cumsum(many[:long]) - many[:long]
        at = np.repeat(begins[:long] - starts, many[:long]) + np.arange(starts[-1] + many[long - 1])
        more = np.take(rows, order[at], axis=0, out=held[: len(at)], mode="clip")
        np.add.reduceat(more, starts, axis=0, out=out[:long])
    return out


def row_bits(tokens_: int) -> int:
    """The number of weight rows, as a power of two, for so many training tokens."""
    wanted = int(np.ceil(np.log2(tokens_ / TOKENS_A_ROW + 1)))
    return min(MOST_ROW_BITS, max(LEAST_ROW_BITS, wanted))


def table_words(types: int) -> int:
    """How many words the word table may hold for such a vocabulary."""
    return min(MOST_TABLE, max(LEAST_TABLE, types // TYPES_A_WORD))


class Model:
    """Word table, tree and weights.

    ``keys`` are sorted; ``tokens_`` and ``types`` count the whole training text.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tokens_: int, types: int) -> None:
        self.keys, self.tokens, self.types = keys, tokens_, types
        self.log_counts = np.log10(counts + 1.0)
        self._prefix = np.uint64(64 - max(1, int(len(keys)).bit_length() + 1))
        prefixes = np.arange((1 << (64 - int(self._prefix))) + 1, dtype=np.uint64)
        self._starts = np.searchsorted(keys >> self._prefix, prefixes).astype(np.int32)
        top = np.lexsort((keys, -counts))[:MOST_TABLE]
        top = top[counts[top] >= NAMED]
        self.named = len(top)
        self.rank = np.full(len(keys) + 1, self.named, np.int64)
        self.rank[top] = np.arange(self.named)
        self.rest = (tokens_ - int(counts[top].sum())) + (types - self.named) + 1
        self.firsts, self.bias = self._tree(counts[top].astype(np.float64))
        self.bits = row_bits(tokens_)
        self.weights = np.zeros((1 << self.bits, WAYS), np.float32)

    def _tree(self, counts: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The number of each tier's root, and the log shares of the ways of all nodes."""
        left = float(self.tokens)
        firsts, nodes, at = [], [], 0
        for t, size in enumerate(TIERS, 1):
            own = counts[:size]
            if t > 1 and not len(own):
                break
            counts, left = counts[size:], left - own.sum()
            firsts.append(at)
            sums = np.zeros(size)
            sums[: len(own)] = own
            levels = []
            for _ in range(t):
                levels.append(sums.reshape(-1, WAYS))
                sums = levels[-1].sum(axis=1)
            levels.append(np.append(max(left, 1.0), sums)[None])
            nodes.extend(levels[::-1])
            at += sum(len(x) for x in levels)
        shares = np.concatenate(nodes)
        with np.errstate(divide="ignore"):
            logs = np.log(shares) - np.log(np.maximum(shares.sum(axis=1, keepdims=True), 1e-9))
        return firsts, np.maximum(logs, -_BOUND).astype(np.float32)

    def found(self, sequence: np.ndarray) -> np.ndarray:
        """Places in the word table; -1 for words that are not there."""
        if not len(self.keys):
            return np.full(len(sequence), -1)
        prefix = sequence >> self._prefix
        at = self._starts[prefix]
        end = self._starts[prefix + np.uint64(1)]
        look = np.flatnonzero(at < end)
        place = np.full(len(sequence), -1, np.int32)
        while len(look):
            here = self.keys[at[look]] == sequence[look]
            place[look[here]] = at[look[here]]
            look = look[~here]
            at[look] += 1
            look = look[at[look] < end[look]]
        return place

    def paths(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Steps of the tokens, level by level: token numbers, nodes and ways."""
        token = np.arange(len(at))
        rank = self.rank[at]  # place -1 is the last entry: no word of the tree
        for t, (root, size) in enumerate(zip(self.firsts, TIERS, strict=False), 1):
            inside = rank < min(size, self.named - sum(TIERS[: t - 1]))
            yield (
                token,
                np.full(len(token), root),
                np.where(inside, 1 + rank // WAYS**t, 0),
            )
            mine, held = token[inside], rank[inside]
            node = root + 1
            for depth in range(t - 1, -1, -1):
                yield mine, node + held // WAYS ** (depth + 1), held // WAYS**depth % WAYS
                node += (WAYS - 1) * WAYS ** (t - 1 - depth)
            token, rank = token[~inside], rank[~inside] - size

    def unnamed(self, at: np.ndarray) -> np.ndarray:
        """Whether a token is shared out by counts, at the end of all tiers."""
        return self.rank[at] >= self.named

    def _parts(self, features: list[np.ndarray], at: np.ndarray):
        """The steps of all tokens, ``STEP`` at a time, with their weight rows."""
        shift, spread = np.uint64(64 - self.bits), np.uint64(_SALTS[2])
        for token, node, way in self.paths(at):
            for begin in range(0, len(token), STEP):
                part = slice(begin, begin + STEP)
                own, of = token[part], node[part].astype(np.uint64) * np.uint64(_SALTS[1])
                rows = [(((f[own] ^ of) * spread) >> shift).astype(np.int64) for f in features]
                yield own, node[part], way[part], rows

    def _softmax(self, node: np.ndarray, way: np.ndarray, rows: list[np.ndarray]):
        """Log probability of the ways taken; all parts and their totals, in scratch memory."""
        logits, more = (x[: len(node)] for x in _scratch()[:2])
        np.take(self.bias, node, axis=0, out=logits, mode="clip")
        for r in rows:
            np.take(self.weights, r, axis=0, out=more, mode="clip")
            logits += more
        np.clip(logits, -_BOUND, _BOUND, out=logits)
        taken = logits[np.arange(len(way)), way]
        np.exp(logits, out=logits)
        totals = logits @ np.ones(WAYS, np.float32)
        return taken - np.log(totals), logits, totals

    def log10(self, features: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Log probability of each token; of unnamed ones that of the way to all of them."""
        out = np.zeros(len(at))
        for token, node, way, rows in self._parts(features, at):
            out[token] += self._softmax(node, way, rows)[0]
        return out / _LN10

    def learn(self, features: list[np.ndarray], at: np.ndarray) -> None:
        """Gradient steps over the tokens, ``STEP`` softmaxes at a time."""
        for _, node, way, rows in self._parts(features, at):
            _, chance, totals = self._softmax(node, way, rows)
            chance *= (1 / totals)[:, None]
            chance[np.arange(len(way)), way] -= 1
            for r in rows:
                self._move(r, chance)

    def _move(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        """Move the weights of every row by its mean gradient, rare ones less."""
        # Sorting 16-bit numbers is a count, not a comparison.
        order = np.argsort(rows.astype(np.uint16) if self.bits <= 16 else rows, kind="stable")
        ranked = rows[order]
        begins = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        many = np.diff(np.append(begins, len(ranked)))
        falling = np.argsort((_SHORT + 1 - np.minimum(many, _SHORT + 1)).astype(np.uint8), kind="stable")
        begins, many = begins[falling], many[falling]
        own = ranked[begins]
        _, moved, sums = (x[: len(rows)] for x in _scratch())
        sums = segment_sums(gradient, order, begins, many, moved, sums[: len(own)])
        # Most runs are one row, at the end; one factor for all of them.
        several = np.count_nonzero(many > 1)
        sums[:several] *= (RATE / (many[:several] + DAMPING)).astype(np.float32)[:, None]
        sums[several:] *= np.float32(RATE / (1 + DAMPING))
        held = moved[: len(own)]
        np.take(self.weights, own, axis=0, out=held, mode="clip")
        held -= sums
        row = np.dtype((np.void, self.weights.strides[0]))
        self.weights.view(row)[own] = held.view(row)


def _packed_counts(rows: DataFrame, bits: int) -> DataFrame:
    """Stored (bucket, keys, counts) of all tokens of the rows' texts."""

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, found = np.unique(np.concatenate(held), return_counts=True)
        bucket, begin = by_bucket(keys, bits)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket, pa.int32()),
                pa.array([x.tobytes() for x in np.split(keys, begin[1:])], pa.binary()),
                pa.array(
                    [x.tobytes() for x in np.split(found.astype(np.uint32), begin[1:])], pa.binary()
                ),
            ],
            ["bucket", "keys", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for block in blocks(t.as_py() for t in batch.column(0)):
                held.append(tokens(block)[0])
                total += len(held[-1])
                if total >= _FLUSH:
                    yield pack(held)
                    held, total = [], 0
        if held:
            yield pack(held)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(rows["keys"]), np.uint64)
        found = np.frombuffer(b"".join(rows["counts"]), np.uint32)
        order = np.argsort(keys, kind="stable")
        keys, found = keys[order], found[order].astype(np.int64)
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sums = np.add.reduceat(found, begins)
        return pd.DataFrame(
            {
                "bucket": rows["bucket"].iloc[:1],
                "keys": [keys[begins].tobytes()],
                "counts": [sums.tobytes()],
                "tokens": [int(sums.sum())],
                "types": [len(begins)],
            }
        )

    return stored(
        rows.select("text")
        .mapInArrow(run, "bucket int, keys binary, counts binary")
        .groupBy("bucket")
        .applyInPandas(add, "bucket int, keys binary, counts binary, tokens long, types long"),
        "word_counts",
    )


def _trained(rows: DataFrame, model: Model) -> Model:
    """Rounds of gradient steps in tasks, averaged by tokens."""
    spark = rows.sparkSession
    shape = model.weights.shape
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        own = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == turn)

        def run(batches, shared=shared):
            start = shared.value
            mine = Model.__new__(Model)
            mine.__dict__.update(start.__dict__, weights=start.weights.copy())
            seen = 0
            for batch in batches:
                for block in blocks(t.as_py() for t in batch.column(0)):
                    sequence, first = tokens(block)
                    mine.learn(contexts(sequence, first), mine.found(sequence))
                    seen += len(sequence)
            if seen:
                moved = (mine.weights - start.weights).astype(np.float16).reshape(_WEIGHT_BLOCKS, -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(_WEIGHT_BLOCKS), pa.int32()),
                        pa.array([m.tobytes() for m in moved], pa.binary()),
                        pa.array([seen] * _WEIGHT_BLOCKS, pa.int64()),
                    ],
                    ["block", "moved", "seen"],
                )

        def add(part: pd.DataFrame, steps: bool) -> pd.DataFrame:
            total = np.zeros(int(np.prod(shape)) // _WEIGHT_BLOCKS)
            for moved, seen in zip(part["moved"], part["seen"], strict=True):
                if steps:  # of one task, in short numbers; weighted by its tokens from here on
                    total += np.frombuffer(moved, np.float16).astype(np.float64) * seen
                else:
                    total += np.frombuffer(moved, np.float32)
            return pd.DataFrame(
                {
                    "block": part["block"].iloc[:1],
                    "moved": [total.astype(np.float32).tobytes()],
                    "seen": [int(part["seen"].sum())],
                }
            )

        schema = "block int, moved binary, seen long"
        steps = own.select("text").mapInArrow(run, schema)
        some = F.floor(F.spark_partition_id() / _TASKS_A_SUM)
        sums = steps.withColumn("some", some).groupBy("block", "some").applyInPandas(
            lambda part: add(part, True), schema
        )
        sums = sums.groupBy("block").applyInPandas(lambda part: add(part, False), schema)
        found = {r["block"]: (r["moved"], r["seen"]) for r in sums.collect()}
        if found:
            mean = [np.frombuffer(m, np.float32) / n for _, (m, n) in sorted(found.items())]
            model.weights = model.weights + np.concatenate(mean).reshape(shape).astype(np.float32)
    return model


def scored(docs: DataFrame, held_out: Column) -> DataFrame:
    """Counts and scores of every row; rows with ``held_out`` (of ``doc_id``) teach nothing."""
    spark = docs.sparkSession
    rows = id_and_text(docs)
    teaching = rows.where(~held_out)
    bits = bucket_bits(docs.count(), DOCS_A_BUCKET)
    counted = _packed_counts(teaching, bits)
    total = counted.agg(F.sum("tokens"), F.sum("types")).first()
    n, v = int(total[0] or 0), int(total[1] or 0)
    keys, counts = frequent(counted, least_count(counted, table_words(v)))
    model = _trained(teaching, Model(keys, counts, n, v))
    shared = spark.sparkContext.broadcast(model)
    schema = (
        "doc_id long, row long, n_tokens long, n_known long, log_counts double, model double, "
        "bucket int, keys binary, rows binary"
    )
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def requests(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """Words whose counts are elsewhere, with their rows, by bucket."""
        wanted = np.concatenate([k for k, _ in held])
        places = np.concatenate([r for _, r in held])
        order = np.argsort(wanted, kind="stable")
        wanted, places = wanted[order], places[order]
        bucket, begin = by_bucket(wanted, bits)
        none = [pa.nulls(len(bucket), t) for t in [pa.int64()] * 4 + [pa.float64()] * 2]
        return pa.RecordBatch.from_arrays(
            [
                *none,
                pa.array(bucket, pa.int32()),
                pa.array([x.tobytes() for x in np.split(wanted, begin[1:])], pa.binary()),
                pa.array([x.tobytes() for x in np.split(places, begin[1:])], pa.binary()),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            row = batch.column(2).to_numpy()
            columns: list[list[np.ndarray]] = [[], [], [], []]
            done = 0
            for block in blocks(t.as_py() for t in batch.column(1)):
                sequence, first = tokens(block)
                begins = first[:-1]
                at = own.found(sequence)
                there = at >= 0
                logs = np.zeros(len(sequence))
                logs[there] = own.log_counts[at[there]]
                other = own.unnamed(at)
                chance = own.log10(contexts(sequence, first), at)
                chance[other] += logs[other] - np.log10(own.rest)
                columns[0].append(np.diff(first))
                columns[1].append(np.add.reduceat(there.astype(np.int64), begins))
                columns[2].append(np.add.reduceat(logs, begins))
                columns[3].append(np.add.reduceat(chance, begins))
                mine = np.repeat(row[done : done + len(block)], np.diff(first))
                if not there.all():
                    held.append((sequence[~there], mine[~there]))
                done += len(block)
                if sum(len(k) for k, _ in held) >= _FLUSH:
                    yield requests(held)
                    held = []
            if batch.num_rows:
                parts = [np.concatenate(c) for c in columns]
                none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary())]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2)]
                    + [pa.array(p, k) for p, k in zip(parts, kinds, strict=True)]
                    + none,
                    names,
                )
        if held:
            yield requests(held)

    first_pass = stored(
        rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema), "scores"
    )

    def look_up(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if asked.empty:
            return pd.DataFrame({"row": [], "logs": [], "known": []})
        wanted = np.frombuffer(b"".join(asked["keys"]), np.uint64)
        places = np.frombuffer(b"".join(asked["rows"]), np.int64)
        known = np.zeros(len(wanted), np.int64)
        if len(held):
            have = np.frombuffer(held["keys"].iloc[0], np.uint64)
            times = np.frombuffer(held["counts"].iloc[0], np.int64)
            at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
            hit = have[at] == wanted
            known[hit] = times[at[hit]]
        row, inverse = np.unique(places, return_inverse=True)
        return pd.DataFrame(
            {
                "row": row,
                "logs": np.bincount(inverse, np.log10(known + 1.0)),
                "known": np.bincount(inverse, known > 0).astype(np.int64),
            }
        )

    asked = first_pass.where("bucket IS NOT NULL").select("bucket", "keys", "rows")
    rare = (
        counted.select("bucket", "keys", "counts")
        .groupBy("bucket")
        .cogroup(asked.groupBy("bucket"))
        .applyInPandas(look_up, "row long, logs double, known long")
        .groupBy("row")
        .agg(F.sum("logs").alias("logs"), F.sum("known").alias("known"))
    )
    base = float(np.log10(n + v + 1))
    logs = F.coalesce("logs", F.lit(0.0))
    return (
        first_pass.where("bucket IS NULL")
        .join(rare, "row", "left")
        .select(
            "doc_id",
            held_out.alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("log_counts") + logs - F.col("n_tokens") * base).alias("base_score"),
            (F.col("model") + logs).alias("score"),
        )
    )
