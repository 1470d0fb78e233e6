"""Exact dedup against a minimal perfect hash of the digests already seen.

History is an index: its distinct SHA-256 digests are dealt to buckets, and each bucket
has a minimal perfect hash, a chain of bit levels.  Level ``k`` hashes every digest that
is still without a place; a position hit by exactly one digest is that digest's for good.
The rank of the bit among all levels is the slot, so ``n`` digests have slots 0 to n - 1.
A slot holds the full digest, the locator of the winner and the number of copies.

A lookup gives some slot for any digest, so it counts only if all 32 bytes of the slot's
digest agree.  Members join the slot's group, nonmembers form groups of their own.

Defined results: a null text is the empty text.  Of equal texts the largest doc_id stays,
a null doc_id being the smallest; of rows equal in both, one stays.  An empty table gives
no rows.  Columns other than id and text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.common import id_and_text, parts, stored, without_ids
from fieldsift.llm.shingles import mix

DIGESTS_A_BUCKET = 20_000
_LOAD = 1.5
_LEAST_ID = -(1 << 63)

INDEX_SCHEMA = (
    "bucket int, sizes array<long>, bits binary, digests binary, "
    "winner_ids binary, winner_rows binary, copies binary"
)
GROUP_SCHEMA = "digest binary, keep_id long, keep_row long, group_size long"


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a level puts digests, given as rows of four 64-bit words."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    mixed = mix(keys[:, 0] ^ salt)
    for word in range(1, 4):
        mixed = mix(mixed ^ keys[:, word])
    return (mixed % np.uint64(size)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and bits of a minimal perfect hash of distinct digests."""
    sizes, levels = [], []
    left = keys
    while len(left):
        size = max(1, int(len(left) * _LOAD))
        at = _positions(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def slots_of(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each digest; -1 where no level has a bit for it."""
    slots = np.full(len(keys), -1, np.int64)
    rank = np.cumsum(bits) - 1
    left = np.arange(len(keys))
    begin = 0
    for level, size in enumerate(sizes):
        at = begin + _positions(keys[left], level, size)
        hit = bits[at]
        slots[left[hit]] = rank[at[hit]]
        left = left[~hit]
        begin += size
    return slots


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def _index_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    keys = _keys(rows["digest"])
    sizes, bits = perfect_hash(keys)
    order = np.empty(len(keys), np.int64)
    order[slots_of(keys, sizes, bits)] = np.arange(len(keys))

    def held(column: str) -> bytes:
        return rows[column].to_numpy(np.int64)[order].tobytes()

    return pd.DataFrame(
        {
            "bucket": [rows["bucket"].iloc[0]],
            "sizes": [sizes],
            "bits": [np.packbits(bits).tobytes()],
            "digests": [keys[order].tobytes()],
            "winner_ids": [held("keep_id")],
            "winner_rows": [held("keep_row")],
            "copies": [held("group_size")],
        }
    )


def _look_up(index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """All groups of a bucket: the slots, with the batch's members added, and the rest."""
    own = _keys(batch["digest"])
    new = batch[["keep_id", "keep_row", "group_size"]].to_numpy(np.int64)
    if index.empty:
        return batch[["digest", "keep_id", "keep_row", "group_size"]]
    held = index.iloc[0]
    slots = np.frombuffer(held["digests"], "<u8").reshape(-1, 4)
    bits = np.unpackbits(np.frombuffer(held["bits"], np.uint8))[: int(sum(held["sizes"]))]
    groups = np.stack(
        [np.frombuffer(held[c], np.int64) for c in ("winner_ids", "winner_rows", "copies")], 1
    ).copy()
    at = slots_of(own, [int(s) for s in held["sizes"]], bits.astype(bool))
    member = at >= 0
    member[member] = (slots[at[member]] == own[member]).all(axis=1)
    at, mine = at[member], new[member]
    newer = (mine[:, 0] > groups[at, 0]) | (
        (mine[:, 0] == groups[at, 0]) & (mine[:, 1] > groups[at, 1])
    )
    groups[at, 2] += mine[:, 2]
    groups[at[newer], :2] = mine[newer, :2]
    keys = np.concatenate([slots, own[~member]])
    values = np.concatenate([groups, new[~member]])
    return pd.DataFrame(
        {
            "digest": [k.tobytes() for k in keys],
            "keep_id": values[:, 0],
            "keep_row": values[:, 1],
            "group_size": values[:, 2],
        }
    )


def digest_rows(docs: DataFrame) -> DataFrame:
    """One small stored row per document: its id, a row number and its text's digest."""
    return stored(
        id_and_text(docs).select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
        ),
        "digests",
    )


def grouped(digests: DataFrame) -> DataFrame:
    """Distinct digests with winner and copies, combined before the shuffle."""
    best = F.max(F.struct(F.coalesce("doc_id", F.lit(_LEAST_ID)).alias("i"), F.col("row").alias("r")))
    return (
        digests.groupBy("digest")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .selectExpr("digest", "best.i AS keep_id", "best.r AS keep_row", "group_size")
    )


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn(
        "bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")
    )


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The stored index of a history of digest rows, one row a bucket."""
    rows = _bucketed(grouped(history), buckets).groupBy("bucket")
    return stored(rows.applyInPandas(_index_bucket, INDEX_SCHEMA), "perfect_hash")


def look_up(batch: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Groups of history and batch together, a row for each distinct digest."""
    rows = _bucketed(grouped(batch), buckets)
    return (
        index.groupBy("bucket")
        .cogroup(rows.groupBy("bucket"))
        .applyInPandas(_look_up, GROUP_SCHEMA)
    )


def decide(docs: DataFrame, in_history: F.Column | None = None) -> DataFrame:
    """A decision for every row: doc_id, row, digest, keep_id, group_size, kept.

    ``in_history`` says, from ``doc_id``, which rows the index is built from; the result
    is the same for any choice.  By default every second id is history.
    """
    digests = digest_rows(docs)
    if in_history is None:
        in_history = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    old = F.coalesce(in_history, F.lit(False))
    buckets = parts(digests.count(), DIGESTS_A_BUCKET, 64)
    groups = look_up(
        digests.where(~old), build_index(digests.where(old), buckets), buckets
    )
    return digests.join(groups, "digest").select(
        "doc_id",
        "row",
        "digest",
        F.when(F.col("keep_id") != _LEAST_ID, F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
    )


def deduplicated(docs: DataFrame, in_history: F.Column | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows equal in id and text one stays, any of them if they differ elsewhere.  Ids of which
    no row stays are dropped by id, so texts stay where they are (see ``without_ids``).  Ids
    with rows that stay and rows that go, and null ids if any of their rows goes, are told
    apart by id and text; only the rows of such ids are moved.
    """
    mark = uuid.uuid4().hex  # no column of the table has such a name
    own_digest, own_id, kept_digest = (f"{n}_{mark}" for n in ("digest", "id", "kept"))
    decisions = stored(decide(docs, in_history).select("doc_id", "digest", "kept"), "decisions")
    stays = F.sum(F.col("kept").cast("long"))
    changed = stored(
        decisions.groupBy(F.col("doc_id").alias(own_id))
        .agg(F.count(F.lit(1)).alias("rows"), stays.alias("stays"))
        .where("stays < rows")
        .select(own_id, (F.col("stays") > 0).alias("some")),
        "changed",
    )
    whole = without_ids(docs, changed.where(F.col(own_id).isNotNull()).select(own_id))
    mixed = changed.where(F.col("some") | F.col(own_id).isNull())
    found = mixed.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(own_id).isNull()).alias("null_ids")
    ).first()
    if not found["n"]:
        return whole
    if found["null_ids"]:
        whole = whole.where(F.col("doc_id").isNotNull())
    kept = decisions.where("kept").join(
        mixed, F.col("doc_id").eqNullSafe(F.col(own_id)), "left_semi"
    )
    kept = kept.select(F.col("doc_id").alias(own_id), F.col("digest").alias(kept_digest))
    own = docs.withColumn(
        own_digest, F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    )
    same = own["doc_id"].cast("long").eqNullSafe(F.col(own_id)) & (
        own[own_digest] == F.col(kept_digest)
    )
    single = own.join(kept, same).dropDuplicates(["doc_id", own_digest]).select(docs.columns)
    return whole.unionByName(single)
