"""Packed counts of 64-bit keys in buckets: histograms and the most frequent ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_count(counted: DataFrame, limit: int) -> int:
    """The least count such that at most ``limit`` keys have as much or more.

    ``counted`` has a column ``counts`` of packed 64-bit numbers.  Counts are taken in
    steps of a hundredth part of their size, so the histogram is small for any corpus.
    """

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)
            step = np.floor(np.log(np.maximum(found, 1)) * 100).astype(np.int64)
            own, many = np.unique(step, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array(many, pa.int64())], ["step", "n"]
            )

    steps = (
        counted.select("counts")
        .mapInArrow(histogram, "step long, n long")
        .groupBy("step")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    least, total = 1 << 62, 0
    for step, many in sorted(((r["step"], r["n"]) for r in steps), reverse=True):
        total += many
        if total > limit:
            break
        least = int(np.ceil(np.exp(step / 100) - 1e-6))
    return least


def frequent(counted: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and counts of the keys with at least this count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), kind)
                for k, kind in ((0, np.uint64), (1, np.int64))
            )
            often = counts >= least
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[often].tobytes()], pa.binary()),
                    pa.array([counts[often].tobytes()], pa.binary()),
                ],
                ["keys", "counts"],
            )

    found = counted.select("keys", "counts").mapInArrow(run, "keys binary, counts binary").toArrow()
    keys = np.frombuffer(b"".join(found.column(0).to_pylist()), np.uint64)
    counts = np.frombuffer(b"".join(found.column(1).to_pylist()), np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def by_bucket(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys, the buckets (their highest bits) that occur and where each begins."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return np.unique(bucket, return_index=True)


def bucket_bits(rows: int, rows_a_bucket: int) -> int:
    """How many bits name a bucket; more than 18 would leave tasks a few keys for each."""
    return min(18, max(4, int(np.ceil(np.log2(rows / rows_a_bucket + 1)))))
