"""Document quality by a Bradley-Terry model over preference pairs.

A document of label 1 is preferred to one of label 0.  The model gives each document a
score, linear in its features, and the chance that one is preferred to another is the
logistic function of the difference of their scores; it is learned by logistic loss on
feature differences.  The features are shape statistics of the whole text, each cut into
bins at its own quantiles, so a weight belongs to a range of values.

The score below which a document counts as bad is a quantile of the scores of the labelled
documents: the share of label 0 among them.  Scores are shifted so that this threshold is
``THRESHOLD`` and pass through the logistic function.

Labelled rows to learn from are bounded by ``LEARN_ROWS``, taken by a hash of the id; each of
them is in ``PAIRS_A_ROW`` pairs or more.  All rows are scored.

Defined results: a null or empty text has the features of no words; a document with
several labels has their majority, ties count as 1; rows with a null id or label teach
nothing; without both labels nothing can be learned and every score is 1; an empty table
gives no rows.  Columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.common import drawn, id_and_text

LEARN_ROWS = 16_000
PAIRS_A_ROW = 4
#: Pairs whose differences the driver holds at once, 6 MB.
PAIRS_A_BLOCK = 4_096
BINS = 12
THRESHOLD = 0.7
_RIDGE = 2.0
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_ENDS = b".!?"
_COMMON = b" \n\t\r.,;:!?'\"-()"
_SIGNS = bytes(c for c in range(33, 127) if c not in _UPPER + _LOWER + _DIGITS + _COMMON)


def features(text: str | None) -> list[float]:
    """Shape statistics of a whole text; shares where they do not depend on its length."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    size, n = max(len(data), 1), max(len(words), 1)
    counts = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]

    def share(letters: bytes) -> float:
        return (len(data) - len(data.translate(None, letters))) / size

    upper, lower = share(_UPPER), share(_LOWER)
    top = counts.most_common(1)[0][1] if words else 0
    twins = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = sum(data.count(bytes([c])) for c in _ENDS)
    return [
        float(np.log1p(len(words))),
        len(data) / n,
        upper,
        upper / max(upper + lower, 1e-9),
        share(_DIGITS),
        share(_SIGNS),
        (len(data.translate(None, _UPPER + _LOWER + _DIGITS)) - len(words)) / n,
        len(counts) / n,
        top / n,
        twins / n,
        pairs / n,
        ends / n,
        len(set(lines)) / max(len(lines), 1),
        len(lines) / n,
        len(zlib.compress(data, 1)) / size,
        sum(map(len, counts)) / max(len(counts), 1),
    ]


def feature_rows(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), -1)


class Ranking:
    """Weights of feature bins, and the shift that puts the quantile at the threshold."""

    def __init__(self, bounds: list[np.ndarray], weights: list[np.ndarray], cut: float) -> None:
        self.bounds, self.weights, self.cut = bounds, weights, cut

    def raw(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values))
        for k, (bounds, weights) in enumerate(zip(self.bounds, self.weights, strict=True)):
            total += weights[np.searchsorted(bounds, values[:, k])]
        return total

    def scores(self, values: np.ndarray) -> np.ndarray:
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.raw(values) - self.cut + shift, -30, 30)))


def fit(values: np.ndarray, good: np.ndarray) -> Ranking | None:
    """Newton steps on the logistic loss of preference pairs."""
    if not good.any() or good.all():
        return None
    bounds = [
        np.unique(np.quantile(values[:, k], np.arange(1, BINS) / BINS))
        for k in range(values.shape[1])
    ]
    begins = np.cumsum([0] + [len(b) + 1 for b in bounds])
    # The column of each feature's bin: a row has a one there and is zero elsewhere.
    places = np.stack(
        [begins[k] + np.searchsorted(b, values[:, k]) for k, b in enumerate(bounds)], axis=1
    )
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    pairs = PAIRS_A_ROW * max(len(better), len(worse))
    rng = np.random.Generator(np.random.PCG64(5))
    wins = better[rng.permutation(pairs) % len(better)]
    losses = worse[rng.permutation(pairs) % len(worse)]
    weights = np.zeros(begins[-1])
    for _ in range(12):
        gradient, curve = np.zeros(len(weights)), np.zeros((len(weights), len(weights)))
        for begin in range(0, pairs, PAIRS_A_BLOCK):
            some = slice(begin, begin + PAIRS_A_BLOCK)
            difference = np.zeros((len(wins[some]), len(weights)))
            rows = np.arange(len(difference))[:, None]
            difference[rows, places[wins[some]]] = 1
            difference[rows, places[losses[some]]] -= 1
            chance = 1 / (1 + np.exp(-np.clip(difference @ weights, -30, 30)))
            gradient += difference.T @ (1 - chance)
            curve += (difference * (chance * (1 - chance))[:, None]).T @ difference
        gradient -= _RIDGE * weights
        step = np.linalg.solve(curve + _RIDGE * np.eye(len(weights)), gradient)
        weights += step
        if np.abs(step).max() < 1e-4:
            break
    split = np.split(weights, begins[1:-1])
    model = Ranking(bounds, split, 0.0)
    model.cut = _quantile_cut(model.raw(values), good)
    return model


def _quantile_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The score quantile at the share of label 0, midway between its neighbours."""
    ranked = np.sort(scores)
    bad = int((~good).sum())
    return float((ranked[bad - 1] + ranked[min(bad, len(ranked) - 1)]) / 2)


def learned(docs: DataFrame, labels: DataFrame, teaches: Column) -> Ranking | None:
    """A model of the labelled documents for whose ``doc_id`` ``teaches`` holds."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & teaches)
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).alias("good"))
    )
    total = usable.count()
    # Bounded by LEARN_ROWS, with the spread of a hash.
    taught = F.broadcast(usable.where(drawn("doc_id", LEARN_ROWS / max(total, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = feature_rows(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(values.tolist(), pa.list_(pa.float64()))],
                ["good", "features"],
            )

    rows = (
        id_and_text(docs)
        .join(taught, "doc_id")
        .select("doc_id", "text", "good")
        .mapInArrow(run, "good boolean, features array<double>")
        .toArrow()
    )
    if not rows.num_rows:
        return None
    good = rows.column(0).to_numpy()
    values = rows.column(1).combine_chunks().flatten().to_numpy().reshape(len(good), -1)
    order = np.lexsort((*values.T, good))  # the same sample gives the same model
    return fit(values[order], good[order])


def scored(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if model is None or not n:
                scores = np.ones(n)
            else:
                scores = model.scores(feature_rows(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"]
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Ranking | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that reach the threshold, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None or not batch.num_rows:
                yield batch
            else:
                scores = model.scores(feature_rows(batch.column(at).to_pylist()))
                yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
