"""What the driver holds while it learns and sends tables to the tasks, and packing in a task."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from fieldsift.llm import packing, quality, similarity


def _rows(n):
    rng = np.random.Generator(np.random.PCG64(8))
    values = rng.normal(size=(n, 16))
    values[:, 3] = np.round(values[:, 3])  # fewer bounds than bins
    good = values[:, :4].sum(axis=1) + rng.normal(size=n) > -1
    return values, good


def _fitted_whole(values, good):
    """Weights by the same steps over one matrix of all pairs."""
    bounds = [np.unique(np.quantile(v, np.arange(1, quality.BINS) / quality.BINS)) for v in values.T]
    coded = np.concatenate(
        [np.eye(len(b) + 1)[np.searchsorted(b, v)] for b, v in zip(bounds, values.T, strict=True)],
        axis=1,
    )
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    pairs = quality.PAIRS_A_ROW * max(len(better), len(worse))
    rng = np.random.Generator(np.random.PCG64(5))
    wins = better[rng.permutation(pairs) % len(better)]
    losses = worse[rng.permutation(pairs) % len(worse)]
    difference = coded[wins] - coded[losses]
    weights = np.zeros(coded.shape[1])
    for _ in range(12):
        chance = 1 / (1 + np.exp(-np.clip(difference @ weights, -30, 30)))
        gradient = difference.T @ (1 - chance) - 2 * weights
        curve = (difference * (chance * (1 - chance))[:, None]).T @ difference
        step = np.linalg.solve(curve + 2 * np.eye(len(weights)), gradient)
        weights += step
        if np.abs(step).max() < 1e-4:
            break
    return weights


def test_the_driver_holds_no_matrix_of_all_pairs():
    values, good = _rows(quality.LEARN_ROWS)
    tracemalloc.start()
    try:
        model = quality.fit(values, good)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40e6, f"{most / 1e6:.0f} MB"
    assert np.allclose(np.concatenate(model.weights), _fitted_whole(values, good), atol=1e-9)


def test_blocks_of_pairs_change_no_score(monkeypatch):
    values, good = _rows(700)
    whole = quality.fit(values, good).scores(values)
    for size in (1, 333, 2_000):
        monkeypatch.setattr(quality, "PAIRS_A_BLOCK", size)
        assert np.allclose(quality.fit(values, good).scores(values), whole, atol=1e-12)


def test_the_order_of_shingles_is_given_up_once_sets_are_made(spark, monkeypatch):
    kind = type(spark.sparkContext.broadcast(0))
    gone, destroy = [], kind.destroy
    monkeypatch.setattr(kind, "destroy", lambda self, *a: (gone.append(self), destroy(self, *a)))
    docs = spark.createDataFrame(
        [(k, "one two three four five six seven eight nine ten" + " x" * (k // 2)) for k in range(8)],
        "doc_id long, text string",
    )
    got = similarity.components(docs)
    assert len(gone) == 1
    kept = got.where(F.col("doc_id") % 2 == 1).where("component_id < doc_id")
    assert got.count() == 8 and kept.count() == 4


def test_packing_holds_one_block_of_texts():
    taken = []
    texts = ("x" * (packing.BLOCK_CHARS // 3) for k in range(20) if taken.append(k) is None)
    sizes = []
    for block in packing._blocks(texts):
        sizes.append(len(block))
        assert len(taken) == sum(sizes)
    assert sum(sizes) == 20 and max(sizes) == 4
