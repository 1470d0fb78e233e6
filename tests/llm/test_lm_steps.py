"""The sums behind a gradient step of the language model."""

import numpy as np
import pytest

from fieldsift.llm import ngram_lm

RNG = np.random.Generator(np.random.PCG64(4))


@pytest.mark.parametrize("most", (3, 40, 4000))
def test_sums_of_runs(most):
    rows = RNG.normal(size=(3000, ngram_lm.WAYS)).astype(np.float32)
    owner = RNG.integers(0, most, 3000)
    order = np.argsort(owner, kind="stable")
    ranked = owner[order]
    begins = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    many = np.diff(np.append(begins, 3000))
    falling = np.argsort(-many, kind="stable")
    begins, many = begins[falling], many[falling]
    held, out = np.empty_like(rows), np.empty((len(many), ngram_lm.WAYS), np.float32)
    sums = ngram_lm.segment_sums(rows, order, begins, many, held, out)
    want = np.zeros((most, ngram_lm.WAYS))
    np.add.at(want, owner, rows)
    np.testing.assert_allclose(sums, want[ranked[begins]], atol=1e-3)
