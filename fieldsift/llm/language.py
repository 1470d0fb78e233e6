"""Language identification with error-correcting output codes.

Every language has a codeword of bits.  For each bit a binary n-gram classifier tells the
languages with a 1 from those with a 0: the log ratio of hashed byte trigrams, averaged
over the text.  A text gets the language with the least loss between its margins and the
codeword, each bit weighted by how often its classifier was right on that language.  Two
codewords with nearly the same loss make a text ambiguous.

Labelled rows to learn from are bounded by ``LEARN_ROWS``, taken by a hash of the id; all
texts are scored, as wholes.

Defined results: a null text or one without letters is ``und`` with score 0; without any
labelled row every text is ``und``; equal losses go to the first language by name; rows
with a null language teach nothing; an empty table gives no rows.  Columns other than id,
text and language are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.common import drawn, id_and_text
from fieldsift.llm.shingles import BLOCK_BYTES

LEARN_ROWS = 12_000
GRAMS = 1 << 15
AMBIGUOUS = 0.1
UNKNOWN = "und"
_SMOOTHING = 0.5
_SHARPNESS = 6.0
_PLAIN_LETTER = re.compile("[A-Za-z]")
_TO_SPACE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter (category L); signs such as a raised 2 are none."""
    return bool(text) and bool(_PLAIN_LETTER.search(text) or any(map(str.isalpha, text)))


def codewords(languages: int) -> np.ndarray:
    """One row of -1 and 1 per language.

    Up to five languages get all ways to split them in two; more get random bits, as many
    as keep rows well apart, from a fixed seed.
    """
    if languages <= 1:
        return np.ones((languages, 1), np.int8)
    if languages <= 5:
        splits = np.arange(1, 1 << (languages - 1))
        return np.where(splits[None, :] >> np.arange(languages)[:, None] & 1, 1, -1).astype(np.int8)
    bits = int(np.ceil(15 * np.log2(languages)))
    rng = np.random.Generator(np.random.PCG64(3))
    best, apart = None, -1
    for _ in range(50):
        code = np.where(rng.random((languages, bits)) < 0.5, -1, 1).astype(np.int8)
        mixed = np.abs(code.sum(axis=0)) < languages
        inner = code.astype(int) @ code.T + np.eye(languages, dtype=int) * -9 * bits
        distance = (bits - inner.max()) // 2 if mixed.all() else -1
        if best is None or distance > apart:
            best, apart = code, distance
    return best


def gram_blocks(texts: list[str | None]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Hashed trigrams of texts, a block at a time: rows, grams, first gram of each row."""
    begin, held, size = 0, [], 0
    for k, text in enumerate(texts):
        data = (text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE)
        held.append(b" " + data + b"  ")
        size += len(data)
        if size >= BLOCK_BYTES or k == len(texts) - 1:
            joined = np.frombuffer(b"".join(held), np.uint8).astype(np.uint32)
            codes = (joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]) * np.uint32(2654435761)
            grams = np.append((codes >> np.uint32(17)).astype(np.uint16), [0, 0])
            first = np.cumsum([0] + [len(h) for h in held[:-1]])
            yield slice(begin, k + 1), grams, first
            begin, held, size = k + 1, [], 0


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    for _, grams, _ in gram_blocks([text]):
        return np.unique(grams[:-2], return_counts=True)


class OutputCode:
    """Codewords, gram weights of each bit, scale of its margins, and how far to trust it."""

    def __init__(self, names: list[str], counts: np.ndarray) -> None:
        self.names = names
        self.code = codewords(len(names))
        share = (counts + _SMOOTHING) / (counts + _SMOOTHING).sum(axis=1, keepdims=True)
        bits = self.code.shape[1]
        self.weights = np.zeros((GRAMS, bits), np.float32)
        for b in range(bits if len(names) > 1 else 0):
            one = self.code[:, b] == 1
            self.weights[:, b] = np.log(share[one].mean(axis=0) / share[~one].mean(axis=0))
        self.scale = np.ones(bits)
        self.trust = np.full(self.code.shape, 1 / bits)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        found = np.zeros((len(texts), self.code.shape[1]))
        for rows, grams, first in gram_blocks(texts):
            sums = np.add.reduceat(self.weights[grams], first, axis=0, dtype=np.float64)
            ends = np.append(first[1:], len(grams))
            # The last two places of a text are its closing spaces, not grams of its own.
            last = self.weights[grams[ends - 1]] + self.weights[grams[ends - 2]]
            found[rows] = (sums - last) / np.maximum(ends - first - 2, 1)[:, None]
        return found / self.scale

    def tune(self, margins: np.ndarray, truth: np.ndarray) -> None:
        """Scale each bit's margins to 1 on average and weigh bits by their accuracy."""
        if not len(truth):
            return
        self.scale = np.maximum(np.abs(margins).mean(axis=0), 1e-9)
        for k in range(len(self.names)):
            own = margins[truth == k]
            if len(own):
                right = (np.sign(own) == self.code[k]).mean(axis=0)
                self.trust[k] = (right + 1e-3) / (right + 1e-3).sum()

    def losses(self, margins: np.ndarray) -> np.ndarray:
        agree = margins[:, None, :] * self.code[None, :, :]
        return (np.logaddexp(0, -2 * agree) * self.trust[None]).sum(axis=2)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not texts:
            return [], np.zeros(0), np.zeros(0, bool)
        losses = self.losses(self.margins(texts))
        order = np.argsort(losses, axis=1, kind="stable")
        rows = np.arange(len(texts))
        best = losses[rows, order[:, 0]]
        chance = 1 / np.exp(-_SHARPNESS * (losses - best[:, None])).sum(axis=1)
        second = losses[rows, order[:, min(1, losses.shape[1] - 1)]]
        unclear = (second - best < AMBIGUOUS) & (len(self.names) > 1)
        names = [self.names[k] for k in order[:, 0]]
        for k, text in enumerate(texts):
            if not has_letter(text):
                names[k], chance[k], unclear[k] = UNKNOWN, 0.0, False
        return names, chance, unclear


def learned(docs: DataFrame, teaches: Column, lang: str = "lang") -> OutputCode | None:
    """A model of the rows with a language for whose ``doc_id`` ``teaches`` holds."""
    usable = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("text").cast("string").alias("text"),
            F.col(lang).cast("string").alias("lang"),
        ).where(F.col("lang").isNotNull() & teaches & F.col("text").isNotNull())
    )
    groups = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(groups)
    if not names:
        return None
    # An even bound for each language, so rare ones are learned too.
    each = max(1, LEARN_ROWS // len(names))
    taken = F.lit(False)
    for name in names:
        taken = taken | ((F.col("lang") == name) & drawn("doc_id", each / groups[name]))
    number = {name: k for k, name in enumerate(names)}
    sample = usable.where(taken).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(names), GRAMS), np.int64)
        for batch in batches:
            for lang_name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, found = gram_counts(text)
                totals[number[lang_name], grams] += found
        k, gram = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int32()), pa.array(gram, pa.int32()), pa.array(totals[k, gram], pa.int64())],
            ["k", "gram", "n"],
        )

    counts = np.zeros((len(names), GRAMS))
    # At most languages x GRAMS rows.
    summed = sample.mapInArrow(count, "k int, gram int, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    for batch in summed.toArrow().to_batches():
        counts[batch.column(0).to_numpy(), batch.column(1).to_numpy()] = batch.column(2).to_numpy()
    model = OutputCode(names, counts)

    def margin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            truth = [number[x] for x in batch.column(0).to_pylist()]
            found = model.margins(batch.column(1).to_pylist()) if truth else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(truth, pa.int32()), pa.array(found.tolist(), pa.list_(pa.float64()))],
                ["k", "margins"],
            )

    seen = sample.mapInArrow(margin, "k int, margins array<double>").toArrow()
    if seen.num_rows:
        truth = seen.column(0).to_numpy()
        margins = np.array(seen.column(1).to_pylist())
        model.tune(margins, truth)
    return model


def identified(docs: DataFrame, model: OutputCode | None) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row."""
    names = ["doc_id", "lang_pred", "score", "ambiguous"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if model is None:
                found = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            else:
                found = model.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(found[0], pa.string()),
                    pa.array(found[1], pa.float64()),
                    pa.array(found[2], pa.bool_()),
                ],
                names,
            )

    return id_and_text(docs).mapInArrow(
        run, "doc_id long, lang_pred string, score double, ambiguous boolean"
    )
