"""Periodic runs of words: where a text repeats itself with a fixed period.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are
identical), of at least ``max(least, 2 * q)`` words, that no neighbouring word extends.

*Diagonals.*  The words are read once, from the first to the last.  The earlier occurrences
of what stands here each name a lag; a lag that was active one word before goes on, so its
match grows by one, any other starts, and an active lag that is not among them has ended.
A diagonal that ended long enough is a run and is emitted at once; nothing is kept of a word
but its occurrences.

*Phrases for words.*  A run of period ``q`` repeats at least ``max(least - q, q)`` words in
a row, so occurrences are looked up by phrases of that length, not by single words: six
words for short lags, 32 for lags from 32, 256 for lags from 256, and so on.  Phrases are
exact ranks, no hashes.  A text in which no phrase of six words occurs twice has no run; a
hash over the whole block finds these texts without reading them one by one.

*Multiples.*  Where a phrase occurs ``p`` words apart again and again and is at least as
long as ``p``, only lag ``p`` is followed there: a diagonal of a multiple of ``p`` is the
same stretch and never has its smallest period.  So a text of one word, or of one short
unit, costs one step a word.  Elsewhere a word costs as many steps as its phrase occurs
within eight times the phrase's length; that is few but for long neighbouring stretches
that repeat the same short unit and are cut apart again and again.

Defined results: a null, empty or wordless text has no runs and collapses to the empty text;
words are told apart by their bytes, upper and lower case included; runs that overlap are
all reported; equal ids and equal texts are rows of their own; a null id stays null; an empty
table gives no rows.  Columns other than id and text are ignored, whatever their names.  One
text is worked on in one task, with memory in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldsift.llm.common import id_and_text
from fieldsift.llm.shingles import blocks, mix, rolled_words

LEAST = 12
FIRST_LAGS = 32
WIDER = 8

RUN = "array<struct<start:long,length:long,period:long>>"


def phrases(codes: np.ndarray, width: int) -> np.ndarray:
    """For each place, the rank of the ``width`` codes that begin there."""

    def pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.unique(x * (int(y.max()) + 1) + y, return_inverse=True)[1]

    held, ranks = 1, codes
    while 2 * held <= width:
        ranks = pairs(ranks[:-held], ranks[held:])
        held *= 2
    return ranks if held == width else pairs(ranks[: held - width], ranks[width - held :])


def near(ranks: np.ndarray, high: int) -> bool:
    """Whether any phrase occurs again within fewer than ``high`` places."""
    order = np.argsort(ranks, kind="stable")
    again = ranks[order][1:] == ranks[order][:-1]
    return bool((np.diff(order)[again] < high).any())


def diagonals(
    ranks: list[int], width: int, low: int, high: int
) -> Iterator[tuple[int, int, int]]:
    """(first word, word behind the last, lag) of the stretches that repeat at a lag.

    ``ranks`` are phrases of ``width`` words, lags are from ``low`` to below ``high``.  Of
    lags that are multiples of another one on the same stretch some are left out.
    """
    last: dict[int, int] = {}
    before = [-1] * len(ranks)
    older = [-1] * len(ranks)
    active: dict[int, int] = {}
    for i, rank in enumerate(ranks):
        j = last.get(rank, -1)
        last[rank] = i
        going: dict[int, int] = {}
        if j >= 0:
            before[i] = j
            # Evenly spaced occurrences that touch are one periodic stretch: only its
            # smallest lag is followed, then what lies before the stretch.
            k = before[j]
            older[i] = older[j] if k >= 0 and j - k == i - j <= width else k
            at, then = j, older[i]
            while at >= 0 and i - at < high:
                if i - at >= low:
                    going[i - at] = active.pop(i - at, i)
                at, then = then, before[then]
        for lag, begin in active.items():
            yield begin - lag, i - 1 + width, lag
        active = going
    for lag, begin in active.items():
        yield begin - lag, len(ranks) - 1 + width, lag


def runs_of(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers, by start and period."""
    found: dict[tuple[int, int], int] = {}
    low, high, width = 1, max(FIRST_LAGS, -(-least // 2)), max(1, -(-least // 2))
    while width + low <= len(codes):
        ranks = phrases(codes, width)
        if near(ranks, high):
            for start, end, lag in diagonals(ranks.tolist(), width, low, high):
                if end - start >= max(least, 2 * lag):
                    # A multiple of the smallest period has the very same stretch.
                    found[start, end] = min(lag, found.get((start, end), lag))
        low, width, high = high, high, WIDER * high
    return sorted((start, end - start, lag) for (start, end), lag in found.items())


def repeating(texts: list[bytes], width: int) -> np.ndarray:
    """Which texts hold a phrase of ``width`` words twice; some others may be among them."""
    rolled, owner = rolled_words(texts, width)
    keys = mix(rolled + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    again = keys[order][1:] == keys[order][:-1]
    marks = np.zeros(len(texts), bool)
    marks[owner[order[1:][again]]] = True
    return marks


def _block(texts: list[bytes], least: int) -> Iterator[tuple[int, list, bytes]]:
    """Per text: its number of words, its runs, and the words no run repeats."""
    for text, may in zip(texts, repeating(texts, min(-(-least // 2), 16)), strict=True):
        words = text.split()  # bytes: at ASCII white space only
        found: list[tuple[int, int, int]] = []
        if may:
            numbers: dict[bytes, int] = {}
            codes = [numbers.setdefault(w, len(numbers)) for w in words]
            found = runs_of(np.array(codes, np.int64), least)
        kept = words
        if found:
            stays = np.ones(len(words), bool)
            for start, length, period in found:
                stays[start + period : start + length] = False
            kept = [words[k] for k in np.flatnonzero(stays).tolist()]
        yield len(words), found, b" ".join(kept)


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``runs`` by start and period, ``collapsed``.

    ``collapsed`` is the text without repetitions: the words that no run contains behind its
    first period, joined by one space.
    """
    fields = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for block in blocks(t.as_py() for t in batch.column(1)):
                counts, runs, texts = [], [], []
                for n, found, text in _block(block, least):
                    counts.append(n)
                    runs.append([dict(zip(("start", "length", "period"), f)) for f in found])
                    texts.append(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(block)),
                        pa.array(counts, pa.int64()),
                        pa.array(runs, pa.list_(fields)),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )
                done += len(block)

    return id_and_text(docs).mapInArrow(
        run, f"doc_id long, n_words long, runs {RUN}, collapsed string"
    )
