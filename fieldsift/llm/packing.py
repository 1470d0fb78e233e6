"""Best-fit packing of tokenised documents into sequences of a fixed length.

A document is its token ids and an end id.  Only a longer one than the capacity is cut,
into full pieces behind a first piece with the rest.

How many pieces there are of each length is all that packing depends on: a table of
at most ``capacity`` rows, whatever the size of the corpus.  The plan is made from it:

* pieces above a third of the capacity go at most two to a sequence; greedily, the longest
  is matched with the longest other one that fits beside it;
* shorter ones go, in falling order, each to the sequence with the least gap that holds
  it; sequences that look alike are handled together, so a step places many pieces;
* what finds no gap opens new sequences.

The plan says, for a range of the pieces of one length, where they go.  Every piece gets a
gapless number among those of its length and finds its place by that number, with no
group of pieces ever in one task.

Defined results: a null text is the empty text, which is the end id alone; equal ids and
equal texts are packed as often as they occur; an empty table gives no rows.  Columns
other than id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.common import id_and_text, numbered, parts, stored

CAPACITY = 1024
END_ID = 2
CACHED_WORDS = 500_000
MOST_TAILS = 10_000
BLOCK_CHARS = 1 << 18
ROWS_A_SLICE = 200_000

PIECE_SCHEMA = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
PLAN_SCHEMA = (
    "length long, first_rank long, last_rank long, first_sequence long, "
    "first_offset long, repeat long"
)
#: White space other than a space or a line break, as Python sees it.
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_MARKS = ".,;:!?"


def single_spaced(text: str) -> list[str] | None:
    """The words, each behind a line break with the break before it; the first one too.

    None unless all white space is one space or line break between two other characters.
    """
    if any(c in text for c in _OTHER_SPACES):
        return None
    parts = f"\n{text}".replace("\n", " \n").split(" ")
    del parts[0]
    return None if "" in parts or "\n" in parts else parts


def _letters_of_bytes() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


_LETTERS = _letters_of_bytes()
_SPACE = _LETTERS[32]


class WordTokens:
    """Token ids of texts as little-endian bytes, with the ids of words cached.

    Byte-level BPE begins a token before a single space and on both sides of a single line
    break, so the ids of a text are those of its words, each with the space or break before
    it.  Texts with other white space, or with the string of an added token, are encoded as wholes.  The cache lives as long as
    the Python worker; it is emptied once it holds about ``CACHED_WORDS``.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Strings of added tokens, such as an end mark, are one id wherever they occur.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        [self.line_break] = self._encode("\n")
        self.model = self.tokenizer.model

    def _encode(self, text: str) -> np.ndarray:
        [found] = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, "<u4")

    def _letters(self, bare: str) -> str:
        """The word as the model reads it, a letter for each byte."""
        return bare.encode().decode("latin-1").translate(_LETTERS)

    def _learn(self, words: list[str]) -> None:
        """Ids of `` word`` or, for a word behind a line break, of the break and the word.

        A plain word with plain marks behind it is one token run of letters and one of
        marks.  Other words go into one text with a break after each, and its ids are cut
        there.
        """
        mark = np.array([self.line_break], "<u4").tobytes()
        odd, held, tokens, letters = [], self.words, self.model.tokenize, self._letters
        for word in words:
            base = word.rstrip(_MARKS)
            behind = word[0] == "\n"
            bare = base[1:] if behind else base
            if not bare.isalpha() or not (bare.isascii() or max(bare) <= "\u024f"):
                odd.append(word)
                continue
            own = held.get(base)
            if own is None:
                spelled = bare if bare.isascii() else letters(bare)
                found = tokens(spelled if behind else _SPACE + spelled)
                own = array("I", [t.id for t in found]).tobytes()
                if behind:
                    own = mark + own
                held[base] = own
            if len(word) > len(base):
                tail = word[len(base) :]
                if tail not in self.tails:
                    if len(self.tails) >= MOST_TAILS:
                        self.tails.clear()
                    self.tails[tail] = self._encode(tail).tobytes()
                held[word] = own + self.tails[tail]
        for k in range(0, len(odd), 4096):
            some = odd[k : k + 4096]
            ids = self._encode("".join(w[1:] + "\n" if w[0] == "\n" else f" {w}\n" for w in some))
            begin = 0
            for word, end in zip(some, np.flatnonzero(ids == self.line_break).tolist(), strict=True):
                own = ids[begin:end].tobytes()
                self.words[word] = mark + own if word[0] == "\n" else own
                begin = end + 1

    def _found(self, parts: list[str]) -> list[bytes]:
        """Ids of each part; what the cache lacks is learned, all of it at once."""
        found = list(map(self.words.get, parts))
        lacking = [k for k, own in enumerate(found) if own is None]
        if lacking:
            missing = {parts[k] for k in lacking}
            if len(self.words) + len(missing) > CACHED_WORDS:
                self.words.clear()
            self._learn(list(missing))
            for k in lacking:
                found[k] = self.words[parts[k]]
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [
            None if self.added and self.added.search(t) else single_spaced(t) for t in texts
        ]
        parts = list(chain.from_iterable(p for p in split if p))
        step = CACHED_WORDS // 2
        found = [x for k in range(0, len(parts), step) for x in self._found(parts[k : k + step])]
        done, begin = [], 0
        for text, own in zip(texts, split, strict=True):
            if own is None:
                done.append(self._encode(text).tobytes())
            else:
                # The break put before the first word is taken off again.
                done.append(b"".join(found[begin : begin + len(own)])[4:])
                begin += len(own)
        return done


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def _blocks(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in runs of about BLOCK_CHARS; no more of them are held at once."""
    block: list[str] = []
    held = 0
    for text in texts:
        block.append(text)
        held += len(text)
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: the rest first, then full ones."""
    rest = n % capacity
    pieces = [(0, rest)] if rest else []
    return pieces + [(k, capacity) for k in range(rest, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; the tokens themselves stay in the task that made them."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32())]
            + [(c, pa.int64()) for c in ("start", "length", "ids_crc32")]
        )
        for batch in batches:
            rows = []
            texts = (t.as_py() or "" for t in batch.column(1))
            ids = (i for block in _blocks(texts) for i in tokens.ids(block))
            for doc_id, row, own in zip(batch.column(0), batch.column(2), ids, strict=True):
                own += end
                rows += [
                    (doc_id.as_py(), row.as_py(), k, a, n, zlib.crc32(own[4 * a : 4 * (a + n)]))
                    for k, (a, n) in enumerate(cut(len(own) // 4, capacity))
                ]
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    rows = id_and_text(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, PIECE_SCHEMA)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Rows of PLAN_SCHEMA for so many pieces of each length.

    The ``k``-th piece of a row's range goes to sequence ``first_sequence + k // repeat``,
    at ``first_offset + length * (k % repeat)``.
    """
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, ...]] = []
    gaps: dict[int, list[list[int]]] = {}  # gap -> runs of [first sequence, how many]
    sequences = 0

    def place(length: int, many: int, sequence: int, offset: int, repeat: int) -> None:
        rows.append(
            (length, used[length], used[length] + many - 1, sequence, offset, repeat)
        )
        used[length] += many
        left[length] -= many

    def opened(many: int) -> int:
        nonlocal sequences
        sequences += many
        return sequences - many

    def leave(gap: int, sequence: int, many: int) -> None:
        if gap and many:
            gaps.setdefault(gap, []).append([sequence, many])

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= n and m <= capacity - n and left[m] > (m == n)), None)
            if mate is None:
                many = left[n]
                first = opened(many)
                place(n, many, first, 0, 1)
                leave(capacity - n, first, many)
            elif mate == n:
                many = left[n] // 2
                first = opened(many)
                place(n, 2 * many, first, 0, 2)
                leave(capacity - 2 * n, first, many)
            else:
                many = min(left[n], left[mate])
                first = opened(many)
                place(n, many, first, 0, 1)
                place(mate, many, first, n, 1)
                leave(capacity - n - mate, first, many)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = min((g for g in gaps if g >= n), default=None)
            if gap is None:
                leave(capacity, opened(many := -(-left[n] // (capacity // n))), many)
                continue
            sequence, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            fit = gap // n
            full = min(many, left[n] // fit)
            if full:
                place(n, full * fit, sequence, capacity - gap, fit)
                leave(gap - fit * n, sequence, full)
                leave(gap, sequence + full, many - full)
            else:
                some = left[n]
                place(n, some, sequence, capacity - gap, some)
                leave(gap - some * n, sequence, 1)
                leave(gap, sequence + 1, many - 1)
    return rows


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = docs.sparkSession
    own = stored(pieces(docs, tokenizer, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = plan(counts, capacity)
    slices = parts(sum(counts.values()), ROWS_A_SLICE, 64)
    ranked = numbered(own, "length", ["row", "piece"], slices)
    # At most a few ranges for each of at most ``capacity`` lengths.
    ranges = (
        spark.createDataFrame(placed, PLAN_SCHEMA)
        .groupBy("length")
        .agg(F.array_sort(F.collect_list(F.struct(
            "first_rank", "last_rank", "first_sequence", "first_offset", "repeat"
        ))).alias("ranges"))
    )
    at = F.filter("ranges", lambda r: (r["first_rank"] <= F.col("rank")) & (F.col("rank") <= r["last_rank"]))[0]
    found = ranked.join(F.broadcast(ranges), "length").withColumn("at", at)
    return found.selectExpr(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        "at.first_sequence + (rank - at.first_rank) div at.repeat AS sequence_id",
        "at.first_offset + length * ((rank - at.first_rank) % at.repeat) AS offset",
    )
