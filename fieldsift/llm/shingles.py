"""Word and shingle hashes of many texts at once, in numpy.

A block of texts is one byte array.  Every byte is mapped to a fixed random 64-bit
number, the hash of a word is the polynomial of its bytes modulo 2**64, taken from a
running sum, and a shingle mixes the hashes of its words.  Nothing is done per word in
Python, so the cost is a few passes over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK_BYTES = 1 << 20
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ORDER_KEYS = np.random.Generator(np.random.PCG64(97)).integers(
    0, 1 << 63, 16, dtype=np.uint64
) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_numbers() -> np.ndarray:
    numbers = np.random.Generator(np.random.PCG64(11)).integers(
        1, 1 << 63, 256, dtype=np.uint64
    )
    numbers[ord("A") : ord("Z") + 1] = numbers[ord("a") : ord("z") + 1]
    return numbers


_NUMBERS = _byte_numbers()
_IS_SPACE = np.isin(np.arange(256), _SPACES)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(n - 1, 1 << 16).bit_length()
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        back = np.full(size, _BASE_INVERSE, np.uint64)
        back[0] = 1
        _powers, _inverses = np.cumprod(steps), np.cumprod(back)
    return _powers[:n], _inverses[:n]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, split at white space) and where texts begin.

    Returns ``(hashes, first)``: the words of text ``i`` are
    ``hashes[first[i]:first[i + 1]]``.
    """
    joined = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = _IS_SPACE[joined]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    powers, inverses = _power_tables(len(joined))
    sums = np.cumsum(_NUMBERS[joined] * powers)
    hashes = mix((sums[ends - 1] - sums[starts - 1]) * inverses[starts])
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, begins)


def rolled_words(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size`` words in a row within a text, and the number of the text."""
    hashes, first = words(texts)
    rolled = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for k in range(size):
        rolled += hashes[k : k + len(rolled)] * _ORDER_KEYS[k]
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    inside = owner[: len(rolled)] == owner[size - 1 :]
    return mix(rolled[inside]), owner[: len(rolled)][inside]


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer words, but at least one, has its whole sequence as its one shingle;
    a text without words has none.
    """
    hashes, first = words(texts)
    rolled = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for k in range(size):
        rolled += hashes[k : k + len(rolled)] * _ORDER_KEYS[k]
    rolled = mix(rolled)
    sets = []
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if end - begin >= size:
            sets.append(np.unique(rolled[begin : end - size + 1]))
        elif end > begin:
            whole = (hashes[begin:end] * _ORDER_KEYS[: end - begin]).sum(dtype=np.uint64)
            sets.append(mix(np.array([whole + np.uint64(end - begin)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def blocks(texts: Iterable[str | None], limit: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The texts as UTF-8, null as empty, in runs of about ``limit`` bytes."""
    block: list[bytes] = []
    held = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if block and held + len(data) > limit:
            yield block
            block, held = [], 0
        block.append(data)
        held += len(data) + 1
    if block:
        yield block
