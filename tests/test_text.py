"""Text primitives against Python's own string methods on random texts."""

import random
import re

import pytest

from fieldsift.functions import paths
from fieldsift.functions.normalize import normalize_text
from fieldsift.functions.text import (
    collapse,
    drop_invisible,
    has_word,
    join_stripped_lines,
    preview,
    python_repr,
    strip,
    unify_breaks,
)

ALPHABET = (
    list("ab Łż²_-.'\"\\$é1\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\x00\xad")
    + ["\r\n", "\u1680", "\u2003", "\u2009", "\u200a", "\u2028", "\u2029", "\u202f", "\u205f"]
    + ["\u3000", "\u200b", "\ufeff", "\U0001f600"]
)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    made = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(600)]
    return made + ["", "\u2003 ", "\n\n", "x" * 100, "word " * 30]


def test_strip(column, texts):
    assert column(texts, strip) == [t.strip() for t in texts]


def test_collapse(column, texts):
    assert column(texts, collapse) == [re.sub(r"\s+", " ", t) for t in texts]


def test_break_and_invisible_characters(column, texts):
    assert column(texts, unify_breaks) == [re.sub("\r\n?", "\n", t) for t in texts]
    assert column(texts, drop_invisible) == [
        t.replace("\ufeff", "").replace("\xa0", " ") for t in texts
    ]


def stripped_lines(text):
    return [line.strip() for line in text.splitlines() if line.strip()]


def test_stripped_lines(column, texts):
    texts = [t.replace("\r", "\n") for t in texts]
    assert column(texts, join_stripped_lines) == ["\n".join(stripped_lines(t)) for t in texts]


def test_normalize_without_damage(column, texts):
    cleaned = [t.replace("\ufeff", "").replace("\xa0", " ") for t in texts]
    assert column(texts, normalize_text) == ["\n".join(stripped_lines(t)) for t in cleaned]


def test_has_word(column, texts):
    assert column(texts, has_word) == [bool(re.search(r"\w", t)) for t in texts]


@pytest.mark.parametrize("limit", [80, 40])
def test_preview(column, texts, limit):
    def expected(text):
        flat = " ".join(text.split())
        return flat if len(flat) <= limit else flat[: limit - 3] + "..."

    exact = texts + ["y" * limit, "y" * (limit + 1), "😀" * (limit + 5)]
    assert column(exact, lambda x: preview(x, limit)) == [expected(t) for t in exact]
    assert column([None], preview) == [None]


def test_python_repr(column, texts):
    assert column(texts, python_repr) == [repr(t) for t in texts]


PATHS = [
    "docs/input.pdf", "input.pdf", "a.b/c", "a/b.c.PDF", "dir/.hidden", "/root.pdf", "/x/y",
    "no_suffix", "a/b..pdf",
]


def test_paths(column):
    assert column(PATHS, lambda p: paths.with_suffix(p, ".docx")) == [
        "docs/input.docx", "input.docx", "a.b/c.docx", "a/b.c.docx", "dir/.hidden.docx",
        "/root.docx", "/x/y.docx", "no_suffix.docx", "a/b..docx",
    ]
    assert column(PATHS, paths.suffix) == [
        ".pdf", ".pdf", "", ".pdf", "", ".pdf", "", "", ".pdf"
    ]
    assert column(PATHS, paths.stem) == [
        "input", "input", "c", "b.c", ".hidden", "root", "y", "no_suffix", "b."
    ]
    assert column(PATHS, paths.parent) == [
        "docs", ".", "a.b", "a", "dir", "/", "/x", ".", "a"
    ]
    assert column(["in/scan.pdf", "scan.pdf"], paths.dump_path) == [
        "in/scan_extracted.txt", "scan_extracted.txt"
    ]
