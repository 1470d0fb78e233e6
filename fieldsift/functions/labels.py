"""Labelled values with continuation lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldsift.functions.text import (
    DIGIT,
    INLINE_SPACE,
    LOWER,
    SPACE,
    WORD,
    alternation,
    collapse,
    let,
    none_if_empty,
    split_lines,
    strip_punct,
)

# Any "name: value" line, whatever the name.
ANY_LABEL = rf"^[{SPACE}]*[{WORD} /().\-]{{1,40}}[{SPACE}]*[:\-][{SPACE}]*[^{SPACE}]"
CONTINUATION_START = rf"^[{LOWER}{DIGIT}(/+]"


def label_pattern(labels: tuple[str, ...]) -> str:
    return rf"(?iu)^(?:{alternation(labels)})[{SPACE}]*[:\-][{SPACE}]*(.+)$"


def _label_anywhere(labels: tuple[str, ...]) -> str:
    """The same test over a whole normalised text, one line at a time."""
    return rf"(?iumd)^(?:{alternation(labels)})[{INLINE_SPACE}]*[:\-][{INLINE_SPACE}]*."


def has_label(normalized: Column, labels: tuple[str, ...]) -> Column:
    return F.rlike(normalized, F.lit(_label_anywhere(labels)))


def first_label_line(lines: Column, labels: tuple[str, ...]) -> Column:
    """1-based number of the first labelled line, 0 if there is none."""
    pattern = F.lit(label_pattern(labels))
    return F.array_position(F.transform(lines, lambda x: F.rlike(x, pattern)), F.lit(True))


def _ends_value(line: Column, labels: tuple[str, ...]) -> Column:
    return (
        ~F.rlike(line, F.lit(CONTINUATION_START))
        | F.rlike(line, F.lit(ANY_LABEL))
        | F.rlike(line, F.lit(label_pattern(labels)))
    )


def _continuations(rest: Column, labels: tuple[str, ...]) -> Column:
    stop = F.array_position(F.transform(rest, lambda x: _ends_value(x, labels)), F.lit(True))
    return let(
        stop.cast("int"),
        lambda s: F.when(s == 0, rest).otherwise(F.slice(rest, F.lit(1), s - 1)),
    )


def _value_at(lines: Column, position: Column, labels: tuple[str, ...]) -> Column:
    head = F.regexp_extract(F.get(lines, position - 1), label_pattern(labels), 1)
    tail = let(
        F.slice(lines, position + 1, F.size(lines)), lambda rest: _continuations(rest, labels)
    )
    joined = F.array_join(F.concat(F.array(head), tail), " ")
    return none_if_empty(strip_punct(collapse(joined)))


def labeled_value(normalized: Column, labels: tuple[str, ...]) -> Column:
    """Value of the first labelled line and the lines that continue it.

    The first labelled line decides: when its value trims to nothing the result
    is null, whatever comes later.  Texts without the label skip the line work.
    """
    found = let(
        split_lines(normalized),
        lambda lines: let(
            first_label_line(lines, labels).cast("int"),
            lambda p: F.when(p > 0, _value_at(lines, p, labels)),
        ),
    )
    return F.when(has_label(normalized, labels), found)
