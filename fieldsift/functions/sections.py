"""Section-based values: the title before and the body after a marker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldsift.functions.text import collapse, contains_any, let, none_if_empty, strip_punct
from fieldsift.vocab import DEFAULT_VOCABULARY, Vocabulary


def earliest(lowered: Column, markers: tuple[str, ...]) -> Column:
    """1-based position of the earliest marker, null if none occurs."""
    positions = [F.nullif(F.instr(lowered, m), F.lit(0)) for m in markers]
    return positions[0] if len(positions) == 1 else F.least(*positions)


def _cut(text: Column, stops: tuple[str, ...]) -> Column:
    """Text up to the earliest stop marker, whole text if there is none."""
    return let(
        earliest(F.lower(text), stops),
        lambda stop: F.when(stop.isNull(), text).otherwise(F.substring(text, 1, stop - 1)),
    )


def section_title(
    normalized: Column, lowered: Column, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> Column:
    """What stands before the first section marker."""

    def title(block: Column) -> Column:
        return none_if_empty(strip_punct(_cut(block, vocab.title_stops)))

    found = let(
        earliest(lowered, vocab.section_markers),
        lambda at: let(strip_punct(collapse(F.substring(normalized, 1, at - 1))), title),
    )
    return F.when(contains_any(lowered, vocab.section_markers), found)


def _first_marker_length(lowered: Column, at: Column, markers: tuple[str, ...]) -> Column:
    """Length of the marker standing at ``at``; the first listed one wins a tie."""
    length = F.lit(None).cast("int")
    for marker in reversed(markers):
        length = F.when(F.instr(lowered, marker) == at, F.lit(len(marker))).otherwise(length)
    return length


def section_body(
    normalized: Column, lowered: Column, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> Column:
    """What follows the first section marker, up to the next known section."""

    def body(at: Column) -> Column:
        start = at + _first_marker_length(lowered, at, vocab.section_markers)
        rest = F.substring(normalized, start, F.length(normalized))
        return let(
            rest,
            lambda r: none_if_empty(strip_punct(collapse(_cut(r, vocab.section_stops)))),
        )

    found = let(earliest(lowered, vocab.section_markers), body)
    return F.when(contains_any(lowered, vocab.section_markers), found)
