"""Text primitives as native Column expressions.

Whitespace, word characters and line breaks follow Unicode rules, which differ
from the ASCII defaults of Java's ``\\s``/``\\w`` and from ``trim`` (U+0020 only),
so the classes are spelled out once here and used everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bodies of regex character classes; the \x{..} spelling is shared by Java and RE2.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Line breaks besides LF.
OTHER_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
INLINE_SPACE = r"\t\x1f\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
LOWER = r"\p{IsLowercase}"
# Decimal digits plus the superscript, subscript and enclosed forms that count as digits.
DIGIT = (
    r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}"
    r"\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
)
# Every character of SPACE, for btrim.
SPACE_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]
        + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
PUNCT_CHARS = " .;:-"
# Up to this many literals are written out as an OR, longer lists are searched in a loop.
SHORT_LIST = 4

# A run of whitespace that is not already one plain space.
_LOOSE_SPACE = rf"\x20[{SPACE}]++|[\t-\r\x1c-\x1f\x{{85}}-\x{{3000}}&&[{SPACE}]][{SPACE}]*+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def literal_list(items: Iterable[str]) -> Column:
    """Constant array of strings; one literal to build, folded by the optimizer."""
    return F.split(F.lit("\n".join(items)), "\n")


def contains_any(text: Column, needles: Sequence[str] | Column) -> Column:
    """True when one of the literals, or of the strings of an array column, occurs.

    A byte search, no regex.
    """
    if isinstance(needles, Column):
        return F.exists(needles, lambda needle: F.contains(text, needle))
    if len(needles) <= SHORT_LIST:
        return any_of([F.contains(text, F.lit(n)) for n in needles])
    return F.exists(literal_list(needles), lambda needle: F.contains(text, needle))


def alternation(literals: Iterable[str]) -> str:
    """Regex alternation of quoted literals, in the given order."""
    return "|".join(re.sub(r"([!-/:-@\[-^`{-~])", r"\\\1", item) for item in literals)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def strip_punct(text: Column) -> Column:
    return F.btrim(text, F.lit(PUNCT_CHARS))


def collapse(text: Column) -> Column:
    """Each run of whitespace becomes one space."""
    return F.regexp_replace(text, _LOOSE_SPACE, " ")


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def unify_breaks(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def drop_invisible(text: Column) -> Column:
    """Byte-order marks vanish, no-break spaces become spaces."""
    return F.replace(F.replace(text, F.lit("\ufeff"), F.lit("")), F.lit("\xa0"), F.lit(" "))


def plain_stripped_lines(text: Column) -> Column:
    """Stripped non-blank lines of a text whose only line break is LF."""
    return F.filter(F.transform(split_lines(text), strip), lambda line: line != "")


def stripped_lines(text: Column) -> Column:
    """Stripped non-blank lines, split at every kind of line break.

    Literal replacement, the one-character split and btrim are byte searches; a
    regex over the Unicode whitespace classes costs several times as much.
    """
    unified = F.reduce(
        literal_list(OTHER_BREAKS), text, lambda acc, char: F.replace(acc, char, F.lit("\n"))
    )
    return plain_stripped_lines(unified)


def join_stripped_lines(text: Column) -> Column:
    """T5, last part: stripped non-blank lines joined by LF."""
    return F.array_join(stripped_lines(text), "\n")


def split_lines(normalized: Column) -> Column:
    return F.split(normalized, "\n")


def has_word(line: Column) -> Column:
    return F.rlike(line, F.lit(f"[{WORD}]"))


def meaningful_lines(normalized: Column) -> Column:
    """The lines that hold at least one word character."""
    return F.filter(split_lines(normalized), has_word)


def preview(value: Column, limit: int = 80) -> Column:
    """Collapsed value, cut to ``limit`` characters with an ellipsis."""
    return F.regexp_replace(
        strip(collapse(value)), rf"(?s)^(.{{{limit - 3}}}).{{4,}}$", "$1..."
    )


_UNPRINTABLE = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}&&[^\x20]]"


def _escape_char(char: Column) -> Column:
    code = F.ascii(char)
    digits = F.lower(F.hex(code))
    return (
        F.when(~F.rlike(char, F.lit(_UNPRINTABLE)), char)
        .when(char == "\t", F.lit("\\t"))
        .when(char == "\n", F.lit("\\n"))
        .when(char == "\r", F.lit("\\r"))
        .when(code < 0x100, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
        .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
    )


def python_repr(value: Column) -> Column:
    """Quoted form of a string: single quotes unless only ``'`` occurs inside."""
    doubled = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    visible = F.when(
        F.rlike(doubled, F.lit(_UNPRINTABLE)),
        F.array_join(F.transform(F.split(doubled, ""), _escape_char), ""),
    ).otherwise(doubled)
    has_single = F.contains(value, F.lit("'"))
    has_double = F.contains(value, F.lit('"'))
    return (
        F.when(has_single & ~has_double, F.concat(F.lit('"'), visible, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(visible, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )
