"""Repair of text that was decoded with the wrong code page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldsift.functions.text import contains_any, let, literal_list
from fieldsift.vocab import DEFAULT_VOCABULARY, Vocabulary

# The printable characters windows-1252 puts into 0x80-0x9F, and
# the code points those bytes have in latin-1.  Derived from the codec itself.
CP1252_BYTES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
CP1252_SPECIALS = bytes(CP1252_BYTES).decode("cp1252")
CP1252_AS_LATIN1 = "".join(map(chr, CP1252_BYTES))


def _shortest_markers(vocab: Vocabulary) -> list[str]:
    """Markers that contain no other marker: if none occurs, no marker occurs."""
    return [
        m
        for m in vocab.damage_markers
        if not any(other != m and other in m for other in vocab.damage_markers)
    ]


def has_damage(text: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    return contains_any(text, _shortest_markers(vocab))


def _occurrences(text: Column, literal: Column) -> Column:
    removed = F.length(text) - F.length(F.replace(text, literal, F.lit("")))
    return (removed / F.length(literal)).cast("int")


def damage_score(text: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """A5: occurrences of every marker, overlapping markers counted separately."""
    return F.reduce(
        literal_list(vocab.damage_markers),
        F.lit(0),
        lambda total, marker: total + _occurrences(text, marker),
    )


def replace_broken(text: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """Ordered literal replacement of known broken sequences."""
    return F.reduce(
        literal_list(f"{broken}\t{fixed}" for broken, fixed in vocab.broken_sequences),
        text,
        lambda acc, pair: F.replace(
            acc, F.substring_index(pair, "\t", 1), F.substring_index(pair, "\t", -1)
        ),
    )


def _decode_bytes(byte_text: Column) -> Column:
    """Strict UTF-8 reading of a text whose characters are bytes; null if invalid."""
    return F.try_validate_utf8(F.encode(byte_text, "ISO-8859-1").cast("string"))


# A byte from 0xC0 up opens a UTF-8 sequence, so an ASCII byte or the end cannot follow.
_BROKEN_LEAD = r"[\x{c0}-\x{ff}](?:[\x00-\x7f]|\z)"


def _as_cp1252_bytes(text: Column) -> Column:
    mapped = F.translate(text, CP1252_SPECIALS, CP1252_AS_LATIN1)
    # The five bytes without a character, and C1 controls in general, do not encode.
    return F.when(
        ~F.rlike(text, F.lit(r"[\x{80}-\x{9f}]")) & ~F.rlike(mapped, F.lit(r"[^\x{00}-\x{ff}]")),
        mapped,
    )


def _as_latin1_bytes(text: Column) -> Column:
    return F.when(~F.rlike(text, F.lit(r"[^\x{00}-\x{ff}]")), text)


def redecode(text: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """T4: read the whole text as bytes of a western code page and decode as UTF-8.

    The result counts only if it has fewer damage markers; windows-1252 is tried
    before latin-1, and a text that cannot be read either way stays as it is.
    """

    def first_better(score: Column) -> Column:
        def better(candidate: Column) -> Column:
            return let(candidate, lambda c: F.when(damage_score(c, vocab) < score, c))

        return F.coalesce(
            better(_decode_bytes(_as_cp1252_bytes(text))),
            better(_decode_bytes(_as_latin1_bytes(text))),
            text,
        )

    # Ordinary western text fails the lead-byte test at its first accented letter.
    readable = has_damage(text, vocab) & ~F.rlike(text, F.lit(_BROKEN_LEAD))
    return F.when(readable, let(damage_score(text, vocab), first_better)).otherwise(text)


def may_need_repair(text: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """False only for texts that both repair steps leave alone; one scan.

    Broken sequences and decodable damage start with a marker's first letter and go
    on with a character beyond ASCII, which sets them apart from a plain capital
    such as the first letter of a German word.
    """
    leads = {m[0] for m in vocab.damage_markers}
    sequences = [broken for broken, _ in vocab.broken_sequences]
    recognisable = all("\xc0" <= c <= "\xff" for c in leads) and all(
        b[0] in leads and not b[1:2].isascii() for b in sequences
    )
    if not recognisable:
        return F.lit(True)
    return F.rlike(text, F.lit(f"[{''.join(sorted(leads))}][^\\x00-\\x7f]"))


def repair(text: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """T3 then T4; undamaged text costs only one scan."""
    repaired = let(replace_broken(text, vocab), lambda t: redecode(t, vocab))
    return F.when(may_need_repair(text, vocab), repaired).otherwise(text)
