"""Line predicates and scores.

Both scores are weighted sums over the same properties of a line, so the
properties are computed once per line, as a struct, and the scores only add.
Word counts are bounded tests: no more words are read than the weights need.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldsift.functions.text import LOWER, WORD, alternation, contains_any, has_word, let
from fieldsift.vocab import DEFAULT_VOCABULARY, Vocabulary

NEXT_LINE_MIN_SCORE = 9
NO_WORDS_SCORE = -20


def is_product_code(line: Column) -> Column:
    """One token of capitals, digits and ./+- with at most 24 characters."""
    return F.rlike(line, F.lit(r"^[A-Z0-9][A-Z0-9./+\-]{0,23}\z"))


def has_excluded_prefix(low: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """The line starts with an excluded label that ends at a word border."""
    if isinstance(vocab.excluded_prefixes, Column):

        def ends_at_border(prefix: Column) -> Column:
            following = F.substring(low, F.length(prefix) + 1, F.lit(1))
            return F.startswith(low, prefix) & ~has_word(following)

        return F.exists(vocab.excluded_prefixes, ends_at_border)
    return F.rlike(low, F.lit(rf"^(?:{alternation(vocab.excluded_prefixes)})(?:\z|[^{WORD}])"))


def is_excluded_header(low: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    if isinstance(vocab.excluded_headers, Column):
        return F.array_contains(vocab.excluded_headers, low)
    return low.isin(*vocab.excluded_headers)


def is_candidate(low: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """The line may be a material type."""
    return (
        (low != "") & ~is_excluded_header(low, vocab) & ~has_excluded_prefix(low, vocab)
    )


def word_count_class(low: Column) -> Column:
    """Number of words, counted up to five."""
    words = F.regexp_extract(low, rf"^(?:[^{WORD}]*+[{WORD}]++){{0,5}}", 0)
    return F.regexp_count(words, F.lit(rf"[{WORD}]++"))


def line_properties(line: Column, low: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """What the scores look at, as one struct per line."""
    has_lower = F.rlike(line, F.lit(f"[{LOWER}]"))
    is_upper = ~F.rlike(line, F.lit(rf"[{LOWER}\p{{Lt}}]")) & F.rlike(
        line, F.lit(r"\p{IsUppercase}")
    )
    return F.struct(
        line.alias("line"),
        low.alias("low"),
        F.length(line).alias("chars"),
        word_count_class(low).alias("words"),
        is_product_code(line).alias("is_code"),
        has_excluded_prefix(low, vocab).alias("has_prefix"),
        has_lower.alias("has_lower"),
        is_upper.alias("is_upper"),
        contains_any(low, vocab.noise_phrases).alias("is_noise"),
        contains_any(low, vocab.material_keywords).alias("has_keyword"),
    )


def candidate_row(row: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """P3 on a properties struct."""
    return ~row["has_prefix"] & ~is_excluded_header(row["low"], vocab)


def _weigh(*terms: tuple[Column, int]) -> Column:
    return reduce(add, [F.when(cond, F.lit(weight)).otherwise(F.lit(0)) for cond, weight in terms])


def _widened(known: Column, base: tuple[str, ...], full: tuple[str, ...], low: Column) -> Column:
    """Does ``low`` hold a word of ``full``, given the answer for ``base``?"""
    if isinstance(full, Column) or isinstance(base, Column) or not set(base) <= set(full):
        return contains_any(low, full)
    extra = [word for word in full if word not in base]
    return (known | contains_any(low, extra)) if extra else known


def material_row_score(row: Column) -> Column:
    """T15 on a properties struct."""
    return _weigh(
        (row["is_noise"], -12),
        (row["is_code"], -8),
        (row["is_upper"] & (row["words"] <= 3), -4),
        (row["chars"] < 8, -3),
        (row["words"] >= 3, 4),
        (row["chars"] >= 20, 3),
        (row["has_lower"], 2),
        (row["has_keyword"], 5),
    )


def description_row_score(
    row: Column, material_low: Column, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> Column:
    """T16 on a properties struct."""
    low = row["low"]
    is_noise = _widened(row["is_noise"], vocab.noise_phrases, vocab.description_noise, low)
    has_keyword = _widened(
        row["has_keyword"], vocab.material_keywords, vocab.description_keywords, low
    )
    same_as_material = F.coalesce((material_low != "") & (low == material_low), F.lit(False))
    score = _weigh(
        (is_noise, -12),
        (row["has_prefix"], -10),
        (row["is_code"], -10),
        (row["is_upper"] & (row["words"] <= 4), -5),
        (same_as_material, -8),
        (row["chars"] < 12, -4),
        (row["words"] >= 5, 5),
        (row["chars"] >= 35, 3),
        (row["has_lower"], 2),
        (has_keyword, 6),
    )
    return F.when(row["words"] > 0, score).otherwise(F.lit(NO_WORDS_SCORE))


def material_score(line: Column, low: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """How much a single line looks like a material type."""
    return let(line_properties(line, low, vocab), material_row_score)


def description_score(
    line: Column, low: Column, material_low: Column, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> Column:
    """How much a single line looks like a description of the material."""
    return let(
        line_properties(line, low, vocab),
        lambda row: description_row_score(row, material_low, vocab),
    )
