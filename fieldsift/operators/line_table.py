"""Line-table forms: one row per meaningful line.

For work whose output is lines, or statistics over them.  Ranking is a hash aggregate
over score and line number packed into one long, combined map-side, so neither a sort, a
window nor a group collected into one task is needed, however many lines one document has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift.functions import scoring
from fieldsift.functions.remembered import remembered
from fieldsift.functions.text import collapse, meaningful_lines, strip_punct
from fieldsift.operators.extract import line_rows
from fieldsift.vocab import DEFAULT_VOCABULARY, Vocabulary


def line_table(docs: DataFrame, *keys: str, normalized: str = "raw_text") -> DataFrame:
    """``keys, line_no (from 1), line`` for every meaningful line."""
    lines = docs.select(
        *keys, F.posexplode(meaningful_lines(F.col(normalized))).alias("_pos", "line")
    )
    return lines.select(*keys, (F.col("_pos") + 1).alias("line_no"), "line")


@remembered
def _property_rows(normalized: str, vocab: Vocabulary) -> Column:
    return line_rows(F.col(normalized), F.lower(normalized), vocab)


def line_property_table(
    docs: DataFrame,
    *keys: str,
    normalized: str = "raw_text",
    vocab: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """``keys, line_no, row, next_row``: the scored properties of each line.

    Properties are computed before the lines are spread out, once per line; the
    following line travels along, so no ordering is needed afterwards.
    """
    rows = docs.select(*keys, _property_rows(normalized, vocab).alias("_rows"))
    pairs = F.transform(
        F.col("_rows"),
        lambda row, i: F.struct(
            row.alias("row"), F.get(F.col("_rows"), i + 1).alias("next_row")
        ),
    )
    return rows.select(*keys, F.posexplode(pairs).alias("_pos", "_pair")).select(
        *keys, (F.col("_pos") + 1).alias("line_no"), "_pair.row", "_pair.next_row"
    )


def material_line_scores(lines: DataFrame, *keys: str) -> DataFrame:
    """T15 for every line of a property table."""
    return lines.select(
        *keys, "line_no", scoring.material_row_score(F.col("row")).alias("score")
    )


def description_line_scores(
    lines: DataFrame,
    *keys: str,
    material_type: str = "material_type",
    vocab: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """T16 for every line of a property table that carries the material type."""
    score = scoring.description_row_score(F.col("row"), F.lower(material_type), vocab)
    return lines.select(*keys, "line_no", score.alias("score"))


def _packed(score: Column, line_no: Column) -> Column:
    """Score and line number as one long; the largest has the best score, the first line."""
    return F.shiftleft(score.cast("long"), 32) - line_no


def _unpacked(packed: Column) -> tuple[Column, Column]:
    line_no = F.pmod(-packed, F.lit(1 << 32))
    return F.shiftright(packed + line_no, 32).cast("int"), line_no.cast("int")


def _at_best(docs: DataFrame, best: DataFrame, keys: tuple[str, ...], *columns: str) -> DataFrame:
    """The documents' ``columns`` beside their row of ``best``, one row per key.

    Hashed, not sorted: a partition of ``best`` holds a few numbers per document.
    """
    named = best.select(*[F.col(k).alias(f"_best_{k}") for k in keys], *best.drop(*keys).columns)
    same = [docs[k].eqNullSafe(named[f"_best_{k}"]) for k in keys]
    joined = docs.select(*keys, *columns).join(named.hint("shuffle_hash"), same)
    return joined.drop(*[f"_best_{k}" for k in keys])


def top_material_lines(
    docs: DataFrame,
    *keys: str,
    normalized: str = "raw_text",
    vocab: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Best candidate line per document and the number of candidates.

    The aggregate only carries numbers; the line is fetched from its document by position.
    """
    lines = line_property_table(docs, *keys, normalized=normalized, vocab=vocab)
    scored = lines.where(scoring.candidate_row(F.col("row"), vocab)).select(
        *keys,
        _packed(scoring.material_row_score(F.col("row")), F.col("line_no")).alias("_packed"),
    )
    best = scored.groupBy(*keys).agg(
        F.max("_packed").alias("_packed"), F.count(F.lit(1)).alias("candidates")
    )
    score, line_no = _unpacked(F.col("_packed"))
    return _at_best(docs, best, keys, normalized).select(
        *keys,
        "candidates",
        score.alias("score"),
        line_no.alias("line_no"),
        F.get(meaningful_lines(F.col(normalized)), line_no - 1).alias("line"),
    )


def top_description_lines(
    docs: DataFrame,
    *keys: str,
    normalized: str = "raw_text",
    material_type: str = "material_type",
    vocab: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """R2/A3: best line above zero, its follower if good enough, and how many are viable.

    The aggregate only carries numbers; both lines are fetched from their document by
    position, and the follower is scored there.
    """
    lines = line_property_table(docs, *keys, material_type, normalized=normalized, vocab=vocab)
    scored = description_line_scores(lines, *keys, material_type=material_type, vocab=vocab)
    best = (
        scored.select(*keys, "score", _packed(F.col("score"), F.col("line_no")).alias("_packed"))
        .groupBy(*keys)
        .agg(F.max("_packed").alias("_packed"), F.count_if(F.col("score") > 0).alias("viable_lines"))
        .where(F.col("viable_lines") > 0)
    )
    score, line_no = _unpacked(F.col("_packed"))
    found = _at_best(docs, best, keys, normalized, material_type).select(
        *keys,
        "viable_lines",
        material_type,
        score.alias("score"),
        line_no.alias("line_no"),
        # The line and the one behind it.
        F.slice(meaningful_lines(F.col(normalized)), line_no, 2).alias("_lines"),
    )
    following = F.get("_lines", F.lit(1))
    next_score = scoring.description_score(
        following, F.lower(following), F.lower(material_type), vocab
    )
    follower = F.when(next_score >= scoring.NEXT_LINE_MIN_SCORE, strip_punct(following))
    joined = F.concat_ws(" ", strip_punct(F.get("_lines", F.lit(0))), follower)
    return found.select(
        *keys,
        "viable_lines",
        "score",
        "line_no",
        strip_punct(collapse(joined)).alias("description"),
    )
