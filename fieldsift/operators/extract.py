"""Field extraction over a document table.

Everything happens inside the document's own row, so a corpus of any size is one
scan-and-project stage without a shuffle.  Each ``withColumns`` below is one step
of the cascade; a later step is guarded by the result of the earlier ones, so a
labelled document never pays for ranking.  A line is carried as a struct
``(line, low)`` to lower each text once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift import schemas
from fieldsift.functions import scoring
from fieldsift.functions.declaration import declaration_identifier
from fieldsift.functions.labels import labeled_value
from fieldsift.functions.normalize import normalize_text
from fieldsift.functions.remembered import remembered
from fieldsift.functions.sections import section_body, section_title
from fieldsift.functions.text import (
    collapse,
    has_word,
    let,
    none_if_empty,
    split_lines,
    strip,
    strip_punct,
)
from fieldsift.operators.barrier import evaluate_once
from fieldsift.operators.diagnostics import event_list, warning_list
from fieldsift.operators.gate import DEFAULT_MIN_CHARS, text_gate
from fieldsift.vocab import DEFAULT_VOCABULARY, Vocabulary

RAW_TEXT_CHARS = 280
EXTRACTED = (
    "status", "error", "n_chars", "raw_text", "material_type", "description", "attachments"
)
DIAGNOSED = ("events", "warnings")


def line_rows(normalized: Column, lowered: Column, vocab: Vocabulary) -> Column:
    """Properties of the meaningful lines, in document order."""
    rows = F.zip_with(
        split_lines(normalized),
        split_lines(lowered),
        lambda line, low: F.when(has_word(line), scoring.line_properties(line, low, vocab)),
    )
    return F.array_compact(rows)


def best_candidate(candidates: Column) -> Column:
    """Highest material score, the earlier line wins a tie."""
    scored = F.transform(
        candidates,
        lambda row, i: F.struct(
            scoring.material_row_score(row).alias("score"),
            (-i).alias("order"),
            row["line"].alias("line"),
        ),
    )
    return F.array_max(scored)


def score_descriptions(rows: Column, material_type: Column, vocab: Vocabulary) -> Column:
    """T16 for every line, as ``array<struct<score, order, line>>``."""
    return let(
        F.lower(material_type),
        lambda material_low: F.transform(
            rows,
            lambda row, i: F.struct(
                scoring.description_row_score(row, material_low, vocab).alias("score"),
                (-i).alias("order"),
                row["line"].alias("line"),
            ),
        ),
    )


def ranked_description(scored: Column) -> Column:
    """R2: best line above zero, and the next line if it scores well itself."""

    def text(best: Column) -> Column:
        following = F.get(scored, F.lit(1) - best["order"])
        extra = F.when(
            following["score"] >= scoring.NEXT_LINE_MIN_SCORE, strip_punct(following["line"])
        )
        joined = F.concat_ws(" ", strip_punct(best["line"]), extra)
        return F.when(best["score"] > 0, strip_punct(collapse(joined)))

    return let(F.array_max(scored), text)


def viable_lines(scored: Column) -> Column:
    """A3: how many lines score above zero."""
    return F.size(F.filter(scored, lambda row: row["score"] > 0))


@remembered
def _ranking_columns(normalized: str, vocab: Vocabulary) -> tuple[Column, Column]:
    rows = line_rows(F.col(normalized), F.lower(normalized), vocab)
    candidates = F.filter(F.col("_rows"), lambda row: scoring.candidate_row(row, vocab))
    return rows, candidates


def rank_material_lines(
    docs: DataFrame,
    *keys: str,
    normalized: str = "raw_text",
    vocab: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """R1/A4 inside the document's row: no shuffle, null where there is no candidate."""
    rows, candidates = _ranking_columns(normalized, vocab)
    found = docs.select(*keys, rows.alias("_rows")).select(*keys, candidates.alias("_candidates"))
    best = found.select(
        *keys,
        F.size("_candidates").alias("candidates"),
        best_candidate(F.col("_candidates")).alias("_best"),
    )
    return best.select(
        *keys,
        "candidates",
        F.col("_best.score").alias("score"),
        F.col("_best.line").alias("line"),
    )


def rank_description_lines(
    docs: DataFrame,
    *keys: str,
    normalized: str = "raw_text",
    material_type: str = "material_type",
    vocab: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """R2/A3 inside the document's row, null where no line is viable."""
    rows, _ = _ranking_columns(normalized, vocab)
    scored = docs.select(*keys, material_type, rows.alias("_rows")).select(
        *keys,
        score_descriptions(F.col("_rows"), F.col(material_type), vocab).alias("_scored"),
    )
    return scored.select(
        *keys,
        viable_lines(F.col("_scored")).alias("viable_lines"),
        F.array_max("_scored")["score"].alias("score"),
        ranked_description(F.col("_scored")).alias("description"),
    )


def raw_text_description(normalized: Column, vocab: Vocabulary) -> Column:
    """Last resort: the beginning of the text, or a placeholder for an empty one."""
    head = F.substring(strip(collapse(normalized)), 1, RAW_TEXT_CHARS)
    return F.coalesce(none_if_empty(head), F.lit(vocab.description_placeholder))


def missing_fields(material_type: Column) -> Column:
    """Names of required fields without a value."""
    return F.array_compact(
        F.array(F.when(F.coalesce(material_type, F.lit("")) == "", F.lit("material_type")))
    )


def missing_fields_error(missing: Column) -> Column:
    """P5: message naming the missing fields."""
    return F.when(
        F.size(missing) > 0,
        F.concat(F.lit("Missing required fields: "), F.array_join(missing, ", ")),
    )


@remembered
def cascade(
    vocab: Vocabulary = DEFAULT_VOCABULARY, described: bool = True
) -> tuple[dict[str, Column], ...]:
    """The columns each step adds to gated documents, in order.

    The expressions only name columns, so one set per vocabulary serves every plan.
    Without ``described`` lines are only looked at where the material type needs them.
    """
    raw, low = F.col("raw_text"), F.col("_low")
    label_material, section_material = F.col("_label_material"), F.col("_section_material")
    label_text, section_text = F.col("_label_description"), F.col("_section_description")
    rows, declared, material = F.col("_rows"), F.col("_declared"), F.col("material_type")
    passed, has_material = F.col("gate_passed"), material.isNotNull()
    needs_material = label_material.isNull() & section_material.isNull()
    needs_description = label_text.isNull() & section_text.isNull()
    needs_rows = needs_material | needs_description if described else needs_material
    labels = {
        "_label_material": labeled_value(raw, vocab.material_labels),
        "_section_material": section_title(raw, low, vocab),
    }
    verdict = {
        "status": F.when(~passed, F.lit(schemas.NON_TEXT))
        .when(has_material, F.lit(schemas.OK))
        .otherwise(F.lit(schemas.PARSE_ERROR)),
        "error": F.when(~passed, F.col("gate_error")).otherwise(
            missing_fields_error(missing_fields(material))
        ),
    }
    if described:
        labels |= {
            "_label_description": labeled_value(raw, vocab.description_labels),
            "_section_description": section_body(raw, low, vocab),
        }
    until_material = (
        {"raw_text": F.when(passed, normalize_text(F.col("gate_text"), vocab))},
        {"_low": F.lower(raw)},
        labels,
        {"_rows": F.when(needs_rows, line_rows(raw, low, vocab))},
        {
            "_candidates": F.when(
                needs_material, F.filter(rows, lambda row: scoring.candidate_row(row, vocab))
            ),
            "_declared": F.when(needs_material, declaration_identifier(rows, vocab)),
        },
        {"_best": F.when(declared.isNull(), best_candidate(F.col("_candidates")))},
        {
            "material_type": F.coalesce(
                label_material, section_material, declared, F.col("_best")["line"]
            )
        },
    )
    if not described:
        return (*until_material, verdict)
    description = F.coalesce(
        label_text, section_text, F.col("_ranked_description"), raw_text_description(raw, vocab)
    )
    return (
        *until_material,
        {
            "_scored": F.when(
                has_material & needs_description, score_descriptions(rows, material, vocab)
            )
        },
        {"_ranked_description": ranked_description(F.col("_scored"))},
        {"description": F.when(has_material, description), **verdict},
    )


def extraction_steps(
    docs: DataFrame,
    *,
    text: str = "text",
    min_chars: int = DEFAULT_MIN_CHARS,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
    described: bool = True,
) -> DataFrame:
    """The cascade with its intermediate results in columns prefixed by ``_``.

    Without ``described`` it ends with the status.
    """
    rows = text_gate(docs, text=text, min_chars=min_chars)
    for columns in cascade(vocab, described):
        rows = rows.withColumns(columns)
    return rows


def material_step() -> Column:
    """Which step of the cascade gave the material type."""
    return (
        F.when(F.col("_label_material").isNotNull(), "label")
        .when(F.col("_section_material").isNotNull(), "section")
        .when(F.col("_declared").isNotNull(), "declaration")
        .when(F.col("_best").isNotNull(), "ranked")
    )


def description_step() -> Column:
    """Which step gave the description."""
    return F.when(
        F.col("material_type").isNotNull(),
        F.when(F.col("_label_description").isNotNull(), "label")
        .when(F.col("_section_description").isNotNull(), "section")
        .when(F.col("_ranked_description").isNotNull(), "ranked")
        .when(F.col("raw_text") == "", "placeholder")
        .otherwise("raw_text"),
    )


def extract_fields(
    docs: DataFrame,
    *,
    text: str = "text",
    source_path: str = "source_path",
    min_chars: int = DEFAULT_MIN_CHARS,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
    diagnostics: bool = False,
    keep: tuple[str, ...] = (),
    columns: tuple[str, ...] | None = None,
) -> DataFrame:
    """One output row per document with status, error and the fields.

    ``keep`` names further input columns to carry along.  With ``diagnostics`` the
    row also holds ``events`` and ``warnings``.  ``columns`` picks from all of them, and
    what it leaves out is not computed.
    """
    if columns is None:
        columns = (*EXTRACTED, *DIAGNOSED) if diagnostics else EXTRACTED
    steps = extraction_steps(
        docs,
        text=text,
        min_chars=min_chars,
        vocab=vocab,
        described="description" in columns or "events" in columns,
    )
    built = {
        "n_chars": lambda: F.col("gate_chars"),
        "attachments": lambda: F.array().cast("array<string>"),
        "events": event_list,
        "warnings": warning_list,
    }
    rows = steps.select(
        *keep,
        F.col(source_path).alias("source_path"),
        *[(built[name]() if name in built else F.col(name)).alias(name) for name in columns],
    )
    return evaluate_once(rows, *keep, "source_path")
