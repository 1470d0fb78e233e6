"""Why each value was chosen: events, warnings and their text form.

The expressions read the step columns of ``extraction_steps``, so they cost
nothing unless a query selects them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift import schemas
from fieldsift.functions.remembered import remembered
from fieldsift.functions.text import none_if_empty, preview, python_repr

CANDIDATE_CHARS = 40
CANDIDATES_SHOWN = 3

# Notes attached to events.
SECTION_NOTE = "activated only for Polish product sheets with 'Opis produktu'"
DECLARATION_NOTE = "selected declaration product identifier"
NO_CANDIDATES_NOTE = "no fallback candidates available"
FIELDS_OK_NOTE = "all required fields present"
EMPTY_TEXT_NOTE = "input text was empty after normalization"
RAW_TEXT_NOTE = "used normalized raw text"


def _event(
    field: str,
    step: str,
    status: Column | str,
    matched: Column | bool,
    value: Column | None = None,
    note: Column | str | None = None,
) -> Column:
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        F.lit(field).alias("field_name"),
        F.lit(step).alias("step_name"),
        lit(status).alias("status"),
        lit(matched).alias("matched"),
        (F.lit(None) if value is None else value).cast("string").alias("value_preview"),
        lit(note).cast("string").alias("note"),
    )


def _attempt(field: str, step: str, value: Column, note: str | None = None) -> Column:
    hit = value.isNotNull()
    status = F.when(hit, "matched").otherwise("not_matched")
    return _event(field, step, status, hit, preview(value), note)


def _candidate_preview(candidates: Column) -> Column:
    shown = F.transform(
        F.slice(candidates, 1, CANDIDATES_SHOWN),
        lambda row: preview(row["line"], CANDIDATE_CHARS),
    )
    more = F.when(F.size(candidates) > CANDIDATES_SHOWN, F.lit("; ...")).otherwise(F.lit(""))
    return none_if_empty(F.concat(F.array_join(shown, "; "), more))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


@remembered
def event_list() -> Column:
    """Events in the order the steps run; empty for documents that never ran."""
    label_m, section_m = F.col("_label_material"), F.col("_section_material")
    label_d, section_d = F.col("_label_description"), F.col("_section_description")
    candidates, declared, best = F.col("_candidates"), F.col("_declared"), F.col("_best")
    material, ranked = F.col("material_type"), F.col("_ranked_description")
    n_candidates = F.size(candidates)
    no_label_m = label_m.isNull()
    fallback_m = no_label_m & section_m.isNull()
    ok = material.isNotNull()
    no_label_d = ok & label_d.isNull()
    fallback_d = no_label_d & section_d.isNull()
    viable = F.size(F.filter(F.col("_scored"), lambda s: s["score"] > 0))
    best_description_score = F.array_max(F.col("_scored"))["score"]

    material_pick = (
        F.when(
            declared.isNotNull(),
            _event(
                "material_type", "fallback_selection", "selected", True,
                preview(declared), DECLARATION_NOTE,
            ),
        )
        .when(
            best.isNotNull(),
            _event(
                "material_type", "fallback_selection", "selected", True, preview(best["line"]),
                _text(
                    "selected highest-ranked candidate of ", n_candidates,
                    " (score ", best["score"], ")",
                ),
            ),
        )
        .otherwise(
            _event(
                "material_type", "fallback_selection", "no_candidates", False,
                note=NO_CANDIDATES_NOTE,
            )
        )
    )
    required = F.when(
        ok,
        _event("required_fields", "missing_required_fields", "ok", True, note=FIELDS_OK_NOTE),
    ).otherwise(
        _event(
            "required_fields", "missing_required_fields", "failed", False,
            note="missing required fields: material_type",
        )
    )
    description_pick = (
        F.when(
            ranked.isNotNull(),
            _event(
                "description", "fallback_selection", "selected", True, preview(ranked),
                _text(
                    "selected highest-ranked candidate(s) from ", viable,
                    " line(s) (score ", best_description_score, ")",
                ),
            ),
        )
        .when(
            F.col("raw_text") == "",
            _event(
                "description", "fallback_selection", "default_placeholder", False,
                preview(F.col("description")), EMPTY_TEXT_NOTE,
            ),
        )
        .otherwise(
            _event(
                "description", "fallback_selection", "selected", True,
                preview(F.col("description")), RAW_TEXT_NOTE,
            )
        )
    )
    events = F.array(
        _attempt("material_type", "labeled_extraction", label_m),
        F.when(
            no_label_m, _attempt("material_type", "section_extraction", section_m, SECTION_NOTE)
        ),
        F.when(
            fallback_m & (n_candidates > 0),
            _event(
                "material_type", "fallback_candidates", "found", True,
                _candidate_preview(candidates), _text(n_candidates, " candidate(s)"),
            ),
        ),
        F.when(fallback_m, material_pick),
        required,
        F.when(ok, _attempt("description", "labeled_extraction", label_d)),
        F.when(
            no_label_d, _attempt("description", "section_extraction", section_d, SECTION_NOTE)
        ),
        F.when(fallback_d, description_pick),
    )
    none = F.array().cast(schemas.EVENTS)
    return F.when(F.col("gate_passed"), F.array_compact(events).cast(schemas.EVENTS)).otherwise(
        none
    )


def warning_list() -> Column:
    """One warning for a document whose required fields are missing."""
    return F.array_compact(
        F.array(F.when(F.col("status") == schemas.PARSE_ERROR, F.col("error")))
    )


def _event_text(event: Column) -> Column:
    value = none_if_empty(event["value_preview"])
    return F.concat(
        F.lit("- "),
        F.concat_ws(
            " | ",
            F.concat(
                event["field_name"], F.lit("."), event["step_name"], F.lit(": "), event["status"]
            ),
            F.concat(F.lit("matched="), F.initcap(event["matched"].cast("string"))),
            F.concat(F.lit("value="), python_repr(value)),
            F.concat(F.lit("note="), none_if_empty(event["note"])),
        ),
    )


def diagnostics_text(events: Column, warnings: Column) -> Column:
    """The report shown to a person; null when nothing was recorded."""
    event_lines = F.when(
        F.size(events) > 0, F.transform(events, _event_text)
    ).otherwise(F.array(F.lit("- no events recorded")))
    warning_lines = F.transform(warnings, lambda w: F.concat(F.lit("- warning: "), w))
    lines = F.concat(F.array(F.lit("Parser diagnostics:")), event_lines, warning_lines)
    return F.when((F.size(events) > 0) | (F.size(warnings) > 0), F.array_join(lines, "\n"))


def explode_events(extracted: DataFrame, *keys: str) -> DataFrame:
    """C5, long form: one row per event with its position in the document."""
    rows = extracted.select(*keys, F.posexplode_outer("events").alias("event_no", "event"))
    return rows.where(F.col("event").isNotNull()).select(*keys, "event_no", "event.*")
