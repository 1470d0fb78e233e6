"""Reading and validating JSON records through VARIANT.

A bad file becomes a row with a status and a message; it never fails the job.
VARIANT keeps the JSON types, so a number is not silently read as a string.
"""

from __future__ import annotations

from threading import Lock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift import schemas
from fieldsift.functions.paths import suffix
from fieldsift.functions.remembered import remembered
from fieldsift.functions.text import let
from fieldsift.operators.barrier import evaluate_once

# Messages of the validation rules.
MISSING = "Field required"
NOT_STRING = "Input should be a valid string"
NOT_LIST = "Input should be a valid list"
NOT_OBJECT = "Input should be an object"
NOT_JSON = "Invalid JSON"
INVALID_DATA = "Invalid or incomplete input data"
CONTEXT_BAD_JSON = "Invalid JSON context file."
CONTEXT_NOT_MAPPING = "Context data must be a mapping."
CONTEXT_UNREADABLE = "Failed to load context file."
CONTEXT_UNSUPPORTED = "Unsupported context format: "
CONTEXT_NO_YAML = "PyYAML is not installed. Install the yaml extra."

FIELDS = {"context": schemas.CONTEXT_FIELDS, "material": schemas.MATERIAL_FIELDS}


def validation_message(errors: Column) -> Column:
    """C4: ``field: message`` details joined behind a fixed prefix."""
    return F.when(F.size(errors) == 0, F.lit(INVALID_DATA + ".")).otherwise(
        F.concat(F.lit(INVALID_DATA + ": "), F.array_join(errors, "; "))
    )


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _value(record: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(record, path, kind)


def _string_error(record: Column, name: str, required: bool, nullable: bool) -> Column:
    accepted = ["STRING", "VOID"] if nullable else ["STRING"]

    def error(kind: Column) -> Column:
        wrong = F.when(~kind.isin(*accepted), F.lit(f"{name}: {NOT_STRING}"))
        if not required:
            return wrong
        return F.when(kind.isNull(), F.lit(f"{name}: {MISSING}")).otherwise(wrong)

    return F.array(let(_kind(_value(record, f"$.{name}")), error))


REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"
_SETTING = Lock()


def _list_errors(record: Column, name: str) -> Column:
    items = F.transform(
        _value(record, f"$.{name}", "array<variant>"),
        lambda item, i: F.when(
            _kind(item) != "STRING",
            F.concat(F.lit(f"{name}."), i.cast("string"), F.lit(f": {NOT_STRING}")),
        ),
    )
    none = F.array().cast("array<string>")

    def errors(kind: Column) -> Column:
        no_list = F.array(F.lit(f"{name}: {NOT_LIST}"))
        return (
            F.when(kind.isNull(), none)
            .when(~F.startswith(kind, F.lit("ARRAY")), no_list)
            .otherwise(F.coalesce(items, none))
        )

    return let(_kind(_value(record, f"$.{name}")), errors)


def field_errors(record: Column, fields: dict[str, tuple[str, bool]]) -> Column:
    """``field: message`` entries in declaration order."""
    errors = [
        _list_errors(record, name)
        if kind == "strings"
        else _string_error(record, name, required, kind == "optional")
        for name, (kind, required) in fields.items()
    ]
    return F.array_compact(F.concat(*errors))


def record_struct(record: Column, fields: dict[str, tuple[str, bool]]) -> Column:
    """The validated record; unknown fields are dropped, missing lists are empty."""

    def field(name: str, kind: str) -> Column:
        if kind == "strings":
            empty = F.array().cast("array<string>")
            return F.coalesce(_value(record, f"$.{name}", "array<string>"), empty)
        return _value(record, f"$.{name}", "string")

    return F.struct(*[field(n, kind).alias(n) for n, (kind, _) in fields.items()])


@remembered
def _parsing(content: str, kind: str) -> tuple[dict[str, Column], ...]:
    """Columns that turn a JSON text into a VARIANT record and its errors."""
    fields, record = FIELDS[kind], F.col("_record")
    return (
        {"_record": parse_one_value(F.try_validate_utf8(F.col(content)))},
        {"_is_object": F.coalesce(F.startswith(_kind(record), F.lit("OBJECT")), F.lit(False))},
        {"_errors": F.when(F.col("_is_object"), field_errors(record, fields))},
    )


def parse_one_value(content: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing else, else null.

    The parser stops behind the first value, so a text with more behind it, or with
    brackets of its own, has to be JSON within an array and within an object as well.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), content, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), content, F.lit("}")))
    return F.when(in_array.isNotNull() & in_object.isNotNull(), F.try_parse_json(content))


def _parsed(files: DataFrame, content: str, kind: str) -> DataFrame:
    """Parse with the last of repeated keys, whatever the session's setting.

    The setting is read when the expressions are analysed.  Threads take turns, so none puts
    back what another one has set.
    """
    conf = files.sparkSession.conf
    with _SETTING:
        before = conf.get(REPEATED_KEYS)
        conf.set(REPEATED_KEYS, "true")
        try:
            for columns in _parsing(content, kind):
                files = files.withColumns(columns)
        finally:
            conf.set(REPEATED_KEYS, before)
    return files


@remembered
def _context_columns(path: str, content: str) -> tuple[Column, ...]:
    kind, record = suffix(F.col(path)), F.col("_record")
    load_error = (
        F.when(
            F.col(content).isNull(), F.concat(F.lit("Context file not found: "), F.col(path))
        )
        .when(kind.isin(".yaml", ".yml"), F.lit(CONTEXT_NO_YAML))
        .when(kind != ".json", F.concat(F.lit(CONTEXT_UNSUPPORTED), kind))
        .when(F.try_validate_utf8(F.col(content)).isNull(), F.lit(CONTEXT_UNREADABLE))
        .when(record.isNull(), F.lit(CONTEXT_BAD_JSON))
        .when(~F.col("_is_object"), F.lit(CONTEXT_NOT_MAPPING))
    )
    has_errors = F.size("_errors") > 0
    return (
        F.col(path).alias("context_path"),
        F.when(load_error.isNotNull(), schemas.CONTEXT_ERROR)
        .when(has_errors, schemas.INVALID_DATA)
        .otherwise(schemas.OK)
        .alias("context_status"),
        F.coalesce(load_error, F.when(has_errors, validation_message(F.col("_errors")))).alias(
            "context_error"
        ),
        F.when(
            load_error.isNull() & ~has_errors, record_struct(record, schemas.CONTEXT_FIELDS)
        ).alias("context"),
    )


def read_contexts(
    files: DataFrame, *, path: str = "path", content: str = "content"
) -> DataFrame:
    """Context files to ``context_path, context_status, context_error, context``.

    A missing content (null) stands for a file that does not exist.
    """
    rows = _parsed(files, content, "context").select(*_context_columns(path, content))
    return evaluate_once(rows, "context_path")


@remembered
def _material_columns(path: str) -> tuple[Column, ...]:
    record = F.col("_record")
    problems = (
        F.when(record.isNull(), F.array(F.lit(NOT_JSON)))
        .when(~F.col("_is_object"), F.array(F.lit(NOT_OBJECT)))
        .otherwise(F.col("_errors"))
    )
    ok = F.size(problems) == 0
    return (
        F.col(path).alias("path"),
        F.when(ok, schemas.OK).otherwise(schemas.INVALID_DATA).alias("status"),
        F.when(~ok, validation_message(problems)).alias("error"),
        F.when(ok, record_struct(record, schemas.MATERIAL_FIELDS)).alias("material"),
    )


def read_materials(
    files: DataFrame,
    *,
    path: str = "path",
    content: str = "content",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Parsed materials from JSON, to ``path, status, error, material``.

    ``keep`` names further input columns to carry along.
    """
    rows = _parsed(files, content, "material").select(*keep, *_material_columns(path))
    return evaluate_once(rows, *keep, "path")
