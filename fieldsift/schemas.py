"""Column sets and status values shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Document and workflow status values.
OK = "ok"
NON_TEXT = "non_text"
PARSE_ERROR = "parse_error"
CONTEXT_ERROR = "context_error"
INVALID_DATA = "invalid_data"
TEMPLATE_NOT_FOUND = "template_not_found"
SKIPPED = "skipped"
ERROR = "error"

EVENT = T.StructType(
    [
        T.StructField("field_name", T.StringType()),
        T.StructField("step_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("matched", T.BooleanType()),
        T.StructField("value_preview", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)
EVENTS = T.ArrayType(EVENT)

# Fields of the JSON records, in declaration order: name -> (kind, required).
# Kinds: "string", "optional" (string or null), "strings" (array of string).
CONTEXT_FIELDS = {
    "template_variant": ("optional", False),
    "output_dir": ("optional", False),
    "investor_name": ("string", True),
    "project_title": ("string", True),
    "contractor_name": ("string", True),
    "manufacturer": ("string", True),
    "estimated_quantity": ("string", True),
    "planned_delivery_date": ("string", True),
    "planned_installation_date": ("string", True),
    "prepared_by_name": ("string", True),
    "prepared_by_role": ("string", True),
    "attachments": ("strings", False),
}
MATERIAL_FIELDS = {
    "source_path": ("optional", False),
    "raw_text": ("optional", False),
    "material_type": ("string", True),
    "description": ("string", True),
    "attachments": ("strings", False),
}

# The twelve values handed to a template, in output order.
RENDER_FIELDS = (
    "investor_name",
    "project_title",
    "contractor_name",
    "material_type",
    "manufacturer",
    "estimated_quantity",
    "description",
    "planned_delivery_date",
    "planned_installation_date",
    "attachments_text",
    "prepared_by_name",
    "prepared_by_role",
)
# Those of them that come from the context.
CONTEXT_RENDER_FIELDS = tuple(
    f for f in RENDER_FIELDS if f not in ("material_type", "description", "attachments_text")
)
