"""Template lookup and filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift import schemas
from fieldsift.functions.remembered import remembered
from fieldsift.functions.text import SPACE, WORD
from fieldsift.operators.lookup import DEFAULT_SALTS, lookup

PLACEHOLDER = rf"\{{\{{[{SPACE}]*([{WORD}]+)[{SPACE}]*\}}\}}"


def split_templates(
    templates: DataFrame, *, path: str = "template_path", text: str = "template_text"
) -> DataFrame:
    """Each template once, as literal pieces and the names between them."""
    return templates.select(
        F.col(path).alias("template_path"),
        F.struct(
            F.split(F.col(text), PLACEHOLDER).alias("pieces"),
            F.regexp_extract_all(F.col(text), F.lit(PLACEHOLDER), F.lit(1)).alias("names"),
        ).alias("template"),
    )


def fill_template(template: Column, values: Column) -> Column:
    """Put the values between the pieces.

    Values are never scanned again, so braces, dollars or backslashes in them stay
    as they are.  Unknown names become empty.
    """
    filled = F.transform(
        template["names"],
        lambda name, i: F.concat(
            F.get(template["pieces"], i), F.coalesce(F.try_element_at(values, name), F.lit(""))
        ),
    )
    tail = F.element_at(template["pieces"], -1)
    return F.concat(F.array_join(filled, ""), tail)


@remembered
def render_values() -> Column:
    """The twelve named values of an approval row, as a map."""
    return F.create_map(
        *[item for name in schemas.RENDER_FIELDS for item in (F.lit(name), F.col(name))]
    )


def template_missing_error(path: Column) -> Column:
    return F.concat(F.lit("Template not found: "), F.coalesce(path, F.lit("")))


def attach_templates(
    docs: DataFrame,
    templates: DataFrame,
    *,
    template_path: str = "template_path",
    spread_by: str = "source_path",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Add the split template, null where the path is not in the template table."""
    return lookup(
        docs,
        split_templates(templates),
        key=F.col(template_path),
        dimension_key="template_path",
        spread_by=F.col(spread_by),
        salts=salts,
    )
