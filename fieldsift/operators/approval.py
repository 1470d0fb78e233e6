"""Context resolution and approval records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift import schemas
from fieldsift.functions.paths import in_folder, parent
from fieldsift.functions.remembered import remembered
from fieldsift.operators.lookup import DEFAULT_SALTS, lookup, only_row
from fieldsift.operators.records import read_contexts
from fieldsift.session import run_folder
from fieldsift.vocab import ATTACHMENTS_PLACEHOLDER

CONTEXT_NAME = "context.json"
# Fixed value: shown when no context could be resolved.
NO_CONTEXT = (
    "Context file not found. Add context.json next to the PDF or run the command "
    "from a folder containing context.json."
)


def select_attachments(context_list: Column, material_list: Column) -> Column:
    """The context's list if it has entries, else the material's."""
    return F.when(F.size(context_list) > 0, context_list).otherwise(material_list)


def attachments_text(attachments: Column) -> Column:
    """Numbered lines, or a dash for an empty list."""
    numbered = F.transform(
        attachments, lambda item, i: F.concat((i + 1).cast("string"), F.lit(". "), item)
    )
    return F.when(
        F.size(attachments) > 0, F.array_join(numbered, "\n")
    ).otherwise(F.lit(ATTACHMENTS_PLACEHOLDER))


@remembered
def approval_columns(context: str = "context", material: str | None = None) -> tuple[Column, ...]:
    """The twelve render columns plus the structured attachments.

    ``context`` and ``material`` name struct columns; without ``material`` its fields
    are the columns of an extraction.
    """

    def of(name: str) -> Column:
        return F.col(name) if material is None else F.col(f"{material}.{name}")

    chosen = select_attachments(F.col(f"{context}.attachments"), of("attachments"))
    values = {name: F.col(f"{context}.{name}") for name in schemas.CONTEXT_RENDER_FIELDS}
    values |= {name: of(name) for name in ("material_type", "description")}
    values["attachments_text"] = attachments_text(chosen)
    return (
        *[values[name].alias(name) for name in schemas.RENDER_FIELDS],
        chosen.alias("attachments"),
    )


def needed_contexts(
    docs: DataFrame,
    files: DataFrame,
    *,
    path: str = "path",
    content: str = "content",
    source_path: str = "source_path",
    explicit_path: str | None = None,
    working_folder: str = "",
) -> DataFrame:
    """The contexts that ``docs`` can be given, as a stored table for ``resolve_contexts``.

    The places that documents look in are few where folders hold many documents.  Files are
    reduced to those places before any is parsed, and each is read and parsed once: the
    lookups of ``resolve_contexts`` then read the table, the one of the working folder by a
    filter that reaches its scan.  A file that no document asks for has no row.
    """
    nearby = in_folder(parent(F.col(source_path)), CONTEXT_NAME)
    place = nearby if explicit_path is None else F.coalesce(F.col(explicit_path), nearby)
    usual = in_folder(F.lit(working_folder), CONTEXT_NAME)
    spark = files.sparkSession
    # Distinct before the union: the one usual place may then come twice, which a semi join allows.
    places = docs.select(place.alias("_place")).distinct()
    places = places.unionByName(spark.range(1).select(usual.alias("_place")))
    asked = files.join(places, files[path] == F.col("_place"), "left_semi")
    parsed = read_contexts(asked, path=path, content=content)
    folder = run_folder(spark, "contexts")
    parsed.write.parquet(folder)
    return spark.read.schema(parsed.schema).parquet(folder)


def resolve_contexts(
    docs: DataFrame,
    contexts: DataFrame,
    *,
    source_path: str = "source_path",
    explicit_path: str | None = None,
    working_folder: str = "",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Add ``context_path, context_status, context_error, context`` to documents.

    Precedence: explicit path, then ``context.json`` next to the document, then the
    one in the working folder.  The winner is picked by existence: a nearer context
    that is invalid is an error, not a reason to look further.  As an explicit path
    excludes the other places, one lookup key per document is enough.  ``contexts``
    is the output of ``read_contexts`` or ``needed_contexts``, one row per path.
    """
    explicit = F.lit(None).cast("string") if explicit_path is None else F.col(explicit_path)
    nearby = in_folder(parent(F.col(source_path)), CONTEXT_NAME)
    default_path = in_folder(F.lit(working_folder), CONTEXT_NAME)
    fields = ("context_path", "context_status", "context_error", "context")
    packed = contexts.select("context_path", F.struct(*fields).alias("_found"))
    found = lookup(
        docs,
        packed,
        key=F.coalesce(explicit, nearby),
        dimension_key="context_path",
        spread_by=F.col(source_path),
        salts=salts,
    )
    default = only_row(packed.where(F.col("context_path") == default_path), F.col("_found"))
    absent = F.struct(
        explicit.alias("context_path"),
        F.lit(schemas.CONTEXT_ERROR).alias("context_status"),
        F.when(
            explicit.isNotNull(), F.concat(F.lit("Context file not found: "), explicit)
        )
        .otherwise(F.lit(NO_CONTEXT))
        .alias("context_error"),
        F.lit(None).cast(contexts.schema["context"].dataType).alias("context"),
    )
    return (
        found.withColumns(
            {"_found": F.coalesce("_found", F.when(explicit.isNull(), default), absent)}
        )
        .withColumns({name: F.col("_found")[name] for name in fields})
        .drop("_found")
    )


def attach_context(docs: DataFrame, context: DataFrame) -> DataFrame:
    """Give every document the one context of the batch, as column ``context``."""
    return docs.withColumn("context", only_row(context, F.col("context")))


def build_approvals(materials: DataFrame, *keep: str) -> DataFrame:
    """Approval records of rows that hold both a material and a context struct."""
    return materials.select(*keep, *approval_columns("context", "material"))
