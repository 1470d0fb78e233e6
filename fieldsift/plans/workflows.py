"""The workflows end to end: parse, generate, batch and build-approval.

Each is one declarative plan.  Texts are reduced to the extracted fields before
anything is joined, so a lookup never moves document texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift import schemas
from fieldsift.functions.paths import batch_output_path, dump_path, output_path
from fieldsift.operators.approval import (
    approval_columns,
    attach_context,
    build_approvals,
    resolve_contexts,
)
from fieldsift.operators.diagnostics import diagnostics_text
from fieldsift.operators.extract import extract_fields
from fieldsift.operators.gate import DEFAULT_MIN_CHARS, scan_diagnosis
from fieldsift.operators.lookup import DEFAULT_SALTS, lookup, only_row
from fieldsift.operators.reports import batch_item, exit_code
from fieldsift.operators.templates import (
    attach_templates,
    fill_template,
    render_values,
    split_templates,
    template_missing_error,
)
from fieldsift.session import run_folder
from fieldsift.sources.listing import failed_items, list_documents, usable
from fieldsift.vocab import DEFAULT_VOCABULARY, Vocabulary

#: What decides about a document, and what a record shows of it.
JUDGED = ("status", "error")
FIELDS = ("material_type", "description", "attachments")


def parse_documents(
    docs: DataFrame,
    *,
    text: str = "text",
    source_path: str = "source_path",
    min_chars: int = DEFAULT_MIN_CHARS,
    debug: bool = False,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Extraction with the message and exit code a single run would end with.

    A document without text gets the scan diagnosis, naming its dump.
    """
    extracted = extract_fields(
        docs, text=text, source_path=source_path, min_chars=min_chars, vocab=vocab,
        diagnostics=debug,
    )
    status, path = F.col("status"), F.col("source_path")
    extra = {
        "message": F.when(
            status == schemas.NON_TEXT, scan_diagnosis(dump_path(path))
        ).otherwise(F.col("error")),
        "exit_code": exit_code(status),
    }
    if debug:
        extra["diagnostics_text"] = diagnostics_text(F.col("events"), F.col("warnings"))
    return extracted.withColumns(extra)


def build_approval_records(
    materials: DataFrame,
    contexts: DataFrame,
    *,
    context_path: str = "context_path",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Parsed materials joined to their contexts; ``materials`` from ``read_materials``.

    The material is checked before the context; every failure ends with code 1.  Only the
    fields of a material that a record shows go into the join, so no text is moved.
    """
    shown = [F.col(f"material.{n}") for n in ("material_type", "description", "attachments")]
    materials = materials.withColumn(
        "material", F.when(F.col("material").isNotNull(), F.struct(*shown))
    )
    found = contexts.select(
        "context_path", F.struct("context_status", "context_error", "context").alias("_found")
    )
    wanted = F.col(context_path)
    joined = lookup(
        materials,
        found,
        key=wanted,
        dimension_key="context_path",
        spread_by=F.col("path"),
        salts=salts,
    )
    context_status = F.coalesce(F.col("_found.context_status"), F.lit(schemas.CONTEXT_ERROR))
    context_error = F.coalesce(
        F.col("_found.context_error"),
        F.when(
            F.col("_found").isNull(),
            F.concat(F.lit("Context file not found: "), wanted),
        ),
    )
    checked = joined.select(
        "path",
        F.when(F.col("status") != schemas.OK, F.col("status"))
        .otherwise(context_status)
        .alias("status"),
        F.coalesce("error", context_error).alias("error"),
        "material",
        F.col("_found.context").alias("context"),
    )
    complete = F.col("status") == schemas.OK
    return build_approvals(
        checked.withColumns(
            {
                "exit_code": F.when(complete, 0).otherwise(1),
                "context": F.when(complete, F.col("context")),
            }
        ),
        "path", "status", "error", "exit_code",
    )


def generate_approvals(
    docs: DataFrame,
    contexts: DataFrame,
    templates: DataFrame,
    *,
    text: str = "text",
    source_path: str = "source_path",
    explicit_context: str | None = None,
    template_path: str = "template_path",
    default_template: str | None = None,
    explicit_output: str | None = None,
    working_folder: str = "",
    min_chars: int = DEFAULT_MIN_CHARS,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
    salts: int = DEFAULT_SALTS,
    render: bool = True,
) -> DataFrame:
    """Extraction, context resolution and template filling for each document.

    The first failing check decides the status: no context anywhere, no text, no
    material type, an absent or invalid context, a missing template.  A document that names
    no template gets ``default_template``.  Without ``render`` the rows end with
    ``context_path``, and nothing is computed for the records and texts.
    """
    keep = tuple(c for c in (explicit_context, template_path, explicit_output) if c)
    extracted = extract_fields(
        docs, text=text, source_path=source_path, min_chars=min_chars, vocab=vocab, keep=keep,
        columns=JUDGED if not render else (*JUDGED, *FIELDS),
    )
    resolved = resolve_contexts(
        extracted,
        contexts,
        explicit_path=explicit_context,
        working_folder=working_folder,
        salts=salts,
    )
    if default_template is not None:
        named = F.coalesce(F.col(template_path), F.lit(default_template))
        resolved = resolved.withColumn(template_path, named)
    complete = attach_templates(
        resolved, templates, template_path=template_path, salts=salts
    )

    parsed, found = F.col("status"), F.col("context_status")
    nowhere = F.col("context_path").isNull()
    path = F.col("source_path")
    status = (
        F.when(nowhere, schemas.CONTEXT_ERROR)
        .when(parsed != schemas.OK, parsed)
        .when(found != schemas.OK, found)
        .when(F.col("template").isNull(), schemas.TEMPLATE_NOT_FOUND)
        .otherwise(schemas.OK)
    )
    error = (
        F.when(nowhere, F.col("context_error"))
        .when(parsed == schemas.NON_TEXT, scan_diagnosis(dump_path(path)))
        .when(parsed != schemas.OK, F.col("error"))
        .when(found != schemas.OK, F.col("context_error"))
        .when(F.col("template").isNull(), template_missing_error(F.col(template_path)))
    )
    target = output_path(path, F.col(explicit_output) if explicit_output else None)
    judged = complete.withColumns({"_status": status, "_error": error})
    outcome = (
        path,
        F.col("_status").alias("status"),
        F.col("_error").alias("error"),
        exit_code(F.col("_status")).alias("exit_code"),
        F.when(F.col("_status") == schemas.OK, target).alias("output"),
        F.col("context_path"),
    )
    if not render:
        return judged.select(*outcome)
    rows = judged.select(
        *outcome,
        F.when(F.col("_status") == schemas.OK, F.col("template")).alias("template"),
        *approval_columns("context"),
    )
    return rows.withColumn(
        "rendered", fill_template(F.col("template"), render_values())
    ).drop("template")


def batch_documents(
    docs: DataFrame,
    output_dir: str,
    *,
    context: DataFrame | None = None,
    templates: DataFrame | None = None,
    template_path: str | None = None,
    text: str = "text",
    source_path: str = "source_path",
    min_chars: int = DEFAULT_MIN_CHARS,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
    render: bool = True,
) -> DataFrame:
    """One item per document: ``pdf, status, output, error, reason, rendered``.

    ``context`` is the one row of ``read_contexts`` for the batch; ``require_context``
    stops the batch unless there is exactly one and it is valid.
    Without a context or a template every document is skipped, and as that is known
    up front no text is read.  Without ``render`` there is no column ``rendered``, and
    neither descriptions nor records are computed.
    """
    if context is None or template_path is None or templates is None:
        nothing = F.lit(None).cast("string")
        skipped = docs.select(
            *batch_item(F.col(source_path), F.lit(schemas.SKIPPED), nothing, nothing),
            nothing.alias("rendered"),
        )
        return skipped if render else skipped.drop("rendered")
    extracted = attach_context(
        extract_fields(
            docs, text=text, source_path=source_path, min_chars=min_chars, vocab=vocab,
            columns=JUDGED if not render else (*JUDGED, *FIELDS),
        ),
        require_context(context),
    )
    wanted = split_templates(templates).where(F.col("template_path") == template_path)
    complete = extracted.withColumn("template", only_row(wanted, F.col("template")))
    no_template = (F.col("status") == schemas.OK) & F.col("template").isNull()
    status = F.when(no_template, schemas.TEMPLATE_NOT_FOUND).otherwise(F.col("status"))
    error = F.when(no_template, template_missing_error(F.lit(template_path))).otherwise(
        F.col("error")
    )
    path = F.col("source_path")
    judged = complete.withColumns({"_status": status, "_error": error})
    item = batch_item(
        path, F.col("_status"), batch_output_path(path, output_dir), F.col("_error")
    )
    if not render:
        return judged.select(*item)
    rows = judged.select(
        *item,
        F.when(F.col("_status") == schemas.OK, F.col("template")).alias("template"),
        *approval_columns("context"),
    )
    return rows.withColumn("rendered", fill_template(F.col("template"), render_values())).select(
        "pdf", "status", "output", "error", "reason", "rendered"
    )


def batch_folder(
    spark: SparkSession,
    folder: str,
    output_dir: str,
    *,
    pattern: str = "*.pdf",
    recursive: bool = False,
    **options,
) -> DataFrame:
    """One item for every name in a folder that matches; ``options`` as ``batch_documents``.

    A file that cannot be read, or is no text, is an item with its error.  The files are
    read once, into a run folder, so the items do not change while a batch runs and a lost
    executor reads none of them again.  Without a context or a template none is opened.
    """
    skipped = any(options.get(name) is None for name in ("context", "templates", "template_path"))
    listed = list_documents(spark, folder, pattern=pattern, recursive=recursive, content=not skipped)
    if skipped:
        return batch_documents(listed, output_dir, **options)
    stored = run_folder(spark, "listing")
    listed.write.parquet(stored)
    files = spark.read.schema(listed.schema).parquet(stored)
    items = batch_documents(usable(files), output_dir, **options)
    return items.unionByName(failed_items(files), allowMissingColumns=True)


class ContextNotUsable(ValueError):
    """The one context of a batch is missing or invalid."""


def require_context(context: DataFrame) -> DataFrame:
    """Stop a batch before any document when its only context is not usable.

    Reads the status of two records at most.
    """
    rows = context.select("context_status", "context_error").take(2)
    if not rows:
        raise ContextNotUsable("Context file not found")
    if len(rows) > 1:
        raise ContextNotUsable("More than one context")
    row = rows[0]
    if row["context_status"] != schemas.OK:
        raise ContextNotUsable(row["context_error"])
    return context
