"""The registered queries, named after the inventory ids they cover.

Each query reads whole tables.  Arrays and long texts are reduced to flat columns
(joined strings, md5) so that results compare by value with the checking SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift import schemas
from fieldsift.functions import labels, mojibake, paths, scoring, sections
from fieldsift.functions.declaration import declaration_identifier
from fieldsift.functions.normalize import normalize_text
from fieldsift.functions.text import (
    collapse,
    drop_invisible,
    has_word,
    meaningful_lines,
    preview,
    split_lines,
    strip,
    unify_breaks,
)
from fieldsift.operators import extract, line_table, records, reports
from fieldsift.operators import templates as template_ops
from fieldsift.operators.approval import (
    attach_context,
    attachments_text,
    needed_contexts,
    resolve_contexts,
    select_attachments,
)
from fieldsift.operators.barrier import evaluate_once
from fieldsift.operators.diagnostics import diagnostics_text, explode_events
from fieldsift.operators.gate import DEFAULT_MIN_CHARS, quarantine, text_gate
from fieldsift.operators.pages import assemble_pages
from fieldsift.operators.vocabularies import attach_vocabulary, vocabulary_of
from fieldsift.plans import workflows
from fieldsift.queries import inputs
from fieldsift.queries import oracle as O
from fieldsift.session import run_folder
from fieldsift.sources import sinks
from fieldsift.sources.listing import list_documents
from fieldsift.sources.publish import published_folder
from fieldsift.vocab import DEFAULT_VOCABULARY as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

DOC_CHARS = DEFAULT_MIN_CHARS
SHEET_CHARS = inputs.SHEET_MIN_CHARS


def query(name: str, check: str | None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if check is not None:
            CHECKS[name] = check
        return function

    return register


def md5(column: str) -> F.Column:
    return F.md5(F.col(column))


def bigints(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("bigint") for c in columns})


def documents(spark, sf_dir):
    return inputs.documents(spark, sf_dir)


def sheets(spark, sf_dir):
    return inputs.sheets(spark, sf_dir)


def raw_documents(spark, sf_dir, passed_only=False, keep=()):
    """Documents with their normalised text, as the line work sees it."""
    gated = text_gate(documents(spark, sf_dir), min_chars=DOC_CHARS)
    gated = gated.where("gate_passed") if passed_only else gated
    return gated.select(
        "doc_id",
        *keep,
        F.when(F.col("gate_passed"), normalize_text(F.col("gate_text"))).alias("raw_text"),
    )


def raw_sheets(spark, sf_dir, passed_only=False):
    gated = text_gate(sheets(spark, sf_dir), min_chars=SHEET_CHARS)
    gated = gated.where("gate_passed") if passed_only else gated
    return gated.select(
        "sheet_id",
        F.when(F.col("gate_passed"), normalize_text(F.col("gate_text"))).alias("raw_text"),
    )


def sheet_steps(spark, sf_dir):
    return extract.extraction_steps(sheets(spark, sf_dir), min_chars=SHEET_CHARS)


def document_steps(spark, sf_dir):
    return extract.extraction_steps(documents(spark, sf_dir), min_chars=DOC_CHARS)


def sheet_lines(spark, sf_dir):
    return line_table.line_table(raw_sheets(spark, sf_dir), "sheet_id")


SHEET_BASE = O.base(O.SHEETS, SHEET_CHARS)
SHEET_EXTRACTION = O.extraction(O.SHEETS, SHEET_CHARS)
DOC_BASE = O.base(O.DOCUMENTS, DOC_CHARS)
DOC_EXTRACTION = O.extraction(O.DOCUMENTS, DOC_CHARS)


# --- sources and gate --------------------------------------------------------
@query(
    "s1_document_scan",
    f"SELECT doc_id, {inputs.DOCUMENT_PATH_SQL} AS source_path, md5(text) AS text_md5 FROM documents",
)
def s1_document_scan(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "source_path", md5("text").alias("text_md5"))


_FILES_SQL = (
    f"files AS (SELECT doc_id AS k, {inputs.FILE_NAME_SQL} AS name, {inputs.FILE_KIND_SQL} AS kind, "
    "coalesce(text, '') AS content FROM documents WHERE doc_id % 6 <> 3)"
)
_FILE_ERROR_SQL = (
    "CASE kind WHEN 'bytes' THEN 'Not UTF-8 at byte ' || octet_length(encode(content)) || ': ' "
    "|| name WHEN 'folder' THEN 'Not a file: ' || name END"
)


def _named(column: str, folder: str) -> F.Column:
    """A path or message without the folder of this run."""
    return F.regexp_replace(column, rf"(?:file:)?\S*/{folder.rsplit('/', 1)[-1]}/", "")


@query(
    "s1_folder_listing",
    f"WITH {_FILES_SQL} SELECT name, CASE kind WHEN 'bytes' THEN 'not_utf8' WHEN 'folder' THEN "
    f"'not_a_file' ELSE 'ok' END AS status, {_FILE_ERROR_SQL} AS error, "
    "CASE kind WHEN 'text' THEN octet_length(encode(content)) "
    "WHEN 'bytes' THEN octet_length(encode(content)) + 1 END AS size, "
    "CASE kind WHEN 'text' THEN md5(content) END AS text_md5 FROM files",
)
def s1_folder_listing(spark, sf_dir):
    folder = inputs.document_files(spark, sf_dir)
    return list_documents(spark, folder).select(
        _named("source_path", folder).alias("name"),
        "status",
        _named("error", folder).alias("error"),
        "size",
        md5("text").alias("text_md5"),
    )


@query(
    "s2_page_assembly",
    "SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS text_md5, "
    "length(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS n_chars "
    "FROM conversations GROUP BY conv_id",
)
def s2_page_assembly(spark, sf_dir):
    pages = inputs.load(spark, sf_dir, "conversations")
    return assemble_pages(pages, document="conv_id", page="turn").select(
        "conv_id", md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars")
    )


@query(
    "p1_text_gate",
    f"WITH {O.DOCUMENTS}, {O.gate(DOC_CHARS)} SELECT k AS doc_id, n_chars, passed, "
    "gate_error AS error, md5(gate_text) AS text_md5 FROM gated",
)
def p1_text_gate(spark, sf_dir):
    return text_gate(documents(spark, sf_dir), min_chars=DOC_CHARS).select(
        "doc_id",
        F.col("gate_chars").cast("bigint").alias("n_chars"),
        F.col("gate_passed").alias("passed"),
        F.col("gate_error").alias("error"),
        md5("gate_text").alias("text_md5"),
    )


# --- text --------------------------------------------------------------------
@query(
    "t1_line_breaks",
    f"WITH {O.SHEETS}, c AS (SELECT k, replace(replace(text, chr(13) || chr(10), chr(10)), "
    "chr(13), chr(10)) AS t FROM src) SELECT k AS sheet_id, md5(t) AS text_md5, "
    "length(t) - length(replace(t, chr(10), '')) AS breaks FROM c",
)
def t1_line_breaks(spark, sf_dir):
    unified = sheets(spark, sf_dir).select("sheet_id", unify_breaks(F.col("text")).alias("t"))
    return unified.select(
        "sheet_id", md5("t").alias("text_md5"),
        F.regexp_count("t", F.lit("\n")).cast("bigint").alias("breaks"),
    )


@query(
    "t2_invisible_characters",
    f"WITH {O.SHEETS} SELECT k AS sheet_id, md5(replace(replace(text, chr(65279), ''), "
    "chr(160), ' ')) AS text_md5 FROM src",
)
def t2_invisible_characters(spark, sf_dir):
    return sheets(spark, sf_dir).select(
        "sheet_id", F.md5(drop_invisible(F.col("text"))).alias("text_md5")
    )


_BROKEN_SQL = "replace(replace(text, 'ó', 'Ã³'), 'é', 'Ä™')"


@query(
    "t3_mojibake_table",
    f"SELECT doc_id, md5({O.table_repair(_BROKEN_SQL)}) AS text_md5 FROM documents",
)
def t3_mojibake_table(spark, sf_dir):
    broken = documents(spark, sf_dir).withColumn("text", F.expr(_BROKEN_SQL))
    return broken.select(
        "doc_id", F.md5(mojibake.replace_broken(F.col("text"))).alias("text_md5")
    )


# Every character read as its UTF-8 bytes; characters have at most three bytes here.
_AS_BYTES_SQL = (
    "array_to_string(list_transform(string_split(text, ''), lambda c: CASE "
    "WHEN unicode(c) < 128 THEN c "
    "WHEN unicode(c) < 2048 THEN chr(192 + unicode(c) // 64) || chr(128 + unicode(c) % 64) "
    "WHEN unicode(c) < 65536 THEN chr(224 + unicode(c) // 4096) "
    "|| chr(128 + unicode(c) // 64 % 64) || chr(128 + unicode(c) % 64) "
    "ELSE chr(240 + unicode(c) // 262144) || chr(128 + unicode(c) // 4096 % 64) "
    "|| chr(128 + unicode(c) // 64 % 64) || chr(128 + unicode(c) % 64) END), '')"
)


def _redecode_check(broken: str) -> str:
    # A text the table changed holds a lone western byte and no longer decodes.
    return (
        f"WITH b AS (SELECT doc_id, text, {broken} AS broken FROM documents), "
        f"r AS (SELECT doc_id, text, broken, {O.table_repair('broken')} AS fixed FROM b) "
        f"SELECT doc_id, md5(CASE WHEN fixed = broken AND {O.damage_score('broken')} > "
        f"{O.damage_score('text')} THEN text ELSE fixed END) AS text_md5 FROM r"
    )


def _as_bytes(text):
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


@query("t4_redecode_latin1", _redecode_check(_AS_BYTES_SQL))
def t4_redecode_latin1(spark, sf_dir):
    broken = documents(spark, sf_dir).withColumn("text", _as_bytes(F.col("text")))
    return broken.select("doc_id", F.md5(mojibake.repair(F.col("text"))).alias("text_md5"))


@query(
    "t4_redecode_cp1252",
    _redecode_check(
        f"translate({_AS_BYTES_SQL}, {O.quote(mojibake.CP1252_AS_LATIN1)}, "
        f"{O.quote(mojibake.CP1252_SPECIALS)})"
    ),
)
def t4_redecode_cp1252(spark, sf_dir):
    broken = documents(spark, sf_dir).withColumn(
        "text",
        F.translate(
            _as_bytes(F.col("text")), mojibake.CP1252_AS_LATIN1, mojibake.CP1252_SPECIALS
        ),
    )
    return broken.select("doc_id", F.md5(mojibake.repair(F.col("text"))).alias("text_md5"))


@query(
    "t5_normalized_documents",
    f"{DOC_BASE} SELECT k AS doc_id, md5(raw_text) AS raw_md5, length(raw_text) AS n_chars FROM norm",
)
def t5_normalized_documents(spark, sf_dir):
    return raw_documents(spark, sf_dir).select(
        "doc_id", md5("raw_text").alias("raw_md5"),
        F.length("raw_text").cast("bigint").alias("n_chars"),
    )


@query("t5_normalized_sheets", f"{SHEET_BASE} SELECT k AS sheet_id, raw_text FROM norm")
def t5_normalized_sheets(spark, sf_dir):
    return raw_sheets(spark, sf_dir)


@query(
    "t6_line_table",
    f"{DOC_BASE}, {O.LINE_TABLE} SELECT k AS doc_id, CAST(line_no AS BIGINT) AS line_no, "
    "md5(line) AS line_md5 FROM line_table",
)
def t6_line_table(spark, sf_dir):
    return line_table.line_table(raw_documents(spark, sf_dir), "doc_id").select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), md5("line").alias("line_md5")
    )


@query(
    "t7_preprocess",
    f"{SHEET_BASE} SELECT k AS sheet_id, md5(raw_text) AS raw_md5, len(lines) AS n_lines, "
    "array_to_string(lines, ' | ') AS lines FROM lists WHERE raw_text IS NOT NULL",
)
def t7_preprocess(spark, sf_dir):
    rows = raw_sheets(spark, sf_dir, passed_only=True).withColumn(
        "l", meaningful_lines(F.col("raw_text"))
    )
    return rows.select(
        "sheet_id", md5("raw_text").alias("raw_md5"),
        F.size("l").cast("bigint").alias("n_lines"), F.array_join("l", " | ").alias("lines"),
    )


@query(
    "t8_preview",
    f"SELECT doc_id, {O.preview('text')} AS preview, {O.preview('text', 40)} AS short_preview "
    "FROM documents",
)
def t8_preview(spark, sf_dir):
    text = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", preview(text).alias("preview"), preview(text, 40).alias("short_preview")
    )


# --- labels, sections, declaration -------------------------------------------
# A label line put in front of, and inside, every document text.
_LABELLED_SQL = (
    "concat(substring(text, 1, 40), chr(10), 'Source:  ', source, chr(10), lang, ' ', text, "
    "chr(10), 'lang - ', lang)"
)
_OWN_LABELS = ("source", "lang")


@query(
    "t9_labeled_value",
    "WITH src AS (SELECT doc_id AS k, "
    f"{_LABELLED_SQL} AS text, CAST(NULL AS VARCHAR) AS fixed FROM documents), "
    f"{O.gate(0)}, {O.normalized()}, {O.label('found', _OWN_LABELS, 'lists')} "
    "SELECT k AS doc_id, md5(value) AS value_md5, length(value) AS value_chars "
    "FROM src LEFT JOIN found USING (k)",
)
def t9_labeled_value(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("text", F.expr(_LABELLED_SQL))
    raw = docs.select("doc_id", normalize_text(F.col("text")).alias("raw_text"))
    values = raw.select(
        "doc_id", labels.labeled_value(F.col("raw_text"), _OWN_LABELS).alias("value")
    )
    return values.select(
        "doc_id", md5("value").alias("value_md5"),
        F.length("value").cast("bigint").alias("value_chars"),
    )


@query(
    "t10_material_label",
    f"{SHEET_BASE}, {O.label('ml', V.material_labels, 'lists')} "
    "SELECT k AS sheet_id, value AS material_type FROM src LEFT JOIN ml USING (k)",
)
def t10_material_label(spark, sf_dir):
    return raw_sheets(spark, sf_dir).select(
        "sheet_id",
        labels.labeled_value(F.col("raw_text"), V.material_labels).alias("material_type"),
    )


@query(
    "t11_description_label",
    f"{SHEET_BASE}, {O.label('dl', V.description_labels, 'lists')} "
    "SELECT k AS sheet_id, value AS description FROM src LEFT JOIN dl USING (k)",
)
def t11_description_label(spark, sf_dir):
    return raw_sheets(spark, sf_dir).select(
        "sheet_id",
        labels.labeled_value(F.col("raw_text"), V.description_labels).alias("description"),
    )


@query(
    "r3_first_label_line",
    f"{SHEET_BASE}, {O.label('ml', V.material_labels, 'lists')} "
    "SELECT k AS sheet_id, CAST(coalesce(pos, 0) AS BIGINT) AS line_no "
    "FROM lists LEFT JOIN ml USING (k) WHERE raw_text IS NOT NULL",
)
def r3_first_label_line(spark, sf_dir):
    return raw_sheets(spark, sf_dir, passed_only=True).select(
        "sheet_id",
        labels.first_label_line(split_lines(F.col("raw_text")), V.material_labels).alias(
            "line_no"
        ),
    )


@query(
    "r4_earliest_marker",
    f"{SHEET_BASE} SELECT k AS sheet_id, "
    f"CAST({O.earliest('lower(raw_text)', V.section_markers)} AS BIGINT) AS section_at, "
    f"CAST({O.earliest('lower(raw_text)', V.section_stops)} AS BIGINT) AS stop_at, "
    f"CAST({O.earliest('lower(raw_text)', V.title_stops)} AS BIGINT) AS title_stop_at FROM norm",
)
def r4_earliest_marker(spark, sf_dir):
    low = raw_sheets(spark, sf_dir).select("sheet_id", F.lower("raw_text").alias("low"))
    return low.select(
        "sheet_id",
        sections.earliest(F.col("low"), V.section_markers).cast("bigint").alias("section_at"),
        sections.earliest(F.col("low"), V.section_stops).cast("bigint").alias("stop_at"),
        sections.earliest(F.col("low"), V.title_stops).cast("bigint").alias("title_stop_at"),
    )


@query(
    "t12_section_title",
    f"{SHEET_BASE}, {O.sections()} SELECT k AS sheet_id, title FROM src LEFT JOIN section USING (k)",
)
def t12_section_title(spark, sf_dir):
    raw = F.col("raw_text")
    return raw_sheets(spark, sf_dir).select(
        "sheet_id", sections.section_title(raw, F.lower(raw)).alias("title")
    )


@query(
    "t13_section_body",
    f"{SHEET_BASE}, {O.sections()} SELECT k AS sheet_id, body FROM src LEFT JOIN section USING (k)",
)
def t13_section_body(spark, sf_dir):
    raw = F.col("raw_text")
    return raw_sheets(spark, sf_dir).select(
        "sheet_id", sections.section_body(raw, F.lower(raw)).alias("body")
    )


@query(
    "t14_declaration",
    f"{SHEET_BASE}, {O.declaration()} SELECT k AS sheet_id, value AS identifier "
    "FROM src LEFT JOIN declared USING (k)",
)
def t14_declaration(spark, sf_dir):
    raw = raw_sheets(spark, sf_dir).withColumn("low", F.lower("raw_text"))
    rows = raw.select(
        "sheet_id", extract.line_rows(F.col("raw_text"), F.col("low"), V).alias("rows")
    )
    return rows.select("sheet_id", declaration_identifier(F.col("rows")).alias("identifier"))


@query(
    "r5_head_limits",
    f"{DOC_BASE} SELECT k AS doc_id, md5(array_to_string(lines[1:5], chr(10))) AS first_5, "
    "md5(array_to_string(lines[1:10], chr(10))) AS first_10, "
    f"substring({O.strip(O.collapse('raw_text'))}, 1, 280) AS head "
    "FROM lists WHERE raw_text IS NOT NULL",
)
def r5_head_limits(spark, sf_dir):
    rows = raw_documents(spark, sf_dir, passed_only=True).withColumn(
        "l", meaningful_lines(F.col("raw_text"))
    )
    return rows.select(
        "doc_id",
        F.md5(F.array_join(F.slice("l", 1, 5), "\n")).alias("first_5"),
        F.md5(F.array_join(F.slice("l", 1, 10), "\n")).alias("first_10"),
        F.substring(strip(collapse(F.col("raw_text"))), 1, 280).alias("head"),
    )


# --- predicates and scores ----------------------------------------------------
@query(
    "p2_product_code",
    f"{SHEET_BASE}, {O.LINE_TABLE} SELECT k AS sheet_id, CAST(line_no AS BIGINT) AS line_no, "
    f"{O.is_code('line')} AS is_code FROM line_table",
)
def p2_product_code(spark, sf_dir):
    return sheet_lines(spark, sf_dir).select(
        "sheet_id", F.col("line_no").cast("bigint").alias("line_no"),
        scoring.is_product_code(F.col("line")).alias("is_code"),
    )


@query(
    "p3_candidate",
    f"{SHEET_BASE}, {O.LINE_TABLE} SELECT k AS sheet_id, CAST(line_no AS BIGINT) AS line_no, "
    f"{O.candidate('lower(line)')} AS is_candidate FROM line_table",
)
def p3_candidate(spark, sf_dir):
    return sheet_lines(spark, sf_dir).select(
        "sheet_id", F.col("line_no").cast("bigint").alias("line_no"),
        scoring.is_candidate(F.lower("line")).alias("is_candidate"),
    )


@query(
    "t15_material_score",
    f"{DOC_BASE}, {O.LINE_TABLE} SELECT k AS doc_id, CAST(line_no AS BIGINT) AS line_no, "
    f"CAST({O.material_score('line')} AS BIGINT) AS score FROM line_table",
)
def t15_material_score(spark, sf_dir):
    lines = line_table.line_property_table(raw_documents(spark, sf_dir), "doc_id")
    return bigints(line_table.material_line_scores(lines, "doc_id"), "line_no", "score")


# The language name stands for the material type, and once in a while equals a line.
_T16 = O.description_score("line", "material_type")


@query(
    "t16_description_score",
    f"{DOC_BASE}, {O.LINE_TABLE}, m AS (SELECT k, lines[1] AS material_type FROM lists) "
    f"SELECT k AS doc_id, CAST(line_no AS BIGINT) AS line_no, CAST({_T16} AS BIGINT) AS score "
    "FROM line_table JOIN m USING (k)",
)
def t16_description_score(spark, sf_dir):
    docs = raw_documents(spark, sf_dir).withColumn(
        "material_type", F.get(meaningful_lines(F.col("raw_text")), F.lit(0))
    )
    lines = line_table.line_property_table(docs, "doc_id", "material_type")
    return bigints(line_table.description_line_scores(lines, "doc_id"), "line_no", "score")


# --- ranking over the line table ----------------------------------------------
_TOP_MATERIAL = (
    "SELECT k AS {key}, CAST(n AS BIGINT) AS candidates, CAST(score AS BIGINT) AS score, "
    "CAST(line_no AS BIGINT) AS line_no, line FROM top_material JOIN candidate_counts USING (k)"
)


def _top_material(docs: DataFrame, key: str) -> DataFrame:
    return line_table.top_material_lines(docs, key).select(
        key, "candidates", F.col("score").cast("bigint").alias("score"),
        F.col("line_no").cast("bigint").alias("line_no"), "line",
    )


@query(
    "r1_top_material_line",
    f"{DOC_BASE}, {O.LINE_TABLE}, {O.CANDIDATES} SELECT k AS doc_id, "
    "CAST(coalesce(n, 0) AS BIGINT) AS candidates, CAST(score AS BIGINT) AS score, line "
    "FROM lists LEFT JOIN candidate_counts USING (k) LEFT JOIN top_material USING (k) WHERE passed",
)
def r1_top_material_line(spark, sf_dir):
    docs = raw_documents(spark, sf_dir, passed_only=True)
    return bigints(extract.rank_material_lines(docs, "doc_id"), "candidates", "score")


@query(
    "r1_top_material_line_sheets",
    f"{SHEET_BASE}, {O.LINE_TABLE}, {O.CANDIDATES} {_TOP_MATERIAL.format(key='sheet_id')}",
)
def r1_top_material_line_sheets(spark, sf_dir):
    return _top_material(raw_sheets(spark, sf_dir), "sheet_id")


# --- word lists from a table, one vocabulary per document ------------------------
_OWN_WORD = (
    "CASE WHEN words IS NULL THEN {usual} "
    "ELSE len(list_filter(words, lambda w: contains(lower(line), w))) > 0 END"
).format(usual=O.holds("lower(line)", V.material_keywords))
_VOCABULARY_LINES = (
    f"{DOC_BASE}, {O.LINE_TABLE}, {inputs.VOCABULARY_WORDS_SQL}, own_lines AS ("
    f"SELECT k, line, line_no, {O.material_score('line', _OWN_WORD)} AS score FROM line_table "
    "JOIN (SELECT doc_id AS k, lang FROM documents) USING (k) LEFT JOIN language_lists USING (lang))"
)


def _documents_with_word_lists(spark, sf_dir):
    return attach_vocabulary(
        raw_documents(spark, sf_dir, keep=("lang",)),
        inputs.vocabulary_words(spark, sf_dir),
        vocabulary="lang",
        spread_by="doc_id",
    )


@query(
    "t15_material_score_vocabularies",
    f"{_VOCABULARY_LINES} SELECT k AS doc_id, CAST(line_no AS BIGINT) AS line_no, "
    "CAST(score AS BIGINT) AS score FROM own_lines",
)
def t15_material_score_vocabularies(spark, sf_dir):
    docs = _documents_with_word_lists(spark, sf_dir)
    own = vocabulary_of(F.col("word_lists"))
    lines = line_table.line_property_table(docs, "doc_id", vocab=own)
    return bigints(line_table.material_line_scores(lines, "doc_id"), "line_no", "score")


@query(
    "r1_top_material_line_vocabularies",
    f"{_VOCABULARY_LINES}, own_candidates AS (SELECT * FROM own_lines "
    f"WHERE {O.candidate('lower(line)')}), own_top AS (SELECT k, line, score FROM own_candidates "
    "QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, line_no) = 1), "
    "own_counts AS (SELECT k, count(*) AS n FROM own_candidates GROUP BY k) "
    "SELECT k AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS candidates, "
    "CAST(score AS BIGINT) AS score, line "
    "FROM lists LEFT JOIN own_counts USING (k) LEFT JOIN own_top USING (k) WHERE passed",
)
def r1_top_material_line_vocabularies(spark, sf_dir):
    docs = _documents_with_word_lists(spark, sf_dir).where(F.col("raw_text").isNotNull())
    own = vocabulary_of(F.col("word_lists"))
    best = extract.rank_material_lines(docs, "doc_id", "word_lists", vocab=own)
    return bigints(best.drop("word_lists"), "candidates", "score")


_TOP_DESCRIPTION = (
    "SELECT k AS {key}, CAST(n AS BIGINT) AS viable_lines, CAST(score AS BIGINT) AS score, "
    "CAST(line_no AS BIGINT) AS line_no, description FROM top_description JOIN viable USING (k)"
)


def _top_description(docs: DataFrame, key: str) -> DataFrame:
    return line_table.top_description_lines(docs, key).select(
        key, "viable_lines", F.col("score").cast("bigint").alias("score"),
        F.col("line_no").cast("bigint").alias("line_no"), "description",
    )


@query(
    "r2_description_lines",
    f"{DOC_BASE}, {O.LINE_TABLE}, m AS (SELECT k, lines[1] AS material_type FROM lists), "
    f"{O.scored_lines('m')} SELECT k AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS viable_lines, "
    "CAST(best AS BIGINT) AS score, description FROM lists "
    "LEFT JOIN (SELECT k, max(score) AS best FROM scored GROUP BY k) USING (k) "
    "LEFT JOIN viable USING (k) LEFT JOIN top_description USING (k) WHERE passed",
)
def r2_description_lines(spark, sf_dir):
    docs = raw_documents(spark, sf_dir, passed_only=True).withColumn(
        "material_type", F.get(meaningful_lines(F.col("raw_text")), F.lit(0))
    )
    return bigints(extract.rank_description_lines(docs, "doc_id"), "viable_lines", "score")


@query(
    "r2_description_lines_sheets",
    f"{SHEET_BASE}, {O.LINE_TABLE}, m AS (SELECT k, lines[1] AS material_type FROM lists), "
    f"{O.scored_lines('m')} {_TOP_DESCRIPTION.format(key='sheet_id')}",
)
def r2_description_lines_sheets(spark, sf_dir):
    docs = raw_sheets(spark, sf_dir).withColumn(
        "material_type", F.get(meaningful_lines(F.col("raw_text")), F.lit(0))
    )
    return _top_description(docs, "sheet_id")


@query(
    "a3_viable_lines",
    f"{DOC_EXTRACTION} SELECT k AS doc_id, CAST(coalesce(n_viable, 0) AS BIGINT) AS viable_lines "
    "FROM extracted WHERE status = 'ok'",
)
def a3_viable_lines(spark, sf_dir):
    viable = extract.viable_lines(F.col("_scored"))
    counted = document_steps(spark, sf_dir).select(
        "doc_id", "status", viable.cast("bigint").alias("viable_lines")
    )
    return evaluate_once(counted).where(F.col("status") == schemas.OK).drop("status")


@query(
    "a4_candidate_count",
    f"{SHEET_BASE}, {O.LINE_TABLE}, {O.CANDIDATES} SELECT k AS sheet_id, "
    "CAST(coalesce(n, 0) AS BIGINT) AS candidates FROM lists LEFT JOIN candidate_counts "
    "USING (k) WHERE raw_text IS NOT NULL",
)
def a4_candidate_count(spark, sf_dir):
    lines = F.filter(
        split_lines(F.col("raw_text")),
        lambda x: has_word(x) & scoring.is_candidate(F.lower(x)),
    )
    return raw_sheets(spark, sf_dir, passed_only=True).select(
        "sheet_id", F.size(lines).cast("bigint").alias("candidates")
    )


@query(
    "a5_damage_score",
    "WITH d AS (SELECT doc_id, replace(replace(text, 'é', 'â€“'), 'ü', 'Ã') AS t FROM documents) "
    f"SELECT doc_id, CAST({O.damage_score('t')} AS BIGINT) AS score FROM d",
)
def a5_damage_score(spark, sf_dir):
    broken = documents(spark, sf_dir).withColumn(
        "t", F.expr("replace(replace(text, 'é', 'â€“'), 'ü', 'Ã')")
    )
    return broken.select(
        "doc_id", mojibake.damage_score(F.col("t")).cast("bigint").alias("score")
    )


# --- cascades and extraction ---------------------------------------------------
@query(
    "t17_material_cascade",
    f"{O.material_ctes(O.SHEETS, SHEET_CHARS)} SELECT k AS sheet_id, material_step AS step, "
    "material_type FROM material",
)
def t17_material_cascade(spark, sf_dir):
    return sheet_steps(spark, sf_dir).select(
        "sheet_id", extract.material_step().alias("step"), "material_type"
    )


@query(
    "t18_description_cascade",
    f"{SHEET_EXTRACTION} SELECT k AS sheet_id, description_step AS step, description "
    "FROM extracted",
)
def t18_description_cascade(spark, sf_dir):
    return sheet_steps(spark, sf_dir).select(
        "sheet_id", extract.description_step().alias("step"), "description"
    )


_EXTRACTED = "status, error, md5(raw_text) AS raw_md5, material_type, description"


@query("t19_extract_documents", f"{DOC_EXTRACTION} SELECT k AS doc_id, {_EXTRACTED} FROM extracted")
def t19_extract_documents(spark, sf_dir):
    return extract.extract_fields(documents(spark, sf_dir), keep=("doc_id",)).select(
        "doc_id", "status", "error", md5("raw_text").alias("raw_md5"),
        "material_type", "description",
    )


@query("t19_extract_sheets", f"{SHEET_EXTRACTION} SELECT k AS sheet_id, {_EXTRACTED} FROM extracted")
def t19_extract_sheets(spark, sf_dir):
    return extract.extract_fields(
        sheets(spark, sf_dir), min_chars=SHEET_CHARS, keep=("sheet_id",)
    ).select(
        "sheet_id", "status", "error", md5("raw_text").alias("raw_md5"),
        "material_type", "description",
    )


@query(
    "t20_parse_documents",
    f"{DOC_EXTRACTION} SELECT path AS source_path, status, material_type, description, "
    f"CASE WHEN status = 'non_text' THEN {O.scan_message('path')} ELSE error END AS message, "
    f"{O.exit_code('status')} AS exit_code FROM extracted",
)
def t20_parse_documents(spark, sf_dir):
    return workflows.parse_documents(documents(spark, sf_dir)).select(
        "source_path", "status", "material_type", "description", "message", "exit_code"
    )


@query(
    "p4_missing_fields",
    f"{O.material_ctes(O.SHEETS, SHEET_CHARS)} SELECT k AS sheet_id, "
    "CASE WHEN material_type IS NULL THEN 'material_type' ELSE '' END AS missing FROM material",
)
def p4_missing_fields(spark, sf_dir):
    return sheet_steps(spark, sf_dir).select(
        "sheet_id",
        F.array_join(extract.missing_fields(F.col("material_type")), ",").alias("missing"),
    )


@query(
    "p5_missing_error",
    f"{O.material_ctes(O.SHEETS, SHEET_CHARS)} SELECT k AS sheet_id, CASE WHEN material_type "
    "IS NULL THEN 'Missing required fields: material_type' END AS error FROM material",
)
def p5_missing_error(spark, sf_dir):
    missing = extract.missing_fields(F.col("material_type"))
    return sheet_steps(spark, sf_dir).select(
        "sheet_id", extract.missing_fields_error(missing).alias("error")
    )


# --- diagnostics ---------------------------------------------------------------
def _note(*parts: str) -> str:
    return " || ".join(parts)


_SECTION_NOTE = "'activated only for Polish product sheets with ''Opis produktu'''"
_EVENTS = f"""{SHEET_EXTRACTION},
shown AS (
  SELECT k, string_agg({O.preview('line', 40)}, '; ' ORDER BY line_no) FILTER (rn <= 3)
    || CASE WHEN max(rn) > 3 THEN '; ...' ELSE '' END AS shown
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY line_no) AS rn FROM candidates)
  GROUP BY k),
e AS (SELECT * FROM extracted LEFT JOIN shown USING (k) WHERE passed),
all_events AS (
  SELECT k, 1 AS seq, 'material_type' AS field_name, 'labeled_extraction' AS step_name,
    CASE WHEN ml IS NULL THEN 'not_matched' ELSE 'matched' END AS status,
    ml IS NOT NULL AS matched, {O.preview('ml')} AS value_preview,
    CAST(NULL AS VARCHAR) AS note FROM e
  UNION ALL SELECT k, 2, 'material_type', 'section_extraction',
    CASE WHEN title IS NULL THEN 'not_matched' ELSE 'matched' END, title IS NOT NULL,
    {O.preview('title')}, {_SECTION_NOTE} FROM e WHERE ml IS NULL
  UNION ALL SELECT k, 3, 'material_type', 'fallback_candidates', 'found', true, shown,
    {_note('n_candidates', "' candidate(s)'")}
    FROM e WHERE ml IS NULL AND title IS NULL AND n_candidates > 0
  UNION ALL SELECT k, 4, 'material_type', 'fallback_selection',
    CASE WHEN material_type IS NULL THEN 'no_candidates' ELSE 'selected' END,
    material_type IS NOT NULL, {O.preview('material_type')},
    CASE WHEN declared IS NOT NULL THEN 'selected declaration product identifier'
      WHEN material_type IS NULL THEN 'no fallback candidates available'
      ELSE {_note("'selected highest-ranked candidate of '", 'n_candidates', "' (score '",
                  'top_score', "')'")} END
    FROM e WHERE ml IS NULL AND title IS NULL
  UNION ALL SELECT k, 5, 'required_fields', 'missing_required_fields',
    CASE WHEN material_type IS NULL THEN 'failed' ELSE 'ok' END, material_type IS NOT NULL, NULL,
    CASE WHEN material_type IS NULL THEN 'missing required fields: material_type'
      ELSE 'all required fields present' END FROM e
  UNION ALL SELECT k, 6, 'description', 'labeled_extraction',
    CASE WHEN dl IS NULL THEN 'not_matched' ELSE 'matched' END, dl IS NOT NULL,
    {O.preview('dl')}, NULL FROM e WHERE material_type IS NOT NULL
  UNION ALL SELECT k, 7, 'description', 'section_extraction',
    CASE WHEN body IS NULL THEN 'not_matched' ELSE 'matched' END, body IS NOT NULL,
    {O.preview('body')}, {_SECTION_NOTE} FROM e WHERE material_type IS NOT NULL AND dl IS NULL
  UNION ALL SELECT k, 8, 'description', 'fallback_selection',
    'selected', true, {O.preview('description')},
    CASE WHEN ranked IS NULL THEN 'used normalized raw text' ELSE
      {_note("'selected highest-ranked candidate(s) from '", 'n_viable', "' line(s) (score '",
             'ranked_score', "')'")} END
    FROM e WHERE material_type IS NOT NULL AND dl IS NULL AND body IS NULL)"""


def _diagnosed(spark, sf_dir):
    return extract.extract_fields(
        sheets(spark, sf_dir), min_chars=SHEET_CHARS, keep=("sheet_id",), diagnostics=True
    )


@query(
    "c5_events",
    f"{_EVENTS} SELECT k AS sheet_id, CAST(row_number() OVER (PARTITION BY k ORDER BY seq) - 1 "
    "AS BIGINT) AS event_no, field_name, step_name, status, matched, value_preview, note "
    "FROM all_events",
)
def c5_events(spark, sf_dir):
    return explode_events(_diagnosed(spark, sf_dir), "sheet_id").withColumn(
        "event_no", F.col("event_no").cast("bigint")
    )


@query(
    "c6_warnings",
    f"{O.material_ctes(O.SHEETS, SHEET_CHARS)} SELECT k AS sheet_id, CASE WHEN passed AND "
    "material_type IS NULL THEN 'Missing required fields: material_type' ELSE '' END AS warnings "
    "FROM material",
)
def c6_warnings(spark, sf_dir):
    found = extract.extract_fields(
        sheets(spark, sf_dir), min_chars=SHEET_CHARS, keep=("sheet_id",), columns=("warnings",)
    )
    return found.select("sheet_id", F.array_join("warnings", "; ").alias("warnings"))


_REPR = (
    "CASE WHEN contains(value_preview, '''') AND NOT contains(value_preview, '\"') "
    "THEN '\"' || value_preview || '\"' "
    "ELSE '''' || replace(value_preview, '''', '\\''') || '''' END"
)


@query(
    "c7_diagnostics_text",
    f"{_EVENTS}, parts AS (SELECT k, seq, '- ' || concat_ws(' | ', "
    "field_name || '.' || step_name || ': ' || status, "
    "'matched=' || CASE WHEN matched THEN 'True' ELSE 'False' END, "
    f"'value=' || {_REPR}, 'note=' || note) AS line FROM all_events "
    "UNION ALL SELECT k, 9, '- warning: ' || error FROM extracted WHERE status = 'parse_error') "
    "SELECT k AS sheet_id, 'Parser diagnostics:' || chr(10) || "
    "string_agg(line, chr(10) ORDER BY seq) AS diagnostics FROM src LEFT JOIN parts USING (k) "
    "GROUP BY k",
)
def c7_diagnostics_text(spark, sf_dir):
    return _diagnosed(spark, sf_dir).select(
        "sheet_id",
        diagnostics_text(F.col("events"), F.col("warnings")).alias("diagnostics"),
    )


# --- paths ---------------------------------------------------------------------
@query(
    "p6_output_path",
    f"WITH {O.SHEETS} SELECT k AS sheet_id, coalesce(explicit_output, "
    f"{O.without_suffix('path')} || '.docx') AS output FROM src",
)
def p6_output_path(spark, sf_dir):
    return sheets(spark, sf_dir).select(
        "sheet_id",
        paths.output_path(F.col("source_path"), F.col("explicit_output")).alias("output"),
    )


@query(
    "p7_batch_output_path",
    f"WITH {O.SHEETS} SELECT k AS sheet_id, 'out/' || "
    f"{O.without_suffix(O.file_name('path'))} || '.docx' AS output FROM src",
)
def p7_batch_output_path(spark, sf_dir):
    return sheets(spark, sf_dir).select(
        "sheet_id", paths.batch_output_path(F.col("source_path"), "out").alias("output")
    )


@query(
    "p7_shared_outputs",
    "SELECT 'out/' || p_name || '.docx' AS output, count(*) AS documents FROM part "
    "GROUP BY 1 HAVING count(*) > 1",
)
def p7_shared_outputs(spark, sf_dir):
    parts = inputs.load(spark, sf_dir, "part")
    path = F.concat(F.lit("in/"), F.col("p_partkey"), F.lit("/"), F.col("p_name"), F.lit(".pdf"))
    return reports.shared_outputs(
        parts.select(paths.batch_output_path(path, "out").alias("output"))
    )


@query(
    "c3_path_suffix",
    f"WITH files AS ({inputs.CONTEXT_FILES_SQL}) SELECT path, {O.suffix('path')} AS suffix "
    "FROM files",
)
def c3_path_suffix(spark, sf_dir):
    return inputs.context_files(spark, sf_dir).select(
        "path", paths.suffix(F.col("path")).alias("suffix")
    )


# --- contexts and materials from JSON -------------------------------------------
_CONTEXTS = f"WITH {O.contexts_cte(schemas.CONTEXT_FIELDS)}"


def contexts(spark, sf_dir):
    return records.read_contexts(inputs.context_files(spark, sf_dir))


@query(
    "c2_context_validation",
    f"{_CONTEXTS} SELECT context_path, context_status AS status, context_error AS error "
    "FROM contexts",
)
def c2_context_validation(spark, sf_dir):
    return contexts(spark, sf_dir).select(
        "context_path",
        F.col("context_status").alias("status"),
        F.col("context_error").alias("error"),
    )


@query(
    "c2_event_props",
    "SELECT event_id, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN "
    "'Invalid or incomplete input data: k: Input should be a valid string; v: Field required' "
    "END AS error FROM events",
)
def c2_event_props(spark, sf_dir):
    fields = {"k": ("string", True), "v": ("string", True)}
    events = inputs.spread_if_set(inputs.load(spark, sf_dir, "events"))
    return events.select(
        "event_id",
        records.validation_message(
            records.field_errors(F.try_parse_json("props"), fields)
        ).alias("error"),
    )


@query(
    "s3_context_records",
    f"{_CONTEXTS} SELECT context_path, "
    + ", ".join(
        f"{O.text_of('json', name)} AS {name}"
        for name in schemas.CONTEXT_FIELDS
        if name != "attachments"
    )
    + f", array_to_string({O.list_of('json', 'attachments')}, ' | ') AS attachments "
    "FROM contexts WHERE context_status = 'ok'",
)
def s3_context_records(spark, sf_dir):
    usable = contexts(spark, sf_dir).where(F.col("context").isNotNull())
    return usable.select("context_path", "context.*").withColumn(
        "attachments", F.array_join("attachments", " | ")
    )


_MATERIALS = f"""WITH raw AS (
  SELECT p_partkey AS k, {inputs.MATERIAL_FILE_SQL} AS path, {inputs.MATERIAL_JSON_SQL} AS content
  FROM part),
valid AS (SELECT k, path, CASE WHEN json_valid(content) THEN content END AS content FROM raw),
problems AS (
  SELECT *, CASE WHEN content IS NULL THEN ['Invalid JSON']
    WHEN json_type(content) <> 'OBJECT' THEN ['Input should be an object']
    ELSE {O.field_errors(schemas.MATERIAL_FIELDS)} END AS errors FROM valid),
materials AS (
  SELECT *, CASE WHEN len(errors) > 0 THEN 'invalid_data' ELSE 'ok' END AS status,
    CASE WHEN len(errors) > 0 THEN {O.message('errors')} END AS error FROM problems)"""


def materials(spark, sf_dir):
    return records.read_materials(inputs.material_files(spark, sf_dir))


@query(
    "s4_material_records",
    f"{_MATERIALS} SELECT path, {O.text_of('content', 'source_path')} AS source_path, "
    f"{O.text_of('content', 'raw_text')} AS raw_text, "
    f"{O.text_of('content', 'material_type')} AS material_type, "
    f"{O.text_of('content', 'description')} AS description, "
    f"array_to_string({O.list_of('content', 'attachments')}, ' | ') AS attachments "
    "FROM materials WHERE status = 'ok'",
)
def s4_material_records(spark, sf_dir):
    usable = materials(spark, sf_dir).where(F.col("material").isNotNull())
    return usable.select("path", "material.*").withColumn(
        "attachments", F.array_join("attachments", " | ")
    )


@query("c4_validation_message", f"{_MATERIALS} SELECT path, status, error FROM materials")
def c4_validation_message(spark, sf_dir):
    return materials(spark, sf_dir).select("path", "status", "error")


# --- contexts and templates on documents ----------------------------------------
@query(
    "j2_context_resolution",
    f"{_CONTEXTS}, {O.SHEETS}, {O.RESOLVED} SELECT k AS sheet_id, context_path, context_status, "
    f"context_error, {O.text_of('json', 'investor_name')} AS investor_name FROM resolved",
)
def j2_context_resolution(spark, sf_dir):
    docs = sheets(spark, sf_dir).select("sheet_id", "source_path", "explicit_context")
    return resolve_contexts(
        docs, contexts(spark, sf_dir), explicit_path="explicit_context"
    ).select(
        "sheet_id", "context_path", "context_status", "context_error", "context.investor_name"
    )


@query(
    "j2_needed_contexts",
    f"{_CONTEXTS}, {O.SHEETS}, {O.RESOLVED} SELECT k AS sheet_id, context_path, context_status, "
    f"context_error, {O.text_of('json', 'investor_name')} AS investor_name FROM resolved",
)
def j2_needed_contexts(spark, sf_dir):
    """Like ``j2_context_resolution``, from the files themselves: only asked ones are parsed."""
    docs = sheets(spark, sf_dir).select("sheet_id", "source_path", "explicit_context")
    known = needed_contexts(
        docs, inputs.context_files(spark, sf_dir), explicit_path="explicit_context"
    )
    return resolve_contexts(docs, known, explicit_path="explicit_context").select(
        "sheet_id", "context_path", "context_status", "context_error", "context.investor_name"
    )


@query(
    "j2_context_of_documents",
    f"{_CONTEXTS}, src AS (SELECT doc_id AS k, {inputs.DOCUMENT_PATH_SQL} AS path, "
    f"CAST(NULL AS VARCHAR) AS explicit_context FROM documents), {O.RESOLVED} "
    "SELECT k AS doc_id, context_path, context_status, context_error FROM resolved",
)
def j2_context_of_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source_path")
    return resolve_contexts(docs, contexts(spark, sf_dir)).select(
        "doc_id", "context_path", "context_status", "context_error"
    )


_SHARED_KEY = f"src{inputs.DEFAULT_CONTEXT_KEY + 2}/context.json"


@query(
    "j1_shared_context",
    f"{_CONTEXTS} SELECT doc_id, {O.text_of('c.json', 'project_title')} AS project_title "
    f"FROM documents, contexts c WHERE c.context_path = '{_SHARED_KEY}'",
)
def j1_shared_context(spark, sf_dir):
    one = contexts(spark, sf_dir).where(F.col("context_path") == _SHARED_KEY)
    return attach_context(documents(spark, sf_dir).select("doc_id"), one).select(
        "doc_id", "context.project_title"
    )


@query(
    "j3_template_lookup",
    f"WITH {O.SHEETS}, t AS ({inputs.TEMPLATES_SQL}) SELECT k AS sheet_id, "
    "CASE WHEN t.template_path IS NULL THEN 'template_not_found' ELSE 'ok' END AS status, "
    "CASE WHEN t.template_path IS NULL THEN 'Template not found: ' || s.template_path END AS error "
    "FROM src s LEFT JOIN t USING (template_path)",
)
def j3_template_lookup(spark, sf_dir):
    docs = sheets(spark, sf_dir).select("sheet_id", "source_path", "template_path")
    found = template_ops.attach_templates(docs, inputs.templates(spark, sf_dir))
    missing = F.col("template").isNull()
    return found.select(
        "sheet_id",
        F.when(missing, schemas.TEMPLATE_NOT_FOUND).otherwise(schemas.OK).alias("status"),
        F.when(missing, template_ops.template_missing_error(F.col("template_path"))).alias("error"),
    )


# --- approvals -------------------------------------------------------------------
_CHOSEN = (
    f"CASE WHEN len({O.list_of('c.json', 'attachments')}) > 0 "
    f"THEN {O.list_of('c.json', 'attachments')} ELSE {O.list_of('m.content', 'attachments')} END"
)
# A material and the context of the folder its number falls into.
_MATERIAL_CONTEXT_SQL = "concat('src', CAST(p_partkey % 11 AS STRING), '/context.json')"
_PAIRED = (
    f"{_CONTEXTS}, {_MATERIALS.removeprefix('WITH ')}, paired AS (SELECT m.path, m.content, "
    f"m.status, m.error, concat('src', CAST(m.k % 11 AS VARCHAR), '/context.json') AS wanted, "
    f"c.context_path, c.context_status, c.context_error, c.json, {_CHOSEN} AS chosen "
    "FROM materials m LEFT JOIN contexts c ON c.context_path = "
    "concat('src', CAST(m.k % 11 AS VARCHAR), '/context.json')), "
    "judged AS (SELECT *, CASE WHEN status <> 'ok' THEN status "
    "ELSE coalesce(context_status, 'context_error') END AS final FROM paired)"
)


def _paired(spark, sf_dir):
    files = inputs.spread_widely(inputs.load(spark, sf_dir, "part")).selectExpr(
        f"{inputs.MATERIAL_FILE_SQL} AS path",
        f"{inputs.MATERIAL_JSON_SQL} AS content",
        f"{_MATERIAL_CONTEXT_SQL} AS context_path",
    )
    return records.read_materials(files, keep=("context_path",))


def _value_sql(name: str) -> str:
    if name in schemas.CONTEXT_RENDER_FIELDS:
        return f"CASE WHEN final = 'ok' THEN {O.text_of('json', name)} END AS {name}"
    if name == "attachments_text":
        return f"CASE WHEN final = 'ok' THEN {O.numbered('chosen')} ELSE '—' END AS {name}"
    return f"{O.text_of('content', name)} AS {name}"


@query(
    "p8_approval",
    f"{_PAIRED} SELECT path, "
    + ", ".join(_value_sql(name) for name in schemas.RENDER_FIELDS)
    + " FROM judged WHERE final = 'ok'",
)
def p8_approval(spark, sf_dir):
    built = workflows.build_approval_records(_paired(spark, sf_dir), contexts(spark, sf_dir))
    return built.where(F.col("status") == schemas.OK).select("path", *schemas.RENDER_FIELDS)


@query(
    "c8_exit_code",
    f"{_PAIRED} SELECT path, final AS status, CASE WHEN final = 'ok' THEN 0 ELSE 1 END AS exit_code, "
    "CASE WHEN status <> 'ok' THEN error WHEN context_path IS NULL "
    "THEN 'Context file not found: ' || wanted ELSE context_error END AS error FROM judged",
)
def c8_exit_code(spark, sf_dir):
    built = workflows.build_approval_records(_paired(spark, sf_dir), contexts(spark, sf_dir))
    return built.select("path", "status", "exit_code", "error")


_OWN_LIST = "string_split(p_name, ' ')"
_GIVEN_LIST = "CASE WHEN p_size > 25 THEN [p_type, p_brand] ELSE [] END"


@query(
    "c1_attachment_choice",
    f"SELECT p_partkey, array_to_string(CASE WHEN len({_GIVEN_LIST}) > 0 THEN {_GIVEN_LIST} "
    f"ELSE {_OWN_LIST} END, ' | ') AS attachments FROM part",
)
def c1_attachment_choice(spark, sf_dir):
    given = F.when(F.col("p_size") > 25, F.array("p_type", "p_brand")).otherwise(
        F.array().cast("array<string>")
    )
    chosen = select_attachments(given, F.split("p_name", " "))
    return inputs.load(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(chosen, " | ").alias("attachments")
    )


_LETTERS = "list_filter(string_split(p_name, ' '), lambda w: length(w) > 4)"


@query(
    "t21_attachments_text",
    f"SELECT p_partkey, {O.numbered(_LETTERS)} AS attachments_text FROM part",
)
def t21_attachments_text(spark, sf_dir):
    words = F.filter(F.split("p_name", " "), lambda w: F.length(w) > 4)
    return inputs.load(spark, sf_dir, "part").select(
        "p_partkey", attachments_text(words).alias("attachments_text")
    )


# --- workflows ---------------------------------------------------------------------
_RENDER_VALUES = {
    name: (
        "coalesce(" + O.text_of("json", name) + ", '')"
        if name in schemas.CONTEXT_RENDER_FIELDS
        else O.numbered(O.list_of("json", "attachments"))
        if name == "attachments_text"
        else name
    )
    for name in schemas.RENDER_FIELDS
}
_GENERATED = f"""{SHEET_EXTRACTION}, {_CONTEXTS.removeprefix('WITH ')}, {O.RESOLVED},
t AS ({inputs.TEMPLATES_SQL}),
generated AS (
  SELECT x.*, r.context_path, r.json, t.template_text,
    CASE WHEN r.context_path IS NULL THEN 'context_error' WHEN x.status <> 'ok' THEN x.status
      WHEN r.context_status <> 'ok' THEN r.context_status
      WHEN t.template_path IS NULL THEN 'template_not_found' ELSE 'ok' END AS final,
    CASE WHEN r.context_path IS NULL THEN r.context_error
      WHEN x.status = 'non_text' THEN {O.scan_message('x.path')}
      WHEN x.status <> 'ok' THEN x.error WHEN r.context_status <> 'ok' THEN r.context_error
      WHEN t.template_path IS NULL THEN 'Template not found: ' || x.template_path END AS final_error
  FROM extracted x JOIN resolved r USING (k)
  LEFT JOIN t ON t.template_path = x.template_path)"""


def _generated(spark, sf_dir, render=True):
    return workflows.generate_approvals(
        sheets(spark, sf_dir),
        contexts(spark, sf_dir),
        inputs.templates(spark, sf_dir),
        explicit_context="explicit_context",
        explicit_output="explicit_output",
        min_chars=SHEET_CHARS,
        render=render,
    )


@query(
    "t22_template_fill",
    f"{_GENERATED} SELECT path AS source_path, "
    f"{O.fill('template_text', _RENDER_VALUES)} AS rendered FROM generated WHERE final = 'ok'",
)
def t22_template_fill(spark, sf_dir):
    return _generated(spark, sf_dir).where(F.col("status") == schemas.OK).select(
        "source_path", "rendered"
    )


@query(
    "e2_generate",
    f"{_GENERATED} SELECT path AS source_path, final AS status, final_error AS error, "
    f"{O.exit_code('final')} AS exit_code, CASE WHEN final = 'ok' THEN coalesce(explicit_output, "
    f"{O.without_suffix('path')} || '.docx') END AS output, context_path FROM generated",
)
def e2_generate(spark, sf_dir):
    return _generated(spark, sf_dir, render=False)


_BATCH_TEMPLATE = "templates/NATION_3.txt"
_BATCH = f"""{DOC_EXTRACTION}, items AS (
  SELECT path AS pdf, CASE WHEN status = 'ok' THEN 'ok' ELSE 'error' END AS status,
    CASE WHEN status = 'ok' THEN 'out/' || {O.without_suffix(O.file_name('path'))} || '.docx' END
      AS output,
    error, CAST(NULL AS VARCHAR) AS reason
  FROM extracted)"""


def _batch(spark, sf_dir, template=_BATCH_TEMPLATE):
    one = contexts(spark, sf_dir).where(F.col("context_path") == _SHARED_KEY)
    return workflows.batch_documents(
        documents(spark, sf_dir),
        "out",
        context=one,
        templates=inputs.templates(spark, sf_dir),
        template_path=template,
        render=False,
    )


@query("a2_batch_items", f"{_BATCH} SELECT * FROM items")
def a2_batch_items(spark, sf_dir):
    return _batch(spark, sf_dir)


@query(
    "a1_batch_totals",
    f"{_BATCH} SELECT count(*) FILTER (status = 'ok') AS processed, "
    "count(*) FILTER (status = 'error') AS errors, "
    "count(*) FILTER (status = 'skipped') AS skipped FROM items",
)
def a1_batch_totals(spark, sf_dir):
    return reports.batch_totals(_batch(spark, sf_dir))


@query(
    "a2_batch_folder",
    f"{DOC_EXTRACTION}, {_FILES_SQL} SELECT name AS pdf, "
    "CASE WHEN kind = 'text' AND status = 'ok' THEN 'ok' ELSE 'error' END AS status, "
    f"CASE WHEN kind = 'text' AND status = 'ok' THEN 'out/' || {O.without_suffix('name')} "
    "|| '.docx' END AS output, "
    f"CASE WHEN kind = 'text' THEN error ELSE {_FILE_ERROR_SQL} END AS error, "
    "CAST(NULL AS VARCHAR) AS reason FROM files JOIN extracted USING (k)",
)
def a2_batch_folder(spark, sf_dir):
    folder = inputs.document_files(spark, sf_dir)
    items = workflows.batch_folder(
        spark,
        folder,
        "out",
        context=contexts(spark, sf_dir).where(F.col("context_path") == _SHARED_KEY),
        templates=inputs.templates(spark, sf_dir),
        template_path=_BATCH_TEMPLATE,
        render=False,
    )
    return items.withColumns({c: _named(c, folder) for c in ("pdf", "error")})


@query(
    "c9_batch_skip",
    f"SELECT {inputs.DOCUMENT_PATH_SQL} AS pdf, 'skipped' AS status, "
    "'batch generation not implemented (missing context/template)' AS reason FROM documents",
)
def c9_batch_skip(spark, sf_dir):
    return workflows.batch_documents(documents(spark, sf_dir), "out").select(
        "pdf", "status", "reason"
    )


@query(
    "c10_error_isolation",
    f"{DOC_EXTRACTION} SELECT path AS pdf, 'error' AS status, CASE WHEN status = 'ok' "
    "THEN 'Template not found: templates/absent.txt' ELSE error END AS error FROM extracted",
)
def c10_error_isolation(spark, sf_dir):
    return _batch(spark, sf_dir, "templates/absent.txt").select("pdf", "status", "error")


# --- sinks, written to the shared folder and read back ---------------------------
@query(
    "c11_scan_message",
    f"WITH {O.DOCUMENTS}, {O.gate(DOC_CHARS)} SELECT path AS source_path, "
    f"{O.scan_message('path')} AS message, gate_error AS error FROM gated WHERE NOT passed",
)
def c11_scan_message(spark, sf_dir):
    return quarantine(documents(spark, sf_dir)).select("source_path", "message", "error")


@query(
    "s5_json_records",
    f"{_CONTEXTS} SELECT context_path, {O.text_of('json', 'template_variant')} AS template_variant, "
    f"{O.text_of('json', 'prepared_by_role')} AS prepared_by_role, "
    f"array_to_string({O.list_of('json', 'attachments')}, ' | ') AS attachments "
    "FROM contexts WHERE context_status = 'ok'",
)
def s5_json_records(spark, sf_dir):
    usable = contexts(spark, sf_dir).where(F.col("context").isNotNull())
    rows = usable.select("context_path", "context.*")
    folder = run_folder(spark, "records")
    sinks.write_json_records(rows, folder)
    written = published_folder(spark, folder, "records")
    return spark.read.schema(rows.schema).json(written).select(
        "context_path", "template_variant", "prepared_by_role",
        F.array_join("attachments", " | ").alias("attachments"),
    )


@query(
    "s6_batch_report",
    f"{_BATCH}, totals AS (SELECT count(*) FILTER (status = 'ok') AS processed, "
    "count(*) FILTER (status = 'error') AS errors, 0 AS skipped FROM items) "
    "SELECT CAST(processed AS BIGINT) AS processed, CAST(errors AS BIGINT) AS errors, "
    "CAST(skipped AS BIGINT) AS skipped FROM totals",
)
def s6_batch_report(spark, sf_dir):
    folder = run_folder(spark, "report")
    items = _batch(spark, sf_dir)
    sinks.write_batch_report(items, folder)
    return sinks.read_batch_report(spark, folder, items.schema)[1]


@query(
    "s6_batch_report_items",
    f"{_BATCH} SELECT pdf, status, output, error, reason FROM items",
)
def s6_batch_report_items(spark, sf_dir):
    folder = run_folder(spark, "report")
    items = _batch(spark, sf_dir)
    sinks.write_batch_report(items, folder)
    return sinks.read_batch_report(spark, folder, items.schema)[0]


@query(
    "s7_quarantine",
    f"WITH {O.DOCUMENTS}, {O.gate(DOC_CHARS)} SELECT path AS source_path, "
    f"{O.dump_path('path')} AS dump_path, gate_text AS extracted_text FROM gated WHERE NOT passed",
)
def s7_quarantine(spark, sf_dir):
    folder = run_folder(spark, "quarantine")
    sinks.write_quarantine(quarantine(documents(spark, sf_dir)), folder)
    return spark.read.parquet(published_folder(spark, folder, "rejected"))


@query(
    "s8_render_rows",
    f"{_PAIRED} SELECT "
    + ", ".join(_value_sql(name) for name in schemas.RENDER_FIELDS)
    + " FROM judged WHERE final = 'ok'",
)
def s8_render_rows(spark, sf_dir):
    built = workflows.build_approval_records(_paired(spark, sf_dir), contexts(spark, sf_dir))
    folder = run_folder(spark, "render")
    sinks.write_render_rows(
        built.where(F.col("status") == schemas.OK).select(*schemas.RENDER_FIELDS), folder
    )
    return spark.read.parquet(published_folder(spark, folder, "rows"))
