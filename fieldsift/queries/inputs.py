"""Input tables of the registered queries, derived from the given tables.

The given tables hold no product sheets, contexts or templates, so they are built
row by row from ``part``, ``supplier``, ``customer`` and ``nation``; every row of
the base table gives one row here.  The building expressions are plain SQL text
that Spark and the checking engine both understand, so both start from the same
input; what is computed from it is written separately on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldsift.operators.vocabularies import DEFAULT_NAME, vocabulary_table
from fieldsift.session import run_folder
from fieldsift.sources.documents import spread
from fieldsift.sources.listing import opened
from fieldsift.vocab import DEFAULT_VOCABULARY

SHEET_MIN_CHARS = 60


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sql_text(template: str) -> str:
    """SQL concat of a text with ``{column}`` gaps; the text holds no quotes or backslashes."""
    parts = []
    for chunk in template.split("{"):
        name, closed, rest = chunk.partition("}")
        if closed:
            parts.append(f"CAST({name} AS STRING)")
            chunk = rest
        if chunk:
            parts.append("'" + chunk + "'")
    return "concat(" + ", ".join(parts) + ")"


# One layout per kind of document the extraction distinguishes.
SHEET_LAYOUTS = (
    # labels
    "ARKUSZ WYROBU {p_partkey}\nDział dachów\n\nMaterial type: {p_name} insulation mat\n"
    "Description: Soft {p_name} mat laid under roof tiles.\n\n"
    "Manufacturer: {p_brand}\nOrder number: MT-{p_partkey}",
    # labels with continuation lines, across a blank line
    "KARTA PRODUKTU\nSpecyfikacja techniczna\nMATERIAL TYPE : {p_name} fire resistant\n"
    "insulation panel for facade\n\n{p_size} mm\n(grade {p_type})\nDescription - Lightweight "
    "{p_name} panel\n+ external wall assemblies.;\nCatalog no: FR-{p_partkey}",
    # a hyphenated line ends a value; the first label decides even when empty
    "Produkt: {p_name}\nfire-resistant panel {p_size}\nOpis: ---\n"
    "Opis: later label {p_partkey}\nDo montażu w rozdzielnicach {p_type} {p_name} stosowania.\n"
    "Na powierzchniach elewacyjnych w systemach ETICS {p_size}.",
    # sections on few lines
    "{p_name} płyta  {p_size} Europejska Ocena Techniczna: ETA-{p_partkey}\n"
    "Opis produktu Ogniochronne {p_name} płyty {p_size} mm, samonośne.\n"
    "Zastosowanie Płyty {p_type}\nDane techniczne Gęstość: {p_partkey} kg",
    # section without a title
    "Opis produktu {p_name} zaprawa {p_size}. Obróbka wiercenie\n"
    "{p_name} przewód {p_size} mm2 {p_type} do zastosowań\nTyp: {p_brand}",
    # declaration with a title
    "{p_name} EPS {p_size}\nDEKLARACJA WŁAŚCIWOŚCI UŻYTKOWYCH\nnr W{p_partkey}\n{p_brand}\n"
    "Niepowtarzalny kod identyfikacyjny typu wyrobu: {p_brand}/{p_partkey}\n"
    "Zamierzone zastosowanie: Izolacja {p_name} w budownictwie",
    # declaration with an identifier only
    "Deklaracja Właściwości Użytkowych\nNr 01-{p_partkey}\nNiepowtarzalny kod "
    "identyfikacyjny typu wyrobu: {p_brand} {p_name} {p_size}.\nZamierzone zastosowanie: "
    "Sucha mieszanka {p_name} do stosowania\nProducent: {p_brand} sp. z o.o.\n"
    "Norma: EN {p_partkey}",
    # product codes and a ranked line
    "ADC{p_partkey}D\nRCBO Wyłącznik różnicowoprądowy {p_name} 1P+N {p_size}A\nTyp AC\n"
    "Specyfikacja techniczna\nPrąd znamionowy {p_size}A",
    # no candidate at all
    "Manufacturer: {p_brand}\nDescription: {p_name} power cable for external use.\n"
    "Specyfikacja techniczna\nOpis: {p_name} kabel\nTyp: H{p_partkey}",
    # damage the replacement table repairs; byte-order mark and CRLF
    "\ufeffMaterial type: RCBO WyÅ‚Ä…cznik {p_name}\r\nDescription: Do montaÅ¼u"
    " w rozdzielnicach {p_size} â€” typ {p_type}.\r\n\r\nManufacturer: {p_brand}\r",
    # damage that only a second decoding repairs
    "Material type: {p_name} DÃ¤mmung fÃ¼r HÃ¶he {p_size}\n"
    "Description: GrÃ¶ÃŸe {p_size} Ã¼ber {p_type} fire board",
    # too short
    "  {p_name}\n{p_size} ",
    # unusual whitespace and line breaks
    "\t{p_name}\u00a0płyta\u2003{p_size}\u3000\x0b\x0cPRĄD {p_size}\u2028\u00a0\u00a0\n"
    "\x85Do mocowania\u2009 płyt {p_type} i zatapiania siatki.\x1cAM-{p_partkey}\r\r\n---\n*",
    # nothing but punctuation
    "---- ---- ---- ---- ----\n.... .... .... .... ....\n**** **** **** **** ****\n!!!! ????",
    # two good lines, ties, repeated lines
    "KARTA MATERIALOWA\nFR-{p_size}\n{p_name} mortar {p_type} for walls\n"
    "{p_name} mortar {p_type} for walls\nPRODUKT\nDane techniczne {p_partkey}\n"
    "Bezpieczeństwo\n{p_partkey}",
)
# Layout whose damage is repaired by the second decoding, and the repaired text.
REDECODED_LAYOUT = 10
REDECODED_TEXT = (
    "Material type: {p_name} Dämmung für Höhe {p_size}\n"
    "Description: Größe {p_size} über {p_type} fire board"
)

SHEET_LAYOUT_SQL = f"p_partkey % {len(SHEET_LAYOUTS)}"
SHEET_TEXT_SQL = (
    f"CASE {SHEET_LAYOUT_SQL} "
    + " ".join(f"WHEN {i} THEN {_sql_text(t)}" for i, t in enumerate(SHEET_LAYOUTS))
    + " END"
)
SHEET_FIXED_SQL = (
    f"CASE WHEN {SHEET_LAYOUT_SQL} = {REDECODED_LAYOUT} THEN {_sql_text(REDECODED_TEXT)} END"
)
# Folder of the sheet, with and without a suffix on the file.
SHEET_PATH_SQL = (
    "concat('src', CAST(p_partkey % 23 AS STRING), '/sheet-', "
    "CAST(p_partkey AS STRING), CASE WHEN p_partkey % 7 = 0 THEN '' "
    "WHEN p_partkey % 7 = 1 THEN '.v2.PDF' ELSE '.pdf' END)"
)
SHEET_EXPLICIT_SQL = (
    "CASE WHEN p_partkey % 5 = 0 THEN concat('shared/', "
    "CAST(p_partkey % 1900 AS STRING), '.json') END"
)
SHEET_TEMPLATE_SQL = (
    "concat('templates/NATION_', CAST(p_partkey % 25 AS STRING), '.txt')"
)
SHEET_OUTPUT_SQL = (
    "CASE WHEN p_partkey % 6 = 0 THEN concat('custom/', "
    "CAST(p_partkey AS STRING), '.docx') END"
)
DOCUMENT_PATH_SQL = "concat(source, '/doc-', CAST(doc_id AS STRING), '.pdf')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source_path, text, lang, source`` of every document."""
    return spread_if_set(load(spark, sf_dir, "documents")).selectExpr(
        "doc_id", f"{DOCUMENT_PATH_SQL} AS source_path", "text", "lang", "source"
    )


# What is in the folder for a document: a text, a text with a byte that is no UTF-8, or a folder.
FILE_KIND_SQL = "CASE doc_id % 6 WHEN 4 THEN 'bytes' WHEN 5 THEN 'folder' ELSE 'text' END"
# Hidden names, and one that does not match ``*.pdf``.
FILE_NAME_SQL = (
    "concat(CASE doc_id % 6 WHEN 1 THEN '_' WHEN 2 THEN '.' ELSE '' END, 'doc ', "
    "CAST(doc_id AS STRING), CASE WHEN doc_id % 6 = 3 THEN '.PDF' ELSE '.pdf' END)"
)


def document_files(spark: SparkSession, sf_dir: str) -> str:
    """Write every document as a file of its own; the folder they are in."""
    folder = run_folder(spark, "files")
    rows = spread_if_set(load(spark, sf_dir, "documents")).selectExpr(
        f"{FILE_NAME_SQL} AS name", f"{FILE_KIND_SQL} AS kind", "coalesce(text, '') AS text"
    )

    def write(batches):
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == "folder":
                    store.create_dir(f"{root}/{row['name']}")
                    continue
                with store.open_output_stream(f"{root}/{row['name']}") as stream:
                    stream.write(row["text"].encode() + b"\xff" * (row["kind"] == "bytes"))
            yield batch.select(["name"])

    rows.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
    return folder


PARTITIONS_SETTING = "fieldsift.inputPartitions"


def spread_if_set(rows: DataFrame) -> DataFrame:
    """Rows dealt to as many partitions as the session asks for; off by default.

    For a benchmark over single files with one row group, which one task would read.
    """
    partitions = rows.sparkSession.conf.get(PARTITIONS_SETTING, None)
    return spread(rows, int(partitions)) if partitions else rows


#: Tasks for each core, so that slow ones do not leave cores waiting at the end.
TASKS_A_CORE = 4


def spread_widely(rows: DataFrame) -> DataFrame:
    """Rows dealt to several tasks for each core, unless the table has as many splits already.

    For tables of short rows that texts or files are built from.  Seven million rows of
    ``part`` are 65 MB, one split, and as texts the work of one task for half an hour.
    """
    session = rows.sparkSession
    if session.conf.get(PARTITIONS_SETTING, None):
        return spread_if_set(rows)
    wanted = TASKS_A_CORE * session.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= wanted else spread(rows, wanted)


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sheet_id, source_path, text, explicit_context, template_path, explicit_output``."""
    return spread_widely(load(spark, sf_dir, "part")).selectExpr(
        "p_partkey AS sheet_id",
        f"{SHEET_PATH_SQL} AS source_path",
        f"{SHEET_TEXT_SQL} AS text",
        f"{SHEET_EXPLICIT_SQL} AS explicit_context",
        f"{SHEET_TEMPLATE_SQL} AS template_path",
        f"{SHEET_OUTPUT_SQL} AS explicit_output",
    )


def _json_fields(who: str, key: str, without: tuple[str, ...] = (), **changed: str) -> str:
    """SQL text of a context's JSON; ``changed`` gives raw JSON for single fields."""
    fields = {
        "template_variant": '"wariant {key}"',
        "investor_name": '"{who}"',
        "project_title": '"Projekt {key} ł"',
        "contractor_name": '"Firma XYZ"',
        "manufacturer": '"{who} Electric"',
        "estimated_quantity": '"{key} szt."',
        "planned_delivery_date": '"2026-05-10"',
        "planned_installation_date": '"2026-05-20"',
        "prepared_by_name": '"Jan Kowalski"',
        "prepared_by_role": '"Kierownik robót"',
        "attachments": '["Karta {key}", "Deklaracja zgodności"]',
        "unknown_field": "17",
    }
    fields.update(changed)
    body = ", ".join(f'"{k}": {v}' for k, v in fields.items() if k not in without)
    text = "concat('{" + body.replace("{who}", f"', {who}, '").replace(
        "{key}", f"', CAST({key} AS STRING), '"
    ) + "}')"
    return text


def context_json_sql(who: str, key: str) -> str:
    """Complete contexts and, by key, every kind of defect."""
    cases = (
        _json_fields(who, key, without=("manufacturer", "prepared_by_role")),
        _json_fields(who, key, investor_name="12.5", attachments='["a", 7, null, "b"]'),
        "concat('{\"investor_name\": \"', " + who + ", '\"')",
        "'[1, 2]'",
        _json_fields(
            who, key, project_title="null", template_variant="5", attachments='{"a": 1}'
        ),
        _json_fields(who, key, attachments="[]"),
        _json_fields(who, key, without=("attachments", "template_variant")),
        _json_fields(who, key, template_variant="null", output_dir='"out"'),
        "'null'",
        "''",
    )
    whens = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases))
    return f"CASE {key} % 17 {whens} ELSE {_json_fields(who, key)} END"


SUPPLIER_CONTEXT_PATH_SQL = (
    "concat('src', CAST(s_suppkey AS STRING), CASE s_suppkey % 13 WHEN 10 THEN "
    "'/context.YAML' WHEN 11 THEN '/context.txt' WHEN 12 THEN '/context' "
    "ELSE '/context.json' END)"
)
CUSTOMER_CONTEXT_PATH_SQL = "concat('shared/', CAST(c_custkey AS STRING), '.json')"
DEFAULT_CONTEXT_KEY = 5


def context_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content``: a context per supplier folder, per customer, and the default."""
    suppliers = spread_widely(load(spark, sf_dir, "supplier"))
    customers = spread_widely(load(spark, sf_dir, "customer"))
    content = context_json_sql("s_name", "s_suppkey")
    nearby = suppliers.selectExpr(
        f"{SUPPLIER_CONTEXT_PATH_SQL} AS path", f"{content} AS content"
    )
    shared = customers.selectExpr(
        f"{CUSTOMER_CONTEXT_PATH_SQL} AS path",
        f"{context_json_sql('c_name', 'c_custkey')} AS content",
    )
    default = suppliers.where(F.col("s_suppkey") == DEFAULT_CONTEXT_KEY).selectExpr(
        "'context.json' AS path", f"{content} AS content"
    )
    return nearby.unionByName(shared).unionByName(default)


CONTEXT_FILES_SQL = f"""
SELECT {SUPPLIER_CONTEXT_PATH_SQL} AS path,
       {context_json_sql('s_name', 's_suppkey')} AS content FROM supplier
UNION ALL
SELECT {CUSTOMER_CONTEXT_PATH_SQL},
       {context_json_sql('c_name', 'c_custkey')} FROM customer
UNION ALL
SELECT 'context.json', {context_json_sql('s_name', 's_suppkey')}
FROM supplier WHERE s_suppkey = {DEFAULT_CONTEXT_KEY}
"""

MATERIAL_JSON_CASES = (
    "'{\"material_type\": 5, \"description\": null, \"attachments\": \"x\"}'",
    "concat('{\"material_type\": \"', p_name, '\"}')",
    "'not json'",
    "'\"text\"'",
    "concat('{\"source_path\": null, \"material_type\": \"', p_name, "
    "'\", \"description\": \"opis ', p_type, '\", \"attachments\": [\"Spec A\", \"', p_brand, "
    "'\"]}')",
)
MATERIAL_JSON_SQL = (
    "CASE p_partkey % 9 "
    + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(MATERIAL_JSON_CASES))
    + " ELSE concat('{\"source_path\": \"in/', CAST(p_partkey AS STRING), "
    "'.pdf\", \"raw_text\": \"', p_name, '\", \"material_type\": \"', p_name, ' ', p_type, "
    "'\", \"description\": \"opis ', p_brand, '\"}') END"
)
MATERIAL_FILE_SQL = "concat('in/', CAST(p_partkey AS STRING), '.json')"


def material_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content, context_path``: a parsed material per part, some defective."""
    return spread_widely(load(spark, sf_dir, "part")).selectExpr(
        f"{MATERIAL_FILE_SQL} AS path",
        f"{MATERIAL_JSON_SQL} AS content",
    )


TEMPLATE_PATH_SQL = "concat('templates/', n_name, '.txt')"
TEMPLATE_TEXT_SQL = (
    "concat('Wniosek {{ project_title }} dla {{investor_name}}, ', n_name, ' $1: ', "
    "'{{ material_type }} / {{ manufacturer }} / {{ estimated_quantity }}\n', "
    "'{{ description }}{{ description }}\n{{ unknown_name }}', "
    "'{{ planned_delivery_date }} - {{ planned_installation_date }} {{ contractor_name }}\n', "
    "'{{ attachments_text }}\n{{ prepared_by_name }}, {{ prepared_by_role }}')"
)


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``template_path, template_text`` per nation; one region has none."""
    return (
        load(spark, sf_dir, "nation")
        .where(F.col("n_regionkey") != 4)
        .selectExpr(
            f"{TEMPLATE_PATH_SQL} AS template_path", f"{TEMPLATE_TEXT_SQL} AS template_text"
        )
    )


TEMPLATES_SQL = (
    f"SELECT {TEMPLATE_PATH_SQL} AS template_path, {TEMPLATE_TEXT_SQL} AS template_text "
    "FROM nation WHERE n_regionkey <> 4"
)


#: Vocabularies by language: the most frequent long words of its documents are keywords.
VOCABULARY_WORDS = 12
USUAL_LANGUAGE = "en"
LONG_WORD = "[a-z]{7,}"
LOWERED_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
VOCABULARY_WORDS_SQL = f"""language_words AS (
  SELECT lang, word FROM (
    SELECT lang, unnest(regexp_extract_all({LOWERED_SQL}, '{LONG_WORD}')) AS word
    FROM documents WHERE lang <> '{USUAL_LANGUAGE}')
  GROUP BY lang, word
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word)
    <= {VOCABULARY_WORDS}),
language_lists AS (SELECT lang, list(word) AS words FROM language_words GROUP BY lang)"""


def vocabulary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary table: the usual lists, and keywords of every other language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("lang") != USUAL_LANGUAGE)
    found = F.expr(f"explode(regexp_extract_all({LOWERED_SQL}, '{LONG_WORD}', 0))")
    counts = docs.select("lang", found.alias("word")).groupBy("lang", "word").count()
    place = F.row_number().over(
        Window.partitionBy("lang").orderBy(F.col("count").desc(), F.col("word"))
    )
    # Spark keeps the first few of each language before the exchange (WindowGroupLimit).
    words = counts.withColumn("place", place).where(F.col("place") <= VOCABULARY_WORDS)
    learned = words.select(
        F.col("lang").alias("vocabulary"), F.lit("material_keywords").alias("list"), "word"
    )
    folder = run_folder(spark, "vocabulary_words")
    learned.write.parquet(folder)
    usual = vocabulary_table(spark, {DEFAULT_NAME: DEFAULT_VOCABULARY})
    return usual.unionByName(spark.read.schema(learned.schema).parquet(folder))
