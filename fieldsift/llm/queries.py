"""The registered queries of the operators and their checking SQL.

Each query applies its operator, with production parameters, to its whole table and
derives flat columns from the result.  Where SQL cannot express an operator, the tests
compare it with a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift.llm import decontaminate, dedup, hard_negatives, language, license_scan
from fieldsift.llm import line_dedup, ngram_lm, packing, periodic, quality, setsketch, sharding
from fieldsift.llm import similarity
from fieldsift.llm.common import crc_class, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def held_out(modulus: int) -> F.Column:
    return F.coalesce(crc_class("doc_id", modulus) == 2, F.lit(False))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id"
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learned(docs, ~held_out(4))
    return language.identified(docs, model).select(
        "doc_id", held_out(4).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.drop("begins", "ends")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = dedup.decide(table(spark, sf_dir, "documents"))
    return decided.select(
        "doc_id",
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve"
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.cleaned(table(spark, sf_dir, "pages")).select(
        "page_id", "host", "n_lines", "n_dropped", F.md5("text").alias("text_md5")
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.scored(table(spark, sf_dir, "documents"), held_out(7))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learned(docs, table(spark, sf_dir, "labels"), ~held_out(4))
    return quality.scored(docs, model).select(
        "doc_id",
        held_out(4).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn(
        "label",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")),
    )
    return hard_negatives.mined(vectors, F.col("vec_id") % 100 == 0)


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def with_repetitions(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; a tenth of the texts repeat a part of their own words.

    With h the crc32 of the id and g = h div 10, texts with h % 10 = 0 keep their first
    a = g % n words and go on with the next p = 1 + (n - a) div (3 + g % 8) words again and
    again, up to their old length.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), _SPACES), lambda w: w != "")
    rows = (
        docs.select("doc_id", "text")
        .withColumn("h", F.crc32(F.col("doc_id").cast("string")))
        .withColumn("words", F.when(F.col("h") % 10 == 0, words))
        .withColumn("n", F.size("words").cast("long"))
        .selectExpr("*", "if(n > 0, (h div 10) % n, 0) AS a")
        .selectExpr("*", "1 + (n - a) div (3 + (h div 10) % 8) AS p")
    )
    repeated = (
        "concat(slice(words, 1, int(a)), slice(flatten(array_repeat("
        "slice(words, int(a) + 1, int(p)), int((n - a - 1) div p + 1))), 1, int(n - a)))"
    )
    return rows.selectExpr(
        "doc_id", f"if(n > 0, array_join({repeated}, ' '), text) AS text"
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_repetitions(table(spark, sf_dir, "documents")))
    # The longest run; of equal ones that with the least start, then the least period.
    best = F.array_max(
        F.transform(
            "runs",
            lambda r: F.struct(
                r["length"].alias("length"),
                (-r["start"]).alias("before"),
                (-r["period"]).alias("shorter"),
            ),
        )
    )
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.shorter")).alias("period"),
        F.expr("1000 * best.length div -best.shorter").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_SPACES = r"[\x20\x09-\x0D]+"
_LOWER = f"translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}')"


def _linked(size: int, percent: int, extra: str = "") -> str:
    """Groups of documents whose sets of ``size`` words in a row are similar."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '{_SPACES}'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {size} + 2),
      lambda i: array_to_string(ws[i:i + {size} - 1], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= {percent} * (max(a.n) + max(b.n) - count(*))),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, p.b FROM r JOIN p ON r.seen = p.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id{extra}
FROM s JOIN c ON c.node = s.doc_id"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _op4() -> str:
    window = decontaminate.WINDOW
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM benchmark),
v AS (
  SELECT DISTINCT item_id, least(len(ws), {window}) AS n,
    array_to_string(ws[k:k + least(len(ws), {window}) - 1], ' ') AS x
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {window} + 1, 1) + 1)) AS k
        FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM v),
g AS (
  SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS x
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k
        FROM d, sizes WHERE len(ws) >= n)),
h AS (SELECT doc_id, k, g.n, item_id FROM g JOIN v ON g.x = v.x AND g.n = v.n),
t AS (
  SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM (
    SELECT doc_id, k, unnest(range(0, n)) AS o FROM h) GROUP BY doc_id),
m AS (
  SELECT doc_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)"""


_OP5 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

_OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER)
    AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 5"""

_CRC = """
list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])),
    lambda r, k: xor(r >> 1, 3988292384 * (r & 1))))"""

#: Every pair of equal words at every lag, then stretches of pairs in a row.
_OP13 = f"""
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACES}'),
    lambda x: x <> '') AS old, xor({_CRC}, 4294967295) AS h FROM documents),
g AS (
  SELECT doc_id, old, len(old) AS n, h % 10 = 0 AND len(old) > 0 AS again,
    CASE WHEN len(old) > 0 THEN (h // 10) % len(old) END AS a, (h // 10) % 8 AS r FROM t),
ws AS (
  SELECT doc_id, k, CASE WHEN again AND k >= a
    THEN old[a + (k - a) % (1 + (n - a) // (3 + r)) + 1] ELSE old[k + 1] END AS w
  FROM (SELECT *, unnest(range(0, n)) AS k FROM g)),
m AS (
  SELECT x.doc_id, y.k - x.k AS q, y.k AS i,
    y.k - row_number() OVER (PARTITION BY x.doc_id, y.k - x.k ORDER BY y.k) AS island
  FROM ws x JOIN ws y ON x.doc_id = y.doc_id AND x.w = y.w AND x.k < y.k),
s AS (
  SELECT doc_id, q, min(i) - q AS b, max(i) + 1 AS e FROM m GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (
  SELECT * FROM s WHERE NOT EXISTS (
    SELECT 1 FROM s z WHERE z.doc_id = s.doc_id AND z.q < s.q AND z.b <= s.b AND z.e >= s.e)),
runs AS (
  SELECT doc_id, count(*) AS n_runs,
    sha256(string_agg(b || ',' || (e - b) || ',' || q || chr(10), '' ORDER BY b, q)) AS runs_sha256
  FROM r GROUP BY doc_id),
best AS (
  SELECT * FROM r
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY e - b DESC, b, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(b + q, e)) AS k FROM r),
kept AS (
  SELECT doc_id, sha256(string_agg(w, ' ' ORDER BY k)) AS collapsed_sha256
  FROM ws ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b AS start, e - b AS length, q AS period,
  1000 * (e - b) // q AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256,
  coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM g LEFT JOIN runs USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_ngram_jaccard_join,
        op3_language_id,
        op4_decontamination,
        op5_exact_dedup,
        op6_sharding,
        op7_license_scan,
        op8_line_dedup,
        op9_lm_scoring,
        op10_quality_classifier,
        op11_hard_negatives,
        op12_minhash_near_dedup,
        op13_periodic_runs,
    )
}
CHECKS: dict[str, str] = {
    "op2_ngram_jaccard_join": _linked(4, 85),
    "op4_decontamination": _op4(),
    "op5_exact_dedup": _OP5,
    "op7_license_scan": license_scan.oracle(),
    "op8_line_dedup": line_dedup.oracle(),
    "op11_hard_negatives": _OP11,
    "op12_minhash_near_dedup": _linked(5, 85, ", doc_id = component_id AS kept"),
    "op13_periodic_runs": _OP13,
}
