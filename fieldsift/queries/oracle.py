"""Checking SQL for the registered queries (DuckDB dialect).

The extraction is written here a second time, as relational SQL over a line table
(unnest, ranking with row_number), independent of the in-row expressions it checks.
The pieces are common table expressions that follow one another, so a check only
names the last one it needs.
"""

from __future__ import annotations

import re

from fieldsift.queries import inputs
from fieldsift.vocab import DEFAULT_VOCABULARY as V

SP = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BR = r"\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
WD = r"\p{L}\p{N}_"
PUNCT = "' .;:-'"
LF = "chr(10)"
ANY_LABEL = rf"^[{WD} /().\-]{{1,40}}[{SP}]*[:\-][{SP}]*[^{SP}]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '[{SP}]+', ' ', 'g')"


def punct(x: str) -> str:
    return f"trim({x}, {PUNCT})"


def cleaned(x: str) -> str:
    """Breaks unified, byte-order marks and no-break spaces gone."""
    crlf = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return f"replace(replace({crlf}, chr(65279), ''), chr(160), ' ')"


def table_repair(x: str) -> str:
    for broken, fixed in V.broken_sequences:
        x = f"replace({x}, {quote(broken)}, {quote(fixed)})"
    return x


def damage_score(x: str) -> str:
    counts = [
        f"((length({x}) - length(replace({x}, {quote(m)}, ''))) // {len(m)})"
        for m in V.damage_markers
    ]
    return "(" + " + ".join(counts) + ")"


def preview(x: str, limit: int = 80) -> str:
    c = strip(collapse(x))
    return (
        f"CASE WHEN length({c}) <= {limit} THEN {c} "
        f"ELSE substring({c}, 1, {limit - 3}) || '...' END"
    )


def holds(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(w)})" for w in words) + ")"


def prefixed(low: str) -> str:
    names = "|".join(re.escape(p).replace("\\ ", " ") for p in V.excluded_prefixes)
    return f"regexp_matches({low}, '^(?:{names})(?:$|[^{WD}])')"


def candidate(low: str) -> str:
    headers = ", ".join(quote(h) for h in V.excluded_headers)
    return f"({low} NOT IN ({headers}) AND NOT {prefixed(low)})"


def is_code(x: str) -> str:
    return f"(regexp_full_match({x}, '[A-Z0-9][A-Z0-9./+-]*') AND length({x}) <= 24)"


def is_upper(x: str) -> str:
    return (
        f"(regexp_matches({x}, '\\p{{Lu}}') AND NOT regexp_matches({x}, '[\\p{{Ll}}\\p{{Lt}}]'))"
    )


def _sum(*terms: tuple[str, int]) -> str:
    return " + ".join(f"CASE WHEN {cond} THEN {w} ELSE 0 END" for cond, w in terms)


def material_score(line: str, keyword: str | None = None) -> str:
    """``keyword``: SQL that says whether the lower-case line holds one, if not the usual."""
    low = f"lower({line})"
    words = f"len(regexp_extract_all({low}, '[{WD}]+'))"
    return "(" + _sum(
        (holds(low, V.noise_phrases), -12),
        (is_code(line), -8),
        (f"{is_upper(line)} AND {words} <= 3", -4),
        (f"length({line}) < 8", -3),
        (f"{words} >= 3", 4),
        (f"length({line}) >= 20", 3),
        (f"regexp_matches({line}, '\\p{{Ll}}')", 2),
        (keyword or holds(low, V.material_keywords), 5),
    ) + ")"


def description_score(line: str, material: str) -> str:
    low = f"lower({line})"
    words = f"len(regexp_extract_all({low}, '[{WD}]+'))"
    body = _sum(
        (holds(low, V.description_noise), -12),
        (prefixed(low), -10),
        (is_code(line), -10),
        (f"{is_upper(line)} AND {words} <= 4", -5),
        (f"{low} = lower({material})", -8),
        (f"length({line}) < 12", -4),
        (f"{words} >= 5", 5),
        (f"length({line}) >= 35", 3),
        (f"regexp_matches({line}, '\\p{{Ll}}')", 2),
        (holds(low, V.description_keywords), 6),
    )
    return f"(CASE WHEN {words} = 0 THEN -20 ELSE {body} END)"


def earliest(low: str, markers: tuple[str, ...]) -> str:
    found = [f"nullif(strpos({low}, {quote(m)}), 0)" for m in markers]
    return found[0] if len(found) == 1 else f"least({', '.join(found)})"


def label_regex(labels: tuple[str, ...]) -> str:
    return rf"(?i)^(?:{'|'.join(labels)})[{SP}]*[:\-][{SP}]*(.+)$"


# --- sources: k, path, text, fixed (text after the second decoding, if it applies) ---
DOCUMENTS = f"""src AS (
  SELECT doc_id AS k, {inputs.DOCUMENT_PATH_SQL} AS path, text, CAST(NULL AS VARCHAR) AS fixed
  FROM documents)"""
SHEETS = f"""src AS (
  SELECT p_partkey AS k, {inputs.SHEET_PATH_SQL} AS path, {inputs.SHEET_TEXT_SQL} AS text,
         {inputs.SHEET_FIXED_SQL} AS fixed,
         {inputs.SHEET_EXPLICIT_SQL} AS explicit_context,
         {inputs.SHEET_TEMPLATE_SQL} AS template_path,
         {inputs.SHEET_OUTPUT_SQL} AS explicit_output
  FROM part)"""


def gate(min_chars: int) -> str:
    return f"""gated AS (
  SELECT *, length(gate_text) AS n_chars, length(gate_text) >= {min_chars} AS passed,
         CASE WHEN length(gate_text) < {min_chars} THEN 'PDF text too short: '
              || length(gate_text) || ' chars (min {min_chars}).' END AS gate_error
  FROM (SELECT *, {strip("coalesce(text, '')")} AS gate_text FROM src))"""


def normalized() -> str:
    repaired = f"coalesce(fixed, {table_repair(cleaned('gate_text'))})"
    lines = (
        f"list_filter(list_transform(regexp_split_to_array({repaired}, '[{BR}]'), "
        f"lambda x: {strip('x')}), lambda x: x <> '')"
    )
    return f"""norm AS (
  SELECT *, CASE WHEN passed THEN array_to_string({lines}, {LF}) END AS raw_text FROM gated),
lists AS (
  SELECT *, string_split(raw_text, {LF}) AS all_lines,
         list_filter(string_split(raw_text, {LF}), lambda x: regexp_matches(x, '[{WD}]')) AS lines
  FROM norm)"""


def label(name: str, labels: tuple[str, ...], source: str) -> str:
    """CTE ``name``: k and value of the first labelled line with its continuations."""
    pattern = label_regex(labels)
    ends = (
        f"(NOT regexp_matches(x, '^[\\p{{Ll}}\\p{{Nd}}²³¹(/+]') "
        f"OR regexp_matches(x, '{ANY_LABEL}') OR regexp_matches(x, '{pattern}'))"
    )
    joined = (
        f"array_to_string(list_concat([regexp_extract(all_lines[pos], '{pattern}', 1)], "
        f"CASE WHEN stop IS NULL THEN rest ELSE rest[1:stop - 1] END), ' ')"
    )
    return f"""{name}_at AS (
  SELECT k, all_lines, list_position(
    list_transform(all_lines, lambda x: regexp_matches(x, '{pattern}')), true) AS pos
  FROM {source}),
{name}_rest AS (
  SELECT k, all_lines, pos, all_lines[pos + 1:] AS rest, list_position(
    list_transform(all_lines[pos + 1:], lambda x: {ends}), true) AS stop
  FROM {name}_at WHERE pos > 0),
{name} AS (
  SELECT k, pos, nullif({punct(collapse(joined))}, '') AS value FROM {name}_rest)"""


def sections() -> str:
    marker = V.section_markers[0]
    return f"""section_at AS (
  SELECT k, {punct(collapse("substring(raw_text, 1, hit - 1)"))} AS title,
         substring(raw_text, hit + {len(marker)}) AS body
  FROM (SELECT k, raw_text, {earliest('lower(raw_text)', V.section_markers)} AS hit FROM lists)
  WHERE hit IS NOT NULL),
section AS (
  SELECT k,
    nullif({punct(f"substring(title, 1, coalesce({earliest('lower(title)', V.title_stops)} - 1, length(title)))")}, '') AS title,
    nullif({punct(collapse(f"substring(body, 1, coalesce({earliest('lower(body)', V.section_stops)} - 1, length(body)))"))}, '') AS body
  FROM section_at)"""


def declaration() -> str:
    skipped = " OR ".join(
        f"starts_with(lower(x), {quote(p)})" for p in V.declaration_skipped_prefixes
    )
    return f"""declared AS (
  SELECT k, coalesce(
    list_filter(lines[1:5], lambda x: NOT ({holds('lower(x)', V.noise_phrases)} OR {skipped}
      OR contains(x, ':')))[1],
    nullif({punct(f"regexp_extract(list_filter(lines[1:10], lambda x: starts_with(lower(x), {quote(V.declaration_code_prefix)}))[1], ':(.*)$', 1)")}, '')
  ) AS value
  FROM lists
  WHERE len(list_filter(lines[1:5],
        lambda x: contains(lower(x), {quote(V.declaration_phrase)}))) > 0)"""


LINE_TABLE = """line_table AS (
  SELECT k, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM lists)"""

CANDIDATES = f"""candidates AS (
  SELECT k, line, line_no FROM line_table WHERE {candidate('lower(line)')}),
candidate_counts AS (SELECT k, count(*) AS n FROM candidates GROUP BY k),
top_material AS (
  SELECT k, line, line_no, score FROM (
    SELECT k, line, line_no, {material_score('line')} AS score FROM candidates)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, line_no) = 1)"""

MATERIAL = """material AS (
  SELECT l.*, ml.value AS ml, s.title, s.body, d.value AS declared, c.n AS n_candidates,
         t.line AS top_line, t.score AS top_score,
         coalesce(ml.value, s.title, d.value, t.line) AS material_type,
         CASE WHEN ml.value IS NOT NULL THEN 'label' WHEN s.title IS NOT NULL THEN 'section'
              WHEN d.value IS NOT NULL THEN 'declaration'
              WHEN t.line IS NOT NULL THEN 'ranked' END AS material_step
  FROM lists l LEFT JOIN ml USING (k) LEFT JOIN section s USING (k)
  LEFT JOIN declared d USING (k) LEFT JOIN candidate_counts c USING (k)
  LEFT JOIN top_material t USING (k))"""


def scored_lines(material_source: str = "material") -> str:
    return f"""scored AS (
  SELECT k, line, line_no, {description_score('line', 'material_type')} AS score
  FROM line_table JOIN (SELECT k, material_type FROM {material_source}) USING (k)),
viable AS (SELECT k, count(*) AS n FROM scored WHERE score > 0 GROUP BY k),
top_description AS (
  SELECT a.k, a.line_no, a.score, {punct(collapse(
      f"concat_ws(' ', {punct('a.line')}, {punct('b.line')})"))} AS description
  FROM (SELECT * FROM scored WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, line_no) = 1) a
  LEFT JOIN scored b ON b.k = a.k AND b.line_no = a.line_no + 1 AND b.score >= 9)"""


def extracted(min_chars: int) -> str:
    head = f"substring({strip(collapse('raw_text'))}, 1, 280)"
    return f"""{scored_lines()},
extracted AS (
  SELECT m.*, dl.value AS dl, t.description AS ranked, t.score AS ranked_score, v.n AS n_viable,
    CASE WHEN material_type IS NOT NULL THEN coalesce(dl.value, m.body, t.description,
         nullif({head}, ''), {quote(V.description_placeholder)}) END AS description,
    CASE WHEN material_type IS NULL THEN NULL WHEN dl.value IS NOT NULL THEN 'label'
         WHEN m.body IS NOT NULL THEN 'section' WHEN t.description IS NOT NULL THEN 'ranked'
         WHEN raw_text = '' THEN 'placeholder' ELSE 'raw_text' END AS description_step,
    CASE WHEN NOT passed THEN 'non_text' WHEN material_type IS NULL THEN 'parse_error'
         ELSE 'ok' END AS status,
    CASE WHEN NOT passed THEN gate_error WHEN material_type IS NULL
         THEN 'Missing required fields: material_type' END AS error
  FROM material m LEFT JOIN dl USING (k) LEFT JOIN top_description t USING (k)
  LEFT JOIN viable v USING (k))"""


def base(source: str, min_chars: int) -> str:
    return f"WITH {source},\n{gate(min_chars)},\n{normalized()}"


def material_ctes(source: str, min_chars: int) -> str:
    return ",\n".join(
        [
            base(source, min_chars), label("ml", V.material_labels, "lists"), sections(),
            declaration(), LINE_TABLE, CANDIDATES, MATERIAL,
        ]
    )


def extraction(source: str, min_chars: int) -> str:
    return ",\n".join(
        [
            material_ctes(source, min_chars),
            label("dl", V.description_labels, "lists"),
            extracted(min_chars),
        ]
    )


def exit_code(status: str) -> str:
    return (
        f"CASE {status} WHEN 'ok' THEN 0 WHEN 'non_text' THEN 2 "
        f"WHEN 'context_error' THEN 3 ELSE 1 END"
    )


def suffix(path: str) -> str:
    return f"lower(regexp_extract({path}, '[^/](\\.[^./]+)$', 1))"


def without_suffix(path: str) -> str:
    return f"regexp_replace({path}, '([^/])\\.[^./]+$', '\\1')"


def file_name(path: str) -> str:
    return f"regexp_extract({path}, '[^/]*$')"


def folder(path: str) -> str:
    return f"regexp_extract({path}, '^(.*)/[^/]*$', 1)"


def dump_path(path: str) -> str:
    return f"({without_suffix(path)} || '_extracted.txt')"


def scan_message(path: str) -> str:
    return (
        "('PDF wygląda na skan (brak warstwy tekstowej).' || chr(10) || "
        "'Zeskanuj do PDF z OCR / użyj wersji programu z OCR (planowane).' || chr(10) || "
        f"'Zapisano podgląd ekstrakcji: ' || {dump_path(path)})"
    )


# --- JSON records -----------------------------------------------------------------
def _string_check(name: str, required: bool, nullable: bool) -> str:
    kind = f"json_type(content, '$.{name}')"
    accepted = "('VARCHAR', 'NULL')" if nullable else "('VARCHAR')"
    wrong = f"WHEN {kind} NOT IN {accepted} THEN '{name}: Input should be a valid string'"
    missing = f"WHEN {kind} IS NULL THEN '{name}: Field required'" if required else ""
    return f"[CASE {missing} {wrong} END]"


def _list_check(name: str) -> str:
    kind = f"json_type(content, '$.{name}')"
    items = f"json_extract(content, '$.{name}[*]')"
    return (
        f"CASE WHEN {kind} IS NULL THEN [] WHEN {kind} <> 'ARRAY' "
        f"THEN ['{name}: Input should be a valid list'] ELSE list_transform({items}, "
        f"lambda x, i: CASE WHEN json_type(x) <> 'VARCHAR' "
        f"THEN '{name}.' || (i - 1) || ': Input should be a valid string' END) END"
    )


def field_errors(fields: dict) -> str:
    checks = [
        _list_check(n) if kind == "strings" else _string_check(n, required, kind == "optional")
        for n, (kind, required) in fields.items()
    ]
    return f"list_filter(list_concat({', '.join(checks)}), lambda e: e IS NOT NULL)"


def message(errors: str) -> str:
    return f"('Invalid or incomplete input data: ' || array_to_string({errors}, '; '))"


def contexts_cte(fields: dict) -> str:
    return f"""files AS ({inputs.CONTEXT_FILES_SQL}),
valid_json AS (
  SELECT path, CASE WHEN json_valid(content) THEN content END AS content,
         {suffix('path')} AS kind FROM files),
checked AS (
  SELECT *, json_type(content) = 'OBJECT' AS is_object,
    CASE WHEN json_type(content) = 'OBJECT' THEN {field_errors(fields)} END AS errors
  FROM valid_json),
contexts AS (
  SELECT path AS context_path, content AS json, errors,
    CASE WHEN kind IN ('.yaml', '.yml') THEN 'PyYAML is not installed. Install the yaml extra.'
         WHEN kind <> '.json' THEN 'Unsupported context format: ' || kind
         WHEN content IS NULL THEN 'Invalid JSON context file.'
         WHEN NOT is_object THEN 'Context data must be a mapping.' END AS load_error,
    CASE WHEN load_error IS NOT NULL THEN 'context_error'
         WHEN len(errors) > 0 THEN 'invalid_data' ELSE 'ok' END AS context_status,
    CASE WHEN load_error IS NOT NULL THEN load_error
         WHEN len(errors) > 0 THEN {message('errors')} END AS context_error
  FROM checked)"""


def text_of(json: str, name: str) -> str:
    return f"json_extract_string({json}, '$.{name}')"


def list_of(json: str, name: str) -> str:
    return f"coalesce(CAST(json_extract({json}, '$.{name}') AS VARCHAR[]), [])"


def numbered(items: str) -> str:
    return (
        f"CASE WHEN len({items}) = 0 THEN '—' ELSE array_to_string(list_transform({items}, "
        f"lambda x, i: i || '. ' || x), chr(10)) END"
    )


NO_CONTEXT = (
    "'Context file not found. Add context.json next to the PDF or run the command "
    "from a folder containing context.json.'"
)

RESOLVED = f"""resolved AS (
  SELECT s.k, s.path, coalesce(f.context_path, s.explicit_context) AS context_path,
    coalesce(f.context_status, 'context_error') AS context_status,
    CASE WHEN f.context_path IS NOT NULL THEN f.context_error
         WHEN s.explicit_context IS NOT NULL
         THEN 'Context file not found: ' || s.explicit_context
         ELSE {NO_CONTEXT} END AS context_error,
    CASE WHEN f.context_status = 'ok' THEN f.json END AS json
  FROM src s
  LEFT JOIN contexts e ON e.context_path = s.explicit_context
  LEFT JOIN contexts n ON n.context_path = {folder('s.path')} || '/context.json'
  LEFT JOIN contexts w ON w.context_path = 'context.json'
  LEFT JOIN contexts f ON f.context_path = CASE
    WHEN s.explicit_context IS NOT NULL THEN e.context_path
    WHEN n.context_path IS NOT NULL THEN n.context_path ELSE w.context_path END)"""


def fill(template: str, values: dict[str, str]) -> str:
    names = {n: "{{ " + n + " }}" for n in values}
    names["investor_name"] = "{{investor_name}}"
    out = f"replace({template}, '{{{{ unknown_name }}}}', '')"
    for name, placeholder in names.items():
        out = f"replace({out}, {quote(placeholder)}, {values[name]})"
    return out
