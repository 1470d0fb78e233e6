"""Product identifier of a declaration of performance.

``lines`` is an array of structs ``(line, low)``: a meaningful line and its
lower-case form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldsift.functions.text import any_of, contains_any, none_if_empty, strip_punct
from fieldsift.vocab import DEFAULT_VOCABULARY, Vocabulary

TITLE_LINES = 5
CODE_LINES = 10


def declaration_identifier(lines: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    head = F.slice(lines, 1, TITLE_LINES)

    def is_title(row: Column) -> Column:
        skipped = any_of(
            [F.startswith(row["low"], F.lit(p)) for p in vocab.declaration_skipped_prefixes]
        )
        return ~(
            contains_any(row["low"], vocab.noise_phrases)
            | skipped
            | F.contains(row["line"], F.lit(":"))
        )

    def has_code(row: Column) -> Column:
        return F.startswith(row["low"], F.lit(vocab.declaration_code_prefix))

    title = F.get(F.filter(head, is_title), F.lit(0))["line"]
    code_line = F.get(F.filter(F.slice(lines, 1, CODE_LINES), has_code), F.lit(0))["line"]
    code = none_if_empty(strip_punct(F.regexp_extract(code_line, r"(?s):(.*)$", 1)))
    declared = F.exists(
        head, lambda row: F.contains(row["low"], F.lit(vocab.declaration_phrase))
    )
    return F.when(declared, F.coalesce(title, code))
