"""The normalisation chain of a document text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldsift.functions.mojibake import may_need_repair, repair
from fieldsift.functions.text import (
    drop_invisible,
    join_stripped_lines,
    let,
    plain_stripped_lines,
    unify_breaks,
)
from fieldsift.vocab import DEFAULT_VOCABULARY, Vocabulary

# Any character outside these ranges may need more than splitting at LF: CR and
# other breaks, no-break spaces, byte-order marks.  Ranges keep the scan cheap.
UNUSUAL = r"[^\t\n\x1f-\x7e\x{a1}-\x{2027}\x{202a}-\x{fefe}\x{ff00}-\x{10ffff}]"


def normalize_text(text: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """Unified breaks, no invisible characters, repaired encoding, stripped lines.

    Texts without anything to unify or repair, the usual case, are only split.
    """
    cleaned = drop_invisible(unify_breaks(text))
    full = join_stripped_lines(let(cleaned, lambda t: repair(t, vocab)))
    special = F.rlike(text, F.lit(UNUSUAL)) | may_need_repair(text, vocab)
    return F.when(special, full).otherwise(F.array_join(plain_stripped_lines(text), "\n"))
