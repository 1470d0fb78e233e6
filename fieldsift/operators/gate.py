"""The text gate: documents without enough text are set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift.functions.paths import dump_path
from fieldsift.functions.text import strip

DEFAULT_MIN_CHARS = 200

# The message shown for a document that looks like a scan.
SCAN_DIAGNOSIS = "PDF wygląda na skan (brak warstwy tekstowej)."
SCAN_ADVICE = "Zeskanuj do PDF z OCR / użyj wersji programu z OCR (planowane)."
SCAN_DUMP_NOTE = "Zapisano podgląd ekstrakcji: "


def too_short_message(chars: Column, min_chars: int) -> Column:
    return F.concat(
        F.lit("PDF text too short: "), chars.cast("string"), F.lit(f" chars (min {min_chars}).")
    )


def text_gate(
    docs: DataFrame, *, text: str = "text", min_chars: int = DEFAULT_MIN_CHARS
) -> DataFrame:
    """Add ``gate_text`` (stripped), ``gate_chars``, ``gate_passed`` and ``gate_error``.

    A missing text counts as empty.  A narrow projection: nothing is shuffled and
    both branches stay in one plan.
    """
    stripped = docs.withColumns({"gate_text": F.coalesce(strip(F.col(text)), F.lit(""))})
    chars = F.length("gate_text")
    return stripped.withColumns(
        {
            "gate_chars": chars,
            "gate_passed": chars >= min_chars,
            "gate_error": F.when(chars < min_chars, too_short_message(chars, min_chars)),
        }
    )


def scan_diagnosis(dump: Column) -> Column:
    """C11: diagnosis, advice and, when a dump was planned, where it lies."""
    return F.concat_ws(
        "\n",
        F.lit(SCAN_DIAGNOSIS),
        F.lit(SCAN_ADVICE),
        F.concat(F.lit(SCAN_DUMP_NOTE), dump),
    )


def quarantine(
    docs: DataFrame,
    *,
    source_path: str = "source_path",
    text: str = "text",
    min_chars: int = DEFAULT_MIN_CHARS,
) -> DataFrame:
    """One row per rejected document with its dump path, text and message."""
    return (
        text_gate(docs, text=text, min_chars=min_chars)
        .where(~F.col("gate_passed"))
        .select(
            F.col(source_path).alias("source_path"),
            dump_path(F.col(source_path)).alias("dump_path"),
            F.col("gate_text").alias("extracted_text"),
            F.col("gate_error").alias("error"),
            scan_diagnosis(dump_path(F.col(source_path))).alias("message"),
        )
    )
