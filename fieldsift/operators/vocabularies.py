"""Word lists from a table, one vocabulary per document (language, supplier, …).

A vocabulary table has a row for each word: ``vocabulary, list, word``.  ``list`` is one of
``LISTS``, fields of ``Vocabulary``.  The words travel with the documents as arrays, so the
plan is the same whatever the words are, and one scan serves documents of all vocabularies.

Defined results: a list that a vocabulary has no word of is that of the default vocabulary;
a document whose vocabulary is null or not in the table has the default one; a repeated word
counts once; null words and lists of other names are left out.
"""

from __future__ import annotations

import dataclasses

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift.operators.lookup import DEFAULT_SALTS, lookup, only_row
from fieldsift.vocab import DEFAULT_VOCABULARY, Vocabulary

#: What candidate lines and their scores depend on.
LISTS = (
    "excluded_prefixes",
    "excluded_headers",
    "noise_phrases",
    "material_keywords",
    "description_noise",
    "description_keywords",
)
SCHEMA = "vocabulary string, list string, word string"
DEFAULT_NAME = "default"


@dataclasses.dataclass(frozen=True, eq=False)
class ColumnVocabulary(Vocabulary):
    """A vocabulary whose ``LISTS`` are array columns; equal only to itself."""

    __hash__ = object.__hash__

    def __eq__(self, other: object) -> bool:
        return self is other


def vocabulary_table(spark: SparkSession, vocabularies: dict[str, Vocabulary]) -> DataFrame:
    """The table of vocabularies that are known to the program."""
    rows = [
        (name, field, word)
        for name, vocab in vocabularies.items()
        for field in LISTS
        for word in getattr(vocab, field)
    ]
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))]
    # From Arrow it is a local relation, whose size Spark knows.
    return spark.createDataFrame(pa.table(columns, names=names))


def packed_vocabularies(words: DataFrame) -> DataFrame:
    """``vocabulary, lists``: a struct of arrays, null where a vocabulary has no list."""
    known = words.where(F.col("word").isNotNull() & F.col("vocabulary").isNotNull())
    arrays = [
        F.array_sort(F.collect_set(F.when(F.col("list") == name, F.col("word")))).alias(name)
        for name in LISTS
    ]
    packed = known.groupBy("vocabulary").agg(*arrays)
    return packed.select(
        "vocabulary",
        F.struct(*[F.when(F.size(n) > 0, F.col(n)).alias(n) for n in LISTS]).alias("lists"),
    )


def attach_vocabulary(
    docs: DataFrame,
    words: DataFrame,
    *,
    vocabulary: str,
    spread_by: str,
    default: str = DEFAULT_NAME,
    into: str = "word_lists",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Add the struct of word lists that the column ``vocabulary`` names.

    One row a vocabulary is joined.  Spark sends them to all tasks while the table is small,
    which it sees before the run if the table is made of files or a ``vocabulary_table``;
    beyond that, a vocabulary of very many documents is split by ``lookup``.
    """
    packed = packed_vocabularies(words)
    found = lookup(
        docs,
        packed.select(F.col("vocabulary").alias("_name"), F.col("lists").alias("_own")),
        key=F.col(vocabulary),
        dimension_key="_name",
        spread_by=F.col(spread_by),
        salts=salts,
    ).withColumn(
        "_usual", only_row(packed.where(F.col("vocabulary") == default), F.col("lists"))
    )
    empty = F.array().cast("array<string>")
    chosen = [F.coalesce(f"_own.{n}", f"_usual.{n}", empty).alias(n) for n in LISTS]
    return found.withColumn(into, F.struct(*chosen)).drop("_own", "_usual")


def vocabulary_of(lists: Column, usual: Vocabulary = DEFAULT_VOCABULARY) -> ColumnVocabulary:
    """A vocabulary that reads its ``LISTS`` from a struct column, the rest from ``usual``."""
    fields = {f.name: getattr(usual, f.name) for f in dataclasses.fields(Vocabulary)}
    return ColumnVocabulary(**fields | {name: lists[name] for name in LISTS})
