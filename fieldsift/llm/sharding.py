"""Shards along a Hilbert curve over several metadata columns, for file pruning.

Each dimension is cut into ``2**BITS`` cells at its own quantiles, strings by the bytes
after the prefix that all of them share.  The curve index of a row's cells orders the
rows, and equal runs of that order are the shards: rows near each other in every dimension
share a shard, so the ranges of each column that a shard holds are narrow.

Native: DataFrame and SQL functions only.  Texts are read once and never shuffled.

Defined results: null values of a dimension are in cell 0; a null text has size 16 and the
crc32 of the empty text; ties on the curve go by hash, so any number of rows may share a
cell; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsift.llm.common import numbered, parts, stored

SHARDS = 40
BITS = 4
DIMENSIONS = ("lang", "source", "n_chars")
ROW_BYTES = 16
ROWS_A_SLICE = 200_000
ACCURACY = 1000


def _as_number(column: str, kind: T.DataType, prefix: Column) -> Column:
    """An order-keeping number: the value itself, or the next seven bytes of a string."""
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.col(column).cast("timestamp").cast("double")
    text = F.col(column).cast("string").cast("binary")
    rest = F.substring(F.hex(text), F.lit(2) * prefix + 1, F.lit(14))
    return F.conv(F.rpad(rest, 14, "0"), 16, 10).cast("double")


def _shared_prefix(column: str) -> Column:
    """Bytes that all strings share: those shared by the least and the greatest."""
    low, high = (F.hex(f(F.col(column).cast("string").cast("binary"))) for f in (F.min, F.max))
    both = F.sequence(F.lit(0), F.least(F.length(low), F.length(high)).cast("int"), F.lit(2))
    alike = F.filter(both, lambda n: F.substring(low, F.lit(1), n) == F.substring(high, F.lit(1), n))
    return F.coalesce(F.array_max(alike) / 2, F.lit(0)).cast("int")


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Distance along the Hilbert curve of a point with these cell numbers.

    The axes are turned level by level from the highest bit, then Gray-decoded, and their
    bits interleaved.
    """
    n = len(cells)
    point = F.array(*[c.cast("long") for c in cells])

    def set_at(x: Column, values: dict[int, Column]) -> Column:
        return F.array(*[values.get(i, x[i]) for i in range(n)])

    def level(x: Column, q: Column) -> Column:
        low = q - 1

        def turned_by(i: int):
            def turn(y: Column, _: Column) -> Column:
                swap = y[0].bitwiseXOR(y[i]).bitwiseAND(low)
                swapped = {0: y[0].bitwiseXOR(swap), i: y[i].bitwiseXOR(swap)} if i else {}
                return F.when(
                    y[i].bitwiseAND(q) != 0, set_at(y, {0: y[0].bitwiseXOR(low)})
                ).otherwise(set_at(y, swapped))

            return turn

        for i in range(n):
            # A fold over one element evaluates what comes before it once.
            x = F.aggregate(F.array(F.lit(i)), x, turned_by(i))
        return x

    levels = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
    turned = F.aggregate(levels, point, level) if bits > 1 else point

    def decoded(x: Column) -> Column:
        values = [x[0]]
        for i in range(1, n):
            values.append(x[i].bitwiseXOR(values[-1]))
        flip = F.aggregate(
            levels if bits > 1 else F.array().cast("array<long>"),
            F.lit(0).cast("long"),
            lambda t, q: F.when(values[-1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
        )
        return F.array(*[v.bitwiseXOR(flip) for v in values])

    def joined(x: Column) -> Column:
        taken = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                taken = F.shiftleft(taken, 1) + F.shiftright(x[i], b).bitwiseAND(F.lit(1))
        return taken

    once = F.aggregate(F.array(F.lit(0)), turned, lambda x, _: decoded(x))
    return F.aggregate(
        F.array(once), F.lit(0).cast("long"), lambda _, x: joined(x)
    )


def _cell(bounds: list[float], value: Column) -> Column:
    """How many of the bounds are below the value."""
    array = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    return F.size(F.filter(array, lambda bound: bound < value))


def located(
    docs: DataFrame,
    dimensions: tuple[str, ...] = DIMENSIONS,
    bits: int = BITS,
    row: Column | None = None,
) -> DataFrame:
    """One small stored row per document: id, size, crc32, dimensions and curve index.

    ``row`` is a number that tells the rows apart; without it they get one.
    """
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            (F.monotonically_increasing_id() if row is None else row).alias("row"),
            *[F.col(d).alias(f"d{i}") for i, d in enumerate(dimensions)],
        ),
        "shard_rows",
    )
    keys = [f"d{i}" for i in range(len(dimensions))]
    strings = [k for k, d in zip(keys, dimensions, strict=True) if isinstance(kinds[d], T.StringType)]
    prefixes = rows.agg(F.lit(0).alias("_"), *[_shared_prefix(k).alias(k) for k in strings]).first()
    numbers = {
        k: _as_number(k, kinds[d], F.lit(prefixes[k] if k in strings else 0))
        for k, d in zip(keys, dimensions, strict=True)
    }
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    quantiles = rows.agg(
        *[F.percentile_approx(x, steps, ACCURACY).alias(k) for k, x in numbers.items()]
    ).first()
    cells = []
    for k, x in numbers.items():
        bounds = sorted(quantiles[k] or [])
        cells.append(F.coalesce(_cell(bounds, x), F.lit(0)))
    return rows.withColumn("curve", hilbert_index(cells, bits).cast("int"))


def sharded(
    docs: DataFrame,
    shards: int = SHARDS,
    dimensions: tuple[str, ...] = DIMENSIONS,
    bits: int = BITS,
    row: Column | None = None,
) -> DataFrame:
    """Every row with its shard and slot; the counts of shards differ by one at most."""
    rows = located(docs, dimensions, bits, row)
    total = rows.count()
    ranked = numbered(rows, "curve", ["text_crc32", "row"], parts(total, ROWS_A_SLICE, 64))
    # One row a curve index, 2 ** (bits * dimensions) at most.
    runs = rows.groupBy("curve").agg(F.count(F.lit(1)).alias("n"))
    before = runs.selectExpr("curve", "sum(n) OVER (ORDER BY curve) - n AS before")
    placed = ranked.join(F.broadcast(before), "curve").withColumn(
        "place", F.col("before") + F.col("rank")
    )
    return placed.selectExpr(
        "doc_id",
        "size",
        "text_crc32",
        "'rows' AS law",
        f"CAST(place * {shards} div {max(total, 1)} AS INT) AS shard",
        f"CAST(place - (place * {shards} div {max(total, 1)} * {total} + {shards - 1}) div {shards}"
        " AS BIGINT) AS slot",
        "CAST(NULL AS INT) AS grown_shard",
        "curve",
        "row",
        *[f"d{i} AS dim_{d}" for i, d in enumerate(dimensions)],
    )


def ranges(placed: DataFrame) -> DataFrame:
    """Per shard, rows, bytes and the range of every dimension: what a reader prunes by."""
    dimensions = [c for c in placed.columns if c.startswith("dim_")]
    return placed.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("size").alias("bytes"),
        *[f(c).alias(f"{f.__name__}_{c[4:]}") for c in dimensions for f in (F.min, F.max)],
    )


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int = SHARDS,
    dimensions: tuple[str, ...] = DIMENSIONS,
    bits: int = BITS,
) -> None:
    """Write whole documents, a folder a shard, its files runs of the shard's slots.

    Rows get a stored number first and are placed by it, so null and repeated ids lose and
    repeat nothing.  The tasks take ranges of (shard, slot): a large shard is cut into as many
    files as its share of the partitions.  Other columns of ``docs`` are written as they are.
    """
    names = docs.columns
    whole = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.struct(*names).alias("document")
        ),
        "numbered_documents",
    )
    own = [F.col(f"document.`{c}`").alias(c) for c in dict.fromkeys(("doc_id", "text", *dimensions))]
    placed = sharded(
        whole.select(*own, F.col("row").alias("_row")), shards, dimensions, bits, F.col("_row")
    )
    rows = whole.join(placed.select("row", "shard", "slot"), "row").drop("row")
    (
        rows.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .select("document", "shard")
        .write.partitionBy("shard")
        .parquet(path)
    )
