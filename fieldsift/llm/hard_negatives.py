"""Hard negatives of anchors, from candidate blocks in Hilbert order with zone maps.

Every row is a vector of whole numbers (``floor(scale * component)``) with a label; a score
is the inner product with an anchor, higher first, ties by smaller id.  An anchor's positives
are its best other rows of the same label.  For each positive of score ``p`` the hard
negatives are the best rows of other labels with ``low * p <= 100 * score <= 100 * p``.

*Blocks.*  Candidates are written once, as Parquet, ordered by label and then by their place
on a Hilbert curve over the dimensions of largest variance, each cut into cells around its
mean.  Runs of ``PAGE_ROWS`` rows are pages, runs of pages are blocks.  A page stores the
least and the greatest value of every dimension and of the label; a block's zone map is that
of its pages.  There are at most ``BLOCKS`` blocks whatever the table's size, so the zone maps
of the blocks, the only data that is broadcast, have at most ``BLOCKS * 8`` bytes for each
dimension.

*Bounds.*  For an anchor ``a`` and a zone, interval arithmetic gives a least and a greatest
score: in each dimension ``a * value`` lies between ``a * least`` and ``a * greatest``.  A
block is read for an anchor only if that interval meets one of the anchor's windows and the
labels allow a row that counts; inside a block the same bounds decide for each page.  For
positives the window reaches from the fifth best row near the anchor on the curve upwards,
for negatives it comes from the positives.  What is skipped cannot hold an answer.

*Work.*  Anchors travel to the blocks they need, in slices of ``SLICE_ANCHORS``, and a block's
rows to the slices that need it; a task streams a block's pages past one slice.  Each block
gives the best few rows for each anchor; a ranked window ends it.  Bounds skip much where
vectors cluster and little where they are spread evenly over many dimensions; then the work
is that of scoring all anchors against all rows, in blocks.

Defined results: rows without an id, a label or a vector, or with a null or non-finite
component, take no part, nor do rows whose squared length (after scaling) is not below 2^56,
as a hundred times their scores may not fit a long.  Missing components of a shorter vector count as 0; an
empty vector has score 0 with all.  Repeated rows are rows of their own, also as anchors; of
equal scores and ids the order is that of the stored rows.  A positive of negative score has
no window, so no negatives.  An anchor without positives gives no rows; an empty table none.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldsift.llm.common import parts, stored

SCALE = 256
LOW_PERCENT = 80
POSITIVES = 5
NEGATIVES = 5
PAGE_ROWS = 256
BLOCKS = 512
SLICE_ANCHORS = 1 << 16
PART_ROWS = 100_000
CURVE_DIMS, CURVE_BITS = 8, 7
CURVE_SPREAD = 3.0
_EXACT = float(1 << 52)
_SLACK = 2.0**-44
_AT_ONCE = 1 << 22

_ROW = (
    "block int, page long, row long, vec_id long, label long, anchor boolean, vector binary,"
    " least binary, greatest binary, label_low long, label_high long"
)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cell numbers below ``2 ** bits``."""
    x = [column.astype(np.int64) for column in cells.T]
    for step in range(bits - 1, 0, -1):
        below = (1 << step) - 1
        for k in range(len(x)):
            upper = (x[k] >> step & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[k]) & below)
            x[0] = x[0] ^ np.where(upper, below, swap)
            x[k] = x[k] ^ swap
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros(len(cells), np.int64)
    for step in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> step & 1, (1 << step) - 1, 0)
    place = np.zeros(len(cells), np.int64)
    for step in range(bits - 1, -1, -1):
        for column in x:
            place = place << 1 | ((column ^ turn) >> step & 1)
    return place


def _exact_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as int64; both sides int64."""
    a = anchors.astype(np.float64)
    b = rows.astype(np.float64)
    if len(a) and len(b) and (a * a).sum(1).max() * (b * b).sum(1).max() >= _EXACT**2:
        return anchors @ rows.T  # no product of rows leaves 64 bits
    return (a @ b.T).astype(np.int64)


def bounds(anchors: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval arithmetic: least and greatest score of each anchor in each zone."""
    up, down = np.maximum(anchors, 0).astype(np.float64), np.minimum(anchors, 0).astype(np.float64)
    least, greatest = least.astype(np.float64), greatest.astype(np.float64)
    slack = (up - down) @ np.maximum(np.abs(least), np.abs(greatest)).T * _SLACK
    low = up @ least.T + down @ greatest.T - slack
    return low, up @ greatest.T + down @ least.T + slack


def _matrix(column: pa.Array) -> np.ndarray:
    joined = np.frombuffer(b"".join(column.to_pylist()), np.int32)
    return joined.reshape(len(column), -1).astype(np.int64)


# ---- candidate blocks


def _whole(vectors: DataFrame, anchor, vec_id: str, label: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, label, anchor, vector array<int>) of the rows that take part."""
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{label}`").cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    squares = F.aggregate(
        "vector", F.lit(0.0), lambda s, x: s + F.pow(x * scale, F.lit(2.0))
    )
    return rows.where(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("vector").isNotNull()
        & F.coalesce(finite, F.lit(False))
        & (squares < float(1 << 56))
    ).withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).try_cast("int")))


def _blocks(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Stored candidates in Hilbert order with the zone of each page; dimensions, anchors."""
    total, wide, anchors = rows.agg(
        F.count(F.lit(1)), F.max(F.size("vector")), F.sum(F.col("anchor").cast("long"))
    ).first()
    dims = max(1, wide or 0)
    spread = (
        rows.select(F.posexplode("vector").alias("d", "x"))
        .groupBy("d")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev"))
        .orderBy(F.desc("dev"), "d")
        .limit(CURVE_DIMS)
        .collect()
    )
    which = [(r["d"], r["mean"], max(r["dev"] or 0.0, 0.5)) for r in spread]
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, parts(total, PART_ROWS))
    pages = parts(total, PAGE_ROWS * tasks)  # of a task, about

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            matrix = np.zeros((batch.num_rows, dims), np.int32)
            matrix[np.arange(dims)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
            cells = np.zeros((batch.num_rows, CURVE_DIMS), np.int64)
            for k, (d, mean, dev) in enumerate(which):
                part = (matrix[:, d] - mean) / (2 * CURVE_SPREAD * dev) + 0.5
                cells[:, k] = np.clip(part * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    pa.array(hilbert(cells, CURVE_BITS), pa.int64()),
                    pa.array([v.tobytes() for v in matrix], pa.binary()),
                ],
                ["vec_id", "label", "anchor", "place", "vector"],
            )

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        held = pa.table({})
        for batch in _with_end(batches):
            if batch is not None:
                more = pa.Table.from_batches([batch])
                held = pa.concat_tables([held, more]) if held.num_rows else more
            while held.num_rows >= PAGE_ROWS or (batch is None and held.num_rows):
                page, held = held.slice(0, PAGE_ROWS), held.slice(PAGE_ROWS)
                page = page.combine_chunks()
                many, number = page.num_rows, done // PAGE_ROWS
                block = (task * BLOCKS + min(BLOCKS - 1, number * BLOCKS // pages)) // tasks
                matrix = _matrix(page["vector"])
                labels = page["label"].to_numpy()
                first = [None] * (many - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(many, block), pa.int32()),
                        pa.array(np.full(many, task << 32 | number), pa.int64()),
                        pa.array(np.arange(done, done + many) | task << 40, pa.int64()),
                        page["vec_id"].combine_chunks(),
                        page["label"].combine_chunks(),
                        page["anchor"].combine_chunks(),
                        page["vector"].combine_chunks(),
                        pa.array([matrix.min(0).astype(np.int32).tobytes(), *first], pa.binary()),
                        pa.array([matrix.max(0).astype(np.int32).tobytes(), *first], pa.binary()),
                        pa.array([int(labels.min()), *first], pa.int64()),
                        pa.array([int(labels.max()), *first], pa.int64()),
                    ],
                    [field.split()[0] for field in _ROW.split(", ")],
                )
                done += many

    ordered = (
        rows.mapInArrow(placed, "vec_id long, label long, anchor boolean, place long, vector binary")
        .repartitionByRange(tasks, "label", "place", "vec_id", "vector")
        .sortWithinPartitions("label", "place", "vec_id", "vector")
    )
    return stored(ordered.mapInArrow(paged, _ROW), "blocks"), dims, anchors or 0


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


class Zones:
    """Zone maps of the blocks: at most ``BLOCKS`` rows."""

    def __init__(self, blocks: DataFrame, dims: int) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            merged: dict[int, list] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                least, greatest = _matrix(batch.column(1)), _matrix(batch.column(2))
                low, high = batch.column(3).to_numpy(), batch.column(4).to_numpy()
                for k, block in enumerate(batch.column(0).to_pylist()):
                    own = merged.setdefault(block, [least[k], greatest[k], low[k], high[k]])
                    own[0], own[1] = np.minimum(own[0], least[k]), np.maximum(own[1], greatest[k])
                    own[2], own[3] = min(own[2], low[k]), max(own[3], high[k])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(merged), pa.int32()),
                    pa.array([m[0].astype(np.int32).tobytes() for m in merged.values()], pa.binary()),
                    pa.array([m[1].astype(np.int32).tobytes() for m in merged.values()], pa.binary()),
                    pa.array([int(m[2]) for m in merged.values()], pa.int64()),
                    pa.array([int(m[3]) for m in merged.values()], pa.int64()),
                ],
                ["block", "least", "greatest", "label_low", "label_high"],
            )

        columns = ["block", "least", "greatest", "label_low", "label_high"]
        # A row for each block and task that holds a part of it.
        found = (
            blocks.where("least IS NOT NULL")
            .select(columns)
            .mapInArrow(
                run, "block int, least binary, greatest binary, label_low long, label_high long"
            )
            .toArrow()
        )
        self.block, at = np.unique(found["block"].to_numpy(), return_inverse=True)
        many = len(self.block)
        self.least = np.full((many, dims), np.iinfo(np.int64).max)
        self.greatest = np.full((many, dims), np.iinfo(np.int64).min)
        self.low = np.full(many, np.iinfo(np.int64).max)
        self.high = np.full(many, np.iinfo(np.int64).min)
        if many:
            np.minimum.at(self.least, at, _matrix(found["least"].combine_chunks()))
            np.maximum.at(self.greatest, at, _matrix(found["greatest"].combine_chunks()))
            np.minimum.at(self.low, at, found["label_low"].to_numpy())
            np.maximum.at(self.high, at, found["label_high"].to_numpy())


def _needed(anchors: np.ndarray, labels: np.ndarray, floor: np.ndarray, ceiling: np.ndarray,
            least: np.ndarray, greatest: np.ndarray, low: np.ndarray, high: np.ndarray,
            same: bool) -> np.ndarray:
    """For each anchor and zone, whether the zone may hold a row of the anchor's window."""
    lowest, highest = bounds(anchors, least, greatest)
    fits = (highest >= floor[:, None]) & (lowest <= ceiling[:, None])
    if same:
        return fits & (low[None, :] <= labels[:, None]) & (labels[:, None] <= high[None, :])
    return fits & ((low[None, :] != labels[:, None]) | (high[None, :] != labels[:, None]))


# ---- anchors and the blocks they need

_ANCHOR = "row long, vec_id long, label long, vector binary"
_WINDOWS = "floors array<long>, ceilings array<long>"
_LEAST, _MOST = -(1 << 62), 1 << 62


def _anchors(blocks: DataFrame) -> DataFrame:
    """Stored anchors with a floor for their positives: the fifth best row near them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False))
            if not len(own):
                continue
            labels, matrix = batch.column(2).to_numpy(), _matrix(batch.column(4))
            floors = []
            for some in np.array_split(own, len(own) // 256 + 1):
                near = slice(max(0, int(some[0]) - 2 * PAGE_ROWS), int(some[-1]) + 2 * PAGE_ROWS)
                scores = _exact_scores(matrix[some], matrix[near])
                scores[labels[some][:, None] != labels[near][None, :]] = _LEAST
                scores[np.arange(len(some)), some - near.start] = _LEAST
                if scores.shape[1] < POSITIVES:
                    floors += [_LEAST] * len(some)
                else:
                    floors += np.partition(scores, -POSITIVES, axis=1)[:, -POSITIVES].tolist()
            kept = batch.take(pa.array(own))
            yield pa.RecordBatch.from_arrays(
                [
                    kept.column(0),
                    kept.column(1),
                    kept.column(2),
                    kept.column(4),
                    pa.array([[f] for f in floors], pa.list_(pa.int64())),
                    pa.array([[_MOST]] * len(floors), pa.list_(pa.int64())),
                ],
                ["row", "vec_id", "label", "vector", "floors", "ceilings"],
            )

    return stored(
        blocks.select("row", "vec_id", "label", "anchor", "vector").mapInArrow(
            run, f"{_ANCHOR}, {_WINDOWS}"
        ),
        "anchors",
    )


def _edges(floors: pa.Array, ceilings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each anchor as matrices, filled up with empty ones."""
    many = max([1, *np.diff(floors.offsets.to_numpy()).tolist()])
    low = np.array([[*x, *[_MOST] * (many - len(x))] for x in floors.to_pylist()], np.int64)
    high = np.array([[*x, *[_LEAST] * (many - len(x))] for x in ceilings.to_pylist()], np.int64)
    return low.reshape(-1, many), high.reshape(-1, many)


def _meetings(anchors: DataFrame, blocks: DataFrame, zones: Zones, slices: int, same: bool) -> DataFrame:
    """Anchors and rows of the blocks they need, by block and slice, anchors first."""
    shared = anchors.sparkSession.sparkContext.broadcast(zones)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            floors, ceilings = _edges(batch.column(4), batch.column(5))
            need = _needed(
                _matrix(batch.column(3)), batch.column(2).to_numpy(), floors.min(1),
                ceilings.max(1), own.least, own.greatest, own.low, own.high, same,
            )
            lists = pa.array([own.block[row].tolist() for row in need], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists], [*batch.schema.names, "needs"]
            )

    chosen = stored(
        anchors.mapInArrow(choose, f"{_ANCHOR}, {_WINDOWS}, needs array<int>").select(
            "*",
            F.explode("needs").alias("block"),
            F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"),
        ).drop("needs"),
        "chosen",
    )
    wanted = chosen.select("block", "slice").distinct()
    rows = blocks.join(wanted, "block").select(
        "block", "slice", F.lit(1).alias("kind"), "page", "row", "vec_id", "label", "vector",
        F.lit(None).cast("array<long>").alias("floors"),
        F.lit(None).cast("array<long>").alias("ceilings"),
        "least", "greatest", "label_low", "label_high",
    )
    asked = chosen.select(
        "block", "slice", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("page"),
        "row", "vec_id", "label", "vector", "floors", "ceilings",
        *[F.lit(None).cast(t).alias(n) for n, t in (
            ("least", "binary"), ("greatest", "binary"), ("label_low", "long"), ("label_high", "long"),
        )],
    )
    return (
        asked.unionByName(rows)
        .repartition("block", "slice")
        .sortWithinPartitions("block", "slice", "kind", "page", "row")
    )


class Slice:
    """Some anchors and the best rows of one block for each of them, so far."""

    def __init__(self, rows: pa.Table, same: bool, keep: int) -> None:
        rows = rows.combine_chunks()
        self.row = rows["row"].to_numpy()
        self.label = rows["label"].to_numpy()
        self.vectors = _matrix(rows["vector"].combine_chunks())
        self.floors, self.ceilings = _edges(
            rows["floors"].combine_chunks(), rows["ceilings"].combine_chunks()
        )
        self.same, self.keep = same, keep
        self.hits: list[np.ndarray] = []
        self.held = 0
        self.page, self.need = None, None

    def add(self, rows: pa.Table) -> None:
        """Rows of one block, pages in a row; a page may go on in the next call."""
        rows = rows.combine_chunks()
        page = rows["page"].to_numpy()
        cuts = np.flatnonzero(page[1:] != page[:-1]) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(page)], strict=True):
            part = rows.slice(int(begin), int(end - begin))
            if page[begin] != self.page:
                # The first row of a page has its zone.
                self.page = page[begin]
                zone = part.slice(0, 1)
                self.need = np.flatnonzero(
                    _needed(
                        self.vectors, self.label, self.floors.min(1), self.ceilings.max(1),
                        _matrix(zone["least"].combine_chunks()),
                        _matrix(zone["greatest"].combine_chunks()),
                        zone["label_low"].to_numpy(), zone["label_high"].to_numpy(), self.same,
                    )[:, 0]
                )
            for some in np.array_split(self.need, len(self.need) * part.num_rows // _AT_ONCE + 1):
                if len(some):
                    self._score(some, part)

    def _score(self, some: np.ndarray, part: pa.Table) -> None:
        scores = _exact_scores(self.vectors[some], _matrix(part["vector"].combine_chunks()))
        alike = self.label[some][:, None] == part["label"].to_numpy()[None, :]
        rows = part["row"].to_numpy()
        if self.same:
            fits = alike & (self.row[some][:, None] != rows[None, :])
        else:
            fits = ~alike
        fits &= scores >= self.floors[some].min(1)[:, None]
        fits &= scores <= self.ceilings[some].max(1)[:, None]
        who, what = np.nonzero(fits)
        ids = part["vec_id"].to_numpy()
        self.hits.append(np.stack([some[who], scores[who, what], ids[what], rows[what]], axis=1))
        self.held += len(who)
        if self.held > 200_000:
            self.reduce()

    def reduce(self) -> np.ndarray:
        """The best rows of each window: (anchor, score, id, row)."""
        hits = np.concatenate(self.hits) if self.hits else np.zeros((0, 4), np.int64)
        hits = hits[np.lexsort((hits[:, 3], hits[:, 2], -hits[:, 1], hits[:, 0]))]
        stays = np.zeros(len(hits), bool)
        for k in range(self.floors.shape[1]):
            inside = np.flatnonzero(
                (hits[:, 1] >= self.floors[hits[:, 0], k])
                & (hits[:, 1] <= self.ceilings[hits[:, 0], k])
            )
            who = hits[inside, 0]
            begins = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else who
            rank = np.arange(len(who)) - np.repeat(begins, np.diff(np.append(begins, len(who))))
            stays[inside[rank < self.keep]] = True
        hits = hits[stays]
        self.hits, self.held = [hits], len(hits)
        if self.same and len(hits):
            # What is not better than the best few so far is not looked for any more.
            last = np.flatnonzero(np.append(hits[1:, 0] != hits[:-1, 0], True))
            begins = np.append(0, last[:-1] + 1)
            full = last - begins + 1 == self.keep
            who = hits[last[full], 0]
            self.floors[who, 0] = np.maximum(self.floors[who, 0], hits[last[full], 1])
        return hits


def _best(meetings: DataFrame, same: bool, keep: int) -> DataFrame:
    """(row of the anchor, score, id and row found) of the best rows of each block."""

    def results(own: Slice) -> pa.RecordBatch:
        hits = own.reduce()
        columns = [own.row[hits[:, 0]], hits[:, 1], hits[:, 2], hits[:, 3]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["anchor", "score", "found_id", "found_row"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[pa.Table] = []
        own, place = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            block, part = table["block"].to_numpy(), table["slice"].to_numpy()
            kind = table["kind"].to_numpy()
            cuts = np.flatnonzero(
                (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])
            ) + 1
            for begin, end in zip([0, *cuts], [*cuts, table.num_rows], strict=True):
                if end == begin:
                    continue
                piece = table.slice(int(begin), int(end - begin))
                if (block[begin], part[begin]) != place:
                    if own is not None:
                        yield results(own)
                    asked, own, place = [], None, (block[begin], part[begin])
                if kind[begin] == 0:
                    asked.append(piece)
                    continue
                if own is None:
                    own = Slice(pa.concat_tables(asked), same, keep)
                own.add(piece)
        if own is not None:
            yield results(own)

    return meetings.mapInArrow(run, "anchor long, score long, found_id long, found_row long")


def mined(
    vectors: DataFrame,
    anchor,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    low_percent: int = LOW_PERCENT,
    scale: int = SCALE,
) -> DataFrame:
    """Per anchor, positive and rank the hard negative and both scores.

    ``anchor`` is a Column of ``vectors``: which rows are anchors.
    """
    blocks, dims, many = _blocks(_whole(vectors, anchor, vec_id, label, vector, scale))
    zones = Zones(blocks, dims)
    slices = parts(many, SLICE_ANCHORS)
    anchors = _anchors(blocks)

    best_first = Window.partitionBy("anchor").orderBy(F.desc("score"), "found_id", "found_row")
    positives = stored(
        _best(_meetings(anchors, blocks, zones, slices, True), True, POSITIVES)
        .withColumn("place", F.row_number().over(best_first))
        .where(F.col("place") <= POSITIVES)
        .select("anchor", "place", F.col("found_id").alias("positive_id"),
                F.col("score").alias("positive_score")),
        "positives",
    )
    windows = (
        positives.where("positive_score >= 0")
        .select("anchor", "positive_score")
        .distinct()
        .groupBy("anchor")
        .agg(F.sort_array(F.collect_list("positive_score")).alias("ceilings"))  # a few an anchor
    )
    asking = (
        anchors.drop("floors", "ceilings")
        .join(windows.withColumnRenamed("anchor", "row"), "row")
        .select(*[f.split()[0] for f in _ANCHOR.split(", ")],
                F.expr(f"transform(ceilings, p -> (p * {low_percent} + 99) div 100)").alias("floors"),
                "ceilings")
    )
    found = _best(_meetings(asking, blocks, zones, slices, False), False, NEGATIVES)
    in_window = (low_percent * F.col("positive_score") <= 100 * F.col("score")) & (
        F.col("score") <= F.col("positive_score")
    )
    ranked = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "found_id", "found_row")
    return (
        found.join(positives, "anchor")
        .where(in_window)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= NEGATIVES)
        .join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("found_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
