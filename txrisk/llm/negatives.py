"""Hard negatives from Hilbert-ordered blocks with zone maps.

Vectors are scaled and floored to integers. They are ordered along a Hilbert
curve over the quartiles of every dimension, cut into extents of even size and
stored as Parquet blocks, each with a zone map: the least and the largest value
of every dimension. For an anchor, interval arithmetic over a zone map bounds
the inner products with all rows of the block, so a block is read for a window
of scores only if its bounds meet the window.

What is sought is the best few rows within a window of scores, of the anchor's
label (its positives: no upper end) or of any other label (its negatives). An
anchor first reads its own extent; the last of the best few found there closes
the window from below, and the zone maps of all other extents tell which of them
may hold better ones. Zone maps are held in groups of extents and anchors stream
by, then blocks of an extent are held and the anchors that need it stream by, so
a task holds one group or one extent whatever the number of anchors.

Rows with a null label, a null vector or a null or non-finite component take no
part; neither do rows with a component of 2^27 or more after scaling, whose
scores a long could not hold. Shorter vectors count as ending in zeros. Repeated
ids are different rows; null ids are candidates that come last among equal
scores and no anchors. Rows equal in score and id are ordered as stored. An empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import streamed
from txrisk.session import materialize

SCALE = 256
LARGEST = 1 << 27

BLOCK_ROWS = 2048
EXTENT_ROWS = 1 << 16
GROUP_EXTENTS = 1024
# Anchors that are scored at once.
ANCHORS_AT_ONCE = 64
# Rows from which the quartiles of the dimensions are taken; they set the order only.
SAMPLE_ROWS = 10_000

POSITIVES = 5
NEGATIVES = 10
# A negative has this many hundredths of the positive's score.
LEAST_PERCENT = 30
MOST_PERCENT = 90

NO_ID = np.iinfo(np.int64).max
EXACT = float(1 << 53)
LOW, HIGH = -(1 << 62), 1 << 62


def hilbert_keys(cells: np.ndarray, bits: int = 2) -> list[bytes]:
    """Position on the Hilbert curve of each row of ``cells`` (``bits`` bits a dimension)."""
    x = [c.copy() for c in cells.astype(np.uint8).T]
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        below = level - 1
        for i in range(len(x)):
            high = (x[i] & level) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below).astype(np.uint8)
            x[0] ^= np.where(high, below, swap).astype(np.uint8)
            x[i] ^= swap
        level >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(len(cells), np.uint8)
    level = top
    while level > 1:
        turn ^= np.where(x[-1] & level, level - 1, 0).astype(np.uint8)
        level >>= 1
    planes = [((c ^ turn) >> b) & 1 for b in range(bits - 1, -1, -1) for c in x]
    packed = np.packbits(np.stack(planes, axis=1), axis=1)
    return [row.tobytes() for row in packed]


def _padded(lists: pa.ListArray, size: int) -> np.ndarray:
    """A list column as a matrix with ``size`` columns, short rows filled with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(lengths), size), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, column] = flat
    return out


@dataclass(frozen=True)
class Index:
    """Stored blocks: ``extent``, ``block``, packed rows and zone map, and their numbers."""

    blocks: DataFrame
    size: int
    extents: int


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str, anchor: Column) -> DataFrame:
    """Rows that take part: ``vec_id``, ``label``, ``anchor`` and the integers ``q``."""
    finite = f"x is not null and abs(x) < {LARGEST / SCALE}D"
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).cast("long").alias("label"),
        F.coalesce(anchor & F.col(vec_id).isNotNull(), F.lit(False)).alias("anchor"),
        F.col(embedding).cast("array<double>").alias("v"),
    )
    rows = rows.filter(f"label is not null and v is not null and forall(v, x -> coalesce({finite}, false))")
    return rows.select("vec_id", "label", "anchor", F.expr(f"transform(v, x -> floor({SCALE}D * x))").alias("q"))


def build(rows: DataFrame, block_rows: int = BLOCK_ROWS, extent_rows: int = EXTENT_ROWS) -> Index:
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    total, size = rows.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    size, extents = max(1, size or 0), max(1, -(-total // extent_rows))
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    picked = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = _padded(rows.filter(picked).limit(2 * SAMPLE_ROWS).select("q").toArrow().column("q").combine_chunks(), size)
    cuts = np.quantile(sample, [0.25, 0.5, 0.75], axis=0) if len(sample) else np.zeros((3, size))

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _padded(batch.column("q"), size)
            cells = (q[:, None, :] >= cuts[None, :, :]).sum(axis=1)
            key = pa.array(hilbert_keys(cells) if len(q) else [], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, key], [*batch.schema.names, "key"])

    keyed = rows.mapInArrow(with_key, "vec_id bigint, label bigint, anchor boolean, q array<bigint>, row bigint, key binary")
    # the id and the row number split copies of one vector
    cut = keyed.repartitionByRange(extents, "key", "vec_id", "row").sortWithinPartitions("key", "vec_id", "row")
    cut = cut.withColumn("extent", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, []

        def block(table: pa.Table) -> pa.RecordBatch:
            q = _padded(table.column("q").combine_chunks(), size)
            lists = [pa.array([table.column(c).to_pylist()], t) for c, t in (
                ("vec_id", pa.list_(pa.int64())), ("label", pa.list_(pa.int64())),
                ("row", pa.list_(pa.int64())), ("anchor", pa.list_(pa.bool_())),
            )]
            extent = table.column("extent")[0].as_py()
            return pa.RecordBatch.from_arrays(
                [pa.array([extent], pa.int32()), pa.array([number], pa.int32()), *lists]
                + [pa.array([a.astype(np.int32).tobytes()], pa.binary()) for a in (q, q.min(axis=0), q.max(axis=0))],
                ["extent", "block", "ids", "labels", "rows", "anchors", "matrix", "low", "high"],
            )

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= block_rows:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, block_rows))
                number += 1
                held = table.slice(block_rows).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    packed = cut.mapInArrow(
        pack,
        "extent int, block int, ids array<bigint>, labels array<bigint>, rows array<bigint>, anchors array<boolean>, "
        "matrix binary, low binary, high binary",
    )
    return Index(materialize(packed, "blocks"), size, extents)


ANCHOR = "anchor bigint, anchor_id bigint, label bigint, vector binary, home int"


def anchors(index: Index) -> DataFrame:
    """The anchors among the rows of ``index``; ``anchor`` is the row number, ``home`` the extent."""
    size = index.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for extent, ids, labels, rows, flags, matrix in zip(
                *(batch.column(c).to_pylist() for c in ("extent", "ids", "labels", "rows", "anchors", "matrix")), strict=True
            ):
                q = np.frombuffer(matrix, np.int32).reshape(-1, size)
                out += [(rows[i], ids[i], labels[i], q[i].tobytes(), extent) for i in np.flatnonzero(flags)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["anchor", "anchor_id", "label", "vector", "home"],
            )

    chosen = index.blocks.select("extent", "ids", "labels", "rows", "anchors", "matrix")
    return materialize(chosen.filter("exists(anchors, a -> a)").mapInArrow(run, ANCHOR), "anchors")


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``q`` with anything between ``low`` and ``high``.

    Widened by what doubles may be off.
    """
    up, down = np.maximum(q, 0.0), np.minimum(q, 0.0)
    least = up @ low.T + down @ high.T
    most = up @ high.T + down @ low.T
    off = 1e-12 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
    return least - off, most + off


def _wanted(q: np.ndarray, windows: list, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which blocks each anchor must read for one of its windows."""
    least, most = bounds(q, low, high)
    need = np.zeros(least.shape, bool)
    for i, spans in enumerate(windows):
        for lo, hi in spans:
            need[i] |= (most[i] >= lo) & (least[i] <= hi)
    return need


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products; by doubles where they hold every sum."""
    if not len(q) or not len(m) or float(np.abs(q).max()) * np.abs(m).max() * q.shape[1] < EXACT:
        return (q @ m.T).astype(np.int64)
    return q.astype(np.int64) @ m.astype(np.int64).T


def _spans(batch: pa.RecordBatch) -> list:
    return [[(w["lo"], w["hi"]) for w in ws] for ws in batch.column("windows").to_pylist()]


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    raw = b"".join(batch.column("vector").to_pylist())
    return np.frombuffer(raw, np.int32).reshape(-1, size).astype(np.float64)


def _zones(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = (b"".join(table.column(c).to_pylist()) for c in ("low", "high"))
    return tuple(np.frombuffer(b, np.int32).reshape(-1, size).astype(np.float64) for b in (low, high))


REQUEST = "anchor bigint, label bigint, vector binary, windows array<struct<lo:bigint,hi:bigint>>"


def choose(index: Index, asked: DataFrame) -> DataFrame:
    """For each anchor the extents other than its home that may hold rows in one of its windows."""
    size, groups = index.size, -(-index.extents // GROUP_EXTENTS)
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("anchor", "bigint"), ("label", "bigint"), ("vector", "binary"), ("windows", "array<struct<lo:bigint,hi:bigint>>"))]
    zones = index.blocks.select(
        (F.col("extent") / GROUP_EXTENTS).cast("int").alias("group"), F.lit(0).alias("kind"), "extent", "low", "high", *nothing
    )
    asking = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"),
        F.col("home").alias("extent"), F.lit(None).cast("binary").alias("low"), F.lit(None).cast("binary").alias("high"),
        "anchor", "label", "vector", "windows",
    )

    def load(table: pa.Table):
        extents = table.column("extent").to_numpy()
        order = np.argsort(extents, kind="stable")
        low, high = _zones(table, size)
        first = np.flatnonzero(np.diff(extents[order], prepend=-1))
        return extents[order][first], first, low[order], high[order]

    def answer(group: int, ready, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        extents, first, low, high = ready
        need = _wanted(_vectors(batch, size), _spans(batch), low, high)
        need = np.maximum.reduceat(need, first, axis=1)
        need &= extents[None, :] != batch.column("extent").to_numpy()[:, None]
        who, which = np.nonzero(need)
        taken = batch.select(["anchor", "label", "vector", "windows"]).take(pa.array(who))
        yield pa.RecordBatch.from_arrays(
            [pa.array(extents[which], pa.int32()), *taken.columns], ["extent", *taken.schema.names]
        )

    both = zones.unionByName(asking).repartition("group").sortWithinPartitions("group", "kind")
    return both.mapInArrow(lambda b: streamed(b, "group", load, answer, ANCHORS_AT_ONCE), f"extent int, {REQUEST}")


FOUND = "anchor bigint, w int, score bigint, id bigint, row bigint"


def visit(index: Index, requests: DataFrame, same_label: bool, best: int) -> DataFrame:
    """For each anchor and window the ``best`` rows of the requested extents, best first."""
    size = index.size
    nothing = lambda names: [F.lit(None).cast(t).alias(n) for n, t in names]
    held = index.blocks.select(
        "extent", F.lit(0).alias("kind"), "ids", "labels", "rows", "matrix", "low", "high",
        *nothing((("anchor", "bigint"), ("label", "bigint"), ("vector", "binary"), ("windows", "array<struct<lo:bigint,hi:bigint>>"))),
    )
    asking = requests.select(
        "extent", F.lit(1).alias("kind"),
        *nothing((("ids", "array<bigint>"), ("labels", "array<bigint>"), ("rows", "array<bigint>"), ("matrix", "binary"), ("low", "binary"), ("high", "binary"))),
        "anchor", "label", "vector", "windows",
    )

    def load(table: pa.Table):
        joined = lambda c: table.column(c).combine_chunks().flatten()
        sizes = table.column("rows").combine_chunks().value_lengths().to_numpy()
        matrix = np.frombuffer(b"".join(table.column("matrix").to_pylist()), np.int32).reshape(-1, size)
        ids = joined("ids").fill_null(NO_ID).to_numpy()
        nulls = joined("ids").is_null().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        return matrix.astype(np.float64), ids, nulls, joined("rows").to_numpy(), joined("labels").to_numpy(), ends - sizes, ends, *_zones(table, size)

    def answer(extent: int, ready, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        matrix, ids, nulls, rows, labels, begin, end, low, high = ready
        q, spans = _vectors(batch, size), _spans(batch)
        need = _wanted(q, spans, low, high)
        scores = np.full((len(q), len(matrix)), LOW - 1)
        for block in np.flatnonzero(need.any(axis=0)):
            who, place = np.flatnonzero(need[:, block]), slice(begin[block], end[block])
            scores[who, place] = _products(q[who], matrix[place])
        own, label = batch.column("anchor").to_numpy(), batch.column("label").to_numpy()
        out = []
        for i, windows in enumerate(spans):
            s = scores[i]
            if same_label:
                allowed = (labels == label[i]) & (rows != own[i])
            else:
                allowed = labels != label[i]
            for w, (lo, hi) in enumerate(windows):
                at = np.flatnonzero(allowed & (s >= lo) & (s <= hi))
                if len(at) > best:
                    least = np.partition(s[at], len(at) - best)[len(at) - best]
                    at = at[s[at] >= least]
                at = at[np.lexsort((rows[at], ids[at], nulls[at], -s[at]))][:best]
                out.append((np.full(len(at), own[i]), np.full(len(at), w, np.int32), s[at], ids[at], nulls[at], rows[at]))
        anchor, w, score, id_, null, row = (np.concatenate(c) for c in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array(w, pa.int32()), pa.array(score), pa.array(id_, mask=null), pa.array(row)],
            ["anchor", "w", "score", "id", "row"],
        )

    both = held.unionByName(asking).repartition("extent").sortWithinPartitions("extent", "kind")
    return both.mapInArrow(lambda b: streamed(b, "extent", load, answer, ANCHORS_AT_ONCE), FOUND)


def best_in_windows(index: Index, asked: DataFrame, same_label: bool, best: int) -> DataFrame:
    """``anchor``, ``w``, ``rank`` from 1, ``score``, ``id``: the best rows in each window of each anchor.

    ``asked`` has ``anchor``, ``label``, ``vector``, ``home`` and ``windows``.
    """
    at_home = asked.select(F.col("home").alias("extent"), "anchor", "label", "vector", "windows")
    near = materialize(visit(index, at_home, same_label, best), "near")
    # the last of enough rows closes its window from below
    enough = near.groupBy("anchor", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    floors = enough.filter(F.col("n") >= best).groupBy("anchor").agg(
        F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("floors")
    )
    closed = asked.join(floors, "anchor", "left").withColumn(
        "windows",
        F.expr("transform(windows, (x, i) -> named_struct('lo', greatest(x.lo, coalesce(floors[i], x.lo)), 'hi', x.hi))"),
    )
    far = visit(index, choose(index, closed.drop("floors")), same_label, best)
    in_order = "over (partition by anchor, w order by score desc, id asc nulls last, row)"
    ranked = near.unionByName(far).selectExpr("*", f"row_number() {in_order} as rank")
    return ranked.filter(F.col("rank") <= best).select("anchor", "w", "rank", "score", "id")


def mine(
    vectors: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    block_rows: int = BLOCK_ROWS,
    extent_rows: int = EXTENT_ROWS,
) -> DataFrame:
    """Hard negatives of every anchor and positive.

    Columns ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``. ``anchor`` is a condition on the
    columns of ``vectors``.
    """
    index = build(usable(vectors, vec_id, embedding, label, anchor), block_rows, extent_rows)
    who = anchors(index)
    window = f"array(named_struct('lo', {LOW}L, 'hi', {HIGH}L))"
    close = materialize(
        best_in_windows(index, who.withColumn("windows", F.expr(window)), True, positives)
        .drop("w")
        .withColumnsRenamed({"score": "positive_score", "id": "positive_id", "rank": "place"}),
        "positives",
    )
    span = (
        f"named_struct('lo', ceil({LEAST_PERCENT} * cast(positive_score as decimal(20, 0)) / 100bd), "
        f"'hi', floor({MOST_PERCENT} * cast(positive_score as decimal(20, 0)) / 100bd))"
    )
    windows = close.groupBy("anchor").agg(
        F.expr(f"transform(array_sort(collect_list(struct(place, {span} as span))), x -> x.span)").alias("windows")
    )
    windows = windows.withColumn("windows", F.col("windows").cast("array<struct<lo:bigint,hi:bigint>>"))
    asked = materialize(who.join(windows, "anchor"), "windows")
    hard = best_in_windows(index, asked, False, negatives)
    named = close.join(who.select("anchor", "anchor_id"), "anchor").withColumn("w", F.col("place") - 1)
    return hard.join(named, ["anchor", "w"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
