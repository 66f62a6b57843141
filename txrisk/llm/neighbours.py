"""Approximate nearest neighbours over learned partitions.

A sample of distinct vectors gives a neighbour graph, which is cut into
partitions of equal size by recursive bisection along the graph's slowest mode
and a few balanced moves. A small classifier learns from each sampled vector how its
neighbours spread over the partitions. It puts every row into its most probable
partition, and sends a query to the several most probable ones, whose rows are
reranked by the exact distance on the original vectors. How many partitions a
query visits is found on the sample: the fewest that keep TARGET_RECALL of the
neighbours there.

Vectors that are null, zero, hold null or non-finite components, or have another
length than most take no part, nor do rows without id. Rows equal in id and vector
count once. Ties go to the smaller id. Fewer candidates than asked for are all
returned, an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txrisk.llm.common import streamed
from txrisk.session import materialize

# Bounds of what is fitted on the driver: sampled vectors and partitions.
SAMPLE_ROWS = 8_192
MAX_PARTITIONS = 256
ROWS_PER_PARTITION = 1_000
GRAPH_DEGREE = 10
HIDDEN = 128
EPOCHS = 30
TARGET_RECALL = 0.96
SEED = 5

# Rows whose distances to the sample are held at once on the driver: 8 MB for the whole sample.
NEAREST_BLOCK = 128

# Rows of a block, which a task holds, and queries that it answers at once.
BLOCK_ROWS = 4_096
QUERIES_AT_ONCE = 1_024


def clean(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id`` and ``v`` (array of double) of the vectors that take part."""
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")
    ).filter(
        "vec_id is not null and exists(v, x -> x <> 0)"
        " and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (sizes["d"] if sizes else 0))


def nearest_in(x: np.ndarray, k: int, block: int = NEAREST_BLOCK) -> np.ndarray:
    """The ``k`` nearest rows of each row of ``x``, itself left out."""
    square = (x * x).sum(axis=1)
    found = []
    for at in range(0, len(x), block):
        d = square - 2 * x[at : at + block] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        found.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(found)


def cut(graph: np.ndarray, parts: int, seed: int = SEED) -> np.ndarray:
    """Partition of each vertex, of equal sizes but for a tenth."""
    n, degree = graph.shape
    rng = np.random.default_rng(seed)
    part = np.zeros(n, np.int64)
    source, target = np.repeat(np.arange(n), degree), graph.ravel()
    source, target = np.concatenate([source, target]), np.concatenate([target, source])
    todo = [(np.arange(n), 0, parts)]
    inside, local = np.zeros(n, bool), np.zeros(n, np.int64)
    while todo:
        members, first, count = todo.pop()
        if count == 1:
            part[members] = first
            continue
        inside[:] = False
        inside[members] = True
        local[members] = np.arange(len(members))
        edge = inside[source] & inside[target]
        s, t = local[source[edge]], local[target[edge]]
        weight = np.maximum(np.bincount(s, minlength=len(members)), 1)
        mode = rng.standard_normal(len(members))
        for _ in range(60):  # towards the slowest mode but the constant one
            mode = mode + np.bincount(s, mode[t], len(members)) / weight
            mode -= (mode * weight).sum() / weight.sum()
            mode /= np.abs(mode).max() or 1
        left = count // 2
        order = np.argsort(mode, kind="stable")
        at = len(members) * left // count
        todo += [(members[order[:at]], first, left), (members[order[at:]], first + left, count - left)]
    most = int(np.ceil(1.1 * n / parts))
    sizes = np.bincount(part, minlength=parts)
    for _ in range(5):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (source, part[target]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        for v in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            if sizes[best[v]] < most:
                sizes[part[v]] -= 1
                sizes[best[v]] += 1
                part[v] = best[v]
    return part


@dataclass
class Classifier:
    """One hidden layer; gives logits of the partitions."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2


def train(x: np.ndarray, wanted: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Classifier:
    """Cross entropy with the rows of ``wanted`` (distributions) by Adam."""
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    scale = float((x - mean).std()) or 1.0
    z = (x - mean) / scale
    n, parts = wanted.shape
    p = [
        rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]),
        np.zeros(HIDDEN),
        rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN),
        np.zeros(parts),
    ]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        order = rng.permutation(n)
        for at in range(0, n, 128):
            rows = order[at : at + 128]
            hidden = np.maximum(z[rows] @ p[0] + p[1], 0)
            logits = hidden @ p[2] + p[3]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            d = (e / e.sum(axis=1, keepdims=True) - wanted[rows]) / len(rows)
            dh = (d @ p[2].T) * (hidden > 0)
            grads = [z[rows].T @ dh, dh.sum(axis=0), hidden.T @ d, d.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Classifier(mean, scale, *p)


def fit(x: np.ndarray, rows: int) -> tuple[Classifier | None, int, int]:
    """Classifier, partitions and visits for a table of ``rows`` rows sampled as ``x``.

    Tables too small to cut have one partition, which every query visits.
    """
    parts = min(MAX_PARTITIONS, rows // ROWS_PER_PARTITION, len(x) // (2 * GRAPH_DEGREE))
    if parts < 2:
        return None, 1, 1
    graph = nearest_in(x, GRAPH_DEGREE)
    part = cut(graph, parts)
    near = np.concatenate([np.arange(len(x))[:, None], graph], axis=1)
    wanted = np.zeros((len(x), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(x)), near.shape[1]), part[near.ravel()]), 1 / near.shape[1])
    model = train(x, wanted)
    order = np.argsort(-model.logits(x), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], axis=1)
    # how late a query would visit the partition that the model gives a neighbour
    late = np.sort(np.take_along_axis(place, order[:, 0][graph], axis=1).ravel())
    return model, parts, int(late[int(TARGET_RECALL * (len(late) - 1))]) + 1


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _routed(rows: DataFrame, model: Classifier | None, visits: int, everything: bool) -> DataFrame:
    """Adds ``parts``: the partitions by falling probability, ``visits`` or all of them."""
    if model is None:
        return rows.withColumn("parts", F.array(F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-model.logits(_matrix(batch.column("v"))), axis=1, kind="stable")
            order = (order if everything else order[:, :visits]).astype(np.int32)
            ends = np.arange(0, order.size + 1, order.shape[1], dtype=np.int32)
            parts = pa.ListArray.from_arrays(pa.array(ends), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], [*batch.schema.names, "parts"])

    return rows.mapInArrow(run, "vec_id bigint, v array<double>, parts array<int>")


def _held(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block, rows equal in both once."""
    ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("v"))
    both = np.concatenate([ids.view(np.float64)[:, None], x], axis=1)
    whole = np.ascontiguousarray(both).view(f"V{both.shape[1] * 8}")
    first = np.sort(np.unique(whole, return_index=True)[1])
    return ids[first], x[first]


def _rerank(k: int):
    def answer(place: int, held: tuple, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, x = held
        out = {"query_id": [], "vector": [], "vec_id": [], "score": []}
        marks = queries.column("vector").to_numpy()
        for q, mark, v in zip(queries.column("vec_id").to_numpy(), marks, _matrix(queries.column("v")), strict=True):
            score = np.sqrt(((x - v) ** 2).sum(axis=1))
            score[ids == q] = np.inf
            best = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1]) if len(score) > k else np.arange(len(score))
            best = best[np.lexsort((ids[best], score[best]))][:k]
            best = best[np.isfinite(score[best])]
            out["query_id"].append(np.full(len(best), q))
            out["vector"].append(np.full(len(best), mark))
            out["vec_id"].append(ids[best])
            out["score"].append(score[best])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in out.values()], list(out))

    return answer


def search(
    vectors: DataFrame,
    queries: str,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest found for the rows of ``vectors`` that the condition ``queries`` names.

    ``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean distance). The
    condition is on ``vec_id``. All rows are indexed.
    """
    rows = materialize(clean(vectors, vec_id, embedding), "vectors")
    n = rows.count()
    share = 1 << 20
    keep = min(1.0, 4 * SAMPLE_ROWS / n) if n else 1.0
    mark = F.xxhash64("v")
    sampled = rows.filter(F.pmod(mark, F.lit(share)) < int(keep * share)).select("v").distinct()
    sampled = sampled.orderBy(F.xxhash64("v"), "v").limit(SAMPLE_ROWS).toArrow()
    x = _matrix(sampled.column("v")) if sampled.num_rows else np.zeros((0, 1))
    model, _, visits = fit(x, n)

    routed = _routed(rows, model, 1, False).select("vec_id", "v", F.col("parts")[0].alias("part"))
    routed = materialize(routed, "index")
    asked = rows.filter(queries).distinct()
    # one row for each partition, MAX_PARTITIONS at most
    counts = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    parts = max(counts, default=0) + 1
    blocks = F.array(*(F.lit(max(1, -(-counts.get(p, 0) // BLOCK_ROWS))) for p in range(parts)))
    held = F.array(*(F.lit(counts.get(p, 0)).cast("long") for p in range(parts)))

    place = F.shiftleft(F.col("part").cast("long"), 40) + F.col("block")
    # as many partitions as found on the sample, and on until they hold enough rows
    to = _routed(asked, model, visits, True).withColumn("held", held).withColumn("visits", F.lit(visits))
    enough = F.expr(
        f"filter(parts, (p, i) -> i < visits or"
        f" aggregate(slice(parts, 1, i), 0L, (s, q) -> s + coalesce(try_element_at(held, q + 1), 0L)) < {4 * k})"
    )
    to = (
        to.withColumn("part", F.explode(enough))
        .withColumn("blocks", F.coalesce(F.try_element_at(blocks, F.col("part") + 1), F.lit(1)))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(place.alias("place"), F.lit(1).alias("kind"), "vec_id", "v", mark.alias("vector"))
    )
    dealt = (
        routed.withColumn("blocks", F.element_at(blocks, F.col("part") + 1))
        .withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")))
        .select(place.alias("place"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("long").alias("vector"))
    )
    # a task holds a block and its queries stream by, so rows move once however many queries there are
    both = dealt.unionByName(to).repartition("place").sortWithinPartitions("place", "kind")
    found = both.mapInArrow(
        lambda batches: streamed(batches, "place", _held, _rerank(k), QUERIES_AT_ONCE),
        "query_id bigint, vector bigint, vec_id bigint, score double",
    )
    best = Window.partitionBy("query_id", "vector").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
