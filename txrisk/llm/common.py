"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.session import materialize

# White space that ends a word: blank and the control characters 0x09 to 0x0D.
# ``bytes.split()`` splits at exactly these.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

CHUNK_BYTES = 16 << 20


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def n_words(text: str = "text") -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def n_chunks(docs: DataFrame, text: str, chunk_bytes: int = CHUNK_BYTES) -> int:
    return max(1, -(-text_bytes(docs, text) // chunk_bytes))


def in_chunks(
    docs: DataFrame, doc_id: str, text: str, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """``doc_id``, ``text`` and ``chunk``, dealt out so that a chunk is in one partition.

    A chunk has about ``chunk_bytes`` of text. The hash of id and text that
    deals them out keeps a retried task the same.
    """
    chunks = n_chunks(docs, text, chunk_bytes)
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")
    ).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    return keyed.repartition(chunks, "chunk")


def packed_in_chunks(docs: DataFrame, doc_id: str, text: str, chunks: int) -> DataFrame:
    """As :func:`in_chunks`, but ``chunk`` and ``docs``: compressed tables of id and text.

    What a batch has for a chunk is one row, so a shuffle moves compressed texts.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).withColumn(
        "chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
        for batch in batches:
            found, tables = np.unique(batch.column("chunk").to_numpy()), []
            rows = batch.select(["doc_id", "text"])
            for chunk in found:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                    out.write(rows.filter(pc.equal(batch.column("chunk"), int(chunk))))
                tables.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array(tables, pa.binary())], ["chunk", "docs"]
            )

    return keyed.mapInArrow(pack, "chunk int, docs binary").repartition(chunks, "chunk")


def unpacked(docs: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(docs.as_buffer()).read_all()


def streamed(
    batches: Iterator[pa.RecordBatch], part: str, load: Callable, answer: Callable, at_once: int
) -> Iterator[pa.RecordBatch]:
    """Join of rows ordered by ``part`` and ``kind``, where one side is held and the other streams by.

    ``load`` makes of the rows of kind 0 of a part, as a table, what is held;
    ``answer`` takes the part, that, and up to ``at_once`` rows of kind 1, and
    yields batches. A part without rows of kind 0 has no answers.
    """
    now, held, ready = None, [], None
    for batch in batches:
        parts, kinds = batch.column(part).to_numpy(), batch.column("kind").to_numpy()
        edge = np.flatnonzero((parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(parts)], strict=True):
            if a == b:
                continue
            piece = batch.slice(a, b - a)
            if parts[a] != now:
                now, held, ready = parts[a], [], None
            if kinds[a] == 0:
                held.append(piece)
                continue
            if ready is None and held:
                ready, held = load(pa.Table.from_batches(held)), []
            if ready is not None:
                for at in range(0, b - a, at_once):
                    yield from answer(int(now), ready, piece.slice(at, at_once))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of ``edges``.

    ``edges`` has columns ``a`` and ``b`` (long). Each round hangs the larger
    neighbours of a node on its smallest neighbour, then the smaller ones, until
    every component is a star; the number of rounds grows with the logarithm of
    the size of a component. Each round is stored, so a lost executor repeats
    one round at most. Only a count and a checksum reach the driver.
    """
    e = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")
    )
    e = materialize(e.distinct(), "edges")
    seen = None
    while True:
        now = e.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(20,0)"))
        ).first()
        if now == seen or not now[0]:
            return e
        seen = now
        both = e.select("node", "root").union(e.select("root", "node"))
        low = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("low"))
        large = (
            both.filter("root > node")
            .join(low, "node")
            .select(F.col("root").alias("node"), F.col("low").alias("root"))
            .distinct()
        )
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node").select(
            F.explode(
                F.array(
                    F.struct(F.col("root").alias("node"), F.col("low").alias("root")),
                    F.struct("node", F.col("low").alias("root")),
                )
            ).alias("e")
        )
        e = materialize(small.select("e.*").filter("node <> root").distinct(), "edges")
