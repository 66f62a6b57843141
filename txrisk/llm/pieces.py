"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into units: before blanks, and between characters that follow each
other in no piece of the table. No piece crosses such a border, so a unit's best
segmentation does not depend on its text, and each distinct unit is encoded once. Its substrings of
bounded length are exploded and joined to the piece table by equality; the edges
are grouped by unit, and two higher-order aggregates fold them: the forward one
keeps the best score to every place, the backward one follows it. A character
without piece falls back to its bytes, at the score the encoder gives an unknown
one. Ties go to the edge that begins first, as in the public encoder.

The segmentation is that of a unigram model: the best sum of scores over the
pieces of the table. A file of another kind is read as pieces with scores.

Each chunk of documents asks for its units and gets their ids, so no task holds
all units. Decoding joins the pieces' bytes. A null or empty text has no ids and
decodes to the empty text. Texts decode to themselves, except that U+2581, the
mark for a blank, becomes one. Long texts are encoded whole. Repeated rows stay;
null ids are kept; an empty table gives no rows; other columns are not looked at,
and decoding writes a column ``text`` of its own in place of one of that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.common import CHUNK_BYTES, n_chunks, packed_in_chunks, shuffle_parts, unpacked

BLANK = "▁"
UNKNOWN_PENALTY = 10.0  # below the lowest score of the table, as the public encoder has it
MAX_PIECES = 1_000_000
# The SQL fold copies its arrays at every step. Units beyond this length are
# folded where they occur, over the same edges in arrays that are not copied.
LONG_UNIT = 512
# A list of the chunks that ask for a unit has 2^16 of them at most; more are answered in shares.
LISTED_BITS = 16
# Within a chunk, arrays over characters are made for so many bytes of text at a time.
RUN_BYTES = 1 << 20
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass(frozen=True)
class Pieces:
    """A piece table; ``scores`` of normal pieces, ``byte_ids`` of the 256 bytes."""

    scores: dict[str, tuple[int, float]]
    byte_ids: list[int]
    raw: list[bytes]
    longest: int
    unknown: float
    adjacent: frozenset[tuple[str, str]]

    @staticmethod
    def load(model_file: str) -> Pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        if size > MAX_PIECES:
            raise ValueError(f"more than {MAX_PIECES} pieces")
        scores, byte_ids, raw = {}, [-1] * 256, []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(_BYTE.fullmatch(piece)[1], 16)
                byte_ids[value] = i
                raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                scores[piece] = (i, model.get_score(i))
                raw.append(piece.replace(BLANK, " ").encode("utf-8", "surrogatepass"))
        if min(byte_ids) < 0:
            raise ValueError("the table has no piece for some bytes")
        if BLANK not in scores:
            raise ValueError("the table has no piece for a blank")
        if any(BLANK in p.lstrip(BLANK) for p in scores):
            raise ValueError("a piece goes on after a blank")
        lowest = min(s for _, s in scores.values())
        adjacent = frozenset(pair for p in scores for pair in zip(p, p[1:], strict=False))
        return Pieces(
            scores, byte_ids, raw, max(map(len, scores)), lowest - UNKNOWN_PENALTY, adjacent
        )

    @property
    def id_bytes(self) -> int:
        """Bytes of an id on its way back to the chunks."""
        return 2 if len(self.raw) <= 1 << 16 else 4

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p, i, s) for p, (i, s) in self.scores.items()]
        return spark.createDataFrame(rows, "piece string, id int, score double")

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


@dataclass(frozen=True)
class Borders:
    """Classes of characters (0: in no pair), and which classes follow each other in a piece."""

    classes: np.ndarray
    follows: np.ndarray

    @staticmethod
    def of(pieces: Pieces) -> Borders:
        place = {c: i for i, c in enumerate(sorted(set(chain.from_iterable(pieces.adjacent))), 1)}
        classes = np.zeros(max(map(ord, place), default=0) + 2, np.int16 if len(place) < 1 << 15 else np.int32)
        follows = np.zeros((len(place) + 1, len(place) + 1), bool)
        for c, i in place.items():
            classes[ord(" " if c == BLANK else c)] = i
        for a, b in pieces.adjacent:
            follows[place[a], place[b]] = True
        return Borders(classes, follows)

    def cut(self, texts: list[str]) -> tuple[pa.BinaryArray, np.ndarray]:
        """The units of all texts, in order, and where each text's begin and end.

        A text gets a blank before it; U+2581 is a blank too.
        """
        marked = [" " + t.replace(BLANK, " ") if t else "" for t in texts]
        joined = "".join(marked)
        edges = np.concatenate([[0], np.cumsum([len(m) for m in marked], dtype=np.int64)])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.classes[np.minimum(points, len(self.classes) - 1)]
        blank = points == ord(" ")
        begins = np.ones(len(points) + 1, bool)
        begins[1:-1] = ~self.follows[kinds[:-1], kinds[1:]] | (blank[1:] & ~blank[:-1])
        begins[edges] = True
        at = np.flatnonzero(begins)
        widths = np.ones(len(points), np.int8)
        for least in (0x80, 0x800, 0x10000):
            widths += points >= least
        places = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])[at]
        data = joined.encode("utf-8", "surrogatepass")
        units = binary(places, pa.py_buffer(data))
        return units, np.searchsorted(at, edges)


def binary(offsets: np.ndarray, data: pa.Buffer) -> pa.BinaryArray:
    offsets = pa.py_buffer(offsets.astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), offsets.size // 4 - 1, [None, offsets, data])


def runs(packed: Iterable[pa.Scalar]) -> Iterator[pa.Table]:
    """The documents of a chunk, RUN_BYTES at a time."""
    held, size = [], 0
    for one in packed:
        held.append(unpacked(one))
        size += held[-1].nbytes
        if size >= RUN_BYTES:
            yield pa.concat_tables(held)
            held, size = [], 0
    if held:
        yield pa.concat_tables(held)


def encode_long(unit: str, pieces: Pieces) -> list[int]:
    """The fold for a single long unit."""
    n = len(unit)
    best, back = np.full(n + 1, -np.inf), [None] * (n + 1)
    best[0] = 0.0
    for start in range(n):
        alone = False
        for length in range(1, min(pieces.longest, n - start) + 1):
            hit = pieces.scores.get(unit[start : start + length])
            if hit is None:
                continue
            alone |= length == 1
            if best[start] + hit[1] > best[start + length]:
                best[start + length], back[start + length] = best[start] + hit[1], (start, [hit[0]])
        if not alone and best[start] + pieces.unknown > best[start + 1]:
            ids = [pieces.byte_ids[b] for b in unit[start].encode("utf-8", "surrogatepass")]
            best[start + 1], back[start + 1] = best[start] + pieces.unknown, (start, ids)
    out, at = [], n
    while at:
        at, ids = back[at]
        out.append(ids)
    return list(chain.from_iterable(reversed(out)))


# An edge is packed into one number, so that edges sort and copy cheaply: its end
# (18 bits), its start (18 bits), and the id of its piece (27 bits; UNKNOWN: none).
# The state is the best score to every place, and the packed edge that reaches it.
PLACE_BITS, ID_BITS = 18, 27
UNKNOWN = (1 << ID_BITS) - 1
_END = f"cast(shiftright(e, {PLACE_BITS + ID_BITS}) as int)"
_START = f"cast(shiftright(e, {ID_BITS}) & {(1 << PLACE_BITS) - 1} as int)"
_END_OF, _START_OF = (x.replace("e,", "e.edge,") for x in (_END, _START))
FORWARD = f"""
aggregate(
  edges,
  named_struct('best', array(0D), 'back', array(0L)),
  (s, e) -> if(
    size(s.best) <= {_END_OF},
    named_struct(
      'best', array_append(s.best, s.best[{_START_OF}] + e.score),
      'back', array_append(s.back, e.edge)),
    if(
      s.best[{_START_OF}] + e.score > s.best[{_END_OF}],
      named_struct(
        'best', array_append(slice(s.best, 1, {_END_OF}), s.best[{_START_OF}] + e.score),
        'back', array_append(slice(s.back, 1, {_END_OF}), e.edge)),
      s)),
  s -> s.back)
"""
BACKWARD = f"""
aggregate(
  reverse(back),
  named_struct('at', size(back) - 1, 'path', cast(array() as array<bigint>)),
  (s, e) -> if(
    {_END} = s.at and e <> 0,
    named_struct('at', {_START}, 'path', array_append(s.path, e)),
    s),
  s -> reverse(s.path))
"""


def encode_units(asked: DataFrame, pieces: Pieces) -> DataFrame:
    """``asked`` (distinct ``unit`` and ``share`` with an array ``chunks``) with ``ids``, by the lattice.

    ``ids`` are bytes, ``id_bytes`` for each id, the high one first.

    ``asked`` is hash-partitioned by unit and share, which exploding keeps, so the
    grouping moves nothing. The first edge of a unit carries its chunks along. The piece
    table is broadcast; it is no larger than MAX_PIECES.
    """
    spark = asked.sparkSession
    first = lambda c: F.when(F.col(c) == (0 if c == "start" else 1), F.col("chunks"))
    placed = asked.select(
        "unit", "share", "chunks", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("start")
    ).select("unit", "share", first("start").alias("chunks"), "start")
    longest = F.least(F.lit(pieces.longest), F.length("unit") - F.col("start"))
    spans = placed.select(
        "unit", "share", "chunks", "start", F.explode(F.sequence(F.lit(1), longest)).alias("n")
    ).select(
        "unit",
        "share",
        first("n").alias("chunks"),
        "start",
        "n",
        F.substring("unit", F.col("start") + 1, F.col("n")).alias("piece"),
    )
    table = F.broadcast(pieces.frame(spark))
    edges = spans.join(table, "piece", "left").filter("id is not null or n = 1")
    packed = F.expr(
        f"shiftleft(cast(start + n as bigint), {PLACE_BITS + ID_BITS})"
        f" | shiftleft(cast(start as bigint), {ID_BITS}) | coalesce(id, {UNKNOWN})"
    )
    edge = F.struct(packed.alias("edge"), F.coalesce("score", F.lit(pieces.unknown)).alias("score"))
    lattice = (
        edges.select("unit", "share", "chunks", edge.alias("edge"))
        .groupBy("unit", "share")
        .agg(
            F.sort_array(F.collect_list("edge")).alias("edges"),
            F.first("chunks", ignorenulls=True).alias("chunks"),
        )
    )
    path = lattice.select("unit", "chunks", F.expr(FORWARD).alias("back")).select(
        "unit", "chunks", F.expr(BACKWARD).alias("path")
    )
    hexed = f"hex(encode(substring(unit, {_START} + 1, 1), 'UTF-8'))"
    byte_ids = ",".join(map(str, pieces.byte_ids))
    ids = f"""
    flatten(transform(path, e -> if(
      e & {UNKNOWN} < {UNKNOWN},
      array(cast(e & {UNKNOWN} as int)),
      transform(
        sequence(0, length({hexed}) div 2 - 1),
        k -> element_at(
          array({byte_ids}), cast(conv(substring({hexed}, cast(2 * k + 1 as int), 2), 16, 10) as int) + 1)))))
    """
    as_bytes = f"unhex(array_join(transform({ids}, i -> lpad(hex(i), {2 * pieces.id_bytes}, '0')), ''))"
    return path.select("unit", "chunks", F.expr(as_bytes).alias("ids"))


def encode(
    docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``ids``, ``n_pieces``, and ``round_trip``: the ids decode to the text.

    The texts are shuffled once, packed: both the units and the assembly read the
    same exchange. A task holds the packed texts of a chunk, its units and their ids.
    """
    pieces = Pieces.load(model_file)
    n = n_chunks(docs, text, CHUNK_BYTES)
    chunks = packed_in_chunks(docs, doc_id, text, n)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def units_of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = Borders.of(pieces)
        packed = (
            pair
            for batch in batches
            for pair in zip(batch.column("chunk").to_pylist(), batch.column("docs"), strict=True)
        )
        # sorted by chunk, so that the units of one chunk are held at a time
        for chunk, of_chunk in groupby(packed, itemgetter(0)):
            found = pa.chunked_array(
                [pc.unique(borders.cut(t.column("text").to_pylist())[0]) for t in runs(d for _, d in of_chunk)],
                pa.binary(),
            )
            units = pc.unique(found).cast(pa.string())
            units = units.filter(pc.less_equal(pc.utf8_length(units), LONG_UNIT))
            units = pc.replace_substring(units, " ", BLANK)
            # sorted, since neighbours alike compress well
            units = units.take(pc.sort_indices(units))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(units), chunk, np.int32)), units], ["chunk", "unit"]
            )
            # the worker lives on beside the tasks that assemble
            del found, units
            pa.default_memory_pool().release_unused()

    # A chunk asks once for a unit, so nothing is to be gathered before the shuffle.
    # The lattice has dozens of rows for a unit; with four tasks for a chunk it is grouped in memory.
    asked = (
        chunks.sortWithinPartitions("chunk")
        .mapInArrow(units_of_chunks, "chunk int, unit string")
        .withColumn("share", F.shiftright("chunk", LISTED_BITS))
        .repartition(max(4 * n, shuffle_parts(docs)), "unit", "share")
        .groupBy("unit", "share")
        .agg(F.collect_list("chunk").alias("chunks"))
    )
    # The ids spell their unit, which therefore does not travel with them.
    answers = encode_units(asked, pieces).select(F.explode("chunks").alias("chunk"), "ids")
    raw = pa.array(pieces.raw, pa.binary())

    def spelled(ids: pa.ListArray) -> pa.BinaryArray:
        """What each list of ids decodes to."""
        parts = raw.take(ids.values)
        offsets = ids.offsets.to_numpy()
        if not len(parts):
            return binary(np.zeros(len(offsets)), pa.py_buffer(b""))
        return binary(np.frombuffer(parts.buffers()[1], np.int32)[offsets], parts.buffers()[2])

    def answered(packed: pa.ChunkedArray) -> pa.ListArray:
        """The lists of ids, from the bytes as they lie."""
        lists = [pa.array([], pa.list_(pa.int32()))]
        for part in packed.chunks:
            if not len(part):
                continue
            ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
            data = np.frombuffer(part.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            values = pa.array(data.view(f">u{pieces.id_bytes}").astype(np.int32))
            lists.append(pa.ListArray.from_arrays(pa.array((ends - ends[0]) // pieces.id_bytes), values))
        return pa.concat_arrays(lists)

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        borders, tables = Borders.of(pieces), []
        short = answered(right.column("ids"))
        spellings = spelled(short)
        for t in runs(left.column("docs")):
            units, bounds = borders.cut(t.column("text").to_pylist())
            # A unit finds the ids that decode to it; a long one is folded here.
            found, known, bad = pc.index_in(units, value_set=spellings), short, None
            if found.null_count:
                long = pc.unique(units.filter(found.is_null()))
                names = [u.decode("utf-8", "surrogatepass").replace(" ", BLANK) for u in long.to_pylist()]
                if any(len(u) <= LONG_UNIT for u in names):
                    raise ValueError("a unit has no answer")
                folded = pa.array([encode_long(u, pieces) for u in names], pa.list_(pa.int32()))
                known = pa.concat_arrays([short, folded])
                place = pc.add(pc.index_in(units, value_set=long), len(short)).cast(pa.int32())
                found = pc.coalesce(found, place)
                bad = np.concatenate([np.zeros(len(short), bool), pc.not_equal(spelled(folded), long).to_numpy(zero_copy_only=False)])
            ids = known.take(found)
            offsets = ids.offsets.to_numpy()[bounds]
            good = np.ones(len(t), bool)
            if bad is not None:
                wrong = np.concatenate([[0], np.cumsum(bad[found.to_numpy()])])
                good = wrong[bounds[1:]] == wrong[bounds[:-1]]
            columns = [
                t.column("doc_id"),
                pa.ListArray.from_arrays(pa.array(offsets), ids.values),
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.array(good),
            ]
            tables.append(pa.table(columns, ["doc_id", "ids", "n_pieces", "round_trip"]))
        return pa.concat_tables(tables)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        assemble, f"doc_id {id_type}, ids array<int>, n_pieces bigint, round_trip boolean"
    )


def decode(encoded: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the column ``text``; null ids give the empty text."""
    pieces = Pieces.load(model_file)
    given = encoded.drop("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pieces.decode(i or []) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return given.mapInArrow(run, f"{schema}, text string")
