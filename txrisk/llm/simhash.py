"""Near duplicates by SimHash over a byte-position inverted index.

Two 64-bit fingerprints that differ in at most three bits agree in at least five
of their eight bytes. The index posts every fingerprint under 14 sets of four
byte positions, those whose numbers have the exclusive-or zero. Any five
positions contain one such set, so a pair with five shared bytes meets under one
key at least. For the pairs that meet, the shared positional bytes are tallied;
pairs that reach five are verified bit by bit.

Null and empty texts have the fingerprint zero, like all texts without words,
and are linked to each other. Repeated rows stay as they are. A null id is kept
and never names a component unless all its ids are null. A bit set in exactly half
of the hashes is not set in the fingerprint. Long texts are hashed whole, shingle
by shingle. An empty table gives no rows. Other columns of the input are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import connected_components
from txrisk.session import materialize

BYTES = 8
MAX_BITS = 3
SHARED = BYTES - MAX_BITS
SEED = 42
POSITION_SETS = [c for c in combinations(range(BYTES), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]

# A posting list longer than this is not paired off: it is split by a fifth byte,
# and if it is still longer, its fingerprints are linked over the values at one
# and two bits' distance, 326 rows for a fingerprint. The links reach the same.
DENSE = 512
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of ``text`` with A-Z in lower case, as signed long."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = zip(*(words[i:] for i in range(width)), strict=False)
    n = len(words) - width + 1
    hashes = np.fromiter((digest(join(g), SEED) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _HASHES_AT_ONCE):
        block = hashes[at : at + _HASHES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3
) -> DataFrame:
    """Columns ``doc_id`` and ``fp`` (long), a row for each row of ``docs``."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"]
            )

    return source.mapInArrow(run, f"doc_id {id_type}, fp bigint")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _postings(fps: DataFrame) -> DataFrame:
    """``fp``, the number of the position set, and the key made of it and its bytes."""
    keys = []
    for number, positions in enumerate(POSITION_SETS):
        key = F.lit(number).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(F.col("fp"), p))
        keys.append(F.struct(F.lit(number).alias("number"), key.alias("key")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("p")).select("fp", "p.*")


def _linked(a: Column, b: Column, max_bits: int) -> Column:
    """Tally of shared positional bytes, then the bits themselves."""
    differ = a.bitwiseXOR(b)
    tally = sum((_byte(differ, p) == 0).cast("int") for p in range(BYTES))
    return (tally >= SHARED) & (F.bit_count(differ) <= max_bits)


def _pairs(posted: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    a, b = posted.alias("a"), posted.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    verified = (F.col("a.fp") < F.col("b.fp")) & _linked(F.col("a.fp"), F.col("b.fp"), max_bits)
    on = verified
    for s in same:
        on = s & on
    return a.join(b, on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _sized(posted: DataFrame, keys: list[str]) -> DataFrame:
    return posted.join(posted.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")), keys)


def _split(posted: DataFrame) -> DataFrame:
    """Long posting lists by one more byte; ``free`` has the three other positions."""
    choices = []
    for number, positions in enumerate(POSITION_SETS):
        others = [p for p in range(BYTES) if p not in positions]
        choices.append(
            F.when(
                F.col("number") == number,
                F.array(
                    *(
                        F.struct(
                            F.lit(p).alias("fifth"),
                            _byte(F.col("fp"), p).alias("byte"),
                            F.array(*(F.lit(o) for o in others if o != p)).alias("free"),
                        )
                        for p in others
                    )
                ),
            )
        )
    return posted.withColumn("s", F.explode(F.coalesce(*choices))).select("fp", "key", "s.*")


def _over_neighbours(dense: DataFrame, max_bits: int) -> DataFrame:
    """Links of fingerprints that share five bytes, without pairing them off.

    Two fingerprints at up to three bits have a value at most one bit from the
    first and two from the second. All within two bits of a value are linked to
    the smallest one within one bit of it. With a smaller ``max_bits`` the reach
    shrinks accordingly.
    """
    near, far = max_bits // 2, max_bits - max_bits // 2
    flips = F.expr(
        "transform(sequence(0, 23), j -> shiftleft(1L, 8 * free[j div 8] + j % 8))"
    )
    rows = dense.select("fp", "free").distinct().withColumn("one", flips)
    two = F.expr(
        "flatten(transform(one, (x, i) -> transform(slice(one, i + 2, 24), y -> x | y)))"
    )
    none = F.array(F.lit(0).cast("long"))
    reach = {0: none, 1: F.concat(none, F.col("one")), 2: F.concat(none, F.col("one"), two)}
    at = lambda k: rows.select("fp", F.explode(reach[k]).alias("x")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("x")).alias("v")
    )
    hubs = at(near).groupBy("v").agg(F.min("fp").alias("a"))
    return at(far).join(hubs, "v").filter("a <> fp").select("a", F.col("fp").alias("b"))


def links(fps: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """Links ``a``, ``b`` that join all fingerprints of ``fps`` (distinct) at ``max_bits`` or less.

    Every returned link is one; links within a crowd may be left out where others
    connect the same fingerprints.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    posted = materialize(_sized(_postings(fps), ["key"]).filter("size > 1"), "postings")
    found = _pairs(posted.filter(F.col("size") <= dense), ["key"], max_bits)
    keys = ["key", "fifth", "byte"]
    if posted.filter(F.col("size") > dense).limit(1).count():
        split = _split(posted.filter(F.col("size") > dense))
        split = materialize(_sized(split, keys).filter("size > 1"), "postings")
        found = found.unionByName(_pairs(split.filter(F.col("size") <= dense), keys, max_bits))
        found = found.unionByName(
            _over_neighbours(split.filter(F.col("size") > dense), max_bits)
        )
    return found.distinct()


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    max_bits: int = MAX_BITS,
    dense: int = DENSE,
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, a row for each row.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` bits, the row's own included. Copies have one fingerprint and
    enter the search once.
    """
    stored = materialize(with_fingerprints(docs, doc_id, text, shingle), "fingerprints")
    classes = materialize(
        stored.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes"
    )
    roots = connected_components(links(classes.select("fp"), max_bits, dense))
    linked = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(smallest, "root").select("fp", "component_id")
    return stored.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def first_of_each(
    docs: DataFrame, text: str = "text", shingle: int = 3, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row of ``docs`` for each component, columns as they are.

    Rows are numbered in a stored copy, so repeated and null ids do no harm; the
    first row of a component stays.
    """
    number = "_row_number_"
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(numbered, number, text, shingle, max_bits)
    # texts move for this join only if the rows that go are too many to be sent to them
    others = materialize(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(number)), "others")
    return numbered.join(others, number, "left_anti").drop(number)
