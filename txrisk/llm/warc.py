"""Merkle fixity audit of WARC replicas.

Pages become WARC records in one global order, a fixed number to a file, with
offsets. The leaves of a replica's tree are digests of records. A node above
hashes the ordered offset range that it covers and its children. The roots of two
replicas are compared, and only the children of nodes that differ are looked at
on the next level, down to the damaged records.

Null fields are written as empty. Repeated rows are records of their own,
interchangeable in the order. Empty replicas agree; records that only one
replica has are reported with a null digest on the other side. Pages of any length
are records like others. Columns other than the three of a page are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txrisk.llm.common import shuffle_parts
from txrisk.session import materialize

FAN_OUT_BITS = 4
FILE_BITS = 3 * FAN_OUT_BITS  # a file has 4,096 records, so a node of level 3 is a file
_SALTS = 1024


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def record() -> Column:
    """A WARC record of columns ``page_id``, ``url`` and ``html``."""
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        _empty("page_id"),
        F.lit(">\r\nWARC-Target-URI: "),
        _empty("url"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(_empty("html")).cast("string"),
        F.lit("\r\n\r\n"),
        _empty("html"),
        F.lit("\r\n\r\n"),
    )


def in_order(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``html`` and ``position``, the place in the order of these three.

    Rows are range-partitioned and sorted in their partitions; the position is
    the number of rows in earlier partitions plus that within the own. Equal
    keys are spread by a salt.
    """
    rows = pages.select("page_id", "url", "html").withColumn(
        "salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS))
    )
    keys = ["page_id", "url", "html"]
    ranged = rows.repartitionByRange(shuffle_parts(pages), *keys, "salt").drop("salt")
    row_bits = 33  # of an id within its partition
    placed = materialize(
        ranged.sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "records"
    ).withColumn("part", F.shiftright("at", row_bits))
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    # one row for each partition of the range shuffle
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    position = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << row_bits) - 1))
    return placed.join(F.broadcast(starts), "part").select(*keys, position.alias("position"))


def manifest(records: DataFrame, payload: str = "record") -> DataFrame:
    """``position``, ``file``, ``start`` and ``end`` (bytes in the file) and ``digest``."""
    sized = records.select(
        "position",
        F.shiftright("position", FILE_BITS).alias("file"),
        F.octet_length(payload).cast("long").alias("n_bytes"),
        F.sha2(payload, 256).alias("digest"),
    )
    upto = Window.partitionBy("file").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("n_bytes").over(upto)
    return sized.select("position", "file", (end - F.col("n_bytes")).alias("start"), end.alias("end"), "digest")


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels of a tree from a stored manifest: ``node``, ``start``, ``end``, ``digest``."""
    top = leaves.agg(F.max("position")).first()[0]
    levels = [leaves.select(F.col("position").alias("node"), "start", "end", "digest")]
    while top:
        top >>= FAN_OUT_BITS
        children = F.sort_array(F.collect_list(F.struct("node", "start", "end", "digest")))
        parents = (
            levels[-1]
            .groupBy(F.shiftright("node", FAN_OUT_BITS).alias("parent"))
            .agg(children.alias("c"))
            .select(
                F.col("parent").alias("node"),
                F.expr("c[0].start").alias("start"),
                F.expr("c[size(c) - 1].end").alias("end"),
                F.sha2(
                    F.expr("array_join(transform(c, x -> concat_ws(':', x.start, x.end, x.digest)), ' ')"),
                    256,
                ).alias("digest"),
            )
        )
        levels.append(materialize(parents, "tree"))
    return levels


def audit(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Records whose digests differ between two manifests.

    ``position``, ``file``, ``start`` and ``end`` as the first has them (or the
    second, if only that has the record), ``expected`` and ``found`` digest.
    """
    expected, found = materialize(expected, "manifest"), materialize(found, "manifest")
    mine, theirs = tree(expected), tree(found)
    suspects = None
    for level in reversed(range(max(len(mine), len(theirs)))):
        a = mine[level] if level < len(mine) else mine[0].limit(0)
        b = theirs[level] if level < len(theirs) else theirs[0].limit(0)
        if suspects is not None:
            below = lambda x: x.join(
                suspects, F.shiftright(x["node"], FAN_OUT_BITS) == suspects["suspect"], "left_semi"
            )
            a, b = below(a), below(b)
        a, b = a.alias("a"), b.alias("b")
        differ = a.join(b, F.col("a.node") == F.col("b.node"), "full").filter(
            ~F.col("a.digest").eqNullSafe(F.col("b.digest"))
            | ((~F.col("a.start").eqNullSafe(F.col("b.start"))) & F.lit(level > 0))
            | ((~F.col("a.end").eqNullSafe(F.col("b.end"))) & F.lit(level > 0))
        )
        if level:
            suspects = materialize(
                differ.select(F.coalesce("a.node", "b.node").alias("suspect")), "suspects"
            )
    position = F.coalesce("a.node", "b.node")
    return differ.select(
        position.alias("position"),
        F.shiftright(position, FILE_BITS).alias("file"),
        F.coalesce("a.start", "b.start").alias("start"),
        F.coalesce("a.end", "b.end").alias("end"),
        F.col("a.digest").alias("expected"),
        F.col("b.digest").alias("found"),
    )


def with_bit_rot(records: DataFrame, damaged: Column, payload: str = "record") -> DataFrame:
    """A replica in which the middle character of ``damaged`` records is overwritten."""
    middle = F.expr(f"length({payload}) div 2")
    broken = F.concat(
        F.substring(payload, F.lit(1), middle), F.lit("~"), F.substring(payload, middle + 2, F.length(payload))
    )
    return records.withColumn(payload, F.when(damaged, broken).otherwise(F.col(payload)))
