"""Mixing sources to target weights by histograms of hash thresholds.

Each document has a 60-bit hash. A source whose target is ``r`` times its size
takes every document ``floor(r)`` times and once more those whose hash lies
below a threshold. The threshold comes from nested histograms: tokens are summed
by source and the first 15 bits, the bucket in which the budget ends is refined
by the next 15 bits, and so on through all four levels; documents are never
sorted. The document at the threshold is taken if that ends nearer to the
target.

Null texts and texts without words have size 0. A null source is a source of its
own, the last one. Rows equal in id and text have one hash, so they are taken
together. A null id is hashed with its text. Long texts are counted whole; of two
thresholds equally near to the target the higher one holds. Other columns are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txrisk.llm.common import n_words
from txrisk.session import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
LEVELS, LEVEL_BITS = 4, 15

# The table of sources is broadcast up to this many rows (about 100 bytes each);
# beyond, it is joined with every source dealt over SPREAD parts.
BROADCAST_SOURCES = 100_000
SPREAD = 64


def _same(a: DataFrame, b: DataFrame):
    return a["source"].eqNullSafe(b["source"])


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows of ``source`` and ``size``.

    Sources in the order of code points, null last, have the weights in turn.
    The total is shared by weight; what exceeds ``max_repeats`` times a source's
    size is shared among the others again. That ends at one level for each unit
    of weight: sources in the order of their limit for a unit are full as long
    as the level that is left for the rest exceeds it. Windows without partition
    run over one row for each source, never over documents.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    per_source = per_source.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    ).withColumn("limit", max_repeats * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_limit.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    ) / F.sum("weight").over(rest)
    full = F.col("limit") / F.col("weight") <= level
    ranked = per_source.withColumn("level", level).withColumn("full", full)
    # the level of the first source that is not full holds for all after it
    final = F.min(F.when(~F.col("full"), F.struct("limit_rank", "level"))).over(everything)
    ranked = ranked.withColumn("limit_rank", F.row_number().over(by_limit))
    ranked = ranked.withColumn("final", final["level"])
    return ranked.select(
        "source",
        "source_size",
        F.when(F.col("full") | F.col("final").isNull(), F.col("limit").cast("double"))
        .otherwise(F.col("final") * F.col("weight"))
        .alias("target"),
    )


def _level(h: str, level: int):
    return F.shiftrightunsigned(F.col(h), LEVEL_BITS * (LEVELS - 1 - level)).bitwiseAND(
        F.lit((1 << LEVEL_BITS) - 1)
    )


def _join_sources(rows: DataFrame, table: DataFrame, n_sources: int) -> DataFrame:
    """Inner join on the source, hot sources included, without moving ``rows`` to one task."""
    if n_sources <= BROADCAST_SOURCES:
        table = F.broadcast(table)
        return rows.join(table, _same(rows, table)).drop(table["source"])
    dealt = rows.withColumn("part", F.pmod(F.col("h"), F.lit(SPREAD)))
    copies = table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    on = _same(dealt, copies) & (dealt["part"] == copies["part"])
    return dealt.join(copies, on).drop(copies["source"]).drop(copies["part"]).drop("part")


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.col(text)), 4)
    return docs.withColumn("size", n_words(text)).withColumn("h", hashed).withColumn(
        "source", F.col(source)
    )


def thresholds(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """The stored plan of the mix, a row for each source.

    ``sized`` is stored and has ``source``, ``size`` and the 60-bit hash ``h``.
    Documents are taken ``whole`` times and once more if ``h < threshold``.
    """
    plan = targets(sized.select("source", "size"), weights, max_repeats)
    plan = plan.withColumn(
        "whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    ).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialize(plan, "targets")
    n_sources = plan.count()

    # ``prefix``: the bits so far of the bucket in which the budget ends;
    # ``left``: what is left of the budget where the bucket begins.
    edge = plan.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - level)
        inside = _join_sources(sized, edge, n_sources).filter(
            F.shiftrightunsigned("h", shift) == F.col("prefix")
        )
        buckets = inside.groupBy("source", "prefix", "left", _level("h", level).alias("bucket")).agg(
            F.sum("size").alias("tokens")
        )
        in_order = Window.partitionBy("source").orderBy("bucket")
        upto = F.sum("tokens").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
        # the first bucket that exceeds the budget, else the last one
        ended = buckets.withColumn("upto", upto).groupBy("source", "prefix", "left").agg(
            F.coalesce(
                F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "tokens", "upto"))),
                F.max(F.struct("bucket", "tokens", "upto")),
            ).alias("at")
        )
        edge = materialize(
            ended.select(
                "source",
                F.shiftleft("prefix", LEVEL_BITS).bitwiseOR(F.col("at.bucket")).alias("prefix"),
                (F.col("left") - F.col("at.upto") + F.col("at.tokens")).alias("left"),
                F.col("at.tokens").alias("tokens"),
            ),
            "edges",
        )
    # all of the last bucket or nothing of it, whichever is nearer
    threshold = F.col("prefix") + F.when(2 * F.col("left") >= F.col("tokens"), 1).otherwise(0)
    edge = edge.select("source", threshold.alias("threshold"))
    plan = plan.join(edge, _same(plan, edge)).drop(edge["source"])
    return materialize(
        plan.select("source", "source_size", "target", "whole", "budget", "threshold"), "plan"
    )


def _repeats(max_repeats: int):
    extra = (F.col("whole") < max_repeats) & (F.col("budget") > 0) & (F.col("h") < F.col("threshold"))
    return (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("int")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``repeats``, ``taken``.

    A row for each document; ``repeats`` is how often the mix takes it and
    ``taken`` the words that makes.
    """
    sized = _sized(docs, doc_id, text, source).select(
        F.col(doc_id).alias("doc_id"), "source", "size", "h"
    )
    sized = materialize(sized, "sizes")
    plan = thresholds(sized, weights, max_repeats)
    return (
        _join_sources(sized, plan, plan.count())
        .withColumn("repeats", _repeats(max_repeats))
        .select(
            "doc_id",
            "size",
            "source",
            "source_size",
            "target",
            "repeats",
            (F.col("repeats") * F.col("size")).alias("taken"),
        )
    )


def mixed_rows(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns as they are.

    The texts stay where they are read: only sizes and the plan are stored.
    """
    names = docs.columns
    given = docs.select(F.struct(*names).alias("row"))
    fields = given.select("row", *(F.col(f"row.{c}").alias(c) for c in {doc_id, text, source}))
    fields = _sized(fields, doc_id, text, source)
    sized = materialize(fields.select("source", "size", "h"), "sizes")
    plan = thresholds(sized, weights, max_repeats)
    taken = _join_sources(fields.select("row", "source", "h"), plan, plan.count())
    taken = taken.withColumn("repeats", _repeats(max_repeats)).filter("repeats > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("repeats"))).alias("row")).select("row.*")
