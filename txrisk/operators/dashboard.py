"""Figures and lists shown on the dashboard. Input: the loaded (top 50) alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.columns import reason_label, total_of
from txrisk.operators.serving import rank_alerts
from txrisk.session import materialize

PAGE_SIZE = 10
SERIES_LENGTH = 10


def kpis(loaded: DataFrame) -> DataFrame:
    """One row: amount, critical alerts, users affected, alerts loaded."""
    return loaded.agg(
        F.coalesce(total_of(F.col("amount"), 6), F.lit(0.0)).alias("total_amount"),
        F.count_if(F.col("risk_level") == "CRITICAL").alias("critical_alerts"),
        F.count_distinct("user_id").alias("users_affected"),
        F.count(F.lit(1)).alias("loaded_alerts"),
    )


def score_series(loaded: DataFrame) -> DataFrame:
    """Label and score of the first ten alerts in rank order."""
    return rank_alerts(loaded).limit(SERIES_LENGTH).select(
        F.concat(F.lit("ID "), "txn_id").alias("label"), "risk_score"
    )


def paged(loaded: DataFrame) -> DataFrame:
    """Number the alerts by rank and by page of ten.

    Any number of alerts: they are cut into ranges of the rank order and stored,
    and each range is numbered by itself, on from the rows of the ranges before
    it. One row for each range is all that comes together.
    """
    order = (
        F.desc_nulls_last("risk_score"), F.desc_nulls_last("amount"), F.asc_nulls_last("txn_id")
    )
    ranges = loaded.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(
        ranges.withColumns(
            {"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}
        ),
        "ranked",
    )
    parts = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    starts = parts.select("part", (before - F.col("first") + 1).alias("start"))
    numbered = stored.join(F.broadcast(starts), "part").withColumn(
        "position", (F.col("place") + F.col("start")).cast("long")
    )
    return numbered.drop("part", "place", "start").withColumn(
        "page", F.ceil(F.col("position") / PAGE_SIZE).cast("long")
    )


def page(loaded: DataFrame, number: int) -> DataFrame:
    """One page in rank order; a number past the last page gives no rows."""
    return paged(loaded).filter(F.col("page") == number).orderBy("position")


def with_labels(alerts: DataFrame) -> DataFrame:
    """Add ``reason_labels``, the readable form of each reason in order."""
    return alerts.withColumn(
        "reason_labels",
        F.transform(F.coalesce("risk_reasons", F.array().cast("array<string>")), reason_label),
    )


def with_route(alerts: DataFrame) -> DataFrame:
    """Add ``route_from``, the previous country or a dash."""
    return alerts.withColumn("route_from", F.coalesce("prev_country", F.lit("-")))
