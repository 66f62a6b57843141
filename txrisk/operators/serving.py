"""Read queries over the gold alerts, the quality report and the silver layer."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.columns import on_or_after, on_or_before
from txrisk.operators.scoring import DECISIONS

MAX_LISTED = 500
MAX_HISTORY = 200


def _within(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}, not {limit}")
    return limit


def _day(text: str) -> datetime.date:
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        raise ValueError(f"not a yyyy-mm-dd date: {text}")
    return datetime.date.fromisoformat(text)


def filter_alerts(
    alerts: DataFrame,
    *,
    risk_level: str | None = None,
    user_id: str | None = None,
    country: str | None = None,
    reason: str | None = None,
    min_amount: float | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    decision: str | None = None,
) -> DataFrame:
    """Rows that meet every given condition; None and empty text mean no condition.

    ``risk_level`` and the dates prune partitions of the gold layer; the rest
    but ``reason`` are pushed to the Parquet scan.
    """
    c = F.col
    if min_amount is not None and min_amount < 0:
        raise ValueError("min_amount must not be negative")
    if decision and decision not in DECISIONS:
        raise ValueError(f"decision must be one of {', '.join(DECISIONS)}")
    conditions = []
    if risk_level:
        conditions.append(c("risk_level") == risk_level)
    if user_id:
        conditions.append(c("user_id") == user_id)
    if country:
        conditions.append(c("txn_country") == country)
    if reason:
        conditions.append(F.array_contains("risk_reasons", reason))
    if min_amount is not None:
        conditions.append(c("amount") >= float(min_amount))
    if date_from:
        conditions.append(on_or_after(c("process_date"), c("txn_ts"), F.lit(_day(date_from))))
    if date_to:
        conditions.append(on_or_before(c("process_date"), c("txn_ts"), F.lit(_day(date_to))))
    if decision:
        conditions.append(c("decision") == decision)
    for condition in conditions:
        alerts = alerts.filter(condition)
    return alerts


def rank_alerts(alerts: DataFrame) -> DataFrame:
    """Highest score first, then highest amount; the id settles ties."""
    return alerts.orderBy(
        F.desc_nulls_last("risk_score"), F.desc_nulls_last("amount"), F.asc_nulls_last("txn_id")
    )


def list_alerts(alerts: DataFrame, *, limit: int = 50, **conditions) -> DataFrame:
    """The top ``limit`` alerts under the conditions of ``filter_alerts``."""
    chosen = filter_alerts(alerts, **conditions)
    return rank_alerts(chosen).limit(_within(limit, MAX_LISTED))


def list_quality(report: DataFrame, limit: int = 50) -> DataFrame:
    return report.orderBy(F.asc_nulls_last("check_name")).limit(_within(limit, MAX_LISTED))


def transaction_by_id(enriched: DataFrame, txn_id: str) -> DataFrame:
    """At most one row; none if there is no such transaction."""
    return enriched.filter(F.col("txn_id") == txn_id).limit(1)


def user_history(enriched: DataFrame, user_id: str, limit: int = 20) -> DataFrame:
    """Latest transactions of one user, newest first."""
    return (
        enriched.filter(F.col("user_id") == user_id)
        .orderBy(F.desc_nulls_last("txn_ts"), F.desc_nulls_last("txn_id"))
        .limit(_within(limit, MAX_HISTORY))
    )


def latest_per_user(enriched: DataFrame, limit: int = 20) -> DataFrame:
    """``user_history`` of every user, with its position in ``recency``.

    Each task keeps only its own ``limit`` latest rows per user before the
    shuffle, so no user is too large.
    """
    newest = Window.partitionBy("user_id").orderBy(
        F.desc_nulls_last("txn_ts"), F.desc_nulls_last("txn_id")
    )
    return enriched.withColumn("recency", F.row_number().over(newest)).filter(
        F.col("recency") <= _within(limit, MAX_HISTORY)
    )
