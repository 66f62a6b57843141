"""Risk profile of a user: totals and reasons over all or the latest transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.functions.columns import total_of
from txrisk.operators.scoring import ALERT_LEVELS
from txrisk.operators.serving import MAX_HISTORY, latest_per_user, user_history


def _is_alert() -> Column:
    return F.col("risk_level").isin(ALERT_LEVELS)


def _figures() -> list[Column]:
    # At most MAX_HISTORY rows per user get here, so the lists are short.
    reasons = F.flatten(F.collect_list(F.when(_is_alert(), F.col("risk_reasons"))))
    return [
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(_is_alert()).alias("total_alerts"),
        F.max(F.coalesce("risk_score", F.lit(0))).alias("max_risk_score"),
        total_of(F.coalesce(F.col("amount"), F.lit(0.0))).alias("total_amount"),
        F.array_sort(F.array_distinct(reasons)).alias("top_reasons"),
    ]


def profile_of(history: DataFrame, user_id: str) -> DataFrame:
    """Profile of the given history rows under the name ``user_id``; no rows, no profile.

    Any number of rows. They are summed up by the magnitude of their amount,
    from 2^(24 s) to 2^(24 s + 24), of which doubles have 43, and those sums are
    put together; the lists of reasons are as many as the rules combine to. The
    total is that of ``total_of``, but amounts without a decimal are added up
    within a magnitude first, so that it depends on no order.
    """
    c, amount = F.col, F.coalesce(F.col("amount"), F.lit(0.0))
    finite = F.abs(amount) < float("inf")
    up, down = F.pow(F.lit(2.0), 12 * c("s")), F.pow(F.lit(2.0), -12 * c("s"))
    size = F.when(finite, F.greatest(F.lit(0), F.floor(F.log2(F.abs(amount)) / 24).cast("int")))
    by_size = (
        history.select(
            F.coalesce(size, F.lit(0)).alias("s"),
            amount.alias("amount"),
            amount.try_cast("decimal(38,6)").alias("exact"),
            F.coalesce("risk_score", F.lit(0)).alias("score"),
            F.coalesce(_is_alert(), F.lit(False)).alias("alert"),
            "risk_reasons",
        )
        .groupBy("s")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if("alert").alias("alerts"),
            F.max("score").alias("score"),
            F.collect_set(F.when(c("alert"), c("risk_reasons"))).alias("reasons"),
            F.try_sum("exact").alias("exact"),
            F.count_if(c("exact").isNull()).alias("lost"),
            # within a magnitude the decimals of all amounts have the same places
            F.sum(F.when(finite, c("amount") * down * down).cast("decimal(38,16)")).alias("part"),
            F.sum(F.when(~finite, c("amount"))).alias("odd"),
        )
        .withColumn("part", F.coalesce(c("part").cast("double") * up * up, F.lit(0.0)))
    )
    parts = F.array_sort(F.collect_list(F.struct("s", "part")))
    plain = F.aggregate(parts, F.lit(0.0), lambda total, x: total + x["part"])
    whole = F.when(
        (F.sum("lost") == 0) & (F.count("exact") == F.count(F.lit(1))),
        F.round(F.try_sum("exact"), 2).cast("double"),
    )
    reasons = F.flatten(F.flatten(F.collect_list("reasons")))
    return (
        by_size.agg(
            F.sum("rows").alias("total_transactions"),
            F.sum("alerts").alias("total_alerts"),
            F.max("score").alias("max_risk_score"),
            F.coalesce(
                whole, F.round(plain + F.coalesce(F.sum("odd"), F.lit(0.0)), 2)
            ).alias("total_amount"),
            F.array_sort(F.array_distinct(reasons)).alias("top_reasons"),
        )
        .filter(F.col("total_transactions") > 0)
        .select(F.lit(user_id).alias("user_id"), "*")
    )


def user_profile(
    enriched: DataFrame, user_id: str, latest: int | None = MAX_HISTORY
) -> DataFrame:
    """Profile of one user over the ``latest`` transactions, over all of them if None."""
    if latest is None:
        return profile_of(enriched.filter(F.col("user_id") == user_id), user_id)
    return profile_of(user_history(enriched, user_id, latest), user_id)


def all_profiles(enriched: DataFrame) -> DataFrame:
    """The profile of every user in one job."""
    return latest_per_user(enriched, MAX_HISTORY).groupBy("user_id").agg(*_figures())
