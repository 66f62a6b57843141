"""The batch job: users and transactions in, five lake layers and metrics out."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions.exact import Span
from txrisk.operators.behaviour import add_features
from txrisk.operators.quality import quality_report, require_pass
from txrisk.operators.scoring import ALERT_LEVELS, add_risk, only_alerts
from txrisk.operators.skew import ROWS_PER_TASK, HotKeys
from txrisk.plans import lake
from txrisk.session import materialize, released


def enrich(
    txns: DataFrame,
    hot: HotKeys | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    span: Span | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Features, score, reasons, level and decision of every transaction."""
    return add_risk(add_features(txns, hot, rows_per_task, span, tasks))


def with_scenarios(txns: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Both sets of transactions, matched by column name; duplicates stay."""
    return txns.unionByName(scenarios)


def alerts_per_level(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("risk_level").agg(F.count(F.lit(1)).alias("alerts")).orderBy("risk_level")


def metrics(users: DataFrame, txns: DataFrame, enriched: DataFrame) -> DataFrame:
    """Row counts of the relations and of the alerts per level, and the largest user.

    ``metric``, ``value`` and ``detail``, which names the user. One pass over
    each relation; transactions are counted per user in every task before the
    shuffle.
    """
    everything = F.count(F.lit(1))
    level = F.col("risk_level")
    counted = [
        users.agg(everything.alias("users")),
        txns.agg(everything.alias("transactions")),
        enriched.agg(
            everything.alias("enriched_transactions"),
            F.count_if(level.isin(ALERT_LEVELS)).alias("alerts"),
            *[F.count_if(level == name).alias(f"alerts_{name.lower()}") for name in ALERT_LEVELS],
        ),
    ]
    rows = [row.unpivot([], row.columns, "metric", "value") for row in counted]
    plain = reduce(DataFrame.unionByName, rows).withColumn("detail", F.lit(None).cast("string"))
    largest = (
        txns.groupBy("user_id")
        .agg(everything.alias("value"))
        .orderBy(F.desc("value"), F.asc_nulls_last("user_id"))
        .limit(1)
        .select(F.lit("largest_user").alias("metric"), "value", F.col("user_id").alias("detail"))
    )
    return plain.unionByName(largest)


def run(
    users: DataFrame,
    txns: DataFrame,
    root: str,
    scenarios: DataFrame | None = None,
    process_date: datetime.date | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Score the transactions and publish the lake below ``root``; returns the metrics.

    Every layer is written once. The inputs go to bronze first, features and
    score are taken from there, and checks, alerts and metrics from the layers
    before them. The number of tasks and files follows the stored rows. Raises
    ``QualityError`` before the run is published if a check fails; what the run
    wrote is deleted then, as is everything else it stored on the way.
    """
    spark, run_id = users.sparkSession, lake.new_run()
    if scenarios is not None:
        txns = with_scenarios(txns, scenarios)
    try:
        with released(spark):
            users = lake.write_layer(users, root, lake.BRONZE_USERS, run_id)
            txns = lake.write_layer(txns, root, lake.BRONZE_TRANSACTIONS, run_id)
            tasks = lake.files_for(spark, txns.count())
            # numbers of stored rows: the same again if a task is repeated
            numbered = txns.withColumn("row_no", F.monotonically_increasing_id())
            scored = enrich(numbered, rows_per_task=rows_per_task, tasks=tasks)
            # The range shuffle of the layer reads its input twice: it gets stored rows.
            scored = materialize(scored, "scored")
            enriched = lake.write_layer(scored, root, lake.SILVER, run_id, tasks)
            report = lake.write_layer(
                quality_report(users, txns, enriched, process_date), root, lake.DATA_QUALITY, run_id
            )
            require_pass(report)
            lake.write_layer(only_alerts(enriched), root, lake.ALERTS, run_id)
            lake.publish(spark, root, run_id)
    except BaseException:
        lake.discard(spark, root, run_id)
        raise
    return metrics(users, txns, enriched)
