"""The physical plans are the intended ones."""

import re

import pytest
from conftest import SF_DIR

from txrisk.functions.exact import Span
from txrisk.operators import profiles, serving
from txrisk.operators.behaviour import add_features
from txrisk.plans import pipeline
from txrisk.plans.queries import registry
from txrisk.session import materialize
from txrisk.sources import shop


SPAN = Span(-1, 0)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(plan, node):
    """Occurrences of a physical operator, by its name at the start of a line."""
    return len(re.findall(rf"^[\s:+*()\d-]*{node}\b", plan, re.M))


@pytest.fixture(scope="module")
def stored(spark):
    return materialize(shop.load(spark, SF_DIR).transactions, "transactions")


def test_features_shuffle_once(spark, stored):
    plan = plan_of(pipeline.enrich(stored, shop.HotKeys(), span=SPAN))
    assert count(plan, "Exchange") == 1
    assert count(plan, "Sort") == 2
    assert count(plan, "Window") == 3


def test_user_join_and_features_share_the_shuffle(spark):
    """With a shuffled join of users the windows reuse its partitioning."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        txns = shop.transactions(spark, SF_DIR)
        joined = count(plan_of(txns), "Exchange")
        assert count(plan_of(pipeline.enrich(txns, shop.HotKeys(), span=SPAN)), "Exchange") == joined
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_flag_needs_no_window(spark, stored):
    plan = plan_of(add_features(stored, shop.HotKeys(), span=SPAN).select("txn_id", "is_new_device"))
    assert count(plan, "Window") == count(plan, "Exchange") == 0
    assert "prev" not in plan


def test_latest_rows_are_cut_before_the_shuffle(spark, stored):
    enriched = materialize(pipeline.enrich(stored, shop.HotKeys(), span=SPAN), "enriched")
    for df in (serving.latest_per_user(enriched), profiles.all_profiles(enriched)):
        plan = plan_of(df)
        assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")
        assert count(plan, "Exchange") == 1


def test_user_filter_reaches_the_scan(spark, stored):
    plan = plan_of(serving.user_history(pipeline.enrich(stored, shop.HotKeys(), span=SPAN), "user_10"))
    assert "EqualTo(user_id,user_10)" in plan


def scan_of(df):
    return next(line for line in plan_of(df).splitlines() if "FileScan parquet" in line)


def test_registered_reads_prune_the_published_layers(spark):
    queries = registry()
    read = queries["alerts_all"](spark, SF_DIR).inputFiles()
    assert read and all("gold/fraud_alerts" in f for f in read)
    by_level = scan_of(queries["alerts_by_level"](spark, SF_DIR))
    assert "risk_level" in by_level.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    by_period = scan_of(queries["alerts_by_period"](spark, SF_DIR))
    assert "process_date" in by_period.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    by_id = queries["txn_by_id"](spark, SF_DIR)
    assert "EqualTo(txn_id,tx_777)" in scan_of(by_id) and "Window" not in plan_of(by_id)
    for name in ("history_of_user", "profile_of_user", "alerts_by_user"):
        assert "EqualTo(user_id,user_10)" in scan_of(queries[name](spark, SF_DIR))


def test_checks_and_metrics_read_stored_rows(spark):
    for name in ("dq_report", "dq_report_sorted", "job_metrics"):
        result = registry()[name](spark, SF_DIR)
        plan = plan_of(result)
        assert "Join" not in plan and "Window" not in plan
        assert all("/run=" in f for f in result.inputFiles())
