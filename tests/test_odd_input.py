"""Values that CSV text and callers may hold."""

import datetime as dt
import math

import pytest
import rows
from pyspark.sql import functions as F

from txrisk.functions.columns import great_circle_km
from txrisk.operators import dashboard, profiles, serving

NAN = float("nan")


def test_nan_coordinates_have_no_distance(spark):
    rows = [(NAN, 0.0, 1.0, 1.0), (NAN, NAN, NAN, NAN), (0.0, 1.0, 1.0, NAN), (0.0, 0.0, 0.0, 180.0), (5.0, 6.0, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    km = [r[0] for r in df.select(great_circle_km(*map(F.col, "abcd"))).collect()]
    assert km[:3] == [None] * 3 and round(km[3], 2) == 20015.09 and km[4] == 0.0


@pytest.mark.parametrize("text", ["2026-W01-1", "20260101", "2026-1-1", "٢٠٢٦-٠١-٠١"])
def test_only_plain_dates(spark, text):
    with pytest.raises(ValueError):
        serving._day(text)


def test_odd_amounts_do_not_stop_totals(spark):
    """1e25 and 1e40 count in full, NaN gives NaN, and other users are not touched."""
    day = dt.datetime(2026, 5, 1)
    made = rows.enriched(spark, [
        dict(txn_id=f"t{i}", user_id=user, amount=amount, txn_ts=day, risk_score=60, risk_level="HIGH")
        for i, (user, amount) in enumerate([
            ("big", 1e25), ("bigger", 1e40), ("bigger", 1e40), ("nan", NAN), ("nan", 1.0),
            ("plain", 0.1), ("plain", 0.2), ("none", None), ("inf", float("inf")),
        ])
    ])
    got = {r.user_id: r.total_amount for r in profiles.all_profiles(made).collect()}
    assert math.isnan(got.pop("nan"))
    assert got == {"big": 1e25, "bigger": 2e40, "plain": 0.3, "none": 0.0, "inf": float("inf")}
    assert profiles.user_profile(made, "big").first().total_amount == 1e25
    kpis = dashboard.kpis(made.filter("user_id in ('big', 'plain')")).first()
    assert kpis.total_amount == 1e25 and kpis.loaded_alerts == 3
    assert math.isnan(dashboard.kpis(made).first().total_amount)
    assert dashboard.kpis(made.limit(0)).first().total_amount == 0.0


@pytest.mark.parametrize("amounts, total", [
    ([0.1, 0.2, None], 0.3), ([None], 0.0), ([1e25, 0.01], 1e25), ([1e40, 1e40, 3.0], 2e40),
    ([1e40, 5.0, -1e40], 5.0), ([9e31, 9e31, 1.5], 1.8e32), ([NAN, 1.0], NAN),
    ([float("inf"), 1.0], float("inf")), ([float("inf"), float("-inf")], NAN),
    ([1.7e308, -1.7e308, 1.7e308], 1.7e308), ([1.7e308, 1.7e308], float("inf")),
    ([5e-324, 2.0], 2.0), ([-3.0, 1.005], -2.0),
])
def test_total_of_a_whole_history(spark, amounts, total):
    """Each finite amount twice and once with the other sign, in one task or many."""
    every = [a for a in amounts for _ in range(2)] + [-a for a in amounts if a and math.isfinite(a)]
    made = rows.enriched(spark, [dict(user_id="u", amount=a, risk_level="LOW") for a in every])
    for tasks in (1, 5):
        row = profiles.user_profile(made.repartition(tasks), "u", latest=None).first()
        assert row.total_transactions == len(every)
        assert row.total_amount == total or math.isnan(total) and math.isnan(row.total_amount)


def test_pages_of_many_alerts(spark):
    """A million alerts are numbered in many tasks, each from the ranges before it."""
    alerts = spark.range(1_000_000).selectExpr(
        "concat('t', id) as txn_id", "cast(id % 101 as int) as risk_score", "double(id % 997) as amount"
    )
    paged = dashboard.paged(alerts)
    assert paged.select(F.spark_partition_id()).distinct().count() > 1
    checked = paged.agg(F.min("position"), F.max("position"), F.count_distinct("position"), F.max("page"))
    assert tuple(checked.first()) == (1, 1_000_000, 1_000_000, 100_000)
    first = serving.rank_alerts(alerts).limit(25).select("txn_id").collect()
    assert paged.filter("position <= 25").orderBy("position").select("txn_id").collect() == first
    assert [r.position for r in dashboard.page(alerts, 7).collect()] == list(range(61, 71))
