"""Alert filters, ranking, lookups, profiles and dashboard figures."""

import datetime as dt

import pytest
import rows
from pyspark.sql import functions as F

from txrisk.functions.columns import reason_label
from txrisk.operators import dashboard, profiles, serving

ALERTS = [
    dict(txn_id="tx_1", user_id="user_1", risk_level="CRITICAL", risk_score=95, amount=5000.0,
         decision="BLOCK", txn_country="JP", process_date=dt.date(2026, 5, 22),
         risk_reasons=["IMPOSSIBLE_TRAVEL", "NEW_COUNTRY_FOR_USER"]),
    dict(txn_id="tx_2", user_id="user_2", risk_level="HIGH", risk_score=70, amount=8000.0,
         decision="REVIEW", txn_country="BR", process_date=dt.date(2026, 5, 21),
         risk_reasons=["VALUE_ABOVE_USER_PROFILE"]),
    dict(txn_id="tx_3", user_id="user_1", risk_level="MEDIUM", risk_score=45, amount=900.0,
         decision="REVIEW", txn_country="US", process_date=dt.date(2026, 5, 20),
         risk_reasons=["NEW_DEVICE"]),
]


@pytest.fixture(scope="module")
def alerts(spark):
    return rows.enriched(spark, ALERTS)


def ids(df):
    return [row.txn_id for row in df.collect()]


def test_reason_and_period(alerts):
    chosen = serving.filter_alerts(
        alerts, reason="IMPOSSIBLE_TRAVEL", date_from="2026-05-22", date_to="2026-05-22"
    )
    assert ids(chosen) == ["tx_1"]


def test_score_ranks_and_amount_settles_ties(spark):
    made = rows.enriched(spark, [
        dict(txn_id="low", risk_score=60, amount=10000.0),
        dict(txn_id="high", risk_score=90, amount=100.0),
        dict(txn_id="tie", risk_score=90, amount=500.0),
        dict(txn_id="unscored", risk_score=None, amount=1.0),
        dict(txn_id="no_amount", risk_score=90, amount=None),
    ])
    assert ids(serving.rank_alerts(made)) == ["tie", "high", "no_amount", "low", "unscored"]


def test_limit(alerts):
    assert ids(serving.list_alerts(alerts, limit=2)) == ["tx_1", "tx_2"]


def test_decision(alerts):
    assert ids(serving.filter_alerts(alerts, decision="BLOCK")) == ["tx_1"]


@pytest.mark.parametrize("conditions, expected", [
    (dict(risk_level="HIGH"), {"tx_2"}),
    (dict(risk_level="LOW"), set()),
    (dict(user_id="user_1"), {"tx_1", "tx_3"}),
    (dict(country="US"), {"tx_3"}),
    (dict(min_amount=5000), {"tx_1", "tx_2"}),
    (dict(min_amount=0), {"tx_1", "tx_2", "tx_3"}),
    (dict(date_from="2026-05-21"), {"tx_1", "tx_2"}),
    (dict(date_to="2026-05-21"), {"tx_2", "tx_3"}),
    (dict(risk_level="", user_id="", country="", reason="", date_from="", decision=""),
     {"tx_1", "tx_2", "tx_3"}),
    (dict(user_id="user_1", risk_level="MEDIUM", reason="NEW_DEVICE"), {"tx_3"}),
])
def test_each_filter(alerts, conditions, expected):
    assert set(ids(serving.filter_alerts(alerts, **conditions))) == expected


def test_period_falls_back_to_the_time(spark):
    made = rows.enriched(spark, [
        dict(txn_id="by_time", txn_ts=rows.at("2026-05-22 23:59:59")),
        dict(txn_id="day_wins", process_date=dt.date(2026, 5, 23),
             txn_ts=rows.at("2026-05-22 00:00:00")),
        dict(txn_id="undated"),
    ])
    one_day = dict(date_from="2026-05-22", date_to="2026-05-22")
    assert ids(serving.filter_alerts(made, **one_day)) == ["by_time"]


def test_missing_values_fail_a_filter(spark):
    made = rows.enriched(spark, [dict(txn_id="bare")])
    assert ids(serving.filter_alerts(made, min_amount=0)) == []
    assert ids(serving.filter_alerts(made, reason="NEW_DEVICE")) == []


@pytest.mark.parametrize("conditions", [
    dict(limit=0), dict(limit=501), dict(min_amount=-1), dict(decision="MAYBE"),
    dict(date_from="2026-13-40"), dict(date_to="20260522"),
])
def test_bad_arguments(alerts, conditions):
    with pytest.raises(ValueError):
        serving.list_alerts(alerts, **conditions)


def test_lookup_and_history(spark):
    made = rows.enriched(spark, [
        dict(txn_id=f"t{i}", user_id="u", txn_ts=rows.at(f"2026-05-20 10:00:{i:02d}"))
        for i in range(25)
    ])
    assert ids(serving.transaction_by_id(made, "t7")) == ["t7"]
    assert ids(serving.transaction_by_id(made, "none")) == []
    assert ids(serving.user_history(made, "u")) == [f"t{i}" for i in range(24, 4, -1)]
    assert ids(serving.user_history(made, "u", 3)) == ["t24", "t23", "t22"]
    assert serving.user_history(made, "nobody").count() == 0
    with pytest.raises(ValueError):
        serving.user_history(made, "u", 201)


def test_profile_of_given_rows(alerts):
    assert profiles.profile_of(alerts, "user_1").first().asDict() == dict(
        user_id="user_1", total_transactions=3, total_alerts=3, max_risk_score=95,
        total_amount=13900.0,
        top_reasons=["IMPOSSIBLE_TRAVEL", "NEW_COUNTRY_FOR_USER", "NEW_DEVICE",
                     "VALUE_ABOVE_USER_PROFILE"],
    )


def test_profile_of_one_user(alerts):
    expected = dict(
        user_id="user_1", total_transactions=2, total_alerts=2, max_risk_score=95,
        total_amount=5900.0,
        top_reasons=["IMPOSSIBLE_TRAVEL", "NEW_COUNTRY_FOR_USER", "NEW_DEVICE"],
    )
    assert profiles.user_profile(alerts, "user_1").first().asDict() == expected
    assert profiles.user_profile(alerts, "nobody").count() == 0
    everyone = {r.user_id: r.asDict() for r in profiles.all_profiles(alerts).collect()}
    assert everyone["user_1"] == expected and everyone.keys() == {"user_1", "user_2"}


def test_profile_covers_the_latest_200(spark):
    start = rows.at("2026-05-20 00:00:00")
    made = rows.enriched(spark, [
        dict(txn_id=f"t{i:03d}", user_id="u", amount=1.005 if i >= 10 else 1000.0,
             risk_score=90 if i < 10 else None, risk_level="HIGH" if i < 10 else "LOW",
             risk_reasons=["NEW_DEVICE"], txn_ts=start + dt.timedelta(seconds=i))
        for i in range(210)
    ])
    expected = dict(user_id="u", total_transactions=200, total_alerts=0, max_risk_score=0,
                    total_amount=201.0, top_reasons=[])
    assert profiles.all_profiles(made).first().asDict() == expected
    assert profiles.user_profile(made, "u").first().asDict() == expected


def test_profile_of_one_user_covers_every_row(spark):
    start = rows.at("2026-05-20 00:00:00")
    made = rows.enriched(spark, [
        dict(txn_id=f"t{i:03d}", user_id="u" if i % 2 else "v", amount=1.005 if i >= 10 else 1000.0,
             risk_score=90 if i < 10 else None, risk_level="HIGH" if i < 10 else "LOW",
             risk_reasons=["NEW_DEVICE"], txn_ts=start + dt.timedelta(seconds=i))
        for i in range(610)
    ])
    got = profiles.user_profile(made.repartition(7), "u", latest=None)
    assert got.first().asDict() == dict(
        user_id="u", total_transactions=305, total_alerts=5, max_risk_score=90,
        total_amount=5301.5, top_reasons=["NEW_DEVICE"])
    assert profiles.user_profile(made, "nobody", latest=None).count() == 0
    # nothing is collected row by row: sums by the magnitude of the amount come together
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "collect_list(amount" not in plan
    assert "collect_list(risk_reasons" not in plan


def test_dashboard(spark, alerts):
    assert dashboard.kpis(alerts).first().asDict() == dict(
        total_amount=13900.0, critical_alerts=1, users_affected=2, loaded_alerts=3
    )
    assert [tuple(r) for r in dashboard.score_series(alerts).collect()] == [
        ("ID tx_1", 95), ("ID tx_2", 70), ("ID tx_3", 45)
    ]
    many = rows.enriched(spark, [dict(txn_id=f"t{i:02d}", risk_score=i) for i in range(25)])
    assert ids(dashboard.page(many, 1)) == [f"t{i:02d}" for i in range(24, 14, -1)]
    assert ids(dashboard.page(many, 3)) == ["t04", "t03", "t02", "t01", "t00"]
    assert ids(dashboard.page(many, 4)) == []


def test_labels_and_route(spark):
    made = rows.enriched(spark, [
        dict(txn_id="a", risk_reasons=["NEW_DEVICE", "SOME_NEW_CODE"], prev_country="US"),
        dict(txn_id="b"),
    ])
    got = {r.txn_id: r for r in dashboard.with_route(dashboard.with_labels(made)).collect()}
    assert got["a"].reason_labels == ["Dispositivo novo", "SOME NEW CODE"]
    assert got["b"].reason_labels == []
    assert (got["a"].route_from, got["b"].route_from) == ("US", "-")
    assert made.select(reason_label(F.lit("ABNORMAL_FREQUENCY"))).first()[0] == "Frequencia anormal"
