"""Every query of the package, each over all rows of the given tables.

A query takes the session and a data folder and returns a DataFrame. Times and
dates come out as text and arrays as joined text, so that results compare
across engines.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.operators import dashboard, profiles, quality, scoring, serving
from txrisk.operators.behaviour import add_features
from txrisk.operators.skew import join_spread
from txrisk.operators.transactions import USER_COLUMNS, from_scenarios, join_countries
from txrisk.plans import lake, pipeline
from txrisk.plans.reads import LakeReads
from txrisk.schemas import QUALITY
from txrisk.session import apply_sql_settings, materialize, released, scratch_path
from txrisk.sources import shop
from txrisk.sources.files import COUNTRIES, countries, read_scenarios, read_users

Query = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, Query] = {}

# The processing date that the quality queries stamp.
REPORT_DATE = "2024-02-01"


def query(fn: Query) -> Query:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(apply_sql_settings(spark), sf_dir)

    _REGISTRY[fn.__name__] = prepared
    return fn


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


# -- common inputs ---------------------------------------------------------


def _features(spark, sf_dir):
    data = shop.load(spark, sf_dir)
    return add_features(data.transactions, data.hot, span=data.span)


def _enriched(spark, sf_dir):
    return scoring.add_risk(_features(spark, sf_dir))


def _alerts(spark, sf_dir):
    return scoring.only_alerts(_enriched(spark, sf_dir))


def _scenario_txns(data, rows):
    """Scenario rows joined with their users."""
    dated = rows.withColumn("process_date", F.to_date("txn_ts"))
    return from_scenarios(dated, data.users, hot=data.hot)


# Roots of the lakes published by this process, by application and data folder.
_LAKES: dict[tuple[str, str], str] = {}


def _publish(spark, sf_dir) -> tuple[str, DataFrame]:
    """Run the whole job into a new lake; its root and the metrics."""
    data, root = shop.load(spark, sf_dir), scratch_path(spark, "lake")
    day = datetime.date.fromisoformat(REPORT_DATE)
    return root, pipeline.run(data.users, data.transactions, root, process_date=day)


def _lake(spark, sf_dir) -> LakeReads:
    """Reads over the published lake of a data folder; the first of them publishes it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    reads = LakeReads(spark, _LAKES[key]) if key in _LAKES else None
    if reads is None or reads.run is None:  # not yet published, or cleared away since
        _LAKES[key] = _publish(spark, sf_dir)[0]
        reads = LakeReads(spark, _LAKES[key])
    return reads


# Columns shown as text: timestamps, dates and reason lists.
_STAMPS = ("txn_ts", "prev_txn_ts")
_DAYS = ("process_date", "created_on")
_LISTS = ("risk_reasons", "top_reasons", "reason_labels")


def show(df: DataFrame, *names: str) -> DataFrame:
    """The named columns in a form that compares across engines."""
    shown = []
    for name in names or df.columns:
        if name in _STAMPS:
            text = f"date_format({name}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
        elif name in _DAYS:
            text = f"cast({name} as string)"
        elif name in _LISTS:
            text = f"array_join({name}, ',')"
        elif name in ("hist_avg_amount", "hist_std_amount"):
            text = f"round({name}, {9 if name == 'hist_avg_amount' else 6})"
        elif name in _WHOLE:
            text = f"cast({name} as bigint)"
        else:
            text = name
        shown.append(f"{text} as {name}")
    return df.selectExpr(*shown)


_WHOLE = (
    "user_seq", "attempts", "txn_hour", "countries_24h", "risk_score", "max_risk_score",
    "position", "page", "recency",
)

_ALERT_COLUMNS = (
    "txn_id", "user_id", "txn_country", "amount", "risk_score", "risk_level", "decision",
    "risk_reasons", "process_date", "txn_ts",
)


# -- users, transactions and joins -----------------------------------------


@query
def users_dim(spark, sf_dir):
    """Users written as CSV and read back through the typed scan."""
    path = scratch_path(spark, "users-csv")
    shop.users(spark, sf_dir).write.option("header", True).csv(path)
    return show(read_users(spark, path))


@query
def geo_dim(spark, sf_dir):
    """Customers per country of residence, with the country's city and coordinates."""
    return (
        shop.user_homes(spark, sf_dir)
        .groupBy("home_country", "home_city", "home_lat", "home_lon")
        .agg(F.count(F.lit(1)).alias("customers"))
    )


@query
def txn_canonical(spark, sf_dir):
    return show(shop.load(spark, sf_dir).transactions)


@query
def txn_join_users(spark, sf_dir):
    data = shop.load(spark, sf_dir)
    people = data.users.select(*USER_COLUMNS)
    joined = join_spread(shop.payments(spark, sf_dir), people, "user_id", data.hot)
    return joined.select("txn_id", "amount", *USER_COLUMNS)


@query
def txn_join_geo_left(spark, sf_dir):
    """Payments placed by event type; type ``error`` has no known country."""
    index = f"event_id % {len(COUNTRIES)}"
    placed = shop.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        f"if(event_type = 'error', 'ZZ', {shop.country_at(index)}) as txn_country",
    )
    return join_countries(placed, countries(spark)).select(
        "event_id", "txn_country", "txn_city", "lat", "lon"
    )


@query
def user_seq_assignment(spark, sf_dir):
    """Transactions dealt over the users in turn by their number, then joined."""
    people = shop.table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as int) as user_seq")
    population = people.agg(F.max("user_seq") + 1).first()[0]
    dealt = shop.table(spark, sf_dir, "events").selectExpr(
        "concat('tx_', event_id) as txn_id", f"cast(event_id % {population} as int) as user_seq"
    )
    return show(dealt.join(people, "user_seq"), "txn_id", "user_seq")


@query
def range_spine(spark, sf_dir):
    """A spine of numbers over the event ids, with the event of each number."""
    ids = shop.table(spark, sf_dir, "events").select("event_id", "value")
    first, last = ids.agg(F.min("event_id"), F.max("event_id")).first()
    spine = spark.range(first, last + 1).withColumnRenamed("id", "event_id")
    return spine.join(ids, "event_id", "left").selectExpr(
        "concat('tx_', event_id) as txn_id", "value as amount"
    )


@query
def ts_interval_shift(spark, sf_dir):
    """Each event moved back by a fraction of 30 days, a day, an hour and a minute."""
    shifted = shop.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "ts - (event_id % 120 / 4) * interval 1 day - (event_id % 48 / 2) * interval 1 hour "
        "- (event_id % 120 / 2) * interval 1 minute - (event_id % 59) * interval 1 second "
        "as txn_ts",
    )
    return show(shifted)


# -- features --------------------------------------------------------------


def _feature_query(name: str, *columns: str) -> None:
    def fn(spark, sf_dir):
        return show(_features(spark, sf_dir), "txn_id", *columns)

    fn.__name__ = name
    query(fn)


_feature_query(
    "prev_txn_context",
    "user_id", "prev_country", "prev_city", "prev_lat", "prev_lon", "prev_txn_ts", "prev_device",
)
_feature_query("haversine_km", "prev_lat", "prev_lon", "lat", "lon", "km_since_prev")
_feature_query("geo_velocity", "mins_since_prev", "km_since_prev", "kmh_since_prev")
_feature_query("hist_amount_stats", "hist_avg_amount", "hist_std_amount")
_feature_query("txns_1h", "txns_1h")
_feature_query("countries_24h", "countries_24h")
_feature_query("high_amount", "amount", "avg_ticket", "is_high_amount")
_feature_query("new_device", "device", "primary_device", "is_new_device")
_feature_query("new_country", "txn_country", "home_country", "prev_country", "is_new_country")
_feature_query("abnormal_frequency", "mins_since_prev", "txns_1h", "is_abnormal_freq")


@query
def txn_hour_flag(spark, sf_dir):
    txns = shop.load(spark, sf_dir).transactions
    return show(txns.withColumn("is_unusual_hour", F.col("txn_hour") < 6),
                "txn_id", "txn_hour", "is_unusual_hour")


@query
def features_all(spark, sf_dir):
    return show(_features(spark, sf_dir))


# -- score -----------------------------------------------------------------


@query
def risk_flags(spark, sf_dir):
    fired = {
        "rule_" + rule.code.lower(): F.coalesce(rule.condition, F.lit(False))
        for rule in scoring.rules()
    }
    return _features(spark, sf_dir).withColumns(fired).select("txn_id", *fired)


@query
def reason_columns(spark, sf_dir):
    """One column per rule: its code if it fired, else null."""
    codes = {
        "reason_" + rule.code.lower(): F.when(rule.condition, F.lit(rule.code))
        for rule in scoring.rules()
    }
    return _features(spark, sf_dir).withColumns(codes).select("txn_id", *codes)


@query
def risk_score(spark, sf_dir):
    return show(_enriched(spark, sf_dir), "txn_id", "risk_score")


@query
def risk_reasons(spark, sf_dir):
    return show(_enriched(spark, sf_dir), "txn_id", "risk_reasons")


@query
def risk_level_decision(spark, sf_dir):
    return show(_enriched(spark, sf_dir), "txn_id", "risk_score", "risk_level", "decision")


@query
def alerts_only(spark, sf_dir):
    return show(_alerts(spark, sf_dir))


@query
def scenarios_scored(spark, sf_dir):
    """All orders through the scenario CSV and back, scored on their own."""
    path = scratch_path(spark, "scenarios-csv")
    shop.scenarios(spark, sf_dir).write.option("header", True).csv(path)
    data = shop.load(spark, sf_dir)
    txns = _scenario_txns(data, read_scenarios(spark, path))
    return show(
        pipeline.enrich(txns, data.hot, span=data.span),
        *_ALERT_COLUMNS, "txns_1h", "countries_24h", "mins_since_prev", "km_since_prev",
        "kmh_since_prev", "is_abnormal_freq",
    )


@query
def txn_union_scenarios(spark, sf_dir):
    """Event transactions and order scenarios together, scored as one history."""
    data, orders = shop.load(spark, sf_dir), shop.scenarios(spark, sf_dir)
    txns = _scenario_txns(data, orders.withColumn("txn_ts", F.try_to_timestamp("txn_ts")))
    both = pipeline.with_scenarios(data.transactions, txns)
    return show(pipeline.enrich(both, data.hot, span=data.span), *_ALERT_COLUMNS, "prev_country", "prev_txn_ts")


# -- alert lists -----------------------------------------------------------


@query
def alerts_all(spark, sf_dir):
    return show(_lake(spark, sf_dir).matching_alerts(), *_ALERT_COLUMNS)


@query
def alerts_ranked(spark, sf_dir):
    """All alerts in rank order. Stored first: a total order reads its input twice."""
    stored = materialize(_alerts(spark, sf_dir).select(*_ALERT_COLUMNS), "alerts")
    return show(serving.rank_alerts(stored), *_ALERT_COLUMNS)


@query
def alerts_top50(spark, sf_dir):
    return show(serving.list_alerts(_alerts(spark, sf_dir)), *_ALERT_COLUMNS)


def _filter_query(name: str, **conditions) -> None:
    def fn(spark, sf_dir):
        return show(_lake(spark, sf_dir).matching_alerts(**conditions), *_ALERT_COLUMNS)

    fn.__name__ = name
    query(fn)


_filter_query("alerts_by_level", risk_level="HIGH")
_filter_query("alerts_by_user", user_id="user_10")
_filter_query("alerts_by_country", country="JP")
_filter_query("alerts_by_reason", reason="HIGH_ATTEMPT_COUNT")
_filter_query("alerts_min_amount", min_amount=100)
_filter_query("alerts_by_period", date_from="2024-01-10", date_to="2024-01-20")
_filter_query("alerts_by_decision", decision="BLOCK")


@query
def alerts_filtered_all(spark, sf_dir):
    """Every condition at once, ranked and limited."""
    chosen = serving.list_alerts(
        _alerts(spark, sf_dir),
        risk_level="HIGH",
        user_id="user_10",
        country="JP",
        reason="IMPOSSIBLE_TRAVEL",
        min_amount=1,
        date_from="2024-01-02",
        date_to="2024-01-29",
        decision="REVIEW",
        limit=500,
    )
    return show(chosen, *_ALERT_COLUMNS)


@query
def alerts_per_level(spark, sf_dir):
    return pipeline.alerts_per_level(_alerts(spark, sf_dir))


# -- lookup, history and profiles ------------------------------------------


@query
def txn_by_id(spark, sf_dir):
    return show(_lake(spark, sf_dir).transaction("tx_777"))


@query
def history_of_user(spark, sf_dir):
    return show(_lake(spark, sf_dir).history("user_10"), "user_id", "txn_id", "txn_ts", "amount",
                "risk_score", "risk_level")


@query
def profile_of_user(spark, sf_dir):
    return show(_lake(spark, sf_dir).risk_profile("user_10"))


@query
def user_history_last20(spark, sf_dir):
    latest = serving.latest_per_user(_enriched(spark, sf_dir), 20)
    return show(latest, "user_id", "recency", "txn_id", "txn_ts", "amount", "risk_score",
                "risk_level")


@query
def user_risk_profile(spark, sf_dir):
    return show(profiles.all_profiles(_enriched(spark, sf_dir)))


@query
def user_top_reasons(spark, sf_dir):
    return show(profiles.all_profiles(_enriched(spark, sf_dir)), "user_id", "top_reasons")


# -- dashboard -------------------------------------------------------------


def _loaded(spark, sf_dir):
    return serving.list_alerts(_alerts(spark, sf_dir))


@query
def dashboard_kpis(spark, sf_dir):
    return dashboard.kpis(_loaded(spark, sf_dir)).withColumn(
        "total_amount", F.round("total_amount", 2)
    )


@query
def top10_score_series(spark, sf_dir):
    return show(_lake(spark, sf_dir).score_series())


@query
def alerts_page(spark, sf_dir):
    """All five pages of the loaded alerts."""
    return show(dashboard.paged(_lake(spark, sf_dir).top_alerts()), "page", "position",
                "txn_id", "risk_score", "amount")


@query
def reasons_labeled(spark, sf_dir):
    return show(dashboard.with_labels(_alerts(spark, sf_dir)), "txn_id", "risk_reasons",
                "reason_labels")


@query
def alert_route(spark, sf_dir):
    return dashboard.with_route(_alerts(spark, sf_dir)).select("txn_id", "route_from", "txn_country")


# -- data quality ----------------------------------------------------------


def _report(users, txns, enriched):
    day = F.to_date(F.lit(REPORT_DATE))
    return quality.quality_report(users, txns, enriched).withColumn("process_date", day)


@query
def dq_report(spark, sf_dir):
    """The checks over the stored users, transactions and scores."""
    reads = _lake(spark, sf_dir)
    return show(_report(reads.users(), reads.transactions(), reads.enriched()), *QUALITY.names)


@query
def dq_report_sorted(spark, sf_dir):
    """The report that the job published."""
    return show(_lake(spark, sf_dir).quality(), *QUALITY.names)


@query
def dq_report_dirty(spark, sf_dir):
    """The report over spoilt copies of the relations: every check fails."""
    data = shop.load(spark, sf_dir)
    number = "cast(substr(txn_id, 4) as bigint)"
    users = data.users.withColumns(
        {
            "user_id": F.expr("if(user_seq % 7 = 0, null, user_id)"),
            "home_country": F.expr("if(user_seq % 11 = 0, null, home_country)"),
        }
    )
    txns = data.transactions.withColumns(
        {
            "user_id": F.expr(f"if({number} % 13 = 0, null, user_id)"),
            "amount": F.expr(
                f"case when {number} % 17 = 0 then null when {number} % 19 = 0 then -1 - amount "
                "else amount end"
            ),
            "txn_ts": F.expr(f"if({number} % 23 = 0, null, txn_ts)"),
            "txn_country": F.expr(f"if({number} % 29 = 0, null, txn_country)"),
        }
    )
    enriched = pipeline.enrich(data.transactions, data.hot, span=data.span).withColumns(
        {
            "risk_score": F.expr(
                f"case when {number} % 31 = 0 then null when {number} % 37 = 0 then 101 "
                "else risk_score end"
            ),
            "risk_level": F.expr(f"if({number} % 41 = 0, 'SEVERE', risk_level)"),
            "decision": F.expr(f"if({number} % 43 = 0, null, decision)"),
        }
    )
    return show(_report(users, txns, enriched), *QUALITY.names)


@query
def job_metrics(spark, sf_dir):
    """The whole job, from the raw tables to a published lake, and its metrics."""
    return _publish(spark, sf_dir)[1]


# -- lake ------------------------------------------------------------------


def _round_trip(spark, rows: DataFrame, layer: lake.Layer) -> DataFrame:
    """Write one layer as a run, publish it and read it as a reader does."""
    root, run = scratch_path(spark, "lake"), lake.new_run()
    with released(spark):
        # A layer is laid out from stored rows.
        lake.write_layer(materialize(rows, "rows"), root, layer, run)
    lake.publish(spark, root, run)
    return lake.read(spark, root, layer)


@query
def lake_roundtrip_users(spark, sf_dir):
    return show(_round_trip(spark, shop.users(spark, sf_dir), lake.BRONZE_USERS))


@query
def lake_roundtrip_bronze(spark, sf_dir):
    txns = shop.load(spark, sf_dir).transactions
    return show(_round_trip(spark, txns, lake.BRONZE_TRANSACTIONS))


@query
def lake_roundtrip_silver(spark, sf_dir):
    return show(_round_trip(spark, _enriched(spark, sf_dir), lake.SILVER))


@query
def lake_roundtrip_gold(spark, sf_dir):
    return show(_round_trip(spark, _alerts(spark, sf_dir), lake.ALERTS))


@query
def lake_roundtrip_quality(spark, sf_dir):
    data = shop.load(spark, sf_dir)
    txns = materialize(data.transactions, "transactions")
    report = _report(data.users, txns, pipeline.enrich(txns, data.hot, span=data.span))
    return show(_round_trip(spark, report, lake.DATA_QUALITY))
