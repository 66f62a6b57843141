"""Users and transactions derived from the shop tables.

customer, nation and events become users and their payment-like transactions;
orders become scenario rows. What the tables lack follows from what they hold:
the kind of event, the number in its properties, the user's profile and nation.
Every rule is exact, so a run can be repeated and checked against plain SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.functions.exact import Span, span_of_all
from txrisk.operators.skew import ROWS_PER_TASK, HotKeys, find_hot_keys, join_spread
from txrisk.operators.transactions import USER_COLUMNS, canonical, join_countries
from txrisk.schemas import SCENARIOS_CSV
from txrisk.sources.files import COUNTRIES, countries

# The two kinds of user.
TRAVELLER = "VIAJANTE"
REGULAR = "PADRAO"

# Declared, so that a scan does not start a job to read Parquet footers first.
TABLES = {
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
        "c_mktsegment string"
    ),
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
        "value double, props string"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
}

_CODES = ", ".join(f"'{code}'" for code, *_ in COUNTRIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def country_at(index: str) -> str:
    """SQL text for the code at a list position."""
    return f"element_at(array({_CODES}), cast({index} as int) + 1)"


def user_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the country of their nation."""
    homes = countries(spark).selectExpr(
        "geo_idx as home_idx", "txn_country as home_country", "txn_city as home_city",
        "lat as home_lat", "lon as home_lon",
    )
    nations = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey as c_nationkey", f"n_nationkey % {len(COUNTRIES)} as home_idx"
    )
    return (
        table(spark, sf_dir, "customer")
        .join(nations, "c_nationkey")
        .join(F.broadcast(homes), "home_idx")
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user per customer; the average ticket is that of the customer's events."""
    spent = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.expr("sum(cast(round(value * 100) as bigint)) as cents"), F.expr("count(value) as n")
    )
    return user_homes(spark, sf_dir).join(spent, "c_custkey", "left").selectExpr(
        "cast(c_custkey as int) as user_seq",
        "concat('user_', c_custkey) as user_id",
        "home_country",
        "home_city",
        "home_lat",
        "home_lon",
        f"if(c_custkey % 5 = 0, '{TRAVELLER}', '{REGULAR}') as profile",
        "if(c_custkey % 2 = 0, 'mobile', 'web') as primary_device",
        # Half-up division of whole cents: the same in every engine.
        "((2 * cents + n) div (2 * n)) / 100 as avg_ticket",
        "case when c_acctbal < 0 then 'LOW' when c_acctbal < 5000 then 'MIDDLE' "
        "else 'HIGH' end as income_band",
        "date_add(date'2020-01-01', cast(c_custkey % 1000 as int)) as created_on",
    )


def hot_users(spark: SparkSession, sf_dir: str, rows_per_task: int = ROWS_PER_TASK) -> HotKeys:
    """Users too large for one task, from the keys of events and orders alone."""
    numbers = table(spark, sf_dir, "events").select("user_id").union(
        table(spark, sf_dir, "orders").select("o_custkey")
    )
    return find_hot_keys(numbers, "user_id", rows_per_task).renamed("concat('user_', hot_key)")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bare payments, before user and country are joined."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('tx_', event_id) as txn_id",
        "concat('user_', user_id) as user_id",
        "value as amount",
        "cast(ts as timestamp) as txn_ts",
        "cast(ts as date) as process_date",
        "event_type",
        # the number that events carry in their properties; 0 if there is none
        "coalesce(try_cast(regexp_extract(props, '\"k\": *([0-9]+)', 1) as int), 0) as k",
    )


def place_payments(payments_of_users: DataFrame) -> DataFrame:
    """Country, device and attempts of each payment, by kind of event and profile.

    Travellers sign up and fail abroad, others fail abroad now and then; a
    failure was tried up to five times, half of them on the other device.
    """
    abroad = country_at(f"k % {len(COUNTRIES)}")
    return payments_of_users.selectExpr(
        "*",
        f"case when profile = '{TRAVELLER}' then "
        f"case when event_type in ('error', 'signup') then {abroad} else home_country end "
        f"else case when event_type = 'error' and k < 30 then {abroad} else home_country end "
        "end as txn_country",
        "case when event_type = 'error' and k >= 50 then "
        "case when primary_device = 'mobile' then 'web' else 'mobile' end "
        "else primary_device end as device",
        "case when event_type = 'error' then 1 + k % 5 when event_type = 'signup' then 1 + k % 2 "
        "else 1 end as attempts",
    )


def transactions(spark: SparkSession, sf_dir: str, hot: HotKeys = HotKeys()) -> DataFrame:
    joined = join_spread(
        payments(spark, sf_dir),
        users(spark, sf_dir).select(*USER_COLUMNS),
        "user_id",
        hot,
    )
    return canonical(join_countries(place_payments(joined), countries(spark)))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a row of the scenario CSV, its time of day set by its key."""
    placed = table(spark, sf_dir, "orders").selectExpr(
        "concat('order_', o_orderkey) as txn_id",
        "concat('user_', o_custkey) as user_id",
        f"{country_at(f'o_orderkey % {len(COUNTRIES)}')} as txn_country",
        "o_totalprice as amount",
        "if(o_orderkey % 2 = 0, 'mobile', 'web') as device",
        "cast(1 + o_orderkey % 4 as int) as attempts",
        "date_format(o_orderdate + make_dt_interval(0, 0, 0, (o_orderkey * 17) % 86400), "
        "'yyyy-MM-dd HH:mm:ss') as txn_ts",
    )
    return join_countries(placed, countries(spark)).select(*SCENARIOS_CSV.names)


@dataclass(frozen=True)
class Shop:
    """The derived relations of one data folder."""

    users: DataFrame
    transactions: DataFrame
    hot: HotKeys
    span: Span


def load(spark: SparkSession, sf_dir: str, rows_per_task: int = ROWS_PER_TASK) -> Shop:
    """The relations, with what is known of their keys and amounts from the raw tables."""
    hot = hot_users(spark, sf_dir, rows_per_task)
    span = span_of_all(
        (table(spark, sf_dir, "events"), "value"), (table(spark, sf_dir, "orders"), "o_totalprice")
    )
    return Shop(users(spark, sf_dir), transactions(spark, sf_dir, hot), hot, span)
