"""Every registered query gives the rows of its SQL in another engine."""

import compare
import pyarrow.parquet as pq
import pytest
from conftest import SF_DIR

import __spark_entry__ as contract
from txrisk.plans import oracle, pipeline
from txrisk.plans.queries import registry, show
from txrisk.sources import shop

QUERIES = registry()
ORACLES = oracle.sql()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    plan = plan_of(result)
    for unwanted in ("Python", "Pandas", "NestedLoop", "CartesianProduct"):
        assert unwanted not in plan
    assert compare.mismatch(result, duck, ORACLES[name]) is None


def test_hot_users_give_the_same_rows(spark, duck):
    """Salted joins and sliced histories, for every user with more than 70 rows."""
    data = shop.load(spark, SF_DIR, rows_per_task=70)
    assert data.hot.keys > 10
    result = show(pipeline.enrich(data.transactions, data.hot, rows_per_task=70))
    plan = plan_of(result)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert compare.mismatch(result, duck, ORACLES["lake_roundtrip_silver"]) is None


def test_profile_of_user_covers_every_row(spark, tmp_path):
    """A user of 450 transactions, with alerts among the oldest only."""
    made = {
        "customer": (20, "id as c_custkey", "concat('c', id) as c_name",
                     "cast(id % 3 as int) as c_nationkey", "100D as c_acctbal", "'A' as c_mktsegment"),
        "nation": (3, "cast(id as int) as n_nationkey", "concat('n', id) as n_name", "0 as n_regionkey"),
        "events": (500, "id as event_id",
                   "timestamp_ntz'2024-01-01' + make_dt_interval(0, 3 * cast(id as int)) as ts",
                   "if(id < 450, 10L, 11L) as user_id", "if(id < 150, 'error', 'view') as event_type",
                   "double(id % 90) / 100 as value", "concat('{\"k\": ', id % 100, '}') as props"),
        "orders": (20, "id as o_orderkey", "id as o_custkey", "'O' as o_orderstatus",
                   "10D as o_totalprice", "timestamp_ntz'2024-01-02' as o_orderdate",
                   "'5-LOW' as o_orderpriority"),
    }
    for name, (size, *columns) in made.items():
        table = spark.range(0, size, 1, 1).selectExpr(*columns)
        pq.write_table(table.toArrow(), tmp_path / f"{name}.parquet")
    sql = contract.oracle_sql()["profile_of_user"]
    profile = contract.queries()["profile_of_user"](spark, str(tmp_path))
    assert compare.mismatch(profile, compare.connect(tmp_path), sql) is None
    row = profile.first()
    assert row.total_transactions == 450 and row.total_alerts > 0 and row.top_reasons
    assert row.total_amount == sum(i % 90 for i in range(450)) / 100


def test_entry(spark):
    ranked = contract.entry(spark)
    assert {"txn_id", "user_id", "risk_score", "risk_level", "risk_reasons", "decision"} <= set(
        ranked.columns
    )
    assert ranked.count() == 139


def test_all_rules_and_levels_occur(spark):
    flags = QUERIES["risk_flags"](spark, SF_DIR)
    fired = flags.selectExpr(*[f"count_if({c}) as {c}" for c in flags.columns if c != "txn_id"]).first()
    assert len(fired) == 7 and min(fired) > 0
    levels = QUERIES["risk_level_decision"](spark, SF_DIR).select("risk_level", "decision").distinct()
    assert {tuple(r) for r in levels.collect()} == {
        ("LOW", "APPROVE"), ("MEDIUM", "REVIEW"), ("HIGH", "REVIEW"), ("CRITICAL", "BLOCK")
    }
