"""Features and score on rows with known answers."""

import datetime as dt
import random
from fractions import Fraction

import pytest
import rows
from pyspark.sql import functions as F

from txrisk.operators import behaviour
from txrisk.operators.behaviour import add_features
from txrisk.operators.scoring import add_risk, rules
from txrisk.operators.skew import HotKeys, find_hot_keys, join_spread
from txrisk.operators.transactions import from_scenarios
from txrisk.schemas import ENRICHED
from txrisk.session import materialize
from txrisk.sources.files import read_scenarios, read_users

GOLDEN = {  # txns_1h, countries_24h, minutes, km, km/h, abnormal, score, level, decision, reasons
    "scenario_normal_br": (1, 1, None, None, None, None, 0, "LOW", "APPROVE", []),
    "scenario_impossible_travel": (
        2, 2, 60.0, 18537.21, 18537.21, False, 100, "CRITICAL", "BLOCK",
        ["IMPOSSIBLE_TRAVEL", "VALUE_ABOVE_USER_PROFILE", "NEW_DEVICE", "NEW_COUNTRY_FOR_USER",
         "HIGH_ATTEMPT_COUNT"],
    ),
    "scenario_valor_alto": (1, 1, None, None, None, None, 25, "LOW", "APPROVE",
                            ["VALUE_ABOVE_USER_PROFILE"]),
    "scenario_device_novo": (1, 1, None, None, None, None, 10, "LOW", "APPROVE", ["NEW_DEVICE"]),
    "scenario_muitas_tentativas": (1, 1, None, None, None, None, 20, "LOW", "APPROVE",
                                   ["HIGH_ATTEMPT_COUNT"]),
    "scenario_horario_incomum": (1, 1, None, None, None, None, 8, "LOW", "APPROVE",
                                 ["UNUSUAL_TRANSACTION_HOUR"]),
}


def scored(spark, made):
    result = add_risk(add_features(rows.transactions(spark, made), HotKeys()))
    return {r.txn_id: r for r in result.collect()}


@pytest.mark.parametrize("rows_per_task", [1_000_000, 1])
def test_six_scenarios(spark, tmp_path, rows_per_task):
    rows.write_users_csv(tmp_path / "users.csv")
    rows.write_cases_csv(
        tmp_path / "cases.csv",
        extra=[("of_nobody", "user_99999", "BR", 1.0, "web", 1, "2026-05-20 10:00:00")],
    )
    users = read_users(spark, str(tmp_path / "users.csv"))
    txns = from_scenarios(read_scenarios(spark, str(tmp_path / "cases.csv")), users)
    result = add_risk(add_features(txns, rows_per_task=rows_per_task))
    assert result.schema.names == ENRICHED.names
    assert result.schema.simpleString() == ENRICHED.simpleString()
    got = {
        r.txn_id: (r.txns_1h, r.countries_24h, r.mins_since_prev, r.km_since_prev,
                   r.kmh_since_prev, r.is_abnormal_freq, r.risk_score, r.risk_level, r.decision,
                   r.risk_reasons)
        for r in result.collect()
    }
    assert got == GOLDEN


def test_history_of_second_scenario(spark):
    made = [rows.txn("a", amount=85.9), rows.txn("b", when="2026-05-20 11:00:00", amount=4200.0)]
    second = scored(spark, made)["b"]
    assert second.hist_avg_amount == 85.9
    assert second.hist_std_amount is None


def test_same_second_pair(spark):
    """No elapsed time: no speed, no travel rule, but a burst."""
    pair = scored(spark, [rows.txn("a"), rows.txn("b", country="JP")])
    assert pair["b"].mins_since_prev == 0
    assert pair["b"].kmh_since_prev is None
    assert pair["b"].risk_reasons == ["NEW_COUNTRY_FOR_USER", "ABNORMAL_FREQUENCY"]
    assert pair["a"].txns_1h == pair["b"].txns_1h == 2


def test_unknown_country_keeps_its_row(spark):
    made = [rows.txn("a", country="ZZ"), rows.txn("b", when="2026-05-20 11:00:00")]
    later = scored(spark, made)["b"]
    assert later.prev_country == "ZZ"
    assert later.km_since_prev is None and later.kmh_since_prev is None
    assert later.risk_score == 0


def test_thresholds(spark):
    """Strict where the rule is strict, inclusive where it is not."""
    made = [
        rows.txn("four_times", user="a", amount=400.0),
        rows.txn("above", user="b", amount=400.01),
        rows.txn("two", user="c", attempts=2),
        rows.txn("three", user="d", attempts=3),
        rows.txn("five", user="e", hour=5),
        rows.txn("six", user="f", hour=6),
        rows.txn("g1", user="g"),
        rows.txn("gap_5_min", user="g", when="2026-05-20 10:05:00"),
        rows.txn("h1", user="h"),
        rows.txn("gap_301_s", user="h", when="2026-05-20 10:05:01"),
        rows.txn("i1", user="i"),
        rows.txn("in_hour", user="i", when="2026-05-20 11:00:00"),
        rows.txn("j1", user="j"),
        rows.txn("past_hour", user="j", when="2026-05-20 11:00:01"),
        rows.txn("k1", user="k"),
        rows.txn("in_day", user="k", when="2026-05-21 10:00:00", country="US"),
        rows.txn("l1", user="l"),
        rows.txn("past_day", user="l", when="2026-05-21 10:00:01", country="US"),
    ]
    got = scored(spark, made)
    reasons = {name: row.risk_reasons for name, row in got.items()}
    assert reasons["four_times"] == [] and reasons["above"] == ["VALUE_ABOVE_USER_PROFILE"]
    assert reasons["two"] == [] and reasons["three"] == ["HIGH_ATTEMPT_COUNT"]
    assert reasons["five"] == ["UNUSUAL_TRANSACTION_HOUR"] and reasons["six"] == []
    # 301 seconds are 5.02 minutes.
    assert reasons["gap_5_min"] == ["ABNORMAL_FREQUENCY"] and reasons["gap_301_s"] == []
    assert (got["in_hour"].txns_1h, got["past_hour"].txns_1h) == (2, 1)
    assert (got["in_day"].countries_24h, got["past_day"].countries_24h) == (2, 1)


def test_speed_limit_is_strict(spark):
    """900 km in an hour along a meridian is allowed, a little more is not."""
    degrees = 900 / (6371 * 3.141592653589793 / 180)
    made = []
    for user, lat in (("at", degrees), ("over", degrees + 0.001)):
        made.append(rows.txn(user + "1", user=user, lat=0.0, lon=0.0))
        made.append(rows.txn(user, user=user, when="2026-05-20 11:00:00", lat=lat, lon=0.0))
    got = scored(spark, made)
    assert got["at"].kmh_since_prev == 900.0 and got["at"].risk_reasons == []
    assert got["over"].risk_reasons == ["IMPOSSIBLE_TRAVEL"]


def test_antipodes_have_a_distance(spark):
    made = [rows.txn("a", lat=10.0, lon=20.0),
            rows.txn("b", when="2026-05-20 12:00:00", lat=-10.0, lon=-160.0)]
    assert scored(spark, made)["b"].km_since_prev == 20015.09


def test_five_in_an_hour(spark):
    made = [rows.txn(f"t{i}", when=f"2026-05-20 10:{i * 12:02d}:00") for i in range(5)]
    got = scored(spark, made)
    assert got["t3"].is_abnormal_freq is False
    assert got["t4"].txns_1h == 5 and got["t4"].is_abnormal_freq is True


def test_crowded_hour_on_first_row_is_not_null(spark):
    made = [rows.txn(f"t{i}") for i in range(5)]
    assert scored(spark, made)["t0"].is_abnormal_freq is True


def test_levels_and_cap(spark):
    # Each set of fired rules by its flags: expected score, level and decision.
    cases = {
        "all": (dict(kmh=901.0, high=True, dev=True, ctry=True, att=3, hour=0, freq=True),
                (100, "CRITICAL", "BLOCK")),
        "no_travel": (dict(kmh=1.0, high=True, dev=True, ctry=True, att=3, hour=0, freq=True),
                      (85, "CRITICAL", "BLOCK")),
        "high_floor": (dict(kmh=1.0, high=True, dev=True, ctry=False, att=3, hour=12, freq=True),
                       (67, "HIGH", "REVIEW")),
        "medium_floor": (dict(kmh=1.0, high=True, dev=True, ctry=False, att=1, hour=12, freq=False),
                         (35, "MEDIUM", "REVIEW")),
        "just_low": (dict(kmh=1.0, high=True, dev=False, ctry=False, att=1, hour=5, freq=False),
                     (33, "LOW", "APPROVE")),
        "unknown": (dict(kmh=None, high=None, dev=None, ctry=None, att=None, hour=None, freq=None),
                    (0, "LOW", "APPROVE")),
    }
    made = rows.enriched(spark, [
        dict(txn_id=name, kmh_since_prev=c["kmh"], is_high_amount=c["high"],
             is_new_device=c["dev"], is_new_country=c["ctry"], attempts=c["att"],
             txn_hour=c["hour"], is_abnormal_freq=c["freq"])
        for name, (c, _) in cases.items()
    ]).drop("risk_score", "risk_reasons", "risk_level", "decision")
    got = {r.txn_id: (r.risk_score, r.risk_level, r.decision) for r in add_risk(made).collect()}
    assert got == {name: expected for name, (_, expected) in cases.items()}


def random_transactions(seed, n=400):
    """Few users, one of them with most rows; crowded seconds, ties and nulls."""
    rng = random.Random(seed)
    start = dt.datetime(2026, 5, 1, tzinfo=dt.timezone.utc)
    made = []
    for i in range(n):
        user = rng.choice(["hot"] * 6 + ["warm"] * 2 + ["cold", None])
        step = rng.choice([0, 1, 1799, 3600, 3601, 40000, 86400, 86401])
        moment = start + dt.timedelta(seconds=step * rng.randrange(12), microseconds=rng.choice(
            [0, 250_000, 999_999]))
        made.append(rows.txn(
            f"t{i:04d}", user=user, when=None if rng.random() < 0.03 else moment,
            country=rng.choice(["BR", "JP", "US", "ZZ", None]),
            amount=None if rng.random() < 0.05 else round(rng.uniform(1, 500), 2),
            device=rng.choice(["mobile", "web"])))
    # A third of the rows share one user and one moment.
    for i in range(n // 2):
        made.append(rows.txn(f"same{i:04d}", user="hot", when="2026-05-03 00:00:00",
                             amount=float(i % 7)))
    return made


@pytest.mark.parametrize("rows_per_task", [1_000_000, 50, 7])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, rows_per_task):
    """Whole users, slices of one hot user, and slices of every user agree with brute force."""
    made = random_transactions(seed)
    txns = rows.transactions(spark, made)
    hot = find_hot_keys(txns, "user_id", rows_per_task)
    assert bool(hot) == (rows_per_task < 1_000)
    got = add_features(txns, hot, rows_per_task).collect()
    assert len(got) == len(made)
    expected = rows.brute_force(made)
    for row in got:
        want = expected[row.txn_id][0]
        for name, value in want.items():
            have = row[name]
            if isinstance(value, dt.datetime):
                value = value.astimezone().replace(tzinfo=None)
                have = have and have.astimezone().replace(tzinfo=None)
            if isinstance(value, float) and isinstance(have, float):
                assert have == pytest.approx(value, rel=1e-9, abs=1e-9), (name, row)
            else:
                assert have == value, (name, row)


def _exact_moments(amounts):
    """Mean and sample deviation before each row by fractions, rounded once."""
    total = squares = Fraction(0)
    out = []
    for n, amount in enumerate(amounts):
        mean = total / n if n else None
        spread = (squares - total * total / n) / (n - 1) if n > 1 else None
        out.append((mean, spread))
        total, squares = total + Fraction(amount), squares + Fraction(amount) ** 2
    return out


AMOUNTS = {
    "money": lambda rng: round(rng.uniform(-9000, 9000), 2),
    "seventeen digits": lambda rng: 1e15 + rng.random(),
    "small ones": lambda rng: rng.choice([1e-5, 3e-5, 1e-300, -2e-5]),
    "huge ones": lambda rng: rng.choice([2e12, 4e12, 1e300, -1e300, 3e-7, 0.1, 5e-324]),
}


@pytest.mark.parametrize("kind", AMOUNTS)
def test_moments_are_exact_and_do_not_depend_on_the_size_of_a_user(spark, kind):
    """300 rows of one user, whole and in slices of 20: equal, and right to 1e-12."""
    rng = random.Random(5)
    start = dt.datetime(2026, 5, 1, tzinfo=dt.timezone.utc)
    amounts = [AMOUNTS[kind](rng) for _ in range(300)]
    made = [rows.txn(f"t{i:04d}", user="one", when=start + dt.timedelta(seconds=i), amount=a)
            for i, a in enumerate(amounts)]
    txns = rows.transactions(spark, made)

    def moments(rows_per_task):
        got = add_features(txns, rows_per_task=rows_per_task).collect()
        return {r.txn_id: (r.hist_avg_amount, r.hist_std_amount) for r in got}

    whole = moments(1_000_000)
    assert whole == moments(20)
    for i, (mean, spread) in enumerate(_exact_moments(amounts)):
        have_mean, have_std = whole[f"t{i:04d}"]
        assert (have_mean is None) == (mean is None) and (have_std is None) == (spread is None)
        if mean is not None:
            assert abs(Fraction(have_mean) - mean) <= abs(mean) / 10**12
        if spread is not None:
            assert abs(Fraction(have_std) ** 2 - spread) <= 3 * spread / 10**12


def test_amounts_that_are_not_finite(spark):
    """As plain arithmetic: an infinity is the mean of what follows, and has no deviation."""
    start = dt.datetime(2026, 5, 1, tzinfo=dt.timezone.utc)
    inf = float("inf")
    for odd, mean in ((float("nan"), "nan"), (inf, "inf"), (-inf, "-inf")):
        made = [rows.txn(f"t{i}", user="one", when=start + dt.timedelta(seconds=i), amount=a)
                for i, a in enumerate([1.0, 3.0, odd, None, 5.0, 6.0])]
        for rows_per_task in (1_000_000, 2):
            got = {r.txn_id: (repr(r.hist_avg_amount), repr(r.hist_std_amount))
                   for r in add_features(rows.transactions(spark, made), rows_per_task=rows_per_task).collect()}
            assert got["t2"][0] == "2.0" and got["t2"][1] == repr(2**0.5)
            assert got["t3"] == got["t4"] == got["t5"] == (mean, "nan")


def test_equal_amounts_have_no_deviation(spark):
    made = [rows.txn(f"t{i}", when=f"2026-05-20 10:{i:02d}:00", amount=33.33) for i in range(9)]
    got = scored(spark, made)["t8"]
    assert (got.hist_avg_amount, got.hist_std_amount) == (33.33, 0.0)


def test_copies_of_one_row_are_split(spark):
    """Two thirds of the rows are one row; no slice takes them all, and the copies add up."""
    made = [rows.txn("copy", amount=5.0)] * 400
    made += [rows.txn(f"t{i}", when=f"2026-05-2{i % 3} 0{i % 9}:00:00", amount=float(i))
             for i in range(200)]
    txns = rows.transactions(spark, made)
    sliced = behaviour._store_slices(txns.selectExpr("*", "unix_seconds(txn_ts) as epoch"), 12)
    assert sliced.count() == 600
    assert sliced.groupBy("slice").count().agg({"count": "max"}).first()[0] <= 4 * 50
    got = {}
    for row in add_features(txns, rows_per_task=50).collect():
        got.setdefault(row.txn_id, []).append(row)
    expected = rows.brute_force(made)
    for name, wanted in expected.items():
        for field in ("hist_avg_amount", "hist_std_amount", "mins_since_prev"):
            have = sorted(row[field] for row in got[name] if row[field] is not None)
            want = sorted(w[field] for w in wanted if w[field] is not None)
            assert have == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert {row.txns_1h for row in got[name]} == {w["txns_1h"] for w in wanted}
        assert len(got[name]) == len(wanted)


def test_score_properties(spark):
    result = add_risk(add_features(rows.transactions(spark, random_transactions(3)), HotKeys()))
    points = {rule.code: rule.points for rule in rules()}
    order = list(points)
    for row in result.collect():
        assert 0 <= row.risk_score <= 100
        assert row.risk_score == min(100, sum(points[code] for code in row.risk_reasons))
        assert row.risk_reasons == sorted(row.risk_reasons, key=order.index)
        level = next(name for name, floor in
                     [("CRITICAL", 85), ("HIGH", 60), ("MEDIUM", 35), ("LOW", 0)]
                     if row.risk_score >= floor)
        assert row.risk_level == level
        assert row.decision == {"CRITICAL": "BLOCK", "LOW": "APPROVE"}.get(level, "REVIEW")


def test_salted_join_equals_plain_join(spark):
    facts = rows.transactions(spark, random_transactions(4)).select("txn_id", "user_id", "amount")
    dim = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("warm", 3), ("nobody", 4)], "user_id string, mark int"
    )
    hot = find_hot_keys(facts, "user_id", 50)
    assert hot.keys >= 2
    plain = sorted(facts.join(dim, "user_id").collect())
    salted = join_spread(facts, dim, "user_id", hot)
    assert sorted(salted.select("user_id", "txn_id", "amount", "mark").collect(), key=str) == sorted(
        plain, key=str)


def test_hot_keys_are_estimated_from_a_sample(spark):
    keys = spark.range(400_000).selectExpr("if(id % 3 = 0, -1, id) as k")
    hot = find_hot_keys(keys, "k", 20_000)
    assert hot.keys == 1
    assert hot.rows == pytest.approx(133_334, rel=0.15)
    assert hot.table.first().hot_key == -1


def test_equal_rows_of_a_hot_key_part(spark):
    """4,000 rows of one user and one id over 40 shares: no task gets more than a few hundred."""
    facts = materialize(
        spark.range(4_000).selectExpr("'one' as user_id", "'same' as txn_id"), "facts"
    )
    people = spark.createDataFrame([("one", 1), ("two", 2)], "user_id string, mark int")
    hot = find_hot_keys(facts, "user_id", 100)
    assert hot.table.first().shares == 40
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        joined = join_spread(facts, people, "user_id", hot)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sum(sizes) == 4_000 and max(sizes) <= 500
