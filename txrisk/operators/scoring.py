"""Risk rules, score, level and decision. Row-local: no shuffle."""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    code: str
    points: int
    condition: Column


MAX_SCORE = 100

# Lowest score of each level, highest level first.
LEVEL_FLOORS = [("CRITICAL", 85), ("HIGH", 60), ("MEDIUM", 35)]
LOWEST_LEVEL = "LOW"
LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
ALERT_LEVELS = ["MEDIUM", "HIGH", "CRITICAL"]
DECISIONS = ["APPROVE", "REVIEW", "BLOCK"]
LEVEL_DECISIONS = {"CRITICAL": "BLOCK", "HIGH": "REVIEW", "MEDIUM": "REVIEW"}
OTHER_DECISION = "APPROVE"


def rules() -> list[Rule]:
    """The rules in the order in which their codes are reported."""
    c = F.col
    return [
        Rule("IMPOSSIBLE_TRAVEL", 45, c("kmh_since_prev") > 900),
        Rule("VALUE_ABOVE_USER_PROFILE", 25, c("is_high_amount")),
        Rule("NEW_DEVICE", 10, c("is_new_device")),
        Rule("NEW_COUNTRY_FOR_USER", 10, c("is_new_country")),
        Rule("HIGH_ATTEMPT_COUNT", 20, c("attempts") >= 3),
        Rule("UNUSUAL_TRANSACTION_HOUR", 8, c("txn_hour") < 6),
        Rule("ABNORMAL_FREQUENCY", 12, c("is_abnormal_freq")),
    ]


def score_of(active: list[Rule]) -> Column:
    """Points of the rules that fire, capped. An unknown condition does not fire."""
    points = [F.when(rule.condition, rule.points).otherwise(0) for rule in active]
    return F.least(F.lit(MAX_SCORE), reduce(add, points))


def reasons_of(active: list[Rule]) -> Column:
    """Codes of the rules that fire, in rule order."""
    return F.array_compact(
        F.array(*[F.when(rule.condition, F.lit(rule.code)) for rule in active])
    )


# Level and decision are looked up rather than compared step by step. A filter on
# them that Spark moves below the projections repeats the whole score, travel
# figures included, wherever their expression names it; this way that is once.


def level_of(score: str) -> Column:
    names = []
    for value in range(MAX_SCORE + 1):
        reached = [level for level, floor in LEVEL_FLOORS if value >= floor]
        names.append(reached[0] if reached else LOWEST_LEVEL)
    table = ", ".join(f"'{name}'" for name in names)
    return F.expr(f"element_at(array({table}), {score} + 1)")


def decision_of(level: str) -> Column:
    table = ", ".join(f"'{name}', '{decision}'" for name, decision in LEVEL_DECISIONS.items())
    return F.expr(f"coalesce(try_element_at(map({table}), {level}), '{OTHER_DECISION}')")


def add_risk(features: DataFrame) -> DataFrame:
    active = rules()
    return (
        features.withColumns(
            {"risk_score": score_of(active), "risk_reasons": reasons_of(active)}
        )
        .withColumn("risk_level", level_of("risk_score"))
        .withColumn("decision", decision_of("risk_level"))
    )


def only_alerts(enriched: DataFrame) -> DataFrame:
    return enriched.filter(F.col("risk_level").isin(ALERT_LEVELS))
