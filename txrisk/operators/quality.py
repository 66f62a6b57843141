"""Data quality report and gate."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.operators.scoring import DECISIONS, LEVELS, MAX_SCORE


class QualityError(ValueError):
    """At least one check of the report failed."""


def _outside(name: str, allowed: list[str]) -> Column:
    return F.col(name).isNull() | ~F.col(name).isin(allowed)


# The check names are part of the published report.
def user_checks() -> dict[str, Column]:
    return {
        "usuarios_com_id_nulo": F.col("user_id").isNull(),
        "usuarios_com_pais_residencia_nulo": F.col("home_country").isNull(),
    }


def transaction_checks() -> dict[str, Column]:
    return {
        "transacoes_com_usuario_nulo": F.col("user_id").isNull(),
        "transacoes_com_valor_invalido": F.col("amount").isNull() | (F.col("amount") < 0),
        "transacoes_sem_data_hora": F.col("txn_ts").isNull(),
        "transacoes_sem_pais": F.col("txn_country").isNull(),
    }


def enriched_checks() -> dict[str, Column]:
    score = F.col("risk_score")
    return {
        "risk_score_fora_intervalo": score.isNull() | (score < 0) | (score > MAX_SCORE),
        "risk_level_invalido": _outside("risk_level", LEVELS),
        "decision_invalida": _outside("decision", DECISIONS),
    }


def _invalid_counts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per check, from a single pass over the columns the checks use."""
    counts = df.agg(*[F.count_if(bad).alias(name) for name, bad in checks.items()])
    return counts.unpivot([], list(checks), "check_name", "invalid_count")


def quality_report(
    users: DataFrame,
    txns: DataFrame,
    enriched: DataFrame,
    process_date: datetime.date | None = None,
) -> DataFrame:
    """Nine rows: check, number of invalid rows, PASS or FAIL, date."""
    parts = [
        _invalid_counts(users, user_checks()),
        _invalid_counts(txns, transaction_checks()),
        _invalid_counts(enriched, enriched_checks()),
    ]
    day = F.current_date() if process_date is None else F.lit(process_date)
    return reduce(DataFrame.unionByName, parts).withColumns(
        {
            "status": F.when(F.col("invalid_count") == 0, "PASS").otherwise("FAIL"),
            "process_date": day,
        }
    )


def require_pass(report: DataFrame) -> None:
    """Raise, naming every failed check."""
    failed = [
        row.check_name
        for row in report.select("check_name", "status").collect()
        if row.status == "FAIL"
    ]
    if failed:
        raise QualityError("failed data quality checks: " + ", ".join(sorted(failed)))
