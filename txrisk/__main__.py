"""Run the batch job: ``spark-submit`` this file or ``python -m txrisk``."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import SparkSession

from txrisk.operators.skew import find_hot_keys
from txrisk.operators.transactions import from_scenarios
from txrisk.plans import pipeline
from txrisk.schemas import TRANSACTIONS
from txrisk.session import apply_sql_settings
from txrisk.sources.files import read_layer, read_scenarios, read_users


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="txrisk", description=__doc__)
    parser.add_argument("--users", required=True, help="user CSV")
    parser.add_argument("--transactions", required=True, help="Parquet in the bronze layout")
    parser.add_argument("--scenarios", help="scenario CSV; left out if the file is missing")
    parser.add_argument("--lake", required=True, help="root of the lake to publish")
    parser.add_argument("--date", type=datetime.date.fromisoformat, help="processing date")
    args = parser.parse_args(argv)
    # one date for the whole run, also over midnight
    date = args.date or datetime.datetime.now(datetime.UTC).date()

    spark = apply_sql_settings(SparkSession.builder.appName("txrisk").getOrCreate())
    users = read_users(spark, args.users)
    txns = read_layer(spark, args.transactions, TRANSACTIONS)
    scenarios = None
    if args.scenarios:
        raw = read_scenarios(spark, args.scenarios)
        scenarios = from_scenarios(raw, users, date, find_hot_keys(raw, "user_id"))
    pipeline.run(users, txns, args.lake, scenarios, date).show(truncate=False)


if __name__ == "__main__":
    main()
