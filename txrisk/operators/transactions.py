"""Building canonical transactions from their sources."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.operators.skew import HotKeys, join_spread
from txrisk.schemas import TRANSACTIONS

USER_COLUMNS = [
    "user_id", "profile", "home_country", "home_city", "avg_ticket", "primary_device",
]


def join_countries(txns: DataFrame, countries: DataFrame) -> DataFrame:
    """Add city and coordinates of ``txn_country``; an unknown country keeps its row.

    ``countries`` is the fixed list of ten.
    """
    places = countries.select("txn_country", "txn_city", "lat", "lon")
    return txns.join(F.broadcast(places), "txn_country", "left")


def canonical(txns: DataFrame, process_date: datetime.date | None = None) -> DataFrame:
    """The transaction columns in order, with the hour and the processing date.

    ``process_date`` stamps every row; without it a ``process_date`` column of
    the input is kept, or else the rows get the date of the run.
    """
    if process_date is not None:
        txns = txns.withColumn("process_date", F.lit(process_date))
    elif "process_date" not in txns.columns:
        txns = txns.withColumn("process_date", F.current_date())
    return txns.withColumn("txn_hour", F.hour("txn_ts")).select(*TRANSACTIONS.names)


def from_scenarios(
    scenarios: DataFrame,
    users: DataFrame,
    process_date: datetime.date | None = None,
    hot: HotKeys = HotKeys(),
) -> DataFrame:
    """Scenario rows as transactions; those of unknown users drop out."""
    joined = join_spread(scenarios, users.select(*USER_COLUMNS), "user_id", hot)
    return canonical(joined, process_date)
