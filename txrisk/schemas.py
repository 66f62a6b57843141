"""Schemas of the relations that the jobs read and write.

Money is ``double`` throughout, identifiers are strings, and the session time
zone decides how a timestamp maps to an hour or a date (``session.py`` pins it
to UTC).
"""

from pyspark.sql.types import ArrayType, StructType


def schema(text: str) -> StructType:
    """Schema from ``name type, name type``, without needing a session yet."""
    built = StructType()
    for field in text.split(","):
        name, kind = field.split()
        if kind.startswith("array<"):
            item = kind.removeprefix("array<").removesuffix(">")
            kind = {"type": "array", "elementType": item, "containsNull": True}
            built = built.add(name, ArrayType.fromJson(kind))
        else:
            built = built.add(name, kind)
    return built


# The CSV reader matches columns by position, so header names are free.
USERS_CSV = schema(
    """
    user_seq integer, user_id string, home_country string, home_city string,
    home_lat double, home_lon double, profile string, primary_device string,
    avg_ticket double, income_band string, created_on string
    """
)

USERS = schema(
    """
    user_seq integer, user_id string, home_country string, home_city string,
    home_lat double, home_lon double, profile string, primary_device string,
    avg_ticket double, income_band string, created_on date
    """
)

SCENARIOS_CSV = schema(
    """
    txn_id string, user_id string, txn_country string, txn_city string,
    lat double, lon double, amount double, device string, attempts integer,
    txn_ts string
    """
)

TRANSACTIONS = schema(
    """
    txn_id string, user_id string, profile string, home_country string,
    home_city string, txn_country string, txn_city string, lat double,
    lon double, amount double, avg_ticket double, device string,
    primary_device string, attempts integer, txn_ts timestamp,
    process_date date, txn_hour integer
    """
)

FEATURES = schema(
    """
    prev_country string, prev_city string, prev_lat double, prev_lon double,
    prev_txn_ts timestamp, prev_device string, hist_avg_amount double,
    hist_std_amount double, txns_1h long, countries_24h integer,
    mins_since_prev double, km_since_prev double, kmh_since_prev double,
    is_high_amount boolean, is_new_device boolean, is_new_country boolean,
    is_abnormal_freq boolean
    """
)

RISK = schema(
    "risk_score integer, risk_reasons array<string>, risk_level string, decision string"
)

ENRICHED = StructType(TRANSACTIONS.fields + FEATURES.fields + RISK.fields)

QUALITY = schema(
    "check_name string, invalid_count long, status string, process_date date"
)
