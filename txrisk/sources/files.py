"""Typed scans: user and scenario CSV files, the country table, lake layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from txrisk.schemas import SCENARIOS_CSV, USERS_CSV

# Country code, city, latitude, longitude.
COUNTRIES = [
    ("BR", "Sao Paulo", -23.5505, -46.6333),
    ("US", "New York", 40.7128, -74.0060),
    ("GB", "London", 51.5074, -0.1278),
    ("FR", "Paris", 48.8566, 2.3522),
    ("DE", "Berlin", 52.5200, 13.4050),
    ("IN", "Mumbai", 19.0760, 72.8777),
    ("CN", "Shanghai", 31.2304, 121.4737),
    ("JP", "Tokyo", 35.6762, 139.6503),
    ("CA", "Toronto", 43.6532, -79.3832),
    ("AU", "Sydney", -33.8688, 151.2093),
]


def countries(spark: SparkSession) -> DataFrame:
    """The ten known countries with their list position ``geo_idx``."""
    rows = ", ".join(
        f"({i}, '{code}', '{city}', {lat}D, {lon}D)"
        for i, (code, city, lat, lon) in enumerate(COUNTRIES)
    )
    return spark.sql(f"VALUES {rows} AS countries(geo_idx, txn_country, txn_city, lat, lon)")


def _no_rows_if_missing(
    spark: SparkSession, schema: StructType | str, read: Callable[[], DataFrame]
) -> DataFrame:
    try:
        return read()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """User CSV with a header row. A bad date becomes null."""
    raw = spark.read.schema(USERS_CSV).option("header", True).csv(path)
    return raw.withColumn("created_on", F.try_to_date("created_on"))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario CSV with a header row; no rows if the file is missing.

    A bad timestamp becomes null, so that the quality report counts it.
    """
    csv = spark.read.schema(SCENARIOS_CSV).option("header", True)
    raw = _no_rows_if_missing(spark, SCENARIOS_CSV, lambda: csv.csv(path))
    return raw.withColumn("txn_ts", F.try_to_timestamp("txn_ts"))


def read_layer(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Hive-partitioned Parquet folder with a declared schema.

    The schema keeps partition discovery from retyping identifiers. A missing
    or empty folder reads as no rows.
    """
    parquet = spark.read.schema(schema)
    return _no_rows_if_missing(spark, schema, lambda: parquet.parquet(path)).select(*schema.names)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; no rows if there is no such folder."""
    json = spark.read.schema(schema)
    return _no_rows_if_missing(spark, schema, lambda: json.json(path))
