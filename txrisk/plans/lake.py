"""The bronze, silver and gold layers of the lake.

Every run writes each layer once, into a folder of its own below the layer's. A
run is published by one row in ``_published``, written last; readers follow the
latest row, so they see the layers of one run or of the one before it, never a
mixture and never a run that failed. One run publishes at a time.
"""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from txrisk.schemas import ENRICHED, QUALITY, TRANSACTIONS, USERS
from txrisk.session import remove
from txrisk.sources.files import read_json, read_layer


@dataclass(frozen=True)
class Layer:
    folder: str
    schema: StructType
    partitions: tuple[str, ...] = ()
    # Rows are kept in this order within a partition, so that a lookup by the
    # first column skips most files and pages by their statistics.
    sorted_by: tuple[str, ...] = ()
    # Columns with a Bloom filter, for lookups the order does not help.
    looked_up: tuple[str, ...] = ()


BRONZE_USERS = Layer("bronze/users", USERS)
BRONZE_TRANSACTIONS = Layer("bronze/transactions", TRANSACTIONS, ("process_date",))
SILVER = Layer(
    "silver/enriched_transactions",
    ENRICHED,
    ("process_date",),
    sorted_by=("user_id", "txn_ts"),
    looked_up=("txn_id",),
)
ALERTS = Layer(
    "gold/fraud_alerts",
    ENRICHED,
    ("process_date", "risk_level"),
    sorted_by=("user_id", "txn_ts"),
)
DATA_QUALITY = Layer("gold/data_quality", QUALITY, ("process_date",))

LAYERS = (BRONZE_USERS, BRONZE_TRANSACTIONS, SILVER, ALERTS, DATA_QUALITY)


PUBLISHED = "_published"
# Runs that stay readable: the published one and the one that readers may still be in.
KEPT_RUNS = 2

# Rows of a file, and the least that are worth a file of their own.
ROWS_PER_FILE = 1_000_000
LEAST_ROWS_PER_FILE = 25_000


def new_run() -> str:
    started = datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%S%f")
    return f"{started}-{uuid.uuid4().hex[:8]}"


def files_for(spark: SparkSession, rows: int) -> int:
    """Files, and tasks, for so many rows: even, and enough for the cores where rows are few."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, -(-rows // ROWS_PER_FILE), min(cores, -(-rows // LEAST_ROWS_PER_FILE)))


def layer_path(root: str, layer: Layer, run: str) -> str:
    return f"{root}/{layer.folder}/run={run}"


def write_layer(
    df: DataFrame, root: str, layer: Layer, run: str, files: int | None = None
) -> DataFrame:
    """Write the layer of a run and return what was stored.

    Without a shuffle every task would leave one small file in every partition.
    Layers that are looked up are cut into ``files`` even ranges of their
    partition columns and sort order, so that a lookup opens few files; the
    number comes from the stored rows unless it is given. The column ``row_no``
    splits even complete copies; a stored table without it is numbered here,
    which gives the same numbers again if a task is repeated. The others are
    rebalanced by their partition columns. Either way a partition with a large
    part of the rows is spread over several tasks and files.
    """
    spark, order = df.sparkSession, layer.partitions + layer.sorted_by
    rows = df.select(*layer.schema.names)
    if layer.sorted_by:
        if files is None:
            files = files_for(spark, df.count())
        number = F.col("row_no") if "row_no" in df.columns else F.monotonically_increasing_id()
        rows = (
            df.select(*layer.schema.names, number.alias("row_no"))
            .repartitionByRange(files, *order, "row_no")
            .sortWithinPartitions(*order)
            .drop("row_no")
        )
    elif layer.partitions:
        rows = rows.hint("rebalance", *layer.partitions)
    writer = rows.write.mode("errorifexists").partitionBy(*layer.partitions)
    for name in layer.looked_up:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(
            "parquet.bloom.filter.adaptive.enabled", "true"
        )
    writer.parquet(layer_path(root, layer, run))
    return read(spark, root, layer, run)


def publish(spark: SparkSession, root: str, run: str) -> None:
    """Make ``run`` the one that readers see, and delete the runs before the last ones."""
    row = spark.range(1).select(
        F.lit(run).alias("run"), F.expr("unix_micros(current_timestamp())").alias("published")
    )
    row.write.mode("append").json(f"{root}/{PUBLISHED}")
    # a failed or already deleted run has nothing left, which is fine
    for old in _published(spark, root)[KEPT_RUNS:]:
        discard(spark, root, old)


def _published(spark: SparkSession, root: str) -> list[str]:
    """The last published runs, the latest first."""
    log = read_json(spark, f"{root}/{PUBLISHED}", "run string, published bigint")
    latest = log.orderBy(F.desc("published"), F.desc("run")).limit(KEPT_RUNS + 1)
    return [row.run for row in latest.collect()]


def current_run(spark: SparkSession, root: str) -> str | None:
    """The published run, None if there is none."""
    return next(iter(_published(spark, root)), None)


def discard(spark: SparkSession, root: str, run: str) -> None:
    """Delete what a run wrote."""
    for layer in LAYERS:
        remove(spark, layer_path(root, layer, run))


def read(spark: SparkSession, root: str, layer: Layer, run: str | None = None) -> DataFrame:
    """The rows of a run, of the published one by default, in the layer's column order.

    None if nothing was published.
    """
    run = run or current_run(spark, root)
    if run is None:
        return spark.createDataFrame([], layer.schema)
    return read_layer(spark, layer_path(root, layer, run), layer.schema)
