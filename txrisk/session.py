"""Session settings and the folder for intermediate tables."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the jobs rely on. Hours and dates are taken in UTC; the
# rest are Spark's adaptive defaults, stated so that a cluster profile that
# turns them off does not change the plans.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def apply_sql_settings(spark: SparkSession) -> SparkSession:
    for name, value in SQL_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def object_store_conf(
    endpoint: str,
    access_key: str,
    secret_key: str,
    *,
    path_style: bool = True,
    tls: bool = True,
    timeout_ms: int = 60_000,
    connect_timeout_ms: int = 5_000,
) -> dict[str, str]:
    """Settings for a lake root of the form ``s3a://bucket``.

    Pass them to ``SparkSession.builder.config``; the hadoop-aws jars come from
    the cluster image or ``spark.jars.packages``.
    """
    prefix = "spark.hadoop.fs.s3a."
    return {
        prefix + "endpoint": endpoint,
        prefix + "access.key": access_key,
        prefix + "secret.key": secret_key,
        prefix + "path.style.access": str(path_style).lower(),
        prefix + "connection.ssl.enabled": str(tls).lower(),
        prefix + "connection.timeout": str(timeout_ms),
        prefix + "connection.request.timeout": str(timeout_ms),
        prefix + "connection.establish.timeout": str(connect_timeout_ms),
        prefix + "impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
    }


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return tempfile.mkdtemp(prefix="txrisk-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; none there is fine."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# The folders made in each open :func:`recorded`, the innermost last.
_scopes: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The list of the folders that :func:`materialize` makes within."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes[:] = [scope for scope in _scopes if scope is not made]


def free(spark: SparkSession, folders: list[str]) -> None:
    """Delete stored tables that nothing reads any more, and shuffle files nothing refers to."""
    for path in folders:
        remove(spark, path)
    folders.clear()
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what :func:`materialize` stored within.

    What is read from there must have been written elsewhere by then.
    """
    with recorded() as made:
        try:
            yield
        finally:
            for path in made:
                remove(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so that a lost executor does not recompute what came
    before, and every later reader sees the same rows. Parquet rather than
    ``checkpoint()`` because readers then load only the columns they use. The
    folder stays, unless it was made within :func:`released`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
