"""Keys too large for one task: finding them, and joining on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this does not go to one task as a whole.
ROWS_PER_TASK = 1_000_000

# The list of hot keys is broadcast, so it has a fixed maximum length. With the
# largest keys listed, a key left off the list holds at most one part in
# MAX_HOT_KEYS of all rows and is fine as an ordinary group.
MAX_HOT_KEYS = 100_000

SAMPLED_ROWS_OF_A_HOT_KEY = 1_000
SAMPLE_SEED = 7


@dataclass(frozen=True)
class HotKeys:
    """The keys of a relation that exceed ``rows_per_task`` rows.

    ``table`` has columns ``hot_key``, ``hot_rows`` (estimated) and ``shares``,
    the number of task-sized parts of the key; it is None if no key is hot.
    ``rows`` is the estimated total of the hot keys.
    """

    table: DataFrame | None = None
    keys: int = 0
    rows: int = 0

    def __bool__(self) -> bool:
        return self.table is not None

    def renamed(self, expression: str) -> HotKeys:
        """The same keys under another form, one-to-one, such as a number as text."""
        if not self:
            return self
        table = self.table.withColumn("hot_key", F.expr(expression))
        return HotKeys(table, self.keys, self.rows)

    def only(self, df: DataFrame, key: str) -> DataFrame:
        hot = F.broadcast(self.table)
        return df.join(hot, df[key].eqNullSafe(hot["hot_key"]), "left_semi")

    def without(self, df: DataFrame, key: str) -> DataFrame:
        hot = F.broadcast(self.table)
        return df.join(hot, df[key].eqNullSafe(hot["hot_key"]), "left_anti")


def find_hot_keys(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> HotKeys:
    """List the keys with more than ``rows_per_task`` rows, largest first.

    Runs one job that scans the key column and counts a sample of it, large
    enough to see a key of that size SAMPLED_ROWS_OF_A_HOT_KEY times. The counts
    only choose between two ways to the same result: a key near the limit that
    is missed is a somewhat larger task, and no row is left out. Give it a cheap
    scan of the key (a stored layer) where there is one.
    """
    fraction = min(1.0, SAMPLED_ROWS_OF_A_HOT_KEY / rows_per_task)
    keys = df.select(F.col(key).alias("hot_key"))
    if fraction < 1.0:
        keys = keys.sample(fraction, seed=SAMPLE_SEED)
    found = (
        keys.groupBy("hot_key")
        .agg(F.ceil(F.count(F.lit(1)) / fraction).alias("hot_rows"))
        .filter(F.col("hot_rows") > rows_per_task)
        .orderBy(F.desc("hot_rows"), "hot_key")
        .limit(MAX_HOT_KEYS)
        .collect()
    )
    if not found:
        return HotKeys()
    rows = [(r.hot_key, r.hot_rows, -(-r.hot_rows // rows_per_task)) for r in found]
    key_type = df.schema[key].dataType.simpleString()
    table = df.sparkSession.createDataFrame(
        rows, f"hot_key {key_type}, hot_rows bigint, shares bigint"
    )
    return HotKeys(table, len(rows), sum(r.hot_rows for r in found))


def join_spread(facts: DataFrame, dim: DataFrame, key: str, hot: HotKeys) -> DataFrame:
    """Inner equi-join ``facts`` with ``dim`` where ``hot`` keys of ``facts`` are salted.

    Rows of a hot key are dealt over its ``shares`` by a hash of their number,
    so even equal rows part; the matching ``dim`` rows are repeated once per
    share, which is in total at most twice the fact rows over the task size.
    Other keys join as they are, by broadcast or shuffle as the sizes tell.
    ``facts`` should be a scan with projections and filters, whose rows get the
    same numbers again if a task is repeated.
    """
    if not hot:
        return facts.join(dim, key)
    shares = F.broadcast(hot.table.select(F.col("hot_key").alias(key), "shares"))
    numbered = hot.only(facts.withColumn("share", F.monotonically_increasing_id()), key)
    dealt = numbered.join(shares, key).withColumn(
        "share", F.pmod(F.xxhash64("share"), F.col("shares"))
    )
    repeated = dim.join(shares, key).withColumn(
        "share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1))
    )
    salted = dealt.drop("shares").join(repeated.drop("shares"), [key, "share"]).drop("share")
    return hot.without(facts, key).join(dim, key).unionByName(salted)
