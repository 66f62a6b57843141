"""Sharding by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table of prime size:
an offset and a step from the digest of its name. Shards take turns, each
claiming its next free slot, until the table is full; so shards own slots evenly,
and when one leaves few other slots change hands. A key's slot is its hash
modulo the size. The table has a fixed size and is broadcast, so placing a row
is one look-up and moves nothing.

A null key has the slot of the empty text. Repeated keys go to one shard, which
is the purpose. Other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 64
# 15 hex digits are the most that a signed long holds.
_DIGITS = 15


def _digest(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode(), usedforsecurity=False).hexdigest()[:_DIGITS], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in ``names``) of every slot."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be there and differ")
    if not is_prime(slots) or slots < len(names):
        raise ValueError("slots must be a prime number, no smaller than the number of shards")
    order = sorted(range(len(names)), key=lambda i: names[i])
    at = [_digest(n, "offset") % slots for n in names]
    step = [_digest(n, "step") % (slots - 1) + 1 for n in names]
    table = [-1] * slots
    left = slots
    while left:
        for i in order[:left]:
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            left -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, _DIGITS)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """``slot`` and ``shard``; one row for each slot."""
    filled = F.split(F.lit(",".join(map(str, fill(names, slots)))), ",")
    return spark.range(1).select(F.posexplode(filled).alias("slot", "shard")).select(
        "slot", F.col("shard").cast("int").alias("shard")
    )


def place(
    rows: DataFrame, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS
) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``; columns of these names are replaced."""
    names = names or [f"shard-{i:03d}" for i in range(SHARDS)]
    table = F.broadcast(table_frame(rows.sparkSession, names, slots))
    return rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(table, "slot")
