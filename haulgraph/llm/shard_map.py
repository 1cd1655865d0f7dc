"""Sharding by a permutation-filled lookup table, in SQL functions alone.

Each shard prefers the slots of a prime-sized table in its own order, offset + k * skip. Shards take turns in the given
order; on its turn a shard claims the first slot of its order that is free, until none is. A key's slot is its hash
modulo the table's size. Shares differ by one slot at most, and a shard that leaves moves few other keys.

The table has ``slots`` rows whatever the input, so it is broadcast; placing a row costs one hash and one probe.

Defined results: a null key places like an empty one; equal keys place alike; names of shards must be distinct, and
there may be no more than ``slots`` of them; the output is the input's columns, repeated rows repeated, with ``slot`` and
``shard``, which replace columns of the input that are called so (the key may be one); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The table is filled by one task, in time that grows with the square of the slots.
MAX_SLOTS = 4099


def hash48(text):
    """48 bits of MD5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard): every slot's owner."""
    if slots > MAX_SLOTS or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots: a prime up to {MAX_SLOTS}")
    if not shards or len(shards) > slots or len(set(shards)) < len(shards):
        raise ValueError("shards: distinct names, one at least, no more than slots")
    names = F.array(*map(F.lit, shards))
    orders = F.transform(
        names,
        lambda name: F.transform(
            F.sequence(F.lit(0), F.lit(slots - 1)),
            lambda k: ((hash48(F.concat(name, F.lit("#offset"))) + k * (hash48(F.concat(name, F.lit("#skip"))) % (slots - 1) + 1)) % slots).cast("int"),
        ),
    )
    free = F.transform(F.sequence(F.lit(1), F.lit(slots)), lambda _: F.lit(-1))

    # the orders ride along in the state, so they are worked out once
    def claim(state, turn):
        shard = (turn % len(shards)).cast("int")
        wanted = F.array(F.element_at(F.filter(F.element_at(state["orders"], shard + 1), lambda slot: F.element_at(state["owner"], slot + 1) < 0), 1))
        owner = lambda w: F.concat(F.slice(state["owner"], F.lit(1), w), F.array(shard), F.slice(state["owner"], w + 2, F.lit(slots)))
        return F.element_at(F.transform(wanted, lambda w: F.struct(owner(w).alias("owner"), state["orders"].alias("orders"))), 1)

    start = F.struct(free.alias("owner"), orders.alias("orders"))
    filled = spark.range(1, numPartitions=1).select(names.alias("names"), F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), start, claim)["owner"].alias("owner"))
    return filled.select("names", F.posexplode("owner").alias("slot", "owner")).select("slot", F.element_at("names", F.col("owner") + 1).alias("shard"))


def place(df: DataFrame, key: str, shards: list[str], slots: int = 2053) -> DataFrame:
    """``df`` with each row's slot and shard."""
    owners = lookup_table(df.sparkSession, shards, slots)
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    keyed = df.select(*kept, (hash48(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))) % slots).cast("int").alias("slot"))
    return keyed.join(F.broadcast(owners), "slot", "left").select(*kept, "slot", "shard")
