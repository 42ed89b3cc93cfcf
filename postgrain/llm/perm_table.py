"""Placing records on shards by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size, from two hashes of its name. Shards take
turns (a shard of weight w takes w turns a round) to claim their next free slot until the table is full. A record's key is
hashed to a slot, so that placing takes constant time, shards differ by at most a turn in slots, and adding or removing a
shard moves few other slots. The table has a fixed number of rows and is broadcast.

A null key counts as the empty key. Equal keys go to one shard; a shard's files are split by a second hash, so that a hot
shard is written by many tasks. Key columns may have any names, also shard and slot. An empty input gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
MOST_SLOTS = 1_000_003  # 12 MB to broadcast


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: dict[str, int], slots: int = SLOTS) -> list[str]:
    """The shard of each slot. ``shards`` has names with turns per round (1 or more); their order does not matter."""
    if not is_prime(slots) or not max(sum(shards.values()), 1) <= slots <= MOST_SLOTS:
        raise ValueError(f"a prime number of slots is needed, at least one a turn and at most {MOST_SLOTS}")
    if not shards or min(shards.values()) < 1:
        raise ValueError("every table needs a shard, and every shard a turn")
    names = sorted(shards)
    place, step = {}, {}
    for name in names:
        digest = sha256(name.encode()).digest()
        place[name] = int.from_bytes(digest[:8], "big") % slots
        step[name] = int.from_bytes(digest[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1
    table: list[str | None] = [None] * slots
    left = slots
    while left:
        for name in names:
            for _ in range(min(shards[name], left)):
                at = place[name]
                while table[at] is not None:
                    at = (at + step[name]) % slots
                table[at] = name
                place[name] = at
                left -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot, from the first 60 bits of its MD5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, key: str, tables: dict[str, list[str]]) -> DataFrame:
    """``docs`` with a column for each table (all of one size): the shard that it gives the record's key, and ``slot``.

    A column of ``docs`` with such a name is replaced.
    """
    size = len(next(iter(tables.values())))
    spark = docs.sparkSession
    rows = [(k, *(table[k] for table in tables.values())) for k in range(size)]
    schema = ", ".join(["__slot int", *(f"`{name}` string" for name in tables)])
    lookup = F.broadcast(spark.createDataFrame(rows, schema))  # at most MOST_SLOTS rows
    others = [c for c in docs.columns if c not in tables and c != "slot"]
    keyed = docs.select(*(F.col(f"`{c}`") for c in others), slot_of(F.col(f"`{key}`"), size).alias("slot"))
    joined = keyed.join(lookup, F.col("slot") == F.col("__slot"))
    return joined.select(*(F.col(f"`{c}`") for c in [*others, "slot", *tables]))


def write_shards(placed: DataFrame, path: str, shard: str = "shard", key: str = "doc_id", files: int = 8) -> None:
    """A folder for each shard, each of ``files`` files."""
    salt = F.pmod(F.xxhash64(F.col(key)), F.lit(files))
    placed.repartition(F.col(shard), salt).write.partitionBy(shard).parquet(path)
