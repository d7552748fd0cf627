"""Shard placement by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: slot = (offset + j * skip) mod size, with offset and
skip from two hashes of the shard's name. The shards take turns, each claiming the first free slot in its order, until the
table is full, so shares differ by one slot at most and a changed set of shards moves few slots. A key is placed by
one look at the slot of its hash.

The table is bounded by its size, so it is broadcast; placing is one projection and a broadcast join, without a shuffle of the rows.
"""

from __future__ import annotations

import xxhash

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 65_537
MOST_SLOTS = 1 << 20  # the largest table that is sent to every executor


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], size: int = SIZE) -> list[int]:
    """Slot to number of the shard in ``shards``. Names must be distinct; their order doesn't matter but for the numbers."""
    if not is_prime(size) or size > MOST_SLOTS:
        raise ValueError(f"the table's size must be a prime of at most {MOST_SLOTS}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("give distinct shard names, at least one and no more than slots")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    at = [xxhash.xxh64_intdigest(s, 1) % size for s in shards]
    skip = [xxhash.xxh64_intdigest(s, 2) % (size - 1) + 1 if size > 2 else 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for i in turns:
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def lookup(spark: SparkSession, shards: list[str], size: int = SIZE) -> DataFrame:
    """(slot, shard) as a table of ``size`` rows."""
    names = F.array(*[F.lit(s) for s in shards])
    rows = [(slot, i) for slot, i in enumerate(fill(shards, size))]
    return spark.createDataFrame(rows, "slot int, i int").select("slot", F.get(names, F.col("i")).alias("shard"))


def slot_of(key: Column, size: int = SIZE) -> Column:
    """Slot of a key: its XXH64 modulo the size; a null key is placed as the empty string."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(size)).cast("int")


def place(df: DataFrame, key: Column, shards: list[str], size: int = SIZE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """All columns of ``df`` and the slot and shard of each row's key; equal keys go to the same shard, every row stays.

    Columns of ``df`` that are called like the new ones are refused.
    """
    taken = {c.lower() for c in df.columns}
    if {slot.lower(), shard.lower()} & taken:
        raise ValueError("name the new columns so that they don't clash")
    own = "_slot"
    while own in taken:
        own += "_"
    table = lookup(df.sparkSession, shards, size).toDF(own, shard)
    placed = df.withColumn(slot, slot_of(key, size)).join(F.broadcast(table), F.col(slot) == F.col(own))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], slot, shard)


def write_shards(df: DataFrame, path: str, shard: str = "shard", rows_per_file: int = 1_000_000) -> None:
    """One folder per shard, in files of about ``rows_per_file`` rows.

    Rows of a shard come together in as many parts as it has files, so there are few files however many tasks read the input, and a shard
    with most of the rows (a hot key) is written by many tasks. The counts are one row per shard.
    """
    files = df.groupBy(shard).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file))).alias("n")).collect()
    of = F.element_at(F.create_map(*[F.lit(v) for r in files for v in (r[0], int(r[1]))]), F.col(shard)) if files else F.lit(1)
    part = F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), of).cast("int")
    df.repartition(max(1, sum(int(r[1]) for r in files)), F.col(shard), part).write.partitionBy(shard).option("maxRecordsPerFile", rows_per_file).parquet(path)
