"""Semi and anti joins that move keys, not rows.

The keys are counted first. Few go to all tasks whole. More of them make a
blocked Bloom filter, by aggregation, of a size that follows from the count; it
goes to all tasks, so that only rows which it holds are shuffled to the exact
join. Beyond BLOCKS blocks the join is a plain one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different keys that are sent to all tasks as they are.
FEW = 100_000
#: Bits of the filter for a key, and blocks of 64 bits that are sent at most (some 40 bytes each).
BITS, BLOCKS = 16, 2_000_000


def _place(on: list[str], blocks: int) -> tuple[Column, Column]:
    """A key's block, and its four bits in it."""
    h = F.xxhash64(*on, F.lit("bloom"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    bits = bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))
    return F.pmod(F.shiftrightunsigned(h, 24), F.lit(blocks)), bits


def bloom(keys: DataFrame, count: int, on: list[str]) -> tuple[DataFrame, int] | None:
    """(block, bits) of the filter and its number of blocks; None if it would be too large to send."""
    blocks = max(1, -(-count * BITS // 64))
    if blocks > BLOCKS:
        return None
    block, bits = _place(on, blocks)
    placed = keys.select(block.alias("__block"), bits.alias("__bits"))
    return placed.groupBy("__block").agg(F.bit_or("__bits").alias("__bits")), blocks


def marked(rows: DataFrame, keys: DataFrame, count: int, on: list[str]) -> DataFrame | None:
    """rows with __maybe: false where the row's key is none of the keys for certain."""
    made = bloom(keys, count, on)
    if made is None:
        return None
    table, blocks = made
    block, bits = _place(on, blocks)
    maybe = F.coalesce(F.col("__bits").bitwiseAND(bits) == bits, F.lit(False))
    return rows.withColumn("__block", block).join(F.broadcast(table), "__block", "left").withColumn("__maybe", maybe).drop("__block", "__bits")


def keep(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """The rows whose key is one of the keys; null keys are none. keys is read twice, so it should be a stored table or cheap."""
    on = [on] if isinstance(on, str) else on
    own = keys.select(*on).distinct()
    count = own.count()
    if count <= FEW:
        return rows.join(F.broadcast(own), on, "left_semi")
    some = marked(rows, own, count, on)
    return (rows if some is None else some.where("__maybe").drop("__maybe")).join(own, on, "left_semi")


def drop(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """The rows whose key is none of the keys; rows with null keys stay. Those that the filter does not hold are not shuffled."""
    on = [on] if isinstance(on, str) else on
    own = keys.select(*on).distinct()
    count = own.count()
    if count <= FEW:
        return rows.join(F.broadcast(own), on, "left_anti")
    some = marked(rows, own, count, on)
    if some is None:
        return rows.join(own, on, "left_anti")
    free = some.where("NOT __maybe").drop("__maybe")
    return free.unionByName(some.where("__maybe").drop("__maybe").join(own, on, "left_anti"))


def missing(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """The different keys of rows that are none of the keys; null keys are not looked for. Keys alone are shuffled."""
    on = [on] if isinstance(on, str) else on
    return rows.select(*on).na.drop().distinct().join(keys.select(*on), on, "left_anti")
