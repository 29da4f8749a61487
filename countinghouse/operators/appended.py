"""Key checks of an appended batch, without a look at all that is stored.

With a table goes a filter of its keys: a Bloom filter of many blocks, one row each, which
Spark's bitmap functions build and unite, so the keys of a batch are added without the old
ones. A key has all its bits in one block. A key whose bits are not all set is certainly
new; only the others are looked up among the stored keys, which stay where they are while
Spark sends it the few that are asked for.

Nulls are no keys: they repeat nothing and refer to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block, as many as Spark's bitmaps have; bits of a key; bits of a block a key.
BLOCK_BITS, KEY_BITS, SPARE = 32_768, 4, 12


def blocks_for(keys: int) -> int:
    """The number of blocks for so many keys: about one key in a hundred is a false hit."""
    return max(1, -(-keys * SPARE // BLOCK_BITS))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """From two halves of a second hash, as whole numbers below the size of a block."""
    seed = F.xxhash64(key, F.lit(1))
    one, two = F.pmod(seed, F.lit(1 << 30)), F.pmod(F.shiftright(seed, 32), F.lit(1 << 30))
    return [F.pmod(one + n * two + n * n, F.lit(BLOCK_BITS)) for n in range(KEY_BITS)]


def key_filter(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """``block`` and its ``bits`` for the keys of ``rows``."""
    known = rows.select(F.col(key).alias("key")).filter("key is not null")
    bit = F.explode(F.array(*_bits(F.col("key")))).alias("bit")
    return (
        known.select(_block(F.col("key"), blocks).alias("block"), bit)
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )


def united(one: DataFrame, other: DataFrame) -> DataFrame:
    """The filter of the keys of both."""
    return one.unionByName(other).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def _is_set(bits: Column, bit: Column) -> Column:
    byte = F.substring(bits, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.call_function("getbit", value, bit.bitwiseAND(F.lit(7)).cast("int")) == 1


def maybe_known(batch: DataFrame, key: str, keys: DataFrame, blocks: int) -> DataFrame:
    """The different keys of ``batch`` that the filter ``keys`` doesn't rule out."""
    asked = batch.select(F.col(key).alias("key")).filter("key is not null").distinct()
    found = asked.withColumn("block", _block(F.col("key"), blocks)).join(keys, "block")
    hit = F.lit(True)
    for bit in _bits(F.col("key")):
        hit &= _is_set(F.col("bits"), bit)
    return found.filter(hit).select(F.col("key").alias(key))


def known_keys(
    stored: DataFrame, batch: DataFrame, key: str, keys: DataFrame, blocks: int
) -> DataFrame:
    """The different keys of ``batch`` that ``stored`` has."""
    hits = maybe_known(batch, key, keys, blocks)
    return stored.select(key).join(hits, key, "left_semi").distinct()


def repeated_keys(
    stored: DataFrame, batch: DataFrame, key: str, keys: DataFrame, blocks: int
) -> DataFrame:
    """The keys of ``batch`` that it has twice or that ``stored`` has, and their number in it."""
    counted = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("batch_rows")
    )
    old = known_keys(stored, batch, key, keys, blocks).withColumn("is_stored", F.lit(True))
    both = counted.join(old, key, "left").fillna(False, ["is_stored"])
    return both.filter((F.col("batch_rows") > 1) | F.col("is_stored"))


def orphans(
    stored: DataFrame, batch: DataFrame, key: str, keys: DataFrame, blocks: int
) -> DataFrame:
    """The keys of ``batch`` that ``stored`` lacks, and their number of rows."""
    counted = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("batch_rows")
    )
    return counted.join(known_keys(stored, batch, key, keys, blocks), key, "left_anti")
