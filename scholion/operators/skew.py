"""Joins and filters that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def skew_safe_lookup(left: DataFrame, right: DataFrame, key: str, hot: int = 256, hot_counts: DataFrame | None = None) -> DataFrame:
    """Left join of ``left`` with ``right``, whose ``key`` is unique, however skewed ``key`` is in ``left``.

    The ``hot`` most frequent keys are looked up by a broadcast of at most ``hot`` rows; in the shuffled
    join those rows travel under a null key spread by a salt, so no task receives a whole hot group.
    Rows with a null key match nothing and are kept. ``key`` must be a string column. The salt is a hash of the row.
    Right columns other than ``key`` must not occur in ``left``.
    """
    counts = hot_counts if hot_counts is not None else left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    top = counts.orderBy(F.desc("_n"), key).limit(hot).select(F.col(key).alias("_hot"))
    values = [c for c in right.columns if c != key]
    hot_rows = right.join(F.broadcast(top), F.col(key) == F.col("_hot"), "left_semi").select(
        F.col(key).alias("_hot"), F.struct(*values).alias("_hot_value")
    )
    # a hash and no random number, so that a recomputed task sends its rows where they went before
    salt = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*left.columns), F.lit(1_000_000)).cast("string"))
    marked = left.join(F.broadcast(hot_rows), F.col(key) == F.col("_hot"), "left").withColumn(
        "_join", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), salt).otherwise(F.col(key))
    )
    cold = right.select(F.col(key).alias("_join"), F.struct(*values).alias("_cold_value"))
    got = marked.join(cold, "_join", "left")
    value = F.coalesce("_hot_value", "_cold_value")
    return got.select(*left.columns, *(value[c].alias(c) for c in values))


WORDS = 8


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """One bit in each of the block's eight 64-bit words, from a hash independent of the block's."""
    h = F.xxhash64(key, F.lit(11))
    g = F.xxhash64(key, F.lit(23))
    bits = [F.shiftrightunsigned(h if i < 5 else g, 6 * (i % 5)).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), b) for b in bits]


class BloomFilter:
    """Split-block Bloom filter of a key column, built by one aggregation and probed by expressions.

    ``blocks`` rows of eight words, 16 bits a key at every size, so one key in a thousand that is not held passes. Up
    to ``max_blocks`` (2**20 blocks are 64 MB, enough for 33 million keys) the filter is broadcast. A larger one stays
    partitioned by block, and the rows probed are shuffled to their blocks, those of hot keys spread.
    """

    def __init__(self, keys: DataFrame, key: str, expected: int, max_blocks: int = 1 << 20):
        self.blocks = max(1, -(-expected * 16 // (64 * WORDS)))
        self.partitioned = self.blocks > max_blocks
        k = F.col(key)
        masks = _masks(k)
        self.frame = (
            keys.where(k.isNotNull())
            .groupBy(_block(k, self.blocks).alias("_block"))
            .agg(*(F.bit_or(m).alias(f"_w{i}") for i, m in enumerate(masks)))
        )

    def probe(self, df: DataFrame, key: str, flag: str) -> DataFrame:
        """Adds ``flag``: false where the key is surely absent, true where it may be present, null for a null key."""
        k = F.col(key)
        hit = F.lit(True)
        for i, m in enumerate(_masks(k)):
            hit = hit & (F.col(f"_w{i}").bitwiseAND(m) == m)
        if self.partitioned:
            keyed = df.withColumn("_block", F.when(k.isNotNull(), _block(k, self.blocks).cast("string")))
            got = skew_safe_lookup(keyed, self.frame.withColumn("_block", F.col("_block").cast("string")), "_block")
        else:
            got = df.withColumn("_block", _block(k, self.blocks)).join(F.broadcast(self.frame), "_block", "left")
        return got.withColumn(flag, F.when(k.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(hit, F.lit(False)))).select(*df.columns, flag)
