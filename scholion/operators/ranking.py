"""Ranks over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholion.session import cut


def global_row_number(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """Adds the place (from 1) of each row in the ascending order of columns that together are unique.

    Rows are range-partitioned and numbered within their range; the ranges' sizes, one number a partition,
    are summed on the driver.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(at)
        at += sizes.get(p, 0)
    offset = F.element_at(F.lit(before or [0]), F.col("_part") + 1)
    rn = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, (rn + offset).cast("bigint")).drop("_part")


def global_ntile(df: DataFrame, order: list[str], tiles: int, name: str = "tile") -> DataFrame:
    """Adds the tile, from 1 to ``tiles``; the first tiles hold one row more where the rows don't divide evenly."""
    numbered = global_row_number(df, order, "_rn")
    n = numbered.count()
    small, larger = divmod(n, tiles)
    border = larger * (small + 1)
    i = F.col("_rn") - 1
    tile = F.when(i < border, F.floor(i / (small + 1))).otherwise(larger + F.floor((i - border) / max(1, small)))
    return numbered.withColumn(name, (tile + 1).cast("int")).drop("_rn")


def rank_by_count(counts: DataFrame, n: str, name: str = "rank") -> DataFrame:
    """Adds the descending rank (ties share it) of rows of counts.

    The window runs over the distinct counts, of which there are at most about the square root of twice
    the rows counted.
    """
    distinct = counts.groupBy(n).agg(F.count("*").alias("_k"))
    above = F.coalesce(F.sum("_k").over(Window.orderBy(F.desc(n)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.join(distinct.select(n, (above + 1).cast("int").alias(name)), n)
