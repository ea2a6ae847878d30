"""Top N items within every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(items: DataFrame, group: str, item: str, score: str, n: int = 10, salts: int = 64, rank: str = "row_rank") -> DataFrame:
    """The ``n`` distinct items of highest score of every group: group, item, rank (from 1).

    Items are spread over ``salts`` subgroups by their hash; each subgroup keeps its own best ``n``, and
    only those survivors (at most salts * n a group) are ranked again, so a group of any size never meets
    in one task. Ties go to the smaller item, null scores come last, rows with a null group or item are
    left out, an item that repeats counts once with its highest score. Fewer than n rows come from small
    groups, none from empty input.
    """
    best = items.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(F.max(score).alias("_score"))
    order = [F.desc_nulls_last("_score"), F.asc(item)]
    salted = best.withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(salts)))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))).where(F.col("_r") <= n)
    second = first.drop("_r", "_salt").withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= n)
    return second.select(group, item, rank)


def community_top_journals(representatives: DataFrame, citations: DataFrame, n: int = 10) -> DataFrame:
    """community_id, journal_id, row_rank: the n most cited journals of each community; journals without a count come last.

    A journal whose count repeats or differs has its highest count. The old ``row_rank`` is not read.
    """
    pairs = representatives.select("community_id", "journal_id").where("community_id is not null and journal_id is not null").distinct()
    counts = citations.where("journal_id is not null").groupBy("journal_id").agg(F.max("citations_number").alias("citations_number"))
    return top_n(pairs.join(counts, "journal_id", "left"), "community_id", "journal_id", "citations_number", n)
