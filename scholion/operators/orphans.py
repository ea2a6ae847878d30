"""References to records that do not exist: orphan detection with a Bloom filter and an exact check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.operators.skew import BloomFilter, skew_safe_lookup


def doi_key(doi: Column) -> Column:
    """A DOI for comparison: from ``10.`` on, lower case, without outer white space; null when blank."""
    trimmed = F.regexp_replace(doi, r"^[\s ]+|[\s ]+$", "")
    at = F.instr(trimmed, "10.")
    cut = F.when(at > 0, F.substring(trimmed, at, F.length(trimmed))).otherwise(trimmed)
    return F.when(F.length(cut) > 0, F.lower(cut))


def first_delivery(references: DataFrame) -> DataFrame:
    """The row of earliest ``indexed_at`` (nulls last) of each (work_id, key), with its compared DOI."""
    row = F.struct(F.col("indexed_at").isNull().alias("n"), F.col("indexed_at").alias("at"), doi_key(F.col("doi")).alias("doi"))
    return (
        references.groupBy("work_id", F.col("key").alias("ref_key"))
        .agg(F.min(row).alias("r"))
        .select("work_id", "ref_key", F.col("r.at").alias("at"), F.col("r.doi").alias("doi"))
    )


def orphan_references(references: DataFrame, works: DataFrame) -> DataFrame:
    """Every dangling side of every reference: work_id, ref_key, side, reason, period.

    Columns needed: references(work_id, key, doi, indexed_at), works(id, doi, indexed_at, deleted_at);
    others are ignored, also such of equal names. A null work_id or a null or blank DOI refers to
    nothing and is no case. Repeated deliveries count once, by the earliest time; a reference whose
    times are all null has a null period and is never late or deleted. Empty tables: empty
    ``references`` give no row, empty ``works`` make every reference ``missing``.

    A filter of the parent keys settles the sure orphans without a join; only references that pass it
    meet ``works`` in an exact join, in which hot DOIs are spread.
    """
    refs = first_delivery(references)
    w = works.select("id", doi_key(F.col("doi")).alias("doi"), "indexed_at", "deleted_at")
    expected = works.count()
    ids = w.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("work_key")).distinct().withColumn("held", F.lit(True))
    dois = (
        w.where(F.col("doi").isNotNull())
        .groupBy("doi")
        .agg(F.min("indexed_at").alias("first_at"), F.min("deleted_at").alias("gone_at"))
        .withColumn("doi_held", F.lit(True))
    )
    id_filter = BloomFilter(w.select(F.col("id").cast("string").alias("k")), "k", expected)
    doi_filter = BloomFilter(w.select(F.col("doi").alias("k")), "k", expected)
    marked = refs.withColumn("work_key", F.col("work_id").cast("string"))
    marked = doi_filter.probe(id_filter.probe(marked, "work_key", "may_work"), "doi", "may_doi")

    by_work = skew_safe_lookup(
        marked.where("may_work").select("work_key", "work_id", "ref_key", "at"), ids, "work_key"
    ).where(F.col("held").isNull())
    work_side = (
        marked.where(~F.col("may_work"))
        .select("work_id", "ref_key", "at")
        .unionByName(by_work.select("work_id", "ref_key", "at"))
        .select("work_id", "ref_key", F.lit("work_id").alias("side"), F.lit("missing").alias("reason"), "at")
    )

    by_doi = skew_safe_lookup(marked.where("may_doi").select("doi", "work_id", "ref_key", "at"), dois, "doi").withColumn(
        "reason",
        F.when(F.col("doi_held").isNull(), "missing").when(F.col("first_at") > F.col("at"), "late").when(F.col("gone_at") <= F.col("at"), "deleted"),
    )
    doi_side = (
        marked.where(~F.col("may_doi"))
        .select("work_id", "ref_key", F.lit("missing").alias("reason"), "at")
        .unionByName(by_doi.where(F.col("reason").isNotNull()).select("work_id", "ref_key", "reason", "at"))
        .select("work_id", "ref_key", F.lit("doi").alias("side"), "reason", "at")
    )
    return work_side.unionByName(doi_side).withColumn("period", F.date_format("at", "yyyy-MM")).drop("at")


def orphan_report(orphans: DataFrame, child_table: str = "work_references") -> DataFrame:
    """Orphans per table, side, reason and period."""
    return orphans.groupBy(F.lit(child_table).alias("table_name"), "side", "reason", "period").agg(F.count("*").alias("orphans"))
