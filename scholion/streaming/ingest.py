"""Streams: container files that arrive over time, late events, and per-key state."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_files(spark: SparkSession, folder: str, pattern: str = "*.gz", per_trigger: int = 100) -> DataFrame:
    """A stream of the paths of files that arrive in a folder; contents are left to the batch that reads them."""
    stream = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger)
    return stream.schema("path string, modificationTime timestamp, length bigint, content binary").load(folder).select("path", "modificationTime", "length")


def populate_on_arrival(spark: SparkSession, source: Callable, folder: str, database: str, checkpoint: str, columns=None, condition: str | None = None, pattern: str = "*.gz"):
    """Populates a database with each batch of container files that arrives: one folder ``<table>/batch=N`` a batch.

    A batch that is run again after a failure replaces its own folders, so every record is there once.
    ``source`` makes a source of container files from (session, folder); it is given the batch's files, with container ids of
    batch number and place in the batch, so that ids are never used twice, in whatever order files arrive.
    """

    def run(batch: DataFrame, number: int) -> None:
        # paths of at most maxFilesPerTrigger files
        paths = sorted(unquote(urlparse(r.path).path) for r in batch.select("path").collect())
        if not paths:
            return
        chosen = source(spark, folder)
        chosen.numbering = {p: (number << 20) | i for i, p in enumerate(paths)}
        for table, frame in chosen.selected(columns, condition).items():
            frame.write.mode("overwrite").parquet(os.path.join(database, table, f"batch={number}"))

    return new_files(spark, folder, pattern).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window and type; events later than ``late`` behind the newest are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_deliveries(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once, by its first delivery, while copies arrive within ``late``."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_totals(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Per key and batch: number and sum of its events so far, kept as state."""

    def step(keys: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n += len(pdf)
            total += float(pdf["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, n long, total double", "n long, total double", "update", "NoTimeout")
