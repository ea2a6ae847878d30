import os
import shutil

import fixtures as fx
from scholion.sources.all import Crossref
from scholion.streaming import ingest


def test_populate_on_arrival(spark, tmp_path, rows):
    folder, later = fx.crossref(str(tmp_path / "in")), str(tmp_path / "later.gz")
    shutil.move(os.path.join(folder, "1.json.gz"), later)
    args = (spark, Crossref, folder, str(tmp_path / "db"), str(tmp_path / "cp"), ["works.doi", "work_authors.family"], "works.published_year > 0")
    ingest.populate_on_arrival(*args).awaitTermination()
    read = lambda t: rows(spark.read.parquet(str(tmp_path / "db" / t)).drop("batch"))
    assert read("works") == [("10.9000/a",)]
    shutil.move(later, os.path.join(folder, "1.json.gz"))
    ingest.populate_on_arrival(*args).awaitTermination()
    assert read("works") == [("10.9000/a",), ("10.9000/c",)] and read("work_authors") == [("Brown",), ("Green",), ("Green",)]


def test_ids_stay_apart_when_files_arrive_out_of_order(spark, tmp_path, rows):
    folder, later = fx.crossref(str(tmp_path / "in")), str(tmp_path / "later.gz")
    shutil.move(os.path.join(folder, "0.json.gz"), later)  # the file that sorts first comes last
    args = (spark, Crossref, folder, str(tmp_path / "db"), str(tmp_path / "cp"), ["works.id", "works.doi", "work_authors.work_id", "work_authors.family"])
    ingest.populate_on_arrival(*args).awaitTermination()
    shutil.move(later, os.path.join(folder, "0.json.gz"))
    ingest.populate_on_arrival(*args).awaitTermination()
    works, authors = (spark.read.parquet(str(tmp_path / "db" / t)) for t in ("works", "work_authors"))
    assert works.select("id").distinct().count() == 3
    assert rows(works.join(authors, works.id == authors.work_id).select("doi", "family")) == [("10.9000/a", "Brown"), ("10.9000/a", "Green"), ("10.9000/c", "Green")]


def _run(spark, frame, name, mode):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _events(spark, tmp_path, n=3):
    path = str(tmp_path / "events")
    for k in range(n):
        spark.sql(f"SELECT timestamp_ntz '2024-01-01 0{k}:10:00' AS ts, id AS event_id, id % 2 AS user_id, 'a' AS event_type, 1.5D AS value FROM range(4)").write.mode("append").parquet(path)
    return spark.readStream.schema("ts timestamp_ntz, event_id long, user_id long, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(path)


def test_windowed_counts(spark, tmp_path):
    got = _run(spark, ingest.windowed_counts(_events(spark, tmp_path)), "w", "complete")
    assert sorted((str(r.start)[11:13], r.n, r.total) for r in got.collect()) == [(f"0{k}", 4, 6.0) for k in range(3)]


def test_first_deliveries(spark, tmp_path):
    assert _run(spark, ingest.first_deliveries(_events(spark, tmp_path), "event_id"), "f", "append").count() == 4


def test_running_totals(spark, tmp_path):
    got = _run(spark, ingest.running_totals(_events(spark, tmp_path)), "r", "update")
    last = {}
    for r in got.collect():
        last[r.user_id] = max(last.get(r.user_id, 0), r.n)
    assert last == {0: 6, 1: 6}
