from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from echoloom.operators import clean
from echoloom.streaming import incremental, progress
from workload.queries import QUERIES

BODY = "one two three four five six seven eight nine ten"
SCHEMA = "source_review_id long, date date, rating int, title string, text string, relevance long"


def land(spark, folder, rows, day_of=lambda d: dt.date(2025, 11, d)):
    data = [(i, day_of(d), 5, "t", text, 1) for i, d, text in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run_clean(spark, folder, out, checkpoint):
    stream = incremental.stream_files(spark, folder, spark.createDataFrame([], SCHEMA).schema)
    incremental.incremental_clean(stream, out, checkpoint).awaitTermination()


def test_restart_reads_only_new_files_and_equals_the_batch_job(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    first = [(5, 7, BODY), (6, 8, BODY), (7, 8, BODY + " a"), (8, 8, "short")]
    second = [(9, 3, BODY.upper()), (10, 9, BODY + " b"), (11, 9, BODY + " a")]
    land(spark, folder, first)
    run_clean(spark, folder, out, checkpoint)
    land(spark, folder, second)
    run_clean(spark, folder, out, checkpoint)
    run_clean(spark, folder, out, checkpoint)
    batch = clean.distinct_reviews(spark.read.schema(SCHEMA).parquet(folder))
    stored = incremental.read_deduplicated(spark, out, batch.schema)
    assert {tuple(r) for r in stored.collect()} == {tuple(r) for r in batch.collect()}
    kept = {r.clean_text: (r.source_review_id, r.copies) for r in stored.collect()}
    assert kept == {BODY: (9, 3), BODY + " a": (7, 2), BODY + " b": (10, 1)}
    per_run = spark.read.parquet(out).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in per_run) == [2, 3]


EVENTS = "ts timestamp, theme string, event_id long"


def events(spark, folder, rows):
    data = [(dt.datetime(2024, m, d, 12), theme, i) for m, d, theme, i in rows]
    spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_weekly_counts_accept_late_rows_until_the_watermark(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = spark.createDataFrame([], EVENTS).schema

    def run():
        stream = incremental.stream_files(spark, folder, schema)
        incremental.run_weekly_counts(stream, "theme", out, checkpoint).awaitTermination()
        table = incremental.read_weekly_counts(spark, out, "theme")
        return {(str(r.week_start_date), str(r.week_end_date), r.theme): r.n for r in table.collect()}

    events(spark, folder, [(1, 1, "a", 1), (1, 7, "a", 2), (1, 8, "b", 3)])
    assert run() == {("2024-01-01", "2024-01-07", "a"): 2, ("2024-01-08", "2024-01-14", "b"): 1}
    events(spark, folder, [(1, 2, "a", 4), (2, 20, "a", 5)])  # late by a week, still counted
    assert run()[("2024-01-01", "2024-01-07", "a")] == 3
    events(spark, folder, [(1, 3, "a", 6), (2, 21, "a", 7)])  # beyond 35 days, its week is closed
    after = run()
    assert after[("2024-01-01", "2024-01-07", "a")] == 3 and after[("2024-02-19", "2024-02-25", "a")] == 2


def test_batch_twin(spark, tmp_path):
    folder = str(tmp_path / "in")
    events(spark, folder, [(1, 1, "a", 1), (1, 7, "a", 2), (1, 8, "b", 3)])
    out = incremental.weekly_counts_batch(spark.read.schema(EVENTS).parquet(folder), "theme")
    assert {(str(r.week_start_date), r.theme, r.n) for r in out.collect()} == {("2024-01-01", "a", 2), ("2024-01-08", "b", 1)}


def test_repeats_within_the_watermark_keep_the_first_arrival(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = spark.createDataFrame([], EVENTS).schema

    def run():
        stream = incremental.drop_repeats(incremental.stream_files(spark, folder, schema), ["theme"])
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(
            availableNow=True
        ).start().awaitTermination()
        return sorted(r.event_id for r in spark.read.parquet(out).select(F.col("event_id")).collect())

    events(spark, folder, [(1, 9, "a", 1), (1, 9, "b", 2)])
    assert run() == [1, 2]
    events(spark, folder, [(1, 2, "a", 3), (1, 10, "c", 4)])
    assert run() == [1, 2, 4]


TABLES = ("incremental_clean", "stream_dedup", "stream_weekly_counts")


@pytest.mark.parametrize("name", TABLES)
def test_tables_of_several_files_stream_like_one(spark, sf_dir, tmp_path, name):
    for table in ("documents", "events"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    parts = {repr(r) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert parts == {repr(r) for r in QUERIES[name](spark, sf_dir).collect()} and parts


@pytest.mark.parametrize("name", TABLES)
def test_a_stream_without_rows_leaves_an_empty_table(spark, sf_dir, tmp_path, name):
    for table in ("documents", "events"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_late_rows_are_logged_and_add_up(spark, tmp_path):
    folder, out, checkpoint, log = (str(tmp_path / n) for n in ("in", "out", "checkpoint", "log"))
    schema = spark.createDataFrame([], EVENTS).schema

    def run():
        stream = incremental.stream_files(spark, folder, schema)
        progress.run_logged_counts(stream, "theme", out, checkpoint, log)
        return progress.late_rows(spark, log, out, "theme").first().asDict()

    events(spark, folder, [(6, 3, "a", 1), (6, 4, "a", 2), (6, 5, "b", 3)])
    assert run() == {"rows_read": 3, "rows_undated": 0, "rows_counted": 3, "rows_late": 0, "groups_late": 0}
    events(spark, folder, [(4, 1, "a", 4), (4, 2, "a", 5), (3, 1, "b", 6), (5, 15, "a", 7)])  # three beyond 35 days, one within
    spark.createDataFrame([(None, "a", 8)], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    second = run()
    assert {k: second[k] for k in ("rows_read", "rows_undated", "rows_counted", "rows_late")} == {
        "rows_read": 8, "rows_undated": 1, "rows_counted": 4, "rows_late": 3,
    }
    assert second["groups_late"] == 2  # two of the late rows share a week and a theme
    assert run() == second  # nothing landed, nothing is counted twice
    batches = progress.read_progress(spark, log).filter("rows_read > 0").orderBy("batch_id").collect()
    assert [b.rows_read for b in batches] == [3, 5] and batches[-1].watermark.startswith("2024-05-01") and batches[0].state_rows == 2
