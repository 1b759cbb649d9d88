"""Keyed state across triggers: corrections, restarts, and the end of a text's state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from echoloom.operators import clean
from echoloom.streaming import incremental, stateful

BODY = "one two three four five six seven eight nine ten"
SCHEMA = "source_review_id long, date date, rating int, title string, text string, relevance long"


class Runs:
    """A landing folder and one checkpoint that every run goes on from."""

    def __init__(self, spark, folder):
        self.spark = spark
        self.landed, self.path, self.checkpoint = (str(folder / n) for n in ("in", "out", "checkpoint"))
        self.schema = spark.createDataFrame([], SCHEMA).schema

    def land(self, rows):
        """(identifier, day counted from 2025-11-01, text)."""
        data = [(i, dt.date(2025, 11, 1) + dt.timedelta(days=d), 5, None, text, 1) for i, d, text in rows]
        self.spark.createDataFrame(data, self.schema).coalesce(1).write.mode("append").parquet(self.landed)

    def run(self):
        stream = incremental.stream_files(self.spark, self.landed, self.schema)
        query = stateful.run_stateful_dedup(stream, self.path, self.checkpoint)
        query.awaitTermination()
        self.progress = query.recentProgress
        return self.table()

    def table(self):
        cleaned = incremental.clean_stream(self.spark.createDataFrame([], self.schema))
        return stateful.read_corrected(self.spark, self.path, cleaned.schema)

    def found(self):
        return sorted((r.source_review_id, str(r.date), r.copies) for r in self.run().collect())


def test_an_earlier_copy_that_lands_late_wins(spark, tmp_path):
    runs = Runs(spark, tmp_path)
    runs.land([(5, 7, BODY), (6, 8, BODY), (7, 8, BODY + " a"), (8, 8, "short")])
    assert runs.found() == [(5, "2025-11-08", 2), (7, "2025-11-09", 1)]
    runs.land([(9, 3, BODY.upper()), (10, 9, BODY + " b"), (11, 9, BODY + " a"), (4, 7, "x " + BODY)])
    assert runs.found() == [(4, "2025-11-08", 1), (7, "2025-11-09", 2), (9, "2025-11-04", 3), (10, "2025-11-10", 1)]
    # A run without news changes nothing, and no later copy takes the place of an earlier one.
    assert len(runs.found()) == 4
    runs.land([(12, 20, BODY), (1, 3, BODY)])
    assert (1, "2025-11-04", 5) in runs.found()
    batch = clean.distinct_reviews(spark.read.schema(SCHEMA).parquet(runs.landed))
    columns = [*incremental.clean_stream(spark.createDataFrame([], SCHEMA)).columns, "copies"]
    assert {tuple(r) for r in runs.table().select(*columns).collect()} == {tuple(r) for r in batch.select(*columns).collect()}


def test_only_news_is_written(spark, tmp_path):
    runs = Runs(spark, tmp_path)
    runs.land([(i, 5, f"{BODY} {i}") for i in range(50)])
    runs.run()
    runs.land([(100, 6, BODY + " 1"), (101, 6, BODY + " 1"), (102, 6, BODY + " 2")])
    runs.run()
    stored = spark.read.parquet(runs.path)
    last = stored.filter(F.col("batch_id") == stored.agg(F.max(F.when(F.col("copies") > 1, F.col("batch_id")))).first()[0])
    assert sorted((r.copies, r.wins) for r in last.collect()) == [(2, False), (3, False)]


def test_state_ends_with_the_watermark(spark, tmp_path):
    runs = Runs(spark, tmp_path)
    runs.land([(1, 0, BODY), (2, 30, BODY + " a")])
    runs.run()
    runs.land([(3, 60, BODY + " b")])  # the watermark passes day 0 and stops at day 25
    runs.run()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in runs.progress if p["stateOperators"]]
    assert left[-1] == 2
    # Day 10 is dropped; day 61 begins a new generation of the first text; the second one is still known.
    runs.land([(4, 10, BODY + " c"), (5, 61, BODY), (6, 31, BODY + " a")])
    assert runs.found() == [(1, "2025-11-01", 1), (2, "2025-12-01", 2), (3, "2025-12-31", 1), (5, "2026-01-01", 1)]


def test_identifiers_sort_as_values(spark):
    rows = spark.createDataFrame([(None,), (-(2**63),), (-5,), (0,), (7,), (10,), (2**63 - 1,)], "v long")
    ranked = rows.select("v", stateful.sort_text(F.col("v"), rows.schema["v"].dataType).alias("t")).orderBy("t")
    assert [r.v for r in ranked.collect()] == [None, -(2**63), -5, 0, 7, 10, 2**63 - 1]


def test_a_text_in_every_second_row(spark, tmp_path):
    """Copies collapse before the shuffle: the state sees few rows of a text however often it lands."""
    runs = Runs(spark, tmp_path)
    runs.land([(i, 5, BODY if i % 2 else f"{BODY} {i}") for i in range(4000)])
    assert runs.run().filter("copies > 1").select("copies").collect()[0][0] == 2000
    rows = [p["sources"][0]["numInputRows"] for p in runs.progress]
    assert max(rows) == 4000 and runs.progress[0]["stateOperators"][0]["numRowsUpdated"] == 2001


def test_texts_of_one_bucket_end_one_by_one(spark, tmp_path, monkeypatch):
    """All texts share one bucket and its timer; each still ends by its own latest copy, and the state holds a row for each."""
    monkeypatch.setattr(stateful, "BUCKETS", 1)
    runs = Runs(spark, tmp_path)
    runs.land([(1, 0, BODY), (2, 10, BODY + " a"), (3, 30, BODY + " b"), (6, 10, BODY + " c")])
    runs.run()
    assert runs.progress[0]["stateOperators"][0]["numRowsUpdated"] == 4
    runs.land([(4, 50, BODY + " d"), (5, 50, BODY + " c")])  # the watermark passes day 0, then stops at day 15
    runs.run()
    assert [p["stateOperators"][0]["numRowsTotal"] for p in runs.progress if p["stateOperators"]][-1] == 3
    runs.land([(7, 51, BODY), (8, 51, BODY + " a"), (9, 51, BODY + " b"), (10, 51, BODY + " c")])
    found = [(1, 0, 1), (2, 10, 1), (3, 30, 2), (4, 50, 1), (6, 10, 3), (7, 51, 1), (8, 51, 1)]
    first = dt.date(2025, 11, 1)
    assert runs.found() == [(i, str(first + dt.timedelta(days=d)), n) for i, d, n in found]
