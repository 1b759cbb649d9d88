from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from echoloom.operators import clean, summaries

RAW = (
    "source_review_id long, at date, score int, thumbs_up long, review_title string, title string, "
    "review_text string, text string, content string"
)
BODY = "one two three four five six seven eight nine ten"


def day(n):
    return dt.date(2025, 11, n)


def test_normalize_takes_first_filled_value(spark):
    rows = [
        (1, day(3), 5, 1, "", "t", "", "b", "c"), (2, day(3), None, 2, "r", "t", None, "", "c"),
        (3, day(3), 1, 0, "r", "t", "a", "b", "c"), (4, day(3), 1, None, "r", "t", "a", "b", "c"),
        (5, None, 1, 1, None, None, None, None, None),
    ]
    out = {r.source_review_id: r for r in clean.normalize_reviews(spark.createDataFrame(rows, RAW)).collect()}
    assert sorted(out) == [1, 2, 5]
    assert (out[1].title, out[1].text, out[1].rating) == ("t", "b", 5)
    assert (out[2].title, out[2].text, out[2].rating) == ("r", "c", 0)
    assert (out[5].title, out[5].text, out[5].date) == ("", "", None)


def duplicates(spark):
    rows = [
        (7, day(5), 1, "x", BODY, 1), (3, day(4), 2, "y", BODY.upper(), 2), (2, day(4), 3, "z", BODY + "  ", 3),
        (9, day(3), 4, "w", BODY + " eleven", 4), (1, day(9), 5, "v", "too short", 5),
    ]
    return spark.createDataFrame(
        rows, "source_review_id long, date date, rating int, title string, text string, relevance long"
    )


def test_dedup_keeps_the_earliest_then_lowest_id(spark):
    out = clean.distinct_reviews(duplicates(spark)).orderBy("date").collect()
    assert [(r.source_review_id, r.copies) for r in out] == [(9, 1), (2, 3)]
    assert (out[1].rating, out[1].title, out[1].text) == (3, "z", BODY + "  ")


def test_dedup_does_not_depend_on_partitions(spark):
    df = duplicates(spark)
    results = {
        tuple(sorted(tuple(r) for r in clean.clean_reviews(df.repartition(n, F.rand(n))).collect())) for n in (1, 3, 7)
    }
    assert len(results) == 1


def test_dedup_never_mixes_rows_on_full_ties(spark):
    rows = [(1, day(3), r, t, x, 1) for r, t, x in ((5, "b", "One  two"), (4, "c", "one TWO"), (4, "a", "ONE two"))]
    df = spark.createDataFrame(
        rows, "source_review_id long, date date, rating int, title string, text string, relevance long"
    )
    row = clean.dedup_earliest(clean.with_clean_text(df)).first()
    assert (row.rating, row.title, row.text, row.copies) == (4, "a", "ONE two", 3)


def test_hot_text_collapses_before_the_shuffle(spark):
    """A text that makes up most of the table reaches the reducer once per map task."""
    df = spark.range(20000).select(
        F.col("id").alias("source_review_id"), F.lit(day(3)).alias("date"), F.lit(1).alias("rating"), F.lit("t").alias("title"),
        F.when(F.col("id") % 10 < 9, BODY).otherwise(F.concat(F.lit(BODY + " "), F.col("id").cast("string"))).alias("text"),
        F.lit(1).cast("long").alias("relevance"),
    )
    out = clean.clean_reviews(df)
    assert out.count() == 1 + 2000
    plan = df_plan(clean.distinct_reviews(df))
    assert plan.index("Exchange hashpartitioning") < plan.index("partial_min")


def df_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_funnel_adds_up(spark):
    df = duplicates(spark)
    row = summaries.processing_funnel(df, clean.distinct_reviews(df)).first()
    assert row.asDict() == {
        "total_input": 5, "after_min_word_filter": 4, "duplicates_removed": 2, "total_output": 2,
    }
    empty = summaries.processing_funnel(df.limit(0), clean.distinct_reviews(df.limit(0))).first()
    assert set(empty.asDict().values()) == {0}


def test_ids_are_stable_and_uuid_shaped(spark):
    a = [r.review_id for r in clean.clean_reviews(duplicates(spark)).orderBy("review_id").collect()]
    b = [r.review_id for r in clean.clean_reviews(duplicates(spark)).orderBy("review_id").collect()]
    assert a == b and all(len(i) == 36 and i.count("-") == 4 for i in a)
