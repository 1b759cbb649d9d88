from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from echoloom.functions import dates
from echoloom.operators import clean, summaries

DAYS = [
    ("2025-11-05", dt.date(2025, 11, 5)), ("2025-1-5", dt.date(2025, 1, 5)), ("2025-11-05T10:00:00", dt.date(2025, 11, 5)),
    ("2025-13-05", None), ("2025-02-30", None), ("", None), (None, None), ("soon", None), ("12025-01-01", None),
]


def test_string_dates(spark):
    df = spark.createDataFrame([(i, d[0]) for i, d in enumerate(DAYS)], "i int, at string")
    out = df.withColumn("d", dates.event_date(F.col("at"), df.schema["at"].dataType)).orderBy("i").collect()
    assert [r.d for r in out] == [d[1] for d in DAYS]
    assert clean.filter_valid_date(df, "at").count() == 3


@pytest.mark.parametrize("kind", ["date", "timestamp", "string"])
def test_window_bounds_are_inclusive(spark, kind):
    rows = [("2025-11-02 23:59:59",), ("2025-11-03 00:00:00",), ("2025-11-09 23:59:59",), ("2025-11-10 00:00:00",), (None,)]
    df = spark.createDataFrame(rows, "at string")
    if kind != "string":
        df = df.withColumn("at", F.col("at").cast(kind))
    assert clean.filter_date_range(df, "at", "2025-11-03", dt.date(2025, 11, 9)).count() == 2
    assert clean.filter_date_range(df, "at", None, "2025-11-09").count() == 3
    assert clean.filter_date_range(df, "at").count() == 5
    with pytest.warns(UserWarning):
        assert clean.filter_date_range(df, "at", "not a day").count() == 5


def test_weeks_start_on_monday(spark):
    df = spark.sql("select explode(sequence(date'2025-11-03', date'2025-11-17')) as date")
    for r in clean.with_week(df).collect():
        assert r.week_start_date.weekday() == 0
        assert r.week_end_date - r.week_start_date == dt.timedelta(days=6)
        assert r.week_start_date <= r.date <= r.week_end_date


def test_window_length_is_checked():
    assert dates.date_window(dt.date(2025, 12, 7), 28) == (dt.date(2025, 11, 10), dt.date(2025, 12, 7))
    for days in (6, 36):
        with pytest.raises(ValueError):
            dates.date_window(dt.date(2025, 12, 7), days)


def test_empty_table_has_no_range(spark):
    row = summaries.date_range(spark.createDataFrame([], "date date")).first()
    assert (row.start_date, row.end_date, row.run_key) == (None, None, "unknown_unknown")
