from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from echoloom.operators import classify, clean, compare, quality, summaries

GOOD = {
    "review_id": "00000000-0000-0000-0000-00000000000{i}", "date": dt.date(2025, 11, 5), "week_start_date": dt.date(2025, 11, 3),
    "week_end_date": dt.date(2025, 11, 9), "rating": 3, "title": "t", "text": "Fine app", "clean_text": "fine app",
    "relevance": 1, "source": "google_play",
}
SCHEMA = (
    "review_id string, date date, week_start_date date, week_end_date date, rating int, title string, text string, "
    "clean_text string, relevance long, source string"
)

BAD = [
    ({"title": None}, {"required_fields"}),
    ({"rating": 0}, {"rating_range"}),
    ({"source": "web"}, {"source_constant"}),
    ({"week_end_date": dt.date(2025, 11, 10)}, {"week_span"}),
    ({"date": dt.date(2025, 11, 2)}, {"date_in_week"}),
    ({"clean_text": "Fine app"}, {"clean_lowercase"}),
    ({"clean_text": "fine app "}, {"clean_trimmed"}),
    ({"clean_text": "fine  app"}, {"clean_single_spaced"}),
    ({"clean_text": "fine app ☀"}, {"emoji_free"}),
    ({"review_id": "nope"}, {"id_is_uuid"}),
    ({"text": "call 9876543210"}, {"pii_residual"}),
    ({"review_id": GOOD["review_id"].format(i=0)}, {"id_unique"}),
    ({"date": None}, {"required_fields", "dates_valid", "date_in_week"}),
    ({"text": None}, {"required_fields", "text_present", "pii_residual"}),
]


def table(spark, *changes):
    rows = [dict(GOOD, review_id=GOOD["review_id"].format(i=i), rating=1 + i) for i in range(3)]
    for n, change in enumerate(changes):
        rows.append(dict(GOOD, review_id=GOOD["review_id"].format(i=chr(ord("a") + n)), rating=2) | change)
    return spark.createDataFrame([tuple(r[c] for c in clean.CLEAN_COLUMNS) for r in rows], SCHEMA)


def failed(verdicts):
    return {r.check for r in verdicts.collect() if not r.passed}


def test_good_rows_pass(spark):
    assert failed(quality.clean_suite(table(spark))) == set()


def test_each_seeded_fault_is_found(spark):
    for change, expected in BAD:
        assert failed(quality.clean_suite(table(spark, change))) == expected, change


def test_rating_spread(spark):
    same = table(spark).withColumn("rating", F.lit(4))
    assert failed(quality.rating_spread(same)) == {"rating_spread"}
    assert failed(quality.rating_spread(same.limit(0))) == set()


def test_all_row_checks_take_one_pass(spark):
    plan = quality.count_bad(table(spark), {
        k: v for k, v in quality.clean_checks().items() if k != "pii_residual"
    })._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def scored(spark, **change):
    base = {"review_id": "a", "rating": 1, "sentiment": "neutral", "review_theme": "KYC & Access", "confidence": 0.5,
            "fallback_applied": True}
    row = base | change
    return spark.createDataFrame(
        [tuple(base.values()), tuple(row.values())],
        "review_id string, rating int, sentiment string, review_theme string, confidence double, fallback_applied boolean",
    )


def test_classified_checks(spark):
    cases = [
        ({}, set()), ({"review_theme": "X"}, {"theme_domain"}), ({"sentiment": "odd"}, {"sentiment_domain"}),
        ({"confidence": 1.5}, {"confidence_range"}), ({"confidence": 0.0}, {"completeness"}),
        ({"sentiment": ""}, {"sentiment_domain", "completeness"}), ({"rating": None}, {"required_fields"}),
    ]
    for change, expected in cases:
        assert failed(quality.count_bad(scored(spark, **change), quality.classified_checks())) == expected, change


def test_summary_reconcile(spark):
    df = scored(spark)
    good = summaries.classification_summary(df, df)
    assert failed(quality.summary_reconcile(df, good)) == set()
    off = good.withColumns({"total_output": F.lit(9).cast("long"), "average_confidence": F.lit(0.6)})
    assert failed(quality.summary_reconcile(df, off)) == {"summary_count", "summary_mean"}


def test_missing_columns(spark):
    assert quality.missing_columns(table(spark).drop("title"), clean.CLEAN_COLUMNS) == ["title"]


def findings(df):
    return {r.finding: r.n for r in df.collect() if r.n}


def test_compare_outputs(spark):
    left = table(spark)
    assert findings(compare.compare_outputs(left, left.repartition(3))) == {"rows_left": 3, "rows_right": 3}
    changed = left.withColumn("title", F.when(F.col("rating") == 1, None).otherwise(F.col("title"))).filter("rating < 3")
    assert findings(compare.compare_outputs(left, changed)) == {
        "rows_left": 3, "rows_right": 2, "keys_left_only": 1, "differs_title": 1,
    }


def test_compare_handles_a_hot_key_without_pairing_rows(spark):
    many = spark.range(5000).select(F.lit("k").alias("review_id"), (F.col("id") % 7).alias("v"))
    same = spark.range(5000).select(F.lit("k").alias("review_id"), ((F.col("id") + 3) % 7).alias("v"))
    out = compare.compare_outputs(many, same)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert findings(out)["rows_left"] == 5000
    assert compare.schema_differences(many, same.withColumn("v", F.col("v").cast("int"))) == ["v"]


def test_full_fallback_passes_its_checks(spark):
    done = classify.full_fallback(table(spark))
    assert failed(quality.classified_suite(done, summaries.classification_summary(done, done))) == set()
