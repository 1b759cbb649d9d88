"""Plans the jobs must keep: no repeated regex chain, no Python, no single-task windows over rows."""

from __future__ import annotations

import datetime as dt

import pytest

from echoloom import schemas
from echoloom.operators import clean, insight, quality
from echoloom.plans import runs, weekly
from echoloom.session import materialize
from workload import views
from workload.queries import QUERIES

CHAIN = 17  # six PII rules, emoji, whitespace, nine typos


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clean_chain_appears_once(spark, sf_dir):
    assert physical(views.reviews_clean(spark, sf_dir)).count("regexp_replace(") == CHAIN
    assert physical(views.reviews_classified(spark, sf_dir)).count("regexp_replace(") == CHAIN


@pytest.mark.parametrize("name", ["theme_counts", "sentiment_distribution", "weekly_distribution", "processing_funnel"])
def test_counts_do_not_repeat_the_chain(spark, sf_dir, name):
    assert physical(QUERIES[name](spark, sf_dir)).count("regexp_replace(") == CHAIN


@pytest.mark.parametrize("name", ["theme_counts", "top_themes", "keyword_hits", "classify_reviews"])
def test_keyword_search_appears_once(spark, sf_dir, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", "2000")
    plan = physical(QUERIES[name](spark, sf_dir))
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count(", fibonacci)") == 1


def test_counting_jobs_do_not_shuffle_texts(spark, sf_dir):
    plan = physical(QUERIES["weekly_distribution"](spark, sf_dir))
    aggregate = next(line for line in plan.splitlines() if "partial_min(struct(date" in line)
    assert "partial_min_by(text" not in aggregate and "partial_min(clean_text" not in aggregate


def test_native_operators_use_no_python(spark, sf_dir):
    for name in ("classify_reviews", "theme_taxonomy", "keyword_hits", "dq_pii_residual", "action_timeline"):
        plan = physical(QUERIES[name](spark, sf_dir))
        assert "Python" not in plan and "MapInPandas" not in plan, name


def test_quotes_use_a_group_limit(spark):
    rows = spark.createDataFrame(
        [("t", 0, [], ["a"])], "theme string, chunk_id long, key_points array<string>, candidate_quotes array<string>"
    )
    assert "WindowGroupLimit" in physical(insight.top_quotes(rows))


def test_report_of_the_cleaning_stage(spark, sf_dir):
    report = weekly.processing_report(views.normalized(spark, sf_dir))
    funnel = report["funnel"].first()
    assert funnel.total_output == sum(r.n for r in report["weeks"].collect()) == sum(r.n for r in report["ratings"].collect())
    assert funnel.after_min_word_filter - funnel.duplicates_removed == funnel.total_output
    assert report["examples"].count() == 3


def test_run_weekly_leaves_its_layers_and_log(spark, sf_dir, tmp_path):
    base = str(tmp_path / "runs")
    pulses = weekly.run_weekly(
        spark, views.reviews_raw(spark, sf_dir), views.predictions(spark, sf_dir), views.AS_OF, base, "r1", 35, views.KEY
    )
    assert pulses.count() == 5
    log = spark.read.schema(schemas.STAGE_LOG).parquet(f"{base}/run_log")
    assert {r.stage: r.n_rows for r in log.collect()}["clean"] == views.reviews_clean(spark, sf_dir).count()
    row = runs.run_summary(log).first()
    assert (row.status, row.failed_stage, row.n_stages) == ("success", None, 3) and row.seconds > 0
    assert {r.check for r in quality.clean_suite(
        spark.read.parquet(f"{base}/clean/run_id=r1")
    ).filter("NOT passed").collect()} == set()


def test_failed_stage_is_logged_and_stops_the_run(spark, sf_dir, tmp_path):
    base = str(tmp_path / "runs")
    with pytest.raises(Exception):
        weekly.run_weekly(
            spark, views.reviews_raw(spark, sf_dir), views.predictions(spark, sf_dir).drop("confidence"), views.AS_OF, base,
            "r2", 35, views.KEY,
        )
    row = runs.run_summary(spark.read.schema(schemas.STAGE_LOG).parquet(f"{base}/run_log")).first()
    assert (row.status, row.failed_stage, row.n_stages) == ("error", "classify", 2)


def test_durations(spark):
    t = dt.datetime(2025, 12, 6, 17, 19, 2)
    log = spark.createDataFrame(
        [("r", "a", t, t + dt.timedelta(seconds=9.5), True, 1, "", "", None, None),
         ("r", "b", t + dt.timedelta(seconds=10), t + dt.timedelta(seconds=20), False, 1, "out/b", "why", t.date(), t.date())], schemas.STAGE_LOG
    )
    assert [r.seconds for r in runs.stage_durations(log).orderBy("stage").collect()] == [9.5, 10.0]
    row = runs.run_summary(log).first()
    assert (row.seconds, row.status, row.failed_stage) == (20.0, "error", "b")
    assert (row.outputs, row.details, row.window_start) == ({"b": "out/b"}, {"b": "why"}, t.date())


def test_written_layer_keeps_rows_and_order_of_columns(spark, sf_dir):
    table = clean.normalize_reviews(views.reviews_raw(spark, sf_dir))
    stored = materialize(table, "layer", ("rating",))
    assert stored.columns == table.columns and stored.exceptAll(table).count() == 0 == table.exceptAll(stored).count()
