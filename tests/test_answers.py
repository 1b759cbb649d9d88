"""Kept answers, the registry of runs, and deduplication by numbers."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from echoloom import schemas
from echoloom.operators import answers, clean, scoring
from echoloom.plans import registry, weekly
from workload import views


def asked(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def logging_model(folder, broken=()):
    """Writes down every prompt that it is asked; some it cannot answer yet, some end the job."""
    path = str(folder)

    def model(prompt):
        import uuid
        from pathlib import Path

        if prompt in broken:
            raise ValueError("the model is gone")
        (Path(path) / uuid.uuid4().hex).write_text(prompt)
        return "no" if prompt == "p7" else f'["{prompt}"]'

    return model


def test_a_broken_run_asks_each_answered_prompt_once(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    prompts = spark.createDataFrame([(i, f"p{i % 20}") for i in range(25)], "batch_id long, prompt string")
    by_part = prompts.select("prompt", F.pmod(F.xxhash64(F.sha2("prompt", 256)), F.lit(4)).alias("part")).distinct()
    last = by_part.filter("part = 3 AND prompt <> 'p7'").first()["prompt"]
    with pytest.raises(Exception, match="the model is gone"):
        answers.answer_prompts(prompts, logging_model(log, broken=(last,)), store, max_retries=0, parts=4)
    committed = {r.prompt for r in by_part.filter("part < 3").collect()} - {"p7"}
    found = answers.answer_prompts(prompts, logging_model(log), store, max_retries=0, parts=4)
    assert found.columns == ["batch_id", "prompt", "response"] and found.count() == 25
    assert {r.prompt for r in found.filter("response IS NULL").collect()} == {"p7"}
    seen = asked(log)
    assert all(seen.count(p) == 1 for p in committed)
    before = len(seen)
    answers.answer_prompts(prompts, logging_model(log), store, max_retries=0, parts=4).collect()
    assert asked(log)[before:] == ["p7"] or sorted(asked(log)).count("p7") >= 2
    assert len(asked(log)) == before + 1


def test_deeply_nested_answers_are_refused(spark):
    assert not scoring.holds_json("[", "]")("[" * 200_000 + "]" * 200_000)
    assert scoring.holds_json("[", "]")("well: [1, 2] so")


def test_registry_names_the_newest_good_run(spark, sf_dir, tmp_path):
    base, at = str(tmp_path / "runs"), dt.datetime(2025, 12, 7, 9)
    clock = iter(at + dt.timedelta(minutes=i) for i in range(1000))
    run = lambda name, predictions: weekly.run_weekly(
        spark, views.reviews_raw(spark, sf_dir), predictions, views.AS_OF, base, name, 35, views.KEY, clock=lambda: next(clock)
    )
    registry.record_finish(spark, f"{base}/registry", "never", at, False)
    assert registry.newest_run(spark, f"{base}/registry") is None
    assert registry.latest_finished(spark, f"{base}/registry", schemas.PULSE).count() == 0
    run("b", views.predictions(spark, sf_dir))
    with pytest.raises(Exception):
        run("c", views.predictions(spark, sf_dir).drop("confidence"))
    newest = registry.newest_run(spark, f"{base}/registry")
    assert newest.run_key == "b" and newest.output.endswith("pulses/run_id=b")
    assert registry.read_registry(spark, f"{base}/registry").filter("NOT succeeded").count() == 2
    registry.record_finish(spark, f"{base}/registry", "d", newest.finished_at, True, "x")
    assert registry.newest_run(spark, f"{base}/registry").run_key == "d"


ROWS = "source_review_id long, date date, rating int, title string, text string, relevance long, clean_text string, n_words long"


def test_late_fetch_gives_the_same_rows(spark, monkeypatch):
    """Ties, null identifiers, negative ones, and both ways of fetching the winners."""
    day = dt.date(2025, 11, 3)
    rows = [(i if i % 9 else None, day - dt.timedelta(days=i % 4), i % 3, "t", f"raw {i % 5} {i}", 1, f"text {i % 17}", 2) for i in range(-60, 240)]
    rows += [(2**63 - 1, day, 1, None, "x", 1, "one", 1), (-(2**63), day, 2, None, "y", 1, "one", 1), (3, dt.date(9999, 12, 31), 1, "", "z", 1, "far", 1)]
    rows += [(4, day, 1, "t", "same", 1, "twice", 1)] * 2
    df = spark.createDataFrame(rows, ROWS)
    ordered = lambda t: sorted(map(repr, t.select(*sorted(t.columns)).collect()))
    unique = df.dropDuplicates(["clean_text", "date", "source_review_id"])
    assert ordered(clean.dedup_late(unique)) == ordered(clean.dedup_earliest(unique))
    first = {(r.clean_text, str(r.date), r.source_review_id, r.copies) for r in clean.dedup_earliest(df).collect()}
    assert {(r.clean_text, str(r.date), r.source_review_id, r.copies) for r in clean.dedup_late(df).collect()} == first
    assert ordered(clean.dedup_late(df)) == ordered(clean.dedup_late(df.repartition(7)))
    monkeypatch.setattr(clean, "BROADCAST_ROWS", 0)
    assert ordered(clean.dedup_late(unique)) == ordered(clean.dedup_earliest(unique))
    named = df.withColumn("source_review_id", F.col("source_review_id").cast("string")).filter("source_review_id IS NOT NULL")
    assert clean.dedup_late(named).count() == clean.dedup_earliest(named).count()


@pytest.mark.parametrize(("limit", "join"), [(1_000_000, "BroadcastHashJoin"), (0, "ShuffledHashJoin")])
def test_late_fetch_sorts_and_shuffles_no_copies(spark, sf_dir, monkeypatch, limit, join):
    monkeypatch.setattr(clean, "BROADCAST_ROWS", limit)
    late = clean.dedup_late(clean.with_clean_text(views.normalized(spark, sf_dir)))
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort " not in plan and join in plan
