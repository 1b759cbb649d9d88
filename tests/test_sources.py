from __future__ import annotations

import json

import pytest

from echoloom import schemas
from echoloom.operators import clean
from echoloom import session
from echoloom.sources import readers, writers
from workload import views

AWKWARD = ['quote " and, comma', "line\nbreak", "emoji 🙂 ’", "back\\slash", "", "  spaced  "]


def records(spark):
    rows = [(f"id{i}", None, None, None, i, t, t, t, 1, "google_play") for i, t in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, schemas.REVIEWS_CLEAN)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_json_documents_round_trip(spark, tmp_path):
    path = str(tmp_path / "docs")
    writers.write_clean_json(records(spark), path)
    back = readers.read_records_json(spark, path)
    assert as_set(back) == as_set(records(spark))


@pytest.mark.parametrize("wrapped", [True, False])
def test_one_pretty_printed_file(spark, tmp_path, wrapped):
    rows = [{"review_id": "a", "date": "2025-11-03", "text": "x\ny"}, {"review_id": "b", "rating": 4}]
    (tmp_path / "all.json").write_text(json.dumps({"records": rows} if wrapped else rows, indent=2))
    out = {r.review_id: r for r in readers.read_records_json(spark, str(tmp_path), multi_line=True).collect()}
    assert sorted(out) == ["a", "b"] and out["a"].text == "x\ny" and out["b"].rating == 4 and str(out["a"].date) == "2025-11-03"


def test_csv_round_trip_of_eight_columns(spark, tmp_path):
    path = str(tmp_path / "csv")
    writers.write_clean_csv(records(spark), path)
    back = readers.read_reviews_csv(spark, path, schemas.REVIEWS_CLEAN, schemas.CLEAN_CSV_COLUMNS)
    assert back.columns == schemas.CLEAN_CSV_COLUMNS
    texts = {r.review_id: r.text for r in back.collect()}
    assert [texts[f"id{i}"] or "" for i in range(len(AWKWARD))] == AWKWARD


def test_landed_json_in_store_names(spark, tmp_path):
    lines = [
        {"reviewId": "u1", "at": "2025-11-05T10:00:00", "score": 4, "thumbsUpCount": 2, "content": "c", "title": "t"},
        {"reviewId": "u2", "at": "bad", "thumbsUpCount": 1, "reviewText": "r"},
    ]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, lines)))
    raw = readers.read_landed_json(spark, str(tmp_path))
    out = {r.source_review_id: r for r in clean.normalize_reviews(raw).collect()}
    assert (str(out["u1"].date), out["u1"].text, out["u1"].rating) == ("2025-11-05", "c", 4)
    assert (out["u2"].date, out["u2"].text, out["u2"].rating) == (None, "r", 0)
    assert clean.normalize_reviews(raw, "2025-11-01", "2025-11-30").count() == 1


PULSES = [("2025-11-03", "2025-11-09", "first"), ("2025-11-10", "2025-11-16", "second")]


def pulses(spark, *rows):
    return spark.createDataFrame([(a, b, n) for a, b, n in rows], "a string, b string, note_markdown string").selectExpr(
        "to_date(a) AS start_date", "to_date(b) AS end_date",
        "array(named_struct('theme', 'T', 'summary_bullets', array('x'))) AS top_themes",
        "array('q') AS quotes", "cast(array() AS array<string>) AS action_ideas", "note_markdown",
    )


def test_pulse_files_and_latest_run(spark, tmp_path):
    path = str(tmp_path / "runs")
    writers.write_pulse_runs(pulses(spark, PULSES[1]), path)
    writers.write_pulse_runs(pulses(spark, PULSES[0]), path, "append")
    newest = readers.latest_run(spark, path, schemas.PULSE).first()
    assert (newest.note_markdown, newest.run_key) == ("first", "20251103_20251109")  # written last, with the smaller key
    (tmp_path / "none").mkdir()
    assert readers.latest_run(spark, str(tmp_path / "none"), schemas.PULSE).count() == 0
    single = str(tmp_path / "one")
    writers.write_pulse(pulses(spark, PULSES[0]), single)
    row = readers.read_pulse_json(spark, single).first()
    assert row.top_themes[0].summary_bullets == ["x"] and row.action_ideas == []


def test_weeks_become_folders_and_prune(spark, sf_dir, tmp_path):
    path = str(tmp_path / "weeks")
    writers.write_clean(views.reviews_clean(spark, sf_dir), path)
    assert len([p for p in (tmp_path / "weeks").iterdir() if p.name.startswith("week_start_date=")]) == 5
    one = readers.read_reviews(spark, path, schemas.REVIEWS_CLEAN).filter("week_start_date = date'2025-11-10'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(week_start_date" in plan and one.count() > 0


def test_raw_filters_reach_the_scan(spark, sf_dir, tmp_path):
    path = str(tmp_path / "raw")
    views.reviews_raw(spark, sf_dir).write.parquet(path)
    table = clean.normalize_reviews(readers.read_reviews(spark, path), "2025-11-10", "2025-12-07")
    plan = table.select("date", "rating")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(thumbs_up,0)" in plan and "GreaterThanOrEqual(at,2025-11-10)" in plan
    assert "review_text" not in plan.split("ReadSchema")[1]


def test_intermediate_tables_lie_in_one_folder_and_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    table = session.materialize(spark.range(3), "layer")
    assert table.count() == 3 and [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["echoloom"]
    session.remove_scratch(spark)
    assert list(tmp_path.iterdir()) == []
