from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from echoloom.functions import report
from echoloom.operators import insight, order, scoring

EXEC, UI = "Execution & Performance", "UI & Feature Gaps"


def classified(spark, counts, day=dt.date(2025, 11, 3)):
    rows = []
    for t, (theme, n) in enumerate(counts.items()):
        for i in range(n):
            rows.append((f"{(i * 7919 + t) % 65536:04x}-{t}-{i}", day + dt.timedelta(days=i % 3), theme, f"order lag {t} {i}", i % 4))
    return spark.createDataFrame(
        rows, "review_id string, date date, review_theme string, clean_text string, relevance long"
    ).withColumn("week_start_date", F.date_trunc("week", "date").cast("date"))


def test_positions_are_exact(spark):
    df = classified(spark, {"a": 57, "b": 3})
    expected = {}
    for theme in ("a", "b"):
        ids = [r.review_id for r in df.filter(F.col("review_theme") == theme).orderBy("date", "review_id").collect()]
        expected.update({i: n for n, i in enumerate(ids)})
    out = order.with_position(df.repartition(5), ["review_theme"]).collect()
    assert {r.review_id: r.position for r in out} == expected


def test_positions_follow_any_identifier(spark):
    """Numbers, a common prefix, one group with nine tenths of the rows, nulls in every key."""
    day = dt.date(2025, 11, 3)
    rows = [(i, f"user_{i:05d}", "big" if i % 10 else "small", day) for i in (2, 4, 9, 10, 100, 30000, *range(200, 900))]
    df = spark.createDataFrame(rows, "number long, name string, theme string, date date").repartition(6)
    for key in ("number", "name"):
        for theme in ("big", "small"):
            ordered = sorted(r[0] for r in rows if r[2] == theme)
            out = order.with_position(df, ["theme"], identifier=key).filter(F.col("theme") == theme).collect()
            assert {r.number: r.position for r in out} == {n: place for place, n in enumerate(ordered)}
    odd = spark.createDataFrame(
        [(1, None, "a"), (None, day, "a"), (2, day, "a"), (3, day, None)], "review_id long, date date, theme string"
    )
    assert sorted(r.position for r in order.with_position(odd, ["theme"]).collect()) == [0, 0, 1, 2]
    assert sorted(r.position for r in order.with_position(odd).collect()) == [0, 1, 2, 3]


def test_chunks_hold_their_size(spark):
    out = insight.chunk_reviews(classified(spark, {EXEC: 45, UI: 20}))
    sizes = {(r.theme, r.chunk_id): r["count"] for r in out.groupBy("theme", "chunk_id").count().collect()}
    assert sizes == {(EXEC, 0): 20, (EXEC, 1): 20, (EXEC, 2): 5, (UI, 0): 20}


def test_no_window_over_rows(spark):
    """Only one row per group and range is windowed, also where there are no groups."""
    for table in (insight.chunk_reviews(classified(spark, {EXEC: 5})), scoring.batch_reviews(classified(spark, {EXEC: 5}))):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number()" not in plan
        window = next(line for line in plan.splitlines() if "Window [" in line)
        assert "sum(_n" in window


def test_top_themes_break_ties_by_first_appearance(spark):
    df = classified(spark, {"late": 2}, dt.date(2025, 11, 10)).unionByName(
        classified(spark, {"early": 2}, dt.date(2025, 11, 3))
    ).unionByName(classified(spark, {"big": 5, "small": 1}))
    top = insight.top_themes(df).orderBy("theme_rank").collect()
    assert [(r.theme, r.review_count) for r in top] == [("big", 5), ("early", 2), ("late", 2)]


def test_missing_theme_is_unknown(spark):
    df = classified(spark, {"a": 1}).withColumn("review_theme", F.lit(None).cast("string"))
    assert insight.top_themes(df).first().theme == "Unknown"


def results(spark, rows):
    return spark.createDataFrame(
        rows, "theme string, chunk_id long, key_points array<string>, candidate_quotes array<string>"
    )


def test_quotes_are_distinct_in_order_of_first_occurrence(spark):
    table = results(spark, [("t", 1, [], ["b", "c", "d"]), ("t", 0, [], ["a", "b", "a"]), ("u", 0, [], [])])
    assert [r.quote for r in insight.top_quotes(table).orderBy("rank").collect()] == ["a", "b", "c", "d"]
    assert [r.quote for r in insight.top_quotes(table, 2).orderBy("rank").collect()] == ["a", "b"]


def test_key_points_keep_repetitions_and_split_into_parts(spark):
    table = results(spark, [("t", i, [f"p{i}", "same"], []) for i in range(5)])
    points = insight.collect_key_points(table)
    assert points.count() == 10
    whole = insight.key_point_parts(points).collect()
    assert len(whole) == 1
    expected = [x for i in range(5) for x in (f"p{i}", "same")]
    assert whole[0].aggregated_key_points == expected
    parts = insight.key_point_parts(points, chunks_per_part=2).orderBy("part").collect()
    assert [len(p.aggregated_key_points) for p in parts] == [4, 4, 2]
    assert [x for p in parts for x in p.aggregated_key_points] == expected


def test_builtin_summary_of_a_chunk(spark):
    df = classified(spark, {EXEC: 3}).withColumn(
        "clean_text", F.element_at(F.array(F.lit("lag order"), F.lit("lag"), F.lit("crash lag")), F.col("relevance").cast("int") + 1)
    )
    row = insight.summarize_chunks_builtin(insight.chunk_reviews(df)).first()
    assert row.key_points == ["lag", "order", "crash"]
    assert row.candidate_quotes == ["crash lag", "lag", "lag order"]


def test_model_summary_skips_failed_chunks(spark):
    texts = insight.chunk_text(insight.chunk_reviews(classified(spark, {EXEC: 45})))

    def model(prompt):
        import json

        lines = prompt.split("\n")
        if len(lines) < 20:
            return "not json"
        return "x " + json.dumps({"theme": "t", "key_points": [str(len(lines))], "candidate_quotes": None}) + " y"

    out = insight.summarize_chunks(texts, model).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.key_points, r.candidate_quotes) for r in out] == [(0, ["20"], []), (1, ["20"], [])]


def test_pulse_per_week_and_overall(spark):
    df = classified(spark, {EXEC: 30, UI: 12}).unionByName(classified(spark, {UI: 4}, dt.date(2025, 11, 10)))
    weeks = insight.generate_pulse(df, ["week_start_date"]).orderBy("week_start_date").collect()
    assert [[t.theme for t in w.top_themes] for w in weeks] == [[EXEC, UI], [UI]]
    assert weeks[0].note_markdown.startswith("# Weekly App Review Pulse (2025-11-03–2025-11-05)\n\n## Top Themes\n*   **")
    assert weeks[0].action_ideas == []
    overall = insight.generate_pulse(df).first()
    assert (overall.start_date, overall.end_date) == (dt.date(2025, 11, 3), dt.date(2025, 11, 12))
    counts = insight.pulse_counts(insight.generate_pulse(df)).first()
    assert (counts.n_themes, counts.n_quotes, counts.n_actions) == (2, 2, 0)


def test_note_limit(spark):
    df = spark.createDataFrame([("a " * 250,), ("a " * 251,)], "note_markdown string")
    assert [r.within_limit for r in insight.note_word_limit(df).orderBy("note_words").collect()] == [True, False]


ACTIONS = [
    ("Fix crashes - Next 2 Sprints", "Next 2 Sprints", "Fix crashes"),
    ("Within 3 weeks review fees", "Within 3 weeks", "review fees"),
    ("ship it in 1 SPRINT now", "1 SPRINT", "ship it in now"),
    ("no target", None, "no target"),
    ("a - 2 sprints, b - 2 sprints", "2 sprints", "a, b"),
]
BULLETS = [
    ("App CRASH and UI", "defect"), ("a bug", "defect"), ("new feature", "feature"), ("quick", "feature"),
    ("speedy", "performance"), ("users", "experience"), ("misc", "general"),
]


def test_report_columns(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ACTIONS)], "i int, a string")
    out = df.select("i", report.action_timeline(F.col("a")).alias("t"), report.action_without_timeline(F.col("a")).alias("r"))
    assert [(r.t, r.r) for r in out.orderBy("i").collect()] == [a[1:] for a in ACTIONS]
    df = spark.createDataFrame([(i, b[0]) for i, b in enumerate(BULLETS)], "i int, b string")
    got = df.select("i", report.bullet_category(F.col("b")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [b[1] for b in BULLETS]


def test_object_answers(spark):
    rows = [('a {"key_points":["x"]} b', 1), ("{broken", 2), ("none", 3)]
    df = spark.createDataFrame(rows, "response string, chunk_id long")
    out = scoring.parse_chunk_answers(df).collect()
    assert [(r.chunk_id, r.key_points, r.candidate_quotes) for r in out] == [(1, ["x"], [])]
