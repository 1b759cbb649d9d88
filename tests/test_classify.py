from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from echoloom import config
from echoloom.config import Taxonomy
from echoloom.operators import classify, scoring, summaries
from echoloom.sources import buckets

UI, EXEC, KYC = "UI & Feature Gaps", "Execution & Performance", "KYC & Access"


def reviews(spark, *texts):
    return spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "review_id string, clean_text string")


@pytest.mark.parametrize("text,theme,word", [
    ("my order and refund", EXEC, "order"),
    ("refund please, order", EXEC, "order"),
    ("delay", EXEC, "delay"),
    ("refund only", "Payments & Withdrawals", "refund"),
    ("company", KYC, "pan"),
    ("quick", UI, "ui"),
    ("app lag", EXEC, "lag"),
    ("ORDER", EXEC, "order"),
])
def test_keywords(spark, text, theme, word):
    row = classify.classify_keywords(reviews(spark, text)).first()
    assert (row.review_theme, row.reason, row.confidence) == (theme, f"fallback keyword: {word}", 0.45)


def test_no_keyword_gives_the_default(spark):
    for row in classify.classify_keywords(reviews(spark, "xyz", "", None)).collect():
        assert (row.review_theme, row.reason) == (UI, "fallback default: no keywords matched")


def test_word_boundary_is_an_option(spark):
    rows = classify.classify_keywords(reviews(spark, "company", "my pan card", "f&o x", "app lag"), word_boundary=True)
    assert [r.reason.split(": ")[1] for r in rows.orderBy("review_id").collect()] == [
        "no keywords matched", "pan", "f&o", "lag",
    ]


CASES = [
    # theme, confidence, sentiment -> theme, confidence, sentiment, suggested, fallback
    (UI, 0.9, "positive", UI, 0.9, "positive", None, False),
    (UI, 0.4, "odd", UI, 0.4, "odd", None, False),
    (UI, 0.39, "negative", EXEC, 0.45, "negative", UI, True),
    ("Other", 0.9, None, EXEC, 0.9, "neutral", None, True),
    ("Other", 0.42, "positive", EXEC, 0.45, "positive", None, True),
    ("Other", 0.1, "positive", EXEC, 0.45, "positive", None, True),
    (None, 0.8, "positive", EXEC, 0.8, "positive", None, True),
    ("", 0.8, "positive", EXEC, 0.8, "positive", None, True),
    (KYC, None, "positive", EXEC, 0.45, "positive", KYC, True),
]


def test_validation_table(spark):
    texts = reviews(spark, *["order"] * len(CASES))
    answers = spark.createDataFrame(
        [(f"r{i}", c[0], c[2], c[1], "why") for i, c in enumerate(CASES)],
        "review_id string, review_theme string, sentiment string, confidence double, reason string",
    )
    rows = {r.review_id: r for r in classify.classify_reviews(texts, answers).collect()}
    for i, case in enumerate(CASES):
        r = rows[f"r{i}"]
        assert (r.review_theme, r.confidence, r.sentiment, r.llm_suggested_theme, r.fallback_applied) == case[3:], case
        assert r.reason == ("fallback keyword: order" if r.fallback_applied else "why")


def test_missing_surplus_and_repeated_predictions(spark):
    answers = spark.createDataFrame(
        [("r9", UI, "positive", 0.9, "x"), ("r1", UI, "positive", 0.5, "low"), ("r1", KYC, "negative", 0.8, "high")],
        "review_id string, review_theme string, sentiment string, confidence double, reason string",
    )
    out = {r.review_id: r for r in classify.classify_reviews(reviews(spark, "order", "zzz"), answers).collect()}
    assert sorted(out) == ["r0", "r1"]
    assert (out["r0"].review_theme, out["r0"].sentiment, out["r0"].fallback_applied) == (EXEC, "neutral", True)
    assert (out["r1"].review_theme, out["r1"].reason) == (KYC, "high")


def test_enrich_defaults_and_latest_row(spark):
    cls = spark.createDataFrame([("a", UI), ("b", UI)], "review_id string, review_theme string")
    src = spark.createDataFrame(
        [("a", "2025-11-03", 1, "old"), ("a", "2025-11-04", 2, "new")],
        "review_id string, date string, rating int, title string",
    ).withColumn("date", F.to_date("date"))
    out = {r.review_id: r for r in classify.enrich_join(cls, src).collect()}
    assert (out["a"].rating, out["a"].title) == (2, "new")
    assert (out["b"].rating, out["b"].title, out["b"].date) == (0, "", None)


def test_own_taxonomy(spark):
    mine = Taxonomy.of({"Cats": ["cat"], "Dogs": ["dog"]}, "Dogs")
    rows = classify.full_fallback(reviews(spark, "a dog", "cat dog", "bird"), taxonomy=mine).orderBy("review_id").collect()
    assert [r.review_theme for r in rows] == ["Dogs", "Cats", "Dogs"]


def test_summary_of_nothing(spark):
    empty = classify.full_fallback(reviews(spark)).limit(0)
    row = summaries.classification_summary(empty, empty).first()
    assert (row.total_input, row.total_output, row.re_prompts_or_fallbacks, row.average_confidence) == (0, 0, 0, 0.0)
    assert row.counts_by_theme == {t: 0 for t in config.TAXONOMY.names}


# --- the model hook ---------------------------------------------------------------------------


def test_retry_rules():
    waits = []
    ok = scoring.holds_json("[", "]")

    def script(*answers):
        queue = list(answers)

        def model(prompt):
            answer = queue.pop(0)
            if isinstance(answer, Exception):
                raise answer
            return answer

        return model

    assert scoring.ask(script("bad", "[1]"), "p", ok, sleep=waits.append) == "[1]" and waits == []
    late = TimeoutError()
    assert scoring.ask(script(late, late, "[2]"), "p", ok, sleep=waits.append) == "[2]" and waits == [1.0, 2.0]
    assert scoring.ask(script(late, late, late), "p", ok, sleep=waits.append) is None
    assert scoring.ask(script("[", "x", "]["), "p", ok, sleep=waits.append) is None
    with pytest.raises(KeyError):
        scoring.ask(script(KeyError("quota")), "p", ok)


RESPONSES = [
    ('Sure:\n[{"review_id":"a","review_theme":"T","confidence":0.5}] bye', ["a"]),
    ("no json", []), ('[{"review_id":"b"', []), ("[]", []), (None, []),
    ('[{"review_id":"c"},{"review_id":"d"},{"x":1}]', ["c", "d"]),
]


def test_parse_responses(spark):
    for response, ids in RESPONSES:
        df = spark.createDataFrame([(response,)], "response string")
        assert sorted(r.review_id for r in scoring.parse_predictions(df).collect()) == ids


def test_scoring_round_trip(spark):
    """Reordered, short and surplus answers, and a batch that fails for good."""
    rows = [(f"r{i:02d}", "2025-11-03", "skip" if i == 3 else "break" if i == 25 else f"text {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "review_id string, date string, clean_text string").withColumn("date", F.to_date("date"))
    predicted = scoring.score_reviews(df, make_model())
    out = {r.review_id: r for r in classify.classify_reviews(df, predicted).collect()}
    assert len(out) == 30
    assert all(out[f"r{i:02d}"].review_theme == KYC and not out[f"r{i:02d}"].fallback_applied for i in range(20) if i != 3)
    assert out["r03"].fallback_applied and all(out[f"r{i}"].fallback_applied for i in range(20, 30))


def make_model():
    """A nested function is pickled whole; workers cannot import this test module."""
    kyc = KYC

    def model(prompt):
        import json

        items = json.loads(prompt[prompt.index("["):prompt.rindex("]") + 1])
        if any(item["text"] == "break" for item in items):
            return "cannot do that"
        answer = [
            {"review_id": i["review_id"], "review_theme": kyc, "sentiment": "positive", "confidence": 0.9, "reason": "m"}
            for i in items if i["text"] != "skip"
        ]
        return json.dumps(answer[::-1] + [{"review_id": "ghost", "review_theme": kyc, "confidence": 1.0}])

    return model


def test_bucketed_layers_join_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "layers")
    reviews = spark.createDataFrame([(i % 40 if i % 5 else None, f"text {i}") for i in range(60)], "id int, clean_text string")
    answers = spark.createDataFrame(
        [(i % 30, "UI & Feature Gaps", "neutral", i / 100, "r") for i in range(60)] + [(None, "X", "neutral", 0.9, "r")],
        "id int, review_theme string, sentiment string, confidence double, reason string",
    )
    for _ in range(2):  # the second writing replaces the first
        classify.write_merge_layers(reviews, answers, path, "id", 4)
    merged = classify.merge_layers(spark, path, reviews.schema, answers.schema, "id", 4)
    direct = classify.merge_predictions(reviews, answers, "id")
    assert sorted(map(repr, merged.select(direct.columns).collect())) == sorted(map(repr, direct.collect()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        again = classify.merge_layers(spark, path, reviews.schema, answers.schema, "id", 4)
        plan = again._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        keyed = [buckets.read_keyed(spark, f"{path}/{name}", table.schema, "id", 4) for name, table in [("predictions", answers), ("reviews", reviews)]]
        enriched = classify.enrich_join(*keyed, "id", unique=True)
        assert "Exchange" not in enriched._jdf.queryExecution().executedPlan().toString()
        enriched = classify.enrich_join(*keyed, "id")  # several rows of a key: aggregated where they lie
        assert "Exchange" not in enriched._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
