"""The registered queries: each operator over the given tables, results flattened to plain columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom import config, schemas
from echoloom.functions import dates, report, text
from echoloom.operators import answers, classify, clean, compare, insight, quality, scoring, summaries
from echoloom.plans import registry, runs, weekly
from echoloom.session import materialize, scratch_path
from echoloom.sources import readers, split, writers
from echoloom.streaming import incremental, progress, stateful
from workload import views
from workload.shipping import ship_packages
from workload.views import AS_OF, FIRST_DAY, KEY, WINDOW_DAYS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

START_28, END_28 = dates.date_window(AS_OF, 28)
CLEAN_OUT = clean.CLEAN_COLUMNS
WEEK = ("week_start_date",)


def query(function: Query) -> Query:
    QUERIES[function.__name__.removeprefix("q_")] = function
    return function


def _scalar(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Register a query over the normalised reviews."""
    QUERIES[name] = lambda spark, sf: build(views.normalized(spark, sf))


def _joined(column: str, separator: str = "|"):
    return F.array_join(column, separator)


def _written_clean(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(views.reviews_clean(spark, sf), "clean")


def _written_classified(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(views.reviews_classified(spark, sf), "classified")


# --- sources and sinks ------------------------------------------------------------------------


@query
def q_scan_reviews(spark, sf):
    path = scratch_path(spark, "reviews-raw")
    views.reviews_raw(spark, sf).write.parquet(path)
    return clean.latest_reviews(readers.read_reviews(spark, path))


@query
def q_read_landed_json(spark, sf):
    """Raw reviews as a store exports them: its own names, times as text."""
    path = scratch_path(spark, "landed-json")
    views.reviews_raw(spark, sf).select(
        F.col(KEY).alias("reviewId"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "score",
        F.col("thumbs_up").alias("thumbsUpCount"), F.col("review_title").alias("reviewTitle"), "title",
        F.col("review_text").alias("reviewText"), "text", "content",
    ).write.json(path)
    return clean.normalize_reviews(readers.read_landed_json(spark, path), FIRST_DAY, AS_OF)


@query
def q_read_records_json(spark, sf):
    path = scratch_path(spark, "records-json")
    table = _written_clean(spark, sf)
    writers.write_clean_json(table.filter(F.col("rating") > 2), path)
    writers.write_report_json(table.filter(F.col("rating") <= 2), path, "append")
    return readers.read_records_json(spark, path)


@query
def q_read_split_records(spark, sf):
    """Documents of a thousand records each, read by split: record boundaries are found by depth."""
    path = scratch_path(spark, "split-records")
    writers.write_clean_json(views.reviews_clean(spark, sf), path)
    return split.read_records(spark, path, schemas.REVIEWS_CLEAN)


@query
def q_read_pulse_json(spark, sf):
    path = scratch_path(spark, "pulse-json")
    writers.write_pulse(_pulses(spark, sf), path)
    return _flat_pulse(readers.read_pulse_json(spark, path))


@query
def q_read_reviews_csv(spark, sf):
    path = scratch_path(spark, "clean-csv")
    writers.write_clean_csv(views.reviews_clean(spark, sf), path)
    table = readers.read_reviews_csv(spark, path, schemas.REVIEWS_CLEAN, schemas.CLEAN_CSV_COLUMNS)
    return table.groupBy("rating").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("text_chars"),
        F.max("clean_text").alias("last_text"), F.min("date").alias("first_date"),
    )


@query
def q_latest_run(spark, sf):
    """The run of the earliest week is written last, so the newest run has the smallest key."""
    path = scratch_path(spark, "pulse-runs")
    pulses = materialize(_pulses(spark, sf), "pulses")
    first = F.col("start_date") == pulses.agg(F.min("start_date").alias("day")).scalar()
    writers.write_pulse_runs(pulses.filter(~first), path)
    writers.write_pulse_runs(pulses.filter(first), path, "append")
    newest = readers.latest_run(spark, path, schemas.PULSE)
    return newest.select("run_key", "start_date", "end_date", "note_markdown")


@query
def q_latest_finished(spark, sf):
    """By the registry: the run of the earliest week finished last, after the others; a later one failed, one never ended."""
    base = scratch_path(spark, "registered-runs")
    pulses = materialize(_pulses(spark, sf), "pulses")
    is_first = F.col("start_date") == pulses.agg(F.min("start_date").alias("day")).scalar()
    for hour, (key, rows, succeeded) in enumerate([
        ("later-weeks", pulses.filter(~is_first), True), ("first-week", pulses.filter(is_first), True), ("all-weeks", pulses, False), ("open", pulses, None),
    ]):
        writers.write_pulse_table(rows, f"{base}/{key}")
        if succeeded is not None:
            registry.record_finish(spark, f"{base}/registry", key, dt.datetime(2025, 12, 7, hour), succeeded, f"{base}/{key}")
    return registry.latest_finished(spark, f"{base}/registry", schemas.PULSE).select("run_key", "start_date", "end_date", "note_markdown")


@query
def q_write_clean(spark, sf):
    path = scratch_path(spark, "clean-weeks")
    writers.write_clean(views.reviews_clean(spark, sf), path)
    return readers.read_reviews(spark, path, schemas.REVIEWS_CLEAN).select(*CLEAN_OUT)


@query
def q_write_clean_csv(spark, sf):
    path = scratch_path(spark, "clean-csv")
    writers.write_clean_csv(views.reviews_clean(spark, sf), path)
    return readers.read_reviews_csv(spark, path, schemas.REVIEWS_CLEAN, schemas.CLEAN_CSV_COLUMNS)


@query
def q_write_report_json(spark, sf):
    path = scratch_path(spark, "report")
    table = summaries.weekly_distribution(views.reviews_clean(spark, sf))
    writers.write_report_json(table, path)
    return spark.read.schema(table.schema).json(path)


@query
def q_write_classified(spark, sf):
    path = scratch_path(spark, "classified")
    table = _written_classified(spark, sf)
    rows = classify.project_classified(table)
    records, totals = writers.write_classified(rows, summaries.classification_summary(table, table), path)
    stored = spark.read.schema(
        "total_input long, total_output long, counts_by_theme map<string,long>, "
        "re_prompts_or_fallbacks long, average_confidence double"
    ).json(totals)
    return spark.read.schema(schemas.REVIEWS_CLASSIFIED).parquet(records).withColumn(
        "summary_total", F.lit(stored.select("total_output").scalar())
    )


@query
def q_write_classified_csv(spark, sf):
    path = scratch_path(spark, "classified-csv")
    writers.write_classified_csv(views.reviews_classified(spark, sf), path)
    return readers.read_reviews_csv(spark, path, schemas.REVIEWS_CLASSIFIED, schemas.CLASSIFIED_CSV_COLUMNS)


@query
def q_write_theme_summaries(spark, sf):
    path = scratch_path(spark, "theme-summaries")
    writers.write_theme_summaries(_summaries(spark, sf), path)
    return _flat_summary(spark.read.schema(
        "theme_rank int, theme string, part long, review_count long, aggregated_key_points array<string>, "
        "aggregated_candidate_quotes array<string>"
    ).parquet(path))


@query
def q_write_pulse(spark, sf):
    path = scratch_path(spark, "pulse-runs")
    writers.write_pulse_runs(_pulses(spark, sf), path)
    return _flat_pulse(spark.read.schema(schemas.PULSE).parquet(path))


@query
def q_write_run_summary(spark, sf):
    path = scratch_path(spark, "run-log")
    log = views.stage_log(spark, sf)
    writers.append_run_log(log.filter(F.col("stage") < "e"), path)
    writers.append_run_log(log.filter(F.col("stage") >= "e"), path)
    return _flat_runs(runs.run_summary(spark.read.schema(log.schema).parquet(path)))


@query
def q_run_key(spark, sf):
    return summaries.date_range(views.normalized(spark, sf)).select("run_key")


# --- filters and projections ------------------------------------------------------------------


@query
def q_filter_relevance(spark, sf):
    return clean.filter_relevance(views.reviews_raw(spark, sf)).select(KEY, "thumbs_up")


@query
def q_date_window(spark, sf):
    return summaries.window_counts(views.reviews_raw(spark, sf).withColumnRenamed("at", "date"), AS_OF)


@query
def q_filter_date_range(spark, sf):
    return clean.filter_date_range(views.reviews_raw(spark, sf), "at", START_28, END_28).select(KEY, "at")


def _with_string_dates(spark, sf):
    """Raw reviews whose event time is text in several shapes."""
    day, kind = F.date_format("at", "yyyy-MM-dd"), F.col(KEY) % 6
    shaped = (
        F.when(kind == 0, day).when(kind == 1, F.concat(day, F.lit("T10:11:12")))
        .when(kind == 2, "2025-1-5").when(kind == 3, "2025-13-05").when(kind == 4, "")
    )
    return views.reviews_raw(spark, sf).select(KEY, shaped.alias("at"))


@query
def q_normalize_date(spark, sf):
    raw = _with_string_dates(spark, sf)
    return raw.select(KEY, dates.event_date(F.col("at"), raw.schema["at"].dataType).alias("date"))


@query
def q_filter_valid_date(spark, sf):
    return clean.filter_valid_date(_with_string_dates(spark, sf), "at")


@query
def q_coalesce_text(spark, sf):
    return views.reviews_raw(spark, sf).select(KEY, text.first_filled("review_text", "text", "content").alias("body"))


@query
def q_coalesce_title(spark, sf):
    return views.reviews_raw(spark, sf).select(KEY, text.first_filled("review_title", "title").alias("title"))


@query
def q_cast_rating(spark, sf):
    raw = views.reviews_raw(spark, sf).withColumn("score", F.when(F.col("score") != 3, F.col("score").cast("double")))
    return raw.select(KEY, clean.cast_rating("score").alias("rating"))


@query
def q_normalize_reviews(spark, sf):
    return clean.normalize_reviews(views.reviews_raw(spark, sf), START_28, END_28)


@query
def q_filter_min_words(spark, sf):
    """Filters a written layer: on a computed text the filter would repeat the whole cleaning chain."""
    cleaned = materialize(clean.with_clean_text(views.normalized(spark, sf)), "cleaned")
    return clean.filter_min_words(cleaned).select(KEY, "n_words")


@query
def q_project_clean_schema(spark, sf):
    return views.reviews_clean(spark, sf).select(*CLEAN_OUT)


@query
def q_truncate_for_model(spark, sf):
    return views.normalized(spark, sf).select(
        KEY, text.truncate("text", config.SCORE_TEXT_CHARS).alias("for_scoring"),
        text.truncate("text", config.CHUNK_TEXT_CHARS).alias("for_chunks"),
    )


# --- string columns ---------------------------------------------------------------------------

for _rule in config.PII_RULES:
    _scalar(
        f"redact_{_rule.name}",
        lambda n, rule=_rule: n.select(KEY, text.redact("text", rule).alias("redacted")),
    )
_scalar("redact_pii", lambda n: clean.redact_column(n, "text").select(KEY, F.col("text").alias("redacted")))
_scalar("remove_emoji", lambda n: n.select(KEY, text.remove_emoji("text").alias("plain")))
_scalar("normalize_quotes", lambda n: n.select(KEY, text.normalize_quotes("text").alias("plain")))
_scalar("lowercase", lambda n: n.select(KEY, F.lower("text").alias("lowered")))
_scalar("collapse_whitespace", lambda n: n.select(KEY, text.collapse_whitespace("text").alias("collapsed")))
_scalar("correct_typos", lambda n: n.select(KEY, text.correct_typos("text").alias("corrected")))
_scalar("clean_text", lambda n: clean.with_clean_text(n).select(KEY, "clean_text"))
_scalar("word_count", lambda n: n.select(KEY, text.word_count("text").alias("n_words")))

# --- dates ------------------------------------------------------------------------------------


@query
def q_week_bounds(spark, sf):
    return clean.with_week(views.reviews_raw(spark, sf).withColumnRenamed("at", "date")).select(
        KEY, "date", "week_start_date", "week_end_date"
    )


@query
def q_compact_date(spark, sf):
    return views.reviews_raw(spark, sf).select(KEY, dates.compact_date("at").alias("compact"))


@query
def q_date_range(spark, sf):
    return summaries.date_range(views.reviews_clean(spark, sf)).select("start_date", "end_date")


@query
def q_stage_durations(spark, sf):
    return runs.stage_durations(views.stage_log(spark, sf)).select("run_id", "stage", "seconds")


# --- dedup, order, limits ---------------------------------------------------------------------


@query
def q_dedup_earliest(spark, sf):
    cleaned = clean.with_clean_text(views.normalized(spark, sf))
    return clean.dedup_earliest(cleaned).select(KEY, "date", "rating", "clean_text", "copies")


@query
def q_dedup_late(spark, sf):
    """The same rows by numbers first and texts second."""
    cleaned = clean.with_clean_text(views.normalized(spark, sf))
    return clean.dedup_late(cleaned).select(KEY, "date", "rating", "clean_text", "copies")


@query
def q_surrogate_id(spark, sf):
    return views.reviews_clean(spark, sf).select("review_id", KEY)


@query
def q_sort_by_date(spark, sf):
    return clean.sort_by_date(views.reviews_clean(spark, sf)).select("date", "review_id", "rating")


@query
def q_sample_records(spark, sf):
    return clean.sample_records(views.reviews_clean(spark, sf)).select(*CLEAN_OUT)


@query
def q_top_themes(spark, sf):
    return insight.top_themes(views.reviews_classified(spark, sf))


@query
def q_top_themes_weekly(spark, sf):
    return insight.top_themes(views.reviews_classified(spark, sf), period=WEEK)


@query
def q_top_quotes(spark, sf):
    return insight.top_quotes(_chunk_results(spark, sf))


@query
def q_report_top3(spark, sf):
    pulses = insight.report_top3(_pulses(spark, sf))
    return pulses.select(*WEEK, _joined("quotes").alias("quotes"), _joined("action_ideas").alias("action_ideas"))


# --- aggregations -----------------------------------------------------------------------------


@query
def q_processing_funnel(spark, sf):
    rows = views.normalized(spark, sf)
    return summaries.processing_funnel(rows, clean.distinct_reviews(rows))


@query
def q_skip_counts(spark, sf):
    return summaries.skip_counts(views.reviews_raw(spark, sf), START_28, END_28)


@query
def q_rating_distribution(spark, sf):
    return summaries.rating_distribution(views.reviews_clean(spark, sf))


@query
def q_rating_share(spark, sf):
    return summaries.rating_share(views.reviews_clean(spark, sf))


@query
def q_weekly_distribution(spark, sf):
    return summaries.weekly_distribution(views.reviews_clean(spark, sf))


@query
def q_group_by_theme(spark, sf):
    counts = summaries.group_by_theme(views.reviews_classified(spark, sf))
    return counts.select(
        "theme", "review_count", F.col("first_seen.date").alias("first_date"),
        F.col("first_seen.review_id").alias("first_id"),
    )


@query
def q_theme_counts(spark, sf):
    return summaries.theme_counts(views.reviews_classified(spark, sf))


@query
def q_classification_summary(spark, sf):
    table = _written_classified(spark, sf)
    counts = F.transform(
        F.map_entries("counts_by_theme"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return summaries.classification_summary(table, table).withColumn("counts_by_theme", F.array_join(counts, ";"))


@query
def q_fallback_by_theme(spark, sf):
    return summaries.fallback_by_theme(views.reviews_classified(spark, sf))


@query
def q_theme_share(spark, sf):
    return summaries.theme_share(views.reviews_classified(spark, sf))


@query
def q_sentiment_distribution(spark, sf):
    return summaries.sentiment_distribution(views.reviews_classified(spark, sf))


@query
def q_confidence_stats(spark, sf):
    return summaries.confidence_stats(views.reviews_classified(spark, sf))


@query
def q_pii_tag_counts(spark, sf):
    return summaries.pii_tag_counts(views.reviews_clean(spark, sf))


@query
def q_keyword_hits(spark, sf):
    return summaries.keyword_hits(views.reviews_clean(spark, sf))


# --- joins ------------------------------------------------------------------------------------


@query
def q_merge_predictions(spark, sf):
    merged = classify.merge_predictions(views.reviews_clean(spark, sf), views.predictions(spark, sf), KEY)
    return merged.select(
        KEY, "date", "model_review_theme", "model_sentiment", "model_confidence", "model_reason", "model_answered"
    )


@query
def q_merge_layers(spark, sf):
    """The same from layers bucketed by key: the join moves no row."""
    path = scratch_path(spark, "merge-layers")
    reviews, predictions = views.reviews_clean(spark, sf).drop("text", "title"), views.predictions(spark, sf)
    classify.write_merge_layers(reviews, predictions, path, KEY, buckets=8)
    side = predictions.select(KEY, *classify.PREDICTION_FIELDS).schema
    return classify.merge_layers(spark, path, reviews.schema, side, KEY, buckets=8).select(
        KEY, "date", "model_review_theme", "model_sentiment", "model_confidence", "model_reason", "model_answered"
    )


@query
def q_enrich_join(spark, sf):
    """Every prediction with its clean review; predictions of dropped reviews get defaults."""
    answers = views.predictions(spark, sf).select(KEY, "review_theme", "confidence")
    return classify.enrich_join(answers, views.reviews_clean(spark, sf), KEY, unique=True)


@query
def q_compare_outputs(spark, sf):
    """The clean layer against its predecessor with some rows missing, altered and added."""
    table = _written_clean(spark, sf)
    stars = F.when(F.col(KEY) % 7 == 0, F.col("rating") + 1).otherwise(F.col("rating"))
    name = F.when(F.col(KEY) % 11 == 0, F.lit(None)).otherwise(F.col("title"))
    older = table.filter(F.col("relevance") > 1).withColumns({"rating": stars.cast("int"), "title": name})
    newer = table.filter(F.col("relevance") < 3)
    return compare.compare_outputs(newer.select(*CLEAN_OUT), older.select(*CLEAN_OUT))


@query
def q_compare_columns(spark, sf):
    """The clean layer against a copy that lacks a column, has one too many, and keeps stars as text."""
    table = _written_clean(spark, sf).select(*CLEAN_OUT)
    other = table.drop("title").withColumn("rating", F.col("rating").cast("string")).withColumn("more", F.lit(1))
    return compare.compare_outputs(table, other, columns=["date", "title", "text", "clean_text", "source"])


# --- classification ---------------------------------------------------------------------------


@query
def q_theme_taxonomy(spark, sf):
    return summaries.taxonomy_table(views.reviews_clean(spark, sf))


@query
def q_classify_keywords(spark, sf):
    table = classify.classify_keywords(views.reviews_clean(spark, sf))
    return table.select("review_id", "review_theme", "confidence", "reason")


@query
def q_batch_reviews(spark, sf):
    batched = scoring.batch_reviews(_written_clean(spark, sf))
    return batched.select("review_id", "batch_id", F.col("ord").cast("long").alias("ord"))


@query
def q_build_prompt(spark, sf):
    return scoring.build_prompts(scoring.batch_reviews(_written_clean(spark, sf)))


#: Prompts that a worker's stub has been asked before.
_ASKED: set[str] = set()


def _stub_model(prompt: str) -> str:
    """Stands in for a model: judges by the prompt's length. Every fifth length is never answered; of the rest every
    third is answered badly the first time it is asked, and well the second."""
    import json

    items = json.loads(prompt[prompt.index("["):])
    if len(prompt) % 5 == 0:
        return "no idea"
    if len(prompt) % 3 == 0 and prompt not in _ASKED:
        _ASKED.add(prompt)
        return "[{ wait"
    names = list(config.THEME_KEYWORDS)
    answer = [
        {
            "review_id": item["review_id"], "review_theme": names[len(item["text"]) % len(names)],
            "sentiment": config.SENTIMENTS[len(item["text"]) % 3], "confidence": (len(item["text"]) % 10) / 10,
            "reason": "length",
        }
        for item in items
    ]
    return "Here it is: " + json.dumps(answer[::-1])


@query
def q_score_batches(spark, sf):
    ship_packages(spark)
    prompts = scoring.build_prompts(scoring.batch_reviews(_written_clean(spark, sf)))
    scored = scoring.score_batches(prompts, _stub_model)
    return scored.select("batch_id", "n_reviews", F.col("response").isNotNull().alias("answered"))


@query
def q_score_kept(spark, sf):
    """Two runs over one store: the first never hears of half the prompts, the second asks for those alone."""
    ship_packages(spark)
    store = scratch_path(spark, "answers")
    prompts = materialize(scoring.build_prompts(scoring.batch_reviews(_written_clean(spark, sf))), "prompts")
    answers.answer_prompts(prompts.filter(F.col("batch_id") % 2 == 0), _stub_model, store, parts=2)
    kept = answers.answer_prompts(prompts, _stub_model, store, parts=2)
    return kept.select("batch_id", "n_reviews", F.col("response").isNotNull().alias("answered"))


@query
def q_score_retry(spark, sf):
    """Reviews left to the keywords because their batch failed for good."""
    ship_packages(spark)
    table = _written_clean(spark, sf)
    predicted = scoring.score_reviews(table, _stub_model)
    classified = classify.classify_reviews(table, predicted)
    return classified.groupBy("fallback_applied").agg(F.count(F.lit(1)).alias("n"))


@query
def q_parse_response(spark, sf):
    """Answers with prose around them, broken, or without JSON; one per document."""
    docs = views.documents(spark, sf)
    item = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("review_id"), F.col("lang").alias("review_theme"),
        F.col("source").alias("sentiment"), ((F.col("doc_id") % 10) / 10).alias("confidence"),
        F.col("text").alias("reason"),
    ))
    kind = F.col("doc_id") % 4
    answer = (
        F.when(kind == 0, F.concat(F.lit("Sure: ["), item, F.lit("] done")))
        .when(kind == 1, F.concat(F.lit("["), item, F.lit("]")))
        .when(kind == 2, F.concat(F.lit("["), item)).otherwise(F.lit("no answer"))
    )
    return scoring.parse_predictions(docs.select(answer.alias("response")))


@query
def q_validate_predictions(spark, sf):
    merged = classify.merge_predictions(views.reviews_clean(spark, sf), views.predictions(spark, sf), KEY)
    return classify.validate_predictions(merged).select(
        "review_id", "review_theme", "sentiment", "confidence", "llm_suggested_theme", "fallback_applied"
    )


@query
def q_full_fallback(spark, sf):
    return classify.full_fallback(views.reviews_clean(spark, sf)).select(
        "review_id", "review_theme", "sentiment", "confidence", "reason", "llm_suggested_theme", "fallback_applied"
    )


@query
def q_classify_reviews(spark, sf):
    return classify.project_classified(views.reviews_classified(spark, sf))


# --- insight ----------------------------------------------------------------------------------


def _chunks(spark, sf, period=()):
    table = _written_classified(spark, sf)
    top = insight.top_themes(table, period=period)
    return insight.chunk_reviews(insight.select_themes(table, top, period), period=period), top


def _chunk_results(spark, sf):
    chunked, _ = _chunks(spark, sf)
    return insight.summarize_chunks_builtin(chunked)


def _summaries(spark, sf):
    chunked, top = _chunks(spark, sf)
    return insight.theme_summary(top, materialize(insight.summarize_chunks_builtin(chunked), "chunk-results"))


def _pulses(spark, sf):
    table = _written_classified(spark, sf)
    return insight.generate_pulse(table, WEEK, layer=materialize, actions=_week_actions(table))


def _week_actions(table: DataFrame) -> DataFrame:
    """An action for each of the week's largest themes, in their order, as a user's model might return them."""
    top = insight.top_themes(table, period=WEEK)
    idea = F.struct("theme_rank", F.concat(F.lit("Look into "), "theme").alias("idea"))
    ideas = F.transform(F.sort_array(F.collect_list(idea)), lambda x: x["idea"])
    return top.groupBy(*WEEK).agg(ideas.alias("action_ideas"))


def _flat_summary(table: DataFrame) -> DataFrame:
    return table.select(
        "theme_rank", "theme", "part", "review_count",
        _joined("aggregated_key_points").alias("key_points"), _joined("aggregated_candidate_quotes").alias("quotes"),
    )


def _flat_pulse(table: DataFrame) -> DataFrame:
    entries = F.transform(
        "top_themes", lambda t: F.concat(t["theme"], F.lit("="), F.array_join(t["summary_bullets"], ","))
    )
    return table.select(
        "start_date", "end_date", F.array_join(entries, ";").alias("themes"), _joined("quotes").alias("quotes"),
        _joined("action_ideas").alias("action_ideas"), "note_markdown",
    )


@query
def q_chunk_reviews(spark, sf):
    chunked = insight.chunk_reviews(_written_classified(spark, sf))
    return chunked.select("theme", "chunk_id", F.col("ord").cast("long").alias("ord"), "review_id")


@query
def q_chunk_text(spark, sf):
    return insight.chunk_text(insight.chunk_reviews(_written_classified(spark, sf)))


@query
def q_map_summarize(spark, sf):
    return _chunk_results(spark, sf).select(
        "theme", "chunk_id", _joined("key_points").alias("key_points"), _joined("candidate_quotes").alias("quotes")
    )


def _stub_summary(prompt: str) -> str:
    """Stands in for a model: the number of lines as key point, the first line as quote."""
    import json

    if len(prompt) % 4 == 0:
        return "sorry"
    lines = prompt.split("\n")
    answer = {"key_points": [f"{len(lines)} lines"], "candidate_quotes": [lines[0][2:]]}
    return "Result: " + json.dumps(answer) + " done"


@query
def q_parse_object_response(spark, sf):
    ship_packages(spark)
    texts = insight.chunk_text(insight.chunk_reviews(_written_classified(spark, sf)))
    results = insight.summarize_chunks(texts, _stub_summary)
    return results.select(
        "theme", "chunk_id", _joined("key_points").alias("key_points"), _joined("candidate_quotes").alias("quotes")
    )


@query
def q_collect_key_points(spark, sf):
    points = insight.collect_key_points(_chunk_results(spark, sf))
    return points.select("theme", "chunk_id", F.col("pos").cast("long").alias("pos"), "key_point")


@query
def q_theme_summary(spark, sf):
    return _flat_summary(_summaries(spark, sf))


@query
def q_reduce_pulse(spark, sf):
    return _flat_pulse(insight.generate_pulse(_written_classified(spark, sf), layer=materialize))


@query
def q_pulse_note(spark, sf):
    return _pulses(spark, sf).select(*WEEK, "note_markdown")


@query
def q_note_word_limit(spark, sf):
    return insight.note_word_limit(_pulses(spark, sf)).select(*WEEK, "note_words", "within_limit")


@query
def q_generate_pulse(spark, sf):
    return _flat_pulse(_pulses(spark, sf))


# --- report columns ---------------------------------------------------------------------------


@query
def q_pulse_counts(spark, sf):
    return insight.pulse_counts(_pulses(spark, sf)).select(*WEEK, "n_themes", "n_quotes", "n_actions")


@query
def q_priority_signal(spark, sf):
    top = insight.top_themes(views.reviews_classified(spark, sf), period=WEEK)
    return top.select(*WEEK, "theme", report.priority_signal(F.col("theme_rank")).alias("priority_signal"))


def _actions(spark, sf):
    """Action items made of the clean reviews: a third names a timeline, in changing spelling."""
    kind = F.col(KEY) % 4
    target = (
        F.when(kind == 0, " - Next 2 Sprints").when(kind == 1, " within 3 WEEKS").when(kind == 2, " - 1 sprint, soon")
        .otherwise("")
    )
    return views.reviews_clean(spark, sf).select(KEY, F.concat("clean_text", target).alias("action"))


@query
def q_action_timeline(spark, sf):
    return _actions(spark, sf).select(
        KEY, report.action_timeline(F.col("action")).alias("timeline"),
        report.action_without_timeline(F.col("action")).alias("action"),
    )


@query
def q_bullet_category(spark, sf):
    tagged = views.reviews_clean(spark, sf).select(
        "review_id", report.bullet_category(F.col("clean_text")).alias("category")
    )
    return tagged


# --- data quality -----------------------------------------------------------------------------


def _row_checks(spark, sf, *names):
    checks = quality.clean_checks()
    table = views.reviews_unchecked(spark, sf)
    if "pii_residual" in names:
        table = quality.with_redacted_again(table)
    return quality.count_bad(table, {n: checks[n] for n in names})


def _model_rows(spark, sf):
    """Predictions as they come, in the classified schema."""
    raw = views.predictions(spark, sf)
    return raw.select(
        F.col(KEY).cast("string").alias("review_id"), F.lit(1).alias("rating"), "sentiment", "review_theme",
        (F.col("confidence") * F.when(F.col(KEY) % 10 == 0, 2.0).otherwise(1.0)).alias("confidence"),
        F.lit(False).alias("fallback_applied"),
    )


def _model_checks(spark, sf, *names):
    checks = quality.classified_checks()
    return quality.count_bad(_model_rows(spark, sf), {n: checks[n] for n in names})




def _required(clean_layer: DataFrame, classified: DataFrame) -> DataFrame:
    rows = quality.required_fields(
        clean_layer, schemas.REVIEWS_CLEAN, CLEAN_OUT, quality.clean_checks()["required_fields"]
    ).withColumn("layer", F.lit("clean"))
    return rows.unionByName(quality.required_fields(
        classified, schemas.REVIEWS_CLASSIFIED, quality.CLASSIFIED_REQUIRED, quality.classified_checks()["required_fields"]
    ).withColumn("layer", F.lit("classified")))


@query
def q_dq_required_fields(spark, sf):
    return _required(views.reviews_unchecked(spark, sf), _model_rows(spark, sf))


@query
def q_dq_absent_columns(spark, sf):
    """The same over tables of which one lacks a column and the other has one too many."""
    return _required(
        views.reviews_unchecked(spark, sf).drop("relevance"), _model_rows(spark, sf).drop("rating").withColumn("more", F.lit(1))
    )


QUERIES["dq_rating_source"] = lambda spark, sf: _row_checks(spark, sf, "rating_range", "source_constant")
QUERIES["dq_dates"] = lambda spark, sf: _row_checks(spark, sf, "dates_valid", "week_span", "date_in_week")
QUERIES["dq_text"] = lambda spark, sf: _row_checks(
    spark, sf, "text_present", "clean_lowercase", "clean_trimmed", "clean_single_spaced"
)
QUERIES["dq_emoji_free"] = lambda spark, sf: _row_checks(spark, sf, "emoji_free")
QUERIES["dq_pii_residual"] = lambda spark, sf: _row_checks(spark, sf, "pii_residual")
QUERIES["dq_theme_domain"] = lambda spark, sf: _model_checks(spark, sf, "theme_domain")
QUERIES["dq_sentiment_domain"] = lambda spark, sf: _model_checks(spark, sf, "sentiment_domain")
QUERIES["dq_confidence_range"] = lambda spark, sf: _model_checks(spark, sf, "confidence_range")
QUERIES["dq_completeness"] = lambda spark, sf: _model_checks(spark, sf, "completeness")


@query
def q_dq_unique_ids(spark, sf):
    table = views.reviews_unchecked(spark, sf)
    return quality.count_bad(table, {"id_is_uuid": quality.clean_checks()["id_is_uuid"]}).unionByName(
        quality.unique_ids(table)
    )


@query
def q_dq_rating_spread(spark, sf):
    return quality.rating_spread(views.reviews_clean(spark, sf))


@query
def q_dq_summary_reconcile(spark, sf):
    """The classified layer against the summary of an older state, which lacks two-helpful-vote rows."""
    table = _written_classified(spark, sf)
    older = table.filter(F.col("relevance") != 2)
    return quality.summary_reconcile(table, summaries.classification_summary(older, older))


@query
def q_dq_suite(spark, sf):
    table = _written_classified(spark, sf)
    return quality.dq_suite(table, table, summaries.classification_summary(table, table))


# --- streams ----------------------------------------------------------------------------------


def _landed_stream(spark, sf):
    docs = incremental.stream_files(
        spark, f"{sf}/documents.parquet", spark.read.schema(views.DOCUMENTS).parquet(f"{sf}/documents.parquet").schema
    )
    return clean.normalize_reviews(views.as_reviews(docs), FIRST_DAY, AS_OF)


def _stream_clean_schema(spark, sf):
    return clean.dedup_earliest(clean.with_clean_text(views.normalized(spark, sf))).schema


@query
def q_incremental_clean(spark, sf):
    path = scratch_path(spark, "stream-clean")
    incremental.incremental_clean(
        _landed_stream(spark, sf), path, scratch_path(spark, "stream-clean-checkpoint")
    ).awaitTermination()
    table = spark.read.schema(_stream_clean_schema(spark, sf)).parquet(path)
    return table.select(KEY, "date", "rating", "text", "clean_text", "n_words", "copies")


@query
def q_stream_dedup(spark, sf):
    """The same files land twice, with a run after each: the second one goes on from the state of the first."""
    ship_packages(spark)
    landed, path, checkpoint = (scratch_path(spark, f"stream-dedup-{name}") for name in ("landed", "corrections", "checkpoint"))
    schema = None
    for _ in range(2):
        views.documents(spark, sf).write.mode("append").parquet(landed)
        docs = incremental.stream_files(spark, landed, views.documents(spark, sf).schema)
        stream = clean.normalize_reviews(views.as_reviews(docs), FIRST_DAY, AS_OF)
        schema = incremental.clean_stream(stream).schema
        stateful.run_stateful_dedup(stream, path, checkpoint).awaitTermination()
    return stateful.read_corrected(spark, path, schema).select(KEY, "date", "clean_text", "copies")


@query
def q_stream_compact(spark, sf):
    """A run, a compaction, and a second run over the same files that appends to the compacted table."""
    path, into = scratch_path(spark, "stream-runs"), scratch_path(spark, "stream-compact")
    schema = _stream_clean_schema(spark, sf)
    incremental.incremental_clean(
        _landed_stream(spark, sf), path, scratch_path(spark, "stream-compact-first")
    ).awaitTermination()
    incremental.compact(spark, path, schema, into)
    incremental.incremental_clean(
        _landed_stream(spark, sf), into, scratch_path(spark, "stream-compact-second")
    ).awaitTermination()
    return incremental.read_deduplicated(spark, into, schema).select(KEY, "date", "clean_text", "copies")


@query
def q_stream_weekly_counts(spark, sf):
    path = scratch_path(spark, "stream-weeks")
    schema = views.events(spark, sf).schema
    stream = incremental.stream_files(spark, f"{sf}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    incremental.run_weekly_counts(
        stream, "event_type", path, scratch_path(spark, "stream-weeks-checkpoint")
    ).awaitTermination()
    return incremental.read_weekly_counts(spark, path, "event_type")


@query
def q_stream_late_rows(spark, sf):
    """The last seven days land first, the rest after them: weeks that ended ten days before the newest row are too late."""
    base = scratch_path(spark, "stream-late")
    table = views.events(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    recent = F.coalesce(F.col("ts") >= table.agg(F.max("ts") - F.expr("interval 7 days")).scalar(), F.lit(False))
    for rows in (table.filter(recent), table.filter(~recent)):
        rows.write.mode("append").parquet(f"{base}/landed")
        stream = incremental.stream_files(spark, f"{base}/landed", table.schema, files_per_trigger=1_000_000)
        progress.run_logged_counts(stream, "event_type", f"{base}/weeks", f"{base}/checkpoint", f"{base}/log", lateness="10 days")
    return progress.late_rows(spark, f"{base}/log", f"{base}/weeks", "event_type").drop("groups_late")


# --- runs -------------------------------------------------------------------------------------


def _flat_runs(table: DataFrame) -> DataFrame:
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias(c)
    return table.select(
        "run_id", "status", "failed_stage", "n_stages", "run_start", "run_end", "seconds", flat("outputs"), flat("details"),
        "window_start", "window_end",
    )


@query
def q_run_summary(spark, sf):
    return _flat_runs(runs.run_summary(views.stage_log(spark, sf)))


@query
def q_weekly_pulse(spark, sf):
    pulses = weekly.weekly_pulse(
        views.reviews_raw(spark, sf), views.predictions(spark, sf), AS_OF, WINDOW_DAYS, actions=_week_actions
    )
    return _flat_pulse(pulses)
