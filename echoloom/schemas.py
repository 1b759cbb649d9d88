"""Declared schemas of the tables the jobs exchange. Readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

REVIEWS_LANDED = T.StructType([
    T.StructField("reviewId", T.StringType()),
    T.StructField("at", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("thumbsUpCount", T.LongType()),
    T.StructField("reviewTitle", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("reviewText", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("content", T.StringType()),
])

REVIEWS_RAW = T.StructType([
    T.StructField("source_review_id", T.LongType()),
    T.StructField("at", T.DateType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("thumbs_up", T.LongType()),
    T.StructField("review_title", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("review_text", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("content", T.StringType()),
])

REVIEWS_CLEAN = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("week_start_date", T.DateType()),
    T.StructField("week_end_date", T.DateType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("clean_text", T.StringType()),
    T.StructField("relevance", T.LongType()),
    T.StructField("source", T.StringType()),
])

CLEAN_CSV_COLUMNS = ["review_id", "date", "rating", "title", "text", "clean_text", "relevance", "source"]

PREDICTION_ITEM = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("review_theme", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reason", T.StringType()),
])

REVIEWS_CLASSIFIED = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("clean_text", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("review_theme", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reason", T.StringType()),
    T.StructField("llm_suggested_theme", T.StringType()),
    T.StructField("fallback_applied", T.BooleanType()),
])

CLASSIFIED_CSV_COLUMNS = [
    "review_id", "date", "rating", "sentiment", "title", "text", "clean_text", "review_theme",
    "confidence", "reason", "llm_suggested_theme", "fallback_applied",
]

CHUNK_RESPONSE = T.StructType([
    T.StructField("theme", T.StringType()),
    T.StructField("key_points", T.ArrayType(T.StringType())),
    T.StructField("candidate_quotes", T.ArrayType(T.StringType())),
])

THEME_SUMMARY = T.StructType([
    T.StructField("theme_rank", T.IntegerType()),
    T.StructField("theme", T.StringType()),
    T.StructField("part", T.LongType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("aggregated_key_points", T.ArrayType(T.StringType())),
    T.StructField("aggregated_candidate_quotes", T.ArrayType(T.StringType())),
])

PULSE = T.StructType([
    T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()),
    T.StructField("top_themes", T.ArrayType(T.StructType([
        T.StructField("theme", T.StringType()),
        T.StructField("summary_bullets", T.ArrayType(T.StringType())),
    ]))),
    T.StructField("quotes", T.ArrayType(T.StringType())),
    T.StructField("action_ideas", T.ArrayType(T.StringType())),
    T.StructField("note_markdown", T.StringType()),
])

STAGE_LOG = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("ended_at", T.TimestampType()),
    T.StructField("succeeded", T.BooleanType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("output", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("window_start", T.DateType()),
    T.StructField("window_end", T.DateType()),
])
