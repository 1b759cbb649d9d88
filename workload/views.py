"""The given tables seen as review tables, in Spark. ``oracle.py`` holds the same in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.operators import classify, clean

AS_OF = dt.date(2025, 12, 7)
WINDOW_DAYS = 35
FIRST_DAY = dt.date(2025, 11, 3)
KEY = "source_review_id"

TAILS = {
    0: " app freeze while order pending",
    1: " refund money not reflected, call +919876543210",
    2: " hidden brokerage, mail me.x@mail.example.com",
    3: " kyc renew fails for ABCDE1234F",
    4: " gud but sucks",
    5: " user_name2024 says fee is high",
    6: " wallet balance 1234 5678 9012",
    7: " verification on 09876543210",
    8: " ok 😀 fine ’",
    9: " Grok  is  down",
    10: " acct 123456 inactivity",
}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def as_reviews(docs: DataFrame) -> DataFrame:
    """Documents as raw reviews: dates over five weeks, text in one of three columns, a tail with
    theme words, personal data, emoji or misspellings chosen by the text's length."""
    tail = None
    for k, words in TAILS.items():
        test = F.pmod(F.length("text"), F.lit(12)) == k
        tail = F.when(test, words) if tail is None else tail.when(test, words)
    body = docs.select("doc_id", "source", "lang", F.concat("text", tail.otherwise("")).alias("body"))
    turn = F.col("doc_id") % 3
    return body.select(
        F.col("doc_id").alias(KEY),
        F.date_add(F.lit(FIRST_DAY), (F.col("doc_id") % 35).cast("int")).alias("at"),
        (1 + F.col("doc_id") % 5).cast("int").alias("score"),
        (F.col("doc_id") % 4).alias("thumbs_up"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("review_title"),
        F.col("lang").alias("title"),
        F.when(turn == 0, F.col("body")).otherwise("").alias("review_text"),
        F.when(turn == 1, F.col("body")).alias("text"),
        F.when(turn == 2, F.col("body")).otherwise("").alias("content"),
    )


def reviews_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_reviews(documents(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a model's answers: good, unsure, unknown, empty and missing ones."""
    docs = spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet").filter(F.col("doc_id") % 13 != 0)
    kind = F.col("doc_id") % 7
    theme = (
        F.when(kind == 0, "Execution & Performance").when(kind == 1, "Payments & Withdrawals")
        .when(kind == 2, "Charges & Transparency").when(kind == 3, "KYC & Access")
        .when(kind == 4, "UI & Feature Gaps").when(kind == 5, "Not A Theme")
    )
    mood = F.col("doc_id") % 3
    return docs.select(
        F.col("doc_id").alias(KEY), theme.alias("review_theme"),
        F.when(mood == 0, "positive").when(mood == 1, "negative").alias("sentiment"),
        ((F.col("doc_id") % 11).cast("double") / 10).alias("confidence"),
        F.lit("model").alias("reason"),
    )


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.normalize_reviews(reviews_raw(spark, sf_dir), FIRST_DAY, AS_OF)


def reviews_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_reviews(normalized(spark, sf_dir))


def reviews_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_reviews(reviews_clean(spark, sf_dir), predictions(spark, sf_dir), KEY)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of runs: a user is a run, an event type a stage, its values tell success."""
    return events(spark, sf_dir).groupBy(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("stage")
    ).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
        (F.max("value") < 250).alias("succeeded"), F.count(F.lit(1)).alias("n_rows"),
    ).withColumns({
        "output": F.concat(F.lit("layers/"), "stage"),
        "details": F.when(F.col("succeeded"), "").otherwise(F.concat(F.lit("over the limit in "), "stage")),
        "window_start": F.to_date("started_at"), "window_end": F.to_date("ended_at"),
    })


def reviews_unchecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised reviews put into the clean schema without any cleaning, so that checks find something."""
    body = F.col("text")
    return normalized(spark, sf_dir).select(
        F.when(F.col(KEY) % 17 == 0, F.lit("not-a-uuid")).otherwise(clean.surrogate_id("text")).alias("review_id"),
        F.when(F.col(KEY) % 19 != 0, F.col("date")).alias("date"),
        F.date_trunc("week", "date").cast("date").alias("week_start_date"),
        F.date_add(F.date_trunc("week", "date").cast("date"), (5 + F.col(KEY) % 2).cast("int")).alias("week_end_date"),
        (F.col("rating") - 1).alias("rating"), "title", body.alias("text"), body.alias("clean_text"),
        "relevance", F.when(F.col(KEY) % 5 == 0, F.lit("elsewhere")).otherwise(F.lit("google_play")).alias("source"),
        KEY,
    )
