"""Themes for reviews: model predictions where they hold up, keywords where they do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom import config
from echoloom.config import Taxonomy
from echoloom.functions import themes
from echoloom.sources import buckets as bucketing

PREDICTION_FIELDS = ["review_theme", "sentiment", "confidence", "reason"]
CLASSIFIED_COLUMNS = [
    "review_id", "date", "rating", "title", "text", "clean_text", "sentiment", "review_theme", "confidence",
    "reason", "llm_suggested_theme", "fallback_applied",
]


def classify_keywords(
    df: DataFrame, column: str = "clean_text", taxonomy: Taxonomy = config.TAXONOMY, word_boundary: bool = False
) -> DataFrame:
    """Add theme, confidence and reason from keywords alone."""
    hit = themes.with_lowered(df, column).withColumn("_hit", themes.best_keyword(taxonomy, word_boundary))
    return hit.withColumns({
        "review_theme": themes.theme_at(F.col("_hit"), taxonomy),
        "confidence": F.lit(config.FALLBACK_CONFIDENCE),
        "reason": themes.reason_at(F.col("_hit"), taxonomy),
    }).drop("_hit", themes.LOWERED)


def one_prediction_per_key(predictions: DataFrame, key: str) -> DataFrame:
    """The most confident prediction of each key.

    Partial aggregation makes a key with very many predictions harmless, and the result is hash
    partitioned on the key, so the join that follows needs no other shuffle of this side.
    """
    best = F.max(F.struct("confidence", "review_theme", "sentiment", "reason")).alias("_best")
    return predictions.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in PREDICTION_FIELDS])


def merge_predictions(
    reviews: DataFrame, predictions: DataFrame, key: str = "review_id", unique: bool = False
) -> DataFrame:
    """Every review with its prediction in ``model_*`` columns, null where the model gave none.

    Pairs by key: missing, surplus or reordered predictions cannot shift onto other reviews.
    ``unique`` skips the dedup of predictions where the key is known to be unique.
    """
    side = predictions if unique else one_prediction_per_key(predictions, key)
    side = side.select(
        key, *[F.col(c).alias(f"model_{c}") for c in PREDICTION_FIELDS], F.lit(True).alias("model_answered")
    )
    return reviews.join(side, key, "left").withColumn("model_answered", F.col("model_answered").isNotNull())


def write_merge_layers(reviews: DataFrame, predictions: DataFrame, path: str, key: str, buckets: int) -> None:
    """Both sides of ``merge_predictions`` as layers bucketed by ``key``, the predictions with one row per key.

    Bucketing costs one shuffle of each side here; every later join of the layers costs none.
    """
    bucketing.write_layer(reviews, f"{path}/reviews", key, buckets)
    bucketing.write_layer(one_prediction_per_key(predictions, key), f"{path}/predictions", key, buckets)


def merge_layers(
    spark: SparkSession, path: str, reviews: T.StructType, predictions: T.StructType, key: str, buckets: int
) -> DataFrame:
    """``merge_predictions`` over such layers: same rows, without a shuffle. Reviews without a key have no prediction."""
    side = bucketing.read_keyed(spark, f"{path}/predictions", predictions, key, buckets)
    keyed = bucketing.read_keyed(spark, f"{path}/reviews", reviews, key, buckets)
    merged = merge_predictions(keyed, side, key, unique=True)
    return merged.unionByName(
        bucketing.read_keyless(spark, f"{path}/reviews", reviews).withColumn("model_answered", F.lit(False)), allowMissingColumns=True
    )


def needs_fallback(taxonomy: Taxonomy = config.TAXONOMY) -> Column:
    """Whether a merged prediction is missing, names no allowed theme, or is too unsure."""
    theme = F.coalesce("model_review_theme", F.lit(""))
    confidence = F.coalesce("model_confidence", F.lit(0.0))
    return ~theme.isin(taxonomy.names) | (confidence < config.CONFIDENCE_THRESHOLD)


def validate_predictions(
    merged: DataFrame, column: str = "clean_text", taxonomy: Taxonomy = config.TAXONOMY, word_boundary: bool = False
) -> DataFrame:
    """Turn merged predictions into final theme, sentiment, confidence and reason.

    Keywords are looked up only for rows that need them. A rejected answer keeps its sentiment,
    and its theme as ``llm_suggested_theme`` where that theme is allowed.
    """
    others = [c for c in merged.columns if not c.startswith("model_")]
    model = [c for c in merged.columns if c.startswith("model_")]
    judged = merged.select(*others, *model, needs_fallback(taxonomy).alias("fallback_applied"))
    looked_up = themes.with_lowered(judged, column).withColumn(
        "_hit", F.when(F.col("fallback_applied"), themes.best_keyword(taxonomy, word_boundary))
    )
    fallback = F.col("fallback_applied")
    confidence = F.coalesce("model_confidence", F.lit(0.0))
    raised = F.when(
        confidence >= config.CONFIDENCE_THRESHOLD, F.greatest(confidence, F.lit(config.FALLBACK_CONFIDENCE))
    ).otherwise(config.FALLBACK_CONFIDENCE)
    return looked_up.select(
        *others,
        F.coalesce("model_sentiment", F.lit(config.DEFAULT_SENTIMENT)).alias("sentiment"),
        F.when(fallback, themes.theme_at(F.col("_hit"), taxonomy)).otherwise(F.col("model_review_theme"))
        .alias("review_theme"),
        F.when(fallback, raised).otherwise(confidence).alias("confidence"),
        F.when(fallback, themes.reason_at(F.col("_hit"), taxonomy))
        .otherwise(F.coalesce("model_reason", F.lit(""))).alias("reason"),
        F.when(fallback & F.col("model_review_theme").isin(taxonomy.names), F.col("model_review_theme"))
        .alias("llm_suggested_theme"),
        fallback.alias("fallback_applied"),
    )


def full_fallback(reviews: DataFrame, column: str = "clean_text", taxonomy: Taxonomy = config.TAXONOMY) -> DataFrame:
    """Classification without any model answer: keywords, neutral, marked as fallback."""
    return classify_keywords(reviews, column, taxonomy).withColumns({
        "sentiment": F.lit(config.DEFAULT_SENTIMENT),
        "llm_suggested_theme": F.lit(None).cast("string"),
        "fallback_applied": F.lit(True),
    })


def classify_reviews(
    reviews: DataFrame,
    predictions: DataFrame,
    key: str = "review_id",
    taxonomy: Taxonomy = config.TAXONOMY,
    unique: bool = False,
    word_boundary: bool = False,
) -> DataFrame:
    """Reviews with final classification. One join: review columns ride along, no later enrichment."""
    merged = merge_predictions(reviews, predictions, key, unique)
    return validate_predictions(merged, "clean_text", taxonomy, word_boundary)


def enrich_join(
    classifications: DataFrame, reviews: DataFrame, key: str = "review_id", unique: bool = False
) -> DataFrame:
    """Classifications with the review they belong to; defaults where there is none.

    Should an identifier occur more than once among the reviews, its latest row counts, found by
    aggregation so that the join never multiplies rows. ``unique`` skips that where the key is known to be unique, as
    it is after cleaning; the texts are then neither sorted nor aggregated.
    """
    carried = [c for c in ("date", "rating", "title", "text", "clean_text") if c in reviews.columns]
    row = F.struct(*carried).alias("_review")
    latest = reviews.select(key, row) if unique else reviews.groupBy(key).agg(F.max(row).alias("_review"))
    joined = classifications.join(latest, key, "left")
    defaults = {"rating": F.lit(0), "title": F.lit(""), "text": F.lit(""), "clean_text": F.lit("")}
    review = [
        F.coalesce(F.col(f"_review.{c}"), defaults[c]).alias(c) if c in defaults else F.col(f"_review.{c}").alias(c)
        for c in carried
    ]
    return joined.select(*classifications.columns, *review)


def project_classified(classified: DataFrame) -> DataFrame:
    """The twelve columns of the classified report."""
    return classified.select(*CLASSIFIED_COLUMNS)
