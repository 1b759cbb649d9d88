"""Data-quality checks as Spark jobs. Each returns ``check, passed, n_bad``.

All row checks of a table are counted in one pass with one aggregate; only uniqueness needs a shuffle of
its own, and that one groups on the identifier with map-side partial counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from echoloom import config, schemas
from echoloom.config import Taxonomy
from echoloom.functions import text
from echoloom.operators.clean import CLEAN_COLUMNS, redact_column

UUID_SHAPE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
CLASSIFIED_REQUIRED = ["review_id", "rating", "sentiment", "review_theme", "confidence", "fallback_applied"]


def _any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def _bad(condition: Column) -> Column:
    """A condition whose null counts as bad."""
    return F.coalesce(condition, F.lit(True))


def clean_checks(source: str = config.SOURCE_NAME) -> dict[str, Column]:
    """Conditions that mark a bad row of the clean layer."""
    day, first, last = F.col("date"), F.col("week_start_date"), F.col("week_end_date")
    body, cleaned = F.col("text"), F.col("clean_text")
    return {
        "required_fields": _any_null(CLEAN_COLUMNS),
        "rating_range": _bad(~F.col("rating").between(1, 5)),
        "source_constant": _bad(F.col("source") != source),
        "dates_valid": day.isNull() | first.isNull() | last.isNull(),
        "week_span": _bad(F.date_diff(last, first) != 6),
        "date_in_week": _bad((day < first) | (day > last)),
        "text_present": body.isNull() | cleaned.isNull(),
        "clean_lowercase": _bad(cleaned != F.lower(cleaned)),
        "clean_trimmed": _bad(cleaned.rlike(r"(?U)\A\s|\s\z")),
        "clean_single_spaced": _bad(F.contains(cleaned, F.lit("  "))),
        "emoji_free": _bad(text.has_emoji(cleaned)),
        "id_is_uuid": _bad(~F.col("review_id").rlike(UUID_SHAPE)),
        "pii_residual": _bad(F.col("_redacted_again") != body),
    }


def classified_checks(taxonomy: Taxonomy = config.TAXONOMY) -> dict[str, Column]:
    """Conditions that mark a bad row of the classified layer."""
    blank = [F.coalesce(F.col(c) == "", F.lit(True)) for c in ("review_id", "sentiment", "review_theme")]
    no_confidence = F.coalesce(F.col("confidence") == 0, F.lit(True))
    return {
        "required_fields": _any_null(CLASSIFIED_REQUIRED),
        "theme_domain": _bad(~F.col("review_theme").isin(taxonomy.names)),
        "sentiment_domain": _bad(~F.col("sentiment").isin(list(config.SENTIMENTS))),
        "confidence_range": _bad(~F.col("confidence").between(0.0, 1.0)),
        "completeness": reduce(lambda a, b: a | b, [*blank, no_confidence]),
    }


def with_redacted_again(clean: DataFrame) -> DataFrame:
    """Add the column that ``pii_residual`` compares: the stored text, redacted once more."""
    return redact_column(clean.withColumn("_redacted_again", F.col("text")), "_redacted_again")


def _verdict(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = [
        F.struct(F.lit(n).alias("check"), (F.col(n) == 0).alias("passed"), F.col(n).cast("long").alias("n_bad"))
        for n in names
    ]
    return counts.select(F.inline(F.array(*rows)))


def count_bad(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Bad rows per check, all checks in one pass."""
    counts = df.agg(*[F.count_if(condition).alias(name) for name, condition in checks.items()])
    return _verdict(counts, list(checks))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that a table does not have."""
    return [c for c in required if c not in df.columns]


def with_absent_as_null(df: DataFrame, schema: StructType) -> DataFrame:
    """The table with every column of ``schema``; those it lacks are null, so that the checks on them fail."""
    absent = set(missing_columns(df, schema.fieldNames()))
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name in absent})


def columns_present(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The number of required columns that a table does not have, also for a table without rows."""
    n = len(missing_columns(df, required))
    return _verdict(df.agg(F.count(F.lit(1)).alias("_rows")).select(F.lit(n).alias("columns_present")), ["columns_present"])


def required_fields(df: DataFrame, schema: StructType, required: Sequence[str], check: Column) -> DataFrame:
    """Rows with a null in a required column, and required columns that are absent."""
    rows = count_bad(with_absent_as_null(df, schema), {"required_fields": check})
    return rows.unionByName(columns_present(df, required))


def unique_ids(df: DataFrame, key: str = "review_id") -> DataFrame:
    """Rows beyond the first of each identifier."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return _verdict(groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("id_unique")), ["id_unique"])


def rating_spread(df: DataFrame) -> DataFrame:
    """One bad finding if all rows carry the same rating."""
    same = F.when(F.count(F.lit(1)) == 0, 0).when(F.min("rating") < F.max("rating"), 0).otherwise(1)
    return _verdict(df.agg(same.alias("rating_spread")), ["rating_spread"])


def summary_reconcile(classified: DataFrame, summary: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Whether a stored summary agrees with the rows it sums up."""
    actual = classified.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean"))
    both = actual.withColumns({
        "stored_n": summary.select("total_output").scalar(),
        "stored_mean": summary.select("average_confidence").scalar(),
    })
    counts = both.agg(
        F.count_if(_bad(F.col("n") != F.col("stored_n"))).alias("summary_count"),
        F.count_if(_bad(F.abs(F.col("mean") - F.col("stored_mean")) >= tolerance)).alias("summary_mean"),
    )
    return _verdict(counts, ["summary_count", "summary_mean"])


def clean_suite(clean: DataFrame, source: str = config.SOURCE_NAME) -> DataFrame:
    """All checks of the clean layer."""
    full = with_absent_as_null(clean, schemas.REVIEWS_CLEAN)
    rows = count_bad(with_redacted_again(full), clean_checks(source)).unionByName(columns_present(clean, CLEAN_COLUMNS))
    return rows.unionByName(unique_ids(full)).unionByName(rating_spread(full))


def classified_suite(classified: DataFrame, summary: DataFrame) -> DataFrame:
    """All checks of the classified layer."""
    full = with_absent_as_null(classified, schemas.REVIEWS_CLASSIFIED)
    rows = count_bad(full, classified_checks()).unionByName(columns_present(classified, CLASSIFIED_REQUIRED))
    return rows.unionByName(summary_reconcile(full, summary))


def dq_suite(clean: DataFrame, classified: DataFrame, summary: DataFrame) -> DataFrame:
    """The checks of both layers with the layer each belongs to."""
    return (
        clean_suite(clean).withColumn("layer", F.lit("clean"))
        .unionByName(classified_suite(classified, summary).withColumn("layer", F.lit("classified")))
    )


def suite_totals(verdicts: DataFrame) -> DataFrame:
    """Checks passed and checks run, per layer."""
    return verdicts.groupBy("layer").agg(
        F.count_if("passed").alias("n_passed"), F.count(F.lit(1)).alias("n_checks")
    )
