"""The whole job: raw reviews in, weekly pulses out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from echoloom import config, schemas
from echoloom.functions import dates
from echoloom.operators import classify, clean, insight, summaries
from echoloom.plans import registry
from echoloom.session import materialize
from echoloom.sources import writers

WEEK = ["week_start_date", "week_end_date"]


def weekly_pulse(
    raw: DataFrame,
    predictions: DataFrame,
    as_of: dt.date,
    window_days: int = config.DEFAULT_WINDOW_DAYS,
    key: str = "source_review_id",
    period: tuple[str, ...] = ("week_start_date",),
    summarize: Callable[[DataFrame], DataFrame] | None = None,
    reduce: Callable[..., DataFrame] | None = None,
    actions: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Pulses of every period in the window. ``actions`` makes the action ideas of each period from the classified layer.

    The classified layer is written once and read by the steps after it: top themes, slice counts
    and chunks all need it, and none of them should clean the texts again.
    """
    start, end = dates.date_window(as_of, window_days)
    reviews = clean.clean_reviews(clean.normalize_reviews(raw, start, end))
    classified = materialize(classify.classify_reviews(reviews, predictions, key), "classified")
    return insight.generate_pulse(classified, period, summarize, materialize, reduce, actions(classified) if actions else None)


@dataclass(frozen=True)
class RunPaths:
    """Where a run leaves its tables."""

    base: str

    def of(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"


def run_weekly(
    spark: SparkSession,
    raw: DataFrame,
    predictions: DataFrame,
    as_of: dt.date,
    base: str,
    run_id: str,
    window_days: int = config.DEFAULT_WINDOW_DAYS,
    key: str = "source_review_id",
    clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc),
) -> DataFrame:
    """Run all stages, writing each layer below ``base``, and log them; returns the pulses.

    Stops at the first stage that fails, after logging it. The registry gets the run's last row, from which
    ``registry.newest_run`` finds the newest one that went well. Row counts come from the write itself
    (``observe``). Since each stage starts from a written table, a run can be repeated from any.
    """
    paths = RunPaths(base)
    start, end = dates.date_window(as_of, window_days)
    log: list[tuple] = []

    def stage(
        name: str, output: str, build: Callable[[], DataFrame], write: Callable[[DataFrame, str], None]
    ) -> StructType:
        started = clock()
        seen = Observation(f"{run_id}-{name}")
        try:
            table = build()
            write(table.observe(seen, F.count(F.lit(1)).alias("n")), output)
        except Exception as error:
            log.append((run_id, name, started, clock(), False, None, output, str(error), start, end))
            writers.append_run_log(spark.createDataFrame(log, schemas.STAGE_LOG), paths.of("run_log"))
            registry.record_finish(spark, paths.of("registry"), run_id, clock(), False, output)
            raise
        log.append((run_id, name, started, clock(), True, seen.get["n"], output, "", start, end))
        return table.schema

    def parquet(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)

    clean_path, classified_path, chunk_path, pulse_path = (
        paths.of(f"{name}/run_id={run_id}") for name in ("clean", "classified", "chunks", "pulses")
    )
    schema = stage("clean", clean_path, lambda: clean.clean_reviews(clean.normalize_reviews(raw, start, end), dedup=clean.dedup_late), parquet)
    reviews = spark.read.schema(schema).parquet(clean_path)
    schema = stage("classify", classified_path, lambda: classify.classify_reviews(reviews, predictions, key), parquet)
    classified = spark.read.schema(schema).parquet(classified_path)
    period = ["week_start_date"]

    def keep_chunks(df: DataFrame, label: str) -> DataFrame:
        parquet(df, chunk_path)
        return spark.read.schema(df.schema).parquet(chunk_path)

    stage("insight", pulse_path, lambda: insight.generate_pulse(classified, period, None, keep_chunks), writers.write_pulse)
    writers.append_run_log(spark.createDataFrame(log, schemas.STAGE_LOG), paths.of("run_log"))
    registry.record_finish(spark, paths.of("registry"), run_id, clock(), True, pulse_path)
    return spark.read.schema(schemas.PULSE).json(pulse_path)


def processing_report(normalized: DataFrame) -> dict[str, DataFrame]:
    """The tables of the cleaning report: funnel, ratings, weeks, examples. Cleans the texts once."""
    distinct = materialize(clean.distinct_reviews(normalized), "distinct")
    table = clean.project_clean(distinct)
    return {
        "funnel": summaries.processing_funnel(normalized, distinct),
        "ratings": summaries.rating_distribution(table),
        "weeks": summaries.weekly_distribution(table),
        "examples": clean.sample_records(table),
    }
