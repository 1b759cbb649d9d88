"""The log of runs: one row per stage, and what it says about each run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_durations(stages: DataFrame) -> DataFrame:
    """Seconds of each stage of each run."""
    return stages.select(
        "run_id", "stage", "started_at", "ended_at", _seconds("started_at", "ended_at").alias("seconds")
    )


def _seconds(start: str, end: str):
    micros = F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    return F.round(micros / F.lit(1_000_000.0), 6)


def run_summary(stages: DataFrame) -> DataFrame:
    """One row per run: status, first stage that failed, window, start, end, total seconds; per stage its stamps,
    output and details.

    A run has a handful of stages, so the maps are small. Stages without an output or details are not in those maps.
    """
    stamps = F.map_from_entries(F.sort_array(F.collect_list(
        F.struct(F.col("stage").alias("key"), F.struct("started_at", "ended_at").alias("value"))
    )))

    def per_stage(column: str):
        given = F.when(F.coalesce(F.col(column), F.lit("")) != "", F.struct(F.col("stage").alias("key"), F.col(column).alias("value")))
        return F.map_from_entries(F.sort_array(F.collect_list(given)))

    failed = F.min(F.when(~F.col("succeeded"), F.struct("started_at", "stage")))["stage"]
    runs = stages.groupBy("run_id").agg(
        F.when(F.bool_and("succeeded"), "success").otherwise("error").alias("status"),
        failed.alias("failed_stage"),
        F.count(F.lit(1)).alias("n_stages"),
        F.min("started_at").alias("run_start"),
        F.max("ended_at").alias("run_end"),
        stamps.alias("stage_stamps"),
        per_stage("output").alias("outputs"),
        per_stage("details").alias("details"),
        F.min("window_start").alias("window_start"),
        F.max("window_end").alias("window_end"),
    )
    return runs.withColumn("seconds", _seconds("run_start", "run_end"))
