"""The registry of runs: one appended row when a run ends, well or not.

The newest run is decided by these rows, not by the times of folders, which object stores do not keep. A run that has not ended
has no row and is never the newest; neither is one that failed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY = T.StructType([
    T.StructField("run_key", T.StringType()),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("succeeded", T.BooleanType()),
    T.StructField("output", T.StringType()),
])


def record_finish(spark: SparkSession, registry: str, run_key: str, finished_at: dt.datetime, succeeded: bool, output: str = "") -> None:
    """Append the row of a run that has ended. ``output`` names where it left its rows."""
    spark.createDataFrame([(run_key, finished_at, succeeded, output)], REGISTRY).coalesce(1).write.mode("append").parquet(registry)


def read_registry(spark: SparkSession, registry: str) -> DataFrame:
    return spark.read.schema(REGISTRY).parquet(registry)


def newest_run(spark: SparkSession, registry: str) -> Row | None:
    """The row of the run that finished last of those that went well; of several at one moment the largest key."""
    last = read_registry(spark, registry).filter("succeeded").agg(F.max(F.struct("finished_at", "run_key", "output")).alias("last"))
    return last.first()["last"]


def latest_finished(spark: SparkSession, registry: str, schema: T.StructType) -> DataFrame:
    """The rows of the newest run, with its ``run_key``; only its own folder is opened. No rows if no run has gone well."""
    newest = newest_run(spark, registry)
    if newest is None:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("run_key", T.StringType())]))
    return spark.read.schema(schema).parquet(newest["output"]).withColumn("run_key", F.lit(newest["run_key"]))
