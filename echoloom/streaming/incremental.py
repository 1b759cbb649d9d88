"""Incremental runs: process only what landed since the last trigger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from echoloom import config
from echoloom.functions import dates, text
from echoloom.operators import clean
from echoloom.session import is_dir, make_dir

WEEK_OFFSET = "4 days"
LATENESS = "35 days"
BATCH = "batch_id"


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000
) -> DataFrame:
    """A stream of the Parquet files of a table: those that land in its folder, or its single file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if is_dir(spark, path):
        return reader.option("pathGlobFilter", "*.parquet").parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def clean_stream(normalized: DataFrame, min_words: int = config.MIN_WORDS) -> DataFrame:
    """The row-wise part of cleaning; works on a stream, where dedup needs state."""
    dated = clean.filter_valid_date(normalized)
    return clean.with_clean_text(dated.filter(text.has_words("text", min_words)))


def append_batches(spark: SparkSession, path: str, build):
    """A sink that writes each micro-batch into its own folder; a repeated batch replaces itself.

    The folder is there from the start, so a stream without rows leaves an empty table.
    """
    make_dir(spark, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return write


def incremental_clean(normalized: DataFrame, path: str, checkpoint: str, min_words: int = config.MIN_WORDS) -> StreamingQuery:
    """Clean newly landed reviews and append them; stops when it has caught up.

    The exact word filter runs in the batch, on one row per text, after the dedup within the batch.
    """

    def build(batch: DataFrame) -> DataFrame:
        return clean.dedup_earliest(batch).filter(F.col("n_words") >= min_words)

    return (
        clean_stream(normalized, min_words).writeStream
        .foreachBatch(append_batches(normalized.sparkSession, path, build))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_deduplicated(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The appended batches as one table: the earliest row of each text over all runs.

    Each batch holds one row per text, so this is the exact rule at the price of one aggregate, and
    no run rewrites what earlier runs stored. ``copies`` adds up.
    """
    batches = spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    earliest = clean.dedup_earliest(batches.withColumnRenamed("copies", "_copies"), total="_copies")
    return earliest.select(*schema.fieldNames())


def compact(spark: SparkSession, path: str, schema: T.StructType, into: str) -> None:
    """Write the deduplicated batches of ``path`` as the first batch of a table at ``into``.

    Later runs append there, so a read no longer aggregates all that ever landed, only one row per text and what
    has come since. The old batches stay until their owner deletes them.
    """
    read_deduplicated(spark, path, schema).write.parquet(f"{into}/{BATCH}=-1")


def drop_repeats(events: DataFrame, keys: Sequence[str], event_time: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Keep the first arrival of each key while its state lasts; state ends with the watermark."""
    return events.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(list(keys))


def weekly_counts(events: DataFrame, theme: str, event_time: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Rows per theme and Monday week; late rows count until the watermark passes their week."""
    week = F.window(event_time, "7 days", "7 days", WEEK_OFFSET)
    return (
        events.withWatermark(event_time, lateness)
        .groupBy(week.alias("_week"), F.col(theme))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.to_date("_week.start").alias("week_start_date"),
            F.date_sub(F.to_date("_week.end"), 1).alias("week_end_date"),
            theme, "n",
        )
    )


def run_weekly_counts(events: DataFrame, theme: str, path: str, checkpoint: str, **kwargs) -> StreamingQuery:
    """Maintain the weekly counts: each trigger appends the weeks that changed."""
    return (
        weekly_counts(events, theme, **kwargs).writeStream
        .outputMode("update")
        .foreachBatch(append_batches(events.sparkSession, path, lambda batch: batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_weekly_counts(spark: SparkSession, path: str, theme: str) -> DataFrame:
    """The latest count of every week and theme from the appended updates."""
    updates = spark.read.schema(
        f"week_start_date date, week_end_date date, `{theme}` string, n long, {BATCH} long"
    ).parquet(path)
    return updates.groupBy("week_start_date", "week_end_date", theme).agg(F.max_by("n", BATCH).alias("n"))


def weekly_counts_batch(events: DataFrame, theme: str, event_time: str = "ts") -> DataFrame:
    """The batch twin of ``weekly_counts``."""
    return events.groupBy(
        dates.week_start(event_time).alias("week_start_date"), dates.week_end(event_time).alias("week_end_date"), theme
    ).agg(F.count(F.lit(1)).alias("n"))
