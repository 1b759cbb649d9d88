"""The run log of a stream: what each micro-batch read, kept in state, and dropped behind its watermark.

Rows behind the watermark vanish from the counts. The engine reports how many groups it dropped, after partial aggregation, so
several late rows of a week can be one group. The exact number of rows is what was read, less what has no time, less what was counted.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from echoloom.streaming.incremental import BATCH, read_weekly_counts, run_weekly_counts

OBSERVED = "rows"
PROGRESS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("watermark", T.StringType()),
    T.StructField("rows_read", T.LongType()),
    T.StructField("rows_undated", T.LongType()),
    T.StructField("state_rows", T.LongType()),
    T.StructField("groups_late", T.LongType()),
])


def observed(events: DataFrame, event_time: str) -> DataFrame:
    """The stream with its rows counted as they are read."""
    undated: Column = F.count_if(F.col(event_time).isNull())
    return events.observe(OBSERVED, F.count(F.lit(1)).alias("rows_read"), undated.alias("rows_undated"))


class ProgressLog(StreamingQueryListener):
    """Writes one row per micro-batch to a folder of its own, so a repeated batch replaces its row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.run_id: str | None = None
        self.ended = threading.Event()
        self.error: Exception | None = None
        self._early: list = []
        self._lock = threading.Lock()

    def follow(self, query: StreamingQuery) -> None:
        """Log this query only; events that came before it was known are looked at now."""
        with self._lock:
            self.run_id = str(query.runId)
            early, self._early = self._early, []
            for event in early:
                self._take(event)

    def _take(self, event) -> None:
        progress = getattr(event, "progress", None)
        if str(progress.runId if progress else event.runId) != self.run_id:
            return
        if progress is None:
            self.ended.set()
            return
        try:
            self._write(progress)
        except Exception as error:  # a listener's errors are lost otherwise
            self.error = error

    def _write(self, progress) -> None:
        seen = progress.observedMetrics.get(OBSERVED)
        operators = progress.stateOperators
        row = (
            str(progress.runId), progress.timestamp, progress.eventTime.get("watermark"),
            seen["rows_read"] if seen else 0, seen["rows_undated"] if seen else 0,
            sum(o.numRowsTotal for o in operators), sum(o.numRowsDroppedByWatermark for o in operators),
        )
        table = self.spark.createDataFrame([row], PROGRESS).coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.path}/{BATCH}={progress.batchId}")

    def _receive(self, event) -> None:
        with self._lock:
            if self.run_id is None:
                self._early.append(event)
            else:
                self._take(event)

    def onQueryStarted(self, event) -> None:
        """Nothing to log yet."""

    def onQueryProgress(self, event) -> None:
        self._receive(event)

    def onQueryIdle(self, event) -> None:
        """Nothing was read."""

    def onQueryTerminated(self, event) -> None:
        self._receive(event)


def run_logged(spark: SparkSession, path: str, start: Callable[[], StreamingQuery], timeout: float = 600) -> StreamingQuery:
    """Start a query, wait until it has caught up, and leave a row for each of its micro-batches at ``path``.

    Rows are written as batches end; events come in order, so after the query's last event all are written. A log that
    could not be written is an error of the run.
    """
    log = ProgressLog(spark, path)
    spark.streams.addListener(log)
    try:
        query = start()
        log.follow(query)
        query.awaitTermination()
        if not log.ended.wait(timeout):
            raise TimeoutError(f"the end of query {query.runId} was not reported")
    finally:
        spark.streams.removeListener(log)
    if log.error:
        raise log.error
    return query


def run_logged_counts(events: DataFrame, theme: str, path: str, checkpoint: str, log: str, event_time: str = "ts", **kwargs) -> StreamingQuery:
    """``run_weekly_counts`` to its end, with its run log."""
    read = observed(events.select(event_time, theme), event_time)
    return run_logged(
        events.sparkSession, log, lambda: run_weekly_counts(read, theme, path, checkpoint, event_time=event_time, **kwargs)
    )


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The run log: one row per micro-batch, over all runs on one checkpoint."""
    return spark.read.schema(T.StructType([*PROGRESS.fields, T.StructField(BATCH, T.LongType())])).parquet(path)


def late_rows(spark: SparkSession, log: str, counts: str, theme: str) -> DataFrame:
    """One row: rows read, without a time, counted, and late, over all runs so far; and the groups the engine dropped."""
    sums = ["rows_read", "rows_undated", "rows_counted", "groups_late"]
    batches = read_progress(spark, log).withColumn("rows_counted", F.lit(0))
    counted = read_weekly_counts(spark, counts, theme).select(F.col("n").alias("rows_counted"))
    both = batches.unionByName(counted, allowMissingColumns=True).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    late = F.col("rows_read") - F.col("rows_undated") - F.col("rows_counted")
    return both.select(*sums[:3], late.alias("rows_late"), "groups_late")
