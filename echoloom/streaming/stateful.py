"""Duplicate removal across triggers with keyed state: each run reads what landed, not what landed before.

The state store holds, per digest of a clean text, the place of its earliest copy in the order of (date, identifier) and the
number of copies; no text. A trigger emits one correction per text that it met: with the row, where that row is the
earliest copy so far, else only the new count. The corrections of a trigger are appended; of a text's corrections the last one
that carries a row tells the row, the largest count the copies.

A text's state ends when the watermark has passed its latest copy; later copies begin a new generation and are kept apart.
Rows older than the watermark are dropped, as in every stream with one. A copy that lands late but within the watermark and is
dated earlier wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from echoloom import config
from echoloom.streaming.incremental import BATCH, LATENESS, append_batches, clean_stream

ORDER = ("date", "source_review_id")
#: The state store: values of ``transformWithState`` need the one on disk.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PLACED = "digest string, rank string, row string, copies long, seen timestamp"
_CORRECTION = "digest string, generation string, copies long, row string"
_STATE = "generation string, rank string, copies long, until long"
#: Texts of one bucket share a call to the state store. Fixed, as a checkpoint depends on it.
BUCKETS = 1 << 12


def sort_text(column: Column, dtype: T.DataType) -> Column:
    """A string that sorts like the value: null first, then dates, whole numbers or strings."""
    if isinstance(dtype, T.DateType):
        text = F.lpad(F.datediff(column, F.lit("0001-01-01").cast("date")).cast("string"), 10, "0")
    elif isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        text = F.lpad((column.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    elif isinstance(dtype, T.StringType):
        text = column
    else:
        raise ValueError(f"no order as text for {dtype.simpleString()}")
    return F.when(column.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), text))


def _collapse(min_words: int):
    """Rows with enough words, one per text and Arrow batch, before the shuffle: a text in every second row meets the state as few rows."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            long_enough = batch.filter(pc.greater_equal(batch.column("n_words"), min_words))
            if not long_enough.num_rows:
                continue
            rows = pa.Table.from_batches([long_enough]).sort_by([("digest", "ascending"), ("rank", "ascending")])
            one = rows.group_by("digest", use_threads=False).aggregate([("rank", "first"), ("row", "first"), ("digest", "count"), ("seen", "max")])
            yield pa.RecordBatch.from_arrays(
                [one.column(c).combine_chunks() for c in ("digest", "rank_first", "row_first", "digest_count", "seen_max")],
                names=["digest", "rank", "row", "copies", "seen"],
            )

    return run


def _processor():
    """The corrections of the texts of one bucket in one trigger: their earliest copies so far, and how many there have been.

    Nearly all the time goes into calls to the store. A bucket's texts are read together and share one timer, which goes off with the first of
    them to end; each text that a trigger met is written by one call. The store keeps a row for each text.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Track(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.texts = handle.getMapState("texts", "digest string", _STATE)

        def _known(self) -> dict:
            return {digest: tuple(place) for (digest,), place in self.texts.iterator()}

        def handleInputRows(self, key, rows, timerValues):
            texts = self._known()
            due = min((until for *_, until in texts.values()), default=None)
            met: dict = {}  # digest: (winning row or null, latest copy)
            for found in rows:
                generation, rank, copies, until = texts.get(found.digest, (None, None, 0, None))
                row, latest = met.get(found.digest, (None, 0))
                if rank is None or found.rank < rank:
                    rank, row = found.rank, found.row
                texts[found.digest] = (generation, rank, copies + found.copies, until)
                met[found.digest] = (row, max(latest, found.seen_ms))
            soonest = timerValues.getCurrentWatermarkInMs() + 1
            for digest, (row, latest) in met.items():
                generation, rank, copies, _ = texts[digest]
                texts[digest] = (rank if generation is None else generation, rank, copies, max(latest, soonest))
                self.texts.updateValue((digest,), texts[digest])
                yield Row(digest=digest, generation=texts[digest][0], copies=copies, row=row)
            ends = min(until for *_, until in texts.values())
            if ends != due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(ends)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            passed = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
            texts = self._known()
            for digest, place in texts.items():
                if place[-1] <= passed:
                    self.texts.removeKey((digest,))
            ends = min((until for *_, until in texts.values() if until > passed), default=None)
            if ends is not None:
                self.handle.registerTimer(ends)
            return iter(())

        def close(self) -> None:
            """Nothing is held open."""

    return Track()


def corrections(cleaned: DataFrame, order: Sequence[str] = ORDER, lateness: str = LATENESS, min_words: int = config.MIN_WORDS) -> DataFrame:
    """A stream of corrections from a stream of cleaned rows. ``row`` is the winning row as JSON, null where it has not changed."""
    rank = F.concat_ws("|", *[sort_text(F.col(c), cleaned.schema[c].dataType) for c in order])
    placed = cleaned.select(
        F.sha2("clean_text", 256).alias("digest"), rank.alias("rank"), F.to_json(F.struct(*cleaned.columns)).alias("row"),
        F.col("date").cast("timestamp").alias("seen"), "n_words",
    )
    collapsed = placed.mapInArrow(_collapse(min_words), _PLACED).withWatermark("seen", lateness).withColumn("seen_ms", F.unix_millis("seen"))
    bucket = F.pmod(F.crc32("digest"), F.lit(BUCKETS))
    return collapsed.withColumn("bucket", bucket).groupBy("bucket").transformWithState(_processor(), _CORRECTION, "update", "eventTime")


def run_stateful_dedup(
    normalized: DataFrame, path: str, checkpoint: str, order: Sequence[str] = ORDER, lateness: str = LATENESS, min_words: int = config.MIN_WORDS
) -> StreamingQuery:
    """Clean what landed since the last run and append its corrections; stops when it has caught up.

    The state lives in ``checkpoint`` and goes on from there after a restart. Cleaning is row by row, so nothing that
    landed before is read again. A repeated micro-batch replaces its own folder.
    """
    spark = normalized.sparkSession
    cleaned = clean_stream(normalized, min_words)
    schema = cleaned.schema

    def build(batch: DataFrame) -> DataFrame:
        return batch.select("digest", "generation", "copies", F.col("row").isNotNull().alias("wins"), F.from_json("row", schema).alias("row"))

    writer = (
        corrections(cleaned, order, lateness, min_words).writeStream
        .foreachBatch(append_batches(spark, path, build))
        .outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS_DB)  # the query keeps the settings that it starts with
    try:
        return writer.start()
    finally:
        spark.conf.set(_STORE, before)


def read_corrected(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The corrections as one table of ``schema`` (of cleaned rows) plus ``copies``: one row per text and generation.

    The aggregate is over digests and counts; of the texts only the winning rows are read, by their text and trigger.
    """
    stored = T.StructType().add("digest", "string").add("generation", "string").add("copies", "long").add("wins", "boolean").add("row", schema).add(BATCH, "long")
    rows = spark.read.schema(stored).parquet(path)
    last = rows.groupBy("digest", "generation").agg(F.max(F.when(F.col("wins"), F.col(BATCH))).alias(BATCH), F.max("copies").alias("copies"))
    won = rows.filter("wins").select("digest", "generation", BATCH, "row")
    return won.join(last, ["digest", "generation", BATCH]).select("row.*", "copies")
