"""What the operators share: reading the given tables, shared-folder layers, and text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from echoloom.session import scratch_path

#: Rows of ``documents`` in the order of its columns.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, opened by Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage for good."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_training(doc_id: str = "doc_id") -> Column:
    """Rows that models may learn from: crc32 of the id as text, modulo 4, is not 2. A null id is not one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 != 2, F.lit(False))


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def whole_text(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


#: Bytes of rows that a task sends to Python at once; Spark's own limit is sixteen times as much, held once by the JVM and twice by Python.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def limit_batches(spark: SparkSession) -> None:
    """Lower the session's limit for batches from Spark's default to ``BATCH_BYTES``; a limit that a user has set stays. Memory only."""
    if spark.conf.get(_LIMIT, None) in (None, f"{64 << 20}b"):
        spark.conf.set(_LIMIT, f"{BATCH_BYTES}b")


def annotated(docs: DataFrame, work, results: str, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` as a struct column ``doc`` beside the columns that ``work`` makes of each text.

    ``work(texts)`` gets an Arrow string column and returns one Arrow array per column of ``results`` (a DDL string).
    Rows stay rows: nothing is joined back by id, so null and repeated ids and clashing names are no matter.
    ``carry`` names the columns inside ``doc`` (default: all), so that a scan reads no others.
    """
    limit_batches(docs.sparkSession)
    names = docs.columns if carry is None else carry
    doc = F.struct(*[F.col(f"`{n}`") for n in names]).alias("doc")
    # A text that is carried along is not sent twice.
    inside = names.index(text) if text in names and docs.schema[text].dataType == StringType() else None
    packed = docs.select(doc) if inside is not None else docs.select(doc, F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1) if inside is None else batch.column(0).field(inside)
            yield pa.RecordBatch.from_arrays([batch.column(0), *work(texts)], names=out_names)

    fields = packed.select("doc").schema
    for field in DataType.fromDDL(results).fields:
        fields = fields.add(field)
    out_names = [f.name for f in fields]
    return packed.mapInArrow(run, fields)
