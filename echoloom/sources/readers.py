"""Reading landed tables. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom import schemas
from echoloom.session import newest_folder
from echoloom.sources import split


def read_reviews(spark: SparkSession, path: str, schema: T.StructType = schemas.REVIEWS_RAW) -> DataFrame:
    """Raw reviews from Parquet."""
    return spark.read.schema(schema).parquet(path)


def read_landed_json(spark: SparkSession, path: str) -> DataFrame:
    """Raw reviews as a store exports them, one JSON object per line, in the names the jobs use."""
    landed = spark.read.schema(schemas.REVIEWS_LANDED).json(path)
    return landed.select(
        F.col("reviewId").alias("source_review_id"), "at", "score", F.col("thumbsUpCount").alias("thumbs_up"),
        F.col("reviewTitle").alias("review_title"), "title", F.col("reviewText").alias("review_text"), "text", "content",
    )


def read_records_json(
    spark: SparkSession, path: str, schema: T.StructType = schemas.REVIEWS_CLEAN, multi_line: bool = False
) -> DataFrame:
    """Records from documents ``{"records": [...]}`` or from bare records, mixed as they come, one a line.

    ``multi_line`` reads files that are one document or one array in any layout, by as many tasks as they have splits.
    """
    if multi_line:
        return split.read_records(spark, path, schema)
    both = T.StructType([T.StructField("records", T.ArrayType(schema)), *schema.fields])
    documents = spark.read.schema(both).json(path)
    bare = F.array(F.struct(*schema.fieldNames()))
    return documents.select(F.inline(F.coalesce("records", bare)))


def read_pulse_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Pulse reports with their nested themes."""
    return spark.read.schema(schemas.PULSE).option("multiLine", multi_line).json(path)


def read_reviews_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str]) -> DataFrame:
    """A CSV export with header, in the column order of the file; quoted values may span lines, and a file many splits."""
    return split.read_csv(spark, path, T.StructType([schema[c] for c in columns]), nullValue="", emptyValue="")


def latest_run(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the run that was written last, with its ``run_key``, from a table with one folder per run.

    Only the list of run folders is looked at, and only the newest is opened; a later run over an earlier window counts as
    newer. Runs written at the same moment are ordered by key. No rows if there is no run.
    """
    newest = newest_folder(spark, path, "run_key=")
    if newest is None:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("run_key", T.StringType())]))
    key = newest.removeprefix("run_key=")
    return spark.read.schema(schema).parquet(f"{path}/{newest}").withColumn("run_key", F.lit(key))
