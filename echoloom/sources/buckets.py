"""Layers bucketed by key, so that later runs join them without moving a row.

The bucket of a row is the hash partition of its key, and each bucket is one file. A catalog entry only says so; it is made anew by whoever
reads, so the layer outlives the session and the catalog that wrote it. Rows without a key match nothing and would all meet in one
bucket: they lie beside the buckets, as they come.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYED, KEYLESS = "keyed", "keyless"


def write_layer(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write a layer in ``buckets`` buckets of ``key``, replacing what is at ``path``; two tables that join share key type and number.

    A key should be rare in the table, as identifiers are: all its rows lie in one bucket.
    """
    table = _name(path)
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    keyed = df.filter(F.col(key).isNotNull()).repartition(buckets, key)
    keyed.write.mode("overwrite").option("path", f"{path}/{KEYED}").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
    df.filter(F.col(key).isNull()).write.mode("overwrite").parquet(f"{path}/{KEYLESS}")


def read_keyed(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> DataFrame:
    """The rows with a key, known to Spark as bucketed."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    table = _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    location = f"{path}/{KEYED}".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    return spark.table(table)


def read_keyless(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows without a key."""
    return spark.read.schema(schema).parquet(f"{path}/{KEYLESS}")


def _name(path: str) -> str:
    """A catalog name for a path; the table there is external, so dropping the name leaves the files."""
    return f"layer_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}"
