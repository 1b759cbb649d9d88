"""Session settings and the shared folder in which jobs keep their intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "echoloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs expect; keyword arguments use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return configured.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The one folder below it in which this application keeps its intermediate tables."""
    return f"{shared_dir(spark)}/echoloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the application's folder that nothing has used yet."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _hadoop_path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove_scratch(spark: SparkSession) -> None:
    """Delete the application's intermediate tables, once no result that reads them is needed any more."""
    files, target = _hadoop_path(spark, run_dir(spark))
    files.delete(target, True)


def make_dir(spark: SparkSession, path: str) -> None:
    """Make a folder on the file system that its path names."""
    files, target = _hadoop_path(spark, path)
    files.mkdirs(target)


def is_dir(spark: SparkSession, path: str) -> bool:
    files, target = _hadoop_path(spark, path)
    return files.getFileStatus(target).isDirectory()


def newest_folder(spark: SparkSession, path: str, prefix: str) -> str | None:
    """The name of the folder below ``path`` that changed last, of those whose names start with ``prefix``."""
    files, target = _hadoop_path(spark, path)
    found = [(s.getModificationTime(), s.getPath().getName()) for s in files.listStatus(target) if s.isDirectory()]
    return max(((at, name) for at, name in found if name.startswith(prefix)), default=(0, None))[1]


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a layer to the shared folder and go on from the written table.

    Cuts the lineage, survives the loss of executors, and lets several readers share one
    evaluation of an expensive chain.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)

