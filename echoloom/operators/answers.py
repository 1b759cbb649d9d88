"""Answers of a model that are kept: what has been answered once is not asked again.

A store is an appended table of prompt digests and accepted answers. Prompts are asked in parts, by digest, and each part is
committed before the next begins, so a run that ends half-way loses one part at most; the next run asks only what the
store does not hold. A prompt without an accepted answer is not stored and is tried again by the next run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom import config
from echoloom.operators.scoring import score_batches
from echoloom.session import make_dir

PARTS = 16
STORE = "digest string, response string"


def read_answers(spark: SparkSession, store: str) -> DataFrame:
    """One answer per digest; two runs at the same time may have stored two, of which the smallest counts."""
    make_dir(spark, store)
    return spark.read.schema(STORE).parquet(store).groupBy("digest").agg(F.min("response").alias("response"))


def answer_prompts(
    prompts: DataFrame,
    model: Callable[[str], str],
    store: str,
    accepts: Callable[[str], bool] | None = None,
    max_retries: int = config.SCORE_MAX_RETRIES,
    parts: int = PARTS,
    concurrency: int | None = None,
) -> DataFrame:
    """``prompts`` with the column ``response`` from the store, after asking for those it does not hold.

    Equal prompts are asked once. ``parts`` is how many jobs the open prompts are dealt to, by digest.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("_digest", F.sha2("prompt", 256))
    for part in range(parts):
        mine = keyed.filter(F.pmod(F.xxhash64("_digest"), F.lit(parts)) == part).select(F.col("_digest").alias("digest"), "prompt")
        open_prompts = mine.dropDuplicates(["digest"]).join(read_answers(spark, store).select("digest"), "digest", "left_anti")
        asked = score_batches(open_prompts, model, accepts, max_retries, concurrency)
        asked.filter(F.col("response").isNotNull()).select("digest", "response").write.mode("append").parquet(store)
    answers = read_answers(spark, store).withColumnRenamed("digest", "_digest")
    return keyed.join(answers, "_digest", "left").select(*prompts.columns, "response")
