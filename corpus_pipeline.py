"""The training-data pipeline: documents through five stages, each written and read again as the next one's input.

Toxic documents go; of equal texts one stays; of each group of near copies one stays; documents with a passage of the benchmark
go; what is left is encoded. The first four return the columns they got. Exact copies are found again by id and content, near copies
by a number of the row, null ids included; columns beyond those of ``documents`` are kept as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoloom.llm import decontaminate, exact_dedup, near_dedup, sentence_pieces, toxicity
from echoloom.llm.common import is_training, table, whole_text, written
from workload.shipping import ship_packages


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels, then leave out what is scored at the threshold or more."""
    ship_packages(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(is_training()))
    return toxicity.remove_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the smallest id (any of them where ids are equal too)."""
    chosen = exact_dedup.exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.sha2(exact_dedup.normalized(whole_text()), 256).alias("sha"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha"))
    found = rows.join(chosen.hint("merge"), same, "left_semi").select("doc", "sha", F.col("doc.doc_id").alias("id"))
    nth = F.row_number().over(Window.partitionBy("id", "sha").orderBy("id"))
    return found.withColumn("nth", nth).filter("nth = 1").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (one of them where ids are equal too)."""
    ship_packages(spark)
    return near_dedup.remove_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents without a passage of the benchmark."""
    ship_packages(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and text_sha256 (of the decoded text) of what is left."""
    ship_packages(spark)
    made = sentence_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id"])
    return made.select("doc.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentence_pieces", encode),
]

#: A trained model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
