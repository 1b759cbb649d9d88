"""One registered query per operator: whole tables, production parameters, digest columns of the operator's results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.llm import chat, decontaminate, exact_dedup, language, licenses, mixing, near_dedup, negatives, secrets, sentence_pieces, token_output, toxicity, turns
from echoloom.llm.common import is_held_out, is_training, table, written
from workload.shipping import ship_packages


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_packages(spark)
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select(
        "doc.doc_id", *[secrets.count_of(kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(secrets.as_text(kinds=secrets.BASE_KINDS), 256).alias("base_sha256"), secrets.as_text().alias("spans"),
    )


def op2_sentence_pieces(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    ship_packages(spark)
    made = sentence_pieces.encode(table(spark, sf_dir, "documents"), model_path or public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id"])
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return made.select("doc.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    ship_packages(spark)
    path = token_output.write_shards(table(spark, sf_dir, "documents"), model_path or public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read_documents(spark.read.schema(token_output.SHARD).parquet(path))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarized(*licenses.scan_licenses(table(spark, sf_dir, "documents")))


#: A conversation whose texts are made of control strings.
CONTROL_CASE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_packages(spark)
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    case = spark.createDataFrame(CONTROL_CASE, "conv_id long, turn long, role string, text string")
    nodes = chat.linear_trees(rows.unionByName(case))
    output = written(chat.formatted_turns(nodes), "chat-output")
    found = chat.digests(chat.parsed_turns(output))
    conv_id = F.when(F.col("tree") != "null", F.col("tree").cast("long")).alias("conv_id")
    return found.select(conv_id, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_packages(spark)
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(is_training()))
    found = language.predict(docs, model, carry=["doc_id"]).select("doc.doc_id", "lang_pred", "score")
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_packages(spark)
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_packages(spark)
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    hits = decontaminate.hit_words()
    return found.select(
        "doc.doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_packages(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(is_training()))
    found = toxicity.score(docs, model, carry=["doc_id"]).select("doc.doc_id", "score")
    return found.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_packages(spark)
    return turns.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_packages(spark)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.whole_vectors(table(spark, sf_dir, "embeddings"), label=moved)
    return negatives.mine(vectors, F.col("id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (op1_secrets, op2_sentence_pieces, op3_exact_dedup, op4_token_output, op5_licenses, op6_chat, op7_language, op8_near_dedup, op9_decontaminate, op10_toxicity, op11_mixing, op12_conversation_repair, op13_hard_negatives)
}
