"""Exact dedup over an extendible-hash index kept on shared files.

Texts are equal when they are identical after each run of white space became one space. The index
maps a 64-bit hash of that form to the rows that hold it:

* the *directory* starts with one slot; as long as a bucket holds more than ``bucket_keys`` distinct hashes
  the directory doubles and the bucket splits by its next leading hash bit, down to ``MAX_DEPTH`` bits. Copies of
  one text are one key, so a hot text never splits a bucket. All depths come from one small count per
  leading-bits prefix;
* *owner tasks* each write one range of (bucket, key) to the index files. The directory is read back from these files; every
  row finds its bucket by its slot there, and meets the entries of that bucket only;
* rows of one key form a *chain*: the tasks that own a bucket's key compare their bytes with those of the chain's head (the
  smallest id); rows that differ although their hash agrees go on to the next link, until none is left.

Only DataFrame functions are used. Copies collapse to one entry per map task before any shuffle by key, and the
joins that bring rows and entries together are by (bucket, key), so adaptive execution can split the hot ones. Only the slots
are broadcast: at most 2**16 rows of two numbers.

Nulls count as empty texts. A null id is the largest one, larger than every long. Rows repeated with the same id are rows of one
group and all of them stay if their id is the smallest. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.llm.common import whole_text, written

#: Leading hash bits that the directory may use: at most 2**16 slots.
MAX_DEPTH = 16
#: Shares into which the rows of one group are dealt.
SALTS = 32
#: Where an entry of the index lies.
PLACE = ["bucket", "key"]
#: Ids are compared as wider numbers, in which this one stands for a null id: beyond every long, equal to itself.
ID, NO_ID = "decimal(20,0)", str(2**63)


def normalized(text: Column) -> Column:
    """Each run of the six ASCII white-space characters becomes one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def directory(keys: DataFrame, bucket_keys: int, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Buckets as (depth, prefix, n_keys): the prefixes at which splitting stops.

    ``keys`` has one row per distinct ``key``. A prefix is a bucket if it fits (or cannot split further)
    and its parent did not fit.
    """
    finest = keys.groupBy(F.expr(f"shiftrightunsigned(key, 64 - {max_depth})").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    levels = finest.select("n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"), "slot").groupBy(
        "depth", F.expr(f"shiftright(slot, {max_depth} - depth)").alias("prefix")
    ).agg(F.sum("n").alias("n_keys"))
    full = F.col("n_keys") > bucket_keys
    parents = levels.filter(full & (F.col("depth") < max_depth)).select(
        (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")
    )
    root = levels.filter("depth = 0").select("depth", "prefix")
    leaf = ~full | (F.col("depth") == max_depth)
    return levels.filter(leaf).join(parents.unionByName(root), ["depth", "prefix"]).select("depth", "prefix", "n_keys")


def slots(buckets: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The directory itself: every slot of ``max_depth`` bits with its bucket's number (first slot) and depth."""
    span = F.expr(f"shiftleft(1L, {max_depth} - depth)")
    first = F.col("prefix") * span
    return buckets.select(F.explode(F.sequence(first, first + span - 1)).alias("slot"), first.alias("bucket"), "depth")


def with_slot(df: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    return df.withColumn("slot", F.expr(f"shiftrightunsigned(key, 64 - {max_depth})"))


def read_directory(index: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(slot, bucket) of the index files, written once; a bucket is numbered by its first slot."""
    prefix = F.expr(f"shiftrightunsigned(bucket, {max_depth} - depth)")
    buckets = index.select("bucket", "depth").distinct().select("depth", prefix.alias("prefix"))
    return written(slots(buckets, max_depth).select("slot", "bucket"), "dedup-directory")


def located(df: DataFrame, table: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Rows that have a ``key`` with the bucket that the directory names for it."""
    return with_slot(df, max_depth).join(F.broadcast(table), "slot").drop("slot")


def build_index(entries: DataFrame, bucket_keys: int = 100_000, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Index entries (bucket, depth, key, head, n_rows) written to the shared folder, by owner tasks.

    ``entries`` has (doc_id, key). The slot table joined here has at most 2**max_depth rows.
    """
    keys = written(entries.groupBy("key").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n_rows")), "dedup-keys")
    table = slots(directory(keys, bucket_keys, max_depth), max_depth)
    placed = with_slot(keys, max_depth).join(table, "slot")
    owned = placed.select("bucket", "depth", "key", "head", "n_rows").repartitionByRange("bucket", "key")
    return written(owned.sortWithinPartitions("bucket", "key"), "dedup-index")


def exact_dedup(docs: DataFrame, bucket_keys: int = 100_000, key=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, chain (0, or the link
    of the chain that a text with a colliding key came to).

    ``key`` makes the 64-bit key of the normalised text; tests pass one that collides.
    """
    body = docs.select(F.coalesce(F.col("doc_id").cast("long").cast(ID), F.lit(NO_ID).cast(ID)).alias("doc_id"), normalized(whole_text()).alias("body"))
    rows = written(
        body.select("doc_id", key(F.col("body")).alias("key"), F.sha2("body", 256).alias("text_sha256")),
        "dedup-rows",
    )
    index = build_index(rows.select("doc_id", "key"), bucket_keys)
    table = read_directory(index)
    several = index.filter("n_rows > 1").select(*PLACE, "head")
    # Only rows whose key is shared take part in the comparison of bytes; all other texts end here. The shared keys grow with
    # the table, so they are never broadcast; on large tables Spark adds its own Bloom filter to this join.
    shared = several.select(*PLACE).hint("merge")
    keyed = located(body.select("doc_id", "body", key(F.col("body")).alias("key")), table)
    open_rows = written(keyed.join(shared, PLACE, "left_semi"), "dedup-shared")
    chain, members = 0, None
    while True:
        heads = written(
            open_rows.join(several.withColumnRenamed("head", "doc_id"), [*PLACE, "doc_id"]).groupBy(*PLACE, "doc_id").agg(F.min("body").alias("head_body")),
            "dedup-heads",
        ).withColumnRenamed("doc_id", "head")
        pairs = open_rows.join(heads, PLACE)
        equal = written(pairs.filter("body = head_body").select(*PLACE, "doc_id", "head", F.sha2("body", 256).alias("text_sha256"), F.lit(chain).alias("chain")), "dedup-equal")
        members = equal if members is None else members.unionByName(equal)
        open_rows = written(pairs.filter("body != head_body").select(*PLACE, "doc_id", "body"), "dedup-open")
        if open_rows.isEmpty():
            break
        several = open_rows.groupBy(*PLACE).agg(F.min("doc_id").alias("head"))
        chain += 1
    # A hot group has very many members: they meet its size spread over salts. A lone row is found by place and id, not place alone.
    group = [*PLACE, "chain", "salt"]
    sizes = members.groupBy(*PLACE, "chain").agg(F.count(F.lit(1)).alias("group_size")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    repeated = salted.join(sizes.hint("merge"), group).select("doc_id", F.col("head").alias("keep_id"), "group_size", "text_sha256", "chain")
    alone = index.filter("n_rows = 1").select(*PLACE, F.col("head").alias("doc_id"))
    single = located(rows, table).join(alone.hint("merge"), [*PLACE, "doc_id"], "left_semi").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256", F.lit(0).alias("chain")
    )
    real = lambda name: F.when(F.col(name) != F.lit(NO_ID).cast(ID), F.col(name)).cast("long").alias(name)
    return single.unionByName(repeated).select(
        real("doc_id"), real("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256", "chain"
    )
