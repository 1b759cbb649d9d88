"""MinHash near-dedup whose banded candidates are verified with odd sketches, then on the full sets.

A document's set is its distinct runs of five words (fewer words: the whole sequence). Two documents are linked if the Jaccard
similarity of their sets is 0.75 or more; a component of links is one group, named by its smallest id.

1. One pass over the texts makes per document the size and a 128-bit digest of its set (sums over two independent hashes that are no
   polynomials of the letters), ``BANDS`` band keys of ``ROWS`` MinHash
   samples each, and an odd sketch: all samples folded into a bitmap by parity.
2. Documents with equal sets form a class; only its row with the smallest (id, row number) goes on. Copies never meet in pairs.
3. Documents with a band key in common are candidates. First each is paired with one centre of its bucket only, another
   one in every band, so each meets many centres and a large group of near copies grows together without its pairs.
   The population count of the XOR of two sketches estimates how many samples differ, precisely at high similarity; pairs
   that cannot reach the threshold end here. So do those whose parity bitmaps of the whole sets differ in more bits than sets
   of their sizes may differ in elements, which loses nothing. The rest are confirmed on their full sets.
4. Candidates that are still in different components are then paired as well, under the sketch test within the join, so no link
   is lost to the choice of centres. Such a comparison takes microseconds and emits nothing. The documents of buckets with more
   than ``CROWDED`` of them per document, as a line that very many documents share can make them, are not compared there. They meet
   at their rarest shingles, where every two of them at the threshold have one in common.

All joins whose sides grow with the table are merge joins, at every size, so a small run shows the plan of a large one; adaptive
execution splits what is skewed.

With 48 bands of 5 samples a pair at the threshold is missed with a probability of 2.3e-6, a pair at 0.85
with 5e-13; crowded buckets add nothing to that. The sketch test lies six standard deviations beyond the threshold. Nothing is capped.

A null or empty text, or one without words, has an empty set and is linked with nothing; a null id is the largest one. Each row
is a document with a number of its own, so rows that share an id, or have none, are told apart. One row of each group is kept, the
first by (id, row number). Every row of the input is a row of the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoloom.llm import words as W
from echoloom.llm.common import annotated, written
from echoloom.llm.components import connected_components

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 48, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
#: Bits of the parity bitmap of a whole set.
SET_BITS = 2048
CROWDED = 1000
#: Shares into which the classes of one component are dealt.
SALTS = 32
#: What is compared of two documents, and the short names of these columns on either side.
FACTS = (("n_shingles", "n"), ("sketch", "sketch"), ("parity", "parity"))

SIGNATURE = "n_shingles long, digest_sum long, digest_other long, bands array<long>, sketch array<long>"


def sketch_bound(samples: int = SAMPLES, bits: int = SKETCH_BITS, similarity: float = PERCENT / 100, sigmas: float = 6.0) -> int:
    """Largest population count of the XOR that a pair at ``similarity`` shows, ``sigmas`` standard deviations out."""
    differ = samples * (1 - similarity)
    spread = math.sqrt(samples * similarity * (1 - similarity))
    mean = lambda d: bits / 2 * (1 - (1 - 2 / bits) ** (2 * d))
    slope = mean(differ + 1) - mean(differ)
    folding = mean(differ) - bits / 4 * (1 - (1 - 4 / bits) ** (2 * differ))
    return math.ceil(mean(differ) + sigmas * math.sqrt((slope * spread) ** 2 + max(folding, 1.0)))


def _families() -> tuple[np.ndarray, np.ndarray]:
    numbers = W.mixed(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64))
    return (numbers[:SAMPLES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (numbers[SAMPLES:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(part: W.Slice, shingle: int = SHINGLE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The sorted distinct shingle hashes of each text of a slice, and a second, independent hash of the same shingles."""
    words = W.Words(part, W.non_space_bytes(), W.ascii_lower())
    one, two = words.strong_hash(1), words.strong_hash(2)
    runs, others = W.run_hash(one, shingle), W.run_hash(two, shingle)
    sets, seconds = [], []
    for first, last in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        n = last - first
        if n >= shingle:
            order = np.argsort(runs[first : last - shingle + 1])
            found = runs[first : last - shingle + 1][order]
            new = np.concatenate(([True], found[1:] != found[:-1]))
            sets.append(found[new])
            seconds.append(others[first : last - shingle + 1][order[new]])
        else:
            # The number of words is part of the hash, so that no short text equals a shingle of a longer one.
            sets.append(W.mixed(W.run_hash(one[first:last], n) + np.uint64(n)) if n else np.zeros(0, np.uint64))
            seconds.append(W.mixed(W.run_hash(two[first:last], n) + np.uint64(n)) if n else np.zeros(0, np.uint64))
    return sets, seconds


def signatures(sets: list[np.ndarray], seconds: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Sizes, both digests (one of each hash), band keys and sketches of some sets."""
    seconds = sets if seconds is None else seconds
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    n = len(sets)
    sums, others = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    bands, sketch = np.zeros((n, BANDS), np.uint64), np.zeros((n, SKETCH_BITS // 64), np.uint64)
    if len(full):
        values = np.concatenate([sets[i] for i in full])
        starts = np.cumsum(sizes[full]) - sizes[full]
        spread = W.mixed(values)
        sums[full] = np.add.reduceat(spread, starts)
        others[full] = np.add.reduceat(W.mixed(np.concatenate([seconds[i] for i in full])), starts)
        short = (spread >> np.uint64(32)).astype(np.uint32)
        odd, flip = _families()
        samples = np.empty((SAMPLES, len(full)), np.uint32)
        for i in range(SAMPLES):
            samples[i] = np.minimum.reduceat((short ^ flip[i]) * odd[i], starts)
        wide = samples.astype(np.uint64)
        for band in range(BANDS):
            key = np.full(len(full), band + 1, np.uint64)
            for i in range(band * ROWS, band * ROWS + ROWS):
                key = W.mixed(key + wide[i])
            bands[full, band] = key
        bits = np.zeros((len(full), SKETCH_BITS), np.uint8)
        at = np.arange(len(full))
        for i in range(SAMPLES):
            bits[at, (W.mixed(wide[i] + (np.uint64(i + 1) << np.uint64(32))) % np.uint64(SKETCH_BITS)).astype(np.int64)] ^= 1
        sketch[full] = np.packbits(bits, axis=1).view(np.uint64)
    return [sizes, sums, others, bands, sketch]


def _lists(rows: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), flat)


def _signature_columns(texts: pa.Array) -> list[pa.Array]:
    parts = [signatures(*shingle_sets(part)) for part in W.slices(texts)]
    if not parts:
        empty = pa.array([], pa.int64())
        lists = pa.array([], pa.list_(pa.int64()))
        return [empty, empty, empty, lists, lists]
    sizes, sums, others, bands, sketch = (np.concatenate(x) for x in zip(*parts, strict=True))
    return [pa.array(sizes), pa.array(sums.view(np.int64)), pa.array(others.view(np.int64)), _lists(bands), _lists(sketch)]


def _set_column(texts: pa.Array) -> list[pa.Array]:
    sets = [s.view(np.int64) for part in W.slices(texts) for s in shingle_sets(part)[0]]
    ends = np.cumsum([0, *map(len, sets)])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), _lists(set_parities(sets))]


def set_parities(sets: list[np.ndarray], at_once: int = 256) -> np.ndarray:
    """The parity bitmap of each whole set: a bit counts its elements modulo 2."""
    out = np.zeros((len(sets), SET_BITS // 64), np.uint64)
    for first in range(0, len(sets), at_once):
        some = sets[first : first + at_once]
        place = np.concatenate([(W.mixed(s.view(np.uint64)) >> np.uint64(20)) % np.uint64(SET_BITS) for s in some]).astype(np.int64)
        owner = np.repeat(np.arange(len(some)), [len(s) for s in some])
        odd = np.bincount(owner * SET_BITS + place, minlength=len(some) * SET_BITS).astype(np.uint8) & 1
        out[first : first + len(some)] = np.packbits(odd.reshape(len(some), SET_BITS), axis=1).view(np.uint64)
    return out


def _differing(a: str, b: str):
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


def _close() -> Column:
    """Whether a and b may reach the threshold, by their sizes, their sketches and the parities of their sets.

    The bitmaps of two sets differ in no more bits than the sets do in elements, and at a similarity of p % the sets differ in at
    most (100 - p) / (100 + p) of the sum of their sizes.
    """
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    whole = _differing("parity_a", "parity_b") * (100 + PERCENT) <= (F.col("n_a") + F.col("n_b")) * (100 - PERCENT)
    return sizes & (_differing("sketch_a", "sketch_b") <= sketch_bound()) & whole


def _merge(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def _confirmed(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left, right = sets.select(F.col("node").alias("a"), F.col("items").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("items").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    reached = shared * 100 >= (F.size("set_a") + F.size("set_b") - shared) * PERCENT
    return written(_merge(_merge(pairs, right, "b"), left, "a").filter(reached).select("a", "b"), label)


def _rare_shingles(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cells (band, node, component) in which every pair of ``nodes`` at the threshold meets: the rarest shingles of each.

    With all shingles in one order, by the number of nodes that hold them, two sets at the threshold share one of the first
    (100 - p) % of either, plus one. A shingle that very many nodes hold comes last, so it is a cell only for sets that
    are made of such shingles almost wholly, and those are near copies of one another. Shingles of one node meet nobody but take
    their places in the order.
    """
    items = _merge(sets, nodes, "node").select("node", "component", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    own = Window.partitionBy("node")
    shared = _merge(items, often, "item").select(
        "*", F.row_number().over(own.orderBy("holders", "item")).alias("place"), F.count(F.lit(1)).over(own).alias("m")
    )
    first = F.expr(f"n - m + place <= n * {100 - PERCENT} div 100 + 1")
    return shared.filter(first).select(F.col("item").alias("band"), "node", "component")


def near_duplicates(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text)."""
    numbered = written(docs.select(_row_number(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "near-rows")
    return _grouped(numbered, crowded).select("doc_id", "n_shingles", "component_id", "kept")


def remove_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies, whatever else its rows share."""
    numbered = written(docs.select(_row_number(), F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("doc")), "near-rows")
    found = _grouped(numbered.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text")), CROWDED)
    return _merge(numbered, found.filter("kept").select("row"), "row", "left_semi").select("doc.*")


def _row_number() -> Column:
    """A number of its own for each row; holds only once written."""
    return F.monotonically_increasing_id().alias("row")


def _first(doc_id: str, row: str) -> Column:
    """The smallest (id, row number) of a group; a null id is the largest."""
    return F.min(F.struct(F.isnull(doc_id).alias("unnamed"), F.col(doc_id).alias("doc_id"), F.col(row).alias("row"))).alias("first")


def _grouped(numbered: DataFrame, crowded: int) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept of the written table ``numbered`` (row, doc_id, text)."""
    made = annotated(numbered, _signature_columns, SIGNATURE, carry=["row", "doc_id"])
    made = written(made.select("doc.row", "doc.doc_id", F.expr("* EXCEPT (doc)")), "near-signatures")
    digest = ["n_shingles", "digest_sum", "digest_other"]
    classes = made.filter("n_shingles > 0").groupBy(*digest).agg(_first("doc_id", "row"))
    # A class is known by the number of its first row.
    classes = written(classes.select(*digest, F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("node")), "near-classes")
    heads = _merge(made.withColumnRenamed("row", "node"), classes.select("node"), "node").select("node", "n_shingles", "bands", "sketch")
    heads = written(heads, "near-heads")

    # Band keys look random, so the smallest node under XOR with the key is another document in every band; XOR gives it back.
    placed = heads.select("node", F.explode("bands").alias("band"))
    other = F.col("node").bitwiseXOR(F.col("band"))
    buckets = placed.groupBy("band").agg(F.min(other).alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = written(buckets.select("band", F.col("centre").bitwiseXOR(F.col("band")).alias("centre")), "near-buckets")
    placed = written(_merge(placed, buckets, "band"), "near-placed")
    wanted = written(placed.select("node").distinct(), "near-wanted")
    texts = _merge(numbered.select(F.col("row").alias("node"), "text"), wanted, "node", "left_semi")
    sets = written(annotated(texts, _set_column, "items array<long>, parity array<long>", carry=["node"]).select("doc.node", "items", "parity"), "near-sets")
    facts = written(_merge(heads.select("node", "n_shingles", "sketch"), sets.select("node", "parity"), "node"), "near-facts")

    def of(side: str) -> DataFrame:
        return facts.select(F.col("node").alias(side), *[F.col(old).alias(f"{new}_{side}") for old, new in FACTS])

    first = placed.filter("node != centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    first = _merge(_merge(first, of("b"), "b"), of("a"), "a").filter(_close())
    links = _confirmed(first.select("a", "b"), sets, "near-first")
    joined = connected_components(links)

    # Buckets whose documents are not all of one component yet; pairs: those of different components in a bucket.
    spread = _merge(placed.select("band", "node"), joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = written(spread, "near-spread")
    crowds = spread.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(
        F.sum("n").alias("n"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs")
    )
    mixed = written(crowds.filter("pairs > 0").select("band", (F.col("pairs") > F.col("n") * crowded).alias("dense")), "near-mixed")
    apart = written(_merge(spread, mixed, "band"), "near-apart")
    rare = _rare_shingles(sets, apart.filter("dense").select("node", "component").distinct())
    cells = written(_merge(apart.filter("NOT dense").select("band", "node", "component").unionByName(rare), facts, "node"), "near-cells")
    one = cells.select("band", F.col("node").alias("a"), F.col("component").alias("ca"), *[F.col(old).alias(f"{new}_a") for old, new in FACTS])
    two = cells.select(F.col("band").alias("band_b"), F.col("node").alias("b"), F.col("component").alias("cb"), *[F.col(old).alias(f"{new}_b") for old, new in FACTS])
    apart_pair = (F.col("band") == F.col("band_b")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
    second = _merge(one, two, apart_pair & _close()).select("a", "b").distinct()
    more = _confirmed(written(second, "near-pairs"), sets, "near-second")
    final = connected_components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    # A component is named by the first row of all its classes; very many classes of one component meet its name spread over salts.
    linked = final.unionByName(final.select(F.col("component").alias("node"), "component").distinct())
    linked = written(_merge(linked, classes.select("node", "first_id"), "node"), "near-linked")
    names = linked.groupBy("component").agg(_first("first_id", "node")).select(
        "component", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("kept_row"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    salted = linked.select("node", "component", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    given = _merge(salted, names, ["component", "salt"]).select("node", "component_id", "kept_row")
    alone = F.col("kept_row").isNull()
    named = _merge(classes, given, "node", "left").select(
        *digest, F.when(alone, F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("kept_row", "node").alias("kept_row")
    )
    return _merge(made.select("row", "doc_id", *digest), named, digest, "left").select(
        "row", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("row") == F.col("kept_row"), F.lit(True)).alias("kept"),
    )
