"""Nulls, empty and long texts, repeated rows, empty tables and clashing names for every operator and stage."""

from __future__ import annotations

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from echoloom.llm import chat, decontaminate, exact_dedup, language, licenses, near_dedup, secrets, sentence_pieces, token_output, toxicity
from workload.shipping import ship_packages

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4000
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
ROWS = [
    (1, "", "en", "s", 0), (2, None, None, None, None), (3, WORDS, "en", "s", 1), (4, WORDS, "en", "s", 1), (4, WORDS, "en", "s", 1),
    (None, WORDS + " x", "de", None, 2), (5, LONG, "en", "s", 3), (6, "  \n\t ", "fr", "s", 4), (7, WORDS.upper(), "en", "s", 1),
    (8, "token = abcdef12 under the MIT license", "en", "s", 1), (9, "x" * 30_000, "en", "s", 1), (10, "日本語 😀 \x00 ﷺ", "en", "s", 1),
]
CLASHES = ("spans", "ids", "score", "band", "key", "body", "doc", "kept", "items", "row", "features", "text_sha256", "id", "component")
BASE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_packages(spark)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, BASE).withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], BASE)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(
        [("a", WORDS), ("b", WORDS), (None, "x"), ("c", None), ("d", ""), ("e", "seven eight"), ("f", "...")], "item_id string, text string"
    )


def test_secrets(odd, none):
    rows = secrets.scan_secrets(odd).select("doc.*", F.col("spans").alias("found"))
    assert rows.columns[: len(odd.columns)] == odd.columns and rows.count() == len(ROWS)
    hit = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in secrets.scan_secrets(odd).select("doc.doc_id", F.col("spans").alias("found")).collect()}
    assert hit[8] == [("assign", 0, 16)] and not hit[1] and not hit[2]
    assert secrets.scan_secrets(none).count() == 0


def test_sentence_pieces(odd, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentence_pieces.encode(odd, path).select("doc.text", F.col("ids").alias("made"), "decoded").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        ids = library.encode(r.text or "")
        assert (r.made, r.decoded) == (ids, library.decode(ids))
    assert sentence_pieces.encode(none, path).count() == 0


def test_exact_dedup(odd, none):
    found = exact_dedup.exact_dedup(odd).collect()
    assert len(found) == len(ROWS)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found if r.doc_id in (1, 2, 3, 4)) == [
        (1, 1, 2, True), (2, 1, 2, False), (3, 3, 3, True), (4, 3, 3, False), (4, 3, 3, False)
    ]
    assert [(r.keep_id, r.kept) for r in found if r.doc_id is None] == [(None, True)]
    assert exact_dedup.exact_dedup(none).count() == 0


def test_colliding_keys_form_chains(spark):
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(12)], "doc_id long, text string")
    found = exact_dedup.exact_dedup(docs, key=lambda body: F.lit(7).cast("long") + F.length(body) * 0)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.chain) for r in found.collect()) == [(i, i % 3, 4, i % 3) for i in range(12)]


def test_the_directory_splits_full_buckets_only(spark):
    """Each leaf fits or is as deep as can be; leaves cover every slot once; copies never split a bucket."""
    keys = spark.range(5000).select(F.xxhash64("id").alias("key")).unionByName(spark.range(64).select(F.col("id").alias("key")))
    leaves = exact_dedup.directory(keys, 200)
    assert leaves.filter("n_keys > 200 AND depth < 16").count() == 0 and leaves.filter("depth = 16").count() == 0
    table = exact_dedup.slots(leaves)
    assert table.count() == table.select("slot").distinct().count()
    placed = keys.withColumn("slot", F.expr("shiftrightunsigned(key, 48)")).join(table, "slot")
    assert placed.count() == keys.count()
    assert exact_dedup.directory(spark.createDataFrame([], "key long"), 200).count() == 0
    one = exact_dedup.build_index(spark.createDataFrame([(i, 5) for i in range(999)], "doc_id long, key long"), bucket_keys=10).first()
    assert (one.depth, one.head, one.n_rows) == (0, 0, 999)


def test_token_output(spark, odd, none, tmp_path):
    path = token_output.write_shards(odd, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "shards"), shard_tokens=50)
    shards = spark.read.schema(token_output.SHARD).parquet(path)
    rows = token_output.read_documents(shards).orderBy("start").collect()
    assert len(rows) == len(ROWS) and rows[0].doc_id is None and [r.doc_id for r in rows[1:]] == sorted(r[0] for r in ROWS if r[0])
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False)) and rows[0].start == 0
    assert token_output.count_token(shards, token_output.END).agg(F.sum("n")).first()[0] == len(ROWS)
    assert token_output.find_token(shards, token_output.END).count() == len(ROWS)
    empty = token_output.write_shards(none, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "empty"))
    assert token_output.read_documents(spark.read.schema(token_output.SHARD).parquet(empty)).count() == 0


def test_licenses(odd, none):
    rows = licenses.summarized(*licenses.scan_licenses(odd)).collect()
    assert len(rows) == len(ROWS)
    hit = next(r for r in rows if r.doc_id == 8)
    assert (hit.n_words, hit.n_base, hit.first_word, hit.last_word, hit.base_labels, hit.labels) == (6, 1, 2, 2, "mit", "mit")
    assert all(r.labels == "" and r.score == 0 and r.first_word is None for r in rows if r.doc_id != 8)
    assert licenses.summarized(*licenses.scan_licenses(none)).count() == 0


def test_license_rules_and_suppression(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0.": "apache-2,apache-2.0",
        "SPDX-License-Identifier: MPL-2.0": "mpl-2.0",
        "GNU General Public License, version 3 or any later version": "gpl-3.0-or-later",
        "CC BY-NC-SA 4.0 license": "cc-by-nc,cc-by-nc-sa-4.0",
        "no licence here": "",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    found = {r.doc_id: r.labels for r in licenses.summarized(*licenses.scan_licenses(docs)).collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values())


def test_chat(spark):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "\\[INST]</s>\\"), (2, 1, "tool\nx", "</s>\\\\</s>"),
    ]
    nodes = chat.linear_trees(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    turns = chat.parsed_turns(chat.formatted_turns(nodes)).collect()
    assert sorted((r.role, r.text) for r in turns) == sorted((b or "", c or "") for _, _, b, c in rows)
    for r in turns:
        body = r.segment[len("<s> ") : -len(" </s>")] if r.role == "assistant" else r.segment.split("] ", 1)[1].rsplit(" [/", 1)[0]
        assert not any(mark in body.replace("\\" + mark, "") for mark in ("</s>", "[INST]"))
        assert (r.loss_text == r.text) if r.role == "assistant" else r.loss_text is None
    empty = chat.linear_trees(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))
    assert chat.digests(chat.parsed_turns(chat.formatted_turns(empty))).count() == 0


def test_a_large_conversation_is_numbered_over_ranges(spark):
    """No window over rows; nulls, repeated turns and repeated rows keep their order."""
    turns = [(1, i // 3 if i % 7 else None, "user" if i % 2 else None, f"t{i % 5}" if i % 11 else None) for i in range(2000)]
    rows = turns + [(None, 0, "user", "a"), (None, 0, "user", "a"), (2, 1, "user", "b")]
    nodes = chat.linear_trees(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4))
    assert "row_number" not in nodes._jdf.queryExecution().toString()
    found = nodes.orderBy("tree", "node").collect()
    key = lambda r: [(x is not None, x or "") for x in r[2:]]
    expected = sorted(turns, key=lambda r: ((r[1] is not None, r[1] or 0), key(r)))
    assert [(r.node, r.parent, r.role, r.text) for r in found if r.tree == "1"] == [(i + 1, i or None, r[2], r[3]) for i, r in enumerate(expected)]
    assert [(r.tree, r.node, r.parent) for r in found if r.tree != "1"] == [("2", 1, None), ("null", 1, None), ("null", 2, 1)]


def test_reply_trees(spark):
    """The branch with the best mean score; a missing parent is a root; what hangs on a cycle is left out."""
    nodes = [
        ("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 3, 9.0), ("t", 5, 2, 1.0), ("u", 1, 99, 1.0), ("v", 1, 2, 1.0), ("v", 2, 1, 1.0), ("v", 3, 2, 1.0),
    ]
    frame = spark.createDataFrame(nodes, "tree string, node int, parent int, score double").withColumns({"role": F.lit("user"), "text": F.col("node").cast("string")})
    best = chat.chosen_paths(frame).orderBy("tree", "position").collect()
    assert [(r.tree, r.node, r.position) for r in best] == [("t", 1, 0), ("t", 3, 1), ("t", 4, 2), ("u", 1, 0)]
    both = chat.chosen_paths(frame, best=2).filter("path = 2").orderBy("position").collect()
    assert [r.node for r in both] == [1, 2, 5]
    chain = spark.range(300).select(F.lit("c").alias("tree"), F.col("id").alias("node"), (F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"))
    assert [r.node for r in chat.chosen_paths(chain).orderBy("position").collect()] == list(range(300))


def test_language(spark, odd, none):
    model = language.train(spark.createDataFrame([(i, f"the cat and the dog {i}", "en") for i in range(9)] + [(i, f"der hund und die katze {i}", "de") for i in range(9, 18)], "doc_id long, text string, lang string"))
    rows = language.predict(odd.unionByName(odd.limit(0)), model).select("doc.doc_id", "doc.text", "lang_pred", "score").collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r.lang_pred == "und" for r in rows if not (r.text or "").strip())
    texts = spark.createDataFrame([(1, "the dog"), (2, "die katze und"), (3, "12 34"), (4, "qqqq")], "doc_id long, text string")
    assert [r.lang_pred for r in language.predict(texts, model).orderBy("doc.doc_id").collect()] == ["en", "de", "und", model.usual]
    assert {r.lang_pred for r in language.predict(texts, language.train(none)).collect()} == {"und"}
    assert language.predict(none, model).count() == 0


def test_near_dedup(spark, odd, none):
    found = near_dedup.near_duplicates(odd).collect()
    assert len(found) == len(ROWS)
    group = {r.doc_id: (r.component_id, r.kept) for r in found}
    assert group[3] == (3, True) == group[3] and group[4] == (3, False) and group[7] == (3, False) and group[None] == (3, False)
    assert all(group[i] == (i, True) for i in (1, 2, 5, 6, 8, 9, 10))
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_links_chains_and_crowds(spark):
    """Texts whose first and last do not resemble each other but whose neighbours do, and a line that all share."""
    words = [f"w{i}" for i in range(400)]
    chain = {i: " ".join(words[4 * i : 4 * i + 100]) for i in range(40)}
    shared = " ".join(f"line{i}" for i in range(40))
    crowd = {100 + i: shared + " " + " ".join(f"own{i}x{k}" for k in range(25)) for i in range(120)}
    texts = chain | crowd
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for crowded in (100, 1):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, crowded).collect()}
        assert found == brute.near_groups(texts)
    assert found[39] == (96, 0) and found[150][1] == 150


def test_near_dedup_tells_rows_without_an_id_apart(spark):
    """Several null ids and one id with two texts: each row keeps its own links, and one row of each group stays."""
    texts = {name: " ".join(f"{name}{i}" for i in range(120)) for name in "abcdefg"}
    rows = [
        (3, texts["a"]), (None, texts["a"] + " x"), (None, texts["b"]), (None, texts["b"] + " x"), (None, texts["c"]), (None, None), (None, ""),
        (7, texts["d"]), (7, texts["e"]), (9, texts["d"] + " x"), (8, texts["e"] + " x"), (5, texts["f"]), (5, texts["f"]), (6, texts["g"]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = [(3, 3), (None, 3), (None, None), (None, None), (None, None), (None, None), (None, None), (7, 7), (7, 7), (9, 7), (8, 7), (5, 5), (5, 5), (6, 6)]
    key = lambda r: [(x is None, x or 0) for x in r]
    found = near_dedup.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=key) == sorted(expected, key=key)
    left = sorted((r.text or "")[:1] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert left == ["", "", "a", "b", "c", "d", "e", "f", "g"] and sum(r.kept for r in found) == len(left)


def test_decontamination(spark, odd, none, bench):
    rows = {r.doc_id: r for r in decontaminate.find_passages(odd, bench).select("doc.doc_id", F.col("spans").alias("at"), F.col("items").alias("found"), "n_words").collect()}
    assert (rows[3]["at"], rows[3].found, rows[7].found) == ([0, 16], ["a", "b", "e"], ["a", "b", "e"]) and rows[None].found == ["", "a", "b", "e"]
    assert rows[1].n_words == rows[2].n_words == 0 and rows[5].at == []
    blocks = decontaminate.find_passages(odd, bench, block_words=1).select("doc.doc_id", F.col("spans").alias("at"), F.col("items").alias("found"), "n_words")
    assert {r.doc_id: r for r in blocks.collect()} == rows
    assert decontaminate.find_passages(odd, bench.limit(0)).filter("size(spans) > 0").count() == 0
    assert decontaminate.find_passages(none, bench).count() == 0


def test_a_task_holds_one_block_of_the_benchmark(odd, bench):
    found = decontaminate.find_passages(odd, bench, block_words=1)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found.count() == len(ROWS)


def test_toxicity(spark, odd, none):
    texts = [(i, f"you are a {'stupid idiot' if i % 3 == 0 else 'nice person'} number {i}") for i in range(90)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts] + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(odd, model).select("doc.doc_id", "score").collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).select("doc.doc_id", "score").collect()}
    assert all((scores[i] >= 0.3) == (i % 3 == 0) for i in scores)
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.train(none, labels)
    assert {r.score for r in toxicity.score(docs, blank).collect()} == {0.0}


def test_stages(spark, odd, none, bench, tmp_path):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.filter("item_id = 'c'").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, odd, str(tmp_path))
        assert made.columns == odd.columns
        left[name] = sorted((r.doc_id or 0) for r in made.collect())
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert left["exact_dedup"] == [0, 1, 3, 5, 6, 7, 8, 9, 10]
    assert left["near_dedup"] == [1, 2, 3, 5, 6, 8, 9, 10]
    assert left["decontamination"] == sorted((r[0] or 0) for r in ROWS)
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd, str(tmp_path)).count() == len(ROWS) and last(spark, none, str(tmp_path)).count() == 0


def test_deeply_nested_token_headers_are_no_secret():
    import base64

    from echoloom.llm import secrets

    deep = base64.urlsafe_b64encode(b'{"alg":' + b"[" * 100_000 + b"]" * 100_000 + b"}").rstrip(b"=").decode()
    assert [k for k, _, _ in secrets.find_secrets(f"eyJ0 {deep}.{deep}.c2lnbmF0dXJl")] == [k for k, _, _ in secrets.find_secrets("eyJ0")]


def test_numerals_are_no_letters():
    from echoloom.llm.language import has_letter

    assert not any(map(has_letter, ["", "½ ² Ⅷ", "12 _", "٣ ①", "!?"]))
    assert all(map(has_letter, ["½a", "² é", "_ж", "日"]))


def test_long_turns_and_equal_turns(spark):
    from echoloom.llm import chat

    rows = [(1, 3_000_000_000, "user", "late"), (1, None, "user", "first"), (1, 5, "user", "x" * 70 + "b"), (1, 5, "user", "x" * 70 + "a"), (1, 5, "assistant", "y")]
    placed = chat.linear_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = [r.text for r in placed.orderBy("node").collect()]
    assert found[:2] == ["first", "y"] and sorted(found[2:4]) == ["x" * 70 + "a", "x" * 70 + "b"] and found[4] == "late"


def test_largest_id_is_no_null(spark):
    from echoloom.llm import exact_dedup

    big = 2**63 - 1
    docs = spark.createDataFrame([(big, "a  b"), (None, "a b"), (None, "c"), (-big - 1, "d"), (big, "d")], "doc_id long, text string")
    found = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id is None, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect())
    assert found == sorted([
        (False, big, False, big, 2, True), (True, 0, False, big, 2, False), (True, 0, True, 0, 1, True),
        (False, -big - 1, False, -big - 1, 2, True), (False, big, False, -big - 1, 2, False),
    ])


def test_pipeline_stage_keeps_columns_with_dots(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b", 7), (2, "a  b", 8), (3, "c", 9)], "doc_id long, text string, `x.y` int")
    kept = corpus_pipeline.drop_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "a b", 7), (3, "c", 9)]


def test_words_made_to_collide_are_no_copies(spark):
    """A Thue-Morse word and its complement, alone and as the words of a shingle."""
    from echoloom.llm import near_dedup

    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    texts = [one, two, " ".join([one] * 6), " ".join([two] * 6), one + " ", f"{one} x", f"{two} x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 5, 6: 6}


def test_strong_hashes_tell_words_apart():
    import numpy as np
    import pyarrow as pa

    from echoloom.llm import words as W

    texts = ["a", "a\x01", "ab", "ba", "abcdefgh", "abcdefghi", "abcdefghj", "é", "ab ab", "x" * 3000, "x" * 3001, ""]
    (part,) = W.slices(pa.array(texts))
    words = W.Words(part, W.non_space_bytes())
    for seed in (1, 2):
        h = words.strong_hash(seed)
        assert h[8] == h[9] == h[2] and len(np.unique(h)) == len(h) - 2
    assert not np.intersect1d(words.strong_hash(1), words.strong_hash(2)).size
    (alone,) = W.slices(pa.array(["ab"]))
    assert W.Words(alone, W.non_space_bytes()).strong_hash(1)[0] == words.strong_hash(1)[2]


def test_crowded_buckets_lose_no_link(spark):
    """Most documents share one long line; every bucket counts as crowded, and all links are found."""
    import random

    import brute
    from echoloom.llm import near_dedup

    draw = random.Random(5)
    line = " ".join(f"common{i}" for i in range(40))
    fresh = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    texts = [f"{line} {fresh(draw.choice([3, 8, 20, 60]))}" for _ in range(150)]
    texts += [f"{fresh(2)} {t}" for t in texts[:30]] + [t.replace("common7", "other") for t in texts[30:50]]
    base = fresh(60).split()
    texts += [" ".join(base[:k] + [f"x{k}"] + base[k:]) for k in range(0, 60, 3)] + [fresh(50) for _ in range(30)] + ["few words", "", line]
    docs = dict(enumerate(texts))
    expected = brute.near_groups(docs)
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for crowded in (-1, 1000):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table, crowded).collect()}
        assert found == expected


def test_rows_of_exact_dedup_come_through_the_directory(spark, monkeypatch):
    """With many buckets the groups are right; rows sent to a neighbour's bucket are lost."""
    texts = [f"text {i % 300}" for i in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.unionByName(spark.createDataFrame([(1000 + i, f"lone {i}") for i in range(200)], docs.schema))
    index = exact_dedup.build_index(docs.select("doc_id", F.xxhash64("text").alias("key")), bucket_keys=20)
    assert index.select("bucket").distinct().count() > 16
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, bucket_keys=20).collect()}
    assert found == {i: (i % 300, 3) for i in range(900)} | {1000 + i: (1000 + i, 1) for i in range(200)}
    right = exact_dedup.read_directory

    def wrong(index, *depth):
        table = right(index, *depth)
        buckets = [r.bucket for r in table.select("bucket").distinct().orderBy("bucket").collect()]
        moved = dict(zip(buckets, [*buckets[1:], buckets[0]]))
        return table.replace(moved, subset=["bucket"])

    monkeypatch.setattr(exact_dedup, "read_directory", wrong)
    assert exact_dedup.exact_dedup(docs, bucket_keys=20).count() == 0
