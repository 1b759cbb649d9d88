"""The registered queries against SQL twins and plain Python, over all rows of the smallest tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from compare_tables import connect, differences

from echoloom.llm.oracle import ORACLE
from echoloom.llm.queries import CONTROL_CASE, QUERIES


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def by_id(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    found = {r.doc_id: r for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) == []


def test_secrets(spark, sf_dir, texts):
    rules = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    found = by_id(spark, sf_dir, "op1_secrets")
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        spans = sorted((m.start(), k, m.end()) for k, (_, rule, ok) in enumerate(rules) for m in rule.finditer(text) if ok(m))
        joined = ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in spans)
        row = found[doc_id]
        assert row.base_sha256 == brute.sha(joined)
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]


def test_sentence_pieces(spark, sf_dir, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = by_id(spark, sf_dir, "op2_sentence_pieces")
    for doc_id, text in texts.items():
        ids = library.encode(text)
        assert tuple(found[doc_id])[1:] == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids)))


def test_token_output(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found, at = by_id(spark, sf_dir, "op4_token_output"), 0
    for doc_id in sorted(texts):
        ids = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert tuple(found[doc_id])[1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_chat(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns: dict = {}
    for row in sorted(rows + CONTROL_CASE):
        turns.setdefault(row[0], []).append(row)
    found = {r.conv_id: r for r in QUERIES["op6_chat"](spark, sf_dir).collect()}
    assert found.keys() == turns.keys()
    for conv_id, members in turns.items():
        loss = "".join(r[3] or "" for r in members if r[2] == "assistant")
        whole = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in members)
        assert tuple(found[conv_id])[1:5] == (len(members), brute.sha(whole), len(loss), brute.sha(loss))


def test_near_dedup(spark, sf_dir, texts):
    found = by_id(spark, sf_dir, "op8_near_dedup")
    expected = brute.near_groups(texts)
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == expected
    assert all(r.kept == (r.component_id == i) for i, r in found.items())


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    found = by_id(spark, sf_dir, "op7_language")
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 for i, r in found.items())
    tested = [i for i in found if held_out(i) and langs[i]]
    assert np.mean([found[i].lang_pred == langs[i] for i in tested]) >= 0.98


def test_toxicity_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect()}
    found = by_id(spark, sf_dir, "op10_toxicity")
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    tested = [i for i in labels if held_out(i) and i in found]
    assert np.mean([found[i].predicted == labels[i] for i in tested]) >= 0.93


def test_pipeline(spark, sf_dir):
    """The first stage's decisions are taken as they are; all later ones are made again in plain Python."""
    import corpus_pipeline
    import sentencepiece

    from echoloom.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = written(corpus_pipeline.drop_toxic(spark, docs, sf_dir), "test-left")
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    first: dict = {}
    for i in sorted(texts):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", texts[i]), i)
    texts = {i: texts[i] for i in first.values()}
    texts = {i: texts[i] for i, (_, group) in brute.near_groups(texts).items() if group == i}
    items = [brute.words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + min(10, len(w))]) for w in items for k in range(len(w) - min(10, len(w)) + 1) if w}
    sizes = {len(w) for w in windows}

    def clean(text):
        w = brute.words(text)
        return not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    texts = {i: t for i, t in texts.items() if clean(t)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    stages = dict(corpus_pipeline.STAGES)
    docs = left
    for name in list(stages)[1:]:
        docs = written(stages[name](spark, docs, sf_dir), "test-stage")
    found = {r.doc_id: r for r in docs.collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        assert found[i].ids == library.encode(text) and found[i].n_tokens == len(found[i].ids)
        assert found[i].text_sha256 == hashlib.sha256(library.decode(found[i].ids).encode()).hexdigest()
