"""Parts of the operators without Spark."""

from __future__ import annotations

import base64
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from echoloom.llm import near_dedup, secrets, sentence_pieces, token_output, toxicity
from echoloom.llm import words as W
from echoloom.llm.distinct import PieceIds
from echoloom.llm.wavelet import WaveletMatrix


def der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


KEY = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48")), der(4, bytes(range(40))))


def kinds(text: str) -> list[str]:
    return [k for k, _, _ in secrets.find_secrets(text)]


def test_structures_are_confirmed():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 'me'})}.c2ln"
    assert kinds(f"see {token} there") == ["jwt"] and kinds(f"{part({'typ': 'x'})}.{part({'a': 1})}.x") == []
    coded = base64.b64encode(KEY).decode()
    assert kinds(f"key {coded}") == ["der"] and kinds(f"key {coded[:-8]}") == []
    assert kinds(KEY.hex()) == ["hex", "der"]
    assert kinds(f"-----BEGIN PRIVATE KEY-----\n{coded[:40]}\n{coded[40:]}\n-----END PRIVATE KEY-----")[0] == "pem"
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"pub" * 9) + field(b"priv" * 9)
    assert "ssh" in kinds(base64.b64encode(ssh).decode()) and "ssh" not in kinds(base64.b64encode(ssh + b"x").decode())


def test_classic_encrypted_blocks_and_hex_of_either_case():
    body = base64.b64encode(bytes(range(64))).decode()
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: {},{}\n\n"

    def block(header: str, data: str = body, kind: str = "RSA ", end: str = "\n") -> str:
        return end.join(f"-----BEGIN {kind}PRIVATE KEY-----\n{header}{data}\n-----END {kind}PRIVATE KEY-----".split("\n"))

    aes, des = head.format("AES-128-CBC", "0A" * 16), head.format("DES-EDE3-CBC", "0A" * 8)
    for text in (block(aes), block(des), block(aes, kind="EC "), block(aes, end="\r\n")):
        assert [x for x in secrets.find_secrets(f"see {text} there") if x[0] == "pem"] == [("pem", 4, 4 + len(text))]
    cut = base64.b64encode(bytes(60)).decode()
    for text in (block(aes, cut), block(head.format("AES-128-CBC", "0A" * 8)), block("Proc-Type: 4,ENCRYPTED\n\n"), block("")):
        assert "pem" not in kinds(text)
    upper, mixed = KEY.hex().upper(), KEY.hex()[:40] + KEY.hex()[40:].upper()
    for text in (upper, mixed):
        assert [x for x in secrets.find_secrets(f"k {text}") if x[0] == "der"] == [("der", 2, 2 + len(text))]
    assert kinds("A" + KEY.hex()) == ["hex", "der"]
    assert "der" not in kinds(upper[:-2])


def test_base_rules():
    assert secrets.find_secrets('API_KEY: "abc123" 😀 AKIA' + "A1" * 9) == [("assign", 0, 16), ("access", 20, 42)]
    assert kinds("token: token: abcdefg") == [] and kinds("AKIA123") == [] and kinds("0123456789abcdef" * 2) == ["hex"]
    assert kinds("to\u212Aen=abcdef") == []  # Kelvin sign
    assert kinds("TOKEN=abcdef") == ["assign"]


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 511, 512, 513, 5000):
        tokens = rng.integers(0, 300, n)
        matrix = WaveletMatrix.build(tokens, 9)
        again = WaveletMatrix.from_bytes(n, 9, *matrix.to_bytes())
        assert (again.tokens() == tokens).all()
        for at in range(0, n, max(1, n // 17)):
            token = int(tokens[at])
            places = np.flatnonzero(tokens == token)
            assert again.access(at) == token and again.count(token) == len(places) and again.count(token, at) == int((places < at).sum())
            assert [again.occurrence(token, k) for k in range(len(places))] == places.tolist()
        assert again.count(511) == 0


def test_pieces_equal_the_library():
    from tokenizers import Tokenizer

    model = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    ours, library = token_output.Encoder(model, token_output.character_kinds()), Tokenizer.from_str(model)
    random.seed(7)
    alphabet = list("ab sS'tmdrevl  \n\t.,!1²٣éñ\xa0　中文😀\x00\x1f'''")
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(3000)] + ["", "'s", "it's 'll  don't", "a\n\n b", "  "]
    for chunk in (texts, [*texts[:50], "x<|endoftext|>y"]):
        for part in W.slices(pa.array(chunk)):
            ids, counts = ours.encode(part)
            ends = np.cumsum(counts)
            for i, (e, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                assert ids[e - n : e].tolist() == library.encode(chunk[part.first + i], add_special_tokens=False).ids


def test_sentence_pieces_equal_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    ours, library = sentence_pieces.Codec(sentence_pieces.load_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    random.seed(8)
    alphabet = list("  aetoinshrl'.\n\t,!1²٣éñ ▁中文😀\x00\x1f<>")
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(3000)] + ["", " ", "  ", "<s>", "</s>x", "<0x0A>", " a", "▁", "a" * 3000, " " * 100]
    for part in W.slices(pa.array(texts)):
        ids, counts = ours.encode(part)
        for i, (e, n) in enumerate(zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True)):
            assert ids[e - n : e].tolist() == library.encode(texts[part.first + i])
    for _ in range(3000):
        some = [random.choice([random.randint(3, 258), random.randint(259, 31999), random.randint(0, 2), 13]) for _ in range(random.randint(0, 8))]
        assert ours.decode(np.array(some, np.int64)) == library.decode(some)


def test_word_hashes_do_not_depend_on_the_slice():
    texts = ["Foo bar", "", "foo é中 x" * 40, None, "bar"]
    whole = [W.Words(p, W.letter_digit_bytes(), W.ascii_lower()) for p in W.slices(pa.array(texts))]
    small = [W.Words(p, W.letter_digit_bytes(), W.ascii_lower()) for p in W.slices(pa.array(texts), limit=3)]
    assert np.concatenate([w.hash for w in whole]).tolist() == np.concatenate([w.hash for w in small]).tolist()
    assert int(whole[0].hash[0]) == W.word_hash("foo") and int(whole[0].hash[1]) == W.word_hash("bar")


def test_sketches_estimate_high_similarity():
    rng = np.random.default_rng(2)
    bound = near_dedup.sketch_bound()
    for similarity in (0.9, 0.8, 0.76):
        for _ in range(40):
            common = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            own = int(1000 * (1 - similarity) / similarity / 2)
            sets = [np.unique(np.concatenate((common, rng.integers(0, 1 << 63, own, dtype=np.uint64)))) for _ in range(2)]
            sketch = near_dedup.signatures(sets)[4]
            assert np.bitwise_count(sketch[0] ^ sketch[1]).sum() <= bound
            parity = near_dedup.set_parities(sets)
            assert np.bitwise_count(parity[0] ^ parity[1]).sum() <= 2 * own
    apart = near_dedup.signatures([rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(2)])[4]
    assert np.bitwise_count(apart[0] ^ apart[1]).sum() > bound


def test_words_with_capitals_beyond_ascii_are_hits():
    lexicon = toxicity.Lexicon(["дурак", "übles"])
    texts = ["blöd cabrón", "BLÖD CABRÓN", "Blöd Cabrón", "дурак übles", "ДУРАК ÜBLES", "Дурак Übles", "étude"]
    made = np.concatenate([toxicity.features(part, lexicon) for part in W.slices(pa.array(texts))])
    at = toxicity.FEATURES.index
    assert made[:, at("insult_hits")].tolist() == [2, 2, 2, 0, 0, 0, 0]
    assert made[:, at("learned_hits")].tolist() == [0, 0, 0, 2, 2, 2, 0]
    assert not made[:, at("hidden_hits")].any()


def thue_morse(n: int) -> tuple[str, str]:
    """A word over a and b and its complement; polynomials modulo a power of two take them for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_pieces_with_one_hash_are_told_apart():
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = thue_morse(2048)
    texts = [one, two, f"{one} {two}", f"{two}! {one}", "plain", two]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    encoder = token_output.Encoder(open(path, encoding="utf-8").read(), token_output.character_kinds())
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = sentence_pieces.Codec(sentence_pieces.load_model(path))
    for batch in (texts, texts[:1], texts[1:2], texts[::-1]):
        for made, plain in ((encoder, lambda t: library.encode(t, add_special_tokens=False).ids), (codec, pieces.encode)):
            for part in W.slices(pa.array(batch)):
                ids, counts = made.encode(part)
                ends = np.cumsum(counts)
                assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [plain(t) for t in batch]


def test_remembered_pieces_are_bounded_in_bytes():
    pieces = PieceIds(lambda texts: [[ord(c) for c in t] for t in texts], remembered=20_000)
    for k in range(50):
        words = [f"{k}w{i}" for i in range(40)]
        whole = "".join(words)
        points = np.array([ord(c) for c in whole], np.uint32)
        starts = np.cumsum([0, *map(len, words[:-1])])
        ids, counts = pieces.of(whole, points, starts, np.array([0, len(whole)]))
        assert ids.tolist() == points.tolist() and counts.tolist() == [len(whole)]
        assert pieces.bytes <= 20_000 + 40 * 200
