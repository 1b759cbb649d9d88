"""Token ids of all documents as wavelet-matrix shards, one compressed record per shard.

Documents are dealt by ranges of doc_id and sorted; each task encodes its range, ends every document with ``END`` and closes a
shard at the first document that brings it to ``shard_tokens``. A shard's record holds its documents' ids and lengths and the bit-planes
with their rank directories, so one record answers token access, counts and occurrence lookups.

The tokenizers library encodes. As its first step parts a text at places that depend on the kinds of characters
only, the same places are found for a whole slice of texts at once, and the library is given each distinct piece once; ids are put
together from there. Kinds of characters are asked of the library itself. Texts that contain one of its added tokens are
given to it whole.

Null texts are empty. Ids that are null come first; rows repeated with one id are ordered by text. An empty table gives no shards.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoloom.llm import words as W
from echoloom.llm.common import whole_text
from echoloom.llm.distinct import PieceIds, code_points
from echoloom.llm.wavelet import WaveletMatrix
from echoloom.session import scratch_path

END = 0
SHARD_TOKENS = 1_000_000
#: Bytes of distinct pieces that a worker remembers: about a million pieces.
REMEMBERED_BYTES = 192 << 20
_LETTER, _NUMBER, _SPACE = 1, 2, 3
_QUOTE = 39
_TAILS = (("s",), ("t",), ("m",), ("d",), ("r", "e"), ("v", "e"), ("l", "l"))

SHARD = "shard long, doc_ids array<long>, lengths array<int>, n_tokens long, depth int, planes binary, ranks binary"


@lru_cache(maxsize=1)
def character_kinds() -> bytes:
    """Kind of every code point (letter, number, white space or other) as the library's patterns see it."""
    from tokenizers import Regex, pre_tokenizers

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    kinds = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        inside = np.ones(len(points), bool)
        for _, (start, end) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text):
            inside[start:end] = False
        kinds[np.array(points)[inside]] = kind
    return kinds.tobytes()


def piece_starts(text: np.ndarray, kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where pieces start in ``text`` (code points); ``rows`` are the starts of the texts and the end of all."""
    n = len(text)
    cut = np.zeros(n + 1, bool)
    cut[rows] = True
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[rows] = True
    change = np.flatnonzero((kind[1:] != kind[:-1]) & ~first[1:n]) + 1
    cut[change] = True
    # White space before something else in the same text: its last character stands apart, and a blank joins what follows.
    after = change[kind[change - 1] == _SPACE]
    cut[after - 1] = True
    cut[after[text[after - 1] == 32]] = False
    quotes = np.flatnonzero(cut[:n] & (text == _QUOTE))
    if len(quotes):
        end = rows[np.searchsorted(rows, quotes, "right")]
        for tail in _TAILS:
            stop = quotes + 1 + len(tail)
            fits = stop <= end
            for i, letter in enumerate(tail):
                fits &= text[np.minimum(quotes + 1 + i, n - 1)] == ord(letter)
            cut[quotes[fits] + 1] = False
            cut[stop[fits]] = True
    return np.flatnonzero(cut[:n])


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is visible, else one from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}


class Encoder:
    """The library's ids for slices of texts."""

    def __init__(self, model: str, kinds: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.kinds = np.frombuffer(kinds, np.uint8)
        self.added = [t["content"] for t in json.loads(model).get("added_tokens", [])]
        self.letters = byte_letters()
        self.pieces = PieceIds(self._encode_pieces, REMEMBERED_BYTES)

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces, by the library's model alone: a piece is not parted any further, its bytes are the model's letters."""
        tokenize, letters = self.library.model.tokenize, self.letters
        return [[token.id for token in tokenize(piece.encode("utf-8").decode("latin-1").translate(letters))] for piece in pieces]

    def encode(self, part: W.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a slice, number of ids of each text)."""
        whole = part.data.tobytes().decode("utf-8")
        if any(token in whole for token in self.added):
            texts = [part.data[a:b].tobytes().decode("utf-8") for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True)]
            lists = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for ids in lists for i in ids], np.int32), np.array([len(ids) for ids in lists], np.int64)
        whole, text, rows = code_points(part)
        return self.pieces.of(whole, text, piece_starts(text, self.kinds[text], rows), rows)

    @property
    def depth(self) -> int:
        return max(1, int(self.library.get_vocab_size(with_added_tokens=True) - 1).bit_length())


_encoders: dict[int, Encoder] = {}


def encoder(model: str, kinds: bytes) -> Encoder:
    """One encoder per worker and model."""
    key = zlib.crc32(model.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(model, kinds)
    return _encoders[key]


class _Shards:
    """Collects documents and gives out the records of full shards."""

    def __init__(self, depth: int, shard_tokens: int):
        self.depth, self.shard_tokens = depth, shard_tokens
        self.number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        self._clear()

    def _clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.docs: list = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> pa.RecordBatch | None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) + 1)
        self.ids += [ids, np.array([END], np.int32)]
        self.size += len(ids) + 1
        return self.close() if self.size >= self.shard_tokens else None

    def close(self) -> pa.RecordBatch:
        planes, ranks = WaveletMatrix.build(np.concatenate(self.ids), self.depth).to_bytes()
        values = [self.number, self.docs, self.lengths, self.size, self.depth, planes, ranks]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        names = ["shard", "doc_ids", "lengths", "n_tokens", "depth", "planes", "ranks"]
        made = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)
        self.number += 1
        self._clear()
        return made


def write_shards(docs: DataFrame, model_path: str, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> str:
    """Encode ``docs`` (doc_id, text) and write the shards to ``path`` (default: a new one in the shared folder)."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-shards")
    with open(model_path, encoding="utf-8") as file:  # read by the driver; the tasks get its content
        shared = spark.sparkContext.broadcast((file.read(), character_kinds()))

    def run(batches) -> Iterator[pa.RecordBatch]:
        made = encoder(*shared.value)
        shards = _Shards(made.depth, shard_tokens)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for part in W.slices(batch.column(1)):
                ids, counts = made.encode(part)
                ends = np.cumsum(counts)
                for row in range(part.n_rows):
                    full = shards.add(doc_ids[part.first + row], ids[ends[row] - counts[row] : ends[row]])
                    if full is not None:
                        yield full
        if shards.docs:
            yield shards.close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).repartitionByRange("doc_id")
    ordered.sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(path)
    return path


def _opened(row: dict) -> WaveletMatrix:
    return WaveletMatrix.from_bytes(row["n_tokens"], row["depth"], row["planes"], row["ranks"])


def shard_starts(shards: DataFrame) -> DataFrame:
    """(shard, first): tokens before each shard. Sums per task first, so that only as many rows as there were tasks meet in one place."""
    task = F.shiftrightunsigned("shard", 24)
    sizes = shards.select("shard", task.alias("task"), "n_tokens")
    tasks = sizes.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    before = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("task").orderBy("shard")) - F.col("n_tokens")
    return sizes.withColumn("within", within).join(before, "task").select("shard", (F.col("base") + F.col("within")).alias("first"))


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens = _opened(row).tokens().astype("<u4")
                ends = np.cumsum(row["lengths"])
                sums = [zlib.crc32(tokens[e - n : e].tobytes()) for e, n in zip(ends.tolist(), row["lengths"], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(sums), pa.int64()), pa.array(row["doc_ids"], pa.int64()),
                        pa.array(ends - row["lengths"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(sums, pa.int64()),
                    ],
                    names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = shards.mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(shards), "shard").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """(shard, n): how often a token occurs, by rank alone."""

    def run(batches):
        for batch in batches:
            counts = [_opened(row).count(token) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["shard", "n"])

    return shards.select("shard", "n_tokens", "depth", "planes", "ranks").mapInArrow(run, "shard long, n long")


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """(shard, at): positions of a token within the shards, by select alone."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                matrix = _opened(row)
                places = [matrix.occurrence(token, k) for k in range(matrix.count(token))]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(places), pa.int64()), pa.array(places, pa.int64())], names=["shard", "at"])

    return shards.select("shard", "n_tokens", "depth", "planes", "ranks").mapInArrow(run, "shard long, at long")
