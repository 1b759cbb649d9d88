"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item (a shorter item is one window). The symbols
are words, not bytes, and blocks are two words:

* the *shift table* gives, for the block that ends at a position, how far the search may jump because no pattern can end
  before that; blocks in no pattern allow the longest jump;
* where the shift is zero, the *bucket* of the block (the patterns' last block, together with their first) names the
  patterns to test;
* *direct comparison* of the words, and then of their bytes, confirms each occurrence.

Many stretches of text are searched at once, each at its own position, as lanes of one numpy loop.

The benchmark is a fixed query set, not corpus data. It is read in blocks of at most ``block_words`` words, kept as flat arrays
(windows name their first word), so what is sent to the tasks is bounded; more blocks mean more passes, without a shuffle, each written to the shared folder before the next.

A null or empty text has no words and no hits; an item without words, or a null item, has no window; an item with a
null id counts as the id "". Items of equal text all count. Every row stays one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.llm import words as W
from echoloom.llm.common import written

#: Words of a block at most: 48 bytes of arrays for each, beside the text and a shift table of at most 16 MB.
BLOCK_WORDS = 500_000
#: End positions that one lane searches.
LANE = 128
#: Slots of the shift table: about eight for each pattern, within these bounds.
_TABLE_BITS, _MOST_BITS = 18, 22


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hash of each word with the one before it; position 0 has its own word only."""
    before = np.empty_like(h)
    before[:1] = 0
    before[1:] = h[:-1]
    return W.mixed(before * np.uint64(0x9E3779B97F4A7C15) + h)


class Source:
    """The words of a block of items as flat arrays; patterns only name their first word here."""

    def __init__(self, texts: list[str]):
        keep, fold = W.letter_digit_bytes(), W.ascii_lower()
        parts = [W.Words(part, keep, fold) for part in W.slices(pa.array(texts, pa.string()))]
        letters = np.cumsum([0, *(len(p.folded) for p in parts)])
        self.folded = _joined([p.folded for p in parts], np.uint8)
        self.start = _joined([p.start + at for p, at in zip(parts, letters)], np.int64)
        self.end = _joined([p.end + at for p, at in zip(parts, letters)], np.int64)
        self.hash = _joined([p.hash for p in parts], np.uint64)
        #: Words of each item.
        self.count = _joined([np.diff(p.bounds) for p in parts], np.int64)


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays).astype(kind, copy=False) if arrays else np.zeros(0, kind)


class Patterns:
    """Patterns of one length: shift table, buckets, and the first word of each to confirm it."""

    def __init__(self, length: int, source: Source, first: np.ndarray, items: np.ndarray):
        self.length = length
        self.block = min(2, length)
        self.bits = min(_MOST_BITS, max(_TABLE_BITS, int(8 * len(first)).bit_length()))
        blocks = _pairs(source.hash) if self.block == 2 else W.mixed(source.hash)
        slots = self._slots(blocks)
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int32)
        for at in range(self.block - 1, length):
            np.minimum.at(self.shift, slots[first + at], length - 1 - at)
        key = self._bucket(blocks[first + length - 1], blocks[first + self.block - 1])
        order = np.argsort(key, kind="stable")
        self.key, self.first, self.items = key[order], first[order], items[order]

    def _slots(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    @staticmethod
    def _bucket(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        return W.mixed(last * np.uint64(0x9E3779B97F4A7C15) + first)

    def positions(self, bounds: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """End positions at which the shift is zero."""
        first, last = bounds[:-1] + self.length - 1, bounds[1:]
        n = np.maximum(0, last - first)
        lanes = -(-n // LANE)
        row = np.repeat(np.arange(len(n)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first[row] + nth * LANE
        end = np.minimum(at + LANE, last[row])
        slots = self._slots(blocks)
        found = []
        while len(at):
            jump = self.shift[slots[at]]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            live = at < end
            at, end = at[live], end[live]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, words: W.Words, source: Source) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of each confirmed occurrence."""
        blocks = _pairs(words.hash) if self.block == 2 else W.mixed(words.hash)
        ends = self.positions(words.bounds, blocks)
        starts = ends - (self.length - 1)
        key = self._bucket(blocks[ends], blocks[starts + self.block - 1])
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = high - low
        starts, low = np.repeat(starts, n), np.repeat(low, n)
        pattern = low + np.arange(len(low)) - np.repeat(np.cumsum(n) - n, n)
        same = np.ones(len(starts), bool)
        for i in range(self.length):
            same &= words.hash[starts + i] == source.hash[self.first[pattern] + i]
        starts, pattern = starts[same], pattern[same]
        equal = [self._text(words, s) == self._text(source, p) for s, p in zip(starts.tolist(), self.first[pattern].tolist(), strict=True)]
        equal = np.array(equal, bool)
        return starts[equal], pattern[equal]

    def _text(self, words: W.Words | Source, first: int) -> bytes:
        return b" ".join(words.folded[words.start[i] : words.end[i]].tobytes() for i in range(first, first + self.length))


class Block:
    """The patterns of one block of items, by length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.ids = [item for item, _ in items]
        self.source = Source([text for _, text in items])
        n = self.source.count
        at = np.cumsum(n) - n
        length = np.minimum(window, n)
        self.patterns = []
        for size in np.unique(length[n > 0]).tolist():
            rows = np.flatnonzero(length == size)
            several = n[rows] - size + 1
            nth = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
            self.patterns.append(Patterns(size, self.source, np.repeat(at[rows], several) + nth, np.repeat(rows, several)))

    def search(self, words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end word, item) of all occurrences."""
        found = [(s, s + p.length, p.items[k]) for p in self.patterns for s, k in [p.occurrences(words, self.source)]]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """(id, text) of the items, in blocks of bounded size (an item larger than that is a block)."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text")).filter("text IS NOT NULL")
    for item, text in rows.toLocalIterator():
        n = 1 + len(text) // 2
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    yield block


def _merged(spans: list[int]) -> list[int]:
    """Overlapping and touching spans joined; flat lists of start, end."""
    out: list[int] = []
    for start, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _search(block, texts: pa.Array) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """Words, merged spans and items of each text."""
    keep, fold = W.letter_digit_bytes(), W.ascii_lower()
    counts: list[int] = []
    spans: list[list[int]] = []
    items: list[list[str]] = []
    for part in W.slices(texts):
        words = W.Words(part, keep, fold)
        counts += words.count.tolist()
        row_spans: list[list[int]] = [[] for _ in range(part.n_rows)]
        row_items: list[set] = [set() for _ in range(part.n_rows)]
        for first, end, item in zip(*(x.tolist() for x in block.search(words)), strict=True):
            row = int(words.row[first])
            base = int(words.bounds[row])
            row_spans[row] += (first - base, end - base)
            row_items[row].add(block.ids[item])
        spans += [_merged(x) for x in row_spans]
        items += [sorted(x) for x in row_items]
    return counts, spans, items


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10, carry: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc`` (the columns ``carry``, default all) with n_words, spans and items of every row.

    ``spans`` are the word ranges inside any occurrence, as start, end, start, end, ...; ``items`` the ids found, sorted.
    """
    context = docs.sparkSession.sparkContext
    names = docs.columns if carry is None else carry
    frame = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("doc"), F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    blocks = item_blocks(benchmark, block_words)
    items = next(blocks)
    while items is not None:
        after = next(blocks, None)
        sent = context.broadcast(Block(items, window))
        frame = _one_pass(frame, sent, keep_text=after is not None)
        if after is not None:
            # Written before the next block, so that a task holds one block only.
            frame = written(frame, "passages")
            sent.destroy()
        items = after
    return frame


def _one_pass(frame: DataFrame, block, keep_text: bool) -> DataFrame:
    schema = frame.schema if keep_text else frame.drop("text").schema

    def run(batches):
        for batch in batches:
            doc, texts, _, spans, items = batch.columns
            counts, new_spans, new_items = _search(block.value, texts)
            spans = [_merged(a + b) for a, b in zip(spans.to_pylist(), new_spans, strict=True)]
            items = [sorted({*a, *b}) for a, b in zip(items.to_pylist(), new_items, strict=True)]
            made = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([doc, texts, *made] if keep_text else [doc, *made], names=[f.name for f in schema])

    return frame.mapInArrow(run, schema)


def hit_words(spans: str = "spans"):
    """Number of words in the merged ``spans``."""
    return F.expr(f"aggregate(transform({spans}, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (a, x) -> a + x)")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark."""
    return find_passages(docs, benchmark, window).filter("size(spans) = 0").select("doc.*")
