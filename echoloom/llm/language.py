"""Language identification with language-bitmask n-gram filters.

Byte n-grams of 3 and 4 (letters only, A-Z lower-cased, all else one blank) are put into one bit-sliced Bloom filter: each of
its slots holds a bitmask with one bit per language, so a single lookup of ``HASHES`` slots, ANDed, returns all languages that
contain an n-gram. A text's n-grams are counted per language; each count is corrected for the share of slots that the language
fills, which is its rate of false positives, and the largest corrected share decides.

An n-gram counts as contained in a language if it was seen ``LEAST_COUNT`` times there and at least ``LEAST_RATIO`` times as often as
in the language where it is most frequent, so stray words and wrong labels do not enter.

The filter is learned from a bounded sample of labelled rows (``train_rows``, chosen by a hash of the id); every row is predicted.
Its size is fixed: ``2**SLOT_BITS`` masks per 63 languages.

Texts that are null or have no letters are ``und`` with score 0, as are all if nothing was labelled. Texts whose n-grams
are all unknown get the most frequent language with score 0. Ties go to the first language by name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.llm import words as W
from echoloom.llm.common import annotated, written

UNKNOWN = "und"
GRAMS = (3, 4)
SLOT_BITS = 20
HASHES = 3
LEAST_COUNT, LEAST_RATIO = 3, 0.2
TRAIN_ROWS = 20_000
PER_MASK = 63

_WORD_CHARACTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a text holds a letter; fractions, superscripts and other numerals are none."""
    return any(found.group().isalpha() for found in _WORD_CHARACTER.finditer(text))


def _blanked() -> np.ndarray:
    table = W.ascii_lower()
    keep = np.zeros(256, bool)
    keep[97:123] = keep[65:91] = keep[128:] = True
    table[~keep] = 32
    return table


def grams(part: W.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, row) of all texts of a slice: n-grams as numbers with their length in the upper bits."""
    lengths = np.diff(part.offsets)
    # One blank after each text (and one before the first) separates the texts.
    data = np.full(len(part.data) + part.n_rows + 1, 32, np.uint8)
    at = 1 + np.arange(len(part.data)) + np.repeat(np.arange(part.n_rows), lengths)
    data[at] = _blanked()[part.data]
    rows = np.zeros(len(data), np.int32)
    rows[at] = np.repeat(np.arange(part.n_rows, dtype=np.int32), lengths)
    ends = part.offsets[1:] + np.arange(1, part.n_rows + 1)
    rows[ends] = np.arange(part.n_rows)
    blank = data == 32
    lone = np.concatenate(([False], blank[1:] & blank[:-1]))
    wide = data.astype(np.uint64)
    found, owners = [], []
    for n in GRAMS:
        m = max(0, len(data) - n + 1)
        value = np.full(m, n, np.uint64)
        bad = np.zeros(m, bool)
        for i in range(n):
            value = (value << np.uint64(8)) | wide[i : i + m]
            if i:
                bad |= lone[i : i + m]
        # Blanks only at the ends of an n-gram, and never two in a row.
        ok = ~bad
        found.append(value[ok])
        owners.append(rows[1 : 1 + m][ok])
    return np.concatenate(found), np.concatenate(owners)


def slots(gram: np.ndarray) -> np.ndarray:
    """The ``HASHES`` slots of each n-gram, one row per hash."""
    spread = W.mixed(gram)
    step = W.mixed(spread) | np.uint64(1)
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return np.stack([((spread + np.uint64(i) * step) >> np.uint64(20) & mask).astype(np.int64) for i in range(HASHES)])


class Model:
    """Languages, the filter (one row of masks per 63 languages), and each language's rate of false positives."""

    def __init__(self, languages: list[str], masks: np.ndarray, usual: str):
        self.languages, self.masks, self.usual = languages, masks, usual
        filled = [np.count_nonzero(masks[i // PER_MASK] >> np.uint64(i % PER_MASK) & np.uint64(1)) / masks.shape[1] for i in range(len(languages))]
        self.false_rate = np.array(filled) ** HASHES

    def shares(self, part: W.Slice) -> np.ndarray:
        """Corrected share of n-grams per row and language."""
        gram, row = grams(part)
        total = np.bincount(row, minlength=part.n_rows).astype(float)
        out = np.zeros((part.n_rows, len(self.languages)))
        places = slots(gram)
        for group in range(len(self.masks)):
            both = self.masks[group][places[0]]
            for more in places[1:]:
                both &= self.masks[group][more]
            for i in range(group * PER_MASK, min(len(self.languages), (group + 1) * PER_MASK)):
                hits = np.bincount(row, weights=(both >> np.uint64(i % PER_MASK) & np.uint64(1)).astype(float), minlength=part.n_rows)
                rate = self.false_rate[i]
                out[:, i] = np.maximum(0.0, hits - rate * total) / np.maximum(1.0, total * (1 - rate) if rate < 1 else total)
        return out


def _count_batches(batches):
    for batch in batches:
        table: dict[str, list] = {}
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            table.setdefault(lang, []).append(text.as_py())
        for lang, texts in table.items():
            for part in W.slices(pa.array(texts, pa.string())):
                values, counts = np.unique(grams(part)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "gram", "n"]
                )


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from the labelled rows of ``docs`` (doc_id, text, lang); those not to be learned from must be left out before."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    n = labelled.count()
    scale = 1 << 20
    part = min(scale, max(1, int(scale * train_rows / n))) if n else scale
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < part).select("text", "lang")
    counts = sample.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "language-grams")
    totals = sorted((r["lang"], r["total"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect())
    languages = [lang for lang, _ in totals]
    masks = np.zeros((max(1, -(-len(languages) // PER_MASK)), 1 << SLOT_BITS), np.uint64)
    if not languages:
        return Model([], masks, UNKNOWN)
    number = F.create_map(*[F.lit(x) for i, (lang, _) in enumerate(totals) for x in (lang, i)])
    size = F.create_map(*[F.lit(x) for lang, total in totals for x in (lang, float(total))])
    rates = counts.select("gram", "n", number[F.col("lang")].alias("i"), (F.col("n") / size[F.col("lang")]).alias("rate"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = rates.join(best, "gram").filter((F.col("n") >= LEAST_COUNT) & (F.col("rate") >= LEAST_RATIO * F.col("best"))).select("gram", "i")

    def placed(batches):
        for batch in batches:
            gram = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            i = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            place = slots(gram).T.ravel()
            language = np.repeat(i, HASHES)
            bit = np.left_shift(np.int64(1), language % PER_MASK)
            yield pa.RecordBatch.from_arrays([pa.array(language // PER_MASK), pa.array(place), pa.array(bit)], names=["word", "slot", "bit"])

    sliced = kept.mapInArrow(placed, "word long, slot long, bit long").groupBy("word", "slot").agg(F.bit_or("bit").alias("mask"))
    # At most 2**SLOT_BITS rows per 63 languages.
    filled = sliced.toPandas()
    masks[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return Model(languages, masks, max(totals, key=lambda x: x[1])[0])


def predict(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``doc`` (the columns ``carry``, default all) with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array):
        found = shared.value
        langs, scores = [], []
        readable = [has_letter(t.as_py() or "") for t in texts]
        for part in W.slices(texts):
            if not found.languages:
                langs += [UNKNOWN] * part.n_rows
                scores += [0.0] * part.n_rows
                continue
            shares = found.shares(part)
            total, best = shares.sum(axis=1), shares.argmax(axis=1)
            for i in range(part.n_rows):
                if not readable[part.first + i]:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                elif total[i] <= 0:
                    langs.append(found.usual)
                    scores.append(0.0)
                else:
                    langs.append(found.languages[best[i]])
                    scores.append(float(shares[i, best[i]] / total[i]))
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return annotated(docs, work, "lang_pred string, score double", carry)
