"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

One pass over the texts makes the features of every document: densities of insults (as written, and with letters replaced or
separated by symbols), how near they stand to second-person words, and rates of capitals, punctuation, symbols, digits and
repeated letters. Trees learn the label from a bounded sample of labelled rows (``train_rows``); on a part of that sample that
the trees have not seen, an isotonic regression turns their scores into probabilities.

Beside the stated insults, words that stand out in the toxic rows of half of the sample count as a second lexicon (at most
``LEARNED`` words). The trees learn from three eighths, the calibration from the last eighth.

The features of a null or empty text are all 0 and it gets a score like any other. Without labels of both kinds every score is
the share of toxic ones (0 if there are none). Several labels of one id count as toxic if one of them is. Every row stays one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.llm import words as W
from echoloom.llm.common import annotated, written

#: Insults as plain words, A-Z lower-cased. Fixed values.
INSULTS = (
    "ass asshole bastard bitch bullshit clown coward crap creep cretin cunt damn deadbeat degenerate dick dimwit dirtbag disgrace "
    "disgusting douche dumb dumbass dunce fool freak fuck fucking garbage hate hideous idiot idiotic idiots ignorant imbecile "
    "jackass jerk kill liar loser losers lowlife lunatic maggot moron moronic morons nasty nazi nitwit parasite pathetic pig prick "
    "psycho racist rat retard scum scumbag shit shut slut stupid sucker sucks thug trash twat ugly vermin vile whore wimp "
    "worthless arschloch blöd dumm dummkopf idioten scheiße trottel versager widerlich connard crétin débile imbécile merde "
    "minable ordure salaud asqueroso basura cabrón estúpido idiota imbécil inútil mierda patético payaso tonto"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes tú ti tus".split()
LEARNED = 300
LEAST_TEXTS, LEAST_RATIO = 4, 10
TRAIN_ROWS = 30_000
NEAR_WORDS = 5
#: Features take about twenty arrays as long as a slice.
SLICE_BYTES = 1 << 18
THRESHOLD = 0.3

FEATURES = (
    "log_words", "insult_hits", "insult_rate", "learned_hits", "learned_rate", "hidden_hits", "hidden_rate", "you_rate",
    "near_you", "capital_rate", "shout_rate", "mark_rate", "exclaim_rate", "symbol_rate", "digit_rate", "repeat_rate", "word_length",
)


def _looks_like() -> np.ndarray:
    """Byte table: symbols and digits that stand for a letter become it; other ASCII that is no letter becomes 0."""
    table = W.ascii_lower()
    table[:97] = np.where((np.arange(97) >= 65) & (np.arange(97) < 91), table[:97], 0)
    table[123:128] = 0
    for symbol, letter in zip("0134578@$", "oieastbas", strict=True):
        table[ord(symbol)] = ord(letter)
    return table


def _hidden_hits(part: W.Slice, lexicon: np.ndarray) -> np.ndarray:
    """Tokens between blanks whose letters alone, after undoing look-alikes, are an insult; per text."""
    tokens = W.Words(part, W.non_space_bytes(), W.ascii_lower())
    letters = _looks_like()[part.data]
    counted = np.concatenate(([0], np.cumsum(letters > 0)))
    up, down = W.power_table(len(part.data) + 1)
    value = np.where(letters > 0, letters.astype(np.uint64) + np.uint64(1), np.uint64(0)) * up[counted[:-1]]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
    h = W.mixed((sums[tokens.end] - sums[tokens.start]) * down[counted[tokens.start]])
    return np.bincount(tokens.row[np.isin(h, lexicon)], minlength=part.n_rows)


def _hashes(words: list[str]) -> np.ndarray:
    """Hashes of words in lower, capitalised and upper case; texts are folded over A-Z only, so each form counts as written beyond."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    forms = {form.translate(fold) for w in words for form in (w, w.lower(), w[:1].upper() + w[1:], w.upper())}
    return np.array(sorted({W.word_hash(w) for w in forms}), np.uint64)


class Lexicon:
    def __init__(self, learned: list[str]):
        self.insults, self.learned, self.second = _hashes(INSULTS), _hashes(learned), _hashes(SECOND_PERSON)


def features(part: W.Slice, lexicon: Lexicon) -> np.ndarray:
    """One row of ``FEATURES`` per text of a slice."""
    n = part.n_rows
    words = W.Words(part, W.letter_digit_bytes(), W.ascii_lower())
    per_row = lambda chosen: np.bincount(words.row[chosen], minlength=n)
    insult, learned, second = (np.isin(words.hash, x) for x in (lexicon.insults, lexicon.learned, lexicon.second))
    bad = np.flatnonzero(insult | learned)
    yours = np.flatnonzero(second)
    near = np.zeros(len(bad), bool)
    if len(yours):
        for side in (0, -1):
            k = np.clip(np.searchsorted(yours, bad) + side, 0, len(yours) - 1)
            near |= (np.abs(yours[k] - bad) <= NEAR_WORDS) & (words.row[yours[k]] == words.row[bad])
    lengths = np.maximum(1, np.diff(part.offsets)).astype(float)
    data = part.data
    size = np.diff(part.offsets)
    owner = np.repeat(np.arange(n), size)

    def rate(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n) / lengths

    upper = (data >= 65) & (data < 91)
    digit = (data >= 48) & (data < 58)
    letter = upper | ((data >= 97) & (data < 123)) | (data >= 128)
    symbol = np.isin(data, np.frombuffer(b"@$#%&*^~+=<>|\\/", np.uint8))
    mark = np.isin(data, np.frombuffer(b".,;:!?\"'()-", np.uint8))
    same = np.zeros(len(data), bool)
    if len(data) > 2:
        same[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    capitals = np.concatenate(([0], np.cumsum(upper)))
    long = words.end - words.start
    shout = (long > 2) & (capitals[words.end] - capitals[words.start] == long)
    count = np.maximum(1, words.count).astype(float)
    hits, taught = per_row(insult), per_row(learned & ~insult)
    hidden = np.maximum(0, _hidden_hits(part, lexicon.insults) - hits)
    columns = [
        np.log1p(words.count), hits, hits / count, taught, taught / count, hidden, hidden / count, per_row(second) / count,
        np.bincount(words.row[bad[near]], minlength=n), rate(upper), per_row(shout) / count, rate(mark), rate(data == 33),
        rate(symbol), rate(digit), rate(same), np.bincount(words.row, weights=long, minlength=n) / count,
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


def with_features(docs: DataFrame, lexicon: Lexicon, carry: list[str] | None = None) -> DataFrame:
    """``doc`` (the columns ``carry``, default all) with ``features``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def work(texts: pa.Array):
        parts = [features(part, shared.value) for part in W.slices(texts, SLICE_BYTES)]
        rows = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        ends = pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32())
        return [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows).ravel()))]

    return annotated(docs, work, "features array<double>", carry)


def _as_vectors(frame: DataFrame) -> DataFrame:
    kept = [c for c in frame.columns if c != "features"]
    return frame.select(*kept, array_to_vector("features").alias("vector"))


def learned_words(sample: DataFrame, bad: int, good: int, limit: int = LEARNED) -> list[str]:
    """Words held by ``LEAST_TEXTS`` toxic texts, and by a share of all ``bad`` ones ``LEAST_RATIO`` times that of the ``good`` ones (each plus one half)."""
    words = F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+', 0)"))
    seen = sample.select("label", F.explode(words).alias("word")).groupBy("word").agg(
        F.sum("label").alias("texts"), ((F.sum("label") + 0.5) / (bad + 1)).alias("p"), ((F.sum(1 - F.col("label")) + 0.5) / (good + 1)).alias("q")
    )
    chosen = seen.filter((F.col("texts") >= LEAST_TEXTS) & (F.col("p") >= LEAST_RATIO * F.col("q"))).orderBy(F.desc(F.col("p") - F.col("q")), "word").limit(limit)
    return [r["word"] for r in chosen.collect()]


class Model:
    def __init__(self, lexicon: Lexicon, trees, curve, usual: float):
        self.lexicon, self.trees, self.curve, self.usual = lexicon, trees, curve, usual


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 3) -> Model:
    """Learn from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text); rows not to be learned from must be left out before."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    n = known.count()
    scale = 1 << 20
    part = min(scale, max(1, int(scale * train_rows / n))) if n else scale
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(scale))
    # About ``train_rows`` rows of two numbers, whatever the size of the table.
    chosen = F.broadcast(known.filter(place < part))
    sample = written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id"), "toxicity-sample")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    total = sum(counts.values())
    usual = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return Model(Lexicon([]), None, None, usual)
    share = F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(8))
    taught = sample.filter(share < 4)
    sizes = {r["label"]: r["count"] for r in taught.groupBy("label").count().collect()}
    lexicon = Lexicon(learned_words(taught, sizes.get(1, 0), sizes.get(0, 0)))
    made = with_features(sample, lexicon, ["doc_id", "label"]).select("doc.doc_id", "doc.label", "features")
    ready = written(_as_vectors(made), "toxicity-features")
    apart = share == 7
    # Rows whose words were learned would seem easier to the trees than they are.
    fit = ready.filter((share >= 4) & (share < 7)).repartition(8, "doc_id").cache()
    gbt = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=11, cacheNodeIds=False)
    if fit.select("label").distinct().count() < 2:
        fit.unpersist()
        return Model(lexicon, None, None, usual)
    model = gbt.fit(fit)
    fit.unpersist()
    held = _margins(model, ready.filter(apart))
    if held.isEmpty():
        held = _margins(model, ready)
    # Rows of one margin are one weighted point, which the fit makes of them anyway; so no margin is a hot one.
    points = held.groupBy("margin").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="score").fit(points)
    return Model(lexicon, model, curve, usual)


def _margins(trees, frame: DataFrame) -> DataFrame:
    kept = [c for c in frame.columns if c != "vector"]
    return trees.transform(frame).select(*kept, vector_to_array("probability")[1].alias("margin"))


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``doc`` (the columns ``carry``, default all) with ``score``, from 0 to 1."""
    made = with_features(docs, model.lexicon, carry)
    if model.trees is None:
        return made.select("doc", F.lit(float(model.usual)).alias("score"))
    scored = model.curve.transform(_margins(model.trees, _as_vectors(made)))
    return scored.select("doc", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("score"))


def remove_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored at ``threshold`` or more."""
    return score(docs, model).filter(F.col("score") < threshold).select("doc.*")
