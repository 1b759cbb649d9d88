"""From raw reviews to the clean layer: filters, normalisation, redaction, dedup, identifiers.

Cost rules the layer follows:

* filters on raw columns come first and reach the scan;
* a text with too few raw words never enters the regex chain (cleaning cannot add words);
* the exact word filter sits above the dedup aggregate, on an aggregated value, so the optimizer
  cannot copy the regex chain into it;
* dedup is an aggregate, so copies of one text collapse before the shuffle however many there are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom import config
from echoloom.config import PiiRule
from echoloom.functions import dates, text
from echoloom.session import materialize

CLEAN_COLUMNS = [
    "review_id", "date", "week_start_date", "week_end_date", "rating", "title", "text", "clean_text",
    "relevance", "source",
]


def latest_reviews(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Raw reviews, newest first: all of them, or only as many as a caller asks for."""
    newest = raw.orderBy(F.desc("at"), "source_review_id")
    return newest if limit is None else newest.limit(limit)


def filter_relevance(raw: DataFrame, column: str = "thumbs_up") -> DataFrame:
    """Keep rows that at least one reader found helpful; a missing count is none.

    The bare comparison drops nulls as well and can be pushed into the scan.
    """
    return raw.filter(F.col(column) > 0)


def filter_date_range(
    df: DataFrame, column: str, start: dt.date | str | None = None, end: dt.date | str | None = None
) -> DataFrame:
    """Keep rows between two days, both included; either may be absent.

    With any bound set, a row whose date cannot be read is dropped. Date and timestamp columns
    are compared as they are, which lets the scan skip row groups.
    """
    low, high = dates.read_bound(start), dates.read_bound(end)
    dtype = df.schema[column].dataType
    value = dates.event_date(F.col(column), dtype) if isinstance(dtype, T.StringType) else F.col(column)
    if low is not None:
        df = df.filter(value >= F.lit(low))
    if high is not None:
        beyond = F.lit(high + dt.timedelta(days=1))
        df = df.filter(value < beyond)
    return df


def filter_valid_date(df: DataFrame, column: str = "date") -> DataFrame:
    """Drop rows whose date cannot be read."""
    return df.filter(dates.event_date(F.col(column), df.schema[column].dataType).isNotNull())


def filter_min_words(df: DataFrame, column: str = "clean_text", n: int = config.MIN_WORDS) -> DataFrame:
    """Keep rows with at least ``n`` words."""
    return df.filter(text.has_words(column, n))


def normalize_reviews(
    raw: DataFrame, start: dt.date | str | None = None, end: dt.date | str | None = None
) -> DataFrame:
    """Relevant raw reviews in the window, with one date, rating, title, text and relevance each."""
    kept = filter_date_range(filter_relevance(raw), "at", start, end)
    return kept.select(
        "source_review_id",
        dates.event_date(F.col("at"), raw.schema["at"].dataType).alias("date"),
        cast_rating("score").alias("rating"),
        text.first_filled("review_title", "title").alias("title"),
        text.first_filled("review_text", "text", "content").alias("text"),
        F.col("thumbs_up").alias("relevance"),
    )


def cast_rating(column: str) -> Column:
    """Stars as an int; missing is 0."""
    return F.coalesce(F.col(column).cast("int"), F.lit(0))


def with_clean_text(
    df: DataFrame,
    rules: Sequence[PiiRule] = config.PII_RULES,
    typos: Mapping[str, str] = config.TYPOS,
) -> DataFrame:
    """Redact ``text`` and add ``clean_text`` and ``n_words``.

    One projection per step: each step reads the one before more than once, and the optimizer
    keeps such projections apart instead of repeating the expensive expression.
    """
    others = [c for c in df.columns if c not in ("text", "clean_text", "n_words")]
    kept = [*others, "text"]
    redacted = redact_column(df.select(*kept), "text", rules)
    filled = redacted.select(*kept, F.coalesce("text", F.lit("")).alias("_filled"))
    plain = filled.select(*kept, text.drop_special("_filled").alias("_plain"))
    folded = plain.select(*kept, text.fold_case("_plain").alias("_folded"))
    cleaned = folded.select(*kept, text.finish_clean("_folded", typos).alias("clean_text"))
    return cleaned.select(*kept, "clean_text", text.clean_word_count("clean_text").alias("n_words"))


def redact_column(df: DataFrame, column: str, rules: Sequence[PiiRule] = config.PII_RULES) -> DataFrame:
    """Redact one column, a projection per step, so that each step's cheap test spares its rules."""
    for step in text.redaction_steps(rules):
        df = df.withColumn(column, step(column))
    return df


def _prefilter_words(df: DataFrame, rules: Sequence[PiiRule], typos: Mapping[str, str], n: int) -> DataFrame:
    """Drop texts that are too short before any cleaning.

    No step of the chain adds a word as long as no replacement holds a space, so fewer than ``n``
    raw words means fewer than ``n`` clean words.
    """
    replacements = [rule.tag for rule in rules] + list(typos.values())
    if any(ch.isspace() for replacement in replacements for ch in replacement):
        return df
    return df.filter(text.has_words("text", n))


def dedup_earliest(
    df: DataFrame,
    key: str = "clean_text",
    order: Sequence[str] = ("date", "source_review_id"),
    wide: Sequence[str] = ("text",),
    total: str | None = None,
) -> DataFrame:
    """One row per key, the earliest; ``copies`` counts the rows it stands for.

    Rows that were deduplicated before carry their count in the column ``total``.

    Groups by a SHA-256 digest instead of the text. Map-side partial aggregation reduces every key
    to one row per task before the shuffle, so a text that makes up a third of the table is no
    hot spot. The long columns are aggregates of their own: a job that does not read them does
    not shuffle them. Should rows agree in ``order``, their other short columns decide, and the
    long ones follow that choice, so a result row is never mixed from two rows.
    """
    order, wide = list(order), [c for c in wide if c in df.columns]
    narrow = [c for c in df.columns if c not in (key, total, *order, *wide)]
    copies = F.sum(total) if total else F.count(F.lit(1))
    rank = F.struct(*order, *narrow)
    return (
        df.groupBy(F.unhex(F.sha2(key, 256)).alias("_digest"))
        .agg(
            F.min(rank).alias("_first"),
            *[F.min_by(c, rank).alias(c) for c in wide],
            F.min(key).alias(key),
            copies.alias("copies"),
        )
        .select(*[F.col(f"_first.{c}").alias(c) for c in order + narrow], *wide, key, "copies")
    )


#: A row's place in one whole number: day, then identifier, then 40 bits of a hash of the row, which settles ties.
_DAYS, _IDS, _HASH = "decimal(7,0)", 2**64 + 1, 2**40
#: Winners (16 bytes each) that ``dedup_late`` broadcasts at most.
BROADCAST_ROWS = 1_000_000


def _order_number(df: DataFrame, order: Sequence[str]) -> Column | None:
    """The order of rows by (date, whole-number identifier) as a ``decimal(38,0)``, null values first; None for other types."""
    kinds = [df.schema[c].dataType for c in order]
    if len(kinds) != 2 or not isinstance(kinds[0], T.DateType) or not isinstance(kinds[1], T.IntegralType):
        return None
    day = F.coalesce(F.datediff(order[0], F.lit("0001-01-01").cast("date")) + 1, F.lit(0)).cast(_DAYS)
    place = F.col(order[1]).cast("decimal(20,0)") + F.lit(str(2**63 + 1)).cast("decimal(20,0)")
    number = F.coalesce(place, F.lit(0)).cast("decimal(20,0)")
    scaled = (day * F.lit(str(_IDS)).cast("decimal(20,0)")).cast("decimal(28,0)") + number
    tie = F.pmod(F.xxhash64(*sorted(df.columns)), F.lit(_HASH)).cast("decimal(13,0)")
    return (scaled.cast("decimal(26,0)") * F.lit(str(_HASH)).cast("decimal(13,0)")).cast("decimal(38,0)") + tie


def dedup_late(
    df: DataFrame, key: str = "clean_text", order: Sequence[str] = ("date", "source_review_id"), label: str = "cleaned"
) -> DataFrame:
    """``dedup_earliest`` with the long columns fetched late: same rows, other plan.

    The rows are written once with a number each. The aggregate sees only a digest, the order as one decimal and that number,
    all of fixed width, so it hashes and sorts nothing; a text in a third of the rows is one entry per task. The winners' numbers
    are written, and the layer is read a second time for their rows. Up to ``BROADCAST_ROWS`` winners are broadcast and no text
    is shuffled; beyond, a hash join on the number takes over, which Spark narrows with a Bloom filter at the scan. No text is sorted.
    """
    rank = _order_number(df, order)
    if rank is None:
        return dedup_earliest(df, key, order)
    layer = materialize(df.withColumn("_row", F.monotonically_increasing_id()), label)
    rank = _order_number(layer.drop("_row"), order)
    narrow = layer.select(F.unhex(F.sha2(key, 256)).alias("_digest"), rank.cast("decimal(38,0)").alias("_rank"), "_row")
    first = narrow.groupBy("_digest").agg(F.min_by("_row", "_rank").alias("_row"), F.count(F.lit(1)).alias("copies"))
    won = materialize(first.select("_row", "copies"), f"{label}-winners")
    kept = layer.join(won.hint("broadcast" if won.count() <= BROADCAST_ROWS else "shuffle_hash"), "_row")
    return kept.select(*[c for c in df.columns if c != key], key, "copies")


def surrogate_id(key: str = "clean_text") -> Column:
    """A UUID-shaped identifier derived from the text; equal on every run and every retry."""
    digest = F.md5(key)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4),
        F.substring(digest, 17, 4), F.substring(digest, 21, 12),
    )


def with_week(df: DataFrame, column: str = "date") -> DataFrame:
    """Add the Monday and Sunday around a date."""
    return df.withColumns({"week_start_date": dates.week_start(column), "week_end_date": dates.week_end(column)})


def distinct_reviews(
    normalized: DataFrame,
    rules: Sequence[PiiRule] = config.PII_RULES,
    typos: Mapping[str, str] = config.TYPOS,
    min_words: int = config.MIN_WORDS,
    dedup: Callable[[DataFrame], DataFrame] = dedup_earliest,
) -> DataFrame:
    """Cleaned, long enough, deduplicated reviews with the number of copies of each.

    ``dedup`` is ``dedup_earliest`` or, where an intermediate layer may be written, ``dedup_late``.
    """
    dated = filter_valid_date(normalized)
    cleaned = with_clean_text(_prefilter_words(dated, rules, typos, min_words), rules, typos)
    return dedup(cleaned).filter(F.col("n_words") >= min_words)


def clean_reviews(
    normalized: DataFrame,
    rules: Sequence[PiiRule] = config.PII_RULES,
    typos: Mapping[str, str] = config.TYPOS,
    min_words: int = config.MIN_WORDS,
    source: str = config.SOURCE_NAME,
    dedup: Callable[[DataFrame], DataFrame] = dedup_earliest,
) -> DataFrame:
    """The clean layer: ten report columns plus the source's own identifier."""
    return project_clean(distinct_reviews(normalized, rules, typos, min_words, dedup), source)


def project_clean(distinct: DataFrame, source: str = config.SOURCE_NAME) -> DataFrame:
    """Give deduplicated reviews their identifier, week and constant source."""
    return with_week(distinct).select(
        surrogate_id().alias("review_id"),
        *[F.lit(source).alias(c) if c == "source" else c for c in CLEAN_COLUMNS[1:]],
        "source_review_id",
    )


def sort_by_date(df: DataFrame) -> DataFrame:
    """Presentation order."""
    return df.orderBy("date", "review_id")


def sample_records(df: DataFrame, n: int = config.REPORT_ITEMS) -> DataFrame:
    """The first few rows by date, for the report."""
    return sort_by_date(df).limit(n)
