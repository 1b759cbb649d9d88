"""Counts and distributions for the reports.

Every table here is the result of a partial aggregate, so what crosses the network and what a
window without partitions sees is bounded by the number of weeks, ratings or themes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoloom import config
from echoloom.config import Taxonomy
from echoloom.functions import dates, text, themes


def processing_funnel(normalized: DataFrame, distinct: DataFrame, min_words: int = config.MIN_WORDS) -> DataFrame:
    """How many rows came in, passed the word filter, were copies, and went out.

    ``distinct`` is ``clean.distinct_reviews(normalized)``: its ``copies`` column carries the count
    before dedup, so texts are cleaned once. The input count reads no text at all.
    """
    before = normalized.agg(F.count(F.lit(1)).alias("total_input")).select(
        "total_input", F.lit(0).cast("long").alias("kept"), F.lit(0).cast("long").alias("total_output")
    )
    after = distinct.filter(F.col("n_words") >= min_words).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("kept"), F.count(F.lit(1)).alias("total_output")
    ).select(F.lit(0).cast("long").alias("total_input"), "kept", "total_output")
    return before.unionByName(after).agg(
        F.sum("total_input").alias("total_input"),
        F.sum("kept").alias("after_min_word_filter"),
        F.sum(F.col("kept") - F.col("total_output")).alias("duplicates_removed"),
        F.sum("total_output").alias("total_output"),
    )


def skip_counts(raw: DataFrame, start: dt.date | str | None = None, end: dt.date | str | None = None) -> DataFrame:
    """Rows left out for relevance, and of the relevant ones those left out for their date."""
    relevant = F.coalesce(F.col("thumbs_up") > 0, F.lit(False))
    low, high = dates.read_bound(start), dates.read_bound(end)
    outside = F.lit(False)
    if low is not None or high is not None:
        day = dates.event_date(F.col("at"), raw.schema["at"].dataType)
        inside = day.isNotNull()
        if low is not None:
            inside = inside & (day >= F.lit(low))
        if high is not None:
            inside = inside & (day <= F.lit(high))
        outside = ~F.coalesce(inside, F.lit(False))
    return raw.agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(~relevant).alias("skipped_relevance"),
        F.count_if(relevant & outside).alias("skipped_date"),
    )


def window_counts(
    normalized: DataFrame, as_of: dt.date, window_days: Sequence[int] = (7, 14, 21, 28, 35)
) -> DataFrame:
    """For each window length its first and last day and how many reviews fall in it, in one pass."""
    spans = {n: dates.date_window(as_of, n) for n in window_days}
    counted = normalized.agg(*[
        F.count_if(F.col("date").between(F.lit(low), F.lit(high))).alias(f"d{n}") for n, (low, high) in spans.items()
    ])
    rows = [
        F.struct(
            F.lit(n).alias("window_days"), F.lit(low).alias("start_date"), F.lit(high).alias("end_date"),
            F.col(f"d{n}").alias("n_reviews"),
        )
        for n, (low, high) in spans.items()
    ]
    return counted.select(F.inline(F.array(*rows)))


def date_range(df: DataFrame, column: str = "date") -> DataFrame:
    """First and last date and the run key made of them; nulls and ``unknown`` for an empty table."""
    bounds = df.agg(F.min(column).alias("start_date"), F.max(column).alias("end_date"))
    return bounds.withColumn("run_key", dates.run_key("start_date", "end_date"))


def with_share(counts: DataFrame, n: str = "n", period: Sequence[str] = ()) -> DataFrame:
    """Add each row's percentage of the total (per period) to a table of counts."""
    total = F.sum(n).over(Window.partitionBy(*period))
    share = F.when(total > 0, F.round(F.col(n) * F.lit(100.0) / total, 6)).otherwise(F.lit(0.0))
    return counts.withColumn("pct", share)


def _zero_filled(df: DataFrame, column: str, values: Sequence, n: str) -> DataFrame:
    """Counts of a column over a fixed list of values, 0 where a value does not occur.

    The list is stacked under the counts rather than joined: a join or a filter on the column would
    be pushed below the aggregate, where it evaluates the column a second time.
    """
    listed = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(v) for v in values])).alias(column), F.lit(0).cast("long").alias(n),
        F.lit(True).alias("_listed"),
    )
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(n)).withColumn("_listed", F.lit(False))
    merged = listed.unionByName(counts).groupBy(column).agg(F.sum(n).alias(n), F.bool_or("_listed").alias("_listed"))
    return merged.filter("_listed").drop("_listed")


def rating_distribution(clean: DataFrame) -> DataFrame:
    """Reviews per rating 1 to 5, zero-filled."""
    return _zero_filled(clean, "rating", range(1, 6), "n")


def rating_share(clean: DataFrame) -> DataFrame:
    """Reviews per rating that occurs, with percentages."""
    return with_share(clean.groupBy("rating").agg(F.count(F.lit(1)).alias("n")))


def weekly_distribution(clean: DataFrame) -> DataFrame:
    """Reviews per Monday week."""
    return (
        clean.groupBy("week_start_date", "week_end_date")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("week_start_date")
    )


def group_by_theme(classified: DataFrame, period: Sequence[str] = ()) -> DataFrame:
    """Reviews per theme with the first (date, id) at which the theme appears."""
    theme = F.coalesce("review_theme", F.lit(config.UNKNOWN_THEME))
    return (
        classified.groupBy(*period, theme.alias("theme"))
        .agg(F.count(F.lit(1)).alias("review_count"), F.min(F.struct("date", "review_id")).alias("first_seen"))
    )


def theme_counts(classified: DataFrame, taxonomy: Taxonomy = config.TAXONOMY) -> DataFrame:
    """Reviews per allowed theme, zero-filled."""
    return _zero_filled(classified, "review_theme", taxonomy.names, "n")


def theme_share(classified: DataFrame) -> DataFrame:
    """Reviews per theme that occurs, with percentages."""
    return with_share(classified.groupBy("review_theme").agg(F.count(F.lit(1)).alias("n")))


def sentiment_distribution(classified: DataFrame) -> DataFrame:
    """Reviews per sentiment with percentages of the whole table, zero-filled."""
    counts = _zero_filled(classified, "sentiment", config.SENTIMENTS, "n")
    return with_share(counts)


def confidence_stats(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"),
    )


def classification_summary(
    reviews: DataFrame, classified: DataFrame, taxonomy: Taxonomy = config.TAXONOMY
) -> DataFrame:
    """Totals, fallbacks, mean confidence, and a zero-filled map of counts by theme."""
    per_theme = classified.groupBy("review_theme").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("fallback_applied").alias("fallbacks"),
        F.sum("confidence").alias("confidence"),
    )
    names = F.array(*[F.lit(t) for t in taxonomy.names])
    total = F.coalesce(F.sum("n"), F.lit(0))
    output = per_theme.agg(
        total.alias("total_output"),
        F.coalesce(F.sum("fallbacks"), F.lit(0)).alias("re_prompts_or_fallbacks"),
        F.when(total > 0, F.round(F.sum("confidence") / F.nullif(total, F.lit(0)), 6))
        .otherwise(F.lit(0.0)).alias("average_confidence"),
        F.map_from_entries(F.collect_list(F.struct("review_theme", "n"))).alias("_found"),
    )
    zeros = F.transform(
        names, lambda t: F.struct(t.alias("key"), F.coalesce(F.element_at("_found", t), F.lit(0).cast("long")).alias("value"))
    )
    summary = output.select(
        F.lit(0).cast("long").alias("total_input"), "total_output",
        F.map_from_entries(zeros).alias("counts_by_theme"),
        "re_prompts_or_fallbacks", "average_confidence",
    )
    counted = reviews.agg(F.count(F.lit(1)).alias("total_input"))
    return _scalar_column(summary, counted, "total_input")


def _scalar_column(one_row: DataFrame, value: DataFrame, column: str) -> DataFrame:
    """Put the single value of a one-row table into a column of another one-row table."""
    return one_row.withColumn(column, value.select(column).scalar())


def fallback_by_theme(classified: DataFrame) -> DataFrame:
    """Reviews classified by keywords, per theme they were given."""
    return classified.filter("fallback_applied").groupBy("review_theme").agg(F.count(F.lit(1)).alias("n_fallbacks"))


def keyword_hits(clean: DataFrame, taxonomy: Taxonomy = config.TAXONOMY) -> DataFrame:
    """Per theme and keyword: reviews in which it is the theme's first hit, and in which it decides."""
    names = F.expr(themes.text_array(taxonomy.names))
    words = F.expr(f"array({', '.join(themes.text_array(listed) for _, listed in taxonomy.themes)})")
    found = themes.with_lowered(clean, "clean_text").select(themes.first_keyword_positions(taxonomy).alias("_positions"))
    first = None
    for i in range(len(taxonomy.themes)):
        hit = F.col("_positions")[i].isNotNull()
        first = F.when(hit, i) if first is None else first.when(hit, i)
    # The slice is the whole array. Exploding the bare column would make the optimizer filter on its size
    # below, where all keywords would be searched a second time.
    every = F.slice("_positions", 1, len(taxonomy.themes))
    hits = found.select(first.alias("_first"), F.posexplode(every).alias("_theme", "_word"))
    counts = hits.filter(F.col("_word").isNotNull()).groupBy("_theme", "_word").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.count_if(F.col("_theme") == F.col("_first")).alias("n_deciding")
    )
    return counts.select(
        names[F.col("_theme")].alias("theme"), words[F.col("_theme")][F.col("_word")].alias("keyword"),
        "n_reviews", "n_deciding",
    )


def taxonomy_table(clean: DataFrame, taxonomy: Taxonomy = config.TAXONOMY) -> DataFrame:
    """The taxonomy as a table: every keyword with its ranks and the number of reviews that hold it."""
    entries = [
        F.struct(
            F.lit(rank).alias("precedence"), F.lit(theme).alias("theme"), F.lit(place).alias("position"),
            F.lit(word).alias("keyword"), F.lit(theme == taxonomy.default_theme).alias("is_default"),
        )
        for rank, (theme, words) in enumerate(taxonomy.themes, start=1)
        for place, word in enumerate(words, start=1)
    ]
    vocabulary = sorted({word for _, word in taxonomy.pairs})
    lowered = themes.with_lowered(clean, "clean_text")
    found = lowered.select(F.explode(themes.matched_keywords(vocabulary)).alias("_i"))
    counts = found.groupBy("_i").agg(F.count(F.lit(1)).alias("_n")).select(
        F.get(F.expr(themes.text_array(vocabulary)), F.col("_i")).alias("keyword"), "_n"
    )
    dimension = clean.sparkSession.range(1).select(F.inline(F.array(*entries)))
    return dimension.join(counts, "keyword", "left").select(
        "precedence", "theme", "position", "keyword", "is_default",
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_reviews"),
    )


def pii_tag_counts(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows that hold a redaction tag and rows that hold none."""
    tagged: Column = F.coalesce(text.has_pii_tag(column), F.lit(False))
    return df.agg(F.count_if(tagged).alias("with_tags"), F.count_if(~tagged).alias("without_tags"))
