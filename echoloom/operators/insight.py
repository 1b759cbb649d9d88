"""From classified reviews to the pulse: top themes, chunks, key points, quotes, report.

``period`` names the columns that separate reports, such as ``week_start_date``; with none there is
one report over the whole table. Chunk results stay long tables until they are small: only the
first few quotes and bullets of a theme are ever put into one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoloom import config
from echoloom.config import Taxonomy
from echoloom.functions import dates, report, text, themes
from echoloom.operators import scoring
from echoloom.operators.order import with_chunk
from echoloom.operators.summaries import group_by_theme

KEY_POINTS_PER_CHUNK = 5
QUOTES_PER_CHUNK = 3
BULLETS_PER_THEME = 2
CHUNKS_PER_PART = 2000
PLACE = ["chunk_id", "pos"]


def top_themes(classified: DataFrame, n: int = config.TOP_THEMES, period: Sequence[str] = ()) -> DataFrame:
    """The ``n`` largest themes (of each period), ties by first appearance."""
    counts = group_by_theme(classified, period)
    order = Window.partitionBy(*period).orderBy(F.desc("review_count"), "first_seen")
    return (
        counts.withColumn("theme_rank", F.row_number().over(order))
        .filter(F.col("theme_rank") <= n)
        .select(*period, "theme_rank", "theme", "review_count")
    )


def chunk_reviews(
    classified: DataFrame, size: int = config.CHUNK_SIZE, period: Sequence[str] = ()
) -> DataFrame:
    """Consecutive chunks of ``size`` reviews per theme (and period) in input order."""
    return with_chunk(_themed(classified), size, [*period, "theme"])


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A join in which null keys meet null keys; the right side's keys are left out."""
    side = right.select(*[F.col(c).alias(f"_same_{c}") if c in keys else c for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in keys]
    return left.join(side, on, how).drop(*[f"_same_{c}" for c in keys])


def _themed(classified: DataFrame) -> DataFrame:
    return classified.withColumn("theme", F.coalesce("review_theme", F.lit(config.UNKNOWN_THEME)))


def select_themes(classified: DataFrame, top: DataFrame, period: Sequence[str] = ()) -> DataFrame:
    """The reviews of the chosen themes; a null period is one of its own."""
    return _same(_themed(classified), top.select(*period, "theme"), [*period, "theme"], "left_semi")


def chunk_text(
    chunked: DataFrame, period: Sequence[str] = (), chars: int = config.CHUNK_TEXT_CHARS
) -> DataFrame:
    """One row per chunk: its shortened texts as a dashed list."""
    line = F.concat(F.lit("- "), text.truncate(F.coalesce("clean_text", F.lit("")), chars))
    lines = F.sort_array(F.collect_list(F.struct("ord", line.alias("line"))))
    return chunked.groupBy(*period, "theme", "chunk_id").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("reviews_list"),
    )


def summarize_chunks(
    texts: DataFrame,
    model: Callable[[str], str],
    template: str = scoring.ITEMS,
    concurrency: int | None = None,
) -> DataFrame:
    """Key points and quotes of each chunk by a user's model; chunks it fails on are left out."""
    head, _, tail = template.partition(scoring.ITEMS)
    prompts = texts.withColumn("prompt", F.concat(F.lit(head), "reviews_list", F.lit(tail)))
    scored = scoring.score_batches(
        prompts, model, accepts=scoring.holds_json("{", "}"), max_retries=0, concurrency=concurrency
    )
    return scoring.parse_chunk_answers(scored).drop("reviews_list", "n_reviews")


def summarize_chunks_builtin(
    chunked: DataFrame, period: Sequence[str] = (), taxonomy: Taxonomy = config.TAXONOMY
) -> DataFrame:
    """Key points and quotes of each chunk without a model.

    Key points are the chunk's most frequent keywords of its theme, quotes its most relevant
    texts. One shuffle; a chunk has at most its fixed size of rows, so the arrays are bounded.
    """
    quote = F.struct(
        (-F.coalesce("relevance", F.lit(0))).alias("rank"), F.col("review_id"), F.col("clean_text").alias("quote")
    )
    lowered = themes.with_lowered(chunked, "clean_text")
    gathered = lowered.withColumn("_words", themes.own_theme_keywords("theme", taxonomy)).groupBy(
        *period, "theme", "chunk_id"
    ).agg(
        F.flatten(F.collect_list("_words")).alias("_words"),
        F.slice(F.sort_array(F.collect_list(quote)), 1, QUOTES_PER_CHUNK).alias("_quotes"),
    )
    counted = F.sort_array(F.transform(
        F.array_distinct("_words"),
        lambda w: F.struct((-F.size(F.filter("_words", lambda x: x == w))).alias("n"), w.alias("word")),
    ))
    names = F.expr("map({})".format(", ".join(
        f"{themes.literal(theme)}, {themes.text_array(words)}" for theme, words in taxonomy.themes
    )))
    return gathered.select(
        *period, "theme", "chunk_id",
        F.element_at(names, F.col("theme")).alias("_names"),
        F.slice(counted, 1, KEY_POINTS_PER_CHUNK).alias("_top"),
        F.transform("_quotes", lambda q: q["quote"]).alias("candidate_quotes"),
    ).select(
        *period, "theme", "chunk_id",
        F.transform("_top", lambda t: F.get(F.col("_names"), t["word"])).alias("key_points"),
        "candidate_quotes",
    )


def _long(chunk_results: DataFrame, column: str, value: str, period: Sequence[str]) -> DataFrame:
    return chunk_results.select(*period, "theme", "chunk_id", F.posexplode(column).alias("pos", value))


def collect_key_points(chunk_results: DataFrame, period: Sequence[str] = ()) -> DataFrame:
    """All key points of a theme in chunk order, repetitions included, as a long table."""
    return _long(chunk_results, "key_points", "key_point", period)


def key_point_parts(
    key_points: DataFrame, period: Sequence[str] = (), chunks_per_part: int = CHUNKS_PER_PART
) -> DataFrame:
    """Key points as ordered arrays, a theme cut into parts of so many chunks.

    A small theme is one part. A huge one is several rows with ascending ``part``, which together
    hold everything, since no single row could.
    """
    entry = F.struct(*PLACE, "key_point")
    part = F.floor(F.col("chunk_id") / chunks_per_part).cast("long").alias("part")
    ordered = F.sort_array(F.collect_list(entry))
    return key_points.groupBy(*period, "theme", part).agg(
        F.transform(ordered, lambda e: e["key_point"]).alias("aggregated_key_points")
    )


def first_distinct(
    rows: DataFrame, value: str, n: int, period: Sequence[str] = ()
) -> DataFrame:
    """The first ``n`` distinct values per theme, ordered by first occurrence, with their rank.

    Digests of the values collapse to their earliest place first, so no text is a group key; chunk and place in one
    long keep that a hash aggregate. The values of the places chosen are fetched in the end; ``rows`` is read twice. The rank filter then becomes a group limit that every task applies before the
    shuffle, so a theme never arrives whole anywhere.
    """
    keys = [*period, "theme"]
    placed = rows.withColumn("_place", F.shiftleft("chunk_id", 20) + F.col("pos"))
    digest = F.unhex(F.sha2(value, 256)).alias("_digest")
    earliest = placed.groupBy(*keys, digest).agg(F.min("_place").alias("_place"))
    order = Window.partitionBy(*keys).orderBy("_place")
    ranked = earliest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    chosen = ranked.select(*keys, "_place", "rank")
    return _same(placed.select(*keys, "_place", value), chosen, [*keys, "_place"], "inner").select(*keys, "rank", value)


def top_quotes(
    chunk_results: DataFrame, n: int = config.MAX_QUOTES, period: Sequence[str] = ()
) -> DataFrame:
    """The first ``n`` distinct quotes of each theme."""
    return first_distinct(_long(chunk_results, "candidate_quotes", "quote", period), "quote", n, period)


def _in_rank_order(value: str, rank: str = "rank") -> Column:
    ordered = F.sort_array(F.collect_list(F.struct(rank, value)))
    return F.transform(ordered, lambda x: x[value])


def theme_summary(
    top: DataFrame, chunk_results: DataFrame, period: Sequence[str] = (), chunks_per_part: int = CHUNKS_PER_PART
) -> DataFrame:
    """Count, key points and first quotes of each top theme.

    Long key-point lists continue in rows with ``part`` 1, 2, ...; the quotes stand in each part.
    """
    keys = [*period, "theme"]
    quotes = top_quotes(chunk_results, period=period).groupBy(*keys).agg(
        _in_rank_order("quote").alias("aggregated_candidate_quotes")
    )
    parts = key_point_parts(collect_key_points(chunk_results, period), period, chunks_per_part)
    empty = F.array().cast("array<string>")
    return (
        _same(_same(top, quotes, keys, "left"), parts, keys, "left").select(
            *period, "theme_rank", "theme", F.coalesce("part", F.lit(0).cast("long")).alias("part"), "review_count",
            F.coalesce("aggregated_key_points", empty).alias("aggregated_key_points"),
            F.coalesce("aggregated_candidate_quotes", empty).alias("aggregated_candidate_quotes"),
        )
    )


def theme_digest(top: DataFrame, chunk_results: DataFrame, period: Sequence[str] = ()) -> DataFrame:
    """What a report needs of each top theme: rank, count, priority, first bullets, best quote."""
    keys = [*period, "theme"]
    bullets = first_distinct(
        collect_key_points(chunk_results, period), "key_point", BULLETS_PER_THEME, period
    ).groupBy(*keys).agg(_in_rank_order("key_point").alias("summary_bullets"))
    quotes = top_quotes(chunk_results, 1, period).select(*keys, "quote")
    return _same(_same(top, bullets, keys, "left"), quotes, keys, "left").select(
        *period, "theme_rank", "theme", "review_count",
        report.priority_signal(F.col("theme_rank")).alias("priority_signal"),
        F.coalesce("summary_bullets", F.array().cast("array<string>")).alias("summary_bullets"), "quote",
    )


def reduce_pulse(
    digest: DataFrame, bounds: DataFrame, period: Sequence[str] = (), actions: DataFrame | None = None
) -> DataFrame:
    """One pulse per period: themes with bullets, quotes, actions and the note.

    ``bounds`` gives ``start_date`` and ``end_date`` of each period. Without a table of
    ``actions`` (period columns and ``action_ideas``) the pulse has none.
    """
    entry = F.struct("theme_rank", F.struct("theme", "summary_bullets").alias("entry"), "quote")
    ordered = F.sort_array(F.collect_list(entry))
    empty = F.array().cast("array<string>")
    grouped = digest.groupBy(*period).agg(ordered.alias("_themes"))
    joined = _same(grouped, bounds, list(period), "inner") if period else grouped.withColumns({
        "start_date": bounds.select("start_date").scalar(), "end_date": bounds.select("end_date").scalar(),
    })
    if actions is None:
        joined = joined.withColumn("action_ideas", empty)
    elif period:
        joined = _same(joined, actions, list(period), "left").withColumn(
            "action_ideas", F.coalesce("action_ideas", empty)
        )
    else:
        joined = joined.withColumn("action_ideas", F.coalesce(actions.select("action_ideas").scalar(), empty))
    quotes = F.filter(F.transform("_themes", lambda t: t["quote"]), lambda q: q.isNotNull())
    shaped = joined.select(
        *period, "start_date", "end_date",
        F.transform("_themes", lambda t: t["entry"]).alias("top_themes"),
        F.slice(quotes, 1, config.REPORT_ITEMS).alias("quotes"), "action_ideas",
    )
    return shaped.withColumn("note_markdown", report.pulse_note(
        F.col("start_date"), F.col("end_date"), F.col("top_themes"), F.col("quotes"), F.col("action_ideas")
    ))


def period_bounds(classified: DataFrame, period: Sequence[str] = ()) -> DataFrame:
    """First and last review date of each period."""
    return classified.groupBy(*period).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))


def generate_pulse(
    classified: DataFrame,
    period: Sequence[str] = (),
    summarize: Callable[[DataFrame], DataFrame] | None = None,
    layer: Callable[[DataFrame, str], DataFrame] = lambda df, label: df,
    reduce: Callable[..., DataFrame] | None = None,
    actions: DataFrame | None = None,
) -> DataFrame:
    """The pulses of all periods in one job.

    ``summarize`` turns chunked reviews into chunk results; the default needs no model. ``layer``
    may write the chunk results (``session.materialize``) so that they are computed once. ``reduce`` makes the pulses from the
    themes' digest, the bounds, the period columns and ``actions`` (see ``reduce_pulse``, the default).
    """
    top = top_themes(classified, period=period)
    chunked = chunk_reviews(select_themes(classified, top, period), period=period)
    results = layer((summarize or (lambda c: summarize_chunks_builtin(c, period)))(chunked), "chunk-results")
    return (reduce or reduce_pulse)(theme_digest(top, results, period), period_bounds(classified, period), period, actions)


def note_word_limit(pulses: DataFrame, limit: int = config.NOTE_MAX_WORDS) -> DataFrame:
    """Word count of each note and whether it keeps the limit."""
    words = text.word_count("note_markdown")
    return pulses.withColumns({"note_words": words, "within_limit": words <= limit})


def pulse_counts(pulses: DataFrame) -> DataFrame:
    """Number of themes, quotes and actions of each pulse."""
    return pulses.withColumns({
        "n_themes": F.coalesce(F.size("top_themes"), F.lit(0)).cast("long"),
        "n_quotes": F.coalesce(F.size("quotes"), F.lit(0)).cast("long"),
        "n_actions": F.coalesce(F.size("action_ideas"), F.lit(0)).cast("long"),
    })


def report_top3(pulses: DataFrame, n: int = config.REPORT_ITEMS) -> DataFrame:
    """Quotes and actions cut to the ``n`` that a report shows."""
    return pulses.withColumns({
        "quotes": F.slice("quotes", 1, n), "action_ideas": F.slice("action_ideas", 1, n),
    })


def with_run_key(pulses: DataFrame) -> DataFrame:
    return pulses.withColumn("run_key", dates.run_key("start_date", "end_date"))
