"""Report columns: bullet categories, action timelines, priority signals, the note itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoloom import config


def bullet_category(c: Column) -> Column:
    """Category of a summary bullet by the first word list that occurs in it."""
    lowered = F.lower(c)
    branches = None
    for category, words in config.BULLET_CATEGORIES:
        any_word = F.lit(False)
        for word in words:
            any_word = any_word | F.contains(lowered, F.lit(word))
        branches = F.when(any_word, category) if branches is None else branches.when(any_word, category)
    return branches.otherwise(config.BULLET_DEFAULT)


def action_timeline(c: Column) -> Column:
    """Target such as "Next 2 Sprints" named in an action, null if none."""
    return F.nullif(F.regexp_extract(c, f"(?i)({config.TIMELINE_PATTERN})", 1), F.lit(""))


def action_without_timeline(c: Column) -> Column:
    """The action with its timeline, and a dash before it, taken out.

    Only occurrences spelled like the first one go.
    """
    target = action_timeline(c)
    stripped = F.regexp_replace(
        c, F.concat(F.lit("(?U)\\s*-?\\s*\\Q"), F.coalesce(target, F.lit("")), F.lit("\\E")), F.lit("")
    )
    return F.when(target.isNull(), F.trim(c)).otherwise(F.trim(stripped))


def priority_signal(rank: Column) -> Column:
    """CRITICAL, HIGH or FOCUS for rank 1, 2, 3; later ranks keep the last one."""
    *urgent, rest = config.PRIORITY_BY_RANK
    branches = None
    for position, label in enumerate(urgent, start=1):
        branches = F.when(rank == position, label) if branches is None else branches.when(rank == position, label)
    return branches.otherwise(rest)


def pulse_note(start: Column, end: Column, top_themes: Column, quotes: Column, actions: Column) -> Column:
    """Markdown note with a dated heading and one bulleted section each for themes, quotes, actions."""
    themes_title, quotes_title, actions_title = config.NOTE_SECTIONS
    theme_lines = F.transform(
        top_themes,
        lambda t: F.concat(F.lit("*   **"), t["theme"], F.lit(":** "), F.array_join(t["summary_bullets"], " ")),
    )
    quote_lines = F.transform(quotes, lambda q: F.concat(F.lit('*   "'), q, F.lit('"')))
    action_lines = F.transform(actions, lambda a: F.concat(F.lit("*   "), a))

    def section(title: str, lines: Column) -> Column:
        return F.concat_ws("\n", F.lit(f"## {title}"), lines)

    heading = F.concat(
        F.lit(f"# {config.NOTE_TITLE} ("), F.date_format(start, "yyyy-MM-dd"), F.lit("–"),
        F.date_format(end, "yyyy-MM-dd"), F.lit(")"),
    )
    return F.concat_ws(
        "\n\n",
        heading,
        section(themes_title, theme_lines),
        section(quotes_title, quote_lines),
        section(actions_title, action_lines),
    )
