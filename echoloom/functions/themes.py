"""Keyword columns over a theme taxonomy.

The functions read a column of lower-cased text by name. It has to be a column, not an expression: the
long CASE over the keywords would evaluate an expression once per keyword. They are written as
SQL text, since a taxonomy makes hundreds of nodes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom import config
from echoloom.config import Taxonomy

LOWERED = "_lowered"


def with_lowered(df: DataFrame, column: str) -> DataFrame:
    """Add the column that the keyword functions read."""
    return df.withColumn(LOWERED, F.lower(column))


def literal(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(values: Iterable[str]) -> str:
    """Strings as a SQL array."""
    return f"array({', '.join(map(literal, values))})"


def _hit(keyword: str, word_boundary: bool) -> str:
    if word_boundary:
        return f"{LOWERED} RLIKE {literal(f'(?U)(?<!{chr(92)}w){chr(92)}Q{keyword}{chr(92)}E(?!{chr(92)}w)')}"
    return f"contains({LOWERED}, {literal(keyword)})"


def _first_hit(keywords: list[str], word_boundary: bool) -> str:
    branches = [
        f"WHEN {_hit(keyword, word_boundary)} THEN {position}"
        for position, keyword in enumerate(keywords)
        # Where an earlier keyword is part of a later one, the earlier one has hit already.
        if word_boundary or not any(earlier in keyword for earlier in keywords[:position])
    ]
    return f"CASE {' '.join(branches)} END"


def best_keyword(taxonomy: Taxonomy = config.TAXONOMY, word_boundary: bool = False) -> Column:
    """Index into ``taxonomy.pairs`` of the first keyword that the text holds, null if none.

    One CASE over all keywords: it stops at the first hit and yields an int, from which theme and
    reason follow by array lookup. Matches substrings (``pan`` hits ``company``) unless
    ``word_boundary`` is set.
    """
    return F.expr(_first_hit([word for _, word in taxonomy.pairs], word_boundary))


def theme_at(index: Column, taxonomy: Taxonomy = config.TAXONOMY) -> Column:
    """Theme of a ``best_keyword`` index; the default theme for null."""
    names = F.expr(text_array(theme for theme, _ in taxonomy.pairs))
    return F.coalesce(F.get(names, index), F.lit(taxonomy.default_theme))


def reason_at(index: Column, taxonomy: Taxonomy = config.TAXONOMY) -> Column:
    """Wording of the reason of a ``best_keyword`` index."""
    words = F.expr(text_array(config.KEYWORD_REASON + word for _, word in taxonomy.pairs))
    return F.coalesce(F.get(words, index), F.lit(config.DEFAULT_REASON))


def _all_hits(keywords: Iterable[str]) -> str:
    tests = [f"CASE WHEN {_hit(word, False)} THEN {i} ELSE -1 END" for i, word in enumerate(keywords)]
    return f"array_remove(array({', '.join(tests)}), -1)"


def matched_keywords(keywords: list[str]) -> Column:
    """Positions of all listed keywords that the text holds, ascending."""
    return F.expr(_all_hits(keywords))


def own_theme_keywords(theme: str, taxonomy: Taxonomy = config.TAXONOMY) -> Column:
    """Positions of the keywords that the text holds, of the theme named in a column."""
    branches = [f"WHEN {theme} = {literal(name)} THEN {_all_hits(words)}" for name, words in taxonomy.themes]
    return F.expr(f"CASE {' '.join(branches)} ELSE cast(array() AS array<int>) END")


def first_keyword_positions(taxonomy: Taxonomy = config.TAXONOMY) -> Column:
    """Array with one entry per theme: position of its first keyword that hits, or null."""
    return F.expr(f"array({', '.join(_first_hit(list(words), False) for _, words in taxonomy.themes)})")
