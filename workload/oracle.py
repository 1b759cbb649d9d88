"""The registered queries in SQL for DuckDB, over the same base tables.

Statements are put together from common table expressions; ``_with`` adds those a statement needs.
"""

from __future__ import annotations

import re

from echoloom import config
from echoloom.operators import insight
from workload import views


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _replace(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {_q(pattern)}, {_q(by)}, 'g')"


def _redact(expr: str) -> str:
    for rule in config.PII_RULES:
        expr = _replace(expr, rule.pattern, rule.tag)
    return expr


EMOJI = "[\\x{1F000}-\\x{1F9FF}\\x{2600}-\\x{27BF}\\x{2300}-\\x{23FF}\\x{FE0F}]"


def _emoji(expr: str) -> str:
    return _replace(expr, EMOJI, "")


def _quotes(expr: str) -> str:
    return f"translate({expr}, '‘’“”', '''''\"\"')"


def _spaces(expr: str) -> str:
    return f"trim({_replace(expr, chr(92) + 's+', ' ')}, ' ')"


def _typos(expr: str) -> str:
    for wrong, right in config.TYPOS.items():
        expr = _replace(expr, rf"\b{wrong}\b", right)
    return expr


def _words(expr: str) -> str:
    return f"CAST(len(list_filter(string_split_regex({expr}, '\\s+'), lambda x: x <> '')) AS BIGINT)"


def _uuid(expr: str) -> str:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return " || '-' || ".join(f"substr(md5({expr}), {a}, {n})" for a, n in cuts)


def _monday(expr: str) -> str:
    return f"CAST(date_trunc('week', {expr}) AS DATE)"


def _pct(n: str, over: str = "") -> str:
    return f"round({n} * 100.0::DOUBLE / sum({n}) OVER ({over}), 6)"


TAIL = " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in views.TAILS.items())
PAIRS = config.TAXONOMY.pairs
VALUES_PAIRS = ", ".join(
    f"({rank}, {_q(theme)}, {place}, {_q(word)})"
    for rank, (theme, words) in enumerate(config.TAXONOMY.themes, start=1)
    for place, word in enumerate(words, start=1)
)
FIRST_HIT = f"list_filter({_list([w for _, w in PAIRS])}, lambda k: contains(lower(clean_text), k))"
THEMES = _list(config.TAXONOMY.names)
THEME_CASE = "CASE " + " ".join(
    f"WHEN len(list_filter({_list(words)}, lambda k: contains(lower(clean_text), k))) > 0 THEN {_q(theme)}"
    for theme, words in config.TAXONOMY.themes
) + f" ELSE {_q(config.DEFAULT_THEME)} END"
REASON_CASE = (
    f"CASE WHEN len({FIRST_HIT}) > 0 THEN {_q(config.KEYWORD_REASON)} || {FIRST_HIT}[1] "
    f"ELSE {_q(config.DEFAULT_REASON)} END"
)

CTES = {
    "reviews_raw": f"""
        SELECT doc_id AS source_review_id,
               DATE '2025-11-03' + CAST(doc_id % 35 AS INT) AS "at",
               CAST(1 + doc_id % 5 AS INT) AS score,
               doc_id % 4 AS thumbs_up,
               CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS review_title,
               lang AS title,
               CASE WHEN doc_id % 3 = 0 THEN body ELSE '' END AS review_text,
               CASE WHEN doc_id % 3 = 1 THEN body END AS text,
               CASE WHEN doc_id % 3 = 2 THEN body ELSE '' END AS content
        FROM (SELECT doc_id, source, lang, text || CASE length(text) % 12 {TAIL} ELSE '' END AS body FROM documents)""",
    "predictions": """
        SELECT doc_id AS source_review_id,
               CASE doc_id % 7 WHEN 0 THEN 'Execution & Performance' WHEN 1 THEN 'Payments & Withdrawals'
                    WHEN 2 THEN 'Charges & Transparency' WHEN 3 THEN 'KYC & Access'
                    WHEN 4 THEN 'UI & Feature Gaps' WHEN 5 THEN 'Not A Theme' END AS review_theme,
               CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' END AS sentiment,
               CAST(doc_id % 11 AS DOUBLE) / 10 AS confidence,
               'model' AS reason
        FROM documents WHERE doc_id % 13 <> 0""",
    "normalized": """
        SELECT source_review_id, "at" AS date, coalesce(score, 0) AS rating,
               coalesce(nullif(review_title, ''), nullif(title, ''), '') AS title,
               coalesce(nullif(review_text, ''), nullif(text, ''), nullif(content, ''), '') AS text,
               thumbs_up AS relevance
        FROM reviews_raw
        WHERE thumbs_up > 0 AND "at" BETWEEN DATE '2025-11-03' AND DATE '2025-12-07'""",
    "redacted": f"""
        SELECT source_review_id, date, rating, title, relevance, {_redact('text')} AS text FROM normalized""",
    "folded": f"""
        SELECT *, {_spaces('lower(' + _quotes(_emoji('text')) + ')')} AS folded FROM redacted""",
    "cleaned": f"""
        SELECT source_review_id, date, rating, title, relevance, text, {_spaces(_typos('folded'))} AS clean_text
        FROM folded""",
    "counted": f"""SELECT *, {_words('clean_text')} AS n_words FROM cleaned""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY clean_text ORDER BY date, source_review_id) AS rn,
               count(*) OVER (PARTITION BY clean_text) AS copies
        FROM counted""",
    "clean": f"""
        SELECT {_uuid('clean_text')} AS review_id, date, {_monday('date')} AS week_start_date,
               {_monday('date')} + 6 AS week_end_date, rating, title, text, clean_text, relevance,
               'google_play' AS source, source_review_id
        FROM ranked WHERE rn = 1 AND n_words >= 10""",
    "keyworded": f"""SELECT *, {THEME_CASE} AS kw_theme, {REASON_CASE} AS kw_reason FROM clean""",
    "merged": """
        SELECT k.*, p.review_theme AS m_theme, p.sentiment AS m_sentiment, p.confidence AS m_confidence,
               p.reason AS m_reason, p.source_review_id IS NOT NULL AS answered,
               NOT (coalesce(p.review_theme, '') IN (SELECT unnest(%s)) AND coalesce(p.confidence, 0.0) >= 0.4)
                 AS fallback_applied
        FROM keyworded k LEFT JOIN predictions p USING (source_review_id)""" % THEMES,
    "classified": f"""
        SELECT review_id, date, week_start_date, week_end_date, rating, title, text, clean_text, relevance, source,
               source_review_id,
               coalesce(m_sentiment, 'neutral') AS sentiment,
               CASE WHEN fallback_applied THEN kw_theme ELSE m_theme END AS review_theme,
               CAST(CASE WHEN NOT fallback_applied THEN m_confidence
                    WHEN m_confidence >= 0.4 THEN greatest(m_confidence, 0.45) ELSE 0.45 END AS DOUBLE) AS confidence,
               CASE WHEN fallback_applied THEN kw_reason ELSE coalesce(m_reason, '') END AS reason,
               CASE WHEN fallback_applied AND list_contains({THEMES}, m_theme) THEN m_theme END AS llm_suggested_theme,
               fallback_applied
        FROM merged""",
    "theme_stats": """
        SELECT review_theme AS theme, count(*) AS review_count, min(date) AS first_date,
               min({'d': date, 'i': review_id}) AS first_seen
        FROM classified GROUP BY 1""",
    "top": """
        SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY review_count DESC, first_seen) AS INT) AS theme_rank,
                              theme, review_count FROM theme_stats) WHERE theme_rank <= 3""",
    "week_top": """
        SELECT * FROM (
          SELECT week_start_date, theme, review_count,
                 CAST(row_number() OVER (PARTITION BY week_start_date ORDER BY review_count DESC, first_seen) AS INT)
                   AS theme_rank
          FROM (SELECT week_start_date, review_theme AS theme, count(*) AS review_count,
                       min({'d': date, 'i': review_id}) AS first_seen
                FROM classified GROUP BY ALL)) WHERE theme_rank <= 3""",
    "chunked": """
        SELECT *, p // 20 AS chunk_id, p % 20 AS ord FROM (
          SELECT review_theme AS theme, review_id, date, clean_text, relevance,
                 row_number() OVER (PARTITION BY review_theme ORDER BY date, review_id) - 1 AS p
          FROM classified)""",
    "week_chunked": """
        SELECT *, p // 20 AS chunk_id, p % 20 AS ord FROM (
          SELECT week_start_date, review_theme AS theme, review_id, date, clean_text, relevance,
                 row_number() OVER (PARTITION BY week_start_date, review_theme ORDER BY date, review_id) - 1 AS p
          FROM classified)""",
    "vocabulary": f"SELECT * FROM (VALUES {VALUES_PAIRS}) AS v(precedence, theme, position, keyword)",
}


def _chunk_ctes(prefix: str, keys: str, on: str, chunked: str, top: str) -> dict[str, str]:
    """Chunk results and what follows from them, for the whole table or per week."""
    return {
        f"{prefix}chosen": f"SELECT c.* FROM {chunked} c SEMI JOIN {top} t USING ({on})",
        f"{prefix}points": f"""
            SELECT {keys}, chunk_id, keyword AS key_point, rk - 1 AS pos FROM (
              SELECT *, row_number() OVER (PARTITION BY {keys}, chunk_id ORDER BY n DESC, position) AS rk FROM (
                SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, c.chunk_id, v.keyword, v.position,
                       count(*) AS n
                FROM {prefix}chosen c JOIN vocabulary v ON v.theme = c.theme AND contains(c.clean_text, v.keyword)
                GROUP BY ALL)) WHERE rk <= 5""",
        f"{prefix}quotes": f"""
            SELECT {keys}, chunk_id, clean_text AS quote, rk - 1 AS pos FROM (
              SELECT *, row_number() OVER (PARTITION BY {keys}, chunk_id ORDER BY relevance DESC, review_id) AS rk
              FROM {prefix}chosen) WHERE rk <= 3""",
        f"{prefix}best_quotes": f"""
            SELECT {keys}, quote, CAST(rk AS INT) AS rank FROM (
              SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY place) AS rk FROM (
                SELECT {keys}, quote, min({{'c': chunk_id, 'p': pos}}) AS place FROM {prefix}quotes GROUP BY ALL))
            WHERE rk <= 10""",
        f"{prefix}bullets": f"""
            SELECT {keys}, list(key_point ORDER BY place) AS bullets FROM (
              SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY place) AS rk FROM (
                SELECT {keys}, key_point, min({{'c': chunk_id, 'p': pos}}) AS place FROM {prefix}points GROUP BY ALL))
            WHERE rk <= 2 GROUP BY ALL""",
    }


CTES |= _chunk_ctes("", "theme", "theme", "chunked", "top")
CTES |= _chunk_ctes("week_", "week_start_date, theme", "week_start_date, theme", "week_chunked", "week_top")


def _pulse_ctes(prefix: str, keys: str, period: str, top: str) -> dict[str, str]:
    by = f"GROUP BY {period}" if period else ""
    comma = f"{period}, " if period else ""
    join = f"USING ({period})" if period else "ON true"
    idea = "'Look into ' || theme" if period else "NULL"
    return {
        f"{prefix}digest": f"""
            SELECT t.*, coalesce(b.bullets, []) AS bullets, q.quote
            FROM {top} t LEFT JOIN {prefix}bullets b USING ({keys})
            LEFT JOIN (SELECT * FROM {prefix}best_quotes WHERE rank = 1) q USING ({keys})""",
        f"{prefix}pulse": f"""
            SELECT {comma}start_date, end_date, themes, bodies, quotes, actions FROM (
              SELECT {comma}list({{'theme': theme, 'bullets': bullets}} ORDER BY theme_rank) AS themes,
                     list('*   **' || theme || ':** ' || array_to_string(bullets, ' ') ORDER BY theme_rank) AS bodies,
                     list(quote ORDER BY theme_rank) FILTER (quote IS NOT NULL) AS quotes,
                     list({idea} ORDER BY theme_rank) FILTER ({idea} IS NOT NULL) AS actions
              FROM {prefix}digest {by}) JOIN
              (SELECT {comma}min(date) AS start_date, max(date) AS end_date FROM classified {by}) {join}""",
        f"{prefix}noted": f"""
            SELECT *, '# Weekly App Review Pulse (' || strftime(start_date, '%Y-%m-%d') || '–'
                   || strftime(end_date, '%Y-%m-%d') || ')' || chr(10) || chr(10)
                   || '## Top Themes' || coalesce(chr(10) || nullif(array_to_string(bodies, chr(10)), ''), '')
                   || chr(10) || chr(10) || '## User Voice (Quotes)'
                   || coalesce(chr(10) || nullif(array_to_string(list_transform(quotes, lambda q: '*   "' || q || '"'),
                                                                 chr(10)), ''), '')
                   || chr(10) || chr(10) || '## Action Ideas'
                   || coalesce(chr(10) || nullif(array_to_string(list_transform(actions, lambda a: '*   ' || a), chr(10)), ''), '')
                   AS note_markdown
            FROM {prefix}pulse""",
        f"{prefix}flat": f"""
            SELECT start_date, end_date,
                   array_to_string(list_transform(themes,
                     lambda t: t.theme || '=' || array_to_string(t.bullets, ',')), ';') AS themes,
                   coalesce(array_to_string(quotes, '|'), '') AS quotes, coalesce(array_to_string(actions, '|'), '') AS action_ideas,
                   note_markdown
            FROM {prefix}noted""",
    }


CTES |= _pulse_ctes("", "theme", "", "top")
CTES |= _pulse_ctes("week_", "week_start_date, theme", "week_start_date", "week_top")
CTES |= {
    "summaries": f"""
        SELECT t.theme_rank, t.theme, coalesce(k.part, 0) AS part, t.review_count, coalesce(k.key_points, '') AS key_points,
               coalesce((SELECT string_agg(quote, '|' ORDER BY rank) FROM best_quotes q WHERE q.theme = t.theme), '')
                 AS quotes
        FROM top t LEFT JOIN (
          SELECT theme, chunk_id // {insight.CHUNKS_PER_PART} AS part, string_agg(key_point, '|' ORDER BY chunk_id, pos) AS key_points
          FROM points GROUP BY ALL) k USING (theme)""",
    "unchecked": f"""
        SELECT CASE WHEN source_review_id % 17 = 0 THEN 'not-a-uuid' ELSE {_uuid('text')} END AS review_id,
               CASE WHEN source_review_id % 19 <> 0 THEN date END AS date,
               {_monday('date')} AS week_start_date,
               {_monday('date')} + CAST(5 + source_review_id % 2 AS INT) AS week_end_date,
               rating - 1 AS rating, title, text, text AS clean_text, relevance,
               CASE WHEN source_review_id % 5 = 0 THEN 'elsewhere' ELSE 'google_play' END AS source, source_review_id
        FROM normalized""",
    "model_rows": """
        SELECT CAST(source_review_id AS VARCHAR) AS review_id, 1 AS rating, sentiment, review_theme,
               confidence * CASE WHEN source_review_id % 10 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
               false AS fallback_applied
        FROM predictions""",
    "stages": """
        SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS stage, min(ts) AS started_at, max(ts) AS ended_at,
               max(value) < 250 AS succeeded, count(*) AS n_rows,
               'layers/' || event_type AS output, 'over the limit in ' || event_type AS details
        FROM events GROUP BY ALL""",
    "run_rows": """
        SELECT run_id, CASE WHEN bool_and(succeeded) THEN 'success' ELSE 'error' END AS status,
               (min({'a': started_at, 's': stage}) FILTER (NOT succeeded)).s AS failed_stage,
               count(*) AS n_stages, min(started_at) AS run_start, max(ended_at) AS run_end,
               round(CAST(epoch_us(max(ended_at)) - epoch_us(min(started_at)) AS DOUBLE) / 1000000, 6) AS seconds,
               coalesce(string_agg(stage || '=' || output, ';' ORDER BY stage), '') AS outputs,
               coalesce(string_agg(stage || '=' || details, ';' ORDER BY stage) FILTER (NOT succeeded), '') AS details,
               CAST(min(started_at) AS DATE) AS window_start, CAST(max(ended_at) AS DATE) AS window_end
        FROM stages GROUP BY run_id""",
    "string_dates": """
        SELECT source_review_id,
               CASE source_review_id % 6 WHEN 0 THEN strftime("at", '%Y-%m-%d')
                    WHEN 1 THEN strftime("at", '%Y-%m-%d') || 'T10:11:12' WHEN 2 THEN '2025-1-5'
                    WHEN 3 THEN '2025-13-05' WHEN 4 THEN '' END AS "at"
        FROM reviews_raw""",
}

TEN = "review_id, date, week_start_date, week_end_date, rating, title, text, clean_text, relevance, source"
EIGHT = "review_id, date, rating, title, text, clean_text, relevance, source"
TWELVE = (
    "review_id, date, rating, title, text, clean_text, sentiment, review_theme, confidence, reason, "
    "llm_suggested_theme, fallback_applied"
)


def _with(statement: str) -> str:
    """The statement behind the table expressions that it needs, directly or not."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                visit(CTES[name])
                needed.append(name)

    visit(statement)
    # A name is only ever used after its definition; visiting in depth keeps that order.
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + f"\n{statement}" if needed else statement


def _checks(table: str, checks: dict[str, str]) -> str:
    return "\nUNION ALL ".join(
        f'SELECT {_q(name)} AS "check", count(*) FILTER ({bad}) = 0 AS passed, '
        f"CAST(count(*) FILTER ({bad}) AS BIGINT) AS n_bad FROM {table}"
        for name, bad in checks.items()
    )


def _null(*columns: str) -> str:
    return " OR ".join(f"{c} IS NULL" for c in columns)


CLEAN_CHECKS = {
    "required_fields": _null(*TEN.split(", ")),
    "rating_range": "coalesce(rating NOT BETWEEN 1 AND 5, true)",
    "source_constant": "coalesce(source <> 'google_play', true)",
    "dates_valid": _null("date", "week_start_date", "week_end_date"),
    "week_span": "coalesce(week_end_date - week_start_date <> 6, true)",
    "date_in_week": "coalesce(date < week_start_date OR date > week_end_date, true)",
    "text_present": _null("text", "clean_text"),
    "clean_lowercase": "coalesce(clean_text <> lower(clean_text), true)",
    "clean_trimmed": r"coalesce(regexp_matches(clean_text, '\A\s|\s\z'), true)",
    "clean_single_spaced": "coalesce(contains(clean_text, '  '), true)",
    "emoji_free": f"coalesce(regexp_matches(clean_text, {_q(EMOJI)}), true)",
    "id_is_uuid": "coalesce(NOT regexp_full_match(review_id, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}'), true)",
    "pii_residual": f"coalesce({_redact('text')} <> text, true)",
}
CLASSIFIED_CHECKS = {
    "required_fields": _null("review_id", "rating", "sentiment", "review_theme", "confidence", "fallback_applied"),
    "theme_domain": f"NOT coalesce(list_contains({THEMES}, review_theme), false)",
    "sentiment_domain": "coalesce(sentiment NOT IN ('positive', 'negative', 'neutral'), true)",
    "confidence_range": "coalesce(confidence NOT BETWEEN 0 AND 1, true)",
    "completeness": "coalesce(review_id = '', true) OR coalesce(sentiment = '', true) OR "
                    "coalesce(review_theme = '', true) OR coalesce(confidence = 0, true)",
}


def _row_checks(*names: str) -> str:
    return _checks("unchecked", {n: CLEAN_CHECKS[n] for n in names})


def _model_checks(*names: str) -> str:
    return _checks("model_rows", {n: CLASSIFIED_CHECKS[n] for n in names})


def _unique(table: str) -> str:
    return (
        'SELECT \'id_unique\' AS "check", coalesce(sum(n - 1), 0) = 0 AS passed, '
        f"CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_bad FROM (SELECT count(*) AS n FROM {table} GROUP BY review_id)"
    )


def _spread(table: str) -> str:
    bad = "CASE WHEN count(*) = 0 OR min(rating) < max(rating) THEN 0 ELSE 1 END"
    return f"SELECT 'rating_spread' AS \"check\", {bad} = 0 AS passed, CAST({bad} AS BIGINT) AS n_bad FROM {table}"


def _present(table: str, absent: int, layer: str) -> str:
    return (
        f"SELECT 'columns_present' AS \"check\", {absent} = 0 AS passed, CAST(count(*) * 0 + {absent} AS BIGINT) AS n_bad, "
        f"{_q(layer)} AS layer FROM {table}"
    )


def _all_bad(table: str, layer: str) -> str:
    return f"SELECT 'required_fields' AS \"check\", count(*) = 0 AS passed, count(*) AS n_bad, {_q(layer)} AS layer FROM {table}"


TIMELINE = f"(?i)({config.TIMELINE_PATTERN})"
COMPARED = TEN.split(", ")[1:]


def _compare() -> str:
    newer = f"SELECT {TEN} FROM clean WHERE relevance < 3"
    older = (
        "SELECT review_id, date, week_start_date, week_end_date, "
        "CASE WHEN source_review_id % 7 = 0 THEN rating + 1 ELSE rating END AS rating, "
        "CASE WHEN source_review_id % 11 <> 0 THEN title END AS title, text, clean_text, relevance, source "
        "FROM clean WHERE relevance > 1"
    )
    findings = [
        ("rows_left", "l.review_id IS NOT NULL"), ("rows_right", "r.review_id IS NOT NULL"),
        ("keys_left_only", "r.review_id IS NULL"), ("keys_right_only", "l.review_id IS NULL"),
        ("keys_count_differs", "false"),
        *[(f"differs_{c}",
           f"l.review_id IS NOT NULL AND r.review_id IS NOT NULL AND l.{c} IS DISTINCT FROM r.{c}") for c in COMPARED],
    ]
    both = f"({newer}) l FULL JOIN ({older}) r ON l.review_id = r.review_id"
    return "\nUNION ALL ".join([
        *[f"SELECT {_q(name)} AS finding, CAST(count(*) FILTER ({test}) AS BIGINT) AS n FROM {both}" for name, test in findings],
        *_columns_apart(0),
    ])


def _columns_apart(n: int) -> list[str]:
    return [
        f"SELECT 'columns_{name}' AS finding, CAST(count(*) * 0 + {n} AS BIGINT) AS n FROM clean"
        for name in ("left_only", "right_only", "type_differs")
    ]


SAME_ROWS = "\nUNION ALL ".join([
    "SELECT 'rows_left' AS finding, count(*) AS n FROM clean", "SELECT 'rows_right' AS finding, count(*) AS n FROM clean",
    *[
        f"SELECT {_q(name)} AS finding, CAST(count(*) * 0 AS BIGINT) AS n FROM clean"
        for name in ("keys_left_only", "keys_right_only", "keys_count_differs", "differs_date", "differs_text",
                     "differs_clean_text", "differs_source")
    ],
    *_columns_apart(1),
])


WINDOWS = "\nUNION ALL ".join(
    f"SELECT {n} AS window_days, DATE '2025-12-07' - {n - 1} AS start_date, DATE '2025-12-07' AS end_date, "
    f"count(*) FILTER (\"at\" BETWEEN DATE '2025-12-07' - {n - 1} AND DATE '2025-12-07') AS n_reviews FROM reviews_raw"
    for n in (7, 14, 21, 28, 35)
)

CHECKED_SUITE = "\nUNION ALL ".join([
    f"SELECT *, 'clean' AS layer FROM ({_checks('classified', CLEAN_CHECKS)})",
    f"SELECT *, 'clean' AS layer FROM ({_unique('classified')})",
    f"SELECT *, 'clean' AS layer FROM ({_spread('classified')})",
    f"SELECT *, 'classified' AS layer FROM ({_checks('classified', CLASSIFIED_CHECKS)})",
    _present("classified", 0, "clean"),
    _present("classified", 0, "classified"),
    "SELECT 'summary_count' AS \"check\", true AS passed, CAST(count(*) * 0 AS BIGINT) AS n_bad, 'classified' AS layer FROM classified",
    "SELECT 'summary_mean' AS \"check\", true AS passed, CAST(count(*) * 0 AS BIGINT) AS n_bad, 'classified' AS layer FROM classified",
])

RECONCILE = """
    SELECT unnest(['summary_count', 'summary_mean']) AS "check", unnest([n = m, abs(a - b) < 0.001]) AS passed,
           CAST(unnest([CASE WHEN n = m THEN 0 ELSE 1 END, CASE WHEN abs(a - b) < 0.001 THEN 0 ELSE 1 END]) AS BIGINT) AS n_bad
    FROM (SELECT count(*) AS n, avg(confidence) AS a, count(*) FILTER (relevance <> 2) AS m,
                 round(avg(confidence) FILTER (relevance <> 2), 6) AS b FROM classified)"""

SUMMARY = f"""
    SELECT count(*) AS total_input, count(*) AS total_output,
           (SELECT string_agg(t || '=' || n, ';' ORDER BY i) FROM
             (SELECT i, {THEMES}[i] AS t, (SELECT count(*) FROM classified WHERE review_theme = {THEMES}[i]) AS n
              FROM range(1, {len(config.TAXONOMY.names) + 1}) r(i))) AS counts_by_theme,
           count(*) FILTER (fallback_applied) AS re_prompts_or_fallbacks,
           round(coalesce(avg(confidence), 0), 6) AS average_confidence
    FROM classified"""

KEYWORD_HITS = " \nUNION ALL ".join(
    f"""SELECT {_q(theme)} AS theme, hit AS keyword, count(*) AS n_reviews,
        count(*) FILTER (kw_theme = {_q(theme)}) AS n_deciding
        FROM (SELECT kw_theme, list_filter({_list(words)}, lambda k: contains(lower(clean_text), k))[1] AS hit FROM keyworded)
        WHERE hit IS NOT NULL GROUP BY ALL"""
    for theme, words in config.TAXONOMY.themes
)

PROMPT_ITEMS = (
    "list({'review_id': review_id, 'text': substr(clean_text, 1, 500)} ORDER BY p)"
)

PROMPTS = (
    "SELECT p // 10 AS batch_id, count(*) AS n_reviews, "
    "'Give each review a theme, a sentiment and a confidence. Answer with a JSON array.' || chr(10) || chr(10) "
    f"|| CAST(to_json({PROMPT_ITEMS}) AS VARCHAR) AS prompt FROM "
    "(SELECT *, row_number() OVER (ORDER BY date, review_id) - 1 AS p FROM clean) GROUP BY 1"
)
CHUNK_TEXTS = (
    "SELECT theme, chunk_id, count(*) AS n_reviews, "
    "string_agg('- ' || substr(clean_text, 1, 200), chr(10) ORDER BY ord) AS reviews_list FROM chunked GROUP BY 1, 2"
)

STATEMENTS = {
    # sources and sinks
    "scan_reviews": 'SELECT * FROM reviews_raw ORDER BY "at" DESC, source_review_id',
    "read_landed_json": "SELECT * REPLACE (CAST(source_review_id AS VARCHAR) AS source_review_id) FROM normalized",
    "read_records_json": f"SELECT {TEN} FROM clean",
    "read_split_records": f"SELECT {TEN} FROM clean",
    "read_pulse_json": "SELECT * FROM week_flat",
    "read_reviews_csv": "SELECT rating, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS text_chars, "
                        "max(clean_text) AS last_text, min(date) AS first_date FROM clean GROUP BY rating",
    "latest_run": "SELECT strftime(start_date, '%Y%m%d') || '_' || strftime(end_date, '%Y%m%d') AS run_key, start_date, "
                  "end_date, note_markdown FROM week_noted ORDER BY 1 LIMIT 1",
    "latest_finished": "SELECT 'first-week' AS run_key, start_date, end_date, note_markdown FROM week_noted "
                       "ORDER BY start_date LIMIT 1",
    "write_clean": f"SELECT {TEN} FROM clean",
    "write_clean_csv": f"SELECT {EIGHT} FROM clean",
    "write_report_json": "SELECT week_start_date, week_end_date, count(*) AS n FROM clean GROUP BY ALL",
    "write_classified": f"SELECT {TWELVE}, count(*) OVER () AS summary_total FROM classified",
    "write_classified_csv": f"SELECT {TWELVE} FROM classified",
    "write_theme_summaries": "SELECT * FROM summaries",
    "write_pulse": "SELECT * FROM week_flat",
    "write_run_summary": "SELECT * FROM run_rows",
    "run_key": "SELECT strftime(min(date), '%Y%m%d') || '_' || strftime(max(date), '%Y%m%d') AS run_key FROM normalized",
    # filters and projections
    "filter_relevance": "SELECT source_review_id, thumbs_up FROM reviews_raw WHERE thumbs_up > 0",
    "date_window": WINDOWS,
    "filter_date_range": 'SELECT source_review_id, "at" FROM reviews_raw '
                         "WHERE \"at\" BETWEEN DATE '2025-11-10' AND DATE '2025-12-07'",
    "normalize_date": "SELECT source_review_id, CAST(try_strptime(substr(\"at\", 1, 10), '%Y-%m-%d') AS DATE) AS date "
                      "FROM string_dates",
    "filter_valid_date": "SELECT * FROM string_dates WHERE try_strptime(substr(\"at\", 1, 10), '%Y-%m-%d') IS NOT NULL",
    "coalesce_text": "SELECT source_review_id, coalesce(nullif(review_text, ''), nullif(text, ''), nullif(content, ''), '') "
                     "AS body FROM reviews_raw",
    "coalesce_title": "SELECT source_review_id, coalesce(nullif(review_title, ''), nullif(title, ''), '') AS title "
                      "FROM reviews_raw",
    "cast_rating": "SELECT source_review_id, CASE WHEN score <> 3 THEN score ELSE 0 END AS rating FROM reviews_raw",
    "normalize_reviews": "SELECT * FROM normalized WHERE date >= DATE '2025-11-10'",
    "filter_min_words": "SELECT source_review_id, n_words FROM counted WHERE n_words >= 10",
    "project_clean_schema": f"SELECT {TEN} FROM clean",
    "truncate_for_model": "SELECT source_review_id, substr(text, 1, 500) AS for_scoring, substr(text, 1, 200) AS for_chunks "
                          "FROM normalized",
    # strings
    **{
        f"redact_{r.name}": f"SELECT source_review_id, {_replace('text', r.pattern, r.tag)} AS redacted FROM normalized"
        for r in config.PII_RULES
    },
    "redact_pii": f"SELECT source_review_id, {_redact('text')} AS redacted FROM normalized",
    "remove_emoji": f"SELECT source_review_id, {_emoji('text')} AS plain FROM normalized",
    "normalize_quotes": f"SELECT source_review_id, {_quotes('text')} AS plain FROM normalized",
    "lowercase": "SELECT source_review_id, lower(text) AS lowered FROM normalized",
    "collapse_whitespace": f"SELECT source_review_id, {_spaces('text')} AS collapsed FROM normalized",
    "correct_typos": f"SELECT source_review_id, {_typos('text')} AS corrected FROM normalized",
    "clean_text": "SELECT source_review_id, clean_text FROM cleaned",
    "word_count": f"SELECT source_review_id, {_words('text')} AS n_words FROM normalized",
    # dates
    "week_bounds": f'SELECT source_review_id, "at" AS date, {_monday(chr(34) + "at" + chr(34))} AS week_start_date, '
                   f'{_monday(chr(34) + "at" + chr(34))} + 6 AS week_end_date FROM reviews_raw',
    "compact_date": "SELECT source_review_id, strftime(\"at\", '%Y%m%d') AS compact FROM reviews_raw",
    "date_range": "SELECT min(date) AS start_date, max(date) AS end_date FROM clean",
    "stage_durations": "SELECT run_id, stage, round(CAST(epoch_us(ended_at) - epoch_us(started_at) AS DOUBLE) / 1000000, 6) "
                       "AS seconds FROM stages",
    # dedup, order, limits
    "dedup_earliest": "SELECT source_review_id, date, rating, clean_text, copies FROM ranked WHERE rn = 1",
    "dedup_late": "SELECT source_review_id, date, rating, clean_text, copies FROM ranked WHERE rn = 1",
    "surrogate_id": "SELECT review_id, source_review_id FROM clean",
    "sort_by_date": "SELECT date, review_id, rating FROM clean ORDER BY date, review_id",
    "sample_records": f"SELECT {TEN} FROM clean ORDER BY date, review_id LIMIT 3",
    "top_themes": "SELECT theme_rank, theme, review_count FROM top",
    "top_themes_weekly": "SELECT week_start_date, theme_rank, theme, review_count FROM week_top",
    "top_quotes": "SELECT theme, rank, quote FROM best_quotes",
    "report_top3": "SELECT week_start_date, array_to_string(quotes[1:3], '|') AS quotes, array_to_string(actions[1:3], '|') AS action_ideas FROM week_pulse",
    # aggregations
    "processing_funnel": "SELECT (SELECT count(*) FROM normalized) AS total_input, "
                         "count(*) AS after_min_word_filter, count(*) FILTER (rn > 1) AS duplicates_removed, "
                         "count(*) FILTER (rn = 1) AS total_output FROM ranked WHERE n_words >= 10",
    "skip_counts": "SELECT count(*) AS n_raw, count(*) FILTER (NOT coalesce(thumbs_up > 0, false)) AS skipped_relevance, "
                   "count(*) FILTER (thumbs_up > 0 AND \"at\" NOT BETWEEN DATE '2025-11-10' AND DATE '2025-12-07') "
                   "AS skipped_date FROM reviews_raw",
    "rating_distribution": "SELECT CAST(r AS INT) AS rating, count(source_review_id) AS n FROM range(1, 6) t(r) "
                           "LEFT JOIN clean ON rating = r GROUP BY r",
    "rating_share": f"SELECT rating, n, {_pct('n')} AS pct FROM (SELECT rating, count(*) AS n FROM clean GROUP BY rating)",
    "weekly_distribution": "SELECT week_start_date, week_end_date, count(*) AS n FROM clean GROUP BY ALL ORDER BY 1",
    "group_by_theme": "SELECT theme, review_count, first_seen.d AS first_date, first_seen.i AS first_id FROM theme_stats",
    "theme_counts": f"SELECT t.review_theme, count(c.review_id) AS n FROM (SELECT unnest({THEMES}) AS review_theme) t "
                    "LEFT JOIN classified c USING (review_theme) GROUP BY 1",
    "classification_summary": SUMMARY,
    "fallback_by_theme": "SELECT review_theme, count(*) AS n_fallbacks FROM classified WHERE fallback_applied GROUP BY 1",
    "theme_share": f"SELECT review_theme, n, {_pct('n')} AS pct FROM "
                   "(SELECT review_theme, count(*) AS n FROM classified GROUP BY 1)",
    "sentiment_distribution": f"SELECT sentiment, n, {_pct('n')} AS pct FROM (SELECT s.sentiment, count(review_id) AS n "
                              f"FROM (SELECT unnest({_list(config.SENTIMENTS)}) AS sentiment) s "
                              "LEFT JOIN classified USING (sentiment) GROUP BY 1)",
    "confidence_stats": "SELECT min(confidence) AS min_confidence, max(confidence) AS max_confidence, "
                        "round(avg(confidence), 6) AS avg_confidence FROM classified",
    "pii_tag_counts": "SELECT count(*) FILTER (tagged) AS with_tags, count(*) FILTER (NOT tagged) AS without_tags FROM "
                      f"(SELECT {' OR '.join(f'contains(text, {_q(t)})' for t in config.PII_TAGS)} AS tagged FROM clean)",
    "keyword_hits": KEYWORD_HITS,
    # joins
    "merge_predictions": "SELECT source_review_id, date, m_theme AS model_review_theme, m_sentiment AS model_sentiment, "
                         "m_confidence AS model_confidence, m_reason AS model_reason, answered AS model_answered FROM merged",
    "merge_layers": "SELECT source_review_id, date, m_theme AS model_review_theme, m_sentiment AS model_sentiment, "
                         "m_confidence AS model_confidence, m_reason AS model_reason, answered AS model_answered FROM merged",
    "enrich_join": "SELECT p.source_review_id, p.review_theme, p.confidence, c.date, coalesce(c.rating, 0) AS rating, "
                   "coalesce(c.title, '') AS title, coalesce(c.text, '') AS text, coalesce(c.clean_text, '') AS clean_text "
                   "FROM predictions p LEFT JOIN clean c USING (source_review_id)",
    "compare_outputs": _compare(),
    "compare_columns": SAME_ROWS,
    # classification
    "theme_taxonomy": "SELECT v.precedence, v.theme, v.position, v.keyword, v.theme = 'UI & Feature Gaps' AS is_default, "
                      "count(c.review_id) AS n_reviews FROM vocabulary v LEFT JOIN clean c "
                      "ON contains(lower(c.clean_text), v.keyword) GROUP BY ALL",
    "classify_keywords": "SELECT review_id, kw_theme AS review_theme, CAST(0.45 AS DOUBLE) AS confidence, "
                         "kw_reason AS reason FROM keyworded",
    "batch_reviews": "SELECT review_id, p // 10 AS batch_id, p % 10 AS ord FROM "
                     "(SELECT review_id, row_number() OVER (ORDER BY date, review_id) - 1 AS p FROM clean)",
    "build_prompt": PROMPTS,
    # the stub model fails on prompts whose length divides by five
    "score_batches": f"SELECT batch_id, n_reviews, length(prompt) % 5 <> 0 AS answered FROM ({PROMPTS})",
    "score_kept": f"SELECT batch_id, n_reviews, length(prompt) % 5 <> 0 AS answered FROM ({PROMPTS})",
    "score_retry": f"""
        SELECT NOT (answered AND least(length(clean_text), 500) % 10 >= 4) AS fallback_applied, count(*) AS n
        FROM (SELECT clean_text, (row_number() OVER (ORDER BY date, review_id) - 1) // 10 AS batch_id FROM clean)
        JOIN (SELECT batch_id, length(prompt) % 5 <> 0 AS answered FROM ({PROMPTS})) USING (batch_id) GROUP BY 1""",
    "parse_response": "SELECT CAST(doc_id AS VARCHAR) AS review_id, lang AS review_theme, source AS sentiment, "
                      "CAST(doc_id % 10 AS DOUBLE) / 10 AS confidence, text AS reason FROM documents WHERE doc_id % 4 < 2",
    "validate_predictions": "SELECT review_id, review_theme, sentiment, confidence, llm_suggested_theme, fallback_applied "
                            "FROM classified",
    "full_fallback": "SELECT review_id, kw_theme AS review_theme, 'neutral' AS sentiment, CAST(0.45 AS DOUBLE) AS confidence, "
                     "kw_reason AS reason, CAST(NULL AS VARCHAR) AS llm_suggested_theme, true AS fallback_applied FROM keyworded",
    "classify_reviews": f"SELECT {TWELVE} FROM classified",
    # insight
    "chunk_reviews": "SELECT theme, chunk_id, ord, review_id FROM chunked",
    "chunk_text": CHUNK_TEXTS,
    # the stub model fails on prompts whose length divides by four
    "parse_object_response": f"""
        SELECT theme, chunk_id, len(string_split(reviews_list, chr(10))) || ' lines' AS key_points,
               substr(string_split(reviews_list, chr(10))[1], 3) AS quotes
        FROM ({CHUNK_TEXTS}) WHERE length(reviews_list) % 4 <> 0""",
    "map_summarize": "SELECT theme, chunk_id, coalesce((SELECT string_agg(key_point, '|' ORDER BY pos) FROM points p "
                     "WHERE p.theme = c.theme AND p.chunk_id = c.chunk_id), '') AS key_points, "
                     "(SELECT string_agg(quote, '|' ORDER BY pos) FROM quotes q "
                     "WHERE q.theme = c.theme AND q.chunk_id = c.chunk_id) AS quotes "
                     "FROM (SELECT DISTINCT theme, chunk_id FROM chosen) c",
    "collect_key_points": "SELECT theme, chunk_id, pos, key_point FROM points",
    "theme_summary": "SELECT * FROM summaries",
    "reduce_pulse": "SELECT * FROM flat",
    "pulse_note": "SELECT week_start_date, note_markdown FROM week_noted",
    "note_word_limit": f"SELECT week_start_date, {_words('note_markdown')} AS note_words, "
                       f"{_words('note_markdown')} <= 250 AS within_limit FROM week_noted",
    "generate_pulse": "SELECT * FROM week_flat",
    # report columns
    "pulse_counts": "SELECT week_start_date, CAST(len(themes) AS BIGINT) AS n_themes, "
                    "CAST(len(quotes) AS BIGINT) AS n_quotes, CAST(len(actions) AS BIGINT) AS n_actions FROM week_pulse",
    "priority_signal": "SELECT week_start_date, theme, CASE theme_rank WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' "
                       "ELSE 'FOCUS' END AS priority_signal FROM week_top",
    "bullet_category": "SELECT review_id, CASE "
                       "WHEN contains(c, 'crash') OR contains(c, 'error') OR contains(c, 'bug') THEN 'defect' "
                       "WHEN contains(c, 'feature') OR contains(c, 'ui') THEN 'feature' "
                       "WHEN contains(c, 'performance') OR contains(c, 'speed') THEN 'performance' "
                       "WHEN contains(c, 'user') OR contains(c, 'experience') THEN 'experience' ELSE 'general' END AS category "
                       "FROM (SELECT review_id, lower(clean_text) AS c FROM clean)",
    "action_timeline": f"""
        SELECT source_review_id, timeline,
               CASE WHEN timeline IS NULL THEN trim(action, ' ')
                    ELSE trim(regexp_replace(action, '\\s*-?\\s*' || timeline, '', 'g'), ' ') END AS action
        FROM (SELECT source_review_id, action, nullif(regexp_extract(action, {_q(TIMELINE)}, 1), '') AS timeline FROM (
          SELECT source_review_id, clean_text || CASE source_review_id % 4 WHEN 0 THEN ' - Next 2 Sprints'
                 WHEN 1 THEN ' within 3 WEEKS' WHEN 2 THEN ' - 1 sprint, soon' ELSE '' END AS action FROM clean))""",
    # data quality
    "dq_required_fields": f"SELECT *, 'clean' AS layer FROM ({_row_checks('required_fields')}) UNION ALL "
                          f"SELECT *, 'classified' AS layer FROM ({_model_checks('required_fields')}) UNION ALL "
                          f"{_present('unchecked', 0, 'clean')} UNION ALL {_present('model_rows', 0, 'classified')}",
    "dq_absent_columns": f"{_all_bad('unchecked', 'clean')} UNION ALL {_all_bad('model_rows', 'classified')} UNION ALL "
                         f"{_present('unchecked', 1, 'clean')} UNION ALL {_present('model_rows', 1, 'classified')}",
    "dq_rating_source": _row_checks("rating_range", "source_constant"),
    "dq_dates": _row_checks("dates_valid", "week_span", "date_in_week"),
    "dq_text": _row_checks("text_present", "clean_lowercase", "clean_trimmed", "clean_single_spaced"),
    "dq_emoji_free": _row_checks("emoji_free"),
    "dq_pii_residual": _row_checks("pii_residual"),
    "dq_theme_domain": _model_checks("theme_domain"),
    "dq_sentiment_domain": _model_checks("sentiment_domain"),
    "dq_confidence_range": _model_checks("confidence_range"),
    "dq_completeness": _model_checks("completeness"),
    "dq_unique_ids": _row_checks("id_is_uuid") + "\nUNION ALL " + _unique("unchecked"),
    "dq_rating_spread": _spread("clean"),
    "dq_summary_reconcile": RECONCILE,
    "dq_suite": CHECKED_SUITE,
    # streams
    "incremental_clean": "SELECT source_review_id, date, rating, text, clean_text, n_words, copies FROM ranked "
                         "WHERE rn = 1 AND n_words >= 10",
    "stream_compact": "SELECT source_review_id, date, clean_text, 2 * copies AS copies FROM ranked "
                      "WHERE rn = 1 AND n_words >= 10",
    "stream_dedup": "SELECT source_review_id, date, clean_text, 2 * copies AS copies FROM ranked "
                    "WHERE rn = 1 AND n_words >= 10",
    "stream_late_rows": "SELECT count(*) AS rows_read, count(*) - count(ts) AS rows_undated, "
    "CAST(count(ts) - coalesce(sum(late), 0) AS BIGINT) AS rows_counted, CAST(coalesce(sum(late), 0) AS BIGINT) AS rows_late FROM ("
    "SELECT ts, CAST(ts < newest - INTERVAL 7 DAY AND date_trunc('week', ts) + INTERVAL 7 DAY <= newest - INTERVAL 10 DAY AS INT) AS late "
    "FROM events, (SELECT max(ts) AS newest FROM events))",
    "stream_weekly_counts": "SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start_date, "
                            "CAST(date_trunc('week', ts) AS DATE) + 6 AS week_end_date, event_type, count(*) AS n "
                            "FROM events GROUP BY ALL",
    # runs
    "run_summary": "SELECT * FROM run_rows",
    "weekly_pulse": "SELECT * FROM week_flat",
}


def oracle_sql() -> dict[str, str]:
    return {name: _with(statement) for name, statement in STATEMENTS.items()}
