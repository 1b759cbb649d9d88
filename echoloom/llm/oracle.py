"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from echoloom.llm import licenses

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


def _words(column: str) -> str:
    return rf"regexp_extract_all({_lower(column)}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"


EXACT_DEDUP = r"""
WITH bodies AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept,
       sha256(body) AS text_sha256, CAST(0 AS INTEGER) AS chain
FROM bodies WINDOW same AS (PARTITION BY body)
"""

DECONTAMINATE = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS pattern
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, {_words('text')} AS w FROM documents),
places AS (
  SELECT doc_id, p, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS pattern
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM docs, (SELECT DISTINCT m FROM patterns))
),
found AS (SELECT doc_id, p, m, item FROM places JOIN patterns USING (m, pattern)),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS word FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""



def _licenses() -> str:
    values = ",\n".join(
        f"({rule}, '{keyword}', '{label}', {str(base).lower()}, {priority}, {weight}, '{pattern}')"
        for rule, keyword, label, base, priority, weight, pattern in licenses.rules()
    )
    blanks = "(length({0}) - length(replace({0}, ' ', ''))) // 2"
    return f"""
WITH rules(rule, keyword, label, is_base, priority, weight, pattern) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS nr, doc_id, {_words('text')} AS w FROM documents),
bodies AS (SELECT nr, doc_id, CAST(len(w) AS BIGINT) AS n_words, ' ' || array_to_string(w, '  ') || ' ' AS body FROM docs),
tried AS (
  SELECT nr, rule, label, is_base, priority, CAST(weight AS DOUBLE) AS weight, regexp_extract_all(body, pattern) AS hits, string_split_regex(body, pattern) AS gaps
  FROM bodies JOIN rules ON contains(body, ' ' || keyword || ' ')
),
found AS (
  SELECT nr, rule, label, is_base, priority, weight, i, {blanks.format('hits[i]')} AS length, {blanks.format('gaps[i]')} AS gap
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM tried)
),
placed AS (
  SELECT nr, rule, label, is_base, priority, weight, length,
         CAST(sum(gap + length) OVER (PARTITION BY nr, rule ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM found
),
judged AS (
  SELECT *, stop - length AS start,
         coalesce(max(stop) OVER (PARTITION BY nr ORDER BY stop - length, stop DESC, priority, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= stop, false) AS inside
  FROM placed
),
summed AS (
  SELECT nr, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word,
         coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (is_base))), ','), '') AS base_labels,
         coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (is_base OR NOT inside))), ','), '') AS labels,
         max(weight) FILTER (is_base OR NOT inside) AS score
  FROM judged GROUP BY nr
)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM bodies LEFT JOIN summed USING (nr)
"""


#: The multipliers by halving an interval, where the operator takes Newton steps.
MIXING = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ' '))[1:15] AS BIGINT) AS tie
  FROM documents
),
cells AS (SELECT source, size, count(*) AS n FROM docs GROUP BY ALL),
sums AS (
  SELECT source, CAST(sum(n * size) AS BIGINT) AS total, sum(n) AS n_docs, min(size) FILTER (size > 0) AS least,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM cells GROUP BY source
),
poured AS (
  SELECT *, 1.5 * sum(total) OVER () - coalesce(sum(2 * total) OVER before, 0) AS remaining, sum(weight) OVER onward AS open_weight
  FROM sums
  WINDOW before AS (ORDER BY total / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY total / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
first_open AS (SELECT min_by({'l': remaining, 'w': open_weight}, total / weight) AS f FROM poured WHERE 2.0 * total * open_weight > remaining * weight),
targets AS (
  SELECT source, total, total / n_docs AS mean, least,
         CASE WHEN 2.0 * total * open_weight <= remaining * weight THEN CAST(2 * total AS DOUBLE)
              ELSE CAST(f.l AS DOUBLE) * weight / CAST(f.w AS DOUBLE) END AS target
  FROM poured LEFT JOIN first_open ON true
),
halved AS (
  SELECT source, ln(least(1, target / total)) * mean / least * 1.000001 AS low, ln(2) * mean / least * 1.000001 AS high, 0 AS step
  FROM targets WHERE total > 0
  UNION ALL
  SELECT source, CASE WHEN words < target THEN mid ELSE low END, CASE WHEN words < target THEN high ELSE mid END, step + 1
  FROM (
    SELECT h.source, low, high, step, (low + high) / 2 AS mid, any_value(target) AS target,
           sum(n * size * least(2.0, exp((low + high) / 2 * size / mean))) AS words
    FROM halved h JOIN targets t ON h.source IS NOT DISTINCT FROM t.source JOIN cells c ON h.source IS NOT DISTINCT FROM c.source
    WHERE step < 100 AND target < 2 * total GROUP BY h.source, low, high, step
  )
),
multipliers AS (SELECT source, max_by(high, step) AS multiplier FROM halved GROUP BY source),
rated AS (
  SELECT c.source, size, n, target, total, CAST(round(coalesce(least(2.0, exp(multiplier * size / mean)), 1) * 16777216) AS BIGINT) AS rate
  FROM cells c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source LEFT JOIN multipliers m ON c.source IS NOT DISTINCT FROM m.source
),
summed AS (SELECT *, (CAST(sum(n * rate) OVER (PARTITION BY source ORDER BY size) AS BIGINT) + 8388608) >> 24 AS upto FROM rated),
rounded AS (SELECT *, upto - coalesce(lag(upto) OVER (PARTITION BY source ORDER BY size), 0) AS copies FROM summed),
mended AS (
  SELECT source, CAST(round(any_value(target)) - sum(copies * size) AS BIGINT) AS rest, CAST(NULL AS BIGINT) AS size, CAST(0 AS BIGINT) AS change
  FROM rounded GROUP BY source
  UNION ALL
  SELECT source, rest - change * size, size, change
  FROM (
    SELECT source, rest, size, least(room, abs(rest) // size) * sign(rest) AS change
    FROM (
      SELECT m.source, m.rest, max(r.size) AS size, arg_max(CASE WHEN m.rest > 0 THEN 2 * n - copies ELSE copies END, r.size) AS room
      FROM mended m JOIN rounded r ON m.source IS NOT DISTINCT FROM r.source
      WHERE r.size > 0 AND r.size <= abs(m.rest) AND (m.size IS NULL OR r.size < m.size) AND CASE WHEN m.rest > 0 THEN 2 * n - copies ELSE copies END > 0
      GROUP BY m.source, m.rest
    )
  )
),
final AS (
  SELECT r.source, r.size, n, target, total, CAST(copies + coalesce(change, 0) AS BIGINT) AS copies
  FROM rounded r LEFT JOIN mended m ON r.source IS NOT DISTINCT FROM m.source AND r.size = m.size
),
placed AS (SELECT *, row_number() OVER (PARTITION BY source, size ORDER BY tie, doc_id NULLS FIRST) - 1 AS place FROM docs)
SELECT doc_id, p.size, total AS source_size, target, copies // n + CAST(place < copies % n AS BIGINT) AS copies,
       p.size * (copies // n + CAST(place < copies % n AS BIGINT)) AS taken
FROM placed p JOIN final f ON p.source IS NOT DISTINCT FROM f.source AND p.size = f.size
"""

HARD_NEGATIVES = """
WITH whole AS (
  SELECT row_number() OVER () AS nr, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.nr AS anchor, a.vec_id AS anchor_id, r.nr, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM whole a JOIN whole r ON a.nr <> r.nr WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor, anchor_id, nr AS positive, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, nr) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
WINDOW best AS (PARTITION BY p.anchor, positive ORDER BY n.score DESC, n.vec_id, n.nr)
QUALIFY row_number() OVER best <= 10
"""


ORACLE = {"op3_exact_dedup": EXACT_DEDUP, "op5_licenses": _licenses(), "op9_decontaminate": DECONTAMINATE, "op11_mixing": MIXING, "op13_hard_negatives": HARD_NEGATIVES}
