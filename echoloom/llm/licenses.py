"""License scan with ordered signature rules.

A text is seen as its words (letters and digits, A-Z lower-cased), each between two blanks of its own, so that rules are
regular expressions over words. Rules come from families (a name, a keyword, versions) times forms (notice, tag, title, ...).

* *Keyword prefilter*: a text without any license mark is done after one search; of the others only the rules whose keyword is
  one of the text's words are tried.
* *Priority and containment*: detections are ordered by start, then longer first, then by the form's priority. One that lies within
  an earlier one is suppressed.

The base phrases are rules too, and their labels always stay. Only DataFrame functions are used. The matches of a text
are rows, not arrays, so even a text made of nothing but licenses is no large cell. The rule table is fixed; it does not grow.

Null and empty texts have no words, no labels and score 0. Every row stays one row, whatever its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoloom.llm.common import whole_text, written

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: A text without this has no base phrase and matches no rule.
_GAP = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
GATE = rf"(?i)licen[sc]e|spdx|(ed|able){_GAP}under|{_GAP}later|cc{_GAP}by"

# The contract's phrases, a keyword of each, and labels.
BASE = (("under the mit license", "mit", "mit"), ("apache license version 2", "apache", "apache-2"), ("cc by nc", "nc", "cc-by-nc"))

#: Label, keyword (a word of every match), name as a pattern over words, versions as they are written after the name.
FAMILIES = (
    ("mit", "mit", "(?:expat )?mit", ()),
    ("apache", "apache", "apache(?: software)?", ("1 0", "1 1", "2 0", "2")),
    ("gpl", "general", "(?:gnu )?general public", ("1", "2", "2 0", "3", "3 0")),
    ("gpl", "gpl", "(?:gnu )?gpl", ("1", "2", "2 0", "3", "3 0")),
    ("gpl", "gplv2", "(?:gnu )?gplv2", ()),
    ("gpl", "gplv3", "(?:gnu )?gplv3", ()),
    ("lgpl", "lesser", "(?:gnu )?lesser general public", ("2 1", "3", "3 0")),
    ("lgpl", "library", "(?:gnu )?library general public", ("2", "2 0")),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ("2", "2 1", "3", "3 0")),
    ("agpl", "affero", "(?:gnu )?affero general public", ("1", "3", "3 0")),
    ("agpl", "agpl", "(?:gnu )?agpl", ("1", "3", "3 0")),
    ("fdl", "documentation", "(?:gnu )?free documentation", ("1 1", "1 2", "1 3")),
    ("bsd", "bsd", "(?:new |modified |simplified |revised )?bsd", ()),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|two clause bsd)", ()),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|three clause bsd)", ()),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|four clause bsd)", ()),
    ("mpl", "mozilla", "mozilla public", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public", ("1 0", "2 0")),
    ("epl", "epl", "epl", ("1 0", "2 0")),
    ("cddl", "cddl", "cddl", ("1 0", "1 1")),
    ("cddl", "distribution", "common development and distribution", ("1 0", "1 1")),
    ("eupl", "european", "european union public", ("1 0", "1 1", "1 2")),
    ("eupl", "eupl", "eupl", ("1 1", "1 2")),
    ("isc", "isc", "isc", ()),
    ("zlib", "zlib", "zlib(?: libpng)?", ()),
    ("artistic", "artistic", "(?:perl )?artistic", ("1 0", "2 0")),
    ("bsl", "boost", "boost software", ("1 0",)),
    ("busl", "business", "business source", ("1 1",)),
    ("psf", "python", "python(?: software foundation)?", ("2", "2 0")),
    ("ruby", "ruby", "ruby", ()),
    ("php", "php", "php", ("3 0", "3 01")),
    ("ofl", "sil", "sil open font", ("1 0", "1 1")),
    ("ofl", "ofl", "ofl", ("1 1",)),
    ("wtfpl", "wtfpl", "wtfpl", ()),
    ("unlicense", "unlicense", "unlicense", ()),
    ("openssl", "openssl", "openssl", ()),
    ("postgresql", "postgresql", "postgresql", ()),
    ("ms-pl", "microsoft", "microsoft public", ()),
    ("ms-rl", "microsoft", "microsoft reciprocal", ()),
    ("upl", "universal", "universal permissive", ("1 0",)),
    ("osl", "open", "open software", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic", "academic free", ("2 0", "2 1", "3 0")),
    ("odbl", "database", "open (?:data commons open )?database", ("1 0",)),
    ("cc-by", "by", "(?:cc|creative commons) by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "sa", "(?:cc|creative commons) by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "nc", "(?:cc|creative commons) by nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "nd", "(?:cc|creative commons) by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "nc", "(?:cc|creative commons) by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "nc", "(?:cc|creative commons) by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "attribution", "creative commons attribution", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc0", "cc0", "(?:creative commons )?cc0", ("1 0",)),
    ("cc0", "zero", "(?:cc|creative commons) zero", ("1 0",)),
)

_UNDER = "(?:licensed|released|distributed|available|published|provided|covered|redistributed) under (?:the )?(?:terms of )?(?:the )?(?:conditions of the )?"
_LICENSE = "(?: public)?(?: licen[sc]e)?(?: version)?"
#: Form, priority (1 is best), confidence, pattern; {name} and {version} (with its leading blank, or empty) are filled in.
FORMS = (
    ("later", 1, 1.0, "{name}" + _LICENSE + "{version} or (?:any )?(?:at your option )?(?:any )?later(?: version)?"),
    ("notice", 2, 1.0, _UNDER + "{name}" + _LICENSE + "{version}"),
    ("tag", 3, 1.0, "spdx license identifier {name}{version}"),
    ("title", 4, 0.9, "{name} (?:public )?licen[sc]e(?: version)?{version}"),
    ("field", 5, 0.8, "licen[sc]e {name}{version}"),
    ("before", 6, 0.7, "{name}{version} licen[sc]e"),
)
RULE_COLUMNS = "rule int, keyword string, label string, is_base boolean, priority int, weight double, pattern string"


def _spaced(pattern: str) -> str:
    """A pattern over words with single blanks, for texts in which each word has two blanks of its own."""
    return " " + pattern.replace(" ", "  ") + " "


def rules() -> list[tuple]:
    """All rules in their order, base phrases first. Versions with a trailing 0 and without are one label."""
    made = [(keyword, label, True, 0, 1.0, _spaced(phrase)) for phrase, keyword, label in BASE]
    for label, keyword, name, versions in FAMILIES:
        for version in ("", *versions):
            written_as = ""
            full = label
            if version:
                written_as = " v?" + version
                full = f"{label}-{version.replace(' ', '.')}" + (".0" if " " not in version else "")
            for form, priority, weight, pattern in FORMS:
                if form == "later" and not version:
                    continue
                tail = "-or-later" if form == "later" else ""
                made.append((keyword, full + tail, False, priority, weight, _spaced(pattern.format(name=name, version=written_as))))
    return [(number, *rule) for number, rule in enumerate(made)]


def _blanks(text: str) -> str:
    return f"length({text}) - length(replace({text}, ' ', ''))"


def scan_licenses(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, detections).

    ``rows``: row (its number in this run), doc_id, n_words. ``detections``: row, label, is_base, start, end (words,
    end exclusive), weight, kept (not suppressed).
    """
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(rules(), RULE_COLUMNS))
    keywords = "|".join(sorted({rule[1] for rule in rules()}))
    words = F.expr(f"regexp_extract_all(text, '{WORD.replace(chr(92), chr(92) * 2)}', 0)")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    body = F.concat(F.lit(" "), F.translate(F.array_join("words", "  "), upper, lower), F.lit(" "))
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole_text().alias("text"))
    read = read.select("row", "doc_id", F.col("text").rlike(GATE).alias("marked"), words.alias("words"))
    rows = read.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.col("marked") & (F.size("words") > 0), body).alias("body"))
    rows = written(rows, "license-rows")
    marked = rows.filter("body IS NOT NULL").select(
        "row", "body", F.explode(F.array_distinct(F.expr(f"regexp_extract_all(body, ' ({keywords}) ', 1)"))).alias("keyword")
    )
    tried = marked.join(table, "keyword").select(
        "row", "rule", "label", "is_base", "priority", "weight",
        F.expr("regexp_extract_all(body, pattern, 0)").alias("hits"), F.expr("split(body, pattern, -1)").alias("gaps"),
    )
    found = tried.select("*", F.expr("posexplode(arrays_zip(hits, gaps))").alias("nth", "part")).filter("part.hits IS NOT NULL")
    found = found.select(
        "row", "rule", "label", "is_base", "priority", "weight", "nth",
        F.expr(f"({_blanks('part.hits')}) div 2").alias("length"), F.expr(f"({_blanks('part.gaps')}) div 2").alias("gap"),
    )
    order = Window.partitionBy("row", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(order)).withColumn("start", F.col("end") - F.col("length"))
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max("end").over(before) >= F.col("end"), F.lit(False))
    return rows.drop("body"), placed.select("row", "label", "is_base", "start", "end", "weight", (~inside).alias("kept"))


def summarized(rows: DataFrame, detections: DataFrame) -> DataFrame:
    """One row per text: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = lambda column: F.when(F.col("is_base"), F.col(column))
    joined = lambda column: F.array_join(F.array_sort(F.collect_set(column)), ",")
    found = detections.groupBy("row").agg(
        F.count(base("start")).alias("n_base"), F.min(base("start")).alias("first_word"), F.max(base("start")).alias("last_word"),
        joined(base("label")).alias("base_labels"), joined(F.when(F.col("is_base") | F.col("kept"), F.col("label"))).alias("labels"),
        F.max(F.when(F.col("is_base") | F.col("kept"), F.col("weight"))).alias("score"),
    )
    none = F.lit("")
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
