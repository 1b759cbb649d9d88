"""Golden cases for redaction and cleaning, and the properties both must have."""

from __future__ import annotations

import random
import re
import time
from functools import reduce

from pyspark.sql import functions as F

from echoloom import config
from echoloom.functions import text
from echoloom.operators import clean

REDACTED = [
    ("call +919876543210 now", "call +[ID_REDACTED] now"),
    ("call 09876543210 now", "call [PHONE_REDACTED] now"),
    ("x+919876543210", "x[PHONE_REDACTED]"),
    ("1234 5678 9012", "[ID_REDACTED]"),
    ("pan ABCDE1234F ok", "pan [ID_REDACTED] ok"),
    ("nifty500 covid2019 @bob_1", "[USER_REDACTED] [USER_REDACTED] [USER_REDACTED]"),
    ("bob@x.c|m", "[EMAIL_REDACTED]"),
    ("aé@b.com x", "aé[USER_REDACTED].com x"),
    ("é9876543210", "é9876543210"),
    ("٩٨٧٦٥٤٣٢١٠", "[PHONE_REDACTED]"),
    ("1234 5678 9012", "[ID_REDACTED]"),
    ("nothing here", "nothing here"),
    ("", ""),
    (None, None),
]

CLEANED = [
    (None, ""),
    ("", ""),
    ("  Hello \t\n World ", "hello world"),
    ("a b", "a b"),
    ("Grok  is  down", "error is down"),
    ("gud, but it sucks!", "good, but it bad!"),
    ("grokking sucksy", "grokking sucksy"),
    ("ok 😀 fine ’", "ok fine '"),
    ("“q” ‘s’", "\"q\" 's'"),
    ("stays 🩰 here", "stays 🩰 here"),
    ("⌚☀️x", "x"),
    ("İX ΟΔΟΣ", "i̇x οδος"),
]

WORDS = [(None, 0), ("", 0), ("   ", 0), ("one", 1), (" a  b\tc d ", 4)]


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")


def values(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_redaction_golden(spark):
    df = column(spark, [c[0] for c in REDACTED])
    assert values(df.withColumn("r", text.redact_pii("text")), "r") == [c[1] for c in REDACTED]
    assert values(clean.redact_column(df, "text"), "text") == [c[1] for c in REDACTED]


def test_cleaning_golden(spark):
    df = column(spark, [c[0] for c in CLEANED])
    assert values(df.withColumn("c", text.clean_text("text")), "c") == [c[1] for c in CLEANED]
    staged = clean.with_clean_text(df)
    assert values(staged, "clean_text") == [c[1] for c in CLEANED]
    assert values(staged, "n_words") == [len(c[1].split()) for c in CLEANED]


def test_word_counts(spark):
    df = column(spark, [w[0] for w in WORDS])
    assert values(df.withColumn("n", text.word_count("text")), "n") == [w[1] for w in WORDS]
    for n in (1, 4, 5):
        flags = values(df.withColumn("b", F.coalesce(text.has_words("text", n), F.lit(False))), "b")
        assert flags == [w[1] >= n for w in WORDS]


def test_gates_never_change_a_result(spark):
    """Each rule with its cheap tests equals the bare pattern."""
    samples = [c[0] for c in REDACTED if c[0]] + ["a1b22c333", "@", "x@y.zz 1234", "123", "id 123456", "+91 12345"]
    df = column(spark, samples)
    for rule in config.PII_RULES:
        bare = F.regexp_replace("text", "(?U)" + rule.pattern, rule.tag)
        fast = text.redaction_steps([rule])[0]("text")
        assert df.filter(~bare.eqNullSafe(fast)).count() == 0, rule.name


def test_custom_rules_and_typos(spark):
    df = column(spark, ["my cat, cats", "a.b"])
    rule = config.PiiRule("cat", r"\bcat\b", "[PET]")
    assert values(clean.redact_column(df, "text", [rule]), "text") == ["my [PET], cats", "a.b"]
    fixed = df.withColumn("c", text.clean_text("text", {"cat": "big  dog", "a.b": "$1"}))
    assert values(fixed, "c") == ["my big dog, cats", "$1"]


def test_short_text_filter_is_exact(spark):
    """The early word filter and the late one keep the same rows."""
    base = [
        "a b c d e f g h i j", "a b c d e f g h i", "a b c d e f g h i 😀", "1 2 3 4 5 6 7 8 1234 5678 9012", None, "",
        "one two three four five six seven eight nine bob@x.com",
    ]
    rows = [(i, f"2025-11-{3 + i:02d}", 5, "t", v, 1) for i, v in enumerate(base)]
    df = spark.createDataFrame(
        rows, "source_review_id long, date string, rating int, title string, text string, relevance long"
    ).withColumn("date", F.to_date("date"))
    kept = {r.source_review_id for r in clean.clean_reviews(df).collect()}
    late = {
        r.source_review_id for r in clean.filter_min_words(clean.with_clean_text(df)).collect()
    }
    assert kept == late == {0, 6}


def test_replacements_with_spaces_switch_the_early_filter_off(spark):
    df = spark.createDataFrame([(1, "a gud b", 1)], "source_review_id long, text string, relevance long").withColumns(
        {"date": F.to_date(F.lit("2025-11-03")), "rating": F.lit(1), "title": F.lit("")}
    )
    out = clean.clean_reviews(df, typos={"gud": "1 2 3 4 5 6 7 8"}).collect()
    assert [r.clean_text for r in out] == ["a 1 2 3 4 5 6 7 8 b"]


ALPHABET = list("aZ09 @.+_-|é’😀\n ٣") + ["grok", "98765", "43210", "ABCDE1234F", "gud "]


def random_texts(n, seed=7):
    pick = random.Random(seed)
    return ["".join(pick.choice(ALPHABET) for _ in range(pick.randrange(14))) for _ in range(n)]


def test_cleaning_and_redaction_properties(spark):
    """Staged and plain forms agree, cleaning is idempotent, and clean text has its shape."""
    df = column(spark, random_texts(1500))
    once = clean.with_clean_text(df.withColumn("raw", F.col("text")))
    checked = once.select(
        (text.redact_pii("raw") == F.col("text")).alias("redact_agrees"),
        (text.clean_text("text") == F.col("clean_text")).alias("clean_agrees"),
        (text.clean_text("clean_text") == F.col("clean_text")).alias("clean_idempotent"),
        (text.word_count("clean_text") == F.col("n_words")).alias("words_agree"),
        (~clean_shape_broken()).alias("shape"),
    )
    row = checked.agg(*[F.count_if(~F.col(c)).alias(c) for c in checked.columns]).first()
    assert set(row.asDict().values()) == {0}, row


def test_random_texts_against_python_regex(spark):
    """Java's expressions with their cheap tests against Python's on the same patterns."""
    samples = random_texts(1500, seed=11)

    def expected(sample):
        hidden = reduce(lambda t, rule: re.sub(rule.pattern, rule.tag, t), config.PII_RULES, sample)
        emoji = "".join(f"{chr(low)}-{chr(high)}" for low, high in config.EMOJI_RANGES)
        plain = re.sub(f"[{emoji}]", "", hidden).translate(str.maketrans("‘’“”", "''\"\"")).lower()
        return hidden, reduce(
            lambda t, pair: re.sub(rf"\b{pair[0]}\b", pair[1], t), config.TYPOS.items(), " ".join(plain.split())
        )

    rows = clean.with_clean_text(column(spark, samples)).orderBy("i").collect()
    assert [(r.text, r.clean_text) for r in rows] == [expected(sample) for sample in samples]


def clean_shape_broken():
    c = F.col("clean_text")
    return F.contains(c, F.lit("  ")) | (c != F.trim(c)) | (c != F.lower(c)) | text.has_emoji(c)


def test_linear_rules_find_what_the_plain_patterns_find(spark):
    """Dense random texts, in which matches touch, fail late, or begin inside a word."""
    draw = random.Random(11)
    alphabets = ["ab@.", "a1_@.", "aé@.-x", "a.|b@c", "12ab_", "é1a2@_.", "%+-a@b.Zz|9 "]
    samples = ["".join(draw.choices(alphabet, k=draw.randint(1, 40))) for alphabet in alphabets for _ in range(400)]
    samples += ["a@b.com-x@y.org", "a@b.cd.ef@g.hi", "éab.c@d.efg", ".+a@b.co", "x" * 30 + "@" + "a." * 20 + "com@q.rs", "12ab345cd678e", "a1b234c567d8@e999"]
    df = column(spark, samples)
    for rule in (r for r in config.PII_RULES if r.search):
        expected = [re.sub(rule.pattern, rule.tag, s) for s in samples]
        assert values(df.withColumn("r", text.redact("text", rule)), "r") == expected
        # Java's own reading of the plain pattern, on characters that Python and Java tell apart.
        odd = column(spark, [s.replace("é", "é").replace("b", "‍") for s in samples])
        both = odd.select("i", text.redact("text", rule).alias("r"), F.regexp_replace("text", "(?U)" + rule.pattern, rule.tag).alias("p"))
        assert values(both, "r") == values(both, "p")


def test_redaction_takes_linear_time(spark):
    """Words of 320,000 characters that hold no match, or hold one at the end only."""
    n = 320_000
    long_words = ["a." * (n // 2), "a1" * (n // 2), "a." * (n // 2) + "@", "a@" * (n // 2), "a" * n + "12", "a.b@" + "a." * (n // 2), "é" + "a" * n + "@"]
    long_words += ["a1" * (n // 2) + "@b.com 999", "a123" + "b1" * (n // 2), "1a" * (n // 2) + "@x", "." * n + "@", "@" * n]
    df = column(spark, long_words)
    df.limit(1).select(text.redact_pii("text")).collect()
    started = time.perf_counter()
    found = values(df.withColumn("r", text.redact_pii("text")), "r")
    assert time.perf_counter() - started < len(long_words)
    assert found[0] == long_words[0] and found[7].endswith("[EMAIL_REDACTED] 999")
