"""Settings of the review jobs: thresholds, redaction rules, spelling fixes, theme taxonomy.

Every job takes these as arguments; the objects below are only the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# These decide the results, so they are stated as they are.
# ---------------------------------------------------------------------------

MIN_WORDS = 10
DEFAULT_WINDOW_DAYS = 28
MIN_WINDOW_DAYS = 7
MAX_WINDOW_DAYS = 35
SOURCE_NAME = "google_play"

SCORE_BATCH_SIZE = 10
SCORE_MAX_RETRIES = 2
SCORE_TEXT_CHARS = 500
CONFIDENCE_THRESHOLD = 0.4
FALLBACK_CONFIDENCE = 0.45
DEFAULT_SENTIMENT = "neutral"
SENTIMENTS = ("positive", "negative", "neutral")
KEYWORD_REASON = "fallback keyword: "
DEFAULT_REASON = "fallback default: no keywords matched"

CHUNK_SIZE = 20
CHUNK_TEXT_CHARS = 200
TOP_THEMES = 3
MAX_QUOTES = 10
REPORT_ITEMS = 3
NOTE_MAX_WORDS = 250
UNKNOWN_THEME = "Unknown"

EMAIL_TAG = "[EMAIL_REDACTED]"
PHONE_TAG = "[PHONE_REDACTED]"
ID_TAG = "[ID_REDACTED]"
USER_TAG = "[USER_REDACTED]"
PII_TAGS = (EMAIL_TAG, PHONE_TAG, ID_TAG, USER_TAG)

EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_PATTERN = r"\b(?:\+91|0)?[6-9]\d{9}\b|\b\d{10}\b"
PAN_PATTERN = r"\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b"
AADHAAR_PATTERN = r"\b\d{4}\s?\d{4}\s?\d{4}\b"
ACCOUNT_PATTERN = r"\b\d{6,}\b"
USERNAME_PATTERN = r"@[a-zA-Z0-9_]+|[a-zA-Z_][a-zA-Z0-9_]*[0-9]{3,}"

EMOJI_RANGES = ((0x1F000, 0x1F9FF), (0x2600, 0x27BF), (0x2300, 0x23FF), (0xFE0F, 0xFE0F))

# Spelling fixes that change a word; entries that map a word to itself have no effect.
TYPOS = {
    "grok": "error",
    "crap": "bad",
    "sucks": "bad",
    "gud": "good",
    "awsome": "awesome",
    "excelent": "excellent",
    "wasteofmoney": "waste",
    "fraudsters": "fraud",
    "lmao": "haha",
}

# Themes in order of precedence, each with its keywords in order of precedence.
THEME_KEYWORDS = {
    "Execution & Performance": [
        "execution", "pending", "order", "delay", "chart", "lag", "crash", "freeze",
        "stuck", "hang", "slow", "not updating", "ltp", "f&o", "strike", "option chain",
        "position", "not visible", "something went wrong", "error", "price not refreshing",
        "blocking", "buy-sell", "app lag", "app freeze", "app crash", "technical issue",
        "glitch", "bug", "not working",
    ],
    "Payments & Withdrawals": [
        "payment", "debit", "money", "not reflected", "refund", "delay", "withdrawal",
        "taking days", "wallet", "balance", "incorrect", "decreasing", "settlement",
        "sale settlement", "auto-deduction", "unexplained", "pending", "charged",
    ],
    "Charges & Transparency": [
        "charge", "brokerage", "expensive", "cost", "fee", "hidden", "unexpected",
        "profit", "settled", "zerodha", "dhan", "competitor", "scalper",
    ],
    "KYC & Access": [
        "kyc", "aadhaar", "biometric", "verification", "incomplete", "blocking",
        "investment", "trading", "renew", "registration", "loop", "account",
        "reactivate", "inactivity", "pan",
    ],
    "UI & Feature Gaps": [
        "ui", "feature", "confusing", "oi", "etf", "stock", "tool", "fibonacci",
        "scalping", "watchlist", "statement", "unprofessional", "unformatted",
        "sip", "pause", "resume", "missing", "gap", "interface", "design",
    ],
}
DEFAULT_THEME = "UI & Feature Gaps"

# Report wording and tags.
NOTE_TITLE = "Weekly App Review Pulse"
NOTE_SECTIONS = ("Top Themes", "User Voice (Quotes)", "Action Ideas")
PRIORITY_BY_RANK = ("CRITICAL", "HIGH", "FOCUS")
BULLET_CATEGORIES = (
    ("defect", ("crash", "error", "bug")),
    ("feature", ("feature", "ui")),
    ("performance", ("performance", "speed")),
    ("experience", ("user", "experience")),
)
BULLET_DEFAULT = "general"
TIMELINE_PATTERN = r"Next \d+ Sprint[s]?|Within \d+ week[s]?|\d+ sprint[s]?"

# ---------------------------------------------------------------------------
# End of fixed values
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class PiiRule:
    """One redaction step: text matching ``pattern`` becomes ``tag``.

    ``needs`` lists expressions of which a text must match at least one for the rule to have any
    effect; cheap tests that spare most texts the rule. Empty means the rule always runs.
    ``guard`` is an assertion that holds wherever a match can start. It goes ahead of the pattern where the
    pattern itself would try far more positions: a class of all first characters.
    ``search`` finds the same matches in linear time, for patterns that would try every position of a long word and
    read it to its end each time. It starts once per word; its first group holds what stands between the start of
    the word and the match, and is kept.
    """

    name: str
    pattern: str
    tag: str
    needs: tuple[str, ...] = ()
    guard: str = ""
    search: str = ""


# A run of address characters is tried once, where it starts or where the last match ended. What is skipped
# up to the first word boundary is either all word characters or none.
EMAIL_SEARCH = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)((?<=\w)[A-Za-z0-9_]*+|(?<!\w)[.%+-]*+)"
    r"\b[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
)
# The last three digits in a row end a name; a run without any is read once.
USERNAME_SEARCH = r"@[a-zA-Z0-9_]++|(?<![a-zA-Z0-9_])([0-9]*+)[a-zA-Z_][a-zA-Z0-9_]*[0-9]{3}"

FOUR_DIGITS = (r"\d{4}",)

PII_RULES = (
    PiiRule("email", EMAIL_PATTERN, EMAIL_TAG, ("@",), search=EMAIL_SEARCH),
    PiiRule("phone", PHONE_PATTERN, PHONE_TAG, FOUR_DIGITS, r"(?=[+\d])"),
    PiiRule("pan", PAN_PATTERN, ID_TAG, FOUR_DIGITS),
    PiiRule("aadhaar", AADHAAR_PATTERN, ID_TAG, FOUR_DIGITS),
    PiiRule("account", ACCOUNT_PATTERN, ID_TAG, FOUR_DIGITS),
    PiiRule("username", USERNAME_PATTERN, USER_TAG, ("@", r"[0-9]{3}"), search=USERNAME_SEARCH),
)


@dataclass(frozen=True)
class Taxonomy:
    """Themes in precedence order with their ordered keywords and the theme used when none hits."""

    themes: tuple[tuple[str, tuple[str, ...]], ...]
    default_theme: str

    @classmethod
    def of(cls, keywords: dict[str, list[str]], default_theme: str) -> "Taxonomy":
        return cls(tuple((theme, tuple(words)) for theme, words in keywords.items()), default_theme)

    @property
    def names(self) -> list[str]:
        return [theme for theme, _ in self.themes]

    @property
    def pairs(self) -> list[tuple[str, str]]:
        """Every (theme, keyword), best match first."""
        return [(theme, word) for theme, words in self.themes for word in words]


TAXONOMY = Taxonomy.of(THEME_KEYWORDS, DEFAULT_THEME)
