"""Secret scan: rules find candidates, structure confirms the encoded ones.

Base kinds are what the patterns below say. A candidate of another kind is only reported when decoding it gives
the structure of a secret:

* ``jwt``: three base64url parts; the first is a JSON object with an ``alg``, the second a JSON object;
* ``der``: base64 or hex of one ASN.1 sequence whose nested lengths all add up and whose first members are those of
  a private key (PKCS#1, PKCS#8 or SEC 1);
* ``ssh``: base64 of an ``openssh-key-v1`` container whose length-prefixed fields all lie within it;
* ``pem``: a private-key block whose body is one of the two above (or, where it says it is encrypted, PKCS#8 encrypted data, or under
  the headers of a classic encrypted key whole blocks of its cipher).

Spans count code points, with exclusive ends, over the whole text. Null and empty texts have none. Matches of one kind never
overlap; those of different kinds may, and all are reported. Every row stays one row.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.llm.common import annotated

# The contract's patterns, least lengths and order of kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "der", "ssh", "pem")

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RULES = {
    "assign": re.compile(ASSIGN, re.IGNORECASE | re.ASCII),
    # A shorter run holds no longer one, so asking for the least length finds the same runs.
    "access": re.compile(ACCESS[:-1] + "{%d,}" % (LEAST_ACCESS - 4)),
    "hex": re.compile(HEX[:-1] + "{%d,}" % LEAST_HEX),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)"),
    # 0x30 begins a sequence: base64 M, then A to P.
    "der": re.compile(r"(?<![A-Za-z0-9+/_-])M[A-P][A-Za-z0-9+/_-]{30,}={0,2}"),
    "ssh": re.compile(r"(?<![A-Za-z0-9+/_-])b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/_-]+={0,2}"),
    # Headers hold hyphens, so the body runs to the next line of five.
    "pem": re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----((?:[^-]|-(?!----))+)-----END \1PRIVATE KEY-----"),
    "der_hex": re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{22,}"),
}
SPANS = "spans array<struct<kind: string, start: bigint, end: bigint>>"


def _base64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_members(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the values that fill ``data`` exactly; None if lengths do not add up at some level."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length >= 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            length = int.from_bytes(data[at : at + n], "big")
            at += n
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        content = data[at : at + length]
        if tag & 0x20 and (depth > 16 or der_members(content, depth + 1) is None):
            return None
        found.append((tag, content))
        at += length
    return found


def is_private_key(data: bytes | None, encrypted: bool = False) -> bool:
    """One DER sequence that begins as a private key does."""
    outer = der_members(data) if data and data[0] == 0x30 else None
    if not outer or len(outer) != 1:
        return False
    members = der_members(outer[0][1])
    tags = [tag for tag, _ in members]
    if encrypted:
        return tags[:2] == [0x30, 0x04]
    if tags[:1] != [0x02] or members[0][1] not in (b"\x00", b"\x01"):
        return False
    if tags[1:3] == [0x30, 0x04]:
        return der_members(members[1][1])[:1] != [] and der_members(members[1][1])[0][0] == 0x06
    if tags[1:2] == [0x04]:
        return len(members[1][1]) >= 16
    return len(tags) >= 9 and set(tags[:9]) == {0x02}


def is_openssh_key(data: bytes | None) -> bool:
    """The container's fields: cipher, key derivation, its options, number of keys, public keys, private part."""
    magic = b"openssh-key-v1\x00"
    if not data or not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        length = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + length > len(data):
            return None
        at += 4 + length
        return data[at - length : at]

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return False
    n_keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= n_keys <= 64 and all(field() is not None for _ in range(n_keys)) and bool(field()) and at == len(data)


#: Block length of the ciphers that classic encrypted keys name.
_BLOCKS = {"DES-CBC": 8, "DES-EDE-CBC": 8, "DES-EDE3-CBC": 8, "IDEA-CBC": 8, "RC2-CBC": 8, "BF-CBC": 8, "CAST5-CBC": 8, "SEED-CBC": 16}
_BLOCKS |= {f"{name}-{bits}-CBC": 16 for name in ("AES", "CAMELLIA", "ARIA") for bits in (128, 192, 256)}
_ENCRYPTED = re.compile(r"^Proc-Type:[ \t]*4,[ \t]*ENCRYPTED[ \t]*$", re.MULTILINE)
_CIPHER = re.compile(r"^DEK-Info:[ \t]*([A-Z0-9-]+),[ \t]*([0-9A-Fa-f]+)[ \t]*$", re.MULTILINE)


def is_encrypted_key(headers: str, data: bytes | None) -> bool:
    """Whole cipher blocks under headers that name the cipher and an initial vector of its block length."""
    named = _CIPHER.search(headers)
    block = _BLOCKS.get(named[1]) if named and _ENCRYPTED.search(headers) else None
    return bool(block and data) and len(named[2]) == 2 * block and len(data) % block == 0


def _object(part: str) -> dict | None:
    try:
        value = json.loads(_base64(part) or b"")
    except (ValueError, RecursionError):  # a header nested beyond reading is none
        return None
    return value if isinstance(value, dict) else None


def _confirmed(kind: str, m: re.Match) -> bool:
    if kind == "jwt":
        header = _object(m[1])
        return header is not None and isinstance(header.get("alg"), str) and _object(m[2]) is not None
    if kind == "der":
        return is_private_key(_base64(m[0]))
    if kind == "ssh":
        return is_openssh_key(_base64(m[0]))
    lines = m[2].splitlines()
    body = _base64("".join(x for x in lines if ":" not in x).replace(" ", "").replace("\t", ""))
    if is_private_key(body) or is_openssh_key(body) or m[1] == "ENCRYPTED " and is_private_key(body, encrypted=True):
        return True
    return is_encrypted_key("\n".join(x for x in lines if ":" in x), body)


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start, then kind in the order of ``KINDS``."""
    if not text:
        return []
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(word in low for word in _KEYWORDS):
            found += [(m.start(), "assign", m.end()) for m in _RULES["assign"].finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _RULES["access"].finditer(text)]
    is_key = lambda m: m[0].startswith("30") and len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0]))
    keys = [m.span() for m in _RULES["der_hex"].finditer(text) if is_key(m)] if "30" in text else []
    for m in _RULES["hex"].finditer(text):
        found.append((m.start(), "hex", m.end()))
        # A lower-case run may also begin within a longer one of both cases.
        if is_key(m) and not any(a <= m.start() and m.end() <= b for a, b in keys):
            keys.append(m.span())
    found += [(a, "der", b) for a, b in keys]
    for kind, mark in (("jwt", "eyJ"), ("der", "M"), ("ssh", "b3BlbnNzaC1rZXktdjE"), ("pem", "-----BEGIN ")):
        if mark in text:
            found += [(m.start(), kind, m.end()) for m in _RULES[kind].finditer(text) if _confirmed(kind, m)]
    found.sort(key=lambda x: (x[0], KINDS.index(x[1])))
    return [(kind, start, end) for start, kind, end in found]


def _span_column(texts: pa.Array) -> list[pa.Array]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t.as_py())] for t in texts]
    return [pa.array(rows, kind)]


def scan_secrets(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``doc`` (the columns ``carry``, default all) with ``spans``, an array of (kind, start, end)."""
    return annotated(docs, _span_column, SPANS, carry)


def as_text(spans: str = "spans", kinds: tuple[str, ...] = KINDS) -> Column:
    """The spans of ``kinds`` as kind:start:end, joined by commas."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str, spans: str = "spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
