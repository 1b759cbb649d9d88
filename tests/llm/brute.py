"""Plain Python versions of the contracts, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


def shingles(text: str | None, n: int = 5) -> set:
    found = TOKEN.findall((text or "").translate(UPPER))
    if len(found) < n:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)}


def near_groups(docs: dict) -> dict:
    """Smallest reachable id of every id, by an inverted list over shingles."""
    sets = {i: shingles(t) for i, t in docs.items()}
    holders: dict = {}
    for i in sorted(sets):
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    counts: dict = {}
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                counts[a, b] = counts.get((a, b), 0) + 1
    for (a, b), shared in counts.items():
        if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}
