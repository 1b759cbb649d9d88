"""Conversation repair against plain dynamic programming over strings, blocks of any size, edges."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from echoloom.llm import turns
from echoloom.llm.queries import QUERIES
from echoloom.llm.common import table

CONV = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """rows of one conversation in order -> blank, duplicate, truncated, illegal, cost, audit, digest."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        faults.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    initials = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))

    def relax(table, state, found):
        if state not in table or found[:2] < table[state][:2]:
            table[state] = found

    def with_inserts(table):
        out = dict(table)
        for state, (cost, audit, lines) in table.items():
            for _ in range(4):
                state, cost, audit = NEXT[state], cost + 3, audit + "I"
                lines = (*lines, (NAME[state], ""))
                relax(out, state, (cost, audit, lines))
        return out

    best = {"": (0, "", ())}
    for (role, text), fault in zip(rows, faults, strict=True):
        made: dict = {}
        for state, (cost, audit, lines) in with_inserts(best).items():
            relax(made, state, (cost + 4, audit + "D", lines))
            if fault in ("b", "d"):
                continue
            more = cost + (3 if fault == "t" else 0)
            if role[:1] == "s" and state == "":
                relax(made, "s", (more, audit + "K", (*lines, (role, text))))
            if role[:1] == NEXT[state]:
                relax(made, NEXT[state], (more, audit + "K", (*lines, (role, text))))
            relax(made, NEXT[state], (more + 3, audit + "R", (*lines, (NAME[NEXT[state]], text))))
        best = made
    cost, audit, lines = min(found for state, found in with_inserts(best).items() if state in ("", "a"))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def plain(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        kept = plain_damage([r for r in rows if r[0] == conv])
        known = [t for t, _, _ in kept if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        found[conv] = (gaps, *plain_repair([(role, text) for _, role, text in kept]))
    return found


def as_dict(result):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in result.collect()}


def test_whole_table(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, sf_dir, "conversations").collect()]
    assert as_dict(QUERIES["op12_conversation_repair"](spark, sf_dir)) == plain(rows)


def random_rows(seed: int, n: int, length: int):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Sys"]
    texts = ["ok.", "no", "why?", "", " \t", None, "a" * 70 + ".", "a" * 70 + "b.", "é!", "line\nbreak."]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(draw.randint(1, length)):
            rows.append((conv, draw.choice([turn, turn, turn, None, turn // 2, turn + 3_000_000_000]), draw.choice(roles), draw.choice(texts)))
    return rows


@pytest.mark.parametrize("block", [1, 3, 256])
def test_random_conversations_in_blocks(spark, block):
    """Blocks of any size, joined two at a time, give what one block gives; nulls, ties, odd roles and long turns included."""
    rows = random_rows(block, 25, 14)
    rows += rows[:20] + [(900, 1, "user", "x" * 100_000 + ".")] + [(901, t, "user", "same.") for t in range(60)]
    conversations = spark.createDataFrame([(*r, "clash") for r in rows], CONV + ", cost string")
    assert as_dict(turns.damage_and_repair(conversations, block, fan_in=2)) == plain(rows)


def test_nothing_left_and_empty_table(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    lone = spark.createDataFrame([(5, gone, "user", "hi.")], CONV)
    assert as_dict(turns.damage_and_repair(lone)) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert turns.damage_and_repair(spark.createDataFrame([], CONV)).collect() == []


def test_letters_of_a_weight():
    """Ties go to the letters that come first, and padding counts as nothing."""
    assert turns.finished(turns.block_weights("ua")) == (0, "KK")
    assert turns.finished(turns.block_weights("s")) == (4, "D")
    assert turns.finished(turns.block_weights("a")) == (3, "IK")
    assert turns.finished(turns.block_weights("uu")) == (3, "KR")
    assert turns.finished(turns.block_weights("-")) == (4, "D")
    assert turns.finished(turns.chained(turns.block_weights("u"), turns.block_weights("u"))) == (3, "KR")


def test_repaired_rows_alternate(spark, sf_dir):
    _, repaired = turns.repair(turns.damaged(table(spark, sf_dir, "conversations")))
    by: dict = {}
    for r in repaired.collect():
        by.setdefault(r.conv_id, []).append((r.place, r.role[:1]))
    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(i for _, i in sorted(rows))) for rows in by.values())
