"""Conversation repair: the cheapest edits that make a conversation's roles alternate, as integer minima over a DAG.

A conversation is sound if its role initials read ``(s?(ua)+)?``. Edits: **K**eep a row (0), **R**erole it to user or
assistant (3), **D**elete it (4), **I**nsert an empty user or assistant row anywhere (3). Blank and repeated rows must be deleted;
a row that is cut off costs 3 more unless it is deleted. Of equally cheap repairs the one whose letters come first in
ASCII order counts.

Both are decided by one integer: cost in the high digits, and below it the letters as digits of fixed width, first letter
first, filled up with zeros at the end. A node of the DAG is (row, state), with the states "nothing yet", "after the system
row", "after a user", "after an assistant"; its weight is the least over its edges of the edge's cost and letter before the
weight that follows. Of two repairs of the same rows none is the beginning of the other at the same cost, so the least integer of the rest stays the
least whatever comes before.

Rows of a conversation are numbered over ranges of the whole table and cut into blocks of ``BLOCK`` rows. A task sees a block as one
short string, a letter per row, and makes a weight for each pair of states the block may begin and end in. Blocks of one
conversation are then joined, ``FAN_IN`` neighbours at a time, until one is left. A conversation of any length is spread
over as many tasks as it has blocks. Only its letters, which are a value of the result, and the stream of its repaired texts, which one digest has
to read in order, go through one task each, the texts row by row.

Order of rows: turn, a null turn first, then role, the first characters of the text, and a digest of it. Null role and null text
count as one space (so the row is blank). An empty conversation has cost 0 and no letters. Identical rows are rows of their own; other
columns are not read. An empty table gives an empty result. Conversations of a null id are one conversation.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.llm.common import written
from echoloom.operators.order import with_position

BLOCK = 256
FAN_IN = 16
#: Characters of a text that take part in the order of rows of one turn.
TEXT_ORDER = 64

#: Letters in ASCII order; 0 is the padding.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = " DIKR"
BITS = 3
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: From a state, the states that a written user or assistant row leads to.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What a whole conversation may begin and end in.
ENDS = (START, ASSISTANT)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}

# A row as a letter: s, u, a or x (another initial); a capital if it is cut off; "-" if it must be deleted.
MUST_GO = "-"


# --- damage and faults --------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that a checksum of ``conv_id:turn`` deals to each row."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    fate = F.crc32(key) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    chosen = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("fate")).filter("fate <> 0")
    hurt = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, 2).otherwise(1)
    return chosen.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
    ).drop("copy")


SPACE = r"\x20\x09-\x0D"


def is_blank(text: str = "text") -> Column:
    return ~F.col(text).rlike(f"[^{SPACE}]")


def is_cut_off(text: str = "text") -> Column:
    """The last character that is no white space ends no sentence."""
    last = F.substring(F.regexp_replace(F.reverse(text), f"^[{SPACE}]+", ""), 1, 1)
    return ~last.isin(".", "!", "?")


def placed_rows(rows: DataFrame) -> DataFrame:
    """conv_id, position, role, text and ``code`` (the row's letter) of every row, numbered in order; written."""
    order = F.struct("role", F.substring("text", 1, TEXT_ORDER), F.unhex(F.sha2("text", 256)).alias("digest")).alias("order")
    placed = written(with_position(rows.select("conv_id", "turn", "role", "text", order), ("conv_id",), "turn", "order"), "turns")
    first = placed.groupBy("conv_id", "role", F.col("order.digest").alias("digest")).agg(F.min("position").alias("position"))
    first = first.select(F.col("conv_id").alias("of"), F.col("position").alias("at"))
    joined = placed.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("position") == F.col("at")), "left")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    fault = F.when(is_blank(), "blank").when(F.col("at").isNull(), "duplicate").when(is_cut_off(), "truncated")
    return written(joined.select("conv_id", "turn", "position", "role", "text", known.alias("initial"), fault.alias("fault")), "judged-turns")


def blocks_of(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, block and the block's rows as one string of letters, and as one of their role initials."""
    code = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    letters = F.array_sort(F.collect_list(F.struct("position", code.alias("code"), "initial")))
    packed = placed.groupBy("conv_id", F.expr(f"position div {block}").alias("block")).agg(letters.alias("rows"))
    return packed.select("conv_id", "block", F.array_join("rows.code", "").alias("codes"), F.array_join("rows.initial", "").alias("initials"))


# --- weights ------------------------------------------------------------------------------------


def _edges(code: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, letters, next state) of a row with what is inserted before it; at most two inserts pay before a row."""
    found = []
    for inserts in range(3):
        before, at = INSERT * inserts, state
        for _ in range(inserts):
            at = NEXT[at]
        letters = "I" * inserts
        found.append((before + DELETE, letters + "D", at))
        if code == MUST_GO:
            continue
        more = before + (CUT_OFF if code.isupper() else 0)
        kind = code.lower()
        if kind == "s" and at == START:
            found.append((more, letters + "K", SYSTEM))
        written_state = NEXT[at]
        if kind == ("u" if written_state == USER else "a"):
            found.append((more, letters + "K", written_state))
        found.append((more + REROLE, letters + "R", written_state))
    return found


EDGES = {code: [_edges(code, state) for state in range(4)] for code in "suaxSUAX" + MUST_GO}


@lru_cache(maxsize=4096)
def block_weights(codes: str) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """For each pair of states (begin, end): cost and letters of the cheapest edits of the block's rows, None if there are none."""
    places = 3 * len(codes)
    low = BITS * places
    mask = (1 << low) - 1
    found = []
    for end in range(4):
        weights: list[int | None] = [0 if state == end else None for state in range(4)]
        for code in reversed(codes):
            before: list[int | None] = []
            for state in range(4):
                least = None
                for cost, letters, to in EDGES[code][state]:
                    rest = weights[to]
                    if rest is None:
                        continue
                    digits = 0
                    for letter in letters:
                        digits = digits << BITS | DIGIT[letter]
                    shift = BITS * len(letters)
                    weight = (((rest >> low) + cost) << low) | (digits << (low - shift)) | ((rest & mask) >> shift)
                    if least is None or weight < least:
                        least = weight
                before.append(least)
            weights = before
        found.append([None if w is None else (w >> low, _letters(w & mask, low)) for w in weights])
    return tuple(tuple(found[end][state] for end in range(4)) for state in range(4))


def _letters(digits: int, low: int) -> str:
    """The letters of a weight, without the padding."""
    text = f"{digits:0{low // BITS}o}" if low else ""
    return text.rstrip("0").translate(_OCTAL)


_OCTAL = str.maketrans({str(d): letter for letter, d in DIGIT.items()})


def chained(left, right):
    """Weights of two neighbouring stretches as one: the least over the state between them."""
    return tuple(
        tuple(
            min(
                ((a[0] + b[0], a[1] + b[1]) for a, b in ((left[begin][mid], right[mid][end]) for mid in range(4)) if a is not None and b is not None),
                default=None,
            )
            for end in range(4)
        )
        for begin in range(4)
    )


#: What may follow the last row: nothing where the roles are sound already, else one or two inserts.
TAIL = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


def finished(weights) -> tuple[int, str]:
    """Cost and letters of the whole conversation."""
    return min((w[0] + TAIL[end][0], w[1] + TAIL[end][1]) for end, w in enumerate(weights[START]) if w is not None)


# --- joining blocks -----------------------------------------------------------------------------

STRETCH = "conv_id long, block long, n_rows long, weights array<struct<cost:long,letters:string>>, first string, last string, illegal long"
LEGAL = {"su", "ua", "au"}


def _flat(weights) -> list:
    return [None if w is None else {"cost": w[0], "letters": w[1]} for row in weights for w in row]


def _square(flat) -> tuple:
    cells = [None if w is None else (w["cost"], w["letters"]) for w in flat]
    return tuple(tuple(cells[4 * i : 4 * i + 4]) for i in range(4))


def _stretches(batches):
    import pyarrow as pa

    schema = _stretch_schema()
    for batch in batches:
        out = []
        for conv, block, codes, initials in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            bad = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            out.append({"conv_id": conv, "block": block, "n_rows": len(codes), "weights": _flat(block_weights(codes)), "first": initials[0], "last": initials[-1], "illegal": bad})
        yield pa.RecordBatch.from_pylist(out, schema)


def _stretch_schema():
    import pyarrow as pa

    weight = pa.struct([("cost", pa.int64()), ("letters", pa.string())])
    long_, text = pa.int64(), pa.string()
    return pa.schema([("conv_id", long_), ("block", long_), ("n_rows", long_), ("weights", pa.list_(weight)), ("first", text), ("last", text), ("illegal", long_)])


def _join_stretches(table, fan_in: int):
    """Neighbouring stretches of one conversation (at most ``fan_in``) as one."""
    import pyarrow as pa

    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    weights, illegal = _square(rows[0]["weights"]), rows[0]["illegal"]
    for before, row in zip(rows, rows[1:], strict=False):
        weights = chained(weights, _square(row["weights"]))
        illegal += row["illegal"] + (before["last"] + row["first"] not in LEGAL)
    one = {
        "conv_id": rows[0]["conv_id"], "block": rows[0]["block"] // fan_in, "n_rows": sum(r["n_rows"] for r in rows), "weights": _flat(weights),
        "first": rows[0]["first"], "last": rows[-1]["last"], "illegal": illegal,
    }
    return pa.Table.from_pylist([one], _stretch_schema())


def repairs(blocks: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """conv_id, n_rows, cost, audit and illegal of every conversation: stretches are joined until each has one."""
    stretches = written(blocks.mapInArrow(_stretches, STRETCH), "stretches")
    last = stretches.agg(F.max("block")).first()[0] or 0
    done = []
    while last > 0:
        # Conversations that are one stretch already wait; the others go on.
        more = stretches.filter("block > 0").select(F.col("conv_id").alias("of")).distinct()
        same = F.col("conv_id").eqNullSafe(F.col("of"))
        done.append(stretches.join(more, same, "left_anti"))
        open_ones = stretches.join(more, same, "left_semi").withColumn("group", F.expr(f"block div {fan_in}"))
        stretches = written(open_ones.groupBy("conv_id", "group").applyInArrow(lambda t: _join_stretches(t.drop_columns(["group"]), fan_in), STRETCH), "stretches")
        last //= fan_in
    for part in done:
        stretches = stretches.unionByName(part)

    def end(batches):
        import pyarrow as pa

        schema = pa.schema([("conv_id", pa.int64()), ("n_rows", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                cost, letters = finished(_square(row["weights"]))
                out.append({"conv_id": row["conv_id"], "n_rows": row["n_rows"], "cost": cost, "audit": letters, "illegal": row["illegal"]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return stretches.mapInArrow(end, "conv_id long, n_rows long, cost long, audit string, illegal long")


# --- repaired texts -----------------------------------------------------------------------------


def audit_parts(found: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """conv_id, block, the state it begins in and its letters: the audit cut at the blocks' borders."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for conv, audit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begin, block, rows = 0, 0, 0
                for at, letter in enumerate(audit):
                    rows += letter != "I"
                    if rows == block_rows:
                        out.append((conv, block, audit[begin : at + 1]))
                        begin, block, rows = at + 1, block + 1, 0
                if begin < len(audit):
                    out.append((conv, block, audit[begin:]))
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["conv_id", "block", "letters"])

    return found.select("conv_id", "audit").mapInArrow(cut, "conv_id long, block long, letters string")


class _Writer:
    """Repaired rows of one conversation, from its letters and its rows in order."""

    def __init__(self):
        self.state = START
        self.letters: list[str] = []
        self.at = 0

    def load(self, letters: str) -> list[tuple[str, str]]:
        """Letters of the next block; what stands before them has been used, but for inserts at the end."""
        rest = self._inserts()
        self.letters, self.at = list(letters), 0
        return rest

    def _inserts(self) -> list[tuple[str, str]]:
        made = []
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.state = NEXT[self.state]
            made.append((ROLE_OF[self.state], ""))
            self.at += 1
        return made

    def row(self, role: str, text: str) -> list[tuple[str, str]]:
        made = self._inserts()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = SYSTEM if self.state == START and role[:1] == "s" else NEXT[self.state]
            made.append((role, text))
        elif letter == "R":
            self.state = NEXT[self.state]
            made.append((ROLE_OF[self.state], text))
        return made

    def end(self) -> list[tuple[str, str]]:
        return self._inserts()


REPAIRED = "conv_id long, place long, role string, text string"


def repaired_rows(placed: DataFrame, found: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, place, role and text of the repaired conversations, in order within each partition.

    Letters and rows meet in one stream per conversation, sorted by place; a task holds one block's letters and one row.
    """
    marks = audit_parts(found, block).select("conv_id", "block", F.lit(-1).cast("long").alias("position"), F.lit("").alias("role"), F.col("letters").alias("text"))
    rows = placed.select("conv_id", F.expr(f"position div {block}").alias("block"), "position", "role", "text")
    # A block's letters stand before its rows; letters beyond the last row (inserts) come as a block of their own.
    together = marks.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "block", "position")

    def run(batches):
        import pyarrow as pa

        current, writer, place, out = _NONE, _Writer(), 0, []

        def put(made):
            nonlocal place
            for role, text in made:
                out.append((current, place, role, text))
                place += 1

        def flush():
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            out.clear()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "place", "role", "text"])

        for batch in batches:
            for conv, _, position, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if conv != current:
                    put(writer.end())
                    current, writer, place = conv, _Writer(), 0
                put(writer.load(text) if position < 0 else writer.row(role, text))
            yield flush()
        put(writer.end())
        yield flush()

    return together.mapInArrow(run, REPAIRED)


_NONE = object()


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of ``role:text`` of its repaired rows, joined by line breaks.

    Reads the partitions of ``repaired_rows`` as they are: each conversation stands in order in one of them.
    """

    def run(batches):
        import pyarrow as pa

        current, digest, out = _NONE, None, []

        def flush():
            ids, shas = [o[0] for o in out], [o[1] for o in out]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.string())], names=["of", "repaired_sha256"])

        for batch in batches:
            for conv, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if conv != current:
                    if digest is not None:
                        out.append((current, digest.hexdigest()))
                    current, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield flush()
        if digest is not None:
            out.append((current, digest.hexdigest()))
        yield flush()

    return repaired.select("conv_id", "role", "text").mapInArrow(run, "of long, repaired_sha256 string")


# --- the whole ----------------------------------------------------------------------------------


def repair(conversations: DataFrame, block: int = BLOCK, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """A row per conversation that has rows (faults, cost, audit), and the repaired rows."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    placed = placed_rows(rows)
    counts = placed.groupBy("conv_id").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    turns = placed.filter("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy(F.col("conv_id").alias("of")).agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    found = written(repairs(blocks_of(placed, block), fan_in), "repairs")
    merged = found.join(counts.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    merged = merged.join(gaps, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    report = merged.select("conv_id", "n_rows", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return report, repaired_rows(placed, found, block)


def damage_and_repair(conversations: DataFrame, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """The report of the damaged conversations, one row for every conversation there was, with the digest of its repair."""
    report, repaired = repair(damaged(conversations), block, fan_in)
    everyone = conversations.select(F.col("conv_id").cast("long").alias("conv")).distinct()
    joined = everyone.join(report, F.col("conv").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    joined = joined.join(repaired_digests(repaired), F.col("conv").eqNullSafe(F.col("of")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(F.col("conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
