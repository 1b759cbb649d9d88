"""Chat formatting of reply trees.

Nodes (tree, node, parent, score, role, text) are messages that answer another. Iterative self-joins double the distance
looked back in each step: after k steps a node knows its ancestor 2**k levels up, and the sum of scores and number of nodes between. So a tree of
depth d takes log2(d) joins of narrow rows, not d. Leaves are ranked within their tree by the mean score along their
path; the nodes of the chosen paths are enumerated by the same steps backwards. Each chosen path is one conversation.

A conversation is written as one row per turn, in order (``position``), so that none has to fit into a cell; its text is
the turns' segments one after the other. Turns look like this::

    [SYS] text [/SYS]   [INST] text [/INST]   <s> text </s>   [TURN] role<newline>text [/TURN]

for system, user, assistant and any other role. Control strings inside a text get a backslash in front (and those
backslashes that stand directly before one are doubled), which :func:`unescaped` takes back exactly. The loss mask covers the assistants'
texts: ``loss_start`` to ``loss_end`` in the segment, in code points.

Null texts and roles are empty ones. A parent that is missing makes a node a root. Nodes that hang on a cycle belong to no path.
Trees need a name that is not null, nodes one that is unique in their tree. Equal scores are ranked by node.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoloom.llm.common import written
from echoloom.operators.order import with_position

_CONTROL = r"(</?s>|\[/?(?:INST|SYS|TURN)\])"
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
OTHER = ("[TURN] ", "\n", " [/TURN]")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)" + _CONTROL, r"$1$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)\1\\" + _CONTROL, r"$1$2")


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(steps, totals): per doubling step (tree, node, up); and (tree, node, depth, total, open) in the end.

    ``depth`` and ``total`` are the number of nodes and the sum of scores from the root down to the node; ``open`` marks nodes without a root.
    """
    own = nodes.select("tree", "node", "parent", "score")
    known = own.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    rooted = own.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")
    )
    state = written(rooted, "chat-step")
    limit = state.count()
    above_root, done = F.col("up").isNotNull(), [state.filter("up IS NULL")]
    climbing = state.filter(above_root)
    steps = []
    reach = 1
    # Only nodes that have not reached their root take part in the next step.
    while reach <= limit and not climbing.isEmpty():
        steps.append(climbing.select("tree", "node", "up"))
        known = reduce(DataFrame.unionByName, done, climbing)
        above = known.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("plus"))
        moved = climbing.join(above, ["tree", "up"]).select(
            "tree", "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("plus")).alias("total")
        )
        moved = written(moved, "chat-step")
        done.append(moved.filter("up IS NULL"))
        climbing = moved.filter(above_root)
        reach *= 2
    totals = reduce(DataFrame.unionByName, done, climbing)
    return steps, totals.select("tree", "node", "depth", "total", above_root.alias("open"))


def chosen_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(tree, path, node, position) of the ``best`` root-to-leaf paths of each tree; ``path`` is the rank, from 1."""
    steps, totals = ancestors(nodes)
    parents = nodes.filter("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = totals.filter("NOT open").join(parents, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "node"))
    found = written(leaves.withColumn("path", rank).filter(F.col("path") <= best).select("tree", "path", "node"), "chat-paths")
    for step in reversed(steps):
        higher = found.join(step, ["tree", "node"]).select("tree", "path", F.col("up").alias("node"))
        found = written(found.unionByName(higher), "chat-paths")
    return found.join(totals.select("tree", "node", (F.col("depth") - 1).alias("position")), ["tree", "node"])


def formatted_turns(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(tree, path, position, segment, loss_start, loss_end): every turn of the chosen paths under the template."""
    texts = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = chosen_paths(nodes, best).join(texts, ["tree", "node"]).withColumn("body", escaped(F.col("text")))
    other = F.concat(F.lit(OTHER[0]), F.url_encode("role"), F.lit(OTHER[1]))
    start, end = other, F.lit(OTHER[2])
    for role, marks in MARKS.items():
        start, end = (F.when(F.col("role") == role, F.lit(mark)).otherwise(old) for mark, old in zip(marks, (start, end), strict=True))
    turns = turns.withColumn("start", start)
    loss = lambda place: F.when(F.col("role") == "assistant", place.cast("long"))
    return turns.select(
        "tree", "path", "position", F.concat("start", "body", end).alias("segment"),
        loss(F.length("start")).alias("loss_start"), loss(F.length("start") + F.length("body")).alias("loss_end"),
    )


def parsed_turns(turns: DataFrame) -> DataFrame:
    """Adds ``role``, ``text`` and ``loss_text``, read from the segments and their loss mask alone."""
    segment = F.col("segment")
    role = F.url_decode(F.regexp_extract(segment, r"^\[TURN\] ([^\n]*)\n", 1))
    body = F.regexp_extract(segment, r"(?s)^\[TURN\] [^\n]*\n(.*) \[/TURN\]$", 1)
    for name, (start, end) in MARKS.items():
        mine = segment.startswith(start)
        role = F.when(mine, F.lit(name)).otherwise(role)
        body = F.when(mine, segment.substr(F.lit(len(start) + 1), F.length(segment) - len(start) - len(end))).otherwise(body)
    masked = segment.substr((F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return turns.withColumns({"role": role, "text": unescaped(body), "loss_text": unescaped(masked)})


DIGESTS = "tree string, path int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation of parsed ``turns``. Turns stream through in order, so memory does not follow their number."""

    def run(batches):
        now, made = None, None
        done: list[tuple] = []

        def close():
            n, every, chars, loss, size = made
            done.append((*now, n, every.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["tree"], row["path"])
                if key != now:
                    if now is not None:
                        close()
                    now, made = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                made[0] += 1
                made[1].update(f"{row['role']}\n{row['text']}\n".encode())
                if row["loss_text"] is not None:
                    made[2] += len(row["loss_text"])
                    made[3].update(row["loss_text"].encode())
                made[4] += len(row["segment"])
            if done:
                yield _digest_batch(done)
                done.clear()
        if now is not None:
            close()
            yield _digest_batch(done)

    ordered = turns.select("tree", "path", "position", "segment", "role", "text", "loss_text").repartition("tree", "path")
    return ordered.sortWithinPartitions("tree", "path", "position").mapInArrow(run, DIGESTS)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["tree", "path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


#: Characters of a text that take part in the order of rows of one turn.
TEXT_ORDER = 64


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees in which each turn answers the one before.

    Turns follow ``turn`` (any long; null first), then role, the first ``TEXT_ORDER`` characters of the text and a digest of it; rows repeated
    with one turn are turns of their own. Rows without a conv_id are one conversation. They are numbered over ranges and written once, so a
    conversation of very many rows is not gathered in one task, and no whole text is a range's border.
    """
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree")
    order = F.struct("role", F.substring("text", 1, TEXT_ORDER).alias("head"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = conversations.select(tree, "turn", order.alias("order"), F.struct("role", "text").alias("said"))
    placed = with_position(rows, ("tree",), date="turn", identifier="order").withColumn("node", F.col("position") + 1)
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return placed.select("tree", "node", parent.alias("parent"), F.lit(1.0).alias("score"), "said.role", "said.text")
