"""Hard negatives: several blocks and leaves, edges."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int, id string"


def plain(rows, is_anchor):
    """(vec_id, vector, label) -> rows of the result, by full comparison."""
    whole = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    order = lambda i: (whole[i][0] is None, whole[i][0] or 0, i)
    out = []
    for a, (anchor, va, la) in enumerate(whole):
        if anchor is None or not is_anchor(anchor):
            continue
        score = {i: sum(x * y for x, y in zip(va, v, strict=False)) for i, (_, v, _) in enumerate(whole) if i != a}
        first = sorted(score, key=lambda i: (-score[i], *order(i)))
        for p in [i for i in first if whole[i][2] == la][:5]:
            chosen = [i for i in first if whole[i][2] != la and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:10]
            out += [(anchor, whole[p][0], k + 1, whole[i][0], score[p], score[i]) for k, i in enumerate(chosen)]
    return sorted(out, key=repr)


def found(spark, rows, anchors):
    table = spark.createDataFrame([(*r, "clash") for r in rows], ROWS)
    result = negatives.mine(negatives.whole_vectors(table), anchors)
    assert result.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in result.collect()), key=repr)


@pytest.fixture
def small(monkeypatch):
    """Several blocks of anchors, chunks and split points on few rows."""
    for name, value in (("CHUNK", 16), ("FANOUT", 3), ("ANCHOR_BLOCK", 7), ("ANCHOR_PART", 2), ("SAMPLE_ROWS", 40)):
        monkeypatch.setattr(negatives, name, value)


def test_blocks_ties_and_odd_rows(spark, small):
    draw = random.Random(3)
    point = lambda: [draw.gauss(0, 1) for _ in range(6)]
    rows = [(i, point(), i % 4) for i in range(240)]
    crowd = point()
    rows += [(1000 + i, crowd, i % 3) for i in range(90)]
    rows += [(5, point(), 1), (5, point(), 1), (None, crowd, 2), (None, point(), 0)]
    rows += [(3000, None, 1), (3001, point(), None), (3002, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (3003, [math.nan] * 6, 2), (3004, [math.inf] * 6, 2)]
    rows += [(3010, [], 0), (3020, [0.5, 0.25], 1), (3030, [0.0] * 6, 2), (2**63 - 1, crowd, 1)]
    draw.shuffle(rows)
    expected = plain(rows, lambda i: i % 10 == 0)
    assert len({r[0] for r in expected}) > 20
    assert found(spark, rows, F.col("id") % 10 == 0) == expected


def test_clusters_are_searched_without_loss(spark, small):
    """Tight clusters, in which the ranges really end subtrees."""
    draw = random.Random(4)
    centres = [[draw.gauss(0, 4) for _ in range(5)] for _ in range(9)]
    rows = [(i, [x + draw.gauss(0, 0.05) for x in centres[i % 9]], i % 2) for i in range(400)]
    assert found(spark, rows, F.col("id") % 20 == 0) == plain(rows, lambda i: i % 20 == 0)


def test_subtrees_are_eliminated():
    rows = np.array([[1000 * k + j, 0] for k in range(4) for j in range(20)], np.int32)
    tree = negatives.Tree(rows, int((rows.astype(np.int64) ** 2).sum(axis=1).max()))
    leaf, near = tree.place(rows)
    tree.set_ranges([(int(x), [None if np.isnan(v) else v for v in near[leaf == x].min(axis=0)], [None if np.isnan(v) else v for v in near[leaf == x].max(axis=0)]) for x in np.unique(leaf)])
    low, high = tree.limits(rows[-1:])
    true = tree.from_anchors(rows[-1:], rows)[0]
    assert all(low[0, x] - 1e-3 <= d <= high[0, x] + 1e-3 for x, d in zip(leaf, true, strict=True))
    assert (low[0, np.unique(leaf)] > true.min() + 1).any()


def test_large_components_stay_exact(spark):
    rows = [(0, [3.0e5, 1.0], 0), (1, [2.0e5, -1.0], 0), (2, [1.5e5, 7.0], 1), (3, [1.0e30, 0.0], 1), (4, [1.0e5, 0.0], 1)]
    kept = [r for r in rows if r[0] != 3]
    result = found(spark, rows, F.col("id") == 0)
    assert [r for r in result if r[3] != 3] == plain(kept, lambda i: i == 0)


def test_no_rows_and_no_anchors(spark):
    assert found(spark, [], F.col("id") % 100 == 0) == []
    assert found(spark, [(1, [1.0], 0), (2, [1.0], 1)], F.col("id") % 100 == 0) == []
