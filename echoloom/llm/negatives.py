"""Hard negatives by a multiway hyperplane tree over vectors.

Components become whole numbers, ``floor(256 * x)``, and a score is an inner product of such vectors, exact. To search by
distance, every row is thought of with one more component that gives all rows the same length: then the squared distance
of an anchor ``a`` to a row ``x`` is ``|a|**2 + longest**2 - 2 * score``, so a window of scores is an annulus of
distances around the anchor.

The tree has two levels. A node has up to ``FANOUT`` split points, rows of a bounded sample, and a row belongs to the nearest of
them (so the borders are hyperplanes). Each split point stores, for each of its siblings, the range of distances from the
split point to the rows below that sibling, taken over all rows. From an anchor's distance to a split point and such a
range follows the range of its distances to the rows of the sibling; if that misses the annulus, the sibling goes.
What is left are leaves, stored in chunks, and these are compared exactly, so nothing is lost.

Anchors are searched in blocks of a fixed number of rows. A block is broadcast (its size is bounded by ``ANCHOR_BLOCK`` rows),
every task goes through its chunks once with a running best list per anchor, and the lists meet in Spark. The first search
finds the positives, with an annulus that shrinks as better rows are found; the second one finds the negatives in the
windows that the positives give. A leaf of any size is as many chunks, so a crowd of equal vectors is spread over tasks.

Rows with a null label, a null vector or a null or non-finite component take no part. A shorter vector counts as
filled up with zeros; components beyond 2**28 either way stay there, so that scores fit a long. Rows are told apart by a number of
their own: repeated ids are rows like others, and of equal scores the smaller id comes first, a null id last. An empty
table, no anchors, or anchors without a positive or a negative give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoloom.llm.common import written
from echoloom.operators.order import with_position
from echoloom.session import scratch_path

SCALE = 256
LIMIT = 1 << 28
N_POSITIVES = 5
N_NEGATIVES = 10
#: The window of an anchor's negatives, in hundredths of the positive's score.
WINDOW = (30, 90)
#: Rows that split points are chosen from, split points of a node, rows in a chunk, anchors in a block and in one product.
SAMPLE_ROWS = 4096
FANOUT = 16
CHUNK = 1024
ANCHOR_BLOCK = 8192
ANCHOR_PART = 256

CHUNK_COLUMNS = "leaf int, near binary, vectors binary, ids binary, known binary, labels binary, numbers binary, n int"
FOUND = "anchor long, slot int, score long, id long, number long"
LAST = np.iinfo(np.int64).max


# --- rows ---------------------------------------------------------------------------------------


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """number, id, label and whole-number components of the rows that take part, written once."""
    value = F.col(vector)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    held = F.transform(value, _component)
    label = F.col(label) if isinstance(label, str) else label
    kept = rows.filter(label.isNotNull() & value.isNotNull() & finite)
    chosen = kept.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), held.alias("vector"))
    return written(chosen.withColumn("number", F.monotonically_increasing_id()), "vectors")


def _component(x: Column) -> Column:
    scaled = F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * SCALE))
    return F.floor(scaled).cast("int")


# --- tree ---------------------------------------------------------------------------------------


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows as int64; in floating point where that is exact."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if most < 2**52:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left.astype(np.int64) @ right.T.astype(np.int64)


def _squares(vectors: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", vectors.astype(np.int64), vectors.astype(np.int64)) if len(vectors) else np.zeros(0, np.int64)


class Tree:
    """Split points of both levels, the length that all rows get, and the ranges once they are known.

    ``tops``: split points of the root. ``leaves[t]``: those of the node below ``t``. Leaf ``t * fanout + s``.
    ``root_range`` and ``node_range`` are (low, high) distances from a split point (first axis) to the rows of a sibling.
    """

    def __init__(self, sample: np.ndarray, longest: int, fanout: int = FANOUT):
        self.longest, self.fanout = longest, fanout
        self.width = sample.shape[1]
        self.tops = _spread(sample, fanout, longest)
        nearest = self._distances(sample, self.tops).argmin(axis=1) if len(sample) else np.zeros(0, int)
        self.leaves = [_spread(sample[nearest == t], fanout, longest) if (nearest == t).any() else self.tops[t : t + 1] for t in range(len(self.tops))]
        self.root_range = self.node_range = None

    def _distances(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Between rows that both have the additional component."""
        a, b = _squares(rows).astype(np.float64), _squares(points).astype(np.float64)
        more_a, more_b = np.sqrt(np.maximum(self.longest - a, 0)), np.sqrt(np.maximum(self.longest - b, 0))
        square = a[:, None] + b[None, :] - 2.0 * _products(rows, points) + (more_a[:, None] - more_b[None, :]) ** 2
        return np.sqrt(np.maximum(square, 0))

    def from_anchors(self, anchors: np.ndarray, points: np.ndarray) -> np.ndarray:
        """From anchors, whose additional component is 0, to rows."""
        square = _squares(anchors).astype(np.float64)[:, None] + float(self.longest) - 2.0 * _products(anchors, points)
        return np.sqrt(np.maximum(square, 0))

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of every row, and its distances to all split points of the root and of its node."""
        to_tops = self._distances(rows, self.tops)
        top = to_tops.argmin(axis=1)
        leaf = np.zeros(len(rows), np.int32)
        below = np.full((len(rows), self.fanout), np.nan)
        for t in np.unique(top):
            here = np.flatnonzero(top == t)
            d = self._distances(rows[here], self.leaves[t])
            leaf[here] = t * self.fanout + d.argmin(axis=1)
            below[here, : d.shape[1]] = d
        wide = np.full((len(rows), self.fanout), np.nan)
        wide[:, : to_tops.shape[1]] = to_tops
        return leaf, np.concatenate([wide, below], axis=1)

    def set_ranges(self, rows: list[tuple[int, list[float], list[float]]]) -> None:
        """``rows``: leaf, least and largest distance to the split points of root and node, over all rows of the leaf."""
        size = self.fanout
        self.root_range = np.stack([np.full((size, size), np.inf), np.full((size, size), -np.inf)])
        self.node_range = np.stack([np.full((size, size, size), np.inf), np.full((size, size, size), -np.inf)])
        for leaf, low, high in rows:
            t, s = divmod(leaf, size)
            for i in range(size):
                if low[i] is not None:
                    self.root_range[0, i, t] = min(self.root_range[0, i, t], low[i])
                    self.root_range[1, i, t] = max(self.root_range[1, i, t], high[i])
                if low[size + i] is not None:
                    self.node_range[0, t, i, s], self.node_range[1, t, i, s] = low[size + i], high[size + i]

    def limits(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible distance of every anchor to the rows of every leaf (anchors x leaves)."""
        n, size = len(anchors), self.fanout
        low, high = np.zeros((n, size * size)), np.full((n, size * size), np.inf)
        root_low, root_high = _bounds(self.from_anchors(anchors, self.tops), *self.root_range)
        for t, points in enumerate(self.leaves):
            node_low, node_high = _bounds(self.from_anchors(anchors, points), self.node_range[0, t], self.node_range[1, t])
            own = slice(t * size, (t + 1) * size)
            low[:, own] = np.maximum(root_low[:, t : t + 1], node_low)
            high[:, own] = np.minimum(root_high[:, t : t + 1], node_high)
        return low, high


def _bounds(distances: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From distances to split points and the split points' ranges: limits of the distances to each sibling's rows."""
    least, most = np.zeros((len(distances), low.shape[1])), np.full((len(distances), low.shape[1]), np.inf)
    for i in range(distances.shape[1]):
        d = distances[:, i : i + 1]
        least = np.maximum(least, np.maximum(low[i] - d, d - high[i]))
        most = np.minimum(most, d + high[i])
    return least, most


def _spread(rows: np.ndarray, n: int, longest: int) -> np.ndarray:
    """Split points far apart: each next one is the row farthest from those before it."""
    chosen, nearest = [0], None
    square = _squares(rows).astype(np.float64)
    more = np.sqrt(np.maximum(longest - square, 0))
    while len(chosen) < min(n, len(rows)):
        k = chosen[-1]
        d = square + square[k] - 2.0 * _products(rows, rows[k : k + 1])[:, 0] + (more - more[k]) ** 2
        nearest = d if nearest is None else np.minimum(nearest, d)
        far = int(nearest.argmax())
        if nearest[far] <= 0:
            break
        chosen.append(far)
    return rows[chosen]


def _matrix(vectors, width: int) -> np.ndarray:
    """A list column as rows of ``width`` whole numbers, filled up with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int32)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(np.int32)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _lists(matrix: np.ndarray, kind):
    """Rows of a matrix as an Arrow list column."""
    import pyarrow as pa

    offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel(), kind))


def fit(vectors: DataFrame) -> Tree:
    """A tree without ranges: split points from a sample of ``SAMPLE_ROWS`` rows, the first by a hash of their number."""
    components = F.aggregate("vector", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + (x.cast("decimal(18,0)") * x).cast("decimal(37,0)")).cast("decimal(38,0)"))
    longest, width = vectors.agg(F.max(components), F.max(F.size("vector"))).first()
    taken = vectors.select("vector", F.xxhash64("number").alias("h"), "number").orderBy("h", "number").limit(SAMPLE_ROWS).select("vector").toArrow()
    return Tree(_matrix(taken.column(0).combine_chunks(), width or 1), int(longest or 0), FANOUT)


# --- index --------------------------------------------------------------------------------------


def index_rows(vectors: DataFrame, tree: Tree, chunk: int) -> DataFrame:
    """All rows in chunks of one leaf each, sorted by id, and the leaf's ranges on each chunk; written."""
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            rows = _matrix(batch.column(batch.schema.get_field_index("vector")), shared.value.width)
            leaf, near = shared.value.place(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _lists(rows, pa.int32()), batch.column(3), pa.array(leaf), _lists(near, pa.float64())],
                names=["id", "label", "vector", "number", "leaf", "near"],
            )

    placed = vectors.select("id", "label", "vector", "number").mapInArrow(place, "id long, label long, vector array<int>, number long, leaf int, near array<double>")

    def pack(batches):
        import pyarrow as pa

        for leaf, table in _runs(batches, chunk):
            rows = _matrix(table.column("vector").combine_chunks(), shared.value.width)
            near = table.column("near").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * shared.value.fanout)
            ids = table.column("id")
            known = ids.is_valid().to_numpy().astype(np.int8)
            values = ids.fill_null(0).to_numpy().astype(np.int64)
            span = np.concatenate([near.min(axis=0), near.max(axis=0)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([leaf], pa.int32()), pa.array([span.tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary()),
                    pa.array([values.tobytes()], pa.binary()), pa.array([known.tobytes()], pa.binary()),
                    pa.array([table.column("label").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                    pa.array([table.column("number").to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([len(rows)], pa.int32()),
                ],
                names=["leaf", "near", "vectors", "ids", "known", "labels", "numbers", "n"],
            )

    # A range of (leaf, id, number) is of even size however full a leaf is.
    ranged = placed.repartitionByRange("leaf", "id", "number").sortWithinPartitions("leaf", F.col("id").asc_nulls_last(), "number")
    return written(ranged.mapInArrow(pack, CHUNK_COLUMNS), "vector-chunks")


def _runs(batches, size: int) -> Iterator[tuple[int, object]]:
    """Tables of up to ``size`` rows of one leaf from sorted batches."""
    import pyarrow as pa

    held, leaf, n = [], None, 0
    for batch in batches:
        leaves = batch.column(batch.schema.get_field_index("leaf")).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(leaves)) + 1).tolist(), len(leaves)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if begin == end:
                continue
            if held and leaves[begin] != leaf:
                yield leaf, pa.Table.from_batches(held)
                held, n = [], 0
            leaf = int(leaves[begin])
            while begin < end:
                take = min(size - n, end - begin)
                held.append(batch.slice(begin, take))
                begin, n = begin + take, n + take
                if n == size:
                    yield leaf, pa.Table.from_batches(held)
                    held, n = [], 0
    if held:
        yield leaf, pa.Table.from_batches(held)


def with_ranges(tree: Tree, chunks: DataFrame) -> Tree:
    """Ranges over all rows, from those of the chunks: at most one row per leaf comes to the driver."""

    size = 2 * tree.fanout

    def spans(batches):
        import pyarrow as pa

        for batch in batches:
            values = [np.frombuffer(b, np.float64) for b in batch.column(1).to_pylist()]
            low = [[None if np.isnan(x) else float(x) for x in v[:size]] for v in values]
            high = [[None if np.isnan(x) else float(x) for x in v[size:]] for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.list_(pa.float64())), pa.array(high, pa.list_(pa.float64()))], names=["leaf", "low", "high"])

    rows = chunks.select("leaf", "near").mapInArrow(spans, "leaf int, low array<double>, high array<double>")
    lows = [F.min(F.col("low")[i]).alias(f"l{i}") for i in range(size)]
    highs = [F.max(F.col("high")[i]).alias(f"h{i}") for i in range(size)]
    found = rows.groupBy("leaf").agg(*lows, *highs)
    tree.set_ranges([(r[0], list(r[1 : 1 + size]), list(r[1 + size :])) for r in found.collect()])
    return tree


# --- search -------------------------------------------------------------------------------------


class Best:
    """The first ``k`` rows of each of ``n`` lists: by score, the highest first, then by id, a null id last, then by number."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id, self.number = np.full((n, k), LAST), np.full((n, k), LAST)
        self.known = np.zeros((n, k), np.int8)
        self.n = np.zeros(n, np.int64)

    def add(self, lists: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, known: np.ndarray, numbers: np.ndarray) -> None:
        """Offer rows (columns, in the order of ties) with their scores to lists; ``allowed`` marks the pairs that count."""
        allowed = allowed & ((scores >= self.score[lists, -1][:, None]) | (self.n[lists] < self.k)[:, None])
        for row in np.flatnonzero(allowed.any(axis=1)):
            columns = np.flatnonzero(allowed[row])
            values = scores[row, columns]
            if len(columns) > self.k:
                # All rows that reach the k-th highest score, ties included; the first k of them in order.
                least = np.partition(values, len(values) - self.k)[len(values) - self.k]
                columns = columns[values >= least]
                values = scores[row, columns]
            first = np.argsort(-values, kind="stable")[: self.k]
            at = columns[first]
            self._merge(lists[row], values[first], ids[at], known[at], numbers[at])

    def _merge(self, at: int, *rows: np.ndarray) -> None:
        kept = (self.score, self.id, self.known, self.number)
        score, ident, known, number = (np.concatenate([old[at, : self.n[at]], new]) for old, new in zip(kept, rows, strict=True))
        order = np.lexsort((number, ident, 1 - known, -score))[: self.k]
        self.n[at] = len(order)
        for old, new in zip(kept, (score, ident, known, number), strict=True):
            old[at, : len(order)] = new[order]


def _chunk(batch, row: int, width: int):
    take = lambda name, kind: np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_buffer(), kind)
    return take("vectors", np.int32).reshape(-1, width), take("ids", np.int64), take("known", np.int8), take("labels", np.int64), take("numbers", np.int64)


#: Distances are square roots; near zero, rounding may be off by the root of a double's last place, far below this share.
SLACK = 1e-6


def _search(chunks: DataFrame, tree, block, k: int, windows) -> DataFrame:
    """The best ``k`` rows of every list of the block, one list per (anchor, window), over the chunks of each task.

    ``block``: vectors, labels and numbers of the anchors. ``windows`` is None for positives: one list per anchor, of other rows of its
    label, any score. Otherwise (low, high), anchors x windows: rows of another label with scores in between.
    """

    def run(batches):
        import pyarrow as pa

        plan = tree.value
        vectors, labels, numbers = block.value[0], block.value[1], block.value[2]
        bounds = windows.value if windows is not None else None
        n, per = len(vectors), 1 if bounds is None else bounds[0].shape[1]
        best = Best(n * per, k)
        low_limit, high_limit = plan.limits(vectors)
        square = _squares(vectors).astype(np.float64) + float(plan.longest)
        slack = SLACK * (1 + np.sqrt(square))

        def distance(scores):
            return np.sqrt(np.maximum(square - 2.0 * scores.astype(np.float64), 0))

        if bounds is not None:
            # The annulus of an anchor holds all its windows; one without a window has an empty annulus.
            low, high = bounds
            some = low <= high
            lowest = np.where(some, low, np.iinfo(np.int64).max).min(axis=1)
            highest = np.where(some, high, np.iinfo(np.int64).min).max(axis=1)
            has_window = some.any(axis=1)
            inner = np.where(has_window, distance(np.where(has_window, highest, 0)), np.inf)
            outer = np.where(has_window, distance(np.where(has_window, lowest, 0)), -np.inf)
        for batch in batches:
            for row in range(batch.num_rows):
                leaf = batch.column(0)[row].as_py()
                if bounds is None:
                    full = best.n >= k
                    reach = np.where(full, distance(np.where(full, best.score[:, -1], 0)), np.inf)
                    alive = low_limit[:, leaf] <= reach + slack
                else:
                    alive = (low_limit[:, leaf] <= outer + slack) & (high_limit[:, leaf] >= inner - slack)
                chosen = np.flatnonzero(alive)
                if not len(chosen):
                    continue
                rows, ids, known, row_labels, row_numbers = _chunk(batch, row, plan.width)
                for start in range(0, len(chosen), ANCHOR_PART):
                    part = chosen[start : start + ANCHOR_PART]
                    scores = _products(vectors[part], rows)
                    same = labels[part][:, None] == row_labels[None, :]
                    if bounds is None:
                        best.add(part, scores, same & (numbers[part][:, None] != row_numbers[None, :]), ids, known, row_numbers)
                    else:
                        for w in range(per):
                            inside = ~same & (scores >= bounds[0][part, w][:, None]) & (scores <= bounds[1][part, w][:, None])
                            best.add(part * per + w, scores, inside, ids, known, row_numbers)
        lists = np.repeat(np.arange(n * per), best.n)
        if len(lists):
            taken = np.arange(k)[None, :] < best.n[:, None]
            unknown = best.known[taken] == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[lists // per]), pa.array((lists % per).astype(np.int32)), pa.array(best.score[taken]), pa.array(best.id[taken], mask=unknown), pa.array(best.number[taken])],
                names=["anchor", "slot", "score", "id", "number"],
            )

    return chunks.select("leaf", "vectors", "ids", "known", "labels", "numbers").mapInArrow(run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The lists of all tasks as one list per (anchor, slot)."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "number")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, window: tuple[int, int] = WINDOW, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over ``vectors`` as made by ``whole_vectors``."""
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if vectors.limit(1).count() == 0:
        return spark.createDataFrame([], out)
    tree = fit(vectors)
    chunks = index_rows(vectors, tree, CHUNK)
    shared = spark.sparkContext.broadcast(with_ranges(tree, chunks))
    wanted = vectors.filter(is_anchor).select("id", "label", "number", "vector")
    placed = written(with_position(wanted, (), "id", "number").withColumn("block", F.expr(f"position div {ANCHOR_BLOCK}")), "anchors")
    last = placed.agg(F.max("block")).first()[0]
    if last is None:
        return spark.createDataFrame([], out)
    path = scratch_path(spark, "negatives")
    for b in range(last + 1):
        rows = placed.filter(F.col("block") == b).orderBy("position").select("id", "label", "number", "vector").toArrow()
        numbers = rows.column(2).to_numpy()
        anchors = spark.sparkContext.broadcast((_matrix(rows.column(3).combine_chunks(), tree.width), rows.column(1).to_numpy(), numbers))
        positives = written(_first(_search(chunks, shared, anchors, n_positives, None), n_positives), "positives")
        low, high = np.ones((len(numbers), n_positives), np.int64), np.zeros((len(numbers), n_positives), np.int64)
        place = np.argsort(numbers)
        # At most ANCHOR_BLOCK * n_positives rows.
        found = positives.select("anchor", "rank", "score").toArrow()
        at = place[np.searchsorted(numbers[place], found.column(0).to_numpy())]
        scores, slots = found.column(2).to_numpy(), found.column(1).to_numpy() - 1
        low[at, slots], high[at, slots] = [-(-window[0] * int(s) // 100) for s in scores], [window[1] * int(s) // 100 for s in scores]
        windows = spark.sparkContext.broadcast((low, high))
        negatives = _first(_search(chunks, shared, anchors, n_negatives, windows), n_negatives)
        chosen = positives.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        ids = placed.filter(F.col("block") == b).select(F.col("number").alias("anchor"), F.col("id").alias("anchor_id"))
        joined = negatives.join(chosen, ["anchor", "slot"]).join(ids, "anchor")
        joined.select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        ).write.parquet(f"{path}/block={b}")
        for broadcast in (anchors, windows):
            broadcast.unpersist()
    return spark.read.schema(out).parquet(path).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
