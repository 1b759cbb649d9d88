"""Mixing sources to target weights by entropy balancing.

Each document gets a rate: the mean number of copies that the mix takes of it. Of all rates between 0 and ``cap`` that give
every source its target of words, those are taken that are closest in entropy to one copy of each document. They are
``min(cap, exp(lambda * size / mean size))`` with one multiplier per source, the minimum of a convex dual that Newton
iterations find; a bracket around each root halves the step where Newton would leave it. Sources do not share
documents, so the Hessian is diagonal and one aggregate over all sources is one iteration for every source.

Documents of one source and size have equal rates. The iterations therefore run over cells, one row per source and size
with its number of documents; a source of w words has at most sqrt(2 w) of them. Rates are rounded into copies
over the cells in order of size, each carrying the rest to the next, and what a source then lacks or exceeds is
made up from its largest cells that fit, pass by pass. A cell's copies go to its documents in the order of a hash of their ids.

Everything is a DataFrame operation. Sums are exact (integers and decimals), so a repeated run agrees with the first.
The driver sees single rows: totals, and how many sources have not converged.

Null text, empty text and text of white space have size 0 and take 0 words. A null source is a source of its own, the
last one. Repeated ids and repeated rows are documents of their own. An empty table gives an empty result.
Columns other than ``doc_id``, ``source`` and ``text`` are not read; ``take_copies`` keeps them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoloom.llm.common import whole_text, written
from echoloom.operators.order import with_position

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
CAP = 2

#: Rates are kept as multiples of 2**-24 when they are rounded into copies.
RATE_BITS = 24
#: Sums of words are taken in units of 2**-20.
WORD_UNITS = float(1 << 20)
#: A multiplier takes its last step where the words are this close to the target; Newton then squares what is left.
CONVERGED = 1e-7
MAX_STEPS = 100
#: Steps from one written table of multipliers to the next.
STEPS_A_WRITE = 3


def word_size(text: str = "text") -> Column:
    """Words between white space; null has none."""
    return F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _same(left: str, right: str, *names: str) -> Column:
    found = F.lit(True)
    for name in names:
        found = found & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return found


def _exact(value: Column) -> Column:
    """A sum that does not depend on the order of its rows, in ``WORD_UNITS``."""
    return F.sum(F.round(value * WORD_UNITS).cast("decimal(38,0)")).cast("double") / WORD_UNITS


def source_targets(cells: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP) -> DataFrame:
    """source, source_size, n_docs, least (smallest size above 0), weight and target of every source.

    Sources take the weights in turn, by code point, null last. A target stops at ``cap`` times its source's size; what is
    above is shared again by weight among the others until none is above, one aggregate for each time it is shared.
    """
    sums = cells.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    ranked = with_position(sums.withColumn("last", F.col("source").isNull()), (), "last", "source")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    sources = written(ranked.select("source", "source_size", "n_docs", "least", turn.cast("long").alias("weight")), "mix-sources")
    size, most, weight = F.col("source_size"), F.col("source_size") * cap, F.col("weight")
    total = sources.agg(F.sum(size)).first()[0] or 0
    wanted, left, open_weight = total * share_percent, total * share_percent, 0
    full = F.lit(False)
    while True:
        held, now_open = sources.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, weight))).first()
        held, now_open = held or 0, now_open or 0
        if now_open == open_weight or now_open == 0:
            break
        left, open_weight = wanted - 100 * held, now_open
        # most <= left / 100 * weight / open_weight, in whole numbers
        full = most.cast("decimal(38,0)") * (100 * open_weight) <= weight.cast("decimal(38,0)") * F.lit(left).cast("decimal(38,0)")
    even = F.lit(left / 100.0) * weight / F.lit(float(open_weight or 1))
    return sources.withColumn("target", F.when(full, most.cast("double")).otherwise(even))


def balance(cells: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``cells`` with the ``rate`` of their documents: the multiplier of every source by safeguarded Newton steps."""
    spread = F.col("source_size") / F.col("n_docs")
    top = F.log(F.lit(float(cap))) * F.col("mean") / F.col("least") * (1 + 1e-9)
    bottom = F.log(F.least(F.lit(1.0), F.col("target") / F.col("source_size"))) * F.col("mean") / F.col("least") * (1 + 1e-9)
    is_full = F.col("target") >= F.col("source_size") * cap
    state = sources.filter("source_size > 0").withColumn("mean", spread).select(
        "source", "mean", "target", bottom.alias("low"), top.alias("high"),
        F.when(is_full, top).otherwise(F.lit(0.0)).alias("multiplier"), is_full.alias("done"),
    )
    state = written(state, "mix-multipliers")
    for _ in range(MAX_STEPS):
        if state.filter("NOT done").limit(1).count() == 0:
            break
        for _ in range(STEPS_A_WRITE):
            state = _newton_step(cells, state, cap)
        state = written(state, "mix-multipliers")
    found = state.select("source", "mean", "multiplier")
    joined = cells.alias("c").join(found.alias("s"), _same("c", "s", "source"), "left").select("c.*", "mean", "multiplier")
    return joined.select(*cells.columns, F.coalesce(_rate(cap), F.lit(1.0)).alias("rate"))


def _rate(cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.col("multiplier") * F.col("size") / F.col("mean")))


def _newton_step(cells: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """One iteration for every source that has not converged."""
    keys = state.columns
    open_state = state.filter("NOT done")
    rows = cells.alias("c").join(open_state.alias("s"), _same("c", "s", "source")).select("s.*", "n", "size").withColumn("rate", _rate(cap))
    words = F.col("n") * F.col("size") * F.col("rate")
    free = F.when(F.col("rate") < cap, words * F.col("size") / F.col("mean")).otherwise(0.0)
    summed = rows.groupBy(*keys).agg(_exact(words).alias("words"), _exact(free).alias("slope"))
    error = F.col("words") - F.col("target")
    low = F.when(error < 0, F.col("multiplier")).otherwise(F.col("low"))
    high = F.when(error > 0, F.col("multiplier")).otherwise(F.col("high"))
    bounded = summed.select("source", "mean", "target", low.alias("low"), high.alias("high"), "multiplier", error.alias("error"), "slope")
    newton = F.when(F.col("slope") > 0, F.col("multiplier") - F.col("error") / F.col("slope"))
    inside = (newton > F.col("low")) & (newton < F.col("high"))
    step = F.when(F.col("error") == 0, F.col("multiplier")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
    # The bracket may also close on a kink of the dual, where Newton has no say.
    done = (F.abs("error") <= CONVERGED * F.col("target")) | (F.col("high") - F.col("low") <= F.abs("multiplier") * 1e-15)
    moved = bounded.select("source", "mean", "target", "low", "high", step.alias("multiplier"), done.alias("done"))
    return state.filter("done").unionByName(moved)


def round_copies(cells: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """source, size, n and ``copies`` of every cell: rates rounded over the cells, then the rest of each source made up.

    Carried over cells in order of size, the rounding is off by the largest document of the source at most. Each pass
    then gives copies to (or takes them from) the largest cell that the rest still holds and that has room, so
    the rest shrinks below that cell's size. It ends when no cell fits.
    """
    unit = 1 << RATE_BITS
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("n") * F.round(F.col("rate") * unit).cast("long")).over(before)
    rounded = F.shiftright(F.col("upto") + unit // 2, RATE_BITS)
    cumulated = cells.withColumn("upto", upto).withColumn("upto", rounded)
    earlier = F.lag("upto", 1, 0).over(Window.partitionBy("source").orderBy("size"))
    made = written(cumulated.select("source", "size", "n", (F.col("upto") - earlier).alias("copies")), "mix-cells")

    taken = made.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    rest = F.round(F.col("target")).cast("long") - F.col("taken")
    state = taken.alias("t").join(sources.alias("s"), _same("t", "s", "source")).select("t.source", rest.alias("rest"), F.lit(None).cast("long").alias("below"))
    changes = None
    while True:
        room = F.when(F.col("rest") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("rest")) & (room > 0) & (F.col("below").isNull() | (F.col("size") < F.col("below")))
        open_cells = made.alias("c").join(state.alias("s"), _same("c", "s", "source") & fits).select("c.*", "rest", room.alias("room"))
        best = open_cells.groupBy("source").agg(F.max(F.struct("size", "room", "rest")).alias("best")).select("source", "best.*")
        change = F.least(F.col("room"), F.expr("abs(rest) div size")) * F.sign("rest").cast("long")
        step = written(best.select("source", "size", change.alias("change"), "rest"), "mix-rest")
        if step.limit(1).count() == 0:
            break
        state = step.select("source", (F.col("rest") - F.col("change") * F.col("size")).alias("rest"), F.col("size").alias("below"))
        changes = step if changes is None else changes.unionByName(step)
    if changes is None:
        return made
    joined = made.alias("c").join(changes.alias("d"), _same("c", "d", "source", "size"), "left")
    return joined.select("c.source", "c.size", "c.n", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"))


def mixing_plan(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP, row: str | None = None
) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every document. ``row`` names a column to carry along."""
    # Hash of the id: which of a cell's documents get the copies that do not go round.
    tie = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(" "))), 1, 15), 16, 10).cast("long")
    carried = [F.col(row).alias("row")] if row else []
    rows = written(docs.select("doc_id", "source", word_size().alias("size"), tie.alias("tie"), *carried), "mix-sizes")
    cells = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sources = written(source_targets(cells, weights, share_percent, cap), "mix-targets")
    copies = round_copies(balance(cells, sources, cap), sources, cap)
    per_source = F.col("s.source_size"), F.col("s.target")
    cells = copies.alias("c").join(sources.alias("s"), _same("c", "s", "source")).select("c.*", *per_source)
    placed = with_position(rows, ("source", "size"), "tie", "doc_id")
    # The cells of all sources are small beside the documents; a hot cell's documents are spread by skew handling.
    joined = placed.alias("d").join(cells.alias("c"), _same("d", "c", "source", "size"))
    extra = F.when(F.col("d.position") < F.expr("c.copies % c.n"), F.lit(1)).otherwise(F.lit(0))
    return joined.select(
        "d.doc_id", "d.source", "d.size", "c.source_size", "c.target", (F.expr("c.copies div c.n") + extra).alias("copies"),
        *[F.col("d.row") for _ in carried],
    )


def take_copies(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the plan says. Rows are told apart by a number of their own."""
    numbered = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "mix-docs")
    plan = mixing_plan(numbered.select("doc.doc_id", "doc.source", "doc.text", "row"), row="row", **settings)
    chosen = plan.filter("copies > 0").select("row", "copies")
    return numbered.join(chosen, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
