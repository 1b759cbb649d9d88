"""Entropy balancing: targets, bounds, edges, and the mix itself."""

from __future__ import annotations

import pytest

from echoloom.llm import mixing

DOCS = "doc_id long, source string, text string, n_words string"


def words(n: int) -> str:
    return " ".join(["w"] * n)


@pytest.fixture(scope="module")
def plan(spark):
    """Null, empty and repeated rows, a null source, a hot source, one very long text, and a column with the name of a result."""
    rows = [(i, "hot", words(1 + i % 40), "x") for i in range(600)]
    rows += [(1000 + i, "b", words(5), "x") for i in range(50)] + [(1050, "b", words(4000), "x")]
    rows += [(2000 + i, "c", words(3 * i), "x") for i in range(60)]
    rows += [(7, None, words(9), "x")] * 40 + [(None, None, words(2), "x")] * 40
    rows += [(3000, "void", None, "x"), (3001, "void", "", "x"), (3001, "void", " \t\n", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    return len(rows), mixing.mixing_plan(docs).collect()


def test_targets_share_the_excess(plan):
    n, rows = plan
    assert len(rows) == n
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
    total, order = 1.5 * sum(size.values()), [*sorted(s for s in size if s is not None), None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left, open_weight = total - sum(2 * size[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * size[s] if s in full else left * weight[s] / open_weight for s in order}
        above = {s for s in order if target[s] > 2 * size[s]}
        if not above:
            break
        full |= above
    for r in rows:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])


def test_taken_words_meet_the_target(plan):
    _, rows = plan
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        target[r.source] = r.target
    for source, words_taken in taken.items():
        smallest = min((r.size for r in rows if r.source == source and r.size > 0), default=0)
        assert abs(words_taken - target[source]) <= max(smallest, 1)


def test_rates_are_tilted(spark):
    """Rates of a source are min(2, exp(multiplier * size / mean)) and meet the target, however far the sizes are apart."""
    cells = spark.createDataFrame([("a", s, n) for s, n in ((1, 500), (10, 90), (100, 9), (30000, 1))], "source string, size long, n long")
    sources = spark.createDataFrame([("a", 32300, 600, 1, 1, 21000.0)], "source string, source_size long, n_docs long, least long, weight long, target double")
    rate = {r["size"]: r["rate"] for r in mixing.balance(cells, sources).collect()}
    assert sum(n * s * rate[s] for s, n in ((1, 500), (10, 90), (100, 9), (30000, 1))) == pytest.approx(21000, rel=1e-9)
    assert rate[10] == pytest.approx(rate[1] ** 10, rel=1e-9) and rate[100] == pytest.approx(rate[1] ** 100, rel=1e-9)


def test_copies_of_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", words(4), 10, "p"), (1, "a", words(4), 11, "q"), (2, "b", words(6), 12, None)], "doc_id long, source string, text string, copies long, `a.b` string")
    plan = {(r.doc_id, r.source): r.copies for r in mixing.mixing_plan(docs).collect()}
    mix = mixing.take_copies(docs)
    assert mix.columns == docs.columns
    assert mix.filter("source = 'b'").count() == plan[2, "b"]
    assert all(r.copies in (10, 11, 12) for r in mix.collect())


def test_empty_table(spark):
    assert mixing.mixing_plan(spark.createDataFrame([], DOCS)).collect() == []
