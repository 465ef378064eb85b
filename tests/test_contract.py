"""Rake and compress against orders and levels by recursion."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rillwork.operators import contract


def values(down):
    """Strahler order and height of every node; parents have smaller numbers."""
    above = defaultdict(list)
    for v, d in down.items():
        if d is not None:
            above[d].append(v)
    order, height = {}, {}
    for v in sorted(down, reverse=True):
        own = Counter(order[u] for u in above[v])
        top = max(own, default=0)
        order[v] = 1 if not top else top + (own[top] >= 2)
        height[v] = 1 + max((height[u] for u in above[v]), default=0)
    return order, height


def shapes():
    rng = random.Random(4)
    yield {i: None if i % 50 == 0 else rng.randrange(i - i % 50, i) for i in range(400)}  # bushes
    yield {i: None if not i else rng.randrange(max(0, i - 3), i) for i in range(300)}  # deep
    yield {i: None if not i else (i - 1) // 2 for i in range(200)}  # a heap
    yield {i: None if not i else i - 1 if i < 100 else rng.randrange(0, i) for i in range(160)}  # a stem with twigs
    yield {i: None if not i else i - 1 if i % 2 else max(0, i - 2) for i in range(121)}  # a comb
    yield {7: None}


def table(spark, down):
    return spark.createDataFrame(list(down.items()), "cell_index long, down long")


@pytest.mark.parametrize("down", shapes())
def test_orders_and_levels(spark, down):
    order, height = values(down)
    edges = table(spark, down)
    assert {r.cell_index: r.order for r in contract.contract(edges).collect()} == order
    assert {r.cell_index: r.level for r in contract.contract(edges, contract.Height, "level").collect()} == height


def test_functions_compose():
    """Of all pairs of functions, on plain numbers in place of columns."""

    def apply(f, x):
        return x if x > f[1] else f[1] + 1 if x >= f[0] else f[2]

    def compose(f, g):
        return g if g[1] > f[1] and f[1] + 1 < g[0] else (f[0], max(f[1], g[1]), apply(g, f[2]))

    own = [(0, 0, 0)] + [(m, m, c) for m in range(1, 5) for c in (m, m + 1)]
    known = set(own)
    for _ in range(3):
        known |= {compose(f, g) for f in known for g in own}
        for f in known:
            for g in known:
                assert all(apply(compose(f, g), x) == apply(g, apply(f, x)) for x in range(1, 9))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    plain = contract.written
    monkeypatch.setattr(contract, "written", lambda df: rounds.append(1) or plain(df))
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("cell_index"), F.when(F.col("id") > 0, F.col("id") - 1).alias("down"))
    got = contract.contract(edges, contract.Height, "level")
    assert got.filter(F.col("level") != n - F.col("cell_index")).isEmpty() and got.count() == n
    assert len(rounds) < 40


def test_cycles_and_no_rows(spark):
    for down in ({0: None, 1: 2, 2: 1}, {1: 2, 2: 3, 3: 1}, {0: None, 1: 0, 2: 1, 3: 4, 4: 5, 5: 3, 6: 4}):
        with pytest.raises(RuntimeError, match="cycle"):
            contract.contract(table(spark, down)).collect()
    assert contract.contract(table(spark, {7: None}).limit(0)).count() == 0
