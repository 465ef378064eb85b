"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two joins on the node id; it makes at most one row for each edge. A node's
neighbours never meet in one row or window: minima are pre-aggregated before the shuffle, and the join that carries
them back to the edges reads them from a written table, so that adaptive execution can split it where a node is hot. Each round is written to the shared
folder, so a lost executor costs one round at most. The number of rounds grows as the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialise(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """edges: (a, b), comparable ids, any direction, repeats and loops allowed. Returns (node, component), component
    being the least node that can be reached, for every node of an edge that isn't a loop. No edges: no rows. Rows
    with a null end are left out: they link nothing."""
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        after = materialise(_small_star(_large_star(now)))
        then = _state(after)
        drop_table(now)
        now = after
        if then == state:
            break
        state = then
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
