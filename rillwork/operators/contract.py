"""Values of trees from the leaves down, in logarithmically many rounds whatever the shape: rake and compress.

A phase takes the leaves, whose values are known, and all chains of nodes that wait for one child only. A chain node's value is
a function of that child's, and such functions are composed by pointer doubling up to the leaf or the branch at the
chain's upper end. Leaves hand their values on to the branch below their chain; branches take their chain's lower end as
their own. What remains are branches, at most as many as half of the leaves before; so a phase halves the network, and a
network that is one chain takes one phase. The chain nodes' values follow at the end from the branches', phase by phase.

edges: cell_index, down (null at a root). A cycle is an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flow
from .iterate import discard, written


class Strahler:
    """Orders: the greatest of the children's, one more where two children share it; 1 without children.

    The functions of one child's order x are x above e, e + 1 from s to e, and c below s; they are closed under composition."""

    @staticmethod
    def empty() -> Column:
        return F.struct(F.lit(0).alias("top"), F.lit(0).cast("long").alias("n"))

    @staticmethod
    def gather(came: DataFrame) -> DataFrame:
        """came: cell_index, value. cell_index, came (how many), add (their state)."""
        equal = came.groupBy("cell_index", F.col("value").alias("top")).agg(F.count("*").alias("n"))
        return equal.groupBy("cell_index").agg(F.sum("n").alias("came"), F.max(F.struct("top", "n")).alias("add"))

    @staticmethod
    def merge(a: Column, b: Column) -> Column:
        n = F.when(a["top"] > b["top"], a["n"]).when(a["top"] < b["top"], b["n"]).otherwise(a["n"] + b["n"])
        return F.struct(F.greatest(a["top"], b["top"]).alias("top"), n.alias("n"))

    @staticmethod
    def value(state: Column) -> Column:
        return F.when(state["top"] == 0, 1).otherwise(state["top"] + (state["n"] >= 2).cast("int"))

    @staticmethod
    def of(state: Column) -> Column:
        top = state["top"]
        return F.struct(top.alias("s"), top.alias("e"), (top + (state["n"] >= 2).cast("int")).alias("c"))

    @staticmethod
    def identity() -> Column:
        return F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0).alias("c"))

    @staticmethod
    def apply(f: Column, x: Column) -> Column:
        return F.when(x > f["e"], x).when(x >= f["s"], f["e"] + 1).otherwise(f["c"])

    @classmethod
    def compose(cls, f: Column, g: Column) -> Column:
        """g after f."""
        low = cls.apply(g, f["c"])
        far = (g["e"] > f["e"]) & (f["e"] + 1 < g["s"])
        end = F.greatest(f["e"], g["e"])
        return F.when(far, g).otherwise(F.struct(f["s"].alias("s"), end.alias("e"), low.alias("c")))


class Height:
    """Levels: one more than the greatest of the children's; 1 without children. Functions max(a, x + b)."""

    @staticmethod
    def empty() -> Column:
        return F.struct(F.lit(0).alias("top"))

    @staticmethod
    def gather(came: DataFrame) -> DataFrame:
        return came.groupBy("cell_index").agg(F.count("*").alias("came"), F.struct(F.max("value").alias("top")).alias("add"))

    @staticmethod
    def merge(a: Column, b: Column) -> Column:
        return F.struct(F.greatest(a["top"], b["top"]).alias("top"))

    @staticmethod
    def value(state: Column) -> Column:
        return state["top"] + 1

    @staticmethod
    def of(state: Column) -> Column:
        return F.struct((state["top"] + 1).alias("a"), F.lit(1).alias("b"))

    @staticmethod
    def identity() -> Column:
        return F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))

    @staticmethod
    def apply(f: Column, x: Column) -> Column:
        return F.greatest(f["a"], x + f["b"])

    @staticmethod
    def compose(f: Column, g: Column) -> Column:
        return F.struct(F.greatest(g["a"], f["a"] + g["b"]).alias("a"), (f["b"] + g["b"]).alias("b"))


def _bases(links: DataFrame, algebra, last: int) -> DataFrame:
    """links: cell_index, base (the child it waits for), f. The same with base the first node above that is in no chain."""
    now, k = written(links.withColumn("open", F.lit(True))), 0
    while True:
        above = now.select(F.col("cell_index").alias("base"), F.col("base").alias("base2"), F.col("f").alias("f2"))
        f = F.when(F.col("base2").isNull(), F.col("f")).otherwise(algebra.compose(F.col("f2"), F.col("f")))
        live, done = now.filter("open").join(above, "base", "left"), now.filter("NOT open")
        moved = live.select("cell_index", F.coalesce("base2", "base").alias("base"), f.alias("f"), F.col("base2").isNotNull().alias("open"))
        then = written(moved.unionByName(done))
        discard(now)
        now, k = then, k + 1
        left = now.filter("open").count()
        if not left:
            return now.drop("open")
        if k > last:
            raise flow.circle(left)


def _ends(active: DataFrame, chain: DataFrame, found: DataFrame, algebra) -> DataFrame:
    """What hands a value on: the lower end of each chain for its base, and all else that no chain node waits for."""
    inner = chain.select(F.col("cell_index").alias("down"), F.lit(True).alias("inside"))
    out = active.select("cell_index", "down", "pass").join(inner, "down", "left").filter("inside IS NULL").select("cell_index", "down", "pass")
    ends = out.join(found, "cell_index", "left")
    passed = F.when(F.col("base").isNull(), F.col("pass")).otherwise(algebra.compose(F.col("f"), F.col("pass")))
    return ends.select(F.coalesce("base", "cell_index").alias("cell_index"), "down", passed.alias("pass"))


def contract(edges: DataFrame, algebra=Strahler, name: str = "order") -> DataFrame:
    """cell_index and the node's value, by rake and compress."""
    need = edges.groupBy(F.col("down").alias("cell_index")).agg(F.count("*").alias("need")).filter("cell_index IS NOT NULL")
    start = edges.select("cell_index", "down").join(need, "cell_index", "left").select("cell_index", "down", F.coalesce("need", F.lit(0)).alias("need"), algebra.empty().alias("state"), algebra.identity().alias("pass"))
    active = written(start)
    last = flow.rounds(active)
    known, logs, before = [], [], None
    while True:
        n, ready, single = active.agg(F.count("*"), F.count_if(F.col("need") == 0), F.count_if(F.col("need") == 1)).first()
        if not n:
            break
        if not ready or n == before:
            raise flow.circle(n)
        before = n
        leaves = active.filter("need = 0").select("cell_index", algebra.value(F.col("state")).alias("value"))
        known.append(leaves)
        on = active.select("cell_index", "down", "pass")
        if single:
            chain = active.filter("need = 1").select("cell_index", algebra.of(F.col("state")).alias("own"))
            pairs = active.select(F.col("cell_index").alias("base"), F.col("down").alias("cell_index"), "pass").join(chain, "cell_index")
            links = written(pairs.select("cell_index", "base", algebra.compose(F.col("pass"), F.col("own")).alias("f")))
            found = _bases(links, algebra, last)
            discard(links)
            logs.append(found)
            on = written(_ends(active, chain, found, algebra))
        sent = on.filter("down IS NOT NULL").join(leaves, "cell_index")
        came = algebra.gather(sent.select(F.col("down").alias("cell_index"), algebra.apply(F.col("pass"), F.col("value")).alias("value")))
        branches = active.filter("need >= 2").select("cell_index", "need", "state").join(on, "cell_index").join(came, "cell_index", "left")
        state = F.when(F.col("came").isNull(), F.col("state")).otherwise(algebra.merge(F.col("state"), F.col("add")))
        then = written(branches.select("cell_index", "down", (F.col("need") - F.coalesce("came", F.lit(0))).alias("need"), state.alias("state"), "pass"))
        if single:
            discard(on)
        active = then
    values = edges.select("cell_index", F.lit(0).alias("value")).limit(0) if not known else reduce(DataFrame.unionByName, known)
    for found in reversed(logs):
        below = found.join(values.withColumnRenamed("cell_index", "base"), "base")
        values = written(values.unionByName(below.select("cell_index", algebra.apply(F.col("f"), F.col("value")).alias("value"))))
    return values.select("cell_index", F.col("value").cast("int").alias(name))
