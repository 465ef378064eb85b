"""Reaches: one for each subbasin, from the main way of its stream. All are aggregations and one pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import contract, flow
from .iterate import written

#: Constant columns of the reach table; fixed values.
CONSTANTS = {
    "main_side_slope": 0.5, "floodplain_side_slope": 0.2, "w_ratio": 5.0, "t0": 0.0, "d0": 0.0, "erodibility_factor": 0.1, "cover_factor": 0.2,
    "bc1": 0.55, "bc2": 1.1, "bc3": 0.21, "bc4": 0.35, "rk1": 1.71, "rk2": 50.0, "rk3": 0.36, "rk4": 2.0, "rs1": 1.0, "rs2": 0.05, "rs3": 0.5,
    "rs4": 0.05, "rs5": 0.05, "minFlow": 0.0, "k_chb": 0.0, "k_bank": 0.0, "bnk0": 0.0, "chs0": 0.0, "a_bnk": 0.2, "b_bnk": 0.05, "MSK_X": 0.0,
    "MSK_col": 0.0, "bank_PP_coef": 0.2, "bank_DP_coef": 0.05, "bank_PN_coef": 0.25, "bank_DN_coef": 1.0, "bank_Ero_frac": 0.5,
}
#: Roughness of the greatest and of the least stream order; fixed values.
MANNING = (0.04, 0.1)


def with_next(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Each cell's step down with both ends' subbasin, whether they are stream, elevation and accumulation."""
    keep = ("subbasin", "is_stream", "dem", "acc")
    low = cells.select(F.col("cell_index").alias("down"), *[F.col(c).alias(f"n_{c}") for c in keep])
    return edges.select("cell_index", "down", "dist").join(cells.select("cell_index", *keep), "cell_index").join(low, "down", "left")


def inlets(steps: DataFrame) -> DataFrame:
    """subbasin, inlet: where the stream of the greatest accumulation enters; in headwaters the stream cell of the
    least accumulation; without any stream cell the end. Ties go to the least cell."""
    enters = steps.filter("is_stream and n_is_stream and subbasin <> n_subbasin")
    main = enters.groupBy(F.col("n_subbasin").alias("subbasin")).agg(F.max(F.struct("acc", (-F.col("down")).alias("m"))).alias("b"))
    first = F.min(F.when(F.col("is_stream"), F.struct("acc", "cell_index")))
    end = F.max(F.struct("acc", (-F.col("cell_index")).alias("m")))
    head = steps.groupBy("subbasin").agg(F.coalesce(first["cell_index"], -end["m"]).alias("head"))
    return head.join(main, "subbasin", "left").select("subbasin", F.coalesce(-F.col("b.m"), "head").alias("inlet"))


def ways(steps: DataFrame, min_length: float, min_slope: float) -> DataFrame:
    """subbasin, inlet, length (from the inlet to the subbasin's end) and slope in percent (the mean of the steps' slopes, the
    step that leaves included, over one more than their number)."""
    inside = F.col("subbasin") == F.col("n_subbasin")
    step = F.when(F.col("down").isNotNull(), (F.col("dem") - F.col("n_dem")) / F.col("dist")).otherwise(0.0)
    own = steps.select(
        "cell_index", F.when(inside, F.col("down")).alias("down"), F.when(inside, F.col("dist")).otherwise(0.0).alias("length"),
        step.alias("fall"), F.col("down").isNotNull().cast("long").alias("n"),
    )
    sums = flow.jump(own, ["length", "fall", "n"])
    start = inlets(steps)
    found = start.join(sums, start["inlet"] == sums["cell_index"])
    slope = F.greatest(F.col("fall") / (F.col("n") + 1) * 100, F.lit(min_slope))
    return found.select("subbasin", "inlet", F.greatest("length", F.lit(min_length)).alias("length"), slope.alias("slope"))


def receiving(steps: DataFrame) -> DataFrame:
    """subbasin, receive: the subbasin that its outlet flows into, 0 if none. With watersheds of pour points all cells leave by the outlet."""
    out = steps.filter("n_subbasin is null or n_subbasin <> subbasin")
    best = out.groupBy("subbasin").agg(F.max(F.struct("acc", (-F.col("cell_index")).alias("m"), F.coalesce("n_subbasin", F.lit(0)).alias("receive"))).alias("b"))
    return best.select("subbasin", "b.receive")


def zonal_terms(cells: DataFrame, cell_ha: float) -> DataFrame:
    """Means over stream cells (width and depth 0.1 at least), elevations of the stream, contribution area: one aggregation.
    A subbasin without stream cells has width and depth 0.1, and the velocity and elevations of all its cells."""
    on = lambda c: F.when(F.col("is_stream"), F.col(c))
    either = lambda f, c: F.coalesce(f(on(c)), f(F.col(c)))
    return cells.groupBy("subbasin").agg(
        F.greatest(F.avg(on("width")), F.lit(0.1)).alias("width"), F.greatest(F.avg(on("depth")), F.lit(0.1)).alias("depth"),
        either(F.avg, "velocity").alias("velocity"), either(F.max, "dem").alias("max_elevation"), either(F.min, "dem").alias("min_elevation"),
        either(F.avg, "dem").alias("ave_elevation"), (F.max("acc") * cell_ha).alias("contribution_area"),
    )


def orders(receive: DataFrame) -> DataFrame:
    """Strahler order of each reach."""
    e = receive.select(F.col("subbasin").alias("cell_index"), F.when(F.col("receive") > 0, F.col("receive")).alias("down"))
    return contract.contract(e).select(F.col("cell_index").alias("subbasin"), F.col("order").alias("stream_order"))


def stream_orders(steps: DataFrame) -> DataFrame:
    """cell_index, order: Strahler order of each stream cell."""
    on = steps.filter("is_stream").select("cell_index", F.when(F.col("n_is_stream"), F.col("down")).alias("down"))
    return contract.contract(on)


def manning(steps: DataFrame, order: DataFrame) -> DataFrame:
    """subbasin, manning: the mean roughness of the runs of one order along the main way, from the inlet to the subbasin's end.

    A run's roughness lies between that of the least order and that of the greatest one of all stream cells; cells without a
    stream have the least order. A run begins at the inlet, and at each cell whose order is not that of the cell before: so
    its terms are sums over the steps of the way, which pointer doubling adds up."""
    ends = order.agg(F.min("order").alias("lo"), F.max("order").alias("hi"))  # one row
    low, high = MANNING
    of = lambda c: F.lit(high) - (high - low) * F.coalesce(F.try_divide(F.col(c) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    cells = steps.select("cell_index", "subbasin", "n_subbasin", "down").join(order, "cell_index", "left").crossJoin(F.broadcast(ends))
    own = written(cells.withColumn("order", F.coalesce("order", "lo")))
    below = own.select(F.col("cell_index").alias("down"), F.col("order").alias("n_order"))
    way = own.join(below, "down", "left").withColumn("inside", F.coalesce(F.col("subbasin") == F.col("n_subbasin"), F.lit(False)))
    turn = F.col("inside") & (F.col("order") != F.col("n_order"))
    sums = flow.jump(way.select("cell_index", F.when(F.col("inside"), F.col("down")).alias("down"), F.when(turn, of("n_order")).otherwise(0.0).alias("rough"), turn.cast("long").alias("runs")), ["rough", "runs"])
    first = own.select("cell_index", of("order").alias("first"))
    start = inlets(steps).withColumnRenamed("inlet", "cell_index").join(first, "cell_index").join(sums, "cell_index")
    mean = (F.col("first") + F.col("rough")) / (F.col("runs") + 1)
    return start.select("subbasin", F.least(F.greatest(mean, F.lit(low)), F.lit(high)).alias("manning"))


def reach_parameter(cells: DataFrame, edges: DataFrame, cell_ha: float, min_length: float, min_slope: float = 0.01) -> DataFrame:
    """The reach table: ids, terms of the main way, zonal terms, order, roughness, receiving reach and constants. cells: cell_index, subbasin, is_stream, dem, acc, width, depth, velocity."""
    steps = written(with_next(edges, cells))
    receive = receiving(steps)
    parts = ways(steps, min_length, min_slope).join(zonal_terms(cells, cell_ha), "subbasin").join(receive, "subbasin")
    parts = parts.join(orders(receive), "subbasin", "left").fillna({"stream_order": 1})
    parts = parts.join(manning(steps, stream_orders(steps)), "subbasin", "left").fillna({"manning": MANNING[1]})
    ids = [F.col("subbasin").alias(n) for n in ("reach_id", "subbasin_id", "outlet_id")]
    own = ("length", "width", "depth", "slope", "stream_order", "manning", "velocity", "max_elevation", "min_elevation", "ave_elevation", "contribution_area")
    return parts.select(*ids, *own, F.col("receive").alias("receive_reach_id"), *[F.lit(v).alias(k) for k, v in CONSTANTS.items()])
