"""Kernels on tiles and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delineation, distance, flood, raster, rings, structures
from ..sources.views import CELLS, COLS, cells, table
from .drainage import STEPS
from .registry import query


#: Structures of three by four cells; each cell's structure, of which the lowest cell is the outlet.
ZONES = """zoned AS (SELECT *, CASE WHEN r % 7 < 3 AND c % 9 < 4 THEN (r // 7) * 15 + c // 9 + 1 ELSE 0 END AS structure FROM cells),
 lowest AS (SELECT structure, arg_min(cell_index, [dem, -cell_index]) AS cell_index FROM zoned WHERE structure > 0 GROUP BY structure),
 wet AS (SELECT z.*, l.cell_index IS NOT NULL AS outlet FROM zoned z LEFT JOIN lowest l ON z.cell_index = l.cell_index)"""
BESIDE = """nbr AS (SELECT a.cell_index AS a, b.cell_index AS b, s.k, b.dem AS z, a.dem AS za, b.structure AS sb, a.structure AS sa, b.outlet
 FROM wet a, steps s, wet b WHERE b.r = a.r + s.dy AND b.c = a.c + s.dx),
 sides AS (SELECT a, count(*) < 8 AS open, count(*) FILTER (z < za) = 0 AS pit FROM nbr GROUP BY a)"""
LEVELS = """levels(cell_index, f) USING KEY (cell_index) AS (SELECT w.cell_index, w.dem FROM wet w JOIN sides ON w.cell_index = a WHERE {seed}
 UNION SELECT n.b, min(CASE WHEN {free} THEN l.f + 0.001 ELSE greatest(n.z, l.f + 0.001) END) AS f FROM levels l JOIN nbr n ON n.a = l.cell_index
 LEFT JOIN recurring.levels k ON k.cell_index = n.b WHERE {way} GROUP BY n.b, k.f
 HAVING k.f IS NULL OR min(CASE WHEN {free} THEN l.f + 0.001 ELSE greatest(n.z, l.f + 0.001) END) < k.f)"""
MAY = "(n.sb = 0 OR n.sb = n.sa OR n.outlet)"
FLOOD = LEVELS.format(seed="open AND (pit OR structure > 0)", free="n.outlet", way=MAY)
#: The same flood without structures.
PLAIN = LEVELS.format(seed="open AND pit", free="FALSE", way="TRUE")
CODES = """codes AS (SELECT n.b AS cell_index, arg_min(1 << ((n.k + 4) % 8), [l.f, n.a]) AS code, arg_min(n.a, [l.f, n.a]) AS down FROM nbr n
 JOIN levels l ON l.cell_index = n.a JOIN levels o ON o.cell_index = n.b WHERE {way} AND NOT (o.f = n.z AND n.b IN (SELECT a FROM sides JOIN wet w ON w.cell_index = a WHERE {seed})) GROUP BY n.b)"""


def zoned_cells(spark, sf_dir):
    """The cells with structures of three by four cells."""
    inside = (F.col("r") % 7 < 3) & (F.col("c") % 9 < 4)
    return cells(spark, sf_dir).withColumn("structure", F.when(inside, F.floor(F.col("r") / 7) * 15 + F.floor(F.col("c") / 9) + 1).otherwise(0).cast("long"))


def wetlands(spark, sf_dir):
    """The cells with structures, their lowest cells as outlets."""
    zoned = zoned_cells(spark, sf_dir)
    low = structures.lowest_outlets(zoned.filter("structure > 0").select(F.col("structure").alias("id"), "cell_index"), cells(spark, sf_dir))
    return zoned.join(low.select("cell_index", F.lit(True).alias("outlet")), "cell_index", "left").fillna(False, ["outlet"])


@query(
    "SELECT r, c, round(f, 3) AS filled, CAST(coalesce(code, 0) AS INTEGER) AS code FROM wet LEFT JOIN levels USING (cell_index) LEFT JOIN codes USING (cell_index)",
    CELLS, STEPS, ZONES, BESIDE, FLOOD, CODES.format(way=MAY, seed="open AND (pit OR structure > 0)"),
)
def priority_flood(spark, sf_dir):
    """Flow directions over the whole grid by a flood that enters structures at their outlets."""
    return flood.route(wetlands(spark, sf_dir), 64).select("r", "c", F.round("filled", 3).alias("filled"), "code")


@query(
    "SELECT r, c, round(f, 3) AS filled, round(f - dem, 3) AS raised FROM wet JOIN levels USING (cell_index)",
    CELLS, STEPS, ZONES, BESIDE, LEVELS.format(seed="open", free="FALSE", way="TRUE"),
)
def fill_depressions(spark, sf_dir):
    """How much the fill of the whole grid, tile by tile with their rims, raises each cell; flats rise by 0.001 a cell."""
    filled = flood.fill_depressions(cells(spark, sf_dir), 64, 0.001)
    return filled.select("r", "c", F.round("filled", 3).alias("filled"), F.round(F.col("filled") - F.col("dem"), 3).alias("raised"))


@query(
    """SELECT structure AS id, cell_index FROM (SELECT w.structure, w.cell_index, arg_min(x.structure, t.n) FILTER (x.structure > 0) AS met FROM wet w JOIN trail t ON w.cell_index = t.cell_index
    LEFT JOIN wet x ON x.cell_index = t.pos WHERE w.structure > 0 GROUP BY w.structure, w.cell_index) WHERE met IS NULL OR met <> structure""",
    CELLS, STEPS, ZONES, BESIDE, PLAIN, CODES.format(way="TRUE", seed="open AND pit"),
    """trail AS (SELECT cell_index, down AS pos, 1 AS n FROM wet LEFT JOIN codes USING (cell_index) UNION ALL
    SELECT t.cell_index, d.down, t.n + 1 FROM trail t JOIN wet x ON x.cell_index = t.pos JOIN codes d ON d.cell_index = t.pos WHERE x.structure = 0)""",
)
def flood_outlets(spark, sf_dir):
    """Outlets of structures by the origin of the flood: crossings whose way does not come back first."""
    c = zoned_cells(spark, sf_dir)
    codes = flood.route(c.withColumn("structure", F.lit(0)).withColumn("outlet", F.lit(False)), 64)
    return flood.flood_outlets(flood.edges_of(codes, COLS), c.filter("structure > 0").select("cell_index", F.col("structure").alias("id")))


def squares(spark, sf_dir):
    """A square for each supplier, whose corners lie between cell centres."""
    x, y, d = F.col("s_suppkey") * 37 % 1000 * 1.0, F.col("s_suppkey") * 91 % 1000 * 1.0, F.col("s_suppkey") % 5 * 10 + 20.0
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(corner(x, y), corner(x + d, y), corner(x + d, y + d), corner(x, y + d)).alias("ring"))


@query(
    """SELECT s_suppkey AS id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM (SELECT s_suppkey, s_suppkey * 37 % 1000 AS x, s_suppkey * 91 % 1000 AS y, s_suppkey % 5 * 10 + 20 AS d FROM supplier), (SELECT unnest(range(0, 110)) AS r), (SELECT unnest(range(0, 110)) AS c)
    WHERE r * 10 + 5 >= y AND r * 10 + 5 < y + d AND c * 10 + 5 >= x AND c * 10 + 5 < x + d"""
)
def rasterise_polygons(spark, sf_dir):
    return raster.rasterise(squares(spark, sf_dir), 10.0)


@query("SELECT s_suppkey AS id, CAST((s_suppkey % 5 * 10 + 20) * (s_suppkey % 5 * 10 + 20) AS DOUBLE) AS area FROM supplier")
def polygon_areas(spark, sf_dir):
    return squares(spark, sf_dir).select("id", raster.polygon_area().alias("area"))


@query(
    "SELECT a.cell_index, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))::BIGINT AS d2 FROM cells a, (SELECT r, c FROM cells WHERE landuse = 5 AND soil = 'P') b GROUP BY a.cell_index",
    CELLS,
)
def distance_to_land(spark, sf_dir):
    """Squared distance of every cell to the nearest cell of a kind, at any radius."""
    c = cells(spark, sf_dir)
    found = distance.distance_to_set(c, c.filter("landuse = 5 and soil = 'P'"))
    return found.select((F.col("r") * COLS + F.col("c")).alias("cell_index"), "d2")


def trails(spark, sf_dir):
    """A line of three points for each supplier."""
    x, y, d = F.col("s_suppkey") * 37 % 1000 * 1.0, F.col("s_suppkey") * 91 % 1000 * 1.0, F.col("s_suppkey") % 7 * 30 - 80.0
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(at(x, y), at(x + d, y + 140), at(x + 90, y + d)).alias("line"))


#: The cells of segments from (x1, y1) to (x2, y2), by their number along the segment.
PASSED = """ends AS (SELECT id, floor(y1 / 10) AS r, floor(x1 / 10) AS c, floor(y2 / 10) - floor(y1 / 10) AS dr, floor(x2 / 10) - floor(x1 / 10) AS dc FROM seg),
 along AS (SELECT *, greatest(abs(dr), abs(dc)) AS n, unnest(range(0, CAST(greatest(abs(dr), abs(dc)) AS BIGINT) + 1)) AS i FROM ends),
 passed AS (SELECT DISTINCT id, CAST(r + CASE WHEN n = 0 THEN 0 ELSE sign(dr) * floor((2 * i * abs(dr) + n) / (2 * n)) END AS INTEGER) AS r,
 CAST(c + CASE WHEN n = 0 THEN 0 ELSE sign(dc) * floor((2 * i * abs(dc) + n) / (2 * n)) END AS INTEGER) AS c FROM along)"""
TRAILS = """trail AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 1000)::DOUBLE AS x, (s_suppkey * 91 % 1000)::DOUBLE AS y, (s_suppkey % 7 * 30 - 80)::DOUBLE AS d FROM supplier),
 seg AS (SELECT id, x AS x1, y AS y1, x + d AS x2, y + 140 AS y2 FROM trail UNION ALL SELECT id, x + d, y + 140, x + 90, y + d FROM trail)"""
SQUARES = """box AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 1000)::DOUBLE AS x, (s_suppkey * 91 % 1000)::DOUBLE AS y, (s_suppkey % 5 * 10 + 20)::DOUBLE AS d FROM supplier),
 seg AS (SELECT id, x AS x1, y AS y1, x + d AS x2, y AS y2 FROM box UNION ALL SELECT id, x + d, y, x + d, y + d FROM box
 UNION ALL SELECT id, x + d, y + d, x, y + d FROM box UNION ALL SELECT id, x, y + d, x, y FROM box)"""


@query("SELECT id, r, c FROM passed", TRAILS, PASSED)
def rasterise_lines(spark, sf_dir):
    """The cells that lines pass."""
    return raster.rasterise_lines(trails(spark, sf_dir), 10.0)


@query("SELECT f.a, p.id AS b, count(*) AS n FROM passed p JOIN (SELECT r, c, min(id) AS a FROM passed GROUP BY r, c) f USING (r, c) WHERE p.id <> f.a GROUP BY f.a, p.id", SQUARES, PASSED)
def border_conflicts(spark, sf_dir):
    """Polygons whose edges pass cells that an earlier polygon's edge owns."""
    return raster.border_conflicts(squares(spark, sf_dir), 10.0)


@query(
    """SELECT r, c, id, border FROM (SELECT r, c, min(id) AS id, TRUE AS border FROM passed GROUP BY r, c UNION ALL
    SELECT i.r, i.c, min(i.id), FALSE FROM (SELECT id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM box, (SELECT unnest(range(0, 110)) AS r), (SELECT unnest(range(0, 110)) AS c)
    WHERE r * 10 + 5 >= y AND r * 10 + 5 < y + d AND c * 10 + 5 >= x AND c * 10 + 5 < x + d) i WHERE (i.r, i.c) NOT IN (SELECT (r, c) FROM passed) GROUP BY i.r, i.c)""",
    SQUARES, PASSED,
)
def bordered_raster(spark, sf_dir):
    """Polygons with their border cells, which their owners keep from what lies over them."""
    return raster.bordered(squares(spark, sf_dir), 10.0)


#: Sides of cells to other regions as edges from corner to corner, each with the next one, and those that each leads to.
EDGES = """sideof(k, dx, dy, d, sr, sc, er, ec) AS (VALUES (7, 0, -1, 0, 0, 0, 0, 1), (1, 1, 0, 1, 0, 1, 1, 1), (3, 0, 1, 2, 1, 1, 1, 0), (5, -1, 0, 3, 1, 0, 0, 0)),
 tied AS (SELECT a.cell_index AS a, b.cell_index AS b FROM cells a, steps s, cells b WHERE b.r = a.r + s.dy AND b.c = a.c + s.dx AND a.texture = b.texture),
 near AS (SELECT cell_index AS a, cell_index AS b FROM cells UNION SELECT j.a, s.b FROM near j JOIN tied s ON j.b = s.a),
 region AS (SELECT a AS cell_index, min(b) AS region FROM near GROUP BY a),
 grid AS (SELECT r, c, region FROM cells JOIN region USING (cell_index)),
 edge AS (SELECT g.region, (g.r + sr) * 129 + g.c + sc AS start, (g.r + er) * 129 + g.c + ec AS stop, d FROM grid g CROSS JOIN sideof s LEFT JOIN grid h ON h.r = g.r + dy AND h.c = g.c + dx WHERE h.region IS DISTINCT FROM g.region),
 onward AS (SELECT e.start * 4 + e.d AS e, e.region, e.start, e.stop, e.d, arg_min(n.start * 4 + n.d, (n.d - e.d + 5) % 4) AS next, arg_min(n.d, (n.d - e.d + 5) % 4) AS turn
 FROM edge e JOIN edge n ON n.start = e.stop AND n.region = e.region GROUP BY ALL),
 around AS (SELECT e, next AS pos FROM onward UNION SELECT a.e, o.next FROM around a JOIN onward o ON a.pos = o.e),
 ring AS (SELECT e, min(pos) AS ring FROM around GROUP BY e)"""


@query(
    """SELECT region, ring, sum(CAST(turn <> d AS INTEGER))::BIGINT AS n_corners, sum((start % 129) * (stop // 129) - (stop % 129) * (start // 129)) / 2 AS area FROM onward JOIN ring USING (e) GROUP BY region, ring""",
    CELLS, STEPS, EDGES,
)
def region_rings(spark, sf_dir):
    """The rings of the raster's regions, with their corners and areas; holes are negative."""
    c = cells(spark, sf_dir)
    own = c.select("r", "c", "cell_index").join(delineation.regions(c, "texture"), "cell_index")
    return rings.ring_areas(rings.rings(own, "region", COLS), COLS)
