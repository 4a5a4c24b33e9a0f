"""Queries of alignment, consensus, chips and rays."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terraloom.functions import geometry as G
from terraloom.operators import alignment, consensus, neighbourhood, rays
from terraloom.operators import chips as C
from terraloom.plans.inputs import table
from terraloom.plans.registry import query, rounded

# --- nearest neighbours and point clouds ------------------------------------------------------------------------------

_CUSTOMERS = "c AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, c_custkey / 10.0::DOUBLE AS y, c_nationkey * 4.0::DOUBLE AS z FROM customer)"


def customers(spark, d):
    """A point for each customer, in a strip that grows with their number."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") / 10.0).alias("y"), (F.col("c_nationkey") * 4.0).alias("z"))


@query(f"""WITH {_CUSTOMERS}, s AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, s_suppkey * 1.5::DOUBLE AS y, s_nationkey * 4.0::DOUBLE AS z FROM supplier),
d AS (SELECT s.id, c.id AS ref, sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) + (s.z - c.z) * (s.z - c.z)) AS d FROM s, c),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ref)::INT AS rank FROM d) SELECT id, rank, ref, round(d, 6) AS distance FROM r WHERE rank <= 5""")
def five_nearest(spark, d):
    """The five customers nearest to each supplier."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") * 1.5).alias("y"), (F.col("s_nationkey") * 4.0).alias("z"))
    return rounded(alignment.nearest_k(s, customers(spark, d), 8.0, 5), "distance")


#: What is planted: a turn about the three axes, and a shift.
_TURN, _SHIFT = (0.0004, -0.0003, 0.0005), (0.3, -0.25, 0.2)


def _turned(points):
    """points as they are before the planted transform (the inverse of a turn is its transpose), and the turn."""
    a, b, c = _TURN
    cx, sx, cy, sy, cz, sz = math.cos(a), math.sin(a), math.cos(b), math.sin(b), math.cos(c), math.sin(c)
    r = [[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx], [-sy, cy * sx, cy * cx]]
    off = [F.col(k) - s for k, s in zip("xyz", _SHIFT, strict=True)]
    return points.select("id", *(sum((off[j] * r[j][i] for j in range(3)), F.lit(0.0)).alias(k) for i, k in enumerate("xyz"))), r


@query(None)
def icp_transform(spark, d):
    """The transform that lays moved customers on where they were. Rows only: a loop; the planted one is checked in tests."""
    ref = customers(spark, d)
    source, _ = _turned(ref)
    rotation, shift, errors = alignment.icp(source, ref, 8.0, rounds=12, still=1e-6)
    return spark.createDataFrame([(*map(float, rotation.ravel()), *map(float, shift), errors[0], errors[-1], len(errors))], ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double, first_error double, error double, rounds int")


# --- rasters ----------------------------------------------------------------------------------------------------------

#: The source is planted so many columns and rows off, and so much lower.
_OFF = (0.6, -0.35, 5.0)
_HEIGHT = "(60 * sin({c} / 9.0) + 45 * cos({r} / 7.0 + {c} / 23.0))"
_TERRAIN = f"""g AS (SELECT l_suppkey AS col, l_partkey % 60 AS "row", avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY ALL),
ref AS (SELECT col, "row", {_HEIGHT.format(c="col", r='"row"')} + a / 10 AS v FROM g),
source AS (SELECT col, "row", {_HEIGHT.format(c=f"(col - {_OFF[0]})", r=f'("row" - {_OFF[1]})')} + b / 10 - {_OFF[2]} AS v FROM g)"""


def _strips(spark, d):
    """Two rasters of one hilly strip, a column for each supplier, with the tables' own roughness and holes."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("col"), (F.col("l_partkey") % 60).alias("row")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    height = lambda c, r: 60 * F.sin(c / 9.0) + 45 * F.cos(r / 7.0 + c / 23.0)
    col, row = F.col("col"), F.col("row")
    ref = g.select("col", "row", (height(col, row) + F.col("a") / 10).alias("v"))
    return ref, g.select("col", "row", (height(col - _OFF[0], row - _OFF[1]) + F.col("b") / 10 - _OFF[2]).alias("v"))


@query(f"""WITH {_TERRAIN}, n AS (SELECT a.col, a."row", a.v, e.v - w.v AS dx, s.v - n.v AS dy FROM ref a JOIN ref w ON w.col = a.col - 1 AND w."row" = a."row" JOIN ref e ON e.col = a.col + 1 AND e."row" = a."row"
  JOIN ref n ON n.col = a.col AND n."row" = a."row" - 1 JOIN ref s ON s.col = a.col AND s."row" = a."row" + 1),
t AS (SELECT col, "row", v, sqrt(dx * dx + dy * dy) / 6 AS t, degrees(atan2(-dx, dy)) AS az FROM n WHERE dx <> 0 OR dy <> 0),
b AS (SELECT floor((CASE WHEN az < 0 THEN az + 360 ELSE az END) / 5)::BIGINT AS bin, (t.v - source.v) / t AS value FROM t JOIN source ON source.col = t.col AND source."row" = t."row" WHERE degrees(atan(t)) >= 1)
SELECT bin, (bin + 0.5) * 5 AS aspect, round(avg(value), 5) AS value, count(*) AS n FROM b GROUP BY bin""")
def nuth_bins(spark, d):
    """What the first round of the co-registration fits: differences over tangents by aspect."""
    ref, source = _strips(spark, d)
    found = alignment.aspect_bins(ref, source, neighbourhood.slope_aspect(ref, 3.0))
    return rounded(found.select("bin", "aspect", "value", "n"), "value", digits=5)


@query(None)
def nuth_shift(spark, d):
    """The shift of the second strip against the first. Rows only: a loop; the planted one is checked in tests."""
    ref, source = _strips(spark, d)
    return spark.createDataFrame([alignment.coregister(ref, source, 3.0)], "dx double, dy double, dz double, rounds int")


# --- matches ----------------------------------------------------------------------------------------------------------

_MATCHES = """m AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, c_custkey / 10.0::DOUBLE AS y,
  20 + (c_acctbal - floor(c_acctbal)) + CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 4 THEN 25 ELSE 0 END AS dx, -4 + c_nationkey / 25.0::DOUBLE AS dy FROM customer)"""


def _matches(spark, d):
    """Matches at customers' places; a few have another disparity."""
    off = F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") < 4), 25).otherwise(0)
    dx = 20 + (F.col("c_acctbal") - F.floor("c_acctbal")) + off
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") / 10.0).alias("y"), dx.alias("dx"), (-4 + F.col("c_nationkey") / 25.0).alias("dy"))


@query(f"""WITH {_MATCHES}, d AS (SELECT a.id, b.id AS ref, b.dx, b.dy, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS k FROM m a JOIN m b ON a.id <> b.id),
n AS (SELECT * FROM d WHERE k <= 10), u AS (SELECT id, sum(dx) / sqrt(sum(dx) * sum(dx) + sum(dy) * sum(dy)) AS ux, sum(dy) / sqrt(sum(dx) * sum(dx) + sum(dy) * sum(dy)) AS uy FROM n GROUP BY id),
p AS (SELECT n.id, avg(n.dx * ux + n.dy * uy) AS mean, stddev_pop(n.dx * ux + n.dy * uy) AS spread FROM n JOIN u ON u.id = n.id GROUP BY n.id)
SELECT m.id, round(abs(m.dx * ux + m.dy * uy - mean) / spread, 5) AS score FROM m JOIN u ON u.id = m.id JOIN p ON p.id = m.id""")
def local_deviation(spark, d):
    m = _matches(spark, d)
    return rounded(alignment.local_deviation(m, alignment._others(m, m, 6.0, 10)), "score", digits=5)


@query(None)
def deviation_filter(spark, d):
    """Matches whose disparity agrees with that of their neighbours. Rows only: rounds; held against a sequential loop in tests."""
    return alignment.deviation_filter(_matches(spark, d), 6.0)


# --- consensus --------------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag AS flag, count(*) AS points, CASE WHEN l_returnflag <> 'R' THEN count(*) ELSE 0 END AS inliers, 0.02::DOUBLE AS slope_x, -0.03::DOUBLE AS slope_y, 7.0::DOUBLE AS height FROM lineitem GROUP BY l_returnflag""")
def bathy_plane(spark, d):
    """The plane of the water's surface among points of which about a third are off it, and its inliers; what is planted is known exactly."""
    x, y = F.col("l_extendedprice") / 1000, F.col("l_quantity")
    off = F.when(F.col("l_returnflag") == "R", 3 + F.col("l_discount") * 50).otherwise(0.0)
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag", x.alias("x"), y.alias("y"), (7 + 0.02 * x - 0.03 * y + off).alias("z"))
    model, _ = consensus.consensus(t, consensus.Plane, "id", 0.01)
    nx, ny, nz, at = map(float, model)
    fine = consensus.Plane.error(model) <= 0.01
    out = t.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("points"), F.count_if(fine).alias("inliers"))
    return rounded(out.withColumns({"slope_x": F.lit(-nx / nz), "slope_y": F.lit(-ny / nz), "height": F.lit(at / nz)}), "slope_x", "slope_y", "height")


@query("""SELECT o_orderstatus = 'P' AS wrong, count(*) AS pairs, count(*) FILTER (WHERE o_orderstatus <> 'P') AS inliers FROM orders GROUP BY o_orderstatus = 'P'""")
def image_affine(spark, d):
    """The affine transform between two images from matches of which some are wrong, and its inliers."""
    x, y = F.col("o_totalprice") / 1000, F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date")) / 10.0
    wrong = F.col("o_orderstatus") == "P"
    off = F.when(wrong, 5.0 + F.col("o_custkey") % 90).otherwise(0.0)
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), wrong.alias("wrong"), x.alias("x"), y.alias("y"), (1.01 * x - 0.02 * y + 12 + off).alias("u"), (0.03 * x + 0.98 * y - 7).alias("v"))
    model, _ = consensus.consensus(t, consensus.Affine, "id", 0.5)
    return t.groupBy("wrong").agg(F.count("*").alias("pairs"), F.count_if(consensus.Affine.error(model) <= 0.5).alias("inliers"))


# --- chips and rays ---------------------------------------------------------------------------------------------------


@query("""SELECT floor(l_extendedprice / 1000 / 20)::BIGINT AS tile_x, floor(l_quantity / 20)::BIGINT AS tile_y, count(*) AS n, TRUE AS small, TRUE AS few FROM lineitem GROUP BY ALL""")
def point_chips(spark, d):
    """Tiles of the cloud cut into chips of at most 128 points: points, whether all chips are small enough, and whether they hold 64 or more on average, as halving leaves them."""
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("y"))
    chip = C.chips(t, 20.0).groupBy("tile_x", "tile_y", "chip").agg(F.count("*").alias("n"))
    return chip.groupBy("tile_x", "tile_y").agg(F.sum("n").alias("n"), F.every(F.col("n") <= 128).alias("small"), (F.count("*") <= F.greatest(F.lit(1.0), F.sum("n") / 64) + 4 * F.floor(F.sum("n") / C.TASK_POINTS)).alias("few"))


_RAYS = """r0 AS (SELECT l_orderkey AS track, l_suppkey * 1.0::DOUBLE AS cx, l_linenumber * 40.0::DOUBLE AS cy, 300.0::DOUBLE + l_discount * 100 AS cz, l_orderkey / 100.0::DOUBLE AS px, l_orderkey % 50 * 1.0::DOUBLE AS py, l_tax AS noise FROM lineitem),
r1 AS (SELECT track, cx, cy, cz, px + noise - cx AS dx, py - cy AS dy, -20.0 - cz AS dz FROM r0),
r AS (SELECT track, cx, cy, cz, dx / l AS dx, dy / l AS dy, dz / l AS dz FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS l FROM r1))"""


@query(f"""WITH {_RAYS}, o AS (SELECT track, min(cx) AS ox, min(cy) AS oy FROM r GROUP BY track),
s AS (SELECT r.track, count(*) AS n, sum(1 - dx * dx) AS a, sum(-dx * dy) AS b, sum(-dx * dz) AS c, sum(1 - dy * dy) AS e, sum(-dy * dz) AS f, sum(1 - dz * dz) AS i,
  sum((1 - dx * dx) * (cx - ox) - dx * dy * (cy - oy) - dx * dz * cz) AS u, sum(-dx * dy * (cx - ox) + (1 - dy * dy) * (cy - oy) - dy * dz * cz) AS v, sum(-dx * dz * (cx - ox) - dy * dz * (cy - oy) + (1 - dz * dz) * cz) AS w, any_value(ox) AS ox, any_value(oy) AS oy FROM r JOIN o ON o.track = r.track GROUP BY r.track),
t AS (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM s),
p AS (SELECT track, n, CASE WHEN n > 1 AND det > 1e-12 * n * n * n THEN (u * (e * i - f * f) - b * (v * i - f * w) + c * (v * f - e * w)) / det + ox END AS x,
  CASE WHEN n > 1 AND det > 1e-12 * n * n * n THEN (a * (v * i - f * w) - u * (b * i - f * c) + c * (b * w - v * c)) / det + oy END AS y,
  CASE WHEN n > 1 AND det > 1e-12 * n * n * n THEN (a * (e * w - v * f) - b * (b * w - v * c) + u * (b * f - e * c)) / det END AS z FROM t),
d AS (SELECT p.track, x - cx AS gx, y - cy AS gy, z - cz AS gz, dx, dy, dz FROM r JOIN p ON p.track = r.track),
q AS (SELECT track, avg(sqrt(pow(gx - k * dx, 2) + pow(gy - k * dy, 2) + pow(gz - k * dz, 2))) AS error FROM (SELECT *, gx * dx + gy * dy + gz * dz AS k FROM d) GROUP BY track)
SELECT p.track, round(x, 3) + 0.0::DOUBLE AS x, round(y, 3) + 0.0::DOUBLE AS y, round(z, 3) + 0.0::DOUBLE AS z, round(error, 3) + 0.0::DOUBLE AS error, n FROM p JOIN q ON q.track = p.track""")
def ray_points(spark, d):
    """A point for each order from the rays of all its items."""
    t = table(spark, d, "lineitem")
    c = {"cx": F.col("l_suppkey") * 1.0, "cy": F.col("l_linenumber") * 40.0, "cz": 300.0 + F.col("l_discount") * 100}
    to = {"dx": F.col("l_orderkey") / 100.0 + F.col("l_tax") - c["cx"], "dy": F.col("l_orderkey") % 50 * 1.0 - c["cy"], "dz": -20.0 - c["cz"]}
    return rounded(rays.triangulate(t.select(F.col("l_orderkey").alias("track"), *(v.alias(k) for k, v in (c | to).items())), "track"), "x", "y", "z", "error", digits=3)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS cx, l_tax * 100 AS cy, l_discount * 10 AS dx FROM lineitem),
s AS (SELECT *, dx / sqrt(dx * dx + 1) AS sx, -1 / sqrt(dx * dx + 1) AS sz FROM r)
SELECT l_orderkey, l_linenumber, round(cx + 50 * dx, 6) AS px, round(cy, 6) AS py, round(sx / 1.34, 6) AS rx, round(-sqrt(1 - pow(sx / 1.34, 2)), 6) AS rz FROM s""")
def bent_rays(spark, d):
    """Rays from 50 above the water into it: where they meet it and how they go on."""
    p, r = G.refract([F.col("l_quantity"), F.col("l_tax") * 100, F.lit(50.0)], [F.col("l_discount") * 10, F.lit(0.0), F.lit(-1.0)], (0.0, 0.0, 2.0), 0.0, 1.34)
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p[0].alias("px"), p[1].alias("py"), r[0].alias("rx"), r[2].alias("rz")), "px", "py", "rx", "rz")
