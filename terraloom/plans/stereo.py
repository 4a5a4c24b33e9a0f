"""Queries over matched rasters, blends by border weights and limited pairings, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions import geometry as G
from terraloom.operators import joins, mosaic, neighbourhood, stereo
from terraloom.plans.inputs import CELLS, RASTER, cells, raster, table
from terraloom.plans.registry import _BOXES, query, rounded


def _sides(spark, d):
    """The raster, and the same moved by two columns and a row with values changed a little."""
    left = raster(spark, d)
    moved = F.col("v") + (F.col("col") * 7 + F.col("row") * 3) % 5
    return left, left.select((F.col("col") + 2).alias("col"), (F.col("row") + 1).alias("row"), moved.alias("v"))


_SIDES = RASTER + """, l AS (SELECT * FROM raster WHERE v IS NOT NULL), r AS (SELECT col + 2 AS col, "row" + 1 AS "row", v + (col * 7 + "row" * 3) % 5 AS v FROM l)"""


def _places(a: str, b: str, dx: int, dy: int) -> str:
    """All places of the squares of a and b at every shift: the cell, the shift, the place and both values."""
    return f"""(SELECT a.col - x AS col, a."row" - y AS "row", dx, dy, x, y, a.v AS l, b.v AS r FROM {a} a CROSS JOIN (SELECT unnest(range(-{dx}, {dx} + 1)) AS dx) CROSS JOIN (SELECT unnest(range(-{dy}, {dy} + 1)) AS dy)
  JOIN {b} b ON b.col = a.col + dx AND b."row" = a."row" + dy CROSS JOIN (SELECT unnest(range(-1, 2)) AS x) CROSS JOIN (SELECT unnest(range(-1, 2)) AS y))"""


_FIRST = 'row_number() OVER (PARTITION BY col, "row" ORDER BY cost, dy, dx)'


@query(f"""WITH {_SIDES}, c AS (SELECT col, "row", dx, dy, sum(abs(l - r)) AS cost FROM {_places("l", "r", 3, 2)} GROUP BY ALL HAVING count(*) = 9)
SELECT col, "row", dx, dy, cost::DOUBLE AS cost FROM (SELECT *, {_FIRST} AS n FROM c) WHERE n = 1""")
def block_matches(spark, d):
    """Shifts of the least absolute difference."""
    return stereo.block_match(*_sides(spark, d), (-3, 3, -2, 2), 1, "absolute", tile=64).select("col", "row", "dx", "dy", "cost")


_ZNCC = f"""z AS (SELECT col, "row", dx, dy, 9 * sum(l * r) - sum(l) * sum(r) AS lr, 9 * sum(l * l) - sum(l) * sum(l) AS ll, 9 * sum(r * r) - sum(r) * sum(r) AS rr FROM {_places("l", "r", 3, 2)} GROUP BY ALL HAVING count(*) = 9),
c AS (SELECT col, "row", dx, dy, -lr / sqrt(ll * rr) AS cost FROM z WHERE ll > 0 AND rr > 0), m AS (SELECT * EXCLUDE (n) FROM (SELECT *, {_FIRST} AS n FROM c) WHERE n = 1)"""


@query(f"""WITH {_SIDES}, {_ZNCC}, b AS (SELECT m.col, m."row", m.dx, m.dy, m.cost, max(CASE WHEN c.dx = m.dx - 1 AND c.dy = m.dy THEN c.cost END) AS bx, max(CASE WHEN c.dx = m.dx + 1 AND c.dy = m.dy THEN c.cost END) AS ax,
  max(CASE WHEN c.dy = m.dy - 1 AND c.dx = m.dx THEN c.cost END) AS yb, max(CASE WHEN c.dy = m.dy + 1 AND c.dx = m.dx THEN c.cost END) AS ya FROM m JOIN c ON c.col = m.col AND c."row" = m."row" GROUP BY ALL)
SELECT col, "row", round(dx + CASE WHEN bx + ax IS NULL OR bx - 2 * cost + ax = 0 THEN 0 ELSE greatest(-1, least(1, (bx - ax) / (2 * (bx - 2 * cost + ax)))) END, 6) + 0.0 AS x,
round(dy + CASE WHEN yb + ya IS NULL OR yb - 2 * cost + ya = 0 THEN 0 ELSE greatest(-1, least(1, (yb - ya) / (2 * (yb - 2 * cost + ya)))) END, 6) + 0.0 AS y,
round(coalesce(bx - 2 * cost + ax, 0), 6) + 0.0 AS curvature_x, round(coalesce(yb - 2 * cost + ya, 0), 6) + 0.0 AS curvature_y FROM b""")
def refined_matches(spark, d):
    """Shifts of the best correlation, refined below a cell."""
    found = stereo.refined(stereo.block_match(*_sides(spark, d), (-3, 3, -2, 2), 1, "zncc", tile=64))
    return rounded(found.select("col", "row", "x", "y", "curvature_x", "curvature_y"), "x", "y", "curvature_x", "curvature_y")


@query(f"""WITH {_SIDES}, {_ZNCC}, o AS (SELECT m.col, m."row", -m.cost AS score, max(CASE WHEN far THEN -c.cost END) AS second, avg(CASE WHEN far THEN -c.cost END) AS mean, stddev_pop(CASE WHEN far THEN -c.cost END) AS sd
  FROM m JOIN (SELECT c.*, abs(c.dx - m.dx) > 1 OR abs(c.dy - m.dy) > 1 AS far FROM c JOIN m ON m.col = c.col AND m."row" = c."row") c ON c.col = m.col AND c."row" = m."row" GROUP BY ALL)
SELECT col, "row", round(score, 6) + 0.0 AS score, round(CASE WHEN score <= 0 THEN 1 WHEN second IS NULL THEN 0 ELSE least(1, greatest(0, second) / score) END, 6) AS peak_ratio,
round(CASE WHEN sd > 1e-9 THEN greatest(0, (score - mean) / sd) ELSE 0 END, 4) AS snr FROM o""")
def match_quality(spark, d):
    """How unique the best correlations are, and how far they rise above the others."""
    found = stereo.peak_quality(stereo.block_match(*_sides(spark, d), (-3, 3, -2, 2), 1, "zncc", tile=64, apart=1))
    found = found.withColumn("snr", F.when(F.col("others_std") > 1e-9, F.col("snr")).otherwise(0.0))
    return rounded(rounded(found.select("col", "row", "score", "peak_ratio", "snr"), "score", "peak_ratio"), "snr", digits=4)


def _census(a: str, b: str) -> str:
    p = _places(a, b, 3, 2)
    return f"""(SELECT q.col, q."row", q.dx, q.dy, count_if((q.l > m.l) <> (q.r > m.r)) AS cost FROM {p} q JOIN (SELECT col, "row", dx, dy, l, r FROM {p} WHERE x = 0 AND y = 0) m
  ON m.col = q.col AND m."row" = q."row" AND m.dx = q.dx AND m.dy = q.dy GROUP BY ALL HAVING count(*) = 9)"""


@query(f"""WITH {_SIDES}, f AS (SELECT * FROM (SELECT *, {_FIRST} AS n FROM {_census("l", "r")}) WHERE n = 1), b AS (SELECT * FROM (SELECT *, {_FIRST} AS n FROM {_census("r", "l")}) WHERE n = 1)
SELECT f.col, f."row", f.dx, f.dy, f.cost::DOUBLE AS cost FROM f JOIN b ON b.col = f.col + f.dx AND b."row" = f."row" + f.dy WHERE abs(f.dx + b.dx) <= 1 AND abs(f.dy + b.dy) <= 1""")
def agreeing_matches(spark, d):
    """Matches by census that agree from left to right and back."""
    left, right = _sides(spark, d)
    back = stereo.block_match(right, left, (-3, 3, -2, 2), 1, "census", tile=64)
    return stereo.agreeing(stereo.block_match(left, right, (-3, 3, -2, 2), 1, "census", tile=64), back, 1).select("col", "row", "dx", "dy", "cost")


# --- blends -----------------------------------------------------------------------------------------------------------


def _framed(spark, d):
    """The three rasters with a line for each place of their frames."""
    idx = F.explode(F.array(*(F.lit(i) for i in range(3))))
    frame = table(spark, d, "supplier").select(F.col("s_suppkey").alias("col"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("row")).withColumn("idx", idx)
    return frame.join(cells(spark, d), ["idx", "col", "row"], "left")


_FRAMED = CELLS + """, framed AS (SELECT i.idx, c.col, r."row", v FROM (SELECT unnest(range(3)) AS idx) i CROSS JOIN (SELECT s_suppkey AS col FROM supplier) c CROSS JOIN (SELECT unnest(range(30)) AS "row") r
  LEFT JOIN cells k ON k.idx = i.idx AND k.col = c.col AND k."row" = r."row"), frame AS (SELECT min(col) AS c0, max(col) AS c1 FROM framed)"""


def _depths(cells: str, name: str) -> str:
    """The distance of each valid cell to the nearest hole of its input or to the frame's outside."""
    return f"""{name} AS (SELECT a.idx, a.col, a."row", a.v, least(coalesce(min(abs(a.col - h.col) + abs(a."row" - h."row")), 1000000), min(a.col - c0 + 1), min(c1 - a.col + 1), min(a."row" + 1), min(30 - a."row"))::DOUBLE AS d
  FROM {cells} a CROSS JOIN frame LEFT JOIN {cells} h ON h.idx = a.idx AND h.v IS NULL AND abs(a.col - h.col) <= 15 WHERE a.v IS NOT NULL GROUP BY ALL)"""


#: Taps of a Gaussian of sigma 1, three each way.
_BLEND = """g AS (SELECT k, exp(-0.5 * k * k) / (SELECT sum(exp(-0.5 * j * j)) FROM range(-3, 4) r(j)) AS g FROM range(-3, 4) t(k)),
w AS (SELECT a.idx, a.col, a."row", a.v, pow(sum(least(b.d, 3) * x.g * y.g), 2) AS w FROM {0} a CROSS JOIN g x CROSS JOIN g y JOIN {0} b ON b.idx = a.idx AND b.col = a.col - x.k AND b."row" = a."row" - y.k GROUP BY ALL)
SELECT col, "row", round(sum(w * v) / sum(w), 6) AS blend, round(sum(CASE WHEN idx = 0 THEN w ELSE 0 END) / sum(w), 6) AS first_share FROM w GROUP BY ALL"""


@query(f"""WITH {_FRAMED}, {_depths("framed", "d")}, {_BLEND.format("d")}""")
def blurred_blend(spark, d):
    return rounded(mosaic.blurred_blend(_framed(spark, d), 3.0, 1.0, 2.0), "blend", "first_share")


@query(f"""WITH {_FRAMED}, {_depths("framed", "d")}, p AS (SELECT col, "row", max(CASE WHEN idx = 0 THEN d END) AS d0, max(CASE WHEN idx = 1 THEN d END) AS d1, max(CASE WHEN idx = 2 THEN d END) AS d2 FROM d GROUP BY ALL),
m1 AS (SELECT *, CASE WHEN d0 IS NULL THEN 1e18 ELSE greatest(0, 2 - d0) END AS room1 FROM p), t1 AS (SELECT *, CASE WHEN d1 IS NOT NULL THEN least(room1, d1) END AS t FROM m1),
m2 AS (SELECT *, CASE WHEN t IS NULL THEN room1 ELSE least(room1, greatest(0, 2 - t)) END AS room2 FROM t1),
burnt AS (SELECT f.idx, f.col, f."row", CASE WHEN f.idx = 0 OR f.idx = 1 AND room1 > 0 OR f.idx = 2 AND room2 > 0 THEN v END AS v FROM framed f LEFT JOIN m2 ON m2.col = f.col AND m2."row" = f."row"),
{_depths("burnt", "e")}, {_BLEND.format("e")}""")
def border_priority_blend(spark, d):
    """Depths by the distance to the border, so that the first raster wins but near its holes."""
    return rounded(mosaic.border_priority_blend(_framed(spark, d), 2.0, 3.0, 1.0, 2.0), "blend", "first_share")


@query(f"""WITH {RASTER}, q AS (SELECT list_sort(list(abs(v))) AS s FROM raster WHERE v IS NOT NULL) SELECT col, "row", v FROM raster CROSS JOIN q WHERE abs(v) <= 1.25 * s[least(floor(0.85 * len(s))::BIGINT + 1, len(s))]""")
def clean_by_quantile(spark, d):
    return neighbourhood.clean_by_quantile(raster(spark, d), 0.85, 1.25)


def _pass(source: str, name: str) -> str:
    return f"""{name} AS (SELECT f.col, f."row", CASE WHEN any_value(f.v) IS NOT NULL THEN any_value(f.v) WHEN count(n.v) >= 0.7 * 12 THEN sum(n.v * w) / sum(CASE WHEN n.v IS NOT NULL THEN w END) END AS v
  FROM {source} f CROSS JOIN disc LEFT JOIN {source} n ON n.col = f.col + dx AND n."row" = f."row" + dy GROUP BY f.col, f."row")"""


@query(f"""WITH {RASTER}, disc AS (SELECT x AS dx, y AS dy, 1 / (pow(sqrt(x * x + y * y), 1.5) + 1) AS w FROM range(-2, 3) a(x), range(-2, 3) b(y) WHERE x * x + y * y BETWEEN 1 AND 4), one AS (SELECT col, "row", v::DOUBLE AS v FROM raster),
{_pass("one", "two")}, {_pass("two", "three")} SELECT col, "row", round(v, 6) AS v FROM three""")
def fill_in_passes(spark, d):
    return rounded(neighbourhood.fill_in_passes(raster(spark, d), 2.0, 1.5, 0.7, 2), "v")


@query(f"""WITH {RASTER}, h AS (SELECT col, "row" FROM raster WHERE v IS NULL), k AS (SELECT * FROM raster WHERE v IS NOT NULL),
e AS (SELECT h.col, h."row", max(CASE WHEN k."row" = h."row" AND k.col < h.col THEN k.col END) AS l, min(CASE WHEN k."row" = h."row" AND k.col > h.col THEN k.col END) AS r,
  max(CASE WHEN k.col = h.col AND k."row" < h."row" THEN k."row" END) AS t, min(CASE WHEN k.col = h.col AND k."row" > h."row" THEN k."row" END) AS b FROM h JOIN k ON k.col = h.col OR k."row" = h."row" GROUP BY ALL),
f AS (SELECT e.col, e."row", (a.v / (e.col - l) + c.v / (r - e.col) + u.v / (e."row" - t) + w.v / (b - e."row")) / (1.0 / (e.col - l) + 1.0 / (r - e.col) + 1.0 / (e."row" - t) + 1.0 / (b - e."row")) AS v
  FROM e JOIN k a ON a.col = l AND a."row" = e."row" JOIN k c ON c.col = r AND c."row" = e."row" JOIN k u ON u.col = e.col AND u."row" = t JOIN k w ON w.col = e.col AND w."row" = b WHERE r - l - 1 <= 2 AND b - t - 1 <= 2)
SELECT x.col, x."row", round(coalesce(x.v, f.v), 6)::DOUBLE AS v FROM raster x LEFT JOIN f ON f.col = x.col AND f."row" = x."row" """)
def fill_short_holes(spark, d):
    return rounded(neighbourhood.fill_short_holes(raster(spark, d), 2), "v")


# --- pairs ------------------------------------------------------------------------------------------------------------

_HITS = f"""{_BOXES}, hit AS (SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
forward AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS n FROM hit) WHERE n <= 3)"""


def _boxes(spark, d):
    at, row = F.col("c_acctbal"), F.col("c_nationkey") * 10.0
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), at.alias("x0"), (at + 60).alias("x1"), row.alias("y0"), (row + 12).alias("y1"))


@query(f"WITH {_HITS} SELECT * FROM forward")
def limited_overlaps(spark, d):
    return joins.limited_overlaps(_boxes(spark, d), 60.0, 3)


@query(f"""WITH {_HITS}, taken AS (SELECT a, count(*) AS taken FROM forward GROUP BY ALL),
again AS (SELECT h.a, h.b, row_number() OVER (PARTITION BY h.b ORDER BY h.a) AS n, coalesce(taken, 0) AS taken FROM hit h ANTI JOIN forward f ON f.a = h.a AND f.b = h.b LEFT JOIN taken t ON t.a = h.b WHERE h.a < 3)
SELECT a, b FROM forward UNION ALL SELECT a, b FROM again WHERE n <= 3 - taken""")
def wrapped_overlaps(spark, d):
    return joins.limited_overlaps(_boxes(spark, d), 60.0, 3, wrap=True)


@query("""WITH s AS (SELECT s_suppkey AS i, CASE WHEN s_nationkey <> 3 THEN s_acctbal END AS x, s_nationkey * 100.0::DOUBLE AS y, 1.0::DOUBLE AS z, count(*) OVER () AS n FROM supplier),
p AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM (SELECT i, (i + k) % n AS j FROM s CROSS JOIN (SELECT unnest(range(1, 6)) AS k)) WHERE i <> j)
SELECT p.i, p.j FROM p JOIN s a ON a.i = p.i JOIN s b ON b.i = p.j WHERE coalesce(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 3000, true)""")
def near_pairs(spark, d):
    """Neighbours in the order of a closed orbit, but for those known to be far apart."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.when(F.col("s_nationkey") != 3, F.col("s_acctbal")).alias("x"), (F.col("s_nationkey") * 100.0).alias("y"), F.lit(1.0).alias("z"))
    return joins.near_pairs(s, 5, True, 3000.0)


@query("""WITH s AS (SELECT l_suppkey % 36 AS salinity, 380 + l_quantity * 5 AS w, l_tax AS r FROM lineitem WHERE l_tax > 0 AND 380 + l_quantity * 5 BETWEEN 400 AND 600),
e AS (SELECT salinity, sum(w * r) / sum(r) AS weighted_mean, min(CASE WHEN r = top THEN w END) AS peak_response FROM (SELECT *, max(r) OVER (PARTITION BY salinity) AS top FROM s) GROUP BY salinity)
SELECT salinity, round(weighted_mean, 6) AS weighted_mean, peak_response, round((-1.97812e-6 + salinity / 35 * (-1.50156e-6 + 1.97812e-6)) * 400 + (1.03223e-7 + salinity / 35 * (1.07085e-7 - 1.03223e-7)) * weighted_mean * weighted_mean
+ (-8.58125e-6 + salinity / 35 * (-4.27594e-5 + 8.58125e-6)) * 20 + (-1.54834e-4 + salinity / 35 * (-1.60476e-4 + 1.54834e-4)) * weighted_mean + 1.38919 + salinity / 35 * (1.39807 - 1.38919), 9) AS index FROM e""")
def refraction_by_salinity(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_suppkey") % 36).alias("salinity"), (380 + F.col("l_quantity") * 5).alias("w"), F.col("l_tax").alias("r"))
    found = G.effective_wavelength(F.col("w"), F.col("r"), 400, 600)
    e = t.groupBy("salinity").agg(*(c.alias(n) for n, c in found.items())).filter("weighted_mean IS NOT NULL")
    e = e.withColumn("index", G.refraction_index_by_salinity(F.col("weighted_mean"), F.lit(20.0), F.col("salinity")))
    return rounded(rounded(e, "weighted_mean", "peak_response"), "index", digits=9)
