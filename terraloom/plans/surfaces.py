"""Queries over weights, normals, cameras and denser series, each with its SQL twin where SQL gives the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions import cameras
from terraloom.operators import surfaces
from terraloom.plans.inputs import CLOUD, RASTER, cloud, frames, raster, table
from terraloom.plans.registry import query, rounded


@query(f"""WITH {RASTER}, hole AS (SELECT col, "row" FROM raster WHERE v IS NULL),
near AS (SELECT a.col, a."row", min(abs(a.col - h.col) + abs(a."row" - h."row")) AS d FROM raster a CROSS JOIN hole h WHERE a.v IS NOT NULL GROUP BY ALL),
f AS (SELECT min(col) AS c0, max(col) AS c1, min("row") AS r0, max("row") AS r1 FROM raster)
SELECT a.col, a."row", a.v, least(d, a.col - c0 + 1, c1 - a.col + 1, a."row" - r0 + 1, r1 - a."row" + 1) AS distance FROM raster a CROSS JOIN f LEFT JOIN near n ON n.col = a.col AND n."row" = a."row" WHERE a.v IS NOT NULL""")
def grassfire_weights(spark, d):
    return surfaces.grassfire(raster(spark, d))


@query(f"""WITH {RASTER}, g AS (SELECT k, exp(-0.5 * k * k / 2.25) / (SELECT sum(exp(-0.5 * j * j / 2.25)) FROM range(-3, 4) r(j)) AS g FROM range(-3, 4) t(k)), p AS (SELECT * FROM raster WHERE v > 0)
SELECT a.col, a."row", round(sum(b.v * x.g * y.g), 6) AS v FROM p a JOIN p b ON abs(a.col - b.col) <= 3 AND abs(a."row" - b."row") <= 3 JOIN g x ON x.k = a.col - b.col JOIN g y ON y.k = a."row" - b."row" GROUP BY ALL""")
def blurred_weights(spark, d):
    return rounded(surfaces.blurred(raster(spark, d), 1.5, 3), "v")


@query()
def surface_normals(spark, d):
    points = raster(spark, d).select("col", "row", (F.col("col") * 3.0).alias("x"), (F.col("row") * 4.0).alias("y"), F.col("v").cast("double").alias("z"))
    return rounded(surfaces.normals(points), "nx", "ny", "nz")


@query(f"""WITH {RASTER}, c AS (SELECT s_suppkey AS col, s_acctbal AS c0, 1 + s_nationkey / 100 AS c1, 1.25 AS c2 FROM supplier WHERE s_suppkey % 4 <> 1)
SELECT r.col, r."row", round(CASE WHEN c.col IS NULL THEN v ELSE c1 * v / c2 + c0 END, 6) AS v FROM raster r LEFT JOIN c ON c.col = r.col""")
def radiometric_columns(spark, d):
    c = table(spark, d, "supplier").filter("s_suppkey % 4 <> 1").select(F.col("s_suppkey").alias("col"), F.col("s_acctbal").alias("c0"), (1 + F.col("s_nationkey") / 100).alias("c1"), F.lit(1.25).alias("c2"))
    return rounded(surfaces.radiometric(raster(spark, d), c), "v")


@query(f"""WITH {RASTER}, f AS (SELECT min(col) AS c0, max(col) AS c1 FROM raster), s AS (SELECT s_suppkey AS col, s_nationkey / 32 AS dx FROM supplier WHERE s_suppkey % 4 <> 1),
p AS (SELECT r.col, r."row", least(greatest(r.col - coalesce(dx, 0), c0), c1) AS px, least(greatest(r."row" - CASE WHEN dx IS NULL THEN 0 ELSE 0.5 END, 0), 29) AS py FROM raster r CROSS JOIN f LEFT JOIN s ON s.col = r.col),
n AS (SELECT p.col, p."row", (1 - abs(px - q.col)) * (1 - abs(py - q."row")) AS w, q.v FROM p JOIN raster q ON q.col BETWEEN floor(px)::BIGINT AND floor(px)::BIGINT + 1 AND q."row" BETWEEN floor(py)::BIGINT AND floor(py)::BIGINT + 1)
SELECT col, "row", CASE WHEN count(v) = count(*) THEN round(sum(w * v), 6) END AS v FROM n WHERE w > 0 GROUP BY ALL""")
def shifted_columns(spark, d):
    s = table(spark, d, "supplier").filter("s_suppkey % 4 <> 1").select(F.col("s_suppkey").alias("col"), (F.col("s_nationkey") / 32).alias("dx"), F.lit(0.5).alias("dy"))
    return rounded(surfaces.column_shifts(raster(spark, d), s), "v")


@query("""WITH i AS (SELECT n_nationkey, 6378137 + (n_nationkey % 3) * 0.06::DOUBLE AS semi_major, 6356752.25 AS semi_minor, CASE WHEN n_regionkey = 4 THEN 180.0 ELSE 0.0 END AS meridian FROM nation)
SELECT *, abs(semi_major - 6378137) <= 0.1 AND meridian = 0 AS fits FROM i""")
def datum_check(spark, d):
    n = table(spark, d, "nation")
    i = n.select("n_nationkey", (F.lit(6378137.0) + (F.col("n_nationkey") % 3) * 0.06).alias("semi_major"), F.lit(6356752.25).alias("semi_minor"), F.when(F.col("n_regionkey") == 4, 180.0).otherwise(0.0).alias("meridian"))
    return surfaces.datum_checked(i, 6378137.0, 6356752.25, 0.0)


@query(f"""WITH {CLOUD} SELECT round(max(sqrt(pow(x - y, 2) + pow(y - z, 2) + pow(z - err, 2))), 6) AS displacement FROM cloud""")
def largest_displacement(spark, d):
    return rounded(surfaces.largest_displacement(cloud(spark, d), ["x", "y", "z"], ["y", "z", "err"]), "displacement")


_DENSE = """s AS (SELECT event_type AS sensor, event_id::DOUBLE AS t, value AS v, row_number() OVER w - 1 AS i, count(*) OVER p AS n, min(event_id::DOUBLE) OVER p AS t0, max(event_id::DOUBLE) OVER p AS t1, lead(event_id::DOUBLE) OVER w AS t2, lead(value) OVER w AS v2
FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY event_id), p AS (PARTITION BY event_type)),
k AS (SELECT *, (t1 - t0) / ((n - 1) * 3) AS step FROM s WHERE t2 IS NOT NULL),
o AS (SELECT *, unnest(range(ceil((t - t0) / step - 1e-9)::BIGINT, CASE WHEN i = n - 2 THEN (n - 1) * 3 + 1 ELSE ceil((t2 - t0) / step - 1e-9)::BIGINT END)) AS k FROM k),
o2 AS (SELECT *, t0 + k * step AS tt, greatest(0, least(i - 1, n - 4)) AS first FROM o)"""


@query(f"""WITH {_DENSE}, j AS (SELECT sensor, k, tt, first, unnest(range(first, first + 4)) AS pi FROM o2), m AS (SELECT *, unnest(range(first, first + 4)) AS qi FROM j),
w AS (SELECT m.sensor, m.k, m.tt, p.v, m.pi, product(CASE WHEN m.qi = m.pi THEN 1 ELSE (m.tt - q.t) / (p.t - q.t) END) AS w FROM m JOIN s p ON p.sensor = m.sensor AND p.i = m.pi JOIN s q ON q.sensor = m.sensor AND q.i = m.qi GROUP BY ALL)
SELECT sensor, k, round(tt, 6) AS t, round(sum(v * w), 4) AS value FROM w GROUP BY ALL""")
def denser_series(spark, d):
    s = frames(spark, d).filter("value IS NOT NULL").select("sensor", F.col("event_id").cast("double").alias("at"), "value")
    return rounded(rounded(surfaces.lagrange(s, ["sensor"], "at", ["value"], 4, 3), "t"), "value", digits=4)


@query(f"""WITH {_DENSE}, a AS (SELECT sensor, k, tt, radians(v % 90) AS a, radians(v2 % 90) AS b, (tt - t) / (t2 - t) AS u FROM o2)
SELECT sensor, k, round(tt, 6) AS t, round(cos((a + u * (b - a)) / 2), 6) AS w, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, round(sin((a + u * (b - a)) / 2), 6) AS z FROM a""")
def denser_turns(spark, d):
    half = F.radians(F.col("value") % 90) / 2
    s = frames(spark, d).filter("value IS NOT NULL").select("sensor", F.col("event_id").cast("double").alias("at"), F.cos(half).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.sin(half).alias("z"))
    return rounded(surfaces.slerped(s, ["sensor"], "at", ["w", "x", "y", "z"], 3), "t", "w", "x", "y", "z")


@query("""SELECT event_id, i.i, s.n_name AS name FROM (SELECT event_id, greatest(0, least(24, round((event_id - 100.0) / 7)::BIGINT)) AS i FROM events) i JOIN nation s ON s.n_nationkey = i.i""")
def nearest_samples(spark, d):
    samples = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_name").alias("name"))
    return surfaces.nearest_sample(frames(spark, d).select("event_id"), samples, "event_id", 100.0, 7.0, 25).select("event_id", "i", "name")


#: A made-up camera: its divisors stay near 1.
CAMERA = cameras.RationalCamera(
    ([0.01, 0.98, -0.02, 0.01, 0.003, 0.002, -0.001, 0.004, 0.001, 0.002, 1e-4, 2e-4, 1e-4, 3e-4, 1e-4, 2e-4, 1e-4, 1e-4, 2e-4, 1e-4], [1, 0.001, 0.002, -0.001, 1e-4, 2e-4, 1e-4, 1e-4, 3e-4, 1e-4, *[1e-5] * 10]),
    ([-0.02, 0.03, -1.01, 0.02, 0.001, -0.002, 0.003, 0.001, 0.002, 0.001, 1e-4, 1e-4, 2e-4, 1e-4, 3e-4, 1e-4, 2e-4, 1e-4, 1e-4, 2e-4], [1, -0.002, 0.001, 0.001, 2e-4, 1e-4, 1e-4, 2e-4, 1e-4, 1e-4, *[2e-5] * 10]),
    (50.0, 25.0, 5.0), (60.0, 30.0, 6.0), (2048.0, 1024.0), (2000.0, 1000.0),
)


def _poly(coefficients) -> str:
    return "(" + " + ".join(f"{c}::DOUBLE" + "".join(f" * {a}" for a in term) for c, term in zip(coefficients, cameras.TERMS, strict=True)) + ")"


@query(f"""WITH g AS (SELECT l_orderkey, l_linenumber, (l_extendedprice / 1000 - 50) / 60 AS x, (l_quantity - 25) / 30 AS y, (l_discount * 100 - 5) / 6 AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, round({_poly(CAMERA.sample[0])} / {_poly(CAMERA.sample[1])} * 2000 + 2048, 6) AS sample, round({_poly(CAMERA.line[0])} / {_poly(CAMERA.line[1])} * 1000 + 1024, 6) AS line FROM g""")
def rational_pixels(spark, d):
    t = table(spark, d, "lineitem")
    sample, line = cameras.rational_pixel(F.col("l_extendedprice") / 1000, F.col("l_quantity").cast("double"), F.col("l_discount") * 100, CAMERA)
    return rounded(t.select("l_orderkey", "l_linenumber", sample.alias("sample"), line.alias("line")), "sample", "line")


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice / 1000, 5) AS lon, round(l_quantity, 5) AS lat FROM lineitem""")
def rational_ground(spark, d):
    """Pixels of all points sent back to the ground: the points themselves."""
    t = table(spark, d, "lineitem")
    height = F.col("l_discount") * 100
    sample, line = cameras.rational_pixel(F.col("l_extendedprice") / 1000, F.col("l_quantity").cast("double"), height, CAMERA)
    found = t.select("l_orderkey", "l_linenumber", cameras.rational_ground(sample, line, height, CAMERA).alias("g")).select("l_orderkey", "l_linenumber", "g.lon", "g.lat")
    return rounded(found, "lon", "lat", digits=5)


@query("""SELECT l_orderkey, l_linenumber, round(sqrt(pow(l_discount, 2) + pow(l_tax, 2)) / 2, 4) AS horizontal, round((100 + l_quantity) / 100 * sqrt(pow(l_discount, 2) + pow(l_tax, 2)), 4) AS vertical FROM lineitem""")
def triangulation_spreads(spark, d):
    """Two cameras 100 apart, as high as the quantity says; the twin has the differences worked out by hand."""
    t = table(spark, d, "lineitem")
    side = lambda s: [F.array(F.lit(s * 50.0), F.lit(0.0), -100 - F.col("l_quantity")), F.array(F.lit(-s * 50.0), F.lit(0.0), 100 + F.col("l_quantity"))]
    found = cameras.triangulation_spread(*side(1), *side(-1), F.col("l_discount").cast("double"), F.col("l_tax").cast("double"))
    return rounded(t.select("l_orderkey", "l_linenumber", found.alias("f")).select("l_orderkey", "l_linenumber", "f.horizontal", "f.vertical"), "horizontal", "vertical", digits=4)
