"""Queries over rasters, spatial and temporal joins, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions import geometry as G
from terraloom.operators import alignment, joins, mosaic, neighbourhood
from terraloom.plans.inputs import CELLS, CLOUD, RASTER, cells, cloud, frames, raster, table
from terraloom.plans.registry import _PAIR, _pair, query, rounded

_SQUARE = 'abs(a.col - b.col) <= {h} AND abs(a."row" - b."row") <= {h}'


@query(f"""WITH {RASTER}, s AS (SELECT a.col, a."row", list_sort(list(b.v)) AS s FROM raster a JOIN raster b ON {_SQUARE.format(h=1)} WHERE b.v IS NOT NULL AND a.v IS NOT NULL GROUP BY ALL)
SELECT r.col, r."row", CASE WHEN abs(r.v - s[len(s) // 2 + 1]) <= 200 THEN r.v END AS v FROM raster r JOIN s ON s.col = r.col AND s."row" = r."row" """)
def height_median_filter(spark, d):
    return neighbourhood.height_median_filter(raster(spark, d), 1, 200.0)


@query(f"""WITH {RASTER}, n AS (SELECT a.col, a."row", a.v, count(*) FILTER (WHERE abs(b.v - a.v) <= 150) - 1 AS k FROM raster a JOIN raster b ON {_SQUARE.format(h=2)} WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL)
SELECT col, "row", v FROM n WHERE k >= 0.4 * 24""")
def clean_by_threshold(spark, d):
    return neighbourhood.clean_by_threshold(raster(spark, d), 2, 150.0, 0.4)


@query(f"""WITH {RASTER}, n AS (SELECT a.col, a."row", a.v, avg(b.v) AS m FROM raster a JOIN raster b ON {_SQUARE.format(h=2)} WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL) SELECT col, "row", v FROM n WHERE abs(v - m) <= 120""")
def clean_by_mean(spark, d):
    return neighbourhood.clean_by_mean(raster(spark, d), 2, 120.0)


@query(f"""WITH {RASTER}, m AS (SELECT col, "row", CASE WHEN v > 250 THEN v END AS v FROM raster), a AS (SELECT "row", min(col) AS l, max(col) AS r FROM m WHERE v IS NOT NULL GROUP BY ALL), b AS (SELECT col, min("row") AS t, max("row") AS u FROM m WHERE v IS NOT NULL GROUP BY ALL)
SELECT m.col, m."row", v FROM m JOIN a ON a."row" = m."row" JOIN b ON b.col = m.col WHERE m.col BETWEEN l + 2 AND r - 2 AND m."row" BETWEEN t + 2 AND u - 2""")
def edge_mask(spark, d):
    return neighbourhood.edge_mask(raster(spark, d).withColumn("v", F.when(F.col("v") > 250, F.col("v"))), 2)


@query(f"""WITH {RASTER}, p AS (SELECT col, "row", col * 3.0::DOUBLE AS x, "row" * 4.0::DOUBLE AS y, v AS z FROM raster WHERE v IS NOT NULL)
SELECT a.col, a."row", CASE WHEN count(*) >= 3 THEN round(max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))), 6) END AS resolution FROM p a JOIN p b ON abs(a.col - b.col) + abs(a."row" - b."row") = 1 GROUP BY ALL""")
def surface_resolution(spark, d):
    p = raster(spark, d).select("col", "row", (F.col("col") * 3.0).alias("x"), (F.col("row") * 4.0).alias("y"), F.col("v").alias("z"))
    return rounded(neighbourhood.surface_resolution(p), "resolution")


@query(f"""WITH RECURSIVE {RASTER}, m AS (SELECT "row" * 2147483648 + col AS node, col, "row", v FROM raster WHERE v > 200), e AS (SELECT a.node AS x, b.node AS y FROM m a JOIN m b ON abs(a.col - b.col) + abs(a."row" - b."row") = 1),
r(node, region) AS (SELECT node, node FROM m UNION SELECT e.y, r.region FROM r JOIN e ON e.x = r.node WHERE r.region < e.y), g AS (SELECT node, min(region) AS region FROM r GROUP BY node), k AS (SELECT region, count(*) AS area FROM g GROUP BY 1)
SELECT col, "row", v, g.region, area FROM m JOIN g ON g.node = m.node JOIN k ON k.region = g.region WHERE area >= 4""")
def blobs(spark, d):
    r = raster(spark, d).withColumn("v", F.when(F.col("v") > 200, F.col("v")))
    return neighbourhood.blobs(r, 4)


@query(f"""WITH {_PAIR}, p AS (SELECT * FROM pair WHERE a IS NOT NULL AND b IS NOT NULL), s AS (SELECT c.col, c."row", sum(p.a * p.b) AS lr, sum(p.a * p.a) AS ll, sum(p.b * p.b) AS rr, count(*) AS n
FROM (SELECT DISTINCT p.col + dx AS col, p."row" + dy AS "row" FROM p, (SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dy)) c JOIN p ON abs(c.col - p.col) <= 1 AND abs(c."row" - p."row") <= 1 GROUP BY ALL) SELECT col, "row", round(lr / sqrt(ll * rr), 9) AS ncc FROM s WHERE n = 9""")
def correlation(spark, d):
    return rounded(neighbourhood.correlation(_pair(spark, d).select("col", "row", F.col("a").alias("l"), F.col("b").alias("r")), 1), "ncc", digits=9)


@query(f"""WITH {_PAIR}, s AS (SELECT a.col, a."row", a.a AS here, l.a AS before, r.a AS after FROM pair a JOIN pair l ON l.col = a.col - 1 AND l."row" = a."row" JOIN pair r ON r.col = a.col + 1 AND r."row" = a."row" WHERE a.a IS NOT NULL AND l.a IS NOT NULL AND r.a IS NOT NULL)
SELECT col, "row", round(CASE WHEN before - 2 * here + after <> 0 THEN (before - after) / (2 * (before - 2 * here + after)) ELSE 0 END, 6) + 0.0 AS shift FROM s""")
def parabola_offsets(spark, d):
    near = neighbourhood.around(_pair(spark, d).select("col", "row", F.col("a").alias("v")), {"here": (0, 0), "before": (-1, 0), "after": (1, 0)}).dropna()
    return rounded(near.select("col", "row", G.parabola_offset(F.col("before"), F.col("here"), F.col("after")).alias("shift")), "shift")


@query(f"""WITH {CELLS}, w AS (SELECT *, pow(1 + "row" % 7, 2) AS w, min(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY col, "row") AS top FROM cells)
SELECT col, "row", round(sum(w * CASE WHEN idx = top THEN 1 ELSE greatest(0, 1 - t / 4) END * v) / sum(w * CASE WHEN idx = top THEN 1 ELSE greatest(0, 1 - t / 4) END), 6) AS v
FROM (SELECT *, max(CASE WHEN idx = top THEN 1 + "row" % 7 END) OVER (PARTITION BY col, "row") AS t FROM w WHERE v IS NOT NULL) GROUP BY ALL""")
def priority_blend(spark, d):
    c = cells(spark, d).withColumn("depth", 1 + F.col("row") % 7)
    return rounded(mosaic.priority_blend(c, "depth", 4.0, 2.0), "v")


@query(f"""WITH {CELLS} SELECT col, "row", greatest(max(v - 300), 0) AS v FROM cells WHERE v IS NOT NULL GROUP BY ALL""")
def max_lit(spark, d):
    return mosaic.max_lit(cells(spark, d).withColumn("v", F.col("v") - 300))


@query(f"""WITH {CELLS} SELECT a.idx AS i, b.idx AS j, round(avg(a.v - b.v), 6) AS mean, count(*) AS n FROM cells a JOIN cells b ON a.col = b.col AND a."row" = b."row" AND a.idx < b.idx WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL""")
def mean_differences(spark, d):
    return rounded(mosaic.mean_differences(cells(spark, d)), "mean")


@query(f"""WITH {CELLS} SELECT idx, round(avg(v) FILTER (WHERE v > 200), 6) AS mean, max(v) AS highest FROM cells GROUP BY idx""")
def lit_albedo(spark, d):
    return rounded(mosaic.lit_albedo(cells(spark, d), 200.0), "mean")


_HOLE = f"""{RASTER}, h AS (SELECT * FROM raster WHERE v IS NULL), n AS (SELECT h.col, h."row", sum(b.v / pow(d2, 2)) / sum(1 / pow(d2, 2)) AS v, count(*) AS k FROM (SELECT h.col, h."row", b.v, pow(h.col - b.col, 2) + pow(h."row" - b."row", 2) AS d2 FROM h JOIN raster b ON b.v IS NOT NULL AND abs(h.col - b.col) <= 2 AND abs(h."row" - b."row") <= 2) b JOIN h ON h.col = b.col AND h."row" = b."row" WHERE d2 <= 4 GROUP BY ALL)"""


@query(f"""WITH {_HOLE} SELECT r.col, r."row", round(coalesce(r.v, CASE WHEN k >= 0.3 * 12 THEN n.v END), 6) AS v FROM raster r LEFT JOIN n ON n.col = r.col AND n."row" = r."row" """)
def fill_holes(spark, d):
    return rounded(neighbourhood.fill_holes(raster(spark, d), 2, 4.0, 0.3), "v")


# --- joins ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_PAIR} SELECT col, "row", a - b AS diff FROM pair WHERE a IS NOT NULL AND b IS NOT NULL""")
def raster_difference(spark, d):
    c = cells(spark, d)
    return joins.raster_difference(c.filter("idx = 0"), c.filter("idx = 1"))


_PTS = "pts AS (SELECT o_orderkey AS id, o_custkey % 90 + 0.25::DOUBLE AS px, o_orderkey % 28 + 0.5::DOUBLE AS py, o_totalprice / 1000 AS h FROM orders)"
_FOUR = """q AS (SELECT *, floor(px)::BIGINT AS c, floor(py)::BIGINT AS r FROM pts), f AS (SELECT q.id, q.h, sum(CASE WHEN n.col = c THEN 0.75 ELSE 0.25 END * 0.5 * v) AS value, count(v) AS k, count(*) AS inside FROM q JOIN raster n ON n.col IN (c, c + 1) AND n."row" IN (r, r + 1) GROUP BY ALL)"""


def _points(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 90 + 0.25).alias("px"), (F.col("o_orderkey") % 28 + 0.5).alias("py"), (F.col("o_totalprice") / 1000).alias("h"))


@query(f"""WITH {RASTER}, {_PTS}, {_FOUR} SELECT id, round(value - h, 5) AS diff FROM f WHERE k = 4""")
def points_difference(spark, d):
    return rounded(joins.points_difference(_points(spark, d), raster(spark, d), "h").select("id", "diff"), "diff", digits=5)


@query(f"""WITH {RASTER}, {_PTS}, {_FOUR} SELECT pts.id, CASE WHEN coalesce(inside, 0) < 4 THEN 0 WHEN k < 4 THEN -1 ELSE 1 END AS code FROM pts LEFT JOIN f ON f.id = pts.id""")
def lookup_codes(spark, d):
    return joins.bilinear(_points(spark, d), raster(spark, d), codes=True).select("id", "code")


_SENSORS = "c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, max(event_id) AS ref FROM events WHERE event_type <> 'click' GROUP BY ALL)"


def _click(spark, d):
    f = frames(spark, d)
    return f.filter("sensor = 'click'").select("event_id", "user_id", "ts"), f.filter("sensor <> 'click'").select("user_id", "ts", F.col("event_id").alias("ref"))


@query(f"""WITH {_SENSORS}, p AS (SELECT c.event_id, c.ts, a.ref AS ra, b.ref AS rb, epoch_us(c.ts) - epoch_us(a.ts) AS da, epoch_us(b.ts) - epoch_us(c.ts) AS db FROM c ASOF LEFT JOIN v a ON a.user_id = c.user_id AND c.ts >= a.ts ASOF LEFT JOIN v b ON b.user_id = c.user_id AND c.ts <= b.ts)
SELECT event_id, CASE WHEN da IS NOT NULL AND (db IS NULL OR da <= db) THEN CASE WHEN da <= 36e8 THEN ra END WHEN db <= 36e8 THEN rb END AS nearest FROM p""")
def nearest_camera(spark, d):
    asked, ref = _click(spark, d)
    return joins.nearest_in_time(asked, ref, ["user_id"], "ts", "ref", "nearest", 3600.0).select("event_id", "nearest")


@query("""WITH r AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'click'), s AS (SELECT user_id, ts AS a, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM r),
f AS (SELECT e.user_id, event_type AS sensor, s.a, s.b, event_id, e.ts, row_number() OVER (PARTITION BY e.user_id, event_type, s.a ORDER BY abs(2 * epoch_us(e.ts) - epoch_us(s.a) - epoch_us(s.b)), e.ts, event_id) AS k
FROM events e JOIN s ON s.user_id = e.user_id AND e.ts >= s.a AND e.ts < s.b WHERE event_type <> 'click' AND epoch_us(s.b) - epoch_us(s.a) <= 864e8)
SELECT user_id, sensor, a AS start, b AS "end", event_id FROM f WHERE k = 1""")
def rig_brackets(spark, d):
    f = frames(spark, d)
    return joins.bracket_nearest_midpoint(f.filter("sensor = 'click'"), f.filter("sensor <> 'click'").select("user_id", "sensor", "ts", "event_id"), ["user_id"], "ts", "event_id", 86400.0)


_KNN = "a AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, c_nationkey * 4.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM customer), b AS (SELECT s_acctbal / 100 AS x, s_nationkey * 4.0::DOUBLE AS y, 1.0::DOUBLE AS z FROM supplier)"


@query(f"""WITH {_KNN}, d AS (SELECT a.id, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS d FROM a, b GROUP BY a.id) SELECT id, round(d, 6) AS distance FROM d""")
def nearest_points(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_nationkey") * 4.0).alias("y"), F.lit(0.0).alias("z"))
    b = table(spark, d, "supplier").select((F.col("s_acctbal") / 100).alias("x"), (F.col("s_nationkey") * 4.0).alias("y"), F.lit(1.0).alias("z"))
    b = b.withColumn("id", F.monotonically_increasing_id())
    return rounded(alignment.nearest_k(a, b, 10.0).select("id", "distance"), "distance")


@query(f"""WITH {_KNN} SELECT id, round(sqrt(pow(x - 40, 2) + pow(y - 40, 2)), 6) AS distance FROM a WHERE sqrt(pow(x - 40, 2) + pow(y - 40, 2)) <= 10 ORDER BY 2, 1 LIMIT 1""")
def nearest_click(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_nationkey") * 4.0).alias("y"))
    return rounded(joins.nearest_click(a, 40.0, 40.0, 10.0), "distance")


@query(f"""WITH {CLOUD}, t AS (SELECT x, y, unnest(range(floor((x - 1) / 10)::BIGINT, floor((x + 1) / 10)::BIGINT + 1)) AS tx FROM cloud), u AS (SELECT tx, unnest(range(floor((y - 1) / 10)::BIGINT, floor((y + 1) / 10)::BIGINT + 1)) AS ty FROM t) SELECT tx, ty, count(*) AS n FROM u GROUP BY ALL""")
def tiles_with_margin(spark, d):
    return joins.tiles_with_margin(cloud(spark, d), 10.0, 1.0).groupBy("tx", "ty").agg(F.count("*").alias("n"))


@query(f"""WITH {RASTER}, v AS (SELECT col, "row" AS r, row_number() OVER (ORDER BY "row", col) - 1 AS k FROM raster WHERE v IS NOT NULL),
q AS (SELECT a.k AS a, b.k AS b, c.k AS c, e.k AS e FROM v a JOIN v b ON b.col = a.col + 1 AND b.r = a.r JOIN v c ON c.col = a.col AND c.r = a.r + 1 JOIN v e ON e.col = a.col + 1 AND e.r = a.r + 1)
SELECT a, c AS b, b AS c FROM q UNION ALL SELECT b, c, e FROM q""")
def triangles(spark, d):
    return joins.triangles(raster(spark, d))


@query(f"""WITH {RASTER} SELECT a.col, a."row", a.v AS v0, b.v * 2 AS v1 FROM raster a JOIN raster b ON a.col = b.col AND a."row" = b."row" """)
def same_frame(spark, d):
    r = raster(spark, d)
    return joins.same_frame([r, r.withColumn("v", F.col("v") * 2)])


@query("""WITH f AS (SELECT l_suppkey, avg(l_extendedprice) AS m FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT l_orderkey, l_linenumber FROM lineitem l LEFT JOIN f ON f.l_suppkey = l.l_suppkey WHERE l_returnflag = 'N' AND (m IS NULL OR abs(l_extendedprice - m) <= 20000)""")
def blunder_filter(spark, d):
    t = table(spark, d, "lineitem")
    out = joins.blunder_filter(t.filter("l_returnflag = 'N'"), t.filter("l_returnflag = 'A'"), "l_suppkey", "l_extendedprice", 20000.0)
    return out.select("l_orderkey", "l_linenumber")


@query(f"""WITH {CELLS}, a AS (SELECT c_custkey AS id, c_custkey % 40 AS col, c_nationkey AS "row" FROM customer), x AS (SELECT a.id, a.col, a."row", c.v AS dx FROM a JOIN cells c ON c.idx = 0 AND c.col = a.col AND c."row" = a."row" WHERE c.v IS NOT NULL)
SELECT x.id, x.col + (dx % 10) AS rx, h.v AS height FROM x JOIN cells h ON h.idx = 1 AND h.col = x.col + (dx % 10) AND h."row" = x."row" WHERE h.v IS NOT NULL""")
def points_by_disparity(spark, d):
    c = cells(spark, d)
    pts = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40).alias("col"), F.col("c_nationkey").cast("long").alias("row"))
    disparity = c.filter("idx = 0").select("col", "row", (F.col("v") % 10).alias("dx"), F.when(F.col("v").isNotNull(), 0.0).alias("dy"))
    return joins.points_by_disparity(pts, disparity, c.filter("idx = 1").select("col", "row", F.col("v").alias("height"))).select("id", "rx", "height")
