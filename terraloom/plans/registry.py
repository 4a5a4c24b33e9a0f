"""Queries over the driver's tables, each with its SQL twin. Floating results are rounded in both."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terraloom.functions import statistics as S
from terraloom.functions.expressions import calculate, polynomial, postfix
from terraloom.operators import filters, gridding, joins, mosaic, neighbourhood, networks, reports, series, tracks
from terraloom.plans.inputs import CELLS, CLOUD, FILE_ORDER, RASTER, RESIDUALS, cells, cloud, frames, raster, residuals, table

FLAGSHIP = "grid_cloud"
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL twin."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df, *names: str, digits: int = 6):
    """Columns rounded; a negative zero becomes zero."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) + F.lit(0.0) for n in names})


# --- gridding ---------------------------------------------------------------------------------------------------------

_NEAR = f"""{CLOUD}, p AS (SELECT * FROM cloud WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
cx AS (SELECT *, unnest(range(ceil((x - 5) / 5)::BIGINT, floor((x + 5) / 5)::BIGINT + 1)) AS col FROM p),
cy AS (SELECT *, unnest(range(ceil((y - 5) / 5)::BIGINT, floor((y + 5) / 5)::BIGINT + 1)) AS "row" FROM cx),
near AS (SELECT *, sqrt(pow(x - col * 5, 2) + pow(y - "row" * 5, 2)) AS dist FROM cy WHERE sqrt(pow(x - col * 5, 2) + pow(y - "row" * 5, 2)) <= 5)"""


_WEIGHT = "exp(ln(0.25) / 25 * pow(floor(dist / (5.0 / 999) + 0.5) * (5.0 / 999), 2))"


@query(f"""WITH {_NEAR}, a AS (SELECT col, "row", round(sum({_WEIGHT} * z) / sum({_WEIGHT}), 6) AS weighted_average,
round(min(z), 6) AS min, round(max(z), 6) AS max, round(avg(z), 6) AS mean, round(median(z), 6) AS median, round(stddev_pop(z), 6) AS stddev, count(z) AS count, median(z) AS m, round(quantile_cont(z, 0.8), 6) AS p80 FROM near GROUP BY ALL),
n AS (SELECT near.col, near."row", round(1.4826 * median(abs(z - m)), 6) AS nmad FROM near JOIN a ON near.col = a.col AND near."row" = a."row" GROUP BY ALL)
SELECT a.col, a."row", weighted_average, min, max, mean, median, stddev, count, nmad, p80 FROM a JOIN n ON a.col = n.col AND a."row" = n."row" """)
def grid_cloud(spark, d):
    out = gridding.grid(cloud(spark, d), 5.0, 5.0, (*gridding.FILTERS, "80-pct")).withColumnRenamed("80-pct", "p80")
    return rounded(out, "weighted_average", "min", "max", "mean", "median", "stddev", "nmad", "p80")


@query(f"""WITH {CLOUD}, b AS (SELECT quantile_cont(err, 0.25) AS a, quantile_cont(err, 0.75) AS b FROM cloud)
SELECT floor(x / 10)::BIGINT AS col, floor(y / 10)::BIGINT AS "row", count(*) AS n, round(avg(z), 6) AS mean FROM cloud, b
WHERE err >= a - 0.5 * (b - a) AND err <= b + 0.5 * (b - a) GROUP BY ALL""")
def grid_without_outliers(spark, d):
    kept = S.within_brackets(cloud(spark, d), "err", 0.75, 0.5)
    out = kept.groupBy(F.floor(F.col("x") / 10).alias("col"), F.floor(F.col("y") / 10).alias("row")).agg(F.count("*").alias("n"), F.avg("z").alias("mean"))
    return rounded(out, "mean")


@query(f"""WITH {CLOUD} SELECT floor(x / 16)::BIGINT AS bx, floor(y / 16)::BIGINT AS "by", min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM cloud GROUP BY ALL""")
def block_boxes(spark, d):
    return cloud(spark, d).groupBy(F.floor(F.col("x") / 16).alias("bx"), F.floor(F.col("y") / 16).alias("by")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("z").alias("z0"), F.max("z").alias("z1"))


@query(f"""WITH {CLOUD}, b AS (SELECT quantile_cont(x, 0.125) AS xa, quantile_cont(x, 0.875) AS xb, quantile_cont(y, 0.125) AS ya, quantile_cont(y, 0.875) AS yb, quantile_cont(z, 0.0625) AS za, quantile_cont(z, 0.9375) AS zb FROM cloud)
SELECT count(*) AS n, round(sum(z), 4) AS total FROM cloud, b WHERE x BETWEEN xa - 0.1 * (xb - xa) AND xb + 0.1 * (xb - xa) AND y BETWEEN ya - 0.1 * (yb - ya) AND yb + 0.1 * (yb - ya) AND z BETWEEN za - 0.1 * (zb - za) AND zb + 0.1 * (zb - za)""")
def inlier_box(spark, d):
    points = cloud(spark, d)
    kept = filters.inside_box(points, filters.inlier_box(points, 75, 0.05))
    return rounded(kept.agg(F.count("*").alias("n"), F.sum("z").alias("total")), "total", digits=4)


# --- mosaics ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {CELLS}, v AS (SELECT * FROM cells WHERE v IS NOT NULL), m AS (SELECT col, "row", median(v) AS m FROM v GROUP BY ALL)
SELECT v.col, v."row", arg_min(v, idx) AS first, arg_max(v, idx) AS last, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean,
CASE WHEN count(v) > 1 THEN round(stddev_samp(v), 6) END AS stddev, median(v) AS median, count(v) AS count, round(1.4826 * median(abs(v - m)), 6) AS nmad
FROM v JOIN m ON v.col = m.col AND v."row" = m."row" GROUP BY v.col, v."row" """)
def mosaic_all(spark, d):
    return rounded(mosaic.mosaic(cells(spark, d)), "mean", "stddev", "nmad")


@query(f"""WITH {CELLS}, v AS (SELECT * FROM cells WHERE v IS NOT NULL), m AS (SELECT col, "row", median(v) AS m FROM v GROUP BY ALL),
r AS (SELECT v.col, v."row", idx, row_number() OVER (PARTITION BY v.col, v."row" ORDER BY v, idx) AS a, row_number() OVER (PARTITION BY v.col, v."row" ORDER BY v DESC, idx) AS b,
row_number() OVER (PARTITION BY v.col, v."row" ORDER BY abs(v - m), idx) AS c FROM v JOIN m ON v.col = m.col AND v."row" = m."row")
SELECT col, "row", max(CASE WHEN a = 1 THEN idx END) AS min_idx, max(CASE WHEN b = 1 THEN idx END) AS max_idx, max(CASE WHEN c = 1 THEN idx END) AS median_idx FROM r GROUP BY ALL""")
def mosaic_index_map(spark, d):
    return mosaic.index_map(cells(spark, d))


@query(f"""WITH {CELLS}, t AS (SELECT floor(col / 8)::BIGINT AS tx, floor("row" / 8)::BIGINT AS ty, idx, sum(v) AS total FROM cells GROUP BY ALL HAVING sum(v) IS NOT NULL)
SELECT tx, ty, idx, total FROM (SELECT *, row_number() OVER (PARTITION BY tx, ty ORDER BY total DESC, idx) AS r FROM t) WHERE r = 1""")
def mosaic_block_max(spark, d):
    return mosaic.block_max(cells(spark, d), 8)


@query(f"""WITH {CELLS}, w AS (SELECT *, 1.0 / (1 + idx) AS w FROM cells WHERE v IS NOT NULL)
SELECT col, "row", round(sum(w * v) / sum(w), 6) AS blend, round(sum(CASE WHEN idx = 0 THEN w ELSE 0 END) / sum(w), 6) AS first_share FROM w GROUP BY ALL""")
def mosaic_blend(spark, d):
    return rounded(mosaic.blend(cells(spark, d).withColumn("w", 1.0 / (1 + F.col("idx"))), "w"), "blend", "first_share")


@query(f"""WITH {CELLS} SELECT col, "row", CASE WHEN count(v) = count(*) THEN round(avg(v), 6) END AS mean FROM cells GROUP BY ALL""")
def mosaic_holes(spark, d):
    return rounded(mosaic.propagate_holes(cells(spark, d)), "mean")


# --- expressions ------------------------------------------------------------------------------------------------------

_PAIR = f"""{CELLS}, pair AS (SELECT a.col, a."row", a.v AS a, b.v AS b FROM cells a JOIN cells b ON a.col = b.col AND a."row" = b."row" WHERE a.idx = 0 AND b.idx = 1)"""


def _pair(spark, d):
    all_ = cells(spark, d)
    a = all_.filter("idx = 0").select("col", "row", F.col("v").alias("a"))
    return a.join(all_.filter("idx = 1").select("col", "row", F.col("v").alias("b")), ["col", "row"])


@query(f"""WITH {_PAIR} SELECT col, "row", CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round(a - (b - (2 * (a / nullif(b * 4, 0)))), 6) END AS right_grouped,
CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a < b THEN least(a, b, 900) ELSE -abs(b) END END AS chosen FROM pair""")
def image_expression(spark, d):
    v = {"var_0": F.col("a"), "var_1": F.col("b")}
    out = _pair(spark, d).select("col", "row", calculate("var_0 - var_1 - 2 * var_0 / var_1 * 4", v).alias("right_grouped"), calculate("lt(var_0, var_1, min(var_0, var_1, 900), -abs(var_1))", v).alias("chosen"))
    return rounded(out, "right_grouped")


@query("""SELECT l_orderkey, l_linenumber, round(3 * l_discount * l_discount + 1, 9) AS square, round(sin(l_discount) * 4 + l_discount, 9) AS wave, round(1 - 0.5 * l_tax + 2 * l_tax * l_tax, 9) AS poly FROM lineitem""")
def ephemeris_equations(spark, d):
    t = table(spark, d, "lineitem")
    out = t.select("l_orderkey", "l_linenumber", postfix("3 t t * * 1 +", F.col("l_discount")).alias("square"), postfix("t sin 4 * t +", F.col("l_discount")).alias("wave"), polynomial([1, -0.5, 2], F.col("l_tax")).alias("poly"))
    return rounded(out, "square", "wave", "poly", digits=9)


@query(f"""WITH {CELLS}, k AS (SELECT idx, list_sort(list(v)) AS s FROM cells WHERE v IS NOT NULL GROUP BY idx),
s AS (SELECT idx, s[floor(0.02 * len(s))::BIGINT + 1] AS lo, s[least(floor(0.98 * len(s))::BIGINT, len(s) - 1) + 1] AS hi FROM k)
SELECT cells.idx, col, "row", CASE WHEN v IS NULL THEN 0 ELSE greatest(0, least(255, floor((v - lo) / (hi - lo) * 255 + 0.5))) END::SMALLINT AS stretched FROM cells LEFT JOIN s ON cells.idx = s.idx""")
def percentile_stretch(spark, d):
    return reports.percentile_stretch(cells(spark, d))


# --- differences and summaries ----------------------------------------------------------------------------------------


@query(f"""WITH {_PAIR}, d AS (SELECT abs(a - b) AS v FROM pair WHERE a IS NOT NULL AND b IS NOT NULL), s AS (SELECT list_sort(list(v)) AS s FROM d)
SELECT max(v) AS max, min(v) AS min, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stddev, any_value(s[len(s) // 2 + 1]) AS median, count(*) AS n FROM d, s""")
def difference_summary(spark, d):
    all_ = cells(spark, d)
    diff = joins.raster_difference(all_.filter("idx = 0"), all_.filter("idx = 1"), absolute=True)
    return rounded(reports.difference_summary(diff, "diff"), "mean", "stddev")


_POINTS = "pts AS (SELECT s_suppkey AS id, s_suppkey * 0.97::DOUBLE AS px, (s_suppkey * 3 % 290) / 10.0::DOUBLE AS py FROM supplier)"


@query(f"""WITH {RASTER}, {_POINTS}, q AS (SELECT *, floor(px)::BIGINT AS c, floor(py)::BIGINT AS r, px - floor(px) AS fx, py - floor(py) AS fy FROM pts)
SELECT q.id, round(CASE WHEN (1 - fx) * (1 - fy) = 0 THEN 0 ELSE (1 - fx) * (1 - fy) * a.v END + CASE WHEN (1 - fx) * fy = 0 THEN 0 ELSE (1 - fx) * fy * b.v END
+ CASE WHEN fx * (1 - fy) = 0 THEN 0 ELSE fx * (1 - fy) * c.v END + CASE WHEN fx * fy = 0 THEN 0 ELSE fx * fy * e.v END, 5) AS value
FROM q LEFT JOIN raster a ON a.col = q.c AND a."row" = q.r LEFT JOIN raster b ON b.col = q.c AND b."row" = q.r + 1
LEFT JOIN raster c ON c.col = q.c + 1 AND c."row" = q.r LEFT JOIN raster e ON e.col = q.c + 1 AND e."row" = q.r + 1""")
def bilinear_lookup(spark, d):
    pts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 0.97).alias("px"), (F.col("s_suppkey") * 3 % 290 / 10.0).alias("py"))
    return rounded(joins.bilinear(pts, raster(spark, d)).select("id", "value"), "value", digits=5)


@query(f"""WITH {RESIDUALS}, s AS (SELECT cid, list_sort(list(resid)) AS s, avg(resid) AS mean FROM res GROUP BY cid) SELECT cid, round(mean, 6) AS mean, round(s[len(s) // 2 + 1], 6) AS median, len(s) AS n FROM s""")
def camera_residuals(spark, d):
    return rounded(reports.camera_report(residuals(spark, d), "resid", ["cid"]), "mean", "median")


@query(f"WITH {RESIDUALS} SELECT pid, round(avg(resid), 6) AS mean_residual, count(*) AS num_observations FROM res GROUP BY pid")
def point_residuals(spark, d):
    return rounded(reports.point_report(residuals(spark, d), "resid", "pid"), "mean_residual")


_PERCENTS = ", ".join(f"round(s[least(floor({p / 100} * len(s))::BIGINT, len(s) - 1) + 1], 6) AS p{p}" for p in (25, 50, 75, 85, 95))


@query(f"""WITH s AS (SELECT l_suppkey AS left_image, l_linenumber::BIGINT AS right_image, list_sort(list(l_discount * 100)) AS s FROM lineitem GROUP BY ALL)
SELECT left_image, right_image, {_PERCENTS}, len(s) AS num FROM s""")
def pair_percentiles(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("left_image"), F.col("l_linenumber").cast("long").alias("right_image"), (F.col("l_discount") * 100).alias("v"))
    return rounded(reports.percentile_report(t, "v", ["left_image", "right_image"]), "p25", "p50", "p75", "p85", "p95")


@query(f"""WITH p AS (SELECT l_suppkey AS image, l_discount * 100 AS v FROM lineitem UNION ALL SELECT l_partkey, l_discount * 100 FROM lineitem),
s AS (SELECT image, list_sort(list(v)) AS s FROM p GROUP BY ALL) SELECT image, {_PERCENTS}, len(s) AS num FROM s""")
def image_percentiles(spark, d):
    t = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_discount") * 100).alias("v"))
    return rounded(reports.percentile_report(reports.both_sides(t, "l_suppkey", "l_partkey", "v"), "v", ["image"]), "p25", "p50", "p75", "p85", "p95")


@query(f"""WITH {RESIDUALS}, p AS (SELECT pid, avg(resid) AS m, count(*) = 1 AS gcp FROM res GROUP BY pid), b AS (SELECT quantile_cont(m, 0.25) AS a, quantile_cont(m, 0.75) AS b FROM p WHERE NOT gcp)
SELECT pid, round(m, 6) AS m FROM p, b WHERE NOT gcp AND m > least(6, greatest(3, b + 3 * (b - a)))""")
def adjustment_outliers(spark, d):
    # a mean at the cutoff falls by the roundings of its sum: in the order of the file, as SQL adds in one thread
    means = S.ordered_means(residuals(spark, d, placed=True), "resid", ["pid"], FILE_ORDER, "m").select("pid", "m", (F.col("n") == 1).alias("gcp"))
    return rounded(filters.adjustment_outliers(means, "m", 75, 3, 3, 6, "gcp").select("pid", "m"), "m")


@query("""WITH b AS (SELECT least(floor((l_quantity - 1) / 5.0), 11)::BIGINT AS bin, l_extendedprice AS v FROM lineitem WHERE l_quantity BETWEEN 1 AND 61)
SELECT r.bin, coalesce(round(avg(v), 4), 0) AS mean, count(v) AS n, coalesce(round(median(v), 4), 0) AS median FROM (SELECT unnest(range(12)) AS bin) r LEFT JOIN b ON b.bin = r.bin GROUP BY r.bin""")
def binned_statistics(spark, d):
    return rounded(reports.binned_statistics(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 12, 1.0, 61.0), "mean", "median", digits=4)


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
h AS (SELECT greatest(0, least(floor((l_extendedprice - lo) / (hi - lo) * 256), 255))::BIGINT AS bin, lo, hi, count(*) AS n FROM lineitem, e GROUP BY ALL),
c AS (SELECT bin, lo, hi, sum(n) OVER (ORDER BY bin) AS below, sum(n * bin) OVER (ORDER BY bin) AS mass, sum(n) OVER () AS total, sum(n * bin) OVER () AS all_mass FROM h),
v AS (SELECT bin, lo, hi, pow(all_mass::DOUBLE * below / total - mass, 2) / (below::DOUBLE * (total - below)) AS between_var FROM c WHERE below < total)
SELECT round(lo + (bin + 1) * (hi - lo) / 256, 6) AS threshold FROM v ORDER BY round(between_var, 6) DESC, bin LIMIT 1""")
def otsu_threshold(spark, d):
    return rounded(reports.otsu_threshold(table(spark, d, "lineitem"), "l_extendedprice"), "threshold")


@query(f"""WITH {RESIDUALS}, r AS (SELECT resid, row_number() OVER (ORDER BY resid) AS k, count(*) OVER () AS n, median(resid) OVER () AS m FROM res)
SELECT {", ".join(f"round(avg(CASE WHEN k <= {q} * n // 4 THEN resid END), 6) AS best{25 * q}" for q in (1, 2, 3, 4))}, {", ".join(f"round(min(CASE WHEN k = least(floor({p / 100} * n + 0.5), n - 1) + 1 THEN resid END), 6) AS p{p}" for p in (16, 84))},
round(median(resid), 6) AS p50, round(median(resid), 6) AS median, round(avg(resid), 6) AS mean, round(stddev_pop(resid), 6) AS stddev, round(sqrt(avg(resid * resid)), 6) AS rmse, round(1.4826 * median(abs(resid - m)), 6) AS nmad FROM r""")
def error_summary(spark, d):
    out = reports.error_summary(residuals(spark, d), "resid")
    return rounded(out, *out.columns)


@query("""WITH c AS (SELECT l_suppkey AS camera, l_discount * 100 - 1 AS v FROM lineitem)
SELECT camera, count(*) FILTER (WHERE v < 0) AS masked, count(*) FILTER (WHERE v = 0 OR v >= 8) AS invalid, round(count(*) FILTER (WHERE v > 0 AND v < 8) / count(*) FILTER (WHERE v >= 0)::DOUBLE, 6) AS valid_fraction FROM c GROUP BY 1""")
def coverage_fraction(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("camera"), (F.col("l_discount") * 100 - 1).alias("v"))
    return rounded(reports.coverage(t, "v", 8.0, ["camera"]), "valid_fraction")


@query(f"""WITH {CLOUD} SELECT round(covar_pop(x, y), 4) AS xy, round(covar_pop(x, z), 4) AS xz, round(covar_pop(y, z), 4) AS yz, round(var_pop(x), 4) AS xx, round(var_pop(y), 4) AS yy, round(var_pop(z), 4) AS zz, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM cloud""")
def plane_sums(spark, d):
    p = cloud(spark, d)
    out = p.agg(*(F.covar_pop(a, b).alias(a + b) for a, b in (("x", "y"), ("x", "z"), ("y", "z"))), *(F.var_pop(a).alias(a + a) for a in "xyz"), *(F.avg(a).alias("c" + a) for a in "xyz"))
    return rounded(rounded(out, "xy", "xz", "yz", "xx", "yy", "zz", digits=4), "cx", "cy", "cz")


# --- joins ------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, max(event_id) AS ref FROM events WHERE event_type <> 'click' GROUP BY ALL)
SELECT c.event_id, b.ref AS before, f.ref AS after FROM c ASOF LEFT JOIN v b ON c.user_id = b.user_id AND c.ts >= b.ts ASOF LEFT JOIN v f ON c.user_id = f.user_id AND c.ts <= f.ts""")
def time_brackets(spark, d):
    f = frames(spark, d)
    asked, ref = f.filter("sensor = 'click'").select("event_id", "user_id", "ts"), f.filter("sensor <> 'click'").select("user_id", "ts", F.col("event_id").alias("ref"))
    out = joins.as_of(joins.as_of(asked, ref, ["user_id"], "ts", "ref", "before"), ref, ["user_id"], "ts", "ref", "after", forward=True)
    return out.select("event_id", "before", "after")


@query("SELECT a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON b.s_suppkey > a.s_suppkey AND b.s_suppkey <= a.s_suppkey + 5")
def image_pairs(spark, d):
    return joins.band_pairs(table(spark, d, "supplier"), "s_suppkey", 5)


_BOXES = "boxes AS (SELECT c_custkey AS id, c_acctbal AS x0, c_acctbal + 60 AS x1, c_nationkey * 10.0::DOUBLE AS y0, c_nationkey * 10.0::DOUBLE + 12 AS y1 FROM customer)"


@query(f"WITH {_BOXES} SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def footprint_overlaps(spark, d):
    boxes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x0"), (F.col("c_acctbal") + 60).alias("x1"), (F.col("c_nationkey") * 10.0).alias("y0"), (F.col("c_nationkey") * 10.0 + 12).alias("y1"))
    return joins.box_overlaps(boxes, 60.0)


@query("SELECT a.l_suppkey AS c1, b.l_suppkey AS c2, count(*) AS matches FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL")
def track_pairs(spark, d):
    return networks.track_pairs(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p_size < 10)")
def inlier_matches(spark, d):
    kept, out = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'"), table(spark, d, "part").filter("p_size < 10")
    t = table(spark, d, "lineitem")
    return t.join(kept, t["l_orderkey"] == kept["o_orderkey"], "left_semi").join(out, t["l_partkey"] == out["p_partkey"], "left_anti").select("l_orderkey", "l_linenumber")


# --- neighbourhoods ---------------------------------------------------------------------------------------------------


@query(f"""WITH {RASTER}, s AS (SELECT a.col, a."row", list_sort(list(b.v)) AS s FROM raster a JOIN raster b ON abs(a.col - b.col) <= 1 AND abs(a."row" - b."row") <= 1 WHERE b.v IS NOT NULL GROUP BY ALL)
SELECT raster.col, raster."row", CASE WHEN len(s) >= 3 THEN s[len(s) // 2 + 1] END AS median FROM raster LEFT JOIN s ON raster.col = s.col AND raster."row" = s."row" """)
def median_filter(spark, d):
    return neighbourhood.median_filter(raster(spark, d), 1, 3)


@query(f"""WITH {RASTER} SELECT a.col, a."row", a.v FROM raster a WHERE v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raster b WHERE b.v IS NULL AND abs(a.col - b.col) <= 1 AND abs(a."row" - b."row") <= 1)""")
def erosion(spark, d):
    return neighbourhood.erode(raster(spark, d), 1)


@query(f"""WITH {RASTER} SELECT DISTINCT col + dx AS col, "row" + dy AS "row" FROM raster, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy) WHERE v IS NOT NULL AND dx * dx + dy * dy <= 4""")
def mask_dilation(spark, d):
    return neighbourhood.dilate(raster(spark, d), 2)


@query(f"""WITH {RASTER}, v AS (SELECT *, min(col) OVER a AS l, max(col) OVER a AS r, min("row") OVER b AS t, max("row") OVER b AS u FROM raster WHERE v IS NOT NULL WINDOW a AS (PARTITION BY "row"), b AS (PARTITION BY col)),
h AS (SELECT *, (r - l) / 2.0::DOUBLE AS hx, (u - t) / 2.0::DOUBLE AS hy FROM v)
SELECT col, "row", v, round(CASE WHEN hx > 0 THEN least(greatest(0, hx - abs(col - (l + r) / 2.0::DOUBLE) + 1e-8 * hx), 8) ELSE 0 END * CASE WHEN hy > 0 THEN least(greatest(0, hy - abs("row" - (t + u) / 2.0::DOUBLE) + 1e-8 * hy), 8) ELSE 0 END, 6) AS weight FROM h""")
def centreline_weights(spark, d):
    return rounded(neighbourhood.centreline_weight(raster(spark, d), 8.0), "weight")


@query(f"""WITH {RASTER}, v AS (SELECT * FROM raster WHERE v IS NOT NULL), g AS (SELECT a.col, a."row", e.v - w.v AS dx, s.v - n.v AS dy FROM v a JOIN v w ON w.col = a.col - 1 AND w."row" = a."row" JOIN v e ON e.col = a.col + 1 AND e."row" = a."row"
JOIN v n ON n.col = a.col AND n."row" = a."row" - 1 JOIN v s ON s.col = a.col AND s."row" = a."row" + 1), t AS (SELECT *, degrees(atan2(dy, -dx)) AS t FROM g)
SELECT col, "row", round(degrees(atan(sqrt(dx * dx + dy * dy) / 200)), 6) AS slope, CASE WHEN dx <> 0 OR dy <> 0 THEN round(CASE WHEN t > 90 THEN 450 - t ELSE 90 - t END - CASE WHEN CASE WHEN t > 90 THEN 450 - t ELSE 90 - t END >= 360 THEN 360 ELSE 0 END, 6) END AS aspect FROM t""")
def slope_aspect(spark, d):
    return rounded(neighbourhood.slope_aspect(raster(spark, d), 100.0), "slope", "aspect")


@query(f"""WITH {RASTER} SELECT col, "row", round(avg(v) OVER (PARTITION BY col ORDER BY "row" RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS average FROM raster""")
def moving_average(spark, d):
    return rounded(neighbourhood.moving_average(raster(spark, d), ["col"], "row", "v", 2).select("col", "row", "average"), "average")


# --- tracks, sets, order ----------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT o_orderkey AS a, 1000000000000 + o_orderkey // 7 AS b FROM orders), g AS (SELECT b, min(a) AS track FROM e GROUP BY b)
SELECT a AS node, track FROM e JOIN g ON e.b = g.b UNION SELECT b, track FROM g""")
def match_tracks(spark, d):
    """All orders, each matched with the seventh of the keys it falls in: components are known, so the twin needs no recursion."""
    links = table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), F.expr("1000000000000 + o_orderkey div 7").alias("b"))
    return tracks.tracks(links)


@query("""WITH n AS (SELECT DISTINCT o_custkey AS node, 0::BIGINT AS image, o_custkey AS track FROM orders UNION ALL
SELECT 1000000000000 + o_orderkey, 1 + year(o_orderdate)::BIGINT * 12 + month(o_orderdate)::BIGINT, o_custkey FROM orders)
SELECT track, node, image FROM n WHERE track IN (SELECT track FROM n GROUP BY track HAVING count(*) = count(DISTINCT image) AND count(*) >= 2)""")
def kept_tracks(spark, d):
    """All orders under their own keys, without conflicting tracks: an order's image is its month. Each order has one customer, so the twin needs no recursion."""
    orders = table(spark, d, "orders").withColumn("b", F.lit(1000000000000) + F.col("o_orderkey"))
    found = tracks.tracks(orders.select(F.col("o_custkey").alias("a"), "b"))
    images = orders.select(F.col("b").alias("node"), (1 + F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("image"))
    images = images.unionByName(orders.select(F.col("o_custkey").alias("node"), F.lit(0).cast("long").alias("image")).distinct())
    return tracks.without_conflicts(found.join(images, "node")).select("track", "node", "image")


@query("SELECT k AS length, count(*) AS tracks FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) = count(DISTINCT l_suppkey) AND count(*) >= 2) GROUP BY k")
def track_lengths(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("length"), F.count("*").alias("n"))
    return t.filter("n = length AND n >= 2").groupBy("length").agg(F.count("*").alias("tracks"))


@query("SELECT DISTINCT least(a, b) AS i, greatest(a, b) AS j FROM (SELECT l_suppkey AS a, l_partkey % 100 + 1 AS b FROM lineitem UNION ALL SELECT l_partkey % 100 + 1, l_suppkey FROM lineitem) WHERE a <> b")
def pair_closure(spark, d):
    return networks.pair_closure(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100 + 1).alias("b")))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def unseen_cameras(spark, d):
    """Customers without the reference cameras, those with an urgent order."""
    seen = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").subtract(seen)


@query("SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events")
def consecutive_frames(spark, d):
    return series.consecutive(frames(spark, d), ["user_id"], ["ts", "event_id"], "event_id", "next_id").select("user_id", "event_id", "next_id")


@query("SELECT date_trunc('hour', ts) AS hour, event_type AS sensor, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def frames_per_hour(spark, d):
    out = frames(spark, d).groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "sensor").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(out, "total", digits=4)


from terraloom.plans import alignment, composites, matches, matching, more, rasters, stereo, summaries, surfaces  # noqa: E402,F401  they register their queries
