"""Queries over reports, normalisation, outlier filters and series, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions import statistics as S
from terraloom.operators import filters, reports, series
from terraloom.plans.inputs import CELLS, CLOUD, RASTER, RESIDUALS, cells, cloud, raster, residuals, table
from terraloom.plans.registry import _PAIR, _pair, query, rounded


def _sorted(value: str, source: str, keys: str = "") -> str:
    """SQL: the sorted list s of a value in each group."""
    return f"SELECT {keys + ',' if keys else ''} list_sort(list({value})) AS s FROM {source} WHERE {value} IS NOT NULL {'GROUP BY ' + keys if keys else ''}"


def _at(p: float) -> str:
    """SQL: element floor(p * n) of s."""
    return f"s[least(floor({p} * len(s))::BIGINT, len(s) - 1) + 1]"


_STATS = f"""k AS ({_sorted("v", "cells", "idx")}), m AS (SELECT idx, median(v) AS m FROM cells GROUP BY idx),
stats AS (SELECT c.idx, min(v) AS min, max(v) AS max, any_value(m) AS median, 1.4826 * median(abs(v - m)) AS nmad, any_value({_at(0.02)}) AS p2, any_value({_at(0.98)}) AS p98 FROM cells c JOIN m ON m.idx = c.idx JOIN k ON k.idx = c.idx GROUP BY c.idx)"""


@query(f"WITH {CELLS}, {_STATS} SELECT idx, min, max, median, round(nmad, 6) AS nmad, p2, p98 FROM stats")
def image_statistics(spark, d):
    return rounded(reports.image_statistics(cells(spark, d)), "nmad")


@query(f"""WITH {CELLS}, {_STATS}, g AS (SELECT min(median - 2 * nmad) AS lo, max(median + 2 * nmad) AS hi FROM stats)
SELECT c.idx, col, "row", round((v - greatest(lo, min)) / (least(hi, max) - greatest(lo, min)), 6) AS v FROM cells c JOIN stats ON stats.idx = c.idx, g""")
def normalised_images(spark, d):
    c = cells(spark, d)
    return rounded(reports.normalised(c, reports.normalisation_bounds(reports.image_statistics(c), stay_inside=True)), "v")


@query(f"""WITH {CELLS}, {_STATS} SELECT idx, (SELECT min(p2) FROM stats) AS lo, (SELECT max(p98) FROM stats) AS hi FROM stats""")
def combined_bounds(spark, d):
    return reports.normalisation_bounds(reports.image_statistics(cells(spark, d)), percentiles=True)


@query(f"""WITH {CELLS}, c AS (SELECT v, median(v) OVER () AS m FROM cells WHERE idx = 1 AND v IS NOT NULL)
SELECT count(*) AS count, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stddev, round(median(v), 6) AS median, round(1.4826 * median(abs(v - m)), 6) AS nmad FROM c""")
def masked_statistics(spark, d):
    return rounded(reports.masked_statistics(cells(spark, d).filter("idx = 1"), "v"), "mean", "stddev", "median", "nmad")


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT greatest(0, least(floor((l_extendedprice - lo) / (hi - lo) * 1024), 1023))::BIGINT AS bin, lo, hi, count(*) AS n FROM lineitem, e GROUP BY ALL""")
def error_histogram(spark, d):
    return reports.histogram(table(spark, d, "lineitem"), "l_extendedprice", 1024)


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
h AS (SELECT greatest(0, least(floor((l_extendedprice - lo) / (hi - lo) * 1024), 1023))::BIGINT AS bin, lo, hi, count(*) AS n FROM lineitem, e GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h) SELECT round(max(lo) + (min(bin) + 1) * (max(hi) - max(lo)) / 1024, 6) AS value FROM c WHERE upto >= 0.75 * total""")
def histogram_percentile(spark, d):
    return rounded(reports.histogram_percentile(reports.histogram(table(spark, d, "lineitem"), "l_extendedprice", 1024), 0.75, 1024), "value")


_MODES = "(SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 8 ELSE 16 END + l_quantity % 3 AS v FROM lineitem)"


@query(f"""WITH c AS (SELECT floor(v / 0.01 + 0.5)::BIGINT AS k, count(*) AS n FROM {_MODES} GROUP BY 1),
d AS (SELECT i, 0.0::DOUBLE + i * (17.0::DOUBLE / 199) AS "at", sum(n * exp(-0.5 * pow((0.0::DOUBLE + i * (17.0::DOUBLE / 199) - k * 0.01::DOUBLE) / 1, 2))) AS d FROM c, (SELECT unnest(range(200)) AS i) GROUP BY i)
SELECT round("at", 6) AS "at" FROM (SELECT *, lag(d) OVER (ORDER BY i) AS a, lead(d) OVER (ORDER BY i) AS b FROM d) WHERE d < a AND d < b ORDER BY i LIMIT 1""")
def density_minimum(spark, d):
    mode = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 8).otherwise(16)
    t = table(spark, d, "lineitem").select((mode + F.col("l_quantity") % 3).alias("v"))
    return rounded(reports.density_minimum(t, "v", 200, 1.0, 0.0, 17.0), "at")


@query(f"""WITH {CLOUD}, k AS ({_sorted("err", "(SELECT err FROM cloud WHERE err > 0)")}) SELECT {_at(0.25)} AS q1, {_at(0.5)} AS q2, {_at(0.75)} AS q3, round(3 * {_at(0.75)}, 6) AS cutoff FROM k""")
def error_cutoff(spark, d):
    return rounded(reports.error_cutoff(cloud(spark, d), "err", 75, 3.0), "cutoff")


@query(f"""WITH {CLOUD}, k AS ({_sorted("err", "(SELECT err FROM cloud WHERE err > 0)")}) SELECT {_at(0.25)} AS q1, {_at(0.5)} AS q2, {_at(0.75)} AS q3, round({_at(0.75)} + 1.5 * ({_at(0.75)} - {_at(0.25)}), 6) AS cutoff FROM k""")
def tukey_cutoff(spark, d):
    return rounded(reports.error_cutoff(cloud(spark, d), "err", 75, 3.0, tukey=True), "cutoff")


@query("""SELECT c_custkey, coalesce(round(avg(o_totalprice), 4), 'nan'::DOUBLE) AS mean, coalesce(round(median(o_totalprice), 4), 'nan'::DOUBLE) AS median, count(o_totalprice) AS count
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON o_custkey = c_custkey GROUP BY c_custkey""")
def offset_report(spark, d):
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return rounded(reports.offset_report(table(spark, d, "customer"), o, "c_custkey", "o_totalprice"), "mean", "median", digits=4)


@query("""SELECT l_suppkey AS a, l_partkey AS b, round(median(l_tax), 6) AS median, round(avg(l_tax), 6) AS mean, coalesce(round(stddev_samp(l_tax), 6), 0) AS stddev, count(*) AS n FROM lineitem GROUP BY ALL""")
def pair_errors(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), "l_tax")
    return rounded(reports.pair_errors(t, ["a", "b"], "l_tax"), "median", "mean", "stddev")


@query("""SELECT l_suppkey AS camera, round(max(sqrt(l_quantity * l_quantity + l_discount * l_discount)), 6) AS horizontal, max(abs(l_tax - 0.05)) AS vertical FROM lineitem GROUP BY 1""")
def largest_changes(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("camera"), F.col("l_quantity").alias("north"), F.col("l_discount").alias("east"), (F.col("l_tax") - 0.05).alias("down"))
    return rounded(reports.largest_changes(t, "camera"), "horizontal")


@query(f"""WITH {CLOUD}, t AS (SELECT floor(floor(x) / 8)::BIGINT AS tx, floor(floor(y) / 8)::BIGINT AS ty, count(*) AS n FROM cloud GROUP BY ALL) SELECT round(count(*) / 72.0::DOUBLE, 9) AS fraction FROM t WHERE tx BETWEEN 0 AND 11 AND ty BETWEEN 0 AND 5 AND n > 100""")
def tile_coverage(spark, d):
    return rounded(reports.tile_coverage(cloud(spark, d), 100, 50, 8, 100), "fraction", digits=9)


@query("""WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem) SELECT round(avg(v), 4) AS mean FROM r WHERE k >= floor(0.25 * n) AND k < ceil(0.75 * n)""")
def trimmed_mean(spark, d):
    return rounded(reports.trimmed_mean(table(spark, d, "lineitem"), "l_extendedprice"), "mean", digits=4)


@query(f"""WITH {CLOUD}, t AS (SELECT median(x) AS x, median(y) AS y, median(z) AS z FROM cloud GROUP BY floor(x / 10), floor(y / 10)) SELECT round(median(x), 6) AS x, round(median(y), 6) AS y, round(median(z), 6) AS z FROM t""")
def cloud_centre(spark, d):
    return rounded(reports.tile_medians(cloud(spark, d), 10.0), "x", "y", "z")


@query(f"""WITH {_PAIR} SELECT round(avg(a), 6) AS mean_a, round(stddev_pop(a), 6) AS std_a, round(avg(b), 6) AS mean_b, round(stddev_pop(b), 6) AS std_b, count(*) AS n FROM pair WHERE a IS NOT NULL AND b IS NOT NULL""")
def joint_statistics(spark, d):
    return rounded(reports.joint_statistics(_pair(spark, d), "a", "b"), "mean_a", "std_a", "mean_b", "std_b")


@query("""WITH p AS (SELECT max(l_tax) AS max, min(l_tax) AS min, avg(l_tax) AS mean, stddev_pop(l_tax) AS stddev FROM lineitem GROUP BY l_suppkey) SELECT max(max) AS max, min(min) AS min, round(avg(mean), 6) AS mean, round(avg(stddev), 6) AS stddev FROM p""")
def merged_summaries(spark, d):
    parts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_tax").alias("max"), F.min("l_tax").alias("min"), F.avg("l_tax").alias("mean"), F.stddev_pop("l_tax").alias("stddev"))
    return rounded(reports.merged_summaries(parts), "mean", "stddev")


@query("SELECT floor(min(l_quantity * 1.3))::BIGINT AS x0, floor(min(l_tax * 10 - 0.3))::BIGINT AS y0, ceil(max(l_quantity * 1.3))::BIGINT AS x1, ceil(max(l_tax * 10 - 0.3))::BIGINT AS y1 FROM lineitem")
def disparity_range(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_quantity") * 1.3).alias("dx"), (F.col("l_tax") * 10 - 0.3).alias("dy"))
    return reports.disparity_range(t, "dx", "dy")


@query(f"""WITH {CLOUD} SELECT round(avg(y) - avg(x), 6) AS dx, round(avg(z) - avg(y), 6) AS dy, round(avg(err) - avg(z), 6) AS dz FROM cloud""")
def centroid_shift(spark, d):
    p = cloud(spark, d)
    return rounded(reports.centroid_shift(p, p.select(F.col("y").alias("x"), F.col("z").alias("y"), F.col("err").alias("z"))), "dx", "dy", "dz")


@query(f"""WITH {CLOUD} SELECT {", ".join(f"round(covar_pop({a}, {b}), 4) AS s{i}{j}" for i, a in enumerate("xyz") for j, b in enumerate(("y", "z", "err")))}, round(var_pop(x) + var_pop(y) + var_pop(z), 4) AS var_left, round(var_pop(y) + var_pop(z) + var_pop(err), 4) AS var_right FROM cloud""")
def transform_sums(spark, d):
    out = reports.cross_covariance(cloud(spark, d), ("x", "y", "z"), ("y", "z", "err"))
    return rounded(out, *out.columns, digits=4)


@query(f"""WITH {CLOUD} SELECT round(max(abs(0.1 * x - y + 0.2 * z - 3)), 6) AS max, round(avg(abs(0.1 * x - y + 0.2 * z - 3)), 6) AS mean, count(*) FILTER (WHERE abs(0.1 * x - y + 0.2 * z - 3) <= 5) AS inliers FROM cloud""")
def plane_distances(spark, d):
    return rounded(reports.plane_distances(cloud(spark, d), (0.1, -1.0, 0.2), 3.0, 5.0), "max", "mean")


_ASPECT = "b AS (SELECT floor(l_quantity)::BIGINT * 7 AS aspect, avg(l_tax) AS value, count(*) AS n FROM lineitem GROUP BY 1)"


@query(f"""WITH {_ASPECT}, t AS (SELECT cos(radians(aspect)) AS c, sin(radians(aspect)) AS s, value AS v, n FROM b)
SELECT round(sum(n * c * c), 4) AS cc, round(sum(n * c * s), 4) AS cs, round(sum(n * s * s), 4) AS ss, round(sum(n * c), 4) AS c, round(sum(n * s), 4) AS s, sum(n)::DOUBLE AS one, round(sum(n * c * v), 4) AS cv, round(sum(n * s * v), 4) AS sv, round(sum(n * v), 4) AS v FROM t""")
def aspect_sums(spark, d):
    b = table(spark, d, "lineitem").groupBy((F.floor("l_quantity") * 7).alias("aspect")).agg(F.avg("l_tax").alias("value"), F.count("*").alias("n"))
    out = reports.fit_aspect(b)
    return rounded(out, *out.columns, digits=4)


# --- filters ----------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS r0, l_quantity * 100 AS r1, l_partkey AS r2, l_tax AS n0, l_discount AS n1, 1.0::DOUBLE AS n2, l_tax * 100 AS err FROM lineitem),
a AS (SELECT *, sqrt(r0 * r0 + r1 * r1 + r2 * r2) AS s, degrees(acos(greatest(-1, least(1, (r0 * n0 + r1 * n1 + r2 * n2) / (sqrt(n0 * n0 + n1 * n1 + n2 * n2) * sqrt(r0 * r0 + r1 * r1 + r2 * r2)))))) AS t FROM p)
SELECT l_orderkey, l_linenumber, round(1e9 / (s * s), 6) AS weight FROM a WHERE err <= 6 AND s <= 60000 AND least(t, 180 - t) <= 87""")
def cloud_chain(spark, d):
    t = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("z"), (F.col("l_tax") * 100).alias("err"),
        F.array(F.col("l_extendedprice"), F.col("l_quantity") * 100, F.col("l_partkey").cast("double")).alias("ray"), F.array("l_tax", "l_discount", F.lit(1.0)).alias("normal"),
    )
    out = filters.cloud_chain(t, most_error=6, most_distance=60000, ray_to_normal=87, distance_power=2)
    return rounded(out.select("l_orderkey", "l_linenumber", (F.col("weight") * 1e9).alias("weight")), "weight")


@query("""SELECT l_orderkey, l_linenumber, round(exp(-l_tax / 0.03), 9) AS reliability, round(pow(least(l_quantity / 20, 1), 1.5), 9) AS border, CASE WHEN l_quantity BETWEEN 5 AND 40 THEN l_quantity END AS ranged,
CASE WHEN l_discount > 0.02 THEN l_discount END AS above, CASE WHEN l_tax > 0 THEN l_quantity END AS weighted FROM lineitem""")
def weights_and_limits(spark, d):
    t = table(spark, d, "lineitem")
    q, tax = F.col("l_quantity"), F.col("l_tax")
    out = t.select("l_orderkey", "l_linenumber", filters.reliability_weight(tax, 0.03).alias("reliability"), filters.boundary_weight(q, 20, 1.5).alias("border"), filters.in_range(q, 5, 40).alias("ranged"), filters.above_threshold(F.col("l_discount"), 0.02).alias("above"), filters.valid_by_weight(q, tax).alias("weighted"))
    return rounded(out, "reliability", "border", digits=9)


@query(f"""WITH {RASTER}, m AS (SELECT median(v) AS m FROM raster), n AS (SELECT any_value(m) AS m, 1.4826 * median(abs(v - m)) AS n FROM raster, m) SELECT col, "row", CASE WHEN abs(v - m) <= 1.5 * n THEN v END AS v FROM raster, n""")
def mad_filter(spark, d):
    return filters.mad_filter(raster(spark, d), "v", 1.5)


@query(f"""WITH {RASTER} SELECT a.col, a."row", CASE WHEN b.v IS NOT NULL THEN a.v END AS v FROM raster a LEFT JOIN (SELECT * FROM cells WHERE idx = 1) b ON a.col = b.col AND a."row" = b."row" """)
def intersect_valid(spark, d):
    return filters.intersect_valid(raster(spark, d), cells(spark, d).filter("idx = 1"))


@query(f"""WITH {CLOUD}, k AS ({_sorted("err", "(SELECT err FROM cloud WHERE err > 0)")}), c AS (SELECT {_at(0.5)} * 0.2 * 4 AS most FROM k), p AS (SELECT cloud.*, most FROM cloud, c WHERE err <= most)
SELECT round(any_value(most), 6) AS most_error, {", ".join(f"round(quantile_cont({a}, {p}) {s} 0.4 * (quantile_cont({a}, {q}) - quantile_cont({a}, {1 - q})), 6) AS {a}_{n}" for a, q in (("x", 0.75), ("y", 0.75), ("z", 0.875)) for n, p, s in (("lo", 1 - q, "-"), ("hi", q, "+")))} FROM p""")
def error_and_box(spark, d):
    out = filters.error_and_box(cloud(spark, d), 50, 0.2)
    return rounded(out, *out.columns)


_B = "quantile_cont({v}, {q}) AS a, quantile_cont({v}, {p}) AS b"


@query(f"""WITH {CLOUD}, b1 AS (SELECT {_B.format(v="x", q=0.1, p=0.9)} FROM cloud), p1 AS (SELECT cloud.* FROM cloud, b1 WHERE x BETWEEN a - 0.05 * (b - a) AND b + 0.05 * (b - a)),
b2 AS (SELECT {_B.format(v="y", q=0.1, p=0.9)} FROM p1), p2 AS (SELECT p1.* FROM p1, b2 WHERE y BETWEEN a - 0.05 * (b - a) AND b + 0.05 * (b - a)),
b3 AS (SELECT {_B.format(v="err", q=0.25, p=0.75)} FROM p2) SELECT count(*) AS n, round(sum(x), 4) AS x, round(sum(y), 4) AS y FROM p2, b3 WHERE err BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a)""")
def bracket_chain(spark, d):
    kept = filters.bracket_chain(cloud(spark, d), [("x", 90, 0.05), ("y", 90, 0.05), ("err", 75, 0.2)])
    return rounded(kept.agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")), "x", "y", digits=4)


@query(f"""WITH {CLOUD}, kx AS ({_sorted("x", "cloud")}), ky AS ({_sorted("y", "cloud")}), m AS (SELECT kx.s[len(kx.s) // 2 + 1] AS mx, ky.s[len(ky.s) // 2 + 1] AS my FROM kx, ky)
SELECT x, y, z FROM cloud, m WHERE x >= mx - 10 AND x < mx + 10 AND y >= my - 10 AND y < my + 10""")
def spread_filter(spark, d):
    return filters.spread_filter(cloud(spark, d), ["x", "y"], 20.0).select("x", "y", "z")


_MATCHES = "m AS (SELECT l_orderkey::DOUBLE AS lx, l_linenumber::DOUBLE AS ly, l_orderkey + l_quantity AS rx, l_linenumber + l_tax AS ry FROM lineitem)"


def _matches(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("double").alias("lx"), F.col("l_linenumber").cast("double").alias("ly"), (F.col("l_orderkey") + F.col("l_quantity")).alias("rx"), (F.col("l_linenumber") + F.col("l_tax")).alias("ry"))


@query(f"""WITH {_MATCHES}, b AS (SELECT quantile_cont(rx - lx, 0.2) AS xa, quantile_cont(rx - lx, 0.8) AS xb, quantile_cont(ry - ly, 0.2) AS ya, quantile_cont(ry - ly, 0.8) AS yb FROM m)
SELECT lx, ly, round(rx, 6) AS rx, round(ry, 6) AS ry FROM m, b WHERE rx - lx BETWEEN xa - 0.1 * (xb - xa) AND xb + 0.1 * (xb - xa) AND ry - ly BETWEEN ya - 0.1 * (yb - ya) AND yb + 0.1 * (yb - ya)""")
def match_brackets(spark, d):
    return rounded(filters.match_brackets(_matches(spark, d), 80, 0.1), "rx", "ry")


@query(f"WITH {CLOUD} SELECT count(*) AS n, round(sum(z), 4) AS z FROM cloud WHERE x >= 5 AND x < 90 AND y >= 5 AND y < 45 AND z BETWEEN 2 AND 7 AND err BETWEEN 1 AND 6")
def borders_and_limits(spark, d):
    kept = filters.within_limits(filters.off_borders(cloud(spark, d), 95, 50, 5.0), {"z": (2, 7), "err": (1, 6)})
    return rounded(kept.agg(F.count("*").alias("n"), F.sum("z").alias("z")), "z", digits=4)


@query("""WITH r AS (SELECT l_orderkey AS pid, l_linenumber AS cid, l_quantity AS dx, l_discount * 100 AS dy, l_tax * 100 + 1 AS dz FROM lineitem),
a AS (SELECT a.pid, max(degrees(acos(greatest(-1, least(1, (a.dx * b.dx + a.dy * b.dy + a.dz * b.dz) / (sqrt(a.dx * a.dx + a.dy * a.dy + a.dz * a.dz) * sqrt(b.dx * b.dx + b.dy * b.dy + b.dz * b.dz))))))) AS angle FROM r a JOIN r b ON a.pid = b.pid AND a.cid < b.cid GROUP BY a.pid)
SELECT p.pid, round(coalesce(angle, 0), 5) AS angle FROM (SELECT DISTINCT pid FROM r) p LEFT JOIN a ON a.pid = p.pid WHERE coalesce(angle, 0) < 10 OR coalesce(angle, 0) > 60""")
def convergence_outliers(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pid"), F.col("l_linenumber").alias("cid"), F.col("l_quantity").alias("dx"), (F.col("l_discount") * 100).alias("dy"), (F.col("l_tax") * 100 + 1).alias("dz"))
    return rounded(filters.convergence_outliers(r, 10, 60), "angle", digits=5)


@query(f"""WITH {_PAIR}, d AS (SELECT col, "row", abs(a - b) AS v FROM pair WHERE a IS NOT NULL AND b IS NOT NULL), k AS ({_sorted("v", "d")}), c AS (SELECT {_at(0.98)} AS cut FROM k) SELECT col, "row", v FROM d, c WHERE v > cut""")
def photometric_outliers(spark, d):
    return filters.photometric_outliers(_pair(spark, d), 0.98)


@query(f"""WITH k AS ({_sorted("l_extendedprice", "lineitem")}), t AS (SELECT i, s[least(floor((i * 0.05) * len(s))::BIGINT, len(s) - 1) + 1] AS lo, CASE WHEN i = 0 THEN s[len(s)] ELSE s[least(floor((1 - i * 0.05) * len(s))::BIGINT, len(s) - 1) + 1] END AS hi FROM k, (SELECT unnest(range(11)) AS i))
SELECT least(lo, hi) AS lo, greatest(lo, hi) AS hi FROM t WHERE hi - lo <= 40000 ORDER BY i LIMIT 1""")
def search_range(spark, d):
    return filters.search_range(table(spark, d, "lineitem"), "l_extendedprice", 40000.0)


@query("""WITH v AS (SELECT DISTINCT l_extendedprice AS v FROM lineitem), g AS (SELECT lead(v) OVER (ORDER BY v) - v AS gap FROM v) SELECT round(median(gap), 6) AS gap FROM g""")
def neighbour_gap(spark, d):
    return rounded(filters.neighbour_gap(table(spark, d, "lineitem"), "l_extendedprice"), "gap")


@query(None)
def error_clusters(spark, d):
    """Rows only: the clusters come from an iteration."""
    return filters.error_clusters(cloud(spark, d), "err")


# --- series and order -------------------------------------------------------------------------------------------------


@query(f"""WITH {RASTER} SELECT col, "row", coalesce(v, round(avg(v) OVER (PARTITION BY col ORDER BY "row" RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6)) AS v FROM raster""")
def gap_fill(spark, d):
    return rounded(series.smoothed(raster(spark, d), ["col"], "row", "v", 2, fill_only=True), "v")


@query(f"""WITH {RASTER}, a AS (SELECT col, "row", avg(v) OVER (PARTITION BY col ORDER BY "row" RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM raster),
b AS (SELECT col, "row", avg(v) OVER (PARTITION BY col ORDER BY "row" RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM a) SELECT col, "row", round(v, 6) AS v FROM b""")
def repeated_average(spark, d):
    return rounded(series.smoothed(raster(spark, d), ["col"], "row", "v", 1, repeats=2), "v")


@query(f"""WITH {RASTER}, e AS (SELECT col, min("row") AS a, max("row") AS b FROM raster WHERE v IS NOT NULL GROUP BY col) SELECT r.col, r."row", v FROM raster r JOIN e ON e.col = r.col AND r."row" BETWEEN a AND b""")
def stripped_series(spark, d):
    return series.stripped(raster(spark, d), ["col"], "row", "v")


@query(f"""WITH {RASTER}, v AS (SELECT col, "row" AS r, v FROM raster WHERE v IS NOT NULL), q AS (SELECT col, "row" + 0.4::DOUBLE AS r FROM raster)
SELECT q.col, q.r AS "row", round(CASE WHEN b.r IS NOT NULL THEN a.v + (q.r - a.r) / (b.r - a.r) * (b.v - a.v) END, 6) AS v FROM q ASOF LEFT JOIN v a ON a.col = q.col AND q.r >= a.r ASOF LEFT JOIN v b ON b.col = q.col AND q.r <= b.r""")
def resampled_series(spark, d):
    r = raster(spark, d).withColumn("row", F.col("row").cast("double"))
    return rounded(series.resampled(r.select("col", (F.col("row") + 0.4).alias("row")), r, ["col"], "row", "v").select("col", "row", "v"), "v")


@query(f"""WITH {RASTER}, r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY "row") AS k, count(*) OVER (PARTITION BY col) AS n FROM raster) SELECT col, "row", v FROM r WHERE k > floor(0.15 * n) AND k <= n - floor(0.15 * n)""")
def trimmed_rows(spark, d):
    return series.trimmed(raster(spark, d), ["col"], "row", 0.15)


@query("""WITH f AS (SELECT l_suppkey, regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(l_extendedprice - m * l_quantity - c, 4) AS residual FROM lineitem l JOIN f ON f.l_suppkey = l.l_suppkey""")
def without_trend(spark, d):
    out = series.without_trend(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return rounded(out.select("l_orderkey", "l_linenumber", "residual"), "residual", digits=4)


@query("SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS place FROM events")
def frames_by_time(spark, d):
    """Places in time and name order, from a range-partitioned sort: ranks of (ts, name) with offsets of ranges."""
    f = table(spark, d, "events").withColumn("key", F.unix_micros(F.col("ts").cast("timestamp")))
    r = S.value_ranks(f, "key").select("key", (F.col("upto") - F.col("c")).alias("before"))
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("event_id")
    return f.join(r, "key").select("event_id", "ts", (F.col("before") + F.row_number().over(w)).alias("place"))


@query(f"WITH {CLOUD} SELECT DISTINCT x, y, z FROM cloud")
def unique_points(spark, d):
    return series.unique_points(cloud(spark, d))


@query(f"""WITH {RASTER} SELECT col, "row", v FROM raster WHERE col % 5 = 0 AND "row" % 5 = 0""")
def grid_subset(spark, d):
    return series.grid_subset(raster(spark, d), 5)


@query(f"""WITH {RASTER} SELECT col, "row", v FROM raster WHERE v IS NOT NULL AND col % 5 = 2 AND "row" % 5 = 2""")
def bin_centres(spark, d):
    return series.bin_centres(raster(spark, d), 5)


@query(None)
def hashed_subset(spark, d):
    """A sampling operator: 500 line items chosen by hash, in order. Rows only."""
    return series.hashed_subset(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500)


@query(f"""WITH {CLOUD}, u AS (SELECT x, y, z, 0 AS cloud FROM cloud UNION ALL SELECT y, z, err, 1 FROM cloud), kx AS ({_sorted("x", "u")}), ky AS ({_sorted("y", "u")}), m AS (SELECT kx.s[len(kx.s) // 2 + 1] AS mx, ky.s[len(ky.s) // 2 + 1] AS my FROM kx, ky)
SELECT cloud, count(*) AS n, round(sum(x - mx), 4) AS x, round(sum(y - my), 4) AS y, round(sum(z), 4) AS z FROM u, m GROUP BY cloud""")
def concatenated_clouds(spark, d):
    p = cloud(spark, d)
    both = series.common_shift([p.select("x", "y", "z"), p.select(F.col("y").alias("x"), F.col("z").alias("y"), F.col("err").alias("z"))])
    return rounded(both.groupBy("cloud").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in "xyz")), "x", "y", "z", digits=4)


@query(f"""WITH {CLOUD} SELECT floor(x / 20)::BIGINT AS tile_x, floor(y / 20)::BIGINT AS tile_y, floor(x / 2)::BIGINT AS block_x, floor(y / 2)::BIGINT AS block_y, count(*) AS n FROM cloud GROUP BY ALL""")
def spatial_blocks(spark, d):
    return series.spatial_blocks(cloud(spark, d), 20.0, 2.0).groupBy("tile_x", "tile_y", "block_x", "block_y").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT l_suppkey AS k, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_tax) AS y0, max(l_tax) AS y1 FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
b AS (SELECT l_suppkey AS k, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_tax) AS y0, max(l_tax) AS y1 FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT a.k, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 FROM a JOIN b ON a.k = b.k WHERE greatest(a.x0, b.x0) <= least(a.x1, b.x1) AND greatest(a.y0, b.y0) <= least(a.y1, b.y1)""")
def box_intersection(spark, d):
    t = table(spark, d, "lineitem")
    a, b = (t.filter(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("k")).agg(F.min("l_quantity").alias("x0"), F.max("l_quantity").alias("x1"), F.min("l_tax").alias("y0"), F.max("l_tax").alias("y1")) for f in "AN")
    return series.box_intersection(a, b, "k")
