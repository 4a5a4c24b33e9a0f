"""Queries over composites, cutoffs, borders, shadows and descriptors, each with its SQL twin where SQL gives the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import composites
from terraloom.plans.inputs import CELLS, CLOUD, RASTER, cells, cloud, raster, table
from terraloom.plans.registry import query, rounded


@query(f"""WITH {CELLS}, c AS (SELECT idx AS cloud, col, "row", v FROM cells), s AS (SELECT cloud, max(col) + 1 AS cols, max("row") + 1 AS "rows" FROM c GROUP BY ALL),
p AS (SELECT cloud, "rows" < cols AS turned, sum(8 * (ceil(least(cols, "rows") / 8) + 1)) OVER (ORDER BY cloud) - 8 * (ceil(least(cols, "rows") / 8) + 1) AS start FROM s)
SELECT c.cloud, (start + CASE WHEN turned THEN "row" ELSE col END)::BIGINT AS col, CASE WHEN turned THEN col ELSE "row" END AS "row", v FROM c JOIN p ON p.cloud = c.cloud""")
def clouds_side_by_side(spark, d):
    c = cells(spark, d).withColumnRenamed("idx", "cloud")
    sizes = c.groupBy("cloud").agg((F.max("col") + 1).alias("cols"), (F.max("row") + 1).alias("rows"))
    return composites.side_by_side(c, sizes, 8)


@query(f"""WITH {CLOUD}, h AS (SELECT round(1023 * least(err, 7.0) / 7.0) AS bin, count(*) AS n FROM cloud WHERE err <> 0 GROUP BY ALL), u AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h),
q AS (SELECT min(bin) FILTER (WHERE upto >= 0.25 * total) * 7.0 / 1024 AS q1, min(bin) FILTER (WHERE upto >= 0.5 * total) * 7.0 / 1024 AS q2, min(bin) FILTER (WHERE upto >= 0.75 * total) * 7.0 / 1024 AS q3 FROM u)
SELECT round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(q3, 6) AS p, round(q3 * 3, 6) AS cutoff FROM q""")
def histogram_cutoff(spark, d):
    return rounded(composites.histogram_cutoff(cloud(spark, d), "err", 7.0, 75.0, 3.0), "q1", "q2", "q3", "p", "cutoff")


@query(f"""WITH {CLOUD} SELECT (abs(x - 60) > 40 OR abs(y - 30) > 18) AS outside, count(*) AS n FROM cloud GROUP BY ALL""")
def outside_crop(spark, d):
    return cloud(spark, d).groupBy(composites.outside_crop(F.col("x"), F.col("y"), (120, 60), (80, 36)).alias("outside")).agg(F.count("*").alias("n"))


@query(f"""WITH {RASTER}, f AS (SELECT min(col) AS c0, max(v) AS top FROM raster), a AS (SELECT col, "row", v, unnest(range(1, 1 + greatest(0, least(floor((top - v) / 50), 2 * (col - c0))::BIGINT))) AS s FROM raster, f WHERE v IS NOT NULL),
h AS (SELECT DISTINCT a.col, a."row" FROM a JOIN raster p ON p.col = a.col - (a.s + 1) // 2 AND p."row" = a."row" JOIN raster q ON q.col = a.col - a.s // 2 AND q."row" = a."row" WHERE a.v + a.s * 50 < (p.v + q.v) / 2)
SELECT r.col, r."row", r.v, h.col IS NOT NULL AS shadow FROM raster r LEFT JOIN h ON h.col = r.col AND h."row" = r."row" WHERE r.v IS NOT NULL""")
def raster_shadows(spark, d):
    """The sun in the west, at 45 degrees over cells of 100."""
    return composites.shadows(raster(spark, d), (100.0, 100.0), 270.0, 45.0)


@query()
def descriptor_matches(spark, d):
    """Suppliers and customers of a nation, by their balance and the lengths of their names."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    a = s.select(F.col("s_nationkey").alias("tile"), F.col("s_suppkey").alias("id"), F.array("s_acctbal", F.length("s_name").cast("double")).alias("descriptor"))
    b = c.select(F.col("c_nationkey").alias("tile"), F.col("c_custkey").alias("id"), F.array("c_acctbal", F.length("c_name").cast("double")).alias("descriptor"))
    return rounded(composites.match_descriptors(a, b, "tile", 0.7), "distance")


@query("""SELECT s_suppkey, CASE s_nationkey % 5 WHEN 0 THEN 'pinhole' WHEN 1 THEN 'csm' WHEN 2 THEN 'isis' WHEN 3 THEN 'spot' END AS kind FROM supplier""")
def camera_kinds(spark, d):
    t = table(spark, d, "supplier")
    k = F.col("s_nationkey") % 5
    camera = F.concat("s_name", F.when(k == 0, ".TSAI").when(k == 1, ".json").when(k == 3, ".dim").otherwise(".xml"))
    image = F.concat("s_name", F.when(k == 2, ".cub").otherwise(".tif"))
    return t.select("s_suppkey", composites.camera_kind(image, image, camera, F.lit(None).cast("string")).alias("kind"))
