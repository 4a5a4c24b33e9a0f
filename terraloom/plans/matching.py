"""Queries over binary match files, smoothing by texture and networks completed by disparities, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.operators import composites, networks, smoothing
from terraloom.operators.storage import shared_path
from terraloom.plans.inputs import CELLS, RASTER, cells, raster, table
from terraloom.plans.registry import query, rounded
from terraloom.sources.matchfiles import read_matches, write_matches


@query("""SELECT 'suppliers-' || (l_suppkey // 10) AS file, l_linenumber::DOUBLE AS lx, l_quantity AS ly, l_quantity AS rx, l_linenumber::DOUBLE AS ry, l_returnflag = 'A' AS polarity,
l_linenumber::BIGINT AS numbers, (l_linenumber * l_quantity)::DOUBLE AS total FROM lineitem""")
def match_files(spark, d):
    """A match for each line item, a pair of images for ten suppliers, with descriptors of 1 to 7 numbers: written as binary files and read back."""
    t = table(spark, d, "lineitem")
    number, quantity = F.col("l_linenumber").cast("float"), F.col("l_quantity").cast("float")
    left = F.struct(number.alias("x"), quantity.alias("y"), (F.col("l_returnflag") == "A").alias("polarity"))
    right = F.struct(quantity.alias("x"), number.alias("y"), F.array_repeat(quantity, F.col("l_linenumber").cast("int")).alias("descriptor"))
    path = shared_path(spark, "match-files")
    write_matches(t.select(F.concat(F.lit("suppliers-"), F.expr("l_suppkey div 10")).alias("file"), F.col("l_orderkey").alias("k"), left.alias("left"), right.alias("right")), path)
    numbers = F.col("right.descriptor")
    out = read_matches(spark, path).select("file", *(F.col(f"{side}.{c}").cast("double").alias(f"{side[0]}{c}") for side in ("left", "right") for c in "xy"), F.col("left.polarity").alias("polarity"), numbers.alias("_d"))
    return out.withColumns({"numbers": F.size("_d").cast("long"), "total": F.aggregate("_d", F.lit(0.0), lambda a, x: a + x)}).drop("_d")


@query(f"""WITH {RASTER}, image AS (SELECT col, "row", v FROM cells WHERE idx = 1 AND v IS NOT NULL),
g AS (SELECT c.col, c."row", abs(e.v - c.v) + abs(s.v - c.v) AS g FROM image c JOIN image e ON e.col = c.col + 1 AND e."row" = c."row" JOIN image s ON s.col = c.col AND s."row" = c."row" + 1),
p AS (SELECT * FROM raster WHERE v IS NOT NULL),
t AS (SELECT i.col, i."row", avg(g) AS t FROM (SELECT col, "row" FROM cells WHERE idx = 1) i JOIN g ON abs(i.col - g.col) <= 1 AND abs(i."row" - g."row") <= 1 GROUP BY ALL),
h AS (SELECT p.*, CASE WHEN t IS NULL THEN 0 ELSE greatest(0, floor((floor(15 * (1 - t / 200)) - 1) / 2)) END::BIGINT AS half FROM p LEFT JOIN t ON t.col = p.col AND t."row" = p."row")
SELECT a.col, a."row", a.half, round(avg(b.v), 6) AS v FROM h a JOIN p b ON b.col BETWEEN a.col - a.half AND a.col + a.half AND b."row" BETWEEN a."row" - a.half AND a."row" + a.half GROUP BY ALL""")
def texture_smoothing(spark, d):
    """The first raster smoothed where the second one shows little texture, over squares of up to 15 cells."""
    image = cells(spark, d).filter("idx = 1").select("col", "row", "v")
    return rounded(smoothing.smooth_by_texture(raster(spark, d), image, 1, 200.0, 15), "v")


@query(f"""WITH {CELLS}, o AS (SELECT row_number() OVER () AS id, l_orderkey AS pid, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cid, l_suppkey - l_discount AS x, l_partkey % 30 + l_tax AS y FROM lineitem),
a AS (SELECT *, x + 0.25 * cid AS px, y + 0.5 AS py FROM o),
n AS (SELECT a.*, floor(px)::BIGINT + i AS col, floor(py)::BIGINT + j AS "row", CASE i WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END * CASE j WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END AS w
  FROM a CROSS JOIN (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS j)),
m AS (SELECT id, pid, n.cid, px + sum(w * v / 50) - n.cid AS u, py - sum(w * v / 100) + n.cid AS t FROM n LEFT JOIN cells c ON c.idx = n.cid AND c.col = n.col AND c."row" = n."row" WHERE w > 0
  GROUP BY id, pid, n.cid, px, py HAVING count(v) = count(*))
SELECT pid, cid::BIGINT AS cid, round(x, 6) AS x, round(y, 6) AS y FROM o UNION ALL SELECT pid, cid + 3, round((u - 0.5 * t) / 1.875, 6), round((2 * t - 0.25 * u) / 1.875, 6) FROM m""")
def completed_network(spark, d):
    """Line items as observations in three images, each completed by its raster read as disparities."""
    image = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).cast("long")
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pid"), image.alias("cid"), (F.col("l_suppkey") - F.col("l_discount")).alias("x"), (F.col("l_partkey") % 30 + F.col("l_tax")).alias("y"))
    moves = cells(spark, d).select(F.col("idx").cast("long").alias("cid"), "col", "row", (F.col("v") / 50).alias("dx"), (-F.col("v") / 100).alias("dy"))
    numbers = lambda *c: F.array(*((x if isinstance(x, Column) else F.lit(x)).cast("double") for x in c))
    k = F.col("cid")
    pairs = table(spark, d, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").cast("long").alias("cid"))
    pairs = pairs.select("cid", numbers(1, 0, 0.25 * k, 0, 1, 0.5).alias("l"), numbers(2, 0.5, k, 0.25, 1, -k).alias("r"))
    return rounded(networks.complete_network(o, moves, pairs, 3), "x", "y")


@query(f"""WITH {RASTER}, c AS (SELECT col // 2 AS x, "row" // 2 AS y, avg(CASE idx WHEN 0 THEN v END) / 2 AS r, avg(CASE idx WHEN 1 THEN v END) / 2 AS g, avg(CASE idx WHEN 2 THEN v END) / 2 AS b FROM cells GROUP BY ALL),
p AS (SELECT col, "row", v / 2 AS v, col / 2 - 0.25 AS px, "row" / 2 - 0.25 AS py FROM raster),
n AS (SELECT p.*, floor(px)::BIGINT + i AS x, floor(py)::BIGINT + j AS y, CASE i WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END * CASE j WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END AS w
  FROM p CROSS JOIN (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS j)),
m AS (SELECT col, "row", n.v, CASE WHEN count(r) = count(*) THEN sum(w * r) END AS r, CASE WHEN count(g) = count(*) THEN sum(w * g) END AS g, CASE WHEN count(b) = count(*) THEN sum(w * b) END AS b
  FROM n LEFT JOIN c ON c.x = n.x AND c.y = n.y WHERE w > 0 GROUP BY col, "row", n.v),
k AS (SELECT *, v IS NOT NULL AND r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL AS whole, least(greatest(128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 0), 255) - 128 AS cb, least(greatest(128 + 0.5 * r - 0.418688 * g - 0.081312 * b, 0), 255) - 128 AS cr FROM m)
SELECT col, "row", CASE WHEN whole THEN round(least(greatest(v + 1.402 * cr, 0), 255), 5) END AS r, CASE WHEN whole THEN round(least(greatest(v - 0.34414 * cb - 0.71414 * cr, 0), 255), 5) END AS g, CASE WHEN whole THEN round(least(greatest(v + 1.772 * cb, 0), 255), 5) END AS b FROM k""")
def pan_sharpening(spark, d):
    """The first raster as the grey image, all three at half its resolution as the colours."""
    half = F.expr("col div 2").alias("col"), F.expr("row div 2").alias("row")
    colours = cells(spark, d).groupBy(*half).agg(*((F.avg(F.when(F.col("idx") == i, F.col("v"))) / 2).alias(n) for i, n in enumerate("rgb")))
    grey = raster(spark, d).select("col", "row", (F.col("v") / 2).alias("v"), (F.col("col") / 2 - 0.25).alias("px"), (F.col("row") / 2 - 0.25).alias("py"))
    return rounded(composites.pan_sharpened(grey, colours), "r", "g", "b", digits=5)
