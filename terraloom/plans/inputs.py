"""The driver's tables read as clouds, rasters, reports, match networks and frames, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark, d) -> DataFrame:
    """A point for each line item: x, y, z and its error."""
    return table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("y"), (F.col("l_discount") * 100).alias("z"), (F.col("l_tax") * 100).alias("err"))


CLOUD = "cloud AS (SELECT l_extendedprice / 1000 AS x, l_quantity AS y, l_discount * 100 AS z, l_tax * 100 AS err FROM lineitem)"


def cells(spark, d) -> DataFrame:
    """Three overlapping rasters, a column for each supplier: sums of whole quantities; every eleventh sum is a hole."""
    img = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    out = table(spark, d, "lineitem").groupBy(img.alias("idx"), F.col("l_suppkey").alias("col"), (F.col("l_partkey") % 30).alias("row")).agg(F.sum("l_quantity").alias("s"))
    return out.select("idx", "col", "row", F.when(F.col("s") % 11 != 0, F.col("s")).alias("v"))


CELLS = """cells AS (SELECT idx, col, "row", CASE WHEN s % 11 <> 0 THEN s END AS v FROM (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS idx, l_suppkey AS col, l_partkey % 30 AS "row", sum(l_quantity) AS s
  FROM lineitem GROUP BY ALL))"""


def raster(spark, d) -> DataFrame:
    """The first of them, with a cell for all places of its frame, which grows with the suppliers."""
    frame = table(spark, d, "supplier").select(F.col("s_suppkey").alias("col"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("row"))
    return frame.join(cells(spark, d).filter("idx = 0").select("col", "row", "v"), ["col", "row"], "left")


RASTER = CELLS + """, raster AS (SELECT c.col, r."row", v FROM (SELECT s_suppkey AS col FROM supplier) c CROSS JOIN (SELECT unnest(range(30)) AS "row") r
  LEFT JOIN (SELECT col, "row", v FROM cells WHERE idx = 0) k ON k.col = c.col AND k."row" = r."row")"""


#: Columns by which the rows of a table are in the order of its files.
FILE_ORDER = ["file", "place"]


def residuals(spark, d, placed: bool = False) -> DataFrame:
    """Residuals of points seen by cameras, with FILE_ORDER if placed."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")] if placed else []
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cid"), F.col("l_orderkey").alias("pid"), (F.col("l_discount") * 100).alias("resid"), (F.col("l_tax") * 100).alias("other"), *place)


RESIDUALS = "res AS (SELECT l_suppkey AS cid, l_orderkey AS pid, l_discount * 100 AS resid, l_tax * 100 AS other FROM lineitem)"


def frames(spark, d) -> DataFrame:
    """Time-stamped frames of sensors."""
    return table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("sensor"), "ts", "value")
