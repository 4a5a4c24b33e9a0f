"""Connected components of a table of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import materialize


def _stars(links: DataFrame) -> bool:
    """Whether every node of links(u, v) is either a centre v or bound to a single centre."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("bound")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("bound")))
    crossed = (F.sum("bound") > 1) | (F.min("bound") < F.max("bound"))
    return ends.groupBy("node").agg(crossed.alias("crossed")).filter("crossed").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, component (the smallest node that it reaches), for all nodes with a link.

    Large-star and small-star rounds until the links form stars: each round ties every node to the smallest of its
    neighbours, with aggregations and joins only. The links of each round are written to the shared folder.
    """
    links = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    while not _stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: among the smaller neighbours
        large = materialize(large.filter("u <> v").distinct(), "components-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        links = materialize(small.distinct(), "components")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
