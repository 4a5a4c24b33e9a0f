"""Tracks: connected components of matches, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.operators.storage import stored


def _stored(df: DataFrame) -> DataFrame:
    return stored(df, "tracks")


def _stars(links: DataFrame) -> bool:
    """Whether every node of links(hi, lo) is a centre (only lo) or bound to a single centre (hi, once)."""
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("bound")).unionByName(links.select(F.col("lo").alias("node"), F.lit(0).alias("bound")))
    return ends.groupBy("node").agg(F.sum("bound").alias("n"), F.min("bound").alias("least")).filter((F.col("n") > 1) | (F.col("least") < F.col("n"))).isEmpty()


def tracks(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, track (the smallest node of its component).

    Rounds until the links are stars around the smallest nodes; links that are stars already take none.
    """
    links = _stored(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while not _stars(links):
        both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        root = both.groupBy("hi").agg(F.min("lo").alias("root")).withColumn("root", F.least("hi", "root"))
        large = both.join(root, "hi").filter(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
        root = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(root, "hi").filter(F.col("lo") != F.col("root")).select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
        links = _stored(small.unionByName(root.select("hi", F.col("root").alias("lo"))).distinct())
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("track")).unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("track")).distinct())


def without_conflicts(found: DataFrame, least: int = 2) -> DataFrame:
    """found(node, image, track) without tracks that hit an image twice or have fewer than `least` nodes."""
    kept = found.groupBy("track").agg(F.count("*").alias("n"), F.count_distinct("image").alias("images")).filter((F.col("n") == F.col("images")) & (F.col("n") >= least))
    return found.join(kept.select("track"), "track", "left_semi")
