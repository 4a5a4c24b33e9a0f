"""Series ordered by time or row: smoothing, resampling, trimming, pairing and subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions import statistics as S
from terraloom.operators.joins import as_of


def smoothed(series: DataFrame, keys: list[str], order: str, value: str, half: int, fill_only: bool = False, repeats: int = 1) -> DataFrame:
    """series with the value replaced by the mean of valid values up to `half` places away, `repeats` times.

    With fill_only, valid values stay as they are and only nulls are filled.
    """
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(-half, half)
    for _ in range(repeats):
        mean = F.avg(value).over(w)
        series = series.withColumn(value, F.coalesce(F.col(value), mean) if fill_only else mean)
    return series


def stripped(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows from the first to the last valid value of each series; nulls between stay."""
    w = Window.partitionBy(*keys)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    return series.withColumns({"_a": F.min(at).over(w), "_b": F.max(at).over(w)}).filter(F.col(order).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def resampled(asked: DataFrame, series: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """asked(keys, at) with the series' value at that place, linear between neighbours; null outside the series."""
    ref = series.filter(F.col(value).isNotNull()).withColumn("_s", F.struct(F.col(at).alias("t"), F.col(value).alias("v"))).select(*keys, at, "_s")
    both = as_of(as_of(asked, ref, keys, at, "_s", "_a"), ref, keys, at, "_s", "_b", forward=True)
    share = (F.col(at) - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    between = F.when(F.col("_a.t") == F.col("_b.t"), F.col("_a.v")).otherwise(F.col("_a.v") + share * (F.col("_b.v") - F.col("_a.v")))
    return both.withColumn(value, between).drop("_a", "_b")


def trimmed(series: DataFrame, keys: list[str], order: str, share: float) -> DataFrame:
    """Rows without a share of them at either end: places floor(share * n) to n - floor(share * n)."""
    w = Window.partitionBy(*keys)
    r = series.withColumns({"_r": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    cut = F.floor(F.lit(share) * F.col("_n"))
    return r.filter((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut)).drop("_r", "_n")


def without_trend(series: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """series with residual: the value less the line fitted to its series."""
    line = series.groupBy(*keys).agg(F.regr_slope(value, at).alias("_m"), F.regr_intercept(value, at).alias("_c"))
    return series.join(line, keys).withColumn("residual", F.col(value) - F.col("_m") * F.col(at) - F.col("_c")).drop("_m", "_c")


def consecutive(frames: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Each row with the value of the next one of its key; null for the last."""
    return frames.withColumn(out, F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)))


def by_time(frames: DataFrame, ts: str, name: str) -> DataFrame:
    """All rows in the order of time, then name: a total order, range-partitioned."""
    return frames.orderBy(ts, name)


def unique_points(points: DataFrame) -> DataFrame:
    """Distinct x, y, z in lexicographic order."""
    return points.select("x", "y", "z").distinct().orderBy("x", "y", "z")


def hashed_subset(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, chosen by a hash of the key (ties by the key), in the key's order: the same each time."""
    return rows.orderBy(F.xxhash64(key), key).limit(most).orderBy(key)


def grid_subset(cells: DataFrame, step: int) -> DataFrame:
    """Every step-th column and row."""
    return cells.filter((F.col("col") % step == 0) & (F.col("row") % step == 0))


def bin_centres(cells: DataFrame, size: int) -> DataFrame:
    """The valid cells at the centres of size x size bins of a raster."""
    return cells.filter(F.col("v").isNotNull() & (F.col("col") % size == size // 2) & (F.col("row") % size == size // 2))


def common_shift(clouds: list[DataFrame]) -> DataFrame:
    """All clouds as one with the number of each, its columns shifted so that the median of all is at 0 in x and y.

    The clouds must have equal columns. shift_x and shift_y keep what was taken off.
    """
    names = clouds[0].columns
    for c in clouds:
        if c.columns != names:
            raise ValueError(f"clouds with different columns: {names} and {c.columns}")
    out = clouds[0].withColumn("cloud", F.lit(0))
    for i, c in enumerate(clouds[1:], 1):
        out = out.unionByName(c.withColumn("cloud", F.lit(i)))
    for axis in "xy":
        m = S.picks(out, axis, {f"shift_{axis}": S.upper_middle()})
        out = out.crossJoin(F.broadcast(m)).withColumn(axis, F.col(axis) - F.col(f"shift_{axis}"))
    return out


def spatial_blocks(points: DataFrame, tile: float, block: float) -> DataFrame:
    """Points in an order that keeps near ones together: range-partitioned by tile, then sorted by block; tile and block as columns."""
    cell = lambda c, s: F.floor(F.col(c) / s)
    named = points.withColumns({"tile_x": cell("x", tile), "tile_y": cell("y", tile), "block_x": cell("x", block), "block_y": cell("y", block)})
    return named.repartitionByRange("tile_x", "tile_y").sortWithinPartitions("tile_x", "tile_y", "block_x", "block_y")


def box_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Boxes(key, x0, y0, x1, y1) of both tables cut to what they share; boxes that don't meet are left out."""
    cut = a.alias("a").join(b.alias("b"), key)
    out = cut.select(key, F.greatest("a.x0", "b.x0").alias("x0"), F.greatest("a.y0", "b.y0").alias("y0"), F.least("a.x1", "b.x1").alias("x1"), F.least("a.y1", "b.y1").alias("y1"))
    return out.filter("x0 <= x1 AND y0 <= y1")
