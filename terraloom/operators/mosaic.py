"""Mosaics of overlapping rasters: cells(idx, col, row, v), idx the order of the inputs, null v a hole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.statistics import NMAD_FACTOR
from terraloom.operators.storage import stored
from terraloom.operators.surfaces import blurred, grassfire


def _middle(values: Column) -> Column:
    """Mean of the two middle elements of a sorted array."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def mosaic(cells: DataFrame) -> DataFrame:
    """All statistics of the valid inputs of each cell, in one exchange: a cell's values, one an input, come together as an array.

    stddev is the sample's and null below two inputs.
    """
    v = cells.filter(F.col("v").isNotNull())
    out = v.groupBy("col", "row").agg(
        F.min_by("v", "idx").alias("first"),
        F.max_by("v", "idx").alias("last"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.avg("v").alias("mean"),
        F.when(F.count("v") > 1, F.stddev_samp("v")).alias("stddev"),
        F.count("v").alias("count"),
        F.array_sort(F.collect_list("v")).alias("_v"),
    )
    out = out.withColumn("median", _middle(F.col("_v")))
    off = F.array_sort(F.transform("_v", lambda x: F.abs(x - F.col("median"))))
    return out.withColumn("nmad", NMAD_FACTOR * _middle(off)).drop("_v")


def index_map(cells: DataFrame) -> DataFrame:
    """Which input gives a cell its minimum, its maximum and the value closest to the median; the earliest wins ties. One exchange."""
    v = cells.filter(F.col("v").isNotNull()).groupBy("col", "row").agg(F.array_sort(F.collect_list(F.struct("v", "idx"))).alias("_p"))
    v = v.withColumn("_m", _middle(F.col("_p.v")))
    best = lambda rank: F.array_min(F.transform("_p", lambda p: F.struct(rank(p["v"]).alias("v"), p["idx"].alias("idx"))))["idx"]
    return v.select("col", "row", best(lambda x: x).alias("min_idx"), best(lambda x: -x).alias("max_idx"), best(lambda x: F.abs(x - F.col("_m"))).alias("median_idx"))


def block_max(cells: DataFrame, tile: int) -> DataFrame:
    """For each tile the input of the largest sum, the earliest on ties."""
    sums = cells.groupBy(F.floor(F.col("col") / tile).alias("tx"), F.floor(F.col("row") / tile).alias("ty"), "idx").agg(F.sum("v").alias("total"))
    best = F.max(F.struct("total", (-F.col("idx")).alias("neg")))
    return sums.filter(F.col("total").isNotNull()).groupBy("tx", "ty").agg(best.alias("b")).select("tx", "ty", (-F.col("b.neg")).alias("idx"), F.col("b.total").alias("total"))


def blend(cells: DataFrame, weight: str) -> DataFrame:
    """Weighted mean of each cell's valid inputs, and the share of the first one's weight."""
    v = cells.filter(F.col("v").isNotNull() & (F.col(weight) > 0))
    total = F.sum(weight)
    return v.groupBy("col", "row").agg((F.sum(F.col(weight) * F.col("v")) / total).alias("blend"), (F.sum(F.when(F.col("idx") == 0, F.col(weight)).otherwise(0.0)) / total).alias("first_share"))


def propagate_holes(cells: DataFrame) -> DataFrame:
    """Mean of a cell, null if any input has a hole there."""
    return cells.groupBy("col", "row").agg(F.when(~F.bool_or(F.col("v").isNull()), F.avg("v")).alias("mean"))


def priority_blend(cells: DataFrame, depth: str, reach: float, power: float) -> DataFrame:
    """Earlier inputs win, except near their border, where they pass over into later ones.

    depth is a cell's distance to its input's border. The first valid input of a cell has its full weight, depth to a
    power; the others' are scaled by 1 - depth of the first / reach, at least 0.
    """
    v = cells.filter(F.col("v").isNotNull())
    w = Window.partitionBy("col", "row")
    v = v.withColumn("_top", F.min(F.struct("idx", F.col(depth).alias("d"))).over(w))
    rest = F.greatest(F.lit(0.0), 1 - F.col("_top.d") / reach)
    weight = F.pow(depth, power) * F.when(F.col("idx") == F.col("_top.idx"), 1.0).otherwise(rest)
    return v.groupBy("col", "row").agg(F.try_divide(F.sum(weight * F.col("v")), F.sum(weight)).alias("v"))


def border_weights(cells: DataFrame, most: float, sigma: float, power: float, border: bool = True) -> DataFrame:
    """Valid cells with weight: the distance to their input's nearest hole, at most `most`, smoothed by a Gaussian, to a power.

    cells has a line for each place of each input's frame. With sigma 0 nothing is smoothed. Without border only holes count, and
    an input without holes has the weight `most` everywhere.
    """
    depth = grassfire(cells, border, ("idx",)).withColumn("_w", F.least(F.coalesce(F.col("distance").cast("double"), F.lit(float(most))), F.lit(float(most))))
    depth = stored(depth.select("idx", "col", "row", "v", "_w"), "border-depths")  # read twice
    if sigma > 0:
        smooth = blurred(depth.select("idx", "col", "row", F.col("_w").alias("v")), sigma, keys=("idx",)).withColumnRenamed("v", "_w")
        depth = depth.drop("_w").join(smooth, ["idx", "col", "row"])
    return depth.select("idx", "col", "row", "v", F.pow("_w", F.lit(float(power))).alias("weight"))


def blurred_blend(cells: DataFrame, most: float = 200.0, sigma: float = 5.0, power: float = 2.0, border: bool = True) -> DataFrame:
    """The mosaic's usual blend: the mean of a cell's valid inputs by their border_weights, and the share of the first input's weight."""
    return blend(border_weights(cells, most, sigma, power, border), "weight")


def burnt(cells: DataFrame, depth: str, reach: float) -> DataFrame:
    """cells with a hole wherever earlier inputs leave nothing to an input, that is, deeper than `reach` inside one of them.

    Going through a cell's inputs in their order, an input's room is the least that its forerunners left, `reach` less their
    own depth (at least 0), and its depth at most that room; an input without room has a hole there.
    """
    valid = cells.filter(F.col("v").isNotNull() & (F.col(depth) > 0))
    earlier = F.array_sort(F.collect_list(F.struct("idx", F.col(depth).cast("double").alias("d"))))

    def step(state, one):
        depth_here = F.least(state["room"], one["d"])
        left = F.least(state["room"], F.greatest(F.lit(0.0), F.lit(float(reach)) - depth_here))
        return F.struct(left.alias("room"), F.concat(state["kept"], F.when(depth_here > 0, F.array(one["idx"])).otherwise(F.array().cast("array<bigint>"))).alias("kept"))

    start = F.struct(F.lit(float("inf")).alias("room"), F.array().cast("array<bigint>").alias("kept"))
    by_cell = valid.withColumn("idx", F.col("idx").cast("bigint")).groupBy("col", "row").agg(F.aggregate(earlier, start, step)["kept"].alias("_kept"))
    out = cells.join(by_cell, ["col", "row"], "left")
    return out.select("idx", "col", "row", F.when(F.array_contains("_kept", F.col("idx").cast("bigint")), F.col("v")).alias("v"))


def border_priority_blend(cells: DataFrame, reach: float, most: float = 200.0, sigma: float = 5.0, power: float = 2.0, border: bool = True) -> DataFrame:
    """Earlier inputs win, except within `reach` of their border, where they pass over into later ones; depths from the inputs' holes.

    Depths say where later inputs have holes burnt; weights are then those of the inputs with these holes.
    """
    cells = stored(cells.select("idx", "col", "row", "v"), "priority-cells")
    deep = grassfire(cells, border, ("idx",)).select("idx", "col", "row", F.coalesce(F.col("distance").cast("double"), F.lit(float("inf"))).alias("_d"))
    deep = stored(cells.join(deep, ["idx", "col", "row"], "left"), "priority-depths")
    return blurred_blend(stored(burnt(deep, "_d", reach), "priority-burnt"), most, sigma, power, border)


def max_lit(cells: DataFrame) -> DataFrame:
    """The largest valid value of each cell, at least 0: the composite starts from black."""
    return cells.filter(F.col("v").isNotNull()).groupBy("col", "row").agg(F.greatest(F.max("v"), F.lit(0.0)).alias("v"))


def mean_differences(cells: DataFrame) -> DataFrame:
    """i, j, mean, n for each pair of inputs i < j: the mean of i less j on the cells valid in both.

    A cell's inputs are paired among themselves; their number is that of the inputs, not of the cells.
    """
    v = cells.filter(F.col("v").isNotNull())
    a, b = v.select("col", "row", F.col("idx").alias("i"), F.col("v").alias("a")), v.select("col", "row", F.col("idx").alias("j"), F.col("v").alias("b"))
    return a.join(b, ["col", "row"]).filter("i < j").groupBy("i", "j").agg(F.avg(F.col("a") - F.col("b")).alias("mean"), F.count("*").alias("n"))


def lit_albedo(cells: DataFrame, shadow: float) -> DataFrame:
    """mean of each image's cells above the shadow threshold, and its highest cell."""
    return cells.groupBy("idx").agg(F.avg(F.when(F.col("v") > shadow, F.col("v"))).alias("mean"), F.max("v").alias("highest"))
