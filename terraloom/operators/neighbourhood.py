"""Operators on cells(col, row, v) and their neighbours; null v is a hole."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.statistics import floor_place, picks, upper_median
from terraloom.operators.storage import stored


def spread(cells: DataFrame, half: int) -> DataFrame:
    """Every valid cell's value at each cell of the square around it: tcol, trow, v."""
    d = F.sequence(F.lit(-half), F.lit(half))
    return cells.filter(F.col("v").isNotNull()).withColumn("_dx", F.explode(d)).withColumn("_dy", F.explode(d)).select((F.col("col") + F.col("_dx")).alias("col"), (F.col("row") + F.col("_dy")).alias("row"), "v")


def median_filter(cells: DataFrame, half: int, least: int = 1) -> DataFrame:
    """Upper median of the valid cells of each square, at all cells of the raster; null below `least` of them."""
    found = spread(cells, half).groupBy("col", "row").agg(upper_median(F.col("v")).alias("median"), F.count("*").alias("_n"))
    joined = cells.select("col", "row").join(found, ["col", "row"], "left")
    return joined.select("col", "row", F.when(F.col("_n") >= least, F.col("median")).alias("median"))


def erode(cells: DataFrame, by: int) -> DataFrame:
    """Cells without a hole within `by` cells; what lies outside the raster is no hole."""
    holes = cells.filter(F.col("v").isNull())
    near = spread(holes.withColumn("v", F.lit(1.0)), by).select("col", "row").distinct()
    return cells.filter(F.col("v").isNotNull()).join(near, ["col", "row"], "left_anti")


def dilate(cells: DataFrame, by: int) -> DataFrame:
    """Cells within `by` of a valid one (closed disc)."""
    d = F.sequence(F.lit(-by), F.lit(by))
    wide = cells.filter(F.col("v").isNotNull()).withColumn("_dx", F.explode(d)).withColumn("_dy", F.explode(d)).filter(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") <= by * by)
    return wide.select((F.col("col") + F.col("_dx")).alias("col"), (F.col("row") + F.col("_dy")).alias("row")).distinct()


def centreline_weight(cells: DataFrame, most: float = float("inf")) -> DataFrame:
    """Valid cells with a weight that falls from the middle of their row's and of their column's valid cells to both ends.

    For each direction: half the width between the first and last valid cell, less the distance to their middle, plus a
    hundred-millionth of the half width, so that the end cells keep some weight; at least 0, at most `most`. The weight
    is the product of both directions, and 0 where a row or column has one valid cell only.
    """
    v = cells.filter(F.col("v").isNotNull())

    def across(along: str, other: str) -> F.Column:
        w = Window.partitionBy(other)
        lo, hi = F.min(along).over(w), F.max(along).over(w)
        half = (hi - lo) / 2.0
        weight = F.greatest(F.lit(0.0), half - F.abs(F.col(along) - (lo + hi) / 2.0) + 1e-8 * half)
        return F.when(half > 0, F.least(weight, F.lit(most))).otherwise(0.0)

    return v.select("col", "row", "v", (across("col", "row") * across("row", "col")).alias("weight"))


def moving_average(series: DataFrame, keys: list[str], order: str, value: str, half: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(-half, half)
    return series.withColumn("average", F.avg(value).over(w))


def around(cells: DataFrame, places: dict[str, tuple[int, int]]) -> DataFrame:
    """col, row and a column for each named place (dx, dy) beside a cell: one exchange, whatever the number of places.

    Every valid cell sends its value to those it is a neighbour of, and each cell picks what arrived.
    """
    sent = F.array(*(F.struct(F.lit(n).alias("at"), (F.col("col") - dx).alias("col"), (F.col("row") - dy).alias("row"), "v") for n, (dx, dy) in places.items()))
    s = cells.filter(F.col("v").isNotNull()).select(F.explode(sent).alias("s")).select("s.*")
    return s.groupBy("col", "row").agg(*(F.max(F.when(F.col("at") == n, F.col("v"))).alias(n) for n in places))


def slope_aspect(cells: DataFrame, spacing: float) -> DataFrame:
    """Slope and aspect in degrees of the cells that are valid with their four neighbours.

    The aspect is an azimuth, 0 to 360, clockwise from north (rows grow southwards); flat cells have none.
    """
    near = around(cells, {"c": (0, 0), "w": (-1, 0), "e": (1, 0), "n": (0, -1), "s": (0, 1)}).dropna(subset=["c", "w", "e", "n", "s"])
    dx, dy = F.col("e") - F.col("w"), F.col("s") - F.col("n")
    slope = F.degrees(F.atan(F.sqrt(dx * dx + dy * dy) / (2 * spacing)))
    turn = F.degrees(F.atan2(dy, -dx))
    azimuth = F.when(turn > 90, 450 - turn).otherwise(90 - turn)
    azimuth = F.when(azimuth >= 360, azimuth - 360).otherwise(azimuth)
    return near.select("col", "row", slope.alias("slope"), F.when((dx != 0) | (dy != 0), azimuth).alias("aspect"))


def height_median_filter(cells: DataFrame, half: int, threshold: float) -> DataFrame:
    """Valid cells; v becomes null where it is farther than the threshold from its square's upper median."""
    centre = median_filter(cells, half)
    kept = F.when(F.abs(F.col("v") - F.col("median")) <= threshold, F.col("v"))
    return cells.filter(F.col("v").isNotNull()).join(centre, ["col", "row"]).select("col", "row", kept.alias("v"))


def clean_by_threshold(cells: DataFrame, half: int, threshold: float, share: float) -> DataFrame:
    """Valid cells with at least `share` of the square's places (itself left out) within the threshold of their value."""
    near = spread(cells, half).withColumnRenamed("v", "o").join(cells.filter(F.col("v").isNotNull()), ["col", "row"])
    like = near.groupBy("col", "row", "v").agg((F.count_if(F.abs(F.col("o") - F.col("v")) <= threshold) - 1).alias("_like"))
    return like.filter(F.col("_like") >= share * ((2 * half + 1) ** 2 - 1)).select("col", "row", "v")


def clean_by_mean(cells: DataFrame, half: int, most: float) -> DataFrame:
    """Valid cells within `most` of the mean of their square's valid cells."""
    near = spread(cells, half).groupBy("col", "row").agg(F.avg("v").alias("_m"))
    kept = cells.filter(F.col("v").isNotNull()).join(near, ["col", "row"])
    return kept.filter(F.abs(F.col("v") - F.col("_m")) <= most).select("col", "row", "v")


def clean_by_quantile(cells: DataFrame, share: float, multiple: float) -> DataFrame:
    """Valid cells whose size |v| is at most `multiple` times the `share` quantile of all sizes (element floor(share * n) of them)."""
    sizes = cells.filter(F.col("v").isNotNull()).withColumn("_s", F.abs("v").cast("double"))
    most = picks(sizes, "_s", {"_most": floor_place(share)})  # one row
    return sizes.crossJoin(F.broadcast(most)).filter(F.col("_s") <= multiple * F.col("_most")).select("col", "row", "v")


def edge_mask(cells: DataFrame, buffer: int = 0) -> DataFrame:
    """Valid cells inside the first and last valid cell of their row and of their column, `buffer` cells farther in.

    What lies between is kept, holes as well: all cells of the raster's frame that are inside.
    """
    rows, cols = Window.partitionBy("row"), Window.partitionBy("col")
    at_col, at_row = F.when(F.col("v").isNotNull(), F.col("col")), F.when(F.col("v").isNotNull(), F.col("row"))
    ends = cells.withColumns({"_l": F.min(at_col).over(rows), "_r": F.max(at_col).over(rows)})
    ends = ends.withColumns({"_t": F.min(at_row).over(cols), "_b": F.max(at_row).over(cols)})
    inside = F.col("col").between(F.col("_l") + buffer, F.col("_r") - buffer) & F.col("row").between(F.col("_t") + buffer, F.col("_b") - buffer)
    return ends.filter(inside).select("col", "row", "v")


def surface_resolution(cells: DataFrame, least: int = 3) -> DataFrame:
    """points(col, row, x, y, z): the largest distance to a valid 4-neighbour, null below `least` of them."""
    sides = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1)))))
    valid = cells.dropna(subset=["x", "y", "z"])
    sent = valid.withColumn("_s", sides).select((F.col("col") + F.col("_s.dx")).alias("col"), (F.col("row") + F.col("_s.dy")).alias("row"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"))
    far = F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2) + F.pow(F.col("z") - F.col("_z"), 2))
    return valid.join(sent, ["col", "row"]).groupBy("col", "row").agg(F.when(F.count("*") >= least, F.max(far)).alias("resolution"))


def blobs(cells: DataFrame, smallest: int) -> DataFrame:
    """Valid cells of 4-connected regions of at least `smallest` cells, with region (its least cell) and area."""
    from terraloom.operators.tracks import tracks

    wide = F.col("row") * (1 << 31) + F.col("col")
    v = cells.filter(F.col("v").isNotNull()).withColumn("node", wide)
    links = v.select(F.col("node").alias("a"), F.explode(F.array(F.col("node") + 1, F.col("node") + (1 << 31))).alias("b"))
    links = links.join(v.select(F.col("node").alias("b")), "b", "left_semi")
    found = v.join(tracks(links), "node", "left").withColumn("region", F.coalesce("track", "node"))
    area = found.groupBy("region").agg(F.count("*").alias("area")).filter(F.col("area") >= smallest)
    return found.join(area, "region").select("col", "row", "v", "region", "area")


def correlation(pairs: DataFrame, half: int) -> DataFrame:
    """pairs(col, row, l, r) -> the normalised cross-correlation of the squares around each cell: sum(lr) / sqrt(sum(ll) sum(rr)).

    Needs all places of the square; null where a sum of squares is 0.
    """
    d = F.sequence(F.lit(-half), F.lit(half))
    sent = pairs.filter(F.col("l").isNotNull() & F.col("r").isNotNull()).withColumn("_dx", F.explode(d)).withColumn("_dy", F.explode(d))
    sent = sent.select((F.col("col") + F.col("_dx")).alias("col"), (F.col("row") + F.col("_dy")).alias("row"), "l", "r")
    s = sent.groupBy("col", "row").agg(F.sum(F.col("l") * F.col("r")).alias("lr"), F.sum(F.col("l") * F.col("l")).alias("ll"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.count("*").alias("n"))
    return s.filter(F.col("n") == (2 * half + 1) ** 2).select("col", "row", F.try_divide("lr", F.sqrt(F.col("ll") * F.col("rr"))).alias("ncc"))


def fill_holes(cells: DataFrame, radius: int, power: float, share: float) -> DataFrame:
    """cells with holes filled by the mean of the valid cells within the radius, weighted by distance to the power -power.

    A hole is filled only if at least `share` of the disc's places around it are valid.
    """
    places = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if 0 < dx * dx + dy * dy <= radius * radius]
    to = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(dx * dx + dy * dy) ** (-power / 2)).alias("w")) for dx, dy in places)))
    sent = cells.filter(F.col("v").isNotNull()).withColumn("_s", to).select((F.col("col") + F.col("_s.dx")).alias("col"), (F.col("row") + F.col("_s.dy")).alias("row"), F.col("_s.w").alias("_w"), F.col("v").alias("_v"))
    holes = cells.filter(F.col("v").isNull()).select("col", "row")
    mean = F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")
    found = holes.join(sent, ["col", "row"]).groupBy("col", "row").agg(F.when(F.count("*") >= share * len(places), mean).alias("_m"))
    return cells.join(found, ["col", "row"], "left").select("col", "row", F.coalesce("v", "_m").alias("v"))


def fill_in_passes(cells: DataFrame, radius: float, power: float, share: float, passes: int) -> DataFrame:
    """cells with holes filled by the mean of the valid cells at most `radius` away, weighted by 1 / (distance to the power + 1).

    A pass fills the holes with at least `share` of the disc's places valid; the next pass takes these as valid. Each pass is
    one exchange of the valid cells near holes; its result is stored, so that passes don't repeat one another.
    """
    reach = math.floor(radius)
    places = [(dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if 0 < dx * dx + dy * dy <= radius * radius]
    to = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(1 / (math.hypot(dx, dy) ** power + 1)).alias("w")) for dx, dy in places)))
    out = cells.select("col", "row", "v")
    for k in range(passes if places else 0):
        sent = out.filter(F.col("v").isNotNull()).withColumn("_s", to).select((F.col("col") + F.col("_s.dx")).alias("col"), (F.col("row") + F.col("_s.dy")).alias("row"), F.col("_s.w").alias("_w"), F.col("v").alias("_v"))
        mean = F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")
        found = out.filter(F.col("v").isNull()).select("col", "row").join(sent, ["col", "row"]).groupBy("col", "row").agg(F.when(F.count("*") >= share * len(places), mean).alias("_m"))
        out = stored(out.join(found, ["col", "row"], "left").select("col", "row", F.coalesce(F.col("v").cast("double"), "_m").alias("v")), f"filled-{k}")
    return out


def fill_short_holes(cells: DataFrame, longest: int) -> DataFrame:
    """cells with those holes filled whose run of holes is at most `longest` both along the row and along the column.

    A hole takes the mean of the valid cells at the four ends of its runs, weighted by 1 / distance. Runs that reach the
    frame's end have no cell there, and stay. cells has a line for each place of its frame.
    """
    ends = []
    out = cells.select("col", "row", "v")
    for axis, other in (("col", "row"), ("row", "col")):
        for side, order in (("a", F.col(axis)), ("b", F.desc(axis))):
            w = Window.partitionBy(other).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            end = F.last(F.when(F.col("v").isNotNull(), F.struct(F.col(axis).alias("at"), F.col("v").cast("double").alias("v"))), ignorenulls=True).over(w)
            out = out.withColumn(f"_{axis}{side}", end)
            ends.append((F.abs(F.col(f"_{axis}{side}.at") - F.col(axis)), F.col(f"_{axis}{side}.v")))
    run = lambda axis: F.abs(F.col(f"_{axis}b.at") - F.col(f"_{axis}a.at")) - 1
    mean = sum(v / d for d, v in ends) / sum(1 / d for d, _ in ends)
    filled = F.when((run("col") <= longest) & (run("row") <= longest), mean)
    return out.select("col", "row", F.coalesce(F.col("v").cast("double"), filled).alias("v"))
