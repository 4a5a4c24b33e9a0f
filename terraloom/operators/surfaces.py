"""Distances, smoothed weights, normals and column corrections of rasters; series made denser."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.functions.geometry import slerp
from terraloom.operators.joins import bilinear


#: Places of a raster's row or column that are put in order together.
STRETCH = 512


def _carried(cells: DataFrame, line: list[str], axis: str, first: Column, last: Column, forward: Column, backward: Column) -> DataFrame:
    """cells with _b, the stretch of their line along an axis, and what the other stretches of the line carry into it.

    _first and _last are the ends of the line's frame; _before and _after the aggregates `forward` over all earlier and
    `backward` over all later stretches of the aggregates `last` and `first` of each. Only one row a stretch is put in order.
    """
    cells = cells.withColumn("_b", F.floor(F.col(axis) / STRETCH))
    ends = cells.groupBy(*line, "_b").agg(F.min(axis).alias("_lo"), F.max(axis).alias("_hi"), first.alias("_head"), last.alias("_tail"))
    whole = Window.partitionBy(*line)
    earlier, later = (whole.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_b"), F.desc("_b")))
    ends = ends.select(*line, "_b", F.min("_lo").over(whole).alias("_first"), F.max("_hi").over(whole).alias("_last"), forward.over(earlier).alias("_before"), backward.over(later).alias("_after"))
    return cells.join(ends, [*line, "_b"])


def grassfire(cells: DataFrame, border: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Valid cells with their city-block distance to the nearest hole; cells has a line for each place of its frame.

    With keys, each of their values is a raster of its own. With border, what lies outside the frame is a hole too; without, a raster of no holes gives null. The distance along
    rows comes from the holes before and after; along columns it is a running minimum each way, so no cell meets another.
    Rows and columns are cut into stretches that carry their holes and minima on, so no task holds a whole one.
    """

    def running(line: list[str], axis: str, aggregate: Column, forward: bool) -> Column:
        w = Window.partitionBy(*line, "_b").orderBy(F.col(axis) if forward else F.desc(axis))
        return aggregate.over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def edges(axis: str) -> list[Column]:
        return [F.col(axis) - F.col("_first") + 1, F.col("_last") - F.col(axis) + 1] if border else []

    cells = cells.select(*keys, "col", "row", "v")
    place, line = F.when(F.col("v").isNull(), F.col("col")), [*keys, "row"]
    hole = F.last(place, ignorenulls=True)
    along = _carried(cells, line, "col", F.min(place), F.max(place), F.max("_tail"), F.min("_head"))
    left = F.col("col") - F.coalesce(running(line, "col", hole, True), F.col("_before"))
    right = F.coalesce(running(line, "col", hole, False), F.col("_after")) - F.col("col")
    along = along.select(*keys, "col", "row", "v", F.least(left, right, *edges("col")).alias("_along"))
    line, up, down = [*keys, "col"], F.min(F.col("_along") - F.col("row")), F.min(F.col("_along") + F.col("row"))
    across = _carried(along, line, "row", down, up, F.min("_tail"), F.min("_head"))
    up = F.least(running(line, "row", up, True), F.col("_before")) + F.col("row")
    down = F.least(running(line, "row", down, False), F.col("_after")) - F.col("row")
    return across.select(*keys, "col", "row", "v", F.least(up, down, *edges("row")).cast("long").alias("distance")).filter(F.col("v").isNotNull())


#: Cells a side of the tiles that are smoothed, or more where taps reach far.
TILE = 128


def blurred(weights: DataFrame, sigma: float, half: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Positive weights(col, row, v) smoothed by a Gaussian of 2 * half + 1 taps a direction that sum to 1.

    Where there is no positive weight, 0 is taken, and nothing is returned. The default reach is three sigma. With keys, each
    of their values is a raster of its own. Smoothed tile by tile, with the cells that reach into a tile from around it, so a
    cell is sent to four tiles at most and a task holds one.
    """
    half = math.ceil(3 * sigma) if half is None else half
    taps = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    taps, side, place = taps / taps.sum(), max(TILE, 4 * half), [*keys, "col", "row"]
    positive = weights.filter("v > 0").select(*place, F.col("v").cast("double").alias("v")).dropna(subset=place)
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / side), F.floor((F.col(c) + half) / side)))

    def smooth(tile: pa.Table) -> pa.Table:
        i, j = (tile[c].to_numpy() - (tile[t][0].as_py() * side - half) for c, t in (("col", "_x"), ("row", "_y")))
        v = np.zeros((side + 2 * half, side + 2 * half))
        np.add.at(v, (i, j), tile["v"].to_numpy())
        v = sum(g * v[k : k + side] for k, g in enumerate(taps))
        v = sum(g * v[:, k : k + side] for k, g in enumerate(taps))
        mine = (i >= half) & (i < half + side) & (j >= half) & (j < half + side)
        return tile.filter(pa.array(mine)).select(place).append_column("v", pa.array(v[i[mine] - half, j[mine] - half]))

    sent = positive.withColumn("_x", tiles("col")).withColumn("_y", tiles("row"))
    return sent.groupBy(*keys, "_x", "_y").applyInArrow(smooth, positive.schema)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _thinnest(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
    """The direction of least variance of each covariance, with z not below 0."""
    m = np.stack([np.stack(r, axis=1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], axis=1).astype(float)
    good = np.isfinite(m).all(axis=(1, 2))
    v = np.linalg.eigh(np.where(good[:, None, None], m, np.eye(3)))[1][:, :, 0]
    v = np.where(v[:, 2:] < 0, -v, v)
    return pd.Series([list(n) if g else None for n, g in zip(v, good, strict=True)])


def normals(points: DataFrame, least: int = 5) -> DataFrame:
    """points(col, row, x, y, z) with nx, ny, nz of the best plane through the valid points of their 3 x 3 square.

    The normal points up (nz >= 0); it is null with fewer than `least` points. Points with a null coordinate are invalid.
    """
    valid = points.dropna(subset=["x", "y", "z"])
    d = F.sequence(F.lit(-1), F.lit(1))
    near = valid.withColumn("_dx", F.explode(d)).withColumn("_dy", F.explode(d)).withColumns({"col": F.col("col") + F.col("_dx"), "row": F.col("row") + F.col("_dy")})
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    sums = near.groupBy("col", "row").agg(F.count("*").alias("_n"), *(F.covar_pop(a, b).alias(f"_{a}{b}") for a, b in pairs))
    fit = sums.filter(F.col("_n") >= least).select("col", "row", _thinnest(*(F.col(f"_{a}{b}") for a, b in pairs)).alias("_v"))
    return valid.join(fit, ["col", "row"], "left").select(*points.columns, *(F.col("_v")[k].alias(n) for k, n in enumerate(("nx", "ny", "nz"))))


def radiometric(cells: DataFrame, corrections: DataFrame) -> DataFrame:
    """Cells with c1 * v / c2 + c0 of their column's corrections(col, c0, c1, c2); holes stay, columns without a line are kept as they are."""
    found = cells.join(corrections, "col", "left")
    return found.select("col", "row", F.when(F.col("c2").isNull(), F.col("v")).otherwise(F.col("c1") * F.col("v") / F.col("c2") + F.col("c0")).alias("v"))


def column_shifts(cells: DataFrame, shifts: DataFrame) -> DataFrame:
    """The raster read at (col - dx, row - dy) of its column's shifts(col, dx, dy), 0 for columns without a line.

    Between nodes it is bilinear; beyond the frame the edge goes on. Null where a node with weight is a hole.
    """
    frame = F.broadcast(cells.agg(*(f(c).alias(f"_{n}{c}") for c in ("col", "row") for n, f in (("lo", F.min), ("hi", F.max)))))  # one line
    at = cells.select("col", "row").join(shifts, "col", "left").crossJoin(frame)
    place = {p: F.least(F.greatest(F.col(c) - F.coalesce(F.col(s), F.lit(0.0)), F.col(f"_lo{c}")), F.col(f"_hi{c}")) for p, c, s in (("px", "col", "dx"), ("py", "row", "dy"))}
    return bilinear(at.select("col", "row", *(x.alias(p) for p, x in place.items())), cells).select("col", "row", F.col("value").alias("v"))


def datum_checked(inputs: DataFrame, semi_major: float, semi_minor: float, meridian: float, strict: bool = False) -> DataFrame:
    """inputs(semi_major, semi_minor, meridian, ...) with `fits`: axes within 0.1 of the given datum's, and its meridian.

    A null counts as not fitting. Strict raises for the first that doesn't fit.
    """
    fits = (F.abs(F.col("semi_major") - semi_major) <= 0.1) & (F.abs(F.col("semi_minor") - semi_minor) <= 0.1) & (F.col("meridian") == meridian)
    fits = F.coalesce(fits, F.lit(False))
    return inputs.withColumn("fits", F.when(fits, True).otherwise(F.raise_error("datums differ").cast("boolean")) if strict else fits)


def largest_displacement(pairs: DataFrame, before: list[str], after: list[str]) -> DataFrame:
    """The greatest distance that a point moved."""
    return pairs.agg(F.max(F.sqrt(sum((F.col(b) - F.col(a)) ** 2 for a, b in zip(before, after, strict=True)))).alias("displacement"))


def _dense(series: DataFrame, keys: list[str], at: str, factor: int) -> DataFrame:
    """Lines of the series as intervals to the next, with the numbers _k of the outputs inside and their time _t.

    A series of n samples has (n - 1) * factor + 1 outputs, evenly from its first to its last time.
    """
    w, whole = Window.partitionBy(*keys).orderBy(at), Window.partitionBy(*keys)
    s = series.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(whole), "_t0": F.min(at).over(whole), "_t1": F.max(at).over(whole), "_next": F.lead(at).over(w)})
    last = (F.col("_n") - 1) * factor
    step = (F.col("_t1") - F.col("_t0")) / last
    number = lambda t: F.ceil((t - F.col("_t0")) / step - 1e-9).cast("long")
    end = F.when(F.col("_i") == F.col("_n") - 2, last).otherwise(number(F.col("_next")) - 1)
    s = s.filter(F.col("_next").isNotNull()).withColumns({"_a": number(F.col(at)), "_b": end.cast("long"), "_step": step})
    s = s.filter(F.col("_a") <= F.col("_b")).withColumn("_k", F.explode(F.sequence("_a", "_b")))
    return s.withColumn("_t", F.col("_t0") + F.col("_k") * F.col("_step"))


def lagrange(series: DataFrame, keys: list[str], at: str, values: list[str], order: int = 8, factor: int = 10) -> DataFrame:
    """keys, k, t, values: the series made `factor` times denser by Lagrange's polynomial through `order` samples.

    They are those around the interval, moved inwards at the ends (all, if there are fewer). Times are numbers and distinct.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    sample = F.struct(F.col(at).alias("t"), *values)
    numbered = series.withColumns({"_j": F.row_number().over(w), "_m": F.count("*").over(Window.partitionBy(*keys))})
    near = F.collect_list(F.struct("_j", sample.alias("s"))).over(w.rowsBetween(1 - order, order - 1))
    first = F.greatest(F.lit(1), F.least(F.col("_j") - order // 2 + 1, F.col("_m") - order + 1))
    kept = F.filter(near, lambda p: (p["_j"] >= F.col("_first")) & (p["_j"] < F.col("_first") + order))
    stencils = numbered.withColumn("_first", first).withColumn("_p", kept).select(*keys, at, "_p")
    dense = _dense(stencils, keys, at, factor)

    def value(name: str) -> Column:
        share = lambda p: F.aggregate(F.filter("_p", lambda q: q["_j"] != p["_j"]), F.lit(1.0), lambda x, q: x * (F.col("_t") - q["s"]["t"]) / (p["s"]["t"] - q["s"]["t"]))
        return F.aggregate("_p", F.lit(0.0), lambda x, p: x + p["s"][name] * share(p))

    return dense.select(*keys, F.col("_k").alias("k"), F.col("_t").alias("t"), *(value(v).alias(v) for v in values))


def slerped(series: DataFrame, keys: list[str], at: str, quaternion: list[str], factor: int = 10) -> DataFrame:
    """keys, k, t, quaternion: unit quaternions made `factor` times denser along the arc between neighbours."""
    w = Window.partitionBy(*keys).orderBy(at)
    beside = series.withColumns({f"_to{c}": F.lead(c).over(w) for c in quaternion})
    dense = _dense(beside, keys, at, factor)
    share = (F.col("_t") - F.col(at)) / (F.col("_next") - F.col(at))
    found = slerp([F.col(c) for c in quaternion], [F.col(f"_to{c}") for c in quaternion], share)
    return dense.select(*keys, F.col("_k").alias("k"), F.col("_t").alias("t"), *(x.alias(c) for x, c in zip(found, quaternion, strict=True)))


def nearest_sample(asked: DataFrame, samples: DataFrame, at: str, start: float, step: float, count: int) -> DataFrame:
    """asked with the columns of the sample(i, ...) whose evenly spaced time is nearest, half steps upward; clamped at both ends."""
    i = F.round((F.col(at) - start) / step).cast("long")
    return asked.withColumn("i", F.least(F.greatest(i, F.lit(0).cast("long")), F.lit(count - 1).cast("long"))).join(samples, "i", "left")
