"""Block matching of two rasters cells(col, row, v): a task has one tile with a halo, so its memory is bounded by the tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions.geometry import parabola_offset

COSTS = ("absolute", "squared", "ncc", "zncc", "census", "ternary")

_MATCH = "col long, row long, dx long, dy long, cost double, before_x double, after_x double, before_y double, after_y double, second double, others long, others_mean double, others_std double"


def _with_halo(cells: DataFrame, side: int, tile: int, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    """Each valid cell once for every tile that it is in or within the halo of: x and y give the halo before and after the tile."""

    def touched(axis: str, halo: tuple[int, int]):
        return F.explode(F.sequence(F.floor((F.col(axis) - halo[1]) / tile), F.floor((F.col(axis) - halo[0]) / tile)))

    valid = cells.filter(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    sent = valid.select("col", "row", F.col("v").cast("double").alias("v"), F.lit(side).alias("side"))
    return sent.withColumn("tx", touched("col", x)).withColumn("ty", touched("row", y))


def _window_sums(a: np.ndarray, size: int) -> np.ndarray:
    """Sums over all size x size squares, one direction after the other: no running totals, so nothing drifts."""
    for axis in (0, 1):
        a = np.lib.stride_tricks.sliding_window_view(a, size, axis).sum(-1)
    return a


def _signs(a: np.ndarray, half: int, band: float) -> Iterator[np.ndarray]:
    """For each place of the square: -1, 0, 1 as its value is below, within the band of, or above the middle's."""
    rows, cols = a.shape[0] - 2 * half, a.shape[1] - 2 * half
    middle = a[half : half + rows, half : half + cols]
    for y in range(2 * half + 1):
        for x in range(2 * half + 1):
            off = a[y : y + rows, x : x + cols] - middle
            yield (off > band).astype(np.int8) - (off < -band).astype(np.int8)


def _cost(left: np.ndarray, right: np.ndarray, half: int, cost: str, band: float) -> np.ndarray:
    """The cost of each square of two arrays of one shape, lower is better; infinite where a place is a hole or a correlation undefined."""
    size = 2 * half + 1
    hole = np.isnan(left) | np.isnan(right)
    whole = _window_sums(hole.astype(np.int32), size) == 0
    l, r = np.where(hole, 0.0, left), np.where(hole, 0.0, right)  # noqa: E741
    if cost == "absolute":
        out = _window_sums(np.abs(l - r), size)
    elif cost == "squared":
        out = _window_sums((l - r) ** 2, size)
    elif cost in ("ncc", "zncc"):
        lr, ll, rr = (_window_sums(p, size) for p in (l * r, l * l, r * r))
        if cost == "zncc":
            n, sl, sr = size * size, _window_sums(l, size), _window_sums(r, size)
            lr, ll, rr = n * lr - sl * sr, n * ll - sl * sl, n * rr - sr * sr
        norm = np.sqrt(np.maximum(ll, 0.0) * np.maximum(rr, 0.0))
        out = np.where(norm > 0, -lr / np.where(norm > 0, norm, 1.0), np.inf)
    elif cost == "census":  # a place is above the middle or not
        out = sum(((a > 0) != (b > 0)).astype(float) for a, b in zip(_signs(l, half, 0.0), _signs(r, half, 0.0), strict=True))
    else:  # ternary: below, near or above; two steps apart count twice
        out = sum(np.abs(a - b).astype(float) for a, b in zip(_signs(l, half, band), _signs(r, half, band), strict=True))
    return np.where(whole, out, np.inf)


def block_match(left: DataFrame, right: DataFrame, search: tuple[int, int, int, int], half: int, cost: str = "zncc", tile: int = 256, band: float = 0.0, apart: int = 3) -> DataFrame:
    """For each cell of left the shift (dx, dy) to the cell of right whose square of 2 * half + 1 has the least cost.

    search is (least dx, most dx, least dy, most dy); ties go to the smaller dy, then dx. Costs: sums of absolute or squared
    differences, the negative normalised correlation of values (ncc) or of values less their square's mean (zncc), and the
    number of places whose order to the middle differs: above or not (census), or below, within `band` and above (ternary).
    A square with a hole has no cost; a cell without any cost gives no row. Of equal cells the largest value counts.

    Further columns: the costs one shift before and after in both directions (null at the end of the search or where undefined),
    and of the shifts more than `apart` away: the least cost (second), their number, mean and standard deviation.

    A task holds one tile: (tile + halo)^2 values of both rasters and a few arrays of tile^2, whatever the search; shifts
    are gone through twice instead of keeping a volume of costs. The halo is `half`, for right also the search's reach.
    """
    if cost not in COSTS:
        raise ValueError(f"cost must be one of {COSTS}")
    x0, x1, y0, y1 = search
    reach_x, reach_y = (x0 - half, x1 + half), (y0 - half, y1 + half)

    def match(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        tx, ty = (int(k) * tile for k in key)
        cells = cells.sort_values("v")

        def image(side: int, x: tuple[int, int], y: tuple[int, int]) -> np.ndarray:
            out = np.full((tile + y[1] - y[0], tile + x[1] - x[0]), np.nan)
            c = cells[cells["side"] == side]
            out[c["row"].to_numpy() - ty - y[0], c["col"].to_numpy() - tx - x[0]] = c["v"].to_numpy()
            return out

        a, b = image(0, (-half, half), (-half, half)), image(1, reach_x, reach_y)
        shape = (tile, tile)
        span = tile + 2 * half
        shifts = [(dx, dy) for dy in range(y0, y1 + 1) for dx in range(x0, x1 + 1)]
        at = lambda dx, dy: _cost(a, b[dy - y0 : dy - y0 + span, dx - x0 : dx - x0 + span], half, cost, band)
        best, bx, by = np.full(shape, np.inf), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for dx, dy in shifts:
            c = at(dx, dy)
            better = c < best
            best[better], bx[better], by[better] = c[better], dx, dy
        beside = {n: np.full(shape, np.nan) for n in ("before_x", "after_x", "before_y", "after_y")}
        second, n, total, squares = np.full(shape, np.inf), np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape)
        for dx, dy in shifts:
            c = at(dx, dy)
            for name, ox, oy in (("before_x", -1, 0), ("after_x", 1, 0), ("before_y", 0, -1), ("after_y", 0, 1)):
                here = (dx - bx == ox) & (dy - by == oy) & np.isfinite(c)
                beside[name][here] = c[here]
            far = ((np.abs(dx - bx) > apart) | (np.abs(dy - by) > apart)) & np.isfinite(c)
            second[far] = np.minimum(second, c)[far]
            n += far
            total[far] += c[far]
            squares[far] += (c[far] - best[far]) ** 2  # about the best cost, so that little is lost
        rows, cols = np.nonzero(np.isfinite(best))
        put = lambda v: v[rows, cols]
        count = np.maximum(put(n), 1)
        mean = put(total) / count
        spread = np.sqrt(np.maximum(put(squares) / count - (mean - put(best)) ** 2, 0.0))
        some = put(n) > 0
        hole = lambda v, keep: pd.Series(v).astype("Float64").where(pd.Series(keep), pd.NA)
        return pd.DataFrame(
            {"col": cols + tx, "row": rows + ty, "dx": put(bx), "dy": put(by), "cost": put(best)}
            | {k: hole(np.nan_to_num(put(v)), ~np.isnan(put(v))) for k, v in beside.items()}
            | {"second": hole(np.where(some, put(second), 0.0), some), "others": put(n), "others_mean": hole(mean, some), "others_std": hole(spread, some)}
        )

    both = _with_halo(left, 0, tile, (-half, half), (-half, half)).unionByName(_with_halo(right, 1, tile, reach_x, reach_y))
    return both.groupBy("tx", "ty").applyInPandas(match, _MATCH)


def refined(matches: DataFrame) -> DataFrame:
    """matches with x and y, the shift at the vertex of a parabola through the costs beside the best (at most one cell away), and their curvatures.

    Where a cost beside is missing the whole shift stays and the curvature is 0. The directions are fitted apart, so a
    correlation peak that is slanted may draw the result off by some tenths of a cell.
    """
    out = matches
    for axis in ("x", "y"):
        before, after = F.col(f"before_{axis}"), F.col(f"after_{axis}")
        known = before.isNotNull() & after.isNotNull()
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), parabola_offset(before, F.col("cost"), after)))
        out = out.withColumns({axis: F.col(f"d{axis}") + F.when(known, step).otherwise(0.0), f"curvature_{axis}": F.when(known, before - 2 * F.col("cost") + after).otherwise(0.0)})
    return out


def peak_quality(matches: DataFrame) -> DataFrame:
    """matches by a correlation (ncc, zncc), with score, peak_ratio and snr.

    peak_ratio is the best correlation farther away over the best, 0 to 1, lower is better: 1 where the best is not positive, 0
    without others. snr is the best less the others' mean in standard deviations of the others, at least 0; 0 without spread.
    """
    score = -F.col("cost")
    ratio = F.when(score <= 0, 1.0).when(F.col("second").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -F.col("second")) / score))
    snr = F.when(F.col("others_std") > 0, F.greatest(F.lit(0.0), (score + F.col("others_mean")) / F.col("others_std"))).otherwise(0.0)
    return matches.withColumns({"score": score, "peak_ratio": ratio, "snr": snr})


def agreeing(forward: DataFrame, backward: DataFrame, most: int) -> DataFrame:
    """Matches from left to right whose match from right to left comes back to within `most` cells in both directions."""
    back = backward.select(F.col("col").alias("_c"), F.col("row").alias("_r"), F.col("dx").alias("_x"), F.col("dy").alias("_y"))
    met = (F.col("col") + F.col("dx") == F.col("_c")) & (F.col("row") + F.col("dy") == F.col("_r"))
    near = (F.abs(F.col("dx") + F.col("_x")) <= most) & (F.abs(F.col("dy") + F.col("_y")) <= most)
    return forward.join(back, met).filter(near).drop("_c", "_r", "_x", "_y")
