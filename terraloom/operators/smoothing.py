"""Means over windows whose size differs from cell to cell, and smoothing that spares texture; cells(col, row, v), null v a hole."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.operators.neighbourhood import around, median_filter

TILE = 256


def window_means(cells: DataFrame, half: str, largest: int, tile: int = TILE) -> DataFrame:
    """col, row, half, mean, n of the valid cells in the square of side 2 * half + 1 around each cell; mean is null where n is 0.

    The column half (whole, 0 to `largest`; null: 0) may differ from cell to cell; other values raise. Each cell goes to
    the tiles that it is within `largest` cells of, in one exchange; there sums over squares are four look-ups in a
    summed-area table, whatever the window. A task holds one tile with its margin, however large the raster is. Sums are
    of differences to the tile's first valid value, so that large heights keep their digits. Cells of a null col or row
    are left out; several values of one place are all counted, and it has one row for each.
    """
    reach = F.lit(largest)
    over = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    sent = cells.select(F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row"), F.col("v").cast("double").alias("v"), F.coalesce(F.col(half), F.lit(0)).cast("long").alias("half"))
    sent = sent.dropna(subset=["col", "row"]).withColumn("half", F.when(F.col("half").between(0, largest), F.col("half")).otherwise(F.raise_error(F.lit(f"a window is below 0 or above {largest}")).cast("long")))
    sent = sent.withColumn("_tx", F.explode(over("col"))).withColumn("_ty", F.explode(over("row")))
    side = tile + 2 * largest

    def means(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        left, top = (int(k) * tile - largest for k in key)
        x, y, v = held["col"].to_numpy() - left, held["row"].to_numpy() - top, held["v"].to_numpy(float)
        valid = ~np.isnan(v)
        base = v[valid][0] if valid.any() else 0.0
        sums, counts = np.zeros((side + 1, side + 1)), np.zeros((side + 1, side + 1), np.int64)
        np.add.at(sums, (y[valid] + 1, x[valid] + 1), v[valid] - base)
        np.add.at(counts, (y[valid] + 1, x[valid] + 1), 1)
        sums, counts = (t.cumsum(0).cumsum(1) for t in (sums, counts))
        own = (x >= largest) & (x < largest + tile) & (y >= largest) & (y < largest + tile)
        x, y, h = x[own], y[own], held["half"].to_numpy()[own]
        total, n = (t[y + h + 1, x + h + 1] - t[y - h, x + h + 1] - t[y + h + 1, x - h] + t[y - h, x - h] for t in (sums, counts))
        mean = np.where(n > 0, (base * n + total) / np.maximum(n, 1), np.nan)  # of whole numbers as exact as their sum
        return pd.DataFrame({"col": x + left, "row": y + top, "half": h, "mean": mean, "n": n})

    out = sent.groupBy("_tx", "_ty").applyInPandas(means, "col long, row long, half long, mean double, n long")
    return out.withColumn("mean", F.when(F.col("n") > 0, F.col("mean")))


def texture(image: DataFrame, half: int, tile: int = TILE) -> DataFrame:
    """col, row, texture: the mean change of brightness to the next cell of the row and of the column, over a square.

    Null where no cell of the square is valid with both its next ones.
    """
    near = around(image, {"c": (0, 0), "e": (1, 0), "s": (0, 1)})
    change = image.select("col", "row").join(near.select("col", "row", (F.abs(F.col("e") - F.col("c")) + F.abs(F.col("s") - F.col("c"))).alias("v")), ["col", "row"], "left")
    return window_means(change.withColumn("half", F.lit(half)), "half", half, tile).select("col", "row", F.col("mean").alias("texture"))


def smooth_by_texture(cells: DataFrame, image: DataFrame, half: int, most: float, widest: int, median: int = 0, tile: int = TILE) -> DataFrame:
    """Valid cells of a disparity raster as means over squares, the wider the less texture its image has there: col, row, v, half.

    The square's side is `widest` * (1 - texture / most), taken down to an odd number: cells of a texture of `most` and
    above, or of none (outside the image), keep their value; those of no change at all are averaged over `widest`. Holes
    stay holes and count in no mean. The texture is the image's mean change over squares of side 2 * half + 1. With
    `median`, cells go through the median of squares of that half side first. A `most` that isn't above 0 raises.
    """
    if not most > 0:
        raise ValueError("most must be above 0")
    valid = cells.filter(F.col("v").isNotNull())
    if median:
        valid = median_filter(valid, median).withColumnRenamed("median", "v")
    side = F.floor(widest * (1 - F.col("texture") / most))
    wide = F.greatest(F.lit(0), F.floor((side - 1) / 2)).cast("long")
    asked = valid.join(texture(image, half, tile), ["col", "row"], "left").withColumn("half", F.when(F.col("texture").isNull(), 0).otherwise(wide))
    return window_means(asked, "half", max((widest - 1) // 2, 0), tile).select("col", "row", F.col("mean").alias("v"), "half")
