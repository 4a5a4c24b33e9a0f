"""Point clouds on grids: every cell gathers the points within a closed disc around its centre."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.statistics import NMAD_FACTOR

FILTERS = ("weighted_average", "min", "max", "mean", "median", "stddev", "count", "nmad")
#: The Gaussian weight falls to a quarter at one spacing.
SIGMA_NUMERATOR = -math.log(0.25)
#: Distances at which the Gaussian is known; others take the nearest one's weight.
SAMPLES = 1000


def points_by_cell(points: DataFrame, spacing: float, radius: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """points(x, y, z, ...) with col, row and dist, once for every cell whose centre is within the radius.

    A bounded fan-out: candidate cells are listed from the point's own position, so no range join is needed.
    """
    def cells(v: str, o: float) -> F.Column:
        return F.sequence(F.ceil((F.col(v) - radius - o) / spacing), F.floor((F.col(v) + radius - o) / spacing))

    near = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    near = near.withColumn("col", F.explode(cells("x", origin[0]))).withColumn("row", F.explode(cells("y", origin[1])))
    dist = F.sqrt(F.pow(F.col("x") - origin[0] - F.col("col") * spacing, 2) + F.pow(F.col("y") - origin[1] - F.col("row") * spacing, 2))
    return near.withColumn("dist", dist).filter(F.col("dist") <= radius)


def gaussian_weight(dist: F.Column, spacing: float, radius: float, least_spacing: float = 0.0, sigma_factor: float = 0.0) -> F.Column:
    """The weight at a distance, taken from SAMPLES even steps between 0 and the radius."""
    sigma = (sigma_factor if sigma_factor > 0 else SIGMA_NUMERATOR) / max(spacing, least_spacing) ** 2
    step = radius / (SAMPLES - 1.0)
    return F.exp(-F.lit(sigma) * F.pow(F.floor(dist / step + 0.5) * step, 2))


def grid(points: DataFrame, spacing: float, radius: float, filters: tuple[str, ...] = FILTERS, origin: tuple[float, float] = (0.0, 0.0), least_spacing: float = 0.0, sigma_factor: float = 0.0, frame: DataFrame | None = None) -> DataFrame:
    """col, row and a column for each filter; a filter like "80-pct" is that percentile (interpolated).

    Cells without points are absent, or, with a frame(col, row), null with a count of 0. One exchange by cell: the
    median that nmad needs is a window over the same partitioning.
    """
    near = points_by_cell(points, spacing, radius, origin)
    weight = gaussian_weight(F.col("dist"), spacing, radius, least_spacing, sigma_factor)
    makers = {
        "weighted_average": lambda: F.sum(weight * F.col("z")) / F.sum(weight),
        "min": lambda: F.min("z"),
        "max": lambda: F.max("z"),
        "mean": lambda: F.avg("z"),
        "median": lambda: F.median("z"),
        "stddev": lambda: F.stddev_pop("z"),
        "count": lambda: F.count("z"),
        "nmad": lambda: NMAD_FACTOR * F.median(F.abs(F.col("z") - F.col("_m"))),
    }
    if "nmad" in filters:
        near = near.withColumn("_m", F.median("z").over(Window.partitionBy("col", "row")))
    wanted = [makers[f]().alias(f) if f in makers else F.percentile("z", float(f.removesuffix("-pct")) / 100).alias(f) for f in filters]
    out = near.groupBy("col", "row").agg(*wanted)
    if frame is not None:
        out = frame.select("col", "row").join(out, ["col", "row"], "left")
        out = out.fillna(0, ["count"]) if "count" in filters else out
    return out.select("col", "row", *(F.col(f"`{f}`") for f in filters))
