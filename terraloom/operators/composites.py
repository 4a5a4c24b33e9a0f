"""Clouds side by side, cutoffs from histograms, borders, shadows, descriptor matches and the kind of a camera."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.functions.geometry import rgb_to_ycbcr, ycbcr_to_rgb
from terraloom.operators.joins import bilinear


def side_by_side(cells: DataFrame, sizes: DataFrame, spacing: int) -> DataFrame:
    """cells(cloud, col, row, ...) of several clouds in one frame; sizes(cloud, cols, rows) has a line for each, in order of cloud.

    Where there are several, those wider than high are transposed. Each starts at a multiple of the spacing, with at
    least one spacing between it and the one before: so starts are running sums over the sizes, one line for each cloud.
    """
    several, up = Window.partitionBy(), Window.orderBy("cloud").rowsBetween(Window.unboundedPreceding, -1)  # one line a cloud
    turned = (F.col("rows") < F.col("cols")) & (F.count("*").over(several) > 1)
    placed = sizes.withColumn("_turned", turned).withColumn("_width", F.when(F.col("_turned"), F.col("rows")).otherwise(F.col("cols")))
    placed = placed.select("cloud", "_turned", F.coalesce(F.sum(spacing * (F.ceil(F.col("_width") / spacing) + 1)).over(up), F.lit(0)).alias("_start"))
    rest = [c for c in cells.columns if c not in ("cloud", "col", "row")]
    across, down = F.when(F.col("_turned"), F.col("row")).otherwise(F.col("col")), F.when(F.col("_turned"), F.col("col")).otherwise(F.col("row"))
    return cells.join(placed, "cloud").select("cloud", (F.col("_start") + across).alias("col"), down.alias("row"), *rest)


def histogram_cutoff(df: DataFrame, value: str, most: float, percent: float, factor: float, tukey: bool = False, bins: int = 1024) -> DataFrame:
    """q1, q2, q3, p and cutoff of the errors from a histogram: factor * p, or, Tukey, q3 + 1.5 * (q3 - q1).

    Errors above `most` count as it; zero errors and those that are null or NaN don't count. A percentile is the start of
    the first bin up to which the share of errors is reached. Without errors all are 0.
    """
    e = F.col(value).cast("double")
    place = F.round((bins - 1) * F.least(e, F.lit(most)) / most).cast("int")
    h = df.filter(e.isNotNull() & ~F.isnan(e) & (e != 0)).groupBy(place.alias("bin")).agg(F.count("*").alias("n")).filter("bin >= 0")
    h = h.withColumns({"_upto": F.sum("n").over(Window.orderBy("bin")), "_all": F.sum("n").over(Window.partitionBy())})  # at most `bins` lines
    at = lambda p: F.coalesce(F.min(F.when(F.col("_upto") >= p / 100 * F.col("_all"), F.col("bin"))), F.lit(0)) * most / bins
    found = h.agg(at(25).alias("q1"), at(50).alias("q2"), at(75).alias("q3"), at(percent).alias("p"))
    return found.withColumn("cutoff", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")) if tukey else factor * F.col("p"))


def outside_crop(x: Column, y: Column, size: tuple[int, int], crop: tuple[int, int]) -> Column:
    """Whether a pixel is farther from the image's middle than half the crop, in either direction; false where both sizes are equal."""
    return (F.abs(x - size[0] / 2) > crop[0] / 2) | (F.abs(y - size[1] / 2) > crop[1] / 2)


def _sine(degrees: float) -> float:
    """Sine, exact at whole right angles: a ray along a row must not lean to the next one."""
    return [0.0, 1.0, 0.0, -1.0][int(degrees // 90) % 4] if degrees % 90 == 0 else math.sin(math.radians(degrees))


def shadows(cells: DataFrame, spacing: tuple[float, float], azimuth: float, elevation: float) -> DataFrame:
    """Valid cells(col, row, v) with `shadow`: whether the surface hides the sun, which stands at azimuth (clockwise from
    north, rows grow southwards) and elevation in degrees, the frame being flat.

    A ray goes to the sun by half a cell at a time, until it is above the highest cell or leaves the frame; it is hidden
    where it is below the bilinear surface. Directions along rows and columns and a rise of 45 degrees are exact. Each cell asks for its own steps only; places next to holes hide nothing.
    """
    g = min(spacing)
    dx, dy = 0.5 * _sine(azimuth) * g / spacing[0], -0.5 * _sine(azimuth + 90) * g / spacing[1]
    rise = 0.5 * g * (1.0 if elevation == 45 else math.tan(math.radians(elevation)))
    frame = cells.agg(F.min("col").alias("_c0"), F.max("col").alias("_c1"), F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.max("v").alias("_top"))
    valid = cells.filter(F.col("v").isNotNull()).crossJoin(F.broadcast(frame))  # one line

    def until_edge(axis: str, step: float) -> list[Column]:
        if abs(step) < 1e-12:
            return []
        return [F.floor(((F.col(f"_{axis[0]}1") - F.col(axis)) if step > 0 else (F.col(axis) - F.col(f"_{axis[0]}0"))) / abs(step) + 1e-9)]

    ends = [*until_edge("col", dx), *until_edge("row", dy), *([F.floor((F.col("_top") - F.col("v")) / rise)] if rise > 0 else [])]
    ends = F.least(*ends) if len(ends) > 1 else ends[0]
    asked = valid.withColumn("_n", ends).filter("_n >= 1").withColumn("_s", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    clamp = lambda c, d: F.least(F.greatest(F.col(c) + F.col("_s") * d, F.col(f"_{c[0]}0")), F.col(f"_{c[0]}1"))
    asked = asked.select("col", "row", (F.col("v") + F.col("_s") * rise).alias("_ray"), clamp("col", dx).alias("px"), clamp("row", dy).alias("py"))
    hidden = bilinear(asked, cells).filter(F.col("_ray") < F.col("value")).select("col", "row").distinct().withColumn("_hidden", F.lit(True))
    return valid.select("col", "row", "v").join(hidden, ["col", "row"], "left").select("col", "row", "v", F.coalesce("_hidden", F.lit(False)).alias("shadow"))


def match_descriptors(a: DataFrame, b: DataFrame, tile: str, ratio: float, hamming: bool = False, block: int = 4096) -> DataFrame:
    """tile, id_a, id_b, distance: for each point of a its nearest of the same tile of b, if nearer than ratio times the second nearest.

    a and b hold tile, id and descriptor (an array of numbers of one length; bytes as numbers for Hamming distances). Ties go
    to the smaller id. A tile with fewer than two points of b gives nothing. Null or broken descriptors take no part. A
    tile's points are cut into blocks, of `block` on average on the side of a and 16 times that on that of b; a task holds one of each side and takes the distances of one point at a time,
    and a point's two nearest of each block are compared after that.
    """
    good = lambda d: d.filter(F.col("descriptor").isNotNull() & ~F.exists("descriptor", lambda x: x.isNull() | F.isnan(x.cast("double"))) & F.col(tile).isNotNull()).select(F.col(tile).alias("tile"), "id", "descriptor")
    bits = np.array([bin(k).count("1") for k in range(256)], np.int64)

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows, found, far = [], [], []
        if len(left) and len(right):
            right = right.sort_values("id")
            there = np.array(right["descriptor"].tolist(), float)
            for row, h in enumerate(left["descriptor"]):
                if hamming:
                    d = bits[np.asarray(h).astype(np.uint8) ^ there.astype(np.uint8)].sum(axis=1).astype(float)
                else:
                    d = np.sqrt(((np.asarray(h, float) - there) ** 2).sum(axis=1))
                for _ in range(min(2, len(d))):
                    at = d.argmin()
                    rows.append(row), found.append(at), far.append(d[at])
                    d[at] = np.inf
        return left[["line", "tile", "id"]].iloc[rows].assign(id_b=right["id"].to_numpy()[np.array(found, int)], distance=far)

    left, right = (good(d).select(*(F.col(c).alias(c) for c in ("tile", "id", "descriptor"))) for d in (a, b))  # a and b may be one
    left = left.withColumn("line", F.monotonically_increasing_id())
    parts = lambda d, name, rows: d.groupBy("tile").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    blocks = parts(left, "asked", block).join(parts(right, "searched", 16 * block), "tile")
    place = lambda key, name: F.pmod(F.xxhash64(key), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    asked = left.join(blocks, "tile").select("tile", "line", "id", "descriptor", place("line", "asked").alias("i"), every("searched").alias("j"))
    searched = right.join(blocks, "tile").select("tile", "id", "descriptor", every("asked").alias("i"), place("id", "searched").alias("j"))
    keys = ["tile", "i", "j"]
    schema = T.StructType([T.StructField("line", T.LongType()), left.schema["tile"], left.schema["id"], T.StructField("id_b", right.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    found = asked.groupBy(*keys).cogroup(searched.groupBy(*keys)).applyInPandas(nearest, schema)
    near = F.slice(F.array_sort(F.collect_list(F.struct("distance", "id_b"))), 1, 2)
    best = found.groupBy("line").agg(F.first("tile").alias("tile"), F.first("id").alias("id_a"), near.alias("n"))
    best = best.filter((F.size("n") == 2) & (F.col("n")[0]["distance"] < ratio * F.col("n")[1]["distance"]))
    return best.select("tile", "id_a", F.col("n")[0]["id_b"].alias("id_b"), F.col("n")[0]["distance"].alias("distance"))


def camera_kind(left_image: Column, right_image: Column, left_camera: Column, right_camera: Column) -> Column:
    """The kind of camera that names tell by their endings, in this order; null where contents would have to be read.

    Pinhole files, CSM state files, ISIS cubes, SPOT metadata. Names of XML files don't tell their maker.
    """
    ends = lambda cols, *endings: F.coalesce(F.greatest(*(F.coalesce(F.lower(c).endswith(e), F.lit(False)) for c in cols for e in endings)), F.lit(False))
    cameras, every = [left_camera, right_camera], [left_image, right_image, left_camera, right_camera]
    return F.when(ends(cameras, ".tsai", ".pinhole"), "pinhole").when(ends(cameras, ".json", ".isd"), "csm").when(ends(every, ".cub"), "isis").when(ends(cameras, ".dim"), "spot")


def pan_sharpened(grey: DataFrame, colours: DataFrame, lo: float = 0.0, hi: float = 255.0) -> DataFrame:
    """col, row, r, g, b of grey(col, row, v, px, py): the colours between the four nodes around (px, py), with v for their luma.

    colours(col, row, r, g, b) is the coarser raster. All values are kept between lo and hi. Null where the grey cell or a
    node of weight is a hole or outside. One join and one aggregation by cell; a place is taken to occur once.
    """
    c, r = F.floor("px"), F.floor("py")
    fx, fy = F.col("px") - c, F.col("py") - r
    nodes = F.array(*(F.struct((c + i).alias("x"), (r + j).alias("y"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)))
    asked = grey.select("col", "row", "v", F.explode_outer(F.filter(nodes, lambda n: n["w"] > 0)).alias("n")).select("col", "row", "v", F.col("n.x").alias("x"), F.col("n.y").alias("y"), F.col("n.w").alias("w"))
    there = colours.select(F.col("col").alias("x"), F.col("row").alias("y"), "r", "g", "b")
    between = lambda n: F.when(F.count(n) == F.count("*"), F.sum(F.col("w") * F.col(n))).alias(n)
    mixed = asked.join(there, ["x", "y"], "left").groupBy("col", "row", "v").agg(*(between(n) for n in "rgb"))
    _, cb, cr = rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"), lo, hi)
    whole = F.col("v").isNotNull() & F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()
    sharp = ycbcr_to_rgb(F.col("v"), cb, cr, lo, hi)
    return mixed.select("col", "row", *(F.when(whole, s).alias(n) for s, n in zip(sharp, "rgb", strict=True)))
