"""Summaries of residuals, differences and rasters, as reports have them. Global order statistics go by value ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions import statistics as S


def _beside(df: DataFrame, picked: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return df.crossJoin(F.broadcast(picked))
    renamed = picked.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(renamed, same, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def difference_summary(df: DataFrame, value: str) -> DataFrame:
    """max, min, mean, population stddev, upper median and number of all values."""
    out = df.agg(F.max(value).alias("max"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"), F.count(value).alias("n"))
    return _beside(out, S.picks(df, value, {"median": S.upper_middle()}), []).select("max", "min", "mean", "stddev", "median", "n")


def camera_report(res: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """mean, upper median and number of residuals of each camera."""
    out = res.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return _beside(out, S.picks(res, value, {"median": S.upper_middle()}, keys), keys).select(*keys, "mean", "median", "n")


def point_report(res: DataFrame, value: str, key: str) -> DataFrame:
    """mean residual and number of observations of each point."""
    return res.groupBy(key).agg(F.avg(value).alias("mean_residual"), F.count(value).alias("num_observations"))


def percentile_report(res: DataFrame, value: str, keys: list[str], percents: tuple[int, ...] = (25, 50, 75, 85, 95)) -> DataFrame:
    """Percentiles (element floor(p * n)) and number of the values of each group, such as a pair of images."""
    return S.picks(res, value, {f"p{p}": S.floor_place(p / 100) for p in percents}, keys, "num")


def both_sides(pairs: DataFrame, left: str, right: str, value: str, name: str = "image") -> DataFrame:
    """image, value: each row of a pair once for either side, for reports of single images."""
    return pairs.select(F.explode(F.array(left, right)).alias(name), value)


def error_summary(df: DataFrame, value: str) -> DataFrame:
    """p16, p50, p84; mean of the smallest 25, 50, 75 and 100 %; mean, stddev, rmse, median and nmad of all errors.

    p16 and p84 are elements round(p * n); the median is the mean of the two middle values; stddev is the population's.
    """
    h = S.value_ranks(df, value)
    parts: list[Column] = [F.min(F.when(F.col("upto") > S.rounded_place(p / 100), F.col(value))).alias(f"p{p}") for p in (16, 84)]
    for quarter in (1, 2, 3, 4):
        most = F.floor(quarter * F.col("n") / 4)
        took = F.greatest(F.lit(0), F.least(F.col("c"), most - (F.col("upto") - F.col("c"))))
        parts.append(F.try_divide(F.sum(took * F.col(value)), F.sum(took)).alias(f"best{25 * quarter}"))
    out = h.agg(*parts).crossJoin(F.broadcast(df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rmse"))))
    return out.crossJoin(F.broadcast(S.centre_and_nmad(df.filter(F.col(value).isNotNull()), value))).withColumn("p50", F.col("median"))


def masked_statistics(df: DataFrame, value: str) -> DataFrame:
    """count, mean, stddev (population), median and nmad of the valid cells."""
    out = df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"))
    return out.crossJoin(F.broadcast(S.centre_and_nmad(df.filter(F.col(value).isNotNull()), value)))


def image_statistics(cells: DataFrame, step: int = 1) -> DataFrame:
    """min, max, median, nmad, p2 and p98 of each image(idx) of cells, on every step-th column and row."""
    v = cells.filter(F.col("v").isNotNull() & (F.col("col") % step == 0) & (F.col("row") % step == 0))
    ends = v.groupBy("idx").agg(F.min("v").alias("min"), F.max("v").alias("max"))
    mid = S.medians(v, "v", ["idx"])
    off = v.join(F.broadcast(mid), "idx").select("idx", F.abs(F.col("v") - F.col("median")).alias("off"))
    nmad = S.medians(off, "off", ["idx"]).select("idx", (S.NMAD_FACTOR * F.col("median")).alias("nmad"))
    tails = S.picks(v, "v", {"p2": S.floor_place(0.02), "p98": S.floor_place(0.98)}, ["idx"])
    return ends.join(mid, "idx").join(nmad, "idx").join(tails, "idx").select("idx", "min", "max", "median", "nmad", "p2", "p98")


def normalisation_bounds(stats: DataFrame, whole_range: bool = False, each: bool = False, percentiles: bool = False, stay_inside: bool = False) -> DataFrame:
    """lo and hi of each image from image_statistics: its range, its percentiles, or median -+ 2 nmad.

    Unless `each`, all images share the least lo and the largest hi; stay_inside limits them to each image's own range.
    """
    lo, hi = ("min", "max") if whole_range else ("p2", "p98") if percentiles else (F.col("median") - 2 * F.col("nmad"), F.col("median") + 2 * F.col("nmad"))
    out = stats.select("idx", "min", "max", (F.col(lo) if isinstance(lo, str) else lo).alias("lo"), (F.col(hi) if isinstance(hi, str) else hi).alias("hi"))
    if not each:
        out = out.drop("lo", "hi").crossJoin(F.broadcast(out.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))))
    if stay_inside:
        out = out.withColumns({"lo": F.greatest("lo", "min"), "hi": F.least("hi", "max")})
    return out.select("idx", "lo", "hi")


def normalised(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Cells scaled so that their image's lo is 0 and hi is 1; not clamped."""
    return cells.join(F.broadcast(bounds), "idx").select("idx", "col", "row", F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")).alias("v"))


def percentile_stretch(cells: DataFrame, low: float = 2.0, high: float = 98.0) -> DataFrame:
    """Each image's cells between two percentiles as whole numbers 0 to 255, rounded and clamped; holes become 0."""
    v = cells.filter(F.col("v").isNotNull())
    s = S.picks(v, "v", {"lo": S.floor_place(low / 100), "hi": S.floor_place(high / 100)}, ["idx"])
    scaled = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255 + 0.5)
    stretched = F.greatest(F.lit(0), F.least(F.lit(255), scaled))
    return cells.join(F.broadcast(s), "idx", "left").select("idx", "col", "row", F.when(F.col("v").isNotNull(), stretched).otherwise(0).cast("smallint").alias("stretched"))


def binned_statistics(df: DataFrame, x: str, y: str, bins: int, lo: float, hi: float) -> DataFrame:
    """bin (from 0), mean, n and median of y for x in equal bins of the closed range; all bins are there, empty ones 0."""
    width = (hi - lo) / bins
    inside = df.filter(F.col(x).between(lo, hi) & F.col(y).isNotNull())
    b = inside.select(F.least(F.floor((F.col(x) - lo) / width), F.lit(bins - 1)).alias("bin"), F.col(y).alias("y"))
    out = b.groupBy("bin").agg(F.avg("y").alias("mean"), F.count("y").alias("n")).join(S.medians(b, "y", ["bin"]), "bin")
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(out, "bin", "left").fillna(0)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, n, lo, hi: numbers of values in equal bins between the least and the largest, the last bin closed."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    place = F.greatest(F.lit(0), F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    return df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(place, F.lit(0)).alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))


def histogram_percentile(hist: DataFrame, p: float, bins: int) -> DataFrame:
    """value: the upper edge of the first bin up to which a share p of the values lies."""
    c = hist.withColumns({"_upto": F.sum("n").over(Window.orderBy("bin")), "_n": F.sum("n").over(Window.partitionBy())})  # at most `bins` rows
    first = c.filter(F.col("_upto") >= p * F.col("_n")).agg(F.min("bin").alias("bin"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    return first.select((F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("value"))


def otsu_threshold(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """threshold: the lower edge of the bin after the split with the largest variance between both classes."""
    if bins < 100:
        raise ValueError("at least 100 bins")
    h = histogram(df, value, bins)
    up, all_ = Window.orderBy("bin"), Window.partitionBy()  # at most `bins` rows
    c = h.select("bin", "lo", "hi", F.sum("n").over(up).alias("below"), F.sum(F.col("n") * F.col("bin")).over(up).alias("mass"), F.sum("n").over(all_).alias("total"), F.sum(F.col("n") * F.col("bin")).over(all_).alias("whole"))
    var = F.pow(F.col("whole").cast("double") * F.col("below") / F.col("total") - F.col("mass"), 2) / (F.col("below").cast("double") * (F.col("total") - F.col("below")))
    best = c.filter("below < total").withColumn("v", F.round(var, 6)).orderBy(F.desc("v"), "bin").limit(1)
    return best.select((F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("threshold"))


def density_minimum(sample: DataFrame, value: str, points: int, bandwidth: float, lo: float, hi: float) -> DataFrame:
    """at: the first place of `points` even ones in lo..hi where the Gaussian kernel density of the values has a local minimum.

    Values are counted in cells of a hundredth of the bandwidth first, so the work is bounded by the range, not the rows.
    """
    cell = bandwidth / 100
    counts = sample.filter(F.col(value).between(lo - 8 * bandwidth, hi + 8 * bandwidth)).groupBy(F.floor(F.col(value) / cell + 0.5).alias("k")).agg(F.count("*").alias("n"))
    at = sample.sparkSession.range(points).select(F.col("id").alias("i"), (F.lit(lo) + F.col("id") * ((hi - lo) / (points - 1))).alias("at"))
    dens = F.sum(F.col("n") * F.exp(-0.5 * F.pow((F.col("at") - F.col("k") * cell) / bandwidth, 2)))
    d = counts.crossJoin(F.broadcast(at)).groupBy("i", "at").agg(dens.alias("d"))  # `points` numbers beside bounded counts
    w = Window.orderBy("i")
    return d.withColumns({"_a": F.lag("d").over(w), "_b": F.lead("d").over(w)}).filter("d < _a AND d < _b").orderBy("i").limit(1).select("at")


def error_cutoff(df: DataFrame, value: str, percent: float, factor: float, tukey: bool = False) -> DataFrame:
    """cutoff of positive errors: factor times their percentile (element floor(p * n)), or, Tukey, q3 + 1.5 * (q3 - q1)."""
    positive = df.filter(F.col(value) > 0)
    p = S.picks(positive, value, {"q1": S.floor_place(0.25), "q2": S.floor_place(0.5), "q3": S.floor_place(0.75), "p": S.floor_place(percent / 100)})
    cut = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")) if tukey else factor * F.col("p")
    return p.select("q1", "q2", "q3", cut.alias("cutoff"))


def offset_report(cameras: DataFrame, offsets: DataFrame, key: str, value: str) -> DataFrame:
    """mean, median and count of each camera's offsets; cameras without any have NaN and 0."""
    found = offsets.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("count")).join(S.medians(offsets, value, [key]), key)
    return cameras.select(key).join(found, key, "left").fillna({"mean": float("nan"), "median": float("nan"), "count": 0}).select(key, "mean", "median", "count")


def pair_errors(pairs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median, mean and sample stddev (0 below two values) of each pair's errors."""
    out = pairs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"), F.count(value).alias("n"))
    out = out.withColumn("stddev", F.when(F.col("n") > 1, F.col("stddev")).otherwise(0.0))
    return out.join(S.medians(pairs, value, keys), keys).select(*keys, "median", "mean", "stddev", "n")


def largest_changes(moves: DataFrame, key: str) -> DataFrame:
    """moves(key, north, east, down): the largest horizontal and vertical change of each camera's positions."""
    flat = F.sqrt(F.col("north") * F.col("north") + F.col("east") * F.col("east"))
    return moves.groupBy(key).agg(F.max(flat).alias("horizontal"), F.max(F.abs("down")).alias("vertical"))


def coverage(cells: DataFrame, value: str, cutoff: float, keys: list[str]) -> DataFrame:
    """masked (below 0), invalid (0, or from the cutoff on) and the valid share of what isn't masked."""
    v = F.col(value)
    masked, invalid = F.count_if(v < 0), F.count_if((v == 0) | (v >= cutoff))
    return cells.groupBy(*keys).agg(masked.alias("masked"), invalid.alias("invalid"), F.try_divide(F.count(v) - masked - invalid, F.count(v) - masked).alias("valid_fraction"))


def tile_coverage(points: DataFrame, width: int, height: int, tile: int = 1024, least: int = 2) -> DataFrame:
    """fraction of whole tiles of a frame with more than `least` points(x, y); partial tiles at the edges don't count."""
    across, down = width // tile, height // tile
    t = points.select(F.floor(F.floor("x") / tile).alias("tx"), F.floor(F.floor("y") / tile).alias("ty")).filter(F.col("tx").between(0, across - 1) & F.col("ty").between(0, down - 1))
    full = t.groupBy("tx", "ty").agg(F.count("*").alias("n")).filter(F.col("n") > least)
    return full.agg((F.count("*") / max(across * down, 1)).alias("fraction"))


def trimmed_mean(df: DataFrame, value: str) -> DataFrame:
    """mean of the values at places floor(n / 4) to ceil(3 n / 4), the last excluded."""
    h = S.value_ranks(df, value)
    lo, hi = F.floor(0.25 * F.col("n")), F.ceil(0.75 * F.col("n"))
    took = F.greatest(F.lit(0), F.least("upto", hi) - F.greatest(F.col("upto") - F.col("c"), lo))
    return h.agg(F.try_divide(F.sum(took * F.col(value)), F.sum(took)).alias("mean"))


def tile_medians(points: DataFrame, tile: float) -> DataFrame:
    """x, y, z: the median over tiles of the points' medians in each tile."""
    per = points.groupBy(F.floor(F.col("x") / tile), F.floor(F.col("y") / tile)).agg(*(F.median(c).alias(c) for c in "xyz"))
    out = S.medians(per, "x", name="x")
    for c in "yz":
        out = out.crossJoin(F.broadcast(S.medians(per, c, name=c)))
    return out


def joint_statistics(pair: DataFrame, a: str, b: str) -> DataFrame:
    """means and population stddevs of two images on the cells valid in both."""
    v = pair.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return v.agg(F.avg(a).alias("mean_a"), F.stddev_pop(a).alias("std_a"), F.avg(b).alias("mean_b"), F.stddev_pop(b).alias("std_b"), F.count("*").alias("n"))


def merged_summaries(parts: DataFrame) -> DataFrame:
    """Summaries(max, min, mean, stddev) of batches as one: plain means of mean and stddev; what is missing becomes -999."""
    out = parts.agg(F.max("max").alias("max"), F.min("min").alias("min"), F.avg("mean").alias("mean"), F.avg("stddev").alias("stddev"))
    return out.fillna(-999.0)


def disparity_range(cells: DataFrame, dx: str, dy: str) -> DataFrame:
    """Whole-number box of the valid disparities."""
    v = cells.filter(F.col(dx).isNotNull() & F.col(dy).isNotNull())
    return v.agg(F.floor(F.min(dx)).alias("x0"), F.floor(F.min(dy)).alias("y0"), F.ceil(F.max(dx)).alias("x1"), F.ceil(F.max(dy)).alias("y1"))


def centroid_shift(a: DataFrame, b: DataFrame) -> DataFrame:
    """The translation (dx, dy, dz) from the centroid of points a to that of b."""
    mean = lambda df, s: df.agg(*(F.avg(c).alias(c + s) for c in "xyz"))
    both = mean(a, "_a").crossJoin(F.broadcast(mean(b, "_b")))
    return both.select(*((F.col(c + "_b") - F.col(c + "_a")).alias("d" + c) for c in "xyz"))


def cross_covariance(pairs: DataFrame, left: tuple[str, str, str], right: tuple[str, str, str]) -> DataFrame:
    """The nine sums and two variances from which a rigid or similarity transform between point pairs follows."""
    sums = [F.covar_pop(a, b).alias(f"s{i}{j}") for i, a in enumerate(left) for j, b in enumerate(right)]
    spread = lambda v: sum((F.var_pop(c) for c in v[1:]), F.var_pop(v[0]))
    return pairs.agg(*sums, spread(left).alias("var_left"), spread(right).alias("var_right"))


def similarity_transform(pairs: DataFrame, left: tuple[str, str, str], right: tuple[str, str, str], scaled: bool = True):
    """(rotation 3 x 3, translation, scale) that takes left points to right ones in the least-squares sense.

    All points are reduced to one row of sums in Spark; only that row is decomposed on the driver.
    """
    import numpy as np

    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate((*left, *right))]
    r, m = cross_covariance(pairs, left, right).first(), pairs.agg(*means).first()
    s = np.array([[r[f"s{i}{j}"] for j in range(3)] for i in range(3)])
    u, d, vt = np.linalg.svd(s.T)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    rotation = u @ flip @ vt
    scale = float((d * np.diag(flip)).sum() / r["var_left"]) if scaled else 1.0
    a, b = np.array([m[f"m{i}"] for i in range(3)]), np.array([m[f"m{i}"] for i in range(3, 6)])
    return rotation, b - scale * rotation @ a, scale


def plane(points: DataFrame):
    """(normal, offset) of the best-fit plane normal . p = offset, from one row of sums; the normal points up."""
    import numpy as np

    r = points.agg(*(F.covar_pop(a, b).alias(a + b) for a in "xyz" for b in "xyz"), *(F.avg(a).alias(a) for a in "xyz")).first()
    values, vectors = np.linalg.eigh(np.array([[r[a + b] for b in "xyz"] for a in "xyz"]))
    normal = vectors[:, 0] * (1 if vectors[2, 0] >= 0 else -1)
    return normal, float(normal @ np.array([r[a] for a in "xyz"]))


def plane_distances(points: DataFrame, normal, offset: float, threshold: float) -> DataFrame:
    """max and mean distance of the points to a plane, and how many lie within the threshold."""
    d = F.abs(F.col("x") * float(normal[0]) + F.col("y") * float(normal[1]) + F.col("z") * float(normal[2]) - float(offset))
    return points.agg(F.max(d).alias("max"), F.avg(d).alias("mean"), F.count_if(d <= threshold).alias("inliers"))


def fit_aspect(bins: DataFrame) -> DataFrame:
    """bins(aspect in degrees, value, n): the sums from which value = a cos(b - aspect) + c follows, which is linear in a cos b, a sin b and c."""
    t = F.radians("aspect")
    c, s, w = F.cos(t), F.sin(t), F.col("n")
    terms = {"cc": c * c, "cs": c * s, "ss": s * s, "c": c, "s": s, "one": F.lit(1.0), "cv": c * F.col("value"), "sv": s * F.col("value"), "v": F.col("value")}
    return bins.agg(*(F.sum(w * x).alias(k) for k, x in terms.items()))
