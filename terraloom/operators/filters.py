"""Filters and weights of clouds, rasters and matches: limits, outlier brackets and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions import statistics as S
from terraloom.functions.geometry import angle_between


def cloud_chain(points: DataFrame, most_error: float = 0.0, most_distance: float = 0.0, ray_to_normal: float = 0.0, dir_to_normal: float = 0.0, dir_to_ray: float = 0.0, distance_power: float = 0.0, least_texture: float | None = None) -> DataFrame:
    """Points with a weight, without those beyond any limit that is above 0.

    Columns: x, y, z, err; with angles ray (an array of three: point less camera), normal and dir as arrays of three.
    Angles are in degrees and don't tell a vector from its opposite; one that can't be formed removes the point. The
    weight is distance to the power -distance_power, 1 where that is 0. A texture below least_texture removes the point.
    """
    vec = lambda name: [F.col(name)[i] for i in range(3)]
    size = lambda name: F.sqrt(sum((F.col(name)[i] * F.col(name)[i] for i in (1, 2)), F.col(name)[0] * F.col(name)[0]))

    def limit(df: DataFrame, a: str, b: str, most: float) -> DataFrame:
        angle = angle_between(vec(a), vec(b))
        return df.filter(F.least(angle, 180 - angle) <= most)

    out = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    if most_error > 0:
        out = out.filter(F.col("err") <= most_error)
    if most_distance > 0:
        out = out.filter(size("ray") <= most_distance)
    if ray_to_normal > 0:
        out = limit(out, "ray", "normal", ray_to_normal)
    elif dir_to_normal > 0:
        out = limit(out, "dir", "normal", dir_to_normal)
    if dir_to_ray > 0:
        out = limit(out, "dir", "ray", dir_to_ray)
    if least_texture is not None:
        out = out.filter(F.col("texture") >= least_texture)
    if distance_power > 0:
        return out.filter(size("ray") > 0).withColumn("weight", F.pow(size("ray"), -distance_power))
    return out.withColumn("weight", F.lit(1.0))


def reliability_weight(residual: Column, reliable: float) -> Column:
    """exp(-residual / reliable)."""
    return F.exp(-residual / reliable)


def boundary_weight(distance: Column, reach: float, power: float) -> Column:
    """A weight that grows from the border to 1 at `reach` cells: (distance / reach), at most 1, to a power."""
    return F.pow(F.least(distance / reach, F.lit(1.0)), power)


def in_range(value: Column, lo: float, hi: float) -> Column:
    """The value, null outside the closed range."""
    return F.when(value.between(lo, hi), value)


def mad_filter(df: DataFrame, value: str, factor: float) -> DataFrame:
    """df with the value null where it is farther than factor * nmad from the median."""
    c = S.centre_and_nmad(df.filter(F.col(value).isNotNull()), value)
    kept = F.when(F.abs(F.col(value) - F.col("median")) <= factor * F.col("nmad"), F.col(value))
    return df.crossJoin(F.broadcast(c)).withColumn(value, kept).drop("median", "nmad")


def intersect_valid(cells: DataFrame, other: DataFrame) -> DataFrame:
    """cells(col, row, v) with v null where the other raster has no valid cell."""
    there = other.filter("v IS NOT NULL").select("col", "row", F.lit(True).alias("_in"))
    return cells.join(there, ["col", "row"], "left").withColumn("v", F.when(F.col("_in"), F.col("v"))).drop("_in")


def above_threshold(value: Column, threshold: float) -> Column:
    """The value, null (no data) where it is at or below the threshold or not a number."""
    return F.when((value > threshold) & ~F.isnan(value.cast("double")), value)


def valid_by_weight(value: Column, weight: Column) -> Column:
    """The value, null where its weight isn't positive."""
    return F.when(weight > 0, value)


def inlier_box(points: DataFrame, percent: float = 75.0, factor: float = 3.0, most_error: float | None = None) -> DataFrame:
    """One row: lo and hi of x, y and z without outliers.

    Brackets around the percentiles (1 + p) / 2 of x and y and (3 + p) / 4 of z, widened by twice the factor times
    their width: isolated peaks and corners of turned frames stay inside. Points above most_error don't count.
    """
    p = percent / 100
    v = points.dropna(subset=["x", "y", "z"])
    if most_error is not None and most_error > 0:
        v = v.filter(F.col("err") <= most_error)
    share = {"x": (1 + p) / 2, "y": (1 + p) / 2, "z": (3 + p) / 4}
    box = None
    for c, q in share.items():
        wide = 2 * factor * (F.col("_b") - F.col("_a"))
        side = S.shares(v, c, {"_a": 1 - q, "_b": q}).select((F.col("_a") - wide).alias(f"{c}_lo"), (F.col("_b") + wide).alias(f"{c}_hi"))
        box = side if box is None else box.crossJoin(F.broadcast(side))  # one row each
    return box


def inside_box(points: DataFrame, box: DataFrame) -> DataFrame:
    """Points inside the one box, borders included."""
    hit = [F.col(c).between(F.col(f"{c}_lo"), F.col(f"{c}_hi")) for c in "xyz"]
    return points.crossJoin(F.broadcast(box)).filter(hit[0] & hit[1] & hit[2]).select(*points.columns)


def error_and_box(points: DataFrame, percent: float = 75.0, factor: float = 3.0) -> DataFrame:
    """most_error (four times factor times the percentile of the positive errors) and the inlier box of points up to it.

    Over all points, so no sampling has to be repeated at finer steps.
    """
    positive = points.filter(F.col("err") > 0)
    cut = S.picks(positive, "err", {"p": S.floor_place(percent / 100)}).select((F.col("p") * factor * 4.0).alias("most_error"))
    kept = points.crossJoin(F.broadcast(cut)).filter(F.col("err") <= F.col("most_error")).drop("most_error")
    return cut.crossJoin(F.broadcast(inlier_box(kept, percent, factor)))


def bracket_chain(df: DataFrame, steps: list[tuple[str, float, float]]) -> DataFrame:
    """Rows inside the brackets of each (column, percent, factor) in turn, each judged on what the ones before kept."""
    for value, percent, factor in steps:
        df = S.within_brackets(df, value, percent / 100, factor)
    return df


def spread_filter(df: DataFrame, columns: list[str], spread: float) -> DataFrame:
    """Rows within half the spread of the upper median of each column; the upper border is excluded."""
    if spread <= 0:
        return df
    mid = None
    for i, c in enumerate(columns):
        m = S.picks(df, c, {f"_m{i}": S.upper_middle()})
        mid = m if mid is None else mid.crossJoin(F.broadcast(m))
    out = df.crossJoin(F.broadcast(mid))
    for i, c in enumerate(columns):
        out = out.filter((F.col(c) >= F.col(f"_m{i}") - spread / 2) & (F.col(c) < F.col(f"_m{i}") + spread / 2))
    return out.drop(*(f"_m{i}" for i in range(len(columns))))


def match_brackets(matches: DataFrame, percent: float, factor: float) -> DataFrame:
    """matches(lx, ly, rx, ry, ...) whose disparities lie inside both brackets, which are taken over all matches."""
    d = matches.withColumns({"_dx": F.col("rx") - F.col("lx"), "_dy": F.col("ry") - F.col("ly")})
    for c in ("_dx", "_dy"):
        b = S.brackets(matches.select((F.col("rx") - F.col("lx") if c == "_dx" else F.col("ry") - F.col("ly")).alias(c)), c, percent / 100, factor)
        d = d.crossJoin(F.broadcast(b)).filter(F.col(c).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    return d.drop("_dx", "_dy")


def off_side_edges(points: DataFrame, width: int, margin: float) -> DataFrame:
    """Points at least `margin` from the left and right edge of an image."""
    return points.filter((F.col("x") >= margin) & (F.col("x") < width - margin))


def off_borders(points: DataFrame, width: int, height: int, margin: float) -> DataFrame:
    """Points at least `margin` inside all four borders."""
    return off_side_edges(points, width, margin).filter((F.col("y") >= margin) & (F.col("y") < height - margin))


def within_limits(points: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Points whose columns lie in closed ranges, such as elevation, lon and lat."""
    for c, (lo, hi) in limits.items():
        points = points.filter(F.col(c).between(lo, hi))
    return points


def error_clusters(df: DataFrame, value: str, rounds: int = 20) -> DataFrame:
    """Rows of the better of two Gaussian clusters of errors, or the best 70 % where no cluster is tight.

    Zero errors count as very large. The two clusters' means and variances come from rounds of sums in Spark; the driver
    sees one row a round. A row stays if the better cluster explains it more, or if it is below that cluster's mean.
    """
    import math

    e = F.when(F.col(value) == 0, F.lit(9999999.0)).otherwise(F.col(value))
    v = df.select(e.cast("double").alias("e"))
    facts = v.agg(F.avg("e").alias("mean"), F.var_pop("e").alias("var"), F.count("*").alias("n")).first()
    if not facts["n"]:
        return df
    tight = S.centre_and_nmad(v, "e").first()
    # one cluster starts as the values around the median, the other as all of them
    mean, var, share = [tight["median"], facts["mean"]], [max(tight["nmad"] ** 2, 1e-12), max(facts["var"], 1e-12)], [0.5, 0.5]
    for _ in range(rounds):
        dens = [share[k] / math.sqrt(var[k]) * F.exp(-F.pow(F.col("e") - mean[k], 2) / (2 * var[k])) for k in (0, 1)]
        part = F.coalesce(F.try_divide(dens[0], dens[0] + dens[1]), (F.abs(F.col("e") - mean[0]) <= F.abs(F.col("e") - mean[1])).cast("double"))
        w = v.withColumn("p", part)
        r = w.agg(*(s for k, p in enumerate((F.col("p"), 1 - F.col("p"))) for s in (F.sum(p).alias(f"n{k}"), F.sum(p * F.col("e")).alias(f"s{k}"), F.sum(p * F.pow(F.col("e") - mean[k], 2)).alias(f"q{k}")))).first()
        for k in (0, 1):
            if r[f"n{k}"] > 1e-9:
                old, mean[k] = mean[k], r[f"s{k}"] / r[f"n{k}"]
                var[k] = max(r[f"q{k}"] / r[f"n{k}"] - (mean[k] - old) ** 2, 1e-12)
                share[k] = r[f"n{k}"] / facts["n"]
    good = 0 if var[0] <= var[1] else 1
    if var[good] > 1e6:
        cut = S.picks(v, "e", {"cut": S.floor_place(0.7)})
        return df.crossJoin(F.broadcast(cut)).filter(e < F.col("cut")).drop("cut")
    like = [F.exp(-F.pow(e - mean[k], 2) / (2 * var[k])) / math.sqrt(var[k]) for k in (good, 1 - good)]
    return df.filter((like[0] > like[1]) | (e < mean[good]))


def adjustment_outliers(means: DataFrame, value: str, percent: float, factor: float, least: float, most: float, gcp: str | None = None) -> DataFrame:
    """Points whose mean residual is above a cutoff: the upper bracket, kept between `least` and `most`.

    Ground control points (a boolean column) neither count for the bracket nor are outliers.
    """
    free = means if gcp is None else means.filter(~F.col(gcp))
    cut = S.brackets(free, value, percent / 100, factor).select(F.least(F.greatest("hi", F.lit(float(least))), F.lit(float(most))).alias("cut"))
    return free.crossJoin(F.broadcast(cut)).filter(F.col(value) > F.col("cut")).drop("cut")


def convergence_outliers(rays: DataFrame, least: float, most: float = 0.0, gcp: str | None = None) -> DataFrame:
    """rays(pid, cid, dx, dy, dz) -> pid, angle of points whose largest angle between two rays is below least or above most.

    Pairs are made within a point only; the work is the square of a track's length, which the number of cameras bounds.
    """
    free = rays if gcp is None else rays.filter(~F.col(gcp))
    a, b = (free.select("pid", F.col("cid").alias(f"c{s}"), *(F.col(c).alias(c + s) for c in ("dx", "dy", "dz"))) for s in "ab")
    angle = angle_between([F.col(c + "a") for c in ("dx", "dy", "dz")], [F.col(c + "b") for c in ("dx", "dy", "dz")])
    found = a.join(b, "pid").filter("ca < cb").groupBy("pid").agg(F.max(angle).alias("angle"))
    found = free.select("pid").distinct().join(found, "pid", "left").fillna({"angle": 0.0})
    bad = F.col("angle") < least
    return found.filter(bad | (F.col("angle") > most) if most > 0 else bad)


def photometric_outliers(pair: DataFrame, share: float = 0.99985) -> DataFrame:
    """pair(col, row, a, b) -> the cells whose absolute difference is above its quantile (element floor(p * n))."""
    d = pair.filter("a IS NOT NULL AND b IS NOT NULL").select("col", "row", F.abs(F.col("a") - F.col("b")).alias("v"))
    cut = S.picks(d, "v", {"cut": S.floor_place(share)})
    return d.crossJoin(F.broadcast(cut)).filter(F.col("v") > F.col("cut")).drop("cut")


def search_range(df: DataFrame, value: str, most_width: float, percent: float = 0.0, step: float = 5.0) -> DataFrame:
    """lo, hi: the value's range with a share cut off at both ends, raised by steps until it is at most most_width wide.

    All cuts are read from one histogram of values, so no pass is repeated; the last cut is the middle.
    """
    cuts = [percent / 100 + i * step / 100 for i in range(int((50 - percent) / step) + 1)]
    places = {f"a{i}": S.floor_place(c) for i, c in enumerate(cuts)} | {f"b{i}": S.floor_place(1 - c) if c else F.col("n") - 1 for i, c in enumerate(cuts)}
    p = S.picks(df, value, places)
    tries = F.array(*(F.struct(F.least(f"a{i}", f"b{i}").alias("lo"), F.greatest(f"a{i}", f"b{i}").alias("hi")) for i in range(len(cuts))))
    fit = F.filter(tries, lambda t: t["hi"] - t["lo"] <= most_width)
    return p.select(F.when(F.size(fit) > 0, fit[0]).otherwise(tries[len(cuts) - 1]).alias("t")).select("t.*")


def neighbour_gap(df: DataFrame, value: str) -> DataFrame:
    """gap: the median distance between neighbouring distinct values, to tell what counts as close."""
    from pyspark.sql import Window

    cuts = df.agg(F.percentile_approx(value, [i / 64 for i in range(1, 64)], 1000).alias("_cuts"))
    v = df.filter(F.col(value).isNotNull()).select(value).distinct().crossJoin(F.broadcast(cuts))
    v = v.select(value, F.size(F.filter("_cuts", lambda s: s < F.col(value))).alias("_b"))
    inner = v.select((F.lead(value).over(Window.partitionBy("_b").orderBy(value)) - F.col(value)).alias("gap"))
    ends = v.groupBy("_b").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))  # at most 64 rows
    outer = ends.select((F.lead("lo").over(Window.orderBy("_b")) - F.col("hi")).alias("gap"))
    return S.medians(inner.unionByName(outer), "gap", name="gap")
