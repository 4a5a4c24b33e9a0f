"""Match networks: observations obs(pid, cid, fid, x, y) of points by cameras, and the sets of images and tracks over them."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.operators.chips import first_come


#: Pairs of cameras that a part of the tracks brings on average, and parts at most.
PART_PAIRS, MOST_PARTS = 2_000_000, 20_000


def track_pairs(obs: DataFrame, pid: str = "pid", cid: str = "cid") -> DataFrame:
    """c1 < c2 and the number of tracks that both cameras see. The work is the square of a track's length, at most that of the number of cameras.

    Tracks are counted beforehand, and go in as many parts as bring PART_PAIRS pairs to each, so a task's tables of pairs
    don't grow with the input. Pairs are counted in their part first, so a frequent pair comes once from each.
    """
    seen = obs.select(F.col(pid).alias("_p"), F.col(cid).alias("_c")).dropna()
    n = F.col("n").cast("double")
    pairs = seen.groupBy("_p").agg(F.count("*").alias("n")).agg(F.sum(n * n / 2)).first()[0] or 0.0
    parts = max(int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, int(pairs / PART_PAIRS) + 1))
    dealt = seen.withColumn("_part", F.pmod(F.xxhash64("_p"), F.lit(8 * parts))).repartition(parts, "_part")
    track = dealt.groupBy("_part", "_p").agg(F.sort_array(F.collect_set("_c")).alias("_c"))
    first = track.select("_part", "_c", F.posexplode("_c").alias("_i", "c1"))
    both = first.select("_part", "c1", F.explode(F.slice("_c", F.col("_i") + 2, F.size("_c"))).alias("c2"))
    counted = both.groupBy("_part", "c1", "c2").agg(F.count("*").alias("_n"))
    return counted.select("c1", "c2", "_n").repartition(parts, "c1", "c2").groupBy("c1", "c2").agg(F.sum("_n").alias("matches"))


def keep_inliers(matches: DataFrame, inliers: DataFrame, keys: tuple[str, ...] = ("lx", "ly", "rx", "ry")) -> DataFrame:
    """Matches that occur among the inliers, by all of the keys."""
    return matches.join(inliers.select(*keys).distinct(), list(keys), "left_semi")


def without_points(rows: DataFrame, outliers: DataFrame, key: str = "pid") -> DataFrame:
    return rows.join(outliers.select(key).distinct(), key, "left_anti")


def pair_closure(pairs: DataFrame) -> DataFrame:
    """Distinct pairs i < j of pairs(a, b) in either order; pairs of equals are left out."""
    return pairs.filter("a <> b").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()


def track_lengths(obs: DataFrame) -> DataFrame:
    """length, tracks: how many tracks have so many observations."""
    return obs.groupBy("pid").agg(F.count("*").alias("length")).groupBy("length").agg(F.count("*").alias("tracks"))


def images_in_tracks(obs: DataFrame) -> DataFrame:
    return obs.select("cid").distinct()


def common_tracks(obs: DataFrame, images: list) -> DataFrame:
    """Tracks that all of the images see."""
    seen = obs.filter(F.col("cid").isin(images)).groupBy("pid").agg(F.count_distinct("cid").alias("n"))
    return seen.filter(F.col("n") == len(set(images))).select("pid")


def split_one_to_one(obs: DataFrame) -> DataFrame:
    """Observations without those of a track that hits one image more than once: of these the smallest fid stays."""
    return obs.groupBy("pid", "cid").agg(F.min("fid").alias("fid"))


def distinct_tracks(obs: DataFrame) -> DataFrame:
    """obs(pid, cid, fid) without tracks that have exactly the observations of one with a smaller pid.

    Tracks are compared by number and two hashes of their observations, added up, so no track is gathered in one place.
    """
    sign = obs.groupBy("pid").agg(F.count("*").alias("n"), F.sum(F.xxhash64("cid", "fid").cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64("fid", "cid", F.lit(7)).cast("decimal(38,0)")).alias("h2"))
    first = sign.groupBy("n", "h1", "h2").agg(F.min("pid").alias("pid"))
    return obs.join(first.select("pid"), "pid", "left_semi")


def unseen_matches(have: DataFrame, more: DataFrame) -> DataFrame:
    """have(lx, ly, rx, ry) and those of more that repeat neither a left nor a right point of it or of an earlier row of more that was taken.

    Earlier is the smaller (lx, ly, rx, ry): the result of a pass in that order. Equal rows of more count once.
    """
    left, right = ["lx", "ly"], ["rx", "ry"]
    new = more.select(*left, *right).distinct().join(have.select(*left).distinct(), left, "left_anti").join(have.select(*right).distinct(), right, "left_anti")
    return have.select(*left, *right).unionByName(first_come(new.select(*left, *right), left, right, [*left, *right]))


def map_correspondences(obs_a: DataFrame, obs_b: DataFrame, shared: DataFrame) -> DataFrame:
    """Tracks of map a and map b that stand for each other, one to one.

    obs_a, obs_b(pid, cid, fid); shared(pid, cid_a, fid_a, cid_b, fid_b) are merged tracks' observations in both. Votes
    count the shared ones of each pair; every track of a takes its best of b, every track of b the best of those that
    took it; the smallest pid wins ties.
    """
    a = obs_a.select(F.col("pid").alias("pid_a"), F.col("cid").alias("cid_a"), F.col("fid").alias("fid_a"))
    b = obs_b.select(F.col("pid").alias("pid_b"), F.col("cid").alias("cid_b"), F.col("fid").alias("fid_b"))
    votes = shared.join(a, ["cid_a", "fid_a"]).join(b, ["cid_b", "fid_b"]).groupBy("pid_a", "pid_b").agg(F.count("*").alias("votes"))
    best = votes.groupBy("pid_a").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("pid_b").alias("p"))).alias("m")).select("pid_a", F.col("m.p").alias("pid_b"), (-F.col("m.v")).alias("votes"))
    back = best.groupBy("pid_b").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("pid_a").alias("p"))).alias("m"))
    return back.select(F.col("m.p").alias("pid_a"), "pid_b", (-F.col("m.v")).alias("votes"))


def submap(obs: DataFrame, images: DataFrame, least: int = 2) -> DataFrame:
    """obs of the listed images(cid, place), cid replaced by place, without tracks of fewer than `least` observations.

    Tracks are numbered anew from 0 in the order of pid, by ranks in ranges of pid.
    """
    from terraloom.functions.statistics import value_ranks

    kept = obs.join(images.select("cid", F.col("place").alias("new_cid")), "cid").drop("cid")
    long = kept.groupBy("pid").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("pid")
    ids = value_ranks(long, "pid").select("pid", (F.col("upto") - 1).alias("new_pid"))
    return kept.join(ids, "pid").select(F.col("new_pid").alias("pid"), F.col("new_cid").alias("cid"), "fid")


def merged_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """place, name: the images of both maps (place, name), those of a first; a name in both keeps its place in a."""
    n = a.agg((F.coalesce(F.max("place"), F.lit(-1)) + 1).alias("n"))
    new = b.join(a.select("name"), "name", "left_anti")
    new = new.withColumn("k", F.row_number().over(Window.orderBy("place")) - 1)  # a line an image
    return a.select("place", "name").unionByName(new.crossJoin(F.broadcast(n)).select((F.col("n") + F.col("k")).alias("place"), "name"))


def merged_poses(poses: DataFrame) -> DataFrame:
    """poses(name, x, y, z, qw, qx, qy, qz) of several maps: one for each image, positions averaged, rotations averaged with equal signs and normalised."""
    first = poses.groupBy("name").agg(F.min(F.struct(F.col("map"), "qw", "qx", "qy", "qz")).alias("f"))
    q = ["qw", "qx", "qy", "qz"]
    dot = sum((F.col(c) * F.col("f")[c] for c in q[1:]), F.col("qw") * F.col("f")["qw"])
    same = F.when(dot < 0, -1.0).otherwise(1.0)
    mean = poses.join(first, "name").groupBy("name").agg(*(F.avg(c).alias(c) for c in "xyz"), *(F.avg(F.col(c) * same).alias(c) for c in q))
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in q[1:]), F.col("qw") * F.col("qw")))
    return mean.select("name", "x", "y", "z", *((F.col(c) / size).alias(c) for c in q))


def check_names(paths: DataFrame, column: str) -> DataFrame:
    """paths as they are; two files of one base name, without folder and ending, raise when they are read."""
    base = F.regexp_extract(column, r"([^/]+?)(\.[^./]*)?$", 1)
    named = paths.withColumn("_base", base)
    twice = named.groupBy("_base").agg(F.count("*").alias("_n"))
    bad = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two files are named "), F.col("_base")))).otherwise(F.col(column))
    return named.join(twice, "_base").withColumn(column, bad).select(*paths.columns)


def sweep(df: DataFrame, **values: list) -> DataFrame:
    """Every row of df under all combinations of the given lists, a column for each; an empty list leaves no row.

    Rows are multiplied where they are read, without an exchange; aggregate by the parameters, so that sums are made in
    the tasks. A parameter named like a column of df raises ValueError.
    """
    if set(values) & set(df.columns):
        raise ValueError("a parameter is named like a column of the table")
    for name, choices in values.items():
        df = df.filter(F.lit(False)).withColumn(name, F.lit(None)) if not choices else df.withColumn(name, F.explode(F.array(*(F.lit(c) for c in choices))))
    return df


#: Rows of the greedy choice that one task goes through, and those that a part of several regions has on average; rows are
#: written anew once the last share of them is covered.
POOL, PART, REWRITTEN = 4_000_000, 500_000, 0.25


def _chosen_in(lists: pa.Array, least: int, floor: tuple[int, int] | None) -> tuple[list[int], list[int]]:
    """Images and gains of a greedy choice, in its order, from a list of images for each cell, until the next comes after floor (-gain, image)."""
    at, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy()
    at = at - at[0]
    sizes = np.diff(at)
    names, image = np.unique(flat, return_inverse=True)
    gains = np.bincount(image, minlength=len(names))
    cells = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(image, kind="stable")]  # those of each image
    begins = np.concatenate([[0], np.cumsum(gains)])
    open_, found = np.ones(len(sizes), bool), ([], [])
    heap = [(-g, k) for k, g in enumerate(gains.tolist()) if g >= least]
    heapq.heapify(heap)
    while heap:
        gain, k = -heap[0][0], heap[0][1]
        now = int(gains[k])
        if now < least:
            heapq.heappop(heap)
        elif now < gain:  # each such step lowers a gain, so there are no more of them than rows
            heapq.heapreplace(heap, (-now, k))
        elif floor is not None and (-gain, int(names[k])) > floor:
            break
        else:
            heapq.heappop(heap)
            found[0].append(int(names[k]))
            found[1].append(gain)
            new = cells[begins[k] : begins[k + 1]]
            new = new[open_[new]]
            open_[new] = False
            n = sizes[new]
            met = np.repeat(at[new] - np.cumsum(n) + n, n) + np.arange(n.sum())
            np.subtract.at(gains, image[met], 1)
    return found


def _chosen(rows: DataFrame, least: int, floor: tuple[int, int] | None = None) -> DataFrame:
    """i, gain: the choice among rows(part, i, cell), each part in one task."""

    def choose(part: pa.Table) -> pa.Table:
        i, gain = _chosen_in(part.column("images").combine_chunks(), least, floor)
        return pa.table({"i": pa.array(i, pa.int64()), "gain": pa.array(gain, pa.int64())})

    return rows.groupBy("part", "cell").agg(F.collect_list("i").alias("images")).select("part", "images").groupBy("part").applyInArrow(choose, "i long, gain long")


def _regions(left: DataFrame, gains: DataFrame) -> DataFrame | None:
    """gains(i, gain) with part, for the images of regions of POOL rows at most: regions share no cell, a part has whole ones. None if there are hardly any.

    An image goes by the smallest that it meets in a cell; where these already have more than POOL rows for most rows,
    there is no search. Else regions are the components of the few that stand for others.
    """
    from terraloom.operators.storage import stored
    from terraloom.operators.tracks import tracks

    met = stored(left.withColumn("m", F.min("i").over(Window.partitionBy("cell"))).select("i", "m").distinct(), "subset-met")
    first = stored(met.groupBy("i").agg(F.min("m").alias("first")).join(gains, "i"), "subset-first")
    large = lambda df, key: df.groupBy(key).agg(F.sum("gain").alias("rows"))
    facts = large(first, "first").agg(F.sum("rows").alias("rows"), F.sum(F.when(F.col("rows") > POOL, F.col("rows"))).alias("large")).first()
    if (facts["large"] or 0) * 2 > (facts["rows"] or 0):
        return None
    links = met.join(first.select("i", F.col("first").alias("a")), "i").join(first.select(F.col("i").alias("m"), F.col("first").alias("b")), "m")
    found = tracks(links.select("a", "b").distinct()).withColumnRenamed("node", "first")
    whole = stored(first.join(found, "first", "left").withColumn("region", F.coalesce("track", "first")).select("i", "gain", "region"), "subset-regions")
    small = large(whole, "region").filter(F.col("rows") <= POOL)
    rows = small.agg(F.sum("rows")).first()[0]
    if not rows:
        return None
    return whole.join(small.select("region"), "region").select("i", "gain", F.pmod(F.xxhash64("region"), F.lit(int(rows // PART) + 1)).alias("part"))


def greedy_subset(seen: DataFrame, threshold: int) -> DataFrame:
    """image, gain: images(image, cell) chosen one at a time by the number of cells that no chosen one has, in the order of choice.

    Stops when the best gain is below the threshold; the smallest image wins ties. A task chooses among POOL rows at most,
    one image after the other. With more rows, regions that share no cell are chosen from apart, in one go. What is left is
    gone through in rounds: a task takes the images of the largest gains, and chooses until the next would come after the
    last of them, as gains only fall: until then no other image can come first. Rows are written anew only when a quarter
    of them is gone; until then a round writes its choice, its cells and the gains. Rows with a null image or cell take no
    part.
    """
    from terraloom.operators.storage import shared_path, stored

    spark, least = seen.sparkSession, max(threshold, 1)
    seen = seen.select("image", "cell").dropna()
    ids = stored(seen.select("image").distinct().orderBy("image").withColumn("i", F.monotonically_increasing_id()), "subset-images")
    live = left = stored(seen.join(ids, "image").select("i", "cell").repartition("cell").distinct(), "subset")
    choice, covered, held, searched = shared_path(spark, "subset-choice"), None, None, False
    spark.createDataFrame([], "i long, gain long").write.parquet(choice)
    while True:
        gains = stored(live.groupBy("i").agg(F.count("*").alias("gain")).filter(F.col("gain") >= least), "subset-gains")
        levels = sorted(((r["gain"], r["n"]) for r in gains.groupBy("gain").agg(F.count("*").alias("n")).collect()), reverse=True)
        rows = sum(g * n for g, n in levels)
        if rows <= POOL:
            if rows:
                _chosen(live.join(gains.select("i", F.lit(0).alias("part")), "i"), least).write.mode("append").parquet(choice)
            break
        live = live.join(gains.select("i"), "i", "left_semi")
        if not searched:
            parts, searched = _regions(live, gains), True
            if parts is not None:
                parts = stored(parts, "subset-parts")
                _chosen(live.join(parts.select("i", "part"), "i"), least).write.mode("append").parquet(choice)
                live = left = stored(live.join(parts.select("i"), "i", "left_anti").repartition("cell"), "subset")
                held = None
                continue
        if held is None:
            held = rows
        elif rows <= (1 - REWRITTEN) * held:
            live = left = stored(live.repartition("cell"), "subset")
            held, covered = rows, None
        floor = _floor(gains, levels)
        pool = gains.filter((F.col("gain") > -floor[0]) | ((F.col("gain") == -floor[0]) & (F.col("i") <= floor[1])))
        if levels[0][0] > POOL:  # the pool is one image
            best = stored(pool, "subset-best")
        else:
            best = stored(_chosen(live.join(pool.select("i", F.lit(0).alias("part")), "i"), least, floor), "subset-best")
        best.write.mode("append").parquet(choice)
        if covered is None:
            covered = shared_path(spark, "subset-covered")
        live.join(best.select("i"), "i", "left_semi").select("cell").distinct().write.mode("append").parquet(covered)
        live = left.join(spark.read.schema(left.select("cell").schema).parquet(covered), "cell", "left_anti")
    return spark.read.schema("i long, gain long").parquet(choice).join(ids, "i").select("image", "gain").orderBy(F.desc("gain"), "image")


def _floor(gains: DataFrame, levels: list[tuple[int, int]]) -> tuple[int, int]:
    """(-gain, image) of the last image that fits into POOL rows, the first one in any case; levels(gain, images), largest first."""
    room = POOL
    for gain, n in levels:
        if gain * n > room:
            fit = room // gain or int(room == POOL)
            return (-gain, gains.filter(F.col("gain") == gain).select("i").orderBy("i").limit(fit).agg(F.max("i")).first()[0] if fit else -1)
        room -= gain * n
    return (0, -1)


def complete_network(observations: DataFrame, disparities: DataFrame, aligned: DataFrame, images: int) -> DataFrame:
    """observations(pid, cid, x, y) with those that disparities give in the other image of each: cid + images.

    aligned(cid, l, r) holds for every image the transforms of its pixels and of the other image's to the aligned pair,
    each an array (a, b, c, d, e, f): x' = a x + b y + c, y' = d x + e y + f. An observation is taken to the aligned left
    image, moved by the disparity(cid, col, row, dx, dy) between its four nodes, and taken back by the inverse of r. What
    falls beside a valid disparity (null dx or dy: a hole) gets no second observation; nodes without weight don't count.
    An image without transforms, or a transform without an inverse, raises when it is read. Nodes are joined by image and
    place, a place once with its four nodes, so an image of many points is spread by its places. Null x or y: no second observation. Repeated observations
    stay repeated.
    """
    line = lambda m, i, x, y: m[i] * x + m[i + 1] * y + m[i + 2]
    o = observations.select("pid", "cid", "x", "y").join(aligned.select("cid", "l", "r"), "cid", "left")
    o = o.withColumn("l", F.when(F.col("l").isNull() | F.col("r").isNull(), F.raise_error(F.concat(F.lit("no transforms for image "), F.col("cid").cast("string")))).otherwise(F.col("l")))
    o = o.withColumns({"px": line(F.col("l"), 0, F.col("x"), F.col("y")), "py": line(F.col("l"), 3, F.col("x"), F.col("y"))})
    o = o.withColumns({"col": F.floor("px"), "row": F.floor("py")})
    # the four nodes about each place are brought together first, so that an observation is met once
    valid = disparities.select("cid", "col", "row", "dx", "dy").filter(F.col("dx").isNotNull() & F.col("dy").isNotNull())
    sent = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    about = valid.withColumn("_n", sent).select("cid", (F.col("col") - F.col("_n.i")).alias("col"), (F.col("row") - F.col("_n.j")).alias("row"), (F.col("_n.i") * 2 + F.col("_n.j")).alias("_at"), "dx", "dy")
    at = lambda c, k: F.max(F.when(F.col("_at") == k, F.col(c))).alias(f"{c}{k}")
    about = about.groupBy("cid", "col", "row").agg(*(at(c, k) for c in ("dx", "dy") for k in range(4)))
    fx, fy = F.col("px") - F.col("col"), F.col("py") - F.col("row")
    weight = {2 * i + j: (fx if i else 1 - fx) * (fy if j else 1 - fy) for i in (0, 1) for j in (0, 1)}
    total = lambda c: sum((F.when(w > 0, w * F.col(f"{c}{k}")).otherwise(0.0) for k, w in weight.items()), F.lit(0.0))
    found = o.select("pid", "cid", "px", "py", "r", "col", "row").join(about, ["cid", "col", "row"]).withColumns({"_sx": total("dx"), "_sy": total("dy")})
    found = found.filter(F.col("_sx").isNotNull() & F.col("_sy").isNotNull())  # a node with weight that is missing makes them null
    m = F.col("r")
    u, v, det = F.col("px") + F.col("_sx") - m[2], F.col("py") + F.col("_sy") - m[5], m[0] * m[4] - m[1] * m[3]
    det = F.when(det != 0, det).otherwise(F.raise_error(F.lit("a transform has no inverse")).cast("double"))
    other = found.select("pid", (F.col("cid") + images).alias("cid"), ((m[4] * u - m[1] * v) / det).alias("x"), ((m[0] * v - m[3] * u) / det).alias("y"))
    return observations.select("pid", "cid", "x", "y").unionByName(other)
