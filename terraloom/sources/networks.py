"""Text forms of match networks, control points, polygons, meshes and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.sources.text import _SEPARATOR

# The first line of a network file and the titles of a control point file.
NETWORK_TITLE = "NVM_V3"
CONTROL_TITLE = "# id lat lon height_above_datum sigma_x sigma_y sigma_z image_name pixel_x pixel_y sigma_x sigma_y, etc."


def _number(words: Column, i: Column | int, kind: str = "double") -> Column:
    return F.get(words, F.lit(i) if isinstance(i, int) else i).try_cast(kind)


def parse_network(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lines(value, line), line counted from 0 -> cameras, points and observations of a network.

    cameras(cid, name, focal, qw, qx, qy, qz, x, y, z); points(pid, x, y, z); observations(pid, cid, fid, px, py). A first
    line other than the title, or fewer measures than a point's line announces, raises. Only the two counts are read on
    the driver.
    """
    body = lines.select("line", F.trim("value").alias("value")).withColumn("w", F.split("value", r"\s+"))
    head = {r["line"]: r["value"] for r in body.filter("line < 2").select("line", "value").collect()}
    if not head.get(0, "").startswith(NETWORK_TITLE):
        raise ValueError("not a network file")
    n = int(head[1])
    cameras = body.filter(F.col("line").between(2, n + 1)).select(
        (F.col("line") - 2).alias("cid"), F.get("w", F.lit(0)).alias("name"),
        *(_number(F.col("w"), i + 1).alias(c) for i, c in enumerate(("focal", "qw", "qx", "qy", "qz", "x", "y", "z"))),
    )
    rows = body.filter(F.col("line") > n + 2).filter("value <> ''").withColumn("pid", F.col("line") - (n + 3))
    points = rows.select("pid", *(_number(F.col("w"), i).alias(c) for i, c in enumerate("xyz")))
    count = _number(F.col("w"), 6, "int")
    whole = F.when(F.size("w") >= 7 + 4 * count, count).otherwise(F.raise_error(F.concat(F.lit("too few measures: "), F.col("value"))).cast("int"))
    each = rows.select("pid", "w", F.explode(F.sequence(F.lit(0), whole - 1)).alias("k"))
    at = lambda j, kind: _number(F.col("w"), 7 + 4 * F.col("k") + j, kind)
    return cameras, points, each.select("pid", at(0, "long").alias("cid"), at(1, "long").alias("fid"), at(2, "double").alias("px"), at(3, "double").alias("py"))


def network_lines(cameras: DataFrame, points: DataFrame, obs: DataFrame) -> DataFrame:
    """line, value: the text of a network; its inverse is parse_network.

    cid and pid must be numbered from 0 without gaps. A point's measures are in the order of cid, then fid; a point with
    fewer than two raises. A track is gathered in one row, which the number of cameras bounds.
    """
    n = cameras.agg(F.count("*").alias("n"))
    top = n.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("line"), F.lit(NETWORK_TITLE).alias("value")), F.struct(F.lit(1).cast("long").alias("line"), F.col("n").cast("string").alias("value")))).alias("s")).select("s.*")
    cams = cameras.select((F.col("cid") + 2).cast("long").alias("line"), F.concat_ws(" ", "name", *(F.col(c).cast("string") for c in ("focal", "qw", "qx", "qy", "qz", "x", "y", "z")), F.lit("0 0")).alias("value"))
    total = points.agg(F.count("*").cast("string").alias("value")).crossJoin(n).select((F.col("n") + 2).cast("long").alias("line"), "value")
    one = F.concat_ws(" ", F.col("cid").cast("string"), F.col("fid").cast("string"), F.col("px").cast("string"), F.col("py").cast("string"))
    tracks = obs.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("cid", "fid", one.alias("t")))).alias("m"))
    joined = points.join(tracks, "pid", "left").crossJoin(F.broadcast(n))
    size = F.coalesce(F.size("m"), F.lit(0))
    text = F.concat_ws(" ", *(F.col(c).cast("string") for c in "xyz"), F.lit("0 0 0"), size.cast("string"), F.concat_ws(" ", F.transform("m", lambda m: m["t"])))
    text = F.when(size > 1, text).otherwise(F.raise_error(F.concat(F.lit("fewer than two measures: point "), F.col("pid").cast("string"))))
    body = joined.select((F.col("pid") + F.col("n") + 3).cast("long").alias("line"), text.alias("value"))
    return top.unionByName(cams).unionByName(total).unionByName(body)


def control_lines(points: DataFrame, measures: DataFrame, ignore_sigma: bool = False) -> DataFrame:
    """id, value: control points(id, lat, lon, height, sx, sy, sz) with their measures(id, k, image, px, py, sx, sy) in the order of k.

    A pixel sigma that isn't positive is 1, and all are with ignore_sigma.
    """
    sigma = lambda c: F.lit("1.0") if ignore_sigma else F.when(F.col(c) > 0, F.col(c)).otherwise(1.0).cast("string")
    one = F.concat_ws(" ", "image", F.col("px").cast("string"), F.col("py").cast("string"), sigma("sx"), sigma("sy"))
    held = measures.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", one.alias("t")))).alias("m"))
    text = F.concat_ws(" ", F.col("id").cast("string"), *(F.col(c).cast("string") for c in ("lat", "lon", "height", "sx", "sy", "sz")), F.concat_ws(" ", F.transform("m", lambda m: m["t"])))
    return points.join(held, "id").select("id", text.alias("value"))


def parse_polygons(lines: DataFrame, names: tuple[str, str] = ("x", "y")) -> DataFrame:
    """lines(file, line, value) -> file, block (from 1), line, x, y, label: the vertices of a polygon file.

    Lines that are no two numbers separate polygons: empty ones, titles, colours. `anno` lines don't; their text beside
    two coordinates labels no vertex and is left out. Files are split over tasks; a file's lines are ordered in one.
    """
    f = F.split(F.trim("value"), _SEPARATOR)
    fits = F.get(f, F.lit(0)).try_cast("double").isNotNull() & F.get(f, F.lit(1)).try_cast("double").isNotNull()
    rows = lines.filter(~F.col("value").startswith("anno ")).select("file", "line", F.when(fits, 0).otherwise(1).alias("_break"), F.get(f, F.lit(0)).try_cast("double").alias(names[0]), F.get(f, F.lit(1)).try_cast("double").alias(names[1]))
    w = Window.partitionBy("file").orderBy("line")
    # a block starts at a vertex after a separator, so separators in a row make no empty blocks
    start = F.when((F.col("_break") == 0) & (F.coalesce(F.lag("_break").over(w), F.lit(1)) == 1), 1).otherwise(0)
    named = rows.withColumn("_start", start).withColumn("block", F.sum("_start").over(w))
    return named.filter("_break = 0").select("file", "block", "line", *names)


def count_points(lines: DataFrame) -> DataFrame:
    """points, columns: the lines that start with a number, and the fields of the first kind met (the most frequent)."""
    f = F.split(F.trim("value"), _SEPARATOR)
    v = lines.filter(~F.trim("value").startswith("#") & F.get(f, F.lit(0)).try_cast("double").isNotNull()).select(F.size(f).alias("columns"))
    sizes = v.groupBy("columns").agg(F.count("*").alias("n"))  # a row for each width
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("points"), F.max(F.struct("n", "columns"))["columns"].alias("columns"))


def match_lines(matches: DataFrame) -> DataFrame:
    """A match (lx, ly, rx, ry) a line, separated by blanks."""
    return matches.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("lx", "ly", "rx", "ry"))).alias("value"))


def parse_matches(lines: DataFrame) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.size(f) >= 4).select(*(F.get(f, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("lx", "ly", "rx", "ry"))))
    return rows.dropna()


def mesh_lines(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """part, k, value: vertices(v, x, y, z), numbered from 0, then triangles(a, b, c) of them; numbers start at 1 in the text."""
    v = vertices.select(F.lit(0).alias("part"), F.col("v").cast("long").alias("k"), F.concat_ws(" ", F.lit("v"), *(F.col(c).cast("string") for c in "xyz")).alias("value"))
    t = triangles.select(F.lit(1).alias("part"), F.col("a").cast("long").alias("k"), F.concat_ws(" ", F.lit("f"), *((F.col(c) + 1).cast("string") for c in "abc")).alias("value"))
    return v.unionByName(t)


def parse_list(lines: DataFrame) -> DataFrame:
    """name: the first word of each line that isn't empty."""
    return lines.filter(F.trim("value") != "").select(F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).alias("name"))


def images_and_cameras(names: DataFrame) -> DataFrame:
    """names(name) told apart by their endings: kind is image, camera, list or other."""
    end = F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1))
    kind = F.when(end.isin("tif", "tiff", "ntf", "cub", "img", "png", "jpg", "jpeg"), "image").when(end.isin("xml", "tsai", "json", "isd", "rpb"), "camera").when(end.isin("txt", "lis"), "list")
    return names.select("name", F.coalesce(kind, F.lit("other")).alias("kind"))


def kml_placemarks(points: DataFrame) -> DataFrame:
    """A placemark (id, lon, lat, height) a line."""
    place = F.concat_ws(",", *(F.col(c).cast("string") for c in ("lon", "lat", "height")))
    return points.select(F.concat(F.lit("<Placemark><name>"), F.col("id").cast("string"), F.lit("</name><Point><coordinates>"), place, F.lit("</coordinates></Point></Placemark>")).alias("value"))
