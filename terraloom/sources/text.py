"""Text sources and sinks: point records by a format string, ASCII clouds, reports, settings, number tables.

Each parser works on a DataFrame with a string column `value`, as spark.read.text gives it, so files of any number are
split over tasks; each has a reader of paths beside it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The field names of point formats, by coordinate system.
SYSTEMS = {
    "xyz": ("x", "y", "z"),
    "geodetic": ("lon", "lat", "height_above_datum"),
    "radius_m": ("lon", "lat", "radius_m"),
    "radius_km": ("lon", "lat", "radius_km"),
    "projected": ("easting", "northing", "height_above_datum"),
    "pixel": ("pixel_x", "pixel_y", "pixel_val"),
}
_SEPARATOR = r"[,\s]+"


@dataclass(frozen=True)
class PointFormat:
    """Which field, counted from 0, holds which coordinate."""

    system: str
    places: dict[str, int]
    file: int | None = None
    zone: str | None = None


def point_format(text: str) -> PointFormat:
    """Reads `2:lon 3:lat 4:height_above_datum`: fields from 1, in any order, at most one `file` and a `utm:` zone.

    Two coordinates of a system are enough where no third is named; it is 0 then.
    """
    places: dict[str, int] = {}
    file = zone = None
    for token in re.split(r"[,\s]+", text.strip()):
        left, _, right = token.partition(":")
        if left == "utm" and right:
            zone = right
            continue
        if not left.isdigit() or int(left) < 1 or not right:
            raise ValueError(f"can't read {token!r} of a point format")
        if right == "file":
            file = int(left) - 1
        elif right in places:
            raise ValueError(f"{right!r} occurs twice")
        else:
            places[right] = int(left) - 1
    fits = [s for s, names in SYSTEMS.items() if places and set(places) <= set(names) and len(places) >= 2]
    whole = [s for s in fits if len(places) == 3]
    if zone and set(places) <= set(SYSTEMS["projected"]):
        whole = ["projected"]
    found = whole or fits
    if not found or len(whole) > 1:
        raise ValueError(f"no coordinate system has the fields {sorted(places)}")
    return PointFormat(found[0], places, file, zone)


def parse_points(lines: DataFrame, fmt: PointFormat | str, others: tuple[str, ...] = ()) -> DataFrame:
    """lines(value, ...) -> others, the coordinates of the format and, if it has one, file.

    Comments (#), empty lines, headers, lines with too few fields and coordinates that are no finite numbers are left
    out. Fields are separated by commas, blanks or tabs, several of them counting as one.
    """
    fmt = point_format(fmt) if isinstance(fmt, str) else fmt
    fields = F.split(F.trim("value"), _SEPARATOR)
    # exploded, so that a line is split once and not again for each use of a field
    kept = lines.filter(F.col("value").isNotNull() & ~F.trim("value").startswith("#")).select(*others, F.explode(F.array(fields)).alias("_f"))

    def field(i: int) -> Column:
        return F.get("_f", F.lit(i))

    names = SYSTEMS[fmt.system]
    values = [field(fmt.places[n]).try_cast("double").alias(n) if n in fmt.places else F.lit(0.0).alias(n) for n in names]
    out = kept.select(*others, *values, *([field(fmt.file).alias("file")] if fmt.file is not None else []))
    for n in names:
        out = out.filter(F.abs(F.col(n)) < float("inf"))  # neither null nor NaN, which is the largest
    return out


def read_points(spark: SparkSession, path: str | list[str], fmt: PointFormat | str) -> DataFrame:
    return parse_points(spark.read.text(path), fmt)


def geodetic(points: DataFrame, system: str, radius: float) -> DataFrame:
    """Points given by radii as lon, lat, height_above_datum over a sphere; other systems unchanged."""
    if system not in ("radius_m", "radius_km"):
        return points
    scale = 1000.0 if system == "radius_km" else 1.0
    return points.withColumn("height_above_datum", F.col(system) * scale - F.lit(float(radius))).drop(system)


def write_points(points: DataFrame, path: str, names: list[str], digits: int = 9) -> None:
    """A point a line, separated by commas, null coordinates left out."""
    whole = points.dropna(subset=names)
    whole.select(F.concat_ws(", ", *(F.format_string(f"%.{digits}f", F.col(n).cast("double")) for n in names)).alias("value")).write.text(path)


def parse_ascii_cloud(lines: DataFrame) -> DataFrame:
    """lines(value) of a self-describing ASCII cloud -> x, y, z. The point count of the header isn't trusted.

    A point line starts with a number; all header lines start with a word or #.
    """
    f = F.split(F.trim("value"), r"\s+")
    out = lines.select(*(F.get(f, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate("xyz")))
    return out.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & ~F.isnan("z"))


def parse_report(lines: DataFrame, header: str, strings: list[str], numbers: list[str]) -> DataFrame:
    """lines(value) of a report -> its columns of these names; header is its title line, with or without #.

    A missing column raises at once, a row of another length or with a bad number when it is read.
    """
    titles = [t.strip() for t in header.lstrip("# ").split(",")]
    missing = [n for n in (*strings, *numbers) if n not in titles]
    if missing:
        raise ValueError(f"the report has no column {missing}")
    body = lines.filter(~F.trim("value").startswith("#") & (F.trim("value") != "") & (F.trim("value") != header.strip()))
    f = F.split("value", r"\s*,\s*")
    row = F.when(F.size(f) == len(titles), f).otherwise(F.raise_error(F.concat(F.lit("ragged row: "), F.col("value"))))
    body = body.select(row.alias("_f"))
    return body.select(*(F.trim(F.get("_f", F.lit(titles.index(n)))).alias(n) for n in strings), *(F.get("_f", F.lit(titles.index(n))).cast("double").alias(n) for n in numbers))


def parse_settings(text: Column) -> Column:
    """`A=1 B=a=b C=long value` as a map, the last of equal names counting.

    Words are separated by white space. One with an equals sign after its first character starts a name, of any
    characters, with the rest of the word as value; a word without one, or starting with one, goes on with the value
    before it, after a blank. A name without value, or a first word that is no name, raises.
    """
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    start = lambda w: F.locate("=", w) > 1

    def step(acc: Column, w: Column) -> Column:
        name = F.substring_index(w, "=", 1)
        value = F.substr(w, F.locate("=", w) + 1)
        fresh = F.when(value == "", F.raise_error(F.concat(F.lit("no value: "), w))).otherwise(value)
        last = F.get(acc, F.size(acc) - 1)
        longer = F.when(F.size(acc) == 0, F.raise_error(F.concat(F.lit("no name: "), w))).otherwise(F.concat(last["v"], F.lit(" "), w))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["k"].alias("k"), longer.alias("v"))))
        return F.when(start(w), F.concat(acc, F.array(F.struct(name.alias("k"), fresh.alias("v"))))).otherwise(grown)

    pairs = F.aggregate(words, F.array().cast("array<struct<k:string,v:string>>"), step)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def parse_key_values(lines: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """lines(value, ...) -> others, key, values: the first word of each line and the others; empty lines and comments (#) are left out."""
    words = F.split(F.trim("value"), r"[ \t]+")
    kept = lines.filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return kept.select(*others, F.get(words, F.lit(0)).alias("key"), F.slice(words, 2, F.size(words)).alias("values"))


def parse_numbers(text: Column) -> Column:
    """All numbers of a line, separated by blanks or commas."""
    return F.transform(F.split(F.trim(text), _SEPARATOR), lambda v: v.try_cast("double"))


def cloud_kind(path: Column) -> Column:
    """What a file holds, by its name's ending."""
    end = F.lower(F.regexp_extract(path, r"\.(copc\.laz|[^./]+)$", 1))
    return F.when(end.isin("las", "laz", "copc.laz"), "las").when(end.isin("csv", "txt"), "csv").when(end == "pcd", "pcd").when(end.isin("tif", "tiff"), "raster").otherwise("unknown")


# The least and largest value of each pixel type.
PIXEL_RANGES = {
    "uint8": (0, 255, "smallint"),
    "int16": (-32768, 32767, "smallint"),
    "uint16": (0, 65535, "int"),
    "int32": (-2147483648, 2147483647, "int"),
    "uint32": (0, 4294967295, "bigint"),
}


def as_pixel(value: Column, kind: str) -> Column:
    """A double clamped to a pixel type's range and cut to whole numbers; float32 and float64 are cast only."""
    if kind in ("float32", "float64"):
        return value.cast("float" if kind == "float32" else "double")
    lo, hi, to = PIXEL_RANGES[kind]
    return F.least(F.greatest(value, F.lit(float(lo))), F.lit(float(hi))).cast(to)


def rounded_offset(value: Column, shift: float, step: float) -> Column:
    """How clouds are stored: less a shift, on multiples of a step (0: unrounded), in single precision."""
    off = value - F.lit(float(shift))
    return (F.round(off / step) * step if step else off).cast("float")
