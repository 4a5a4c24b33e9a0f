import pytest
from pyspark.sql import functions as F

from terraloom.functions import geometry as G
from terraloom.sources import text


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


# Sample lines of the point formats and what they hold.
@pytest.mark.parametrize(
    ("fmt", "line", "wanted"),
    [
        ("2:file 5:lon 6:lat 7:height_above_datum", "1, name.jpg, 3, 4, 5, 6, 7, 8, 9", (5, 6, 7, "name.jpg")),
        ("1:file 8:y 4:x 2:z", "name.tif, 2, 3, 4, 5, 6, 7, 8, 9", (4, 8, 2, "name.tif")),
        ("1:height_above_datum 3:lon 2:lat", "310.061156\t69.37378,\t658.478", (658.478, 69.37378, 310.061156)),
        ("1:x 2:y", "1 2", (1, 2, 0)),
    ],
)
def test_point_lines(spark, fmt, line, wanted):
    assert tuple(text.parse_points(lines(spark, line), fmt).first()) == wanted


def test_lines_without_points(spark):
    got = text.parse_points(lines(spark, "# 1 2 3", "", None, "x y z", "1 2", "1 nan 3", "1 2 inf", "1 2 3"), "1:x 2:y 3:z")
    assert [tuple(r) for r in got.collect()] == [(1, 2, 3)]


@pytest.mark.parametrize("fmt", ["", "1:x", "1:x 1:lon", "0:x 2:y", "1:x 2:x 3:y", "x:1 y:2"])
def test_bad_formats(fmt):
    with pytest.raises(ValueError):
        text.point_format(fmt)


def test_radius_formats(spark):
    for fmt, line in (("4:lat 2:lon 3:radius_km", "t, 3.77738, 1735.5, 27.4985"), ("3:lat 2:radius_m 4:lon", "t, 1735500, 27.4985, 3.77738")):
        system = text.point_format(fmt).system
        row = text.geodetic(text.parse_points(lines(spark, line), fmt), system, 1737400.0).first()
        assert (row["lon"], row["lat"]) == (3.77738, 27.4985) and abs(row["height_above_datum"] + 1900) < 1e-6


def test_points_round_trip(spark, tmp_path):
    points = spark.createDataFrame([(1.5, 2.25, -3.0), (4.0, None, 1.0)], "x double, y double, z double")
    text.write_points(points, str(tmp_path / "out"), ["x", "y", "z"])
    assert [tuple(r) for r in text.read_points(spark, str(tmp_path / "out"), "1:x 2:y 3:z").collect()] == [(1.5, 2.25, -3.0)]


def test_ascii_cloud(spark):
    got = text.parse_ascii_cloud(lines(spark, "# .PCD v.7", "FIELDS x y z", "POINTS 99", "DATA ascii", "17.8 -181.4 584.97", "nan nan nan"))
    assert [tuple(r) for r in got.collect()] == [(17.8, -181.4, 584.97)]


def test_reports(spark):
    header = "# image, mean"
    good = text.parse_report(lines(spark, header, "a.tif, 2.5", ""), header, ["image"], ["mean"])
    assert [tuple(r) for r in good.collect()] == [("a.tif", 2.5)]
    with pytest.raises(ValueError):
        text.parse_report(lines(spark), header, ["camera"], [])
    with pytest.raises(Exception, match="ragged"):
        text.parse_report(lines(spark, "a, 1, 2"), header, ["image"], ["mean"]).collect()


def test_settings_and_numbers(spark):
    row = lines(spark, "A=1 B=a=b C=long value").select(text.parse_settings(F.col("value")).alias("m"), text.parse_numbers(F.lit("1, 2 x")).alias("n")).first()
    assert row["m"] == {"A": "1", "B": "a=b", "C": "long value"} and row["n"] == [1.0, 2.0, None]


@pytest.mark.parametrize("line", ["A=", "word A=1", "=1 A=2", "A=1 B="])
def test_bad_settings(spark, line):
    with pytest.raises(Exception, match="no (value|name)"):
        lines(spark, line).select(text.parse_settings(F.col("value"))).collect()


def test_setting_names_and_blanks(spark):
    row = lines(spark, "a-b.c=1   two  =x  D=4 a-b.c=9").select(text.parse_settings(F.col("value")).alias("m")).first()
    assert row["m"] == {"a-b.c": "9", "D": "4"} and lines(spark, "").select(text.parse_settings(F.col("value")).alias("m")).first()["m"] == {}
    got = text.parse_key_values(lines(spark, "# no", "", " key a  b")).first()
    assert (got["key"], got["values"]) == ("key", ["a", "b"])


def test_pixels_kinds_and_angles(spark):
    row = spark.range(1).select(
        text.as_pixel(F.lit(300.7), "uint8").alias("a"), text.as_pixel(F.lit(-5.0), "uint32").alias("b"), text.rounded_offset(F.lit(10.3), 10, 0.25).alias("c"),
        text.cloud_kind(F.lit("d/a.COPC.laz")).alias("d"), text.cloud_kind(F.lit("a.tif")).alias("e"), G.recentred(F.lit(350.0), 0).alias("f"),
        G.angle_between([F.lit(1.0), F.lit(0.0)], [F.lit(0.0), F.lit(2.0)]).alias("g"), G.angle_between([F.lit(0.0)], [F.lit(1.0)]).alias("h"),
    ).first()
    assert tuple(row) == (255, 0, 0.25, "las", "raster", -10, 90, None)
