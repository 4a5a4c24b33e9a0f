"""Weights, normals, corrections, cameras and denser series against values worked out by hand or by plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import cameras
from terraloom.operators import surfaces
from terraloom.plans.surfaces import CAMERA


def grid(spark, rows):
    return spark.createDataFrame([(c, r, v) for r, line in enumerate(rows) for c, v in enumerate(line)], "col long, row long, v double")


def cells(df, value):
    return {(r["col"], r["row"]): r[value] for r in df.collect()}


def test_grassfire(spark):
    whole = grid(spark, [[1.0] * 5 for _ in range(5)])
    assert cells(surfaces.grassfire(whole), "distance") == {(c, r): 1 + min(c, r, 4 - c, 4 - r) for c in range(5) for r in range(5)}
    assert set(cells(surfaces.grassfire(whole, border=False), "distance").values()) == {None}
    holed = whole.withColumn("v", F.when((F.col("col") != 1) | (F.col("row") != 2), F.col("v")))
    assert cells(surfaces.grassfire(holed, border=False), "distance") == {(c, r): abs(c - 1) + abs(r - 2) for c in range(5) for r in range(5) if (c, r) != (1, 2)}
    assert surfaces.grassfire(whole.filter("false")).count() == 0


@pytest.mark.parametrize("border", [True, False])
def test_grassfire_over_stretches(spark, monkeypatch, border):
    monkeypatch.setattr(surfaces, "STRETCH", 3)
    rng = np.random.default_rng(9)
    holes = {k: {(int(c) - 5, int(r)) for c, r in rng.integers(0, 17, (4, 2))} for k in (0, 1)}
    rows = [(k, c, r, None if (c, r) in holes[k] else 1.0) for k in (0, 1) for c in range(-5, 12) for r in range(17)]
    got = surfaces.grassfire(spark.createDataFrame(rows, "k int, col long, row long, v double"), border, ("k",)).collect()
    near = lambda k, c, r: min([abs(c - x) + abs(r - y) for x, y in holes[k]] + ([c + 6, 12 - c, r + 1, 17 - r] if border else []))
    assert {(g["k"], g["col"], g["row"]): g["distance"] for g in got} == {(k, c, r): near(k, c, r) for k, c, r, v in rows if v}


def test_blurred_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(surfaces, "TILE", 5)
    rng = np.random.default_rng(10)
    v = {(k, c, r): float(rng.normal(1, 1)) for k in (0, 1) for c in range(-7, 10) for r in range(12)}
    g = np.exp(-0.5 * (np.arange(-2, 3) / 0.8) ** 2)
    g /= g.sum()
    df = spark.createDataFrame([(*p, x) for p, x in v.items()], "k int, col int, row long, v double")
    got = {(r["k"], r["col"], r["row"]): r["v"] for r in surfaces.blurred(df, 0.8, 2, ("k",)).collect()}
    wanted = {(k, c, r): sum(max(v.get((k, c - i, r - j), 0.0), 0.0) * g[i + 2] * g[j + 2] for i in range(-2, 3) for j in range(-2, 3)) for (k, c, r), x in v.items() if x > 0}
    assert got == pytest.approx(wanted) and surfaces.blurred(df.filter("false"), 1.0).count() == 0


def test_blurred(spark):
    weights = grid(spark, [[0.0, 4.0, None], [2.0, 1.0, -3.0]])
    a, b = math.exp(-0.5), 1.0
    a, b = a / (2 * a + b), b / (2 * a + b)
    got = cells(surfaces.blurred(weights, 1.0, 1), "v")
    assert got == pytest.approx({(1, 0): 4 * b * b + 2 * a * a + b * a, (0, 1): 2 * b * b + 4 * a * a + a * b, (1, 1): b * b + 4 * a * b + 2 * a * b})


def test_normals(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(6, 6))
    points = [(c, r, 2.0 * c, 3.0 * r, None if (c, r) in {(0, 1), (4, 4)} else float(z[r, c])) for c in range(6) for r in range(6)]
    got = {(r["col"], r["row"]): (r["nx"], r["ny"], r["nz"]) for r in surfaces.normals(spark.createDataFrame(points, "col long, row long, x double, y double, z double")).collect()}
    assert len(got) == 34 and got[5, 0] == (None, None, None)  # a corner has four
    for (c, r), n in got.items():
        near = np.array([p[2:] for p in points if abs(p[0] - c) <= 1 and abs(p[1] - r) <= 1 and p[4] is not None])
        if len(near) < 5:
            assert n == (None, None, None)
            continue
        wanted = np.linalg.svd(near - near.mean(0))[2][2]
        assert n == pytest.approx(tuple(wanted * (1 if wanted[2] >= 0 else -1)), abs=1e-9)


def test_column_corrections(spark):
    image = grid(spark, [[1.0, 2.0, 4.0], [3.0, None, 8.0]])
    fix = spark.createDataFrame([(0, 1.0, 2.0, 4.0), (1, 5.0, 1.0, 1.0)], "col long, c0 double, c1 double, c2 double")
    assert cells(surfaces.radiometric(image, fix), "v") == {(0, 0): 1.5, (1, 0): 7.0, (2, 0): 4.0, (0, 1): 2.5, (1, 1): None, (2, 1): 8.0}
    shift = spark.createDataFrame([(0, 0.5, 0.0), (2, 0.0, 0.25)], "col long, dx double, dy double")
    assert cells(surfaces.column_shifts(image, shift), "v") == {(0, 0): 1.0, (1, 0): 2.0, (2, 0): 4.0, (0, 1): 3.0, (1, 1): None, (2, 1): 7.0}


def test_datums(spark):
    rows = spark.createDataFrame([(6378137.05, 6356752.25, 0.0), (6378137.2, 6356752.25, 0.0), (6378137.0, 6356752.25, 180.0), (None, 6356752.25, 0.0)], "semi_major double, semi_minor double, meridian double")
    assert [r["fits"] for r in surfaces.datum_checked(rows, 6378137.0, 6356752.25, 0.0).collect()] == [True, False, False, False]
    with pytest.raises(Exception, match="datums differ"):
        surfaces.datum_checked(rows, 6378137.0, 6356752.25, 0.0, strict=True).collect()


def test_denser_series(spark):
    f = lambda t: 2 - t + 0.5 * t * t - 0.1 * t**3
    times = [0.0, 1.0, 2.5, 4.0, 5.0, 7.0, 8.0]
    s = spark.createDataFrame([("a", t, f(t)) for t in times] + [("b", 0.0, 1.0), ("b", 2.0, 5.0)] + [("c", 3.0, 1.0)], "s string, at double, v double")
    got = {(r["s"], r["k"]): (r["t"], r["v"]) for r in surfaces.lagrange(s, ["s"], "at", ["v"], 4, 5).collect()}
    assert [k for k in sorted(got) if k[0] == "a"] == [("a", k) for k in range(31)]  # a cubic comes back whole
    assert all(t == pytest.approx(8 * k / 30) and v == pytest.approx(f(t)) for (n, k), (t, v) in got.items() if n == "a")
    assert [got["b", k] for k in range(6)] == [(pytest.approx(0.4 * k), pytest.approx(1 + 0.8 * k)) for k in range(6)]
    assert not any(n == "c" for n, _ in got)  # one sample spans no time
    q = spark.createDataFrame([(0.0, 1.0, 0.0, 0.0, 0.0), (1.0, math.cos(0.5), math.sin(0.5), 0.0, 0.0)], "at double, w double, x double, y double, z double")
    turned = sorted((r["k"], r["w"], r["x"]) for r in surfaces.slerped(q, [], "at", ["w", "x", "y", "z"], 4).collect())
    assert turned == [(k, pytest.approx(math.cos(k / 8)), pytest.approx(math.sin(k / 8))) for k in range(5)]
    samples = spark.createDataFrame([(i, 10 * i) for i in range(4)], "i long, v long")
    asked = spark.createDataFrame([(-5.0,), (2.9,), (3.0,), (99.0,)], "at double")
    assert {r["at"]: r["v"] for r in surfaces.nearest_sample(asked, samples, "at", 0.0, 2.0, 4).collect()} == {-5.0: 0, 2.9: 10, 3.0: 20, 99.0: 30}


def test_rational_camera(spark):
    one = [1.0] + [0.0] * 19
    sample, line = [0.0] * 20, [0.0] * 20
    sample[14], line[17] = 1.0, 1.0  # x * x * y and x * x * z
    plain = cameras.RationalCamera((sample, one), (line, one), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (5.0, 7.0), (2.0, 3.0))
    p = spark.createDataFrame([(2.0, 3.0, 5.0), (None, 1.0, 1.0)], "x double, y double, z double")
    got = p.select(*cameras.rational_pixel(F.col("x"), F.col("y"), F.col("z"), plain)).collect()
    assert [tuple(r) for r in got] == [(2 * 12 + 5.0, 3 * 20 + 7.0), (None, None)]
    pixel = cameras.rational_pixel(F.col("x"), F.col("y"), F.col("z"), CAMERA)
    back = [tuple(r["g"]) for r in p.select(cameras.rational_ground(*pixel, F.col("z"), CAMERA).alias("g")).collect()]
    assert back[0] == (pytest.approx(2.0), pytest.approx(3.0)) and back[1] == (None, None)


def test_triangulation_spread(spark):
    rows = [([10.0, 0.0, -50.0], [-10.0, 0.0, 50.0], [-10.0, 0.0, -50.0], [10.0, 0.0, 50.0], 3.0, 4.0), ([10.0, 0.0, -50.0], [1.0, 0.0, 0.0], [-10.0, 0.0, -50.0], [1.0, 0.0, 0.0], 3.0, 4.0), (None, [-10.0, 0.0, 50.0], [-10.0, 0.0, -50.0], [10.0, 0.0, 50.0], 3.0, 4.0)]
    df = spark.createDataFrame(rows, "c1 array<double>, r1 array<double>, c2 array<double>, r2 array<double>, s1 double, s2 double")
    got = [tuple(r["f"]) for r in df.select(cameras.triangulation_spread("c1", "r1", "c2", "r2", "s1", "s2").alias("f")).collect()]
    assert got[0] == (pytest.approx(2.5, rel=1e-4), pytest.approx(50 / 20 * 5, rel=1e-4))
    assert got[1:] == [(None, None), (None, None)]
