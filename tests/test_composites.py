"""Composites, cutoffs, shadows and descriptor matches against values worked out by hand or by plain loops."""

import math

import numpy as np
from pyspark.sql import functions as F

from terraloom.operators import composites


def test_side_by_side(spark):
    sizes = spark.createDataFrame([(0, 3, 5), (1, 9, 2), (2, 4, 4)], "cloud long, cols long, rows long")
    cells = spark.createDataFrame([(0, 2, 4, "a"), (1, 8, 1, "b"), (2, 0, 3, "c")], "cloud long, col long, row long, x string")
    got = {r["x"]: (r["col"], r["row"]) for r in composites.side_by_side(cells, sizes, 4).collect()}
    assert got == {"a": (2, 4), "b": (8 + 1, 8), "c": (16, 3)}  # widths 3, 2 (turned) and 4
    alone = composites.side_by_side(cells.filter("cloud = 1"), sizes.filter("cloud = 1"), 4).collect()
    assert [(r["col"], r["row"]) for r in alone] == [(8, 1)]


def test_histogram_cutoff(spark):
    rng = np.random.default_rng(2)
    errors = [float(x) for x in rng.gamma(2.0, 1.0, 500)]
    df = spark.createDataFrame([(x,) for x in [*errors, 0.0, None, float("nan")]], "e double")
    bins = sorted(int(math.floor(1023 * min(x, 6.0) / 6.0 + 0.5)) for x in errors)
    at = lambda p: bins[math.ceil(p * len(bins)) - 1] * 6.0 / 1024
    r = composites.histogram_cutoff(df, "e", 6.0, 90.0, 2.0).first()
    assert tuple(r) == (at(0.25), at(0.5), at(0.75), at(0.9), 2 * at(0.9))
    assert composites.histogram_cutoff(df, "e", 6.0, 90.0, 2.0, tukey=True).first()["cutoff"] == at(0.75) + 1.5 * (at(0.75) - at(0.25))
    assert composites.histogram_cutoff(df.filter("false"), "e", 6.0, 90.0, 2.0).first()["cutoff"] == 0


def test_outside_crop(spark):
    p = spark.createDataFrame([(50.0, 20.0), (10.0, 20.0), (9.9, 20.0), (50.0, 36.0)], "x double, y double")
    assert [r[0] for r in p.select(composites.outside_crop(F.col("x"), F.col("y"), (100, 40), (80, 30))).collect()] == [False, False, True, True]


def test_shadows(spark):
    rng = np.random.default_rng(3)
    z = rng.uniform(0, 30, (7, 9))
    z[2, 4] = np.nan
    cells = spark.createDataFrame([(c, r, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(7) for c in range(9)], "col long, row long, v double")
    for azimuth, elevation in ((270.0, 20.0), (133.0, 35.0), (0.0, -1.0)):
        got = {(r["col"], r["row"]): r["shadow"] for r in composites.shadows(cells, (10.0, 12.0), azimuth, elevation).collect()}
        dx, dy, rise = 5 * math.sin(math.radians(azimuth)) / 10, -5 * math.cos(math.radians(azimuth)) / 12, 5 * math.tan(math.radians(elevation))
        for (c, r), shadow in got.items():
            wanted = False
            for i in range(1, 100):
                x, y, h = c + i * dx, r + i * dy, z[r, c] + i * rise
                if h > np.nanmax(z) or not (-1e-9 <= x <= 8 + 1e-9 and -1e-9 <= y <= 6 + 1e-9):
                    break
                x, y = min(max(x, 0), 8), min(max(y, 0), 6)
                c0, r0 = int(math.floor(x)), int(math.floor(y))
                nodes = [(c0 + i, r0 + j, (x - c0 if i else 1 - x + c0) * (y - r0 if j else 1 - y + r0)) for i in (0, 1) for j in (0, 1)]
                if h < sum(w * z[b, a] for a, b, w in nodes if w > 0):  # NaN hides nothing
                    wanted = True
            assert shadow == wanted, (azimuth, c, r)
        assert len(got) == 62


def test_descriptor_matches(spark):
    rng = np.random.default_rng(4)
    a = [(int(t), i, [float(x) for x in rng.normal(size=4)]) for i, t in enumerate(rng.integers(0, 3, 60))]
    b = [(t, 100 + i, [x + float(rng.normal()) * 0.2 for x in v]) for t, i, v in a] + [(0, 500, None), (0, 501, [1.0, None, 2.0, 3.0]), (9, 502, [0.0] * 4)]
    schema = "tile long, id long, descriptor array<double>"
    both = spark.createDataFrame([*a, (9, 77, [0.0] * 4), (8, 78, None)], schema), spark.createDataFrame(b, schema)
    got = {(r["tile"], r["id_a"], r["id_b"]) for r in composites.match_descriptors(*both, "tile", 0.7, block=7).collect()}
    wanted = set()
    for t, i, v in a:
        near = sorted((math.dist(v, w), j) for u, j, w in b if u == t and w is not None and None not in w)
        if near[0][0] < 0.7 * near[1][0]:
            wanted.add((t, i, near[0][1]))
    assert got == wanted and len(got) > 20
    bits = spark.createDataFrame([(0, 1, [0, 255]), (0, 2, [15, 0])], "tile long, id long, descriptor array<int>")
    found = composites.match_descriptors(bits, bits, "tile", 0.9, hamming=True).collect()
    assert {(r["id_a"], r["id_b"], r["distance"]) for r in found} == {(1, 1, 0.0), (2, 2, 0.0)}


def test_descriptors_of_a_large_tile_are_cut_into_blocks(spark):
    rng = np.random.default_rng(6)
    a, b = ([(0, i % n, [float(x) for x in v]) for i, v in enumerate(rng.integers(0, 60, (n + 3, 2)))] for n in (40, 400))
    schema = "tile long, id long, descriptor array<double>"
    found = composites.match_descriptors(spark.createDataFrame(a, schema), spark.createDataFrame(b[:400], schema), "tile", 0.8, block=5)
    wanted = []
    for _, i, v in a:
        near = sorted((math.dist(v, w), j) for _, j, w in b[:400])
        if near[0][0] < 0.8 * near[1][0]:
            wanted.append((i, near[0][1]))
    assert sorted((r["id_a"], r["id_b"]) for r in found.collect()) == sorted(wanted)
    assert "asked" in found._jdf.queryExecution().toString()  # groups are blocks, not tiles


def test_shadows_along_a_row_are_exact(spark):
    rows = [(0, 0, 150.0), (1, 0, 50.0), (2, 0, 50.0), (0, 1, None), (1, 1, 50.0), (2, 1, 49.0), (0, 2, 200.0), (1, 2, 0.0), (2, 2, 0.0)]
    cells = spark.createDataFrame(rows, "col long, row long, v double")
    got = {(r["col"], r["row"]) for r in composites.shadows(cells, (100.0, 100.0), 270.0, 45.0).filter("shadow").collect()}
    # in row 0 the ray just touches the highest cell, beside a hole below; one higher step hides
    assert got == {(1, 2)}
    higher = cells.replace(150.0, 152.0, subset="v")
    got = {(r["col"], r["row"]) for r in composites.shadows(higher, (100.0, 100.0), 270.0, 45.0).filter("shadow").collect()}
    assert got == {(1, 0), (2, 0), (1, 2)} - {(2, 0)}
