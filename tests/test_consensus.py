"""Consensus models, chips, sequential choice and rays against planted values and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import geometry as G
from terraloom.operators import chips, consensus, networks, rays


def test_plane_among_outliers(spark):
    rng = np.random.default_rng(1)
    good = [(i, x, y, 0.3 * x - 0.2 * y + 4) for i, (x, y) in enumerate(rng.uniform(-50, 50, (400, 2)).tolist())]
    bad = [(1000 + i, x, y, 40 + z) for i, (x, y, z) in enumerate(rng.uniform(-50, 50, (250, 3)).tolist())]
    bad = [r for r in bad if abs(0.3 * r[1] - 0.2 * r[2] + 4 - r[3]) > 0.5]
    df = spark.createDataFrame([*good, *bad, (5000, None, 1.0, 1.0)], "id long, x double, y double, z double")
    found = []
    for parts in (1, 5):
        model, n = consensus.consensus(df.repartition(parts), consensus.Plane, "id", 0.01, hypotheses=100)
        assert n == 400 and {r["id"] for r in df.filter(consensus.Plane.error(model) <= 0.01).collect()} == set(range(400))
        found.append(model)
    assert np.allclose(*found, atol=1e-9)
    normal = np.array([-0.3, 0.2, 1]) / np.linalg.norm([-0.3, 0.2, 1])
    assert np.allclose(found[0], [*normal, 4 * normal[2]], atol=1e-9)
    counts = consensus.score(df.dropna(), consensus.Plane, np.array([found[0], [0, 0, 1, 0.0]]), 0.01)
    assert counts.tolist() == [400, sum(abs(r[3]) <= 0.01 for r in [*good, *bad])]


def test_affine_among_outliers(spark):
    rng = np.random.default_rng(2)
    m = np.array([[0.9, 0.1, 5.0], [-0.2, 1.1, -3.0]])
    rows = []
    for i, (x, y) in enumerate(rng.uniform(0, 100, (300, 2)).tolist()):
        u, v = m @ [x, y, 1] + (rng.normal(0, 0.01, 2) if i < 200 else rng.uniform(20, 60, 2))
        rows.append((i, x, y, float(u), float(v)))
    df = spark.createDataFrame(rows, "id long, x double, y double, u double, v double").repartition(3)
    model, n = consensus.consensus(df, consensus.Affine, "id", 0.1)
    assert n == 200 and np.allclose(model.reshape(2, 3), m, atol=5e-3)


def test_degenerate_models(spark):
    line = spark.createDataFrame([(i, float(i), 2.0 * i, 3.0 * i) for i in range(20)], "id long, x double, y double, z double")
    with pytest.raises(ValueError):
        consensus.consensus(line, consensus.Plane, "id", 0.1)
    with pytest.raises(ValueError):
        consensus.consensus(line.limit(2), consensus.Plane, "id", 0.1)


@pytest.mark.parametrize("task", [50_000, 300])
def test_chips(spark, monkeypatch, task):
    monkeypatch.setattr(chips, "TASK_POINTS", task)
    monkeypatch.setattr(chips, "MOST_QUARTERINGS", 5)
    rng = np.random.default_rng(4)
    rows = [(i, *p) for i, p in enumerate(rng.uniform(-10, 30, (1500, 2)).tolist())] + [(5000 + i, 3.0, 3.0) for i in range(700)] + [(1, None, 2.0), (None, 1.0, 1.0), (1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(3)
    out = chips.chips(df, 20.0, 64).collect()
    assert len(out) == len(rows) - 1
    held = {}
    for r in out:
        assert (r["tile_x"], r["tile_y"]) == (math.floor(r["x"] / 20), math.floor(r["y"] / 20))
        held.setdefault((r["tile_x"], r["tile_y"], r["chip"]), []).append((r["x"], r["y"]))
    assert max(map(len, held.values())) <= 64
    if task == 50_000:
        assert min(map(len, held.values())) >= 32
    # chips of one tile don't overlap but where points coincide
    boxes = [(k[:2], *np.min(v, axis=0), *np.max(v, axis=0)) for k, v in held.items()]
    for i, a in enumerate(boxes):
        for b in boxes[:i]:
            assert a[0] != b[0] or a[3] <= b[1] or b[3] <= a[1] or a[4] <= b[2] or b[4] <= a[2] or 3.0 in (a[1], a[3], b[1], b[3])
    assert chips.chips(df.filter("false"), 20.0).count() == 0


def test_quarterings_are_counted_several_at_once(spark, monkeypatch):
    monkeypatch.setattr(chips, "TASK_POINTS", 50)
    written, real = [], chips.stored
    monkeypatch.setattr(chips, "stored", lambda df, name: written.append(name) or real(df, name))
    rng = np.random.default_rng(8)
    at = np.concatenate([rng.uniform(0, 20 / 16, (400, 2)), rng.uniform(-20, -20 + 20 / 16, (300, 2))]).tolist()  # the first four quarterings part nothing
    df = spark.createDataFrame([(i, x, y, [str(i)], {"k": i}) for i, (x, y) in enumerate(at)], "id long, x double, y double, names array<string>, m map<string, int>").repartition(3)
    out = chips.chips(df, 20.0, 16).collect()
    assert {(r["id"], r["x"], r["y"], r["names"][0], r["m"]["k"]) for r in out} == {(i, x, y, str(i), i) for i, (x, y) in enumerate(at)} and len(out) == 700
    held = {}
    for r in out:
        held.setdefault((r["tile_x"], r["tile_y"], r["chip"]), []).append((r["x"], r["y"]))
    boxes = [(k[:2], *np.min(v, axis=0), *np.max(v, axis=0)) for k, v in held.items()]
    assert max(map(len, held.values())) <= 16 and len({b[0] for b in boxes}) == 2
    assert all(a[0] != b[0] or a[3] < b[1] or b[3] < a[1] or a[4] < b[2] or b[4] < a[2] for i, a in enumerate(boxes) for b in boxes[:i])
    assert written.count("chips") <= 1


def sequential(rows):
    left, right, out = set(), set(), []
    for r in sorted(rows):
        if r[0] not in left and r[1] not in right:
            left.add(r[0])
            right.add(r[1])
            out.append(r)
    return sorted(out)


def test_first_come(spark):
    rng = np.random.default_rng(6)
    cases = [sorted(set(map(tuple, rng.integers(0, n, (m, 2)).tolist()))) for n, m in ((30, 200), (5, 40))]
    cases += [[(i // 2, (i + 1) // 2) for i in range(60)], [(7, i) for i in range(50)], []]  # a chain, one hot key, none
    for rows in cases:
        df = spark.createDataFrame(rows, "l long, r long").repartition(3)
        assert sorted(tuple(r) for r in chips.first_come(df, ["l"], ["r"], ["l", "r"]).collect()) == sequential(rows)


def test_unseen_matches_is_sequential(spark):
    have = spark.createDataFrame([(0, 0, 9, 9)], "lx long, ly long, rx long, ry long")
    rows = [(1, 0, 1, 0), (1, 0, 2, 0), (2, 0, 2, 0), (2, 0, 3, 0), (3, 0, 9, 9), (0, 0, 5, 5), (3, 0, 3, 0), (1, 0, 1, 0)]
    more = spark.createDataFrame(rows, "lx long, ly long, rx long, ry long")
    got = sorted(tuple(r) for r in networks.unseen_matches(have, more).collect())
    assert got == [(0, 0, 9, 9), (1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0)]


def ray_rows(rng, key, point, n, noise):
    for _ in range(n):
        c = rng.uniform(-500, 500, 3)
        d = (np.array(point) - c) * rng.uniform(0.5, 3) + rng.normal(0, noise, 3)
        yield (key, *c.tolist(), *d.tolist())


SCHEMA = "track long, cx double, cy double, cz double, dx double, dy double, dz double"


def test_triangulation(spark):
    rng = np.random.default_rng(9)
    point = np.array([4_000_123.0, -2_000_456.0, 5_000_789.0])
    rows = [*ray_rows(rng, 1, (3, 4, 5), 6, 0.0), *ray_rows(rng, 2, (-30, 40, 5), 5, 2.0)]
    rows += [(3, *(point + c).tolist(), *map(float, d)) for c, d in (((-100, 0, 0), (1.0, 0, 0)), ((0, -100, 0), (0, 1.0, 0)), ((0, 0.5, -100), (0, 0, 1.0)))]
    rows += [(4, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (5, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (5, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0), (6, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (7, None, 0.0, 0.0, 1.0, 0.0, 0.0)]
    got = {r["track"]: r for r in rays.triangulate(spark.createDataFrame(rows, SCHEMA).repartition(3), "track").collect()}
    assert np.allclose([got[1][c] for c in "xyz"], (3, 4, 5)) and got[1]["error"] < 1e-9 and got[1]["n"] == 6
    a, b = np.zeros((3, 3)), np.zeros(3)
    mine = [np.array(r[1:]) for r in rows if r[0] == 2]
    for r in mine:
        d = r[3:] / np.linalg.norm(r[3:])
        p = np.eye(3) - np.outer(d, d)
        a, b = a + p, b + p @ r[:3]
    x = np.linalg.solve(a, b)
    assert np.allclose([got[2][c] for c in "xyz"], x, atol=1e-7)
    assert math.isclose(got[2]["error"], np.mean([np.linalg.norm(np.cross(x - r[:3], r[3:] / np.linalg.norm(r[3:]))) for r in mine]), rel_tol=1e-6)
    # three lines along the axes, one of them half a unit off: the point is half-way, the third's distance and the first's a quarter each
    assert np.allclose(np.array([got[3][c] for c in "xyz"]) - point, (0, 0.25, 0), atol=1e-6)
    assert got[4]["x"] is None and got[5]["x"] is None and 6 not in got and 7 not in got


def test_two_rays_are_the_midpoint(spark):
    rng = np.random.default_rng(10)
    rows = [r for k in range(40) for r in ray_rows(rng, k, rng.uniform(-50, 50, 3), 2, 3.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["track"]: [r[c] for c in "xyz"] for r in rays.triangulate(df, "track").collect()}
    for k in range(40):
        a, b = (r for r in rows if r[0] == k)
        point, distance = G.ray_midpoint(*([F.lit(v) for v in part] for r in (a, b) for part in (r[1:4], r[4:])))
        want = spark.range(1).select(*point).first()
        assert np.allclose(got[k], list(want), atol=1e-6)


def test_refraction(spark):
    angle = math.radians(40)
    at, way = G.refract([F.lit(0.0), F.lit(0.0), F.lit(10.0)], [F.lit(math.sin(angle)), F.lit(0.0), F.lit(-math.cos(angle))], (0.0, 0.0, 1.0), 0.0, 1.33)
    r = spark.range(1).select(*(c.alias(f"p{i}") for i, c in enumerate(at)), *(c.alias(f"d{i}") for i, c in enumerate(way))).first()
    inner = math.asin(math.sin(angle) / 1.33)
    assert np.allclose([r["p0"], r["p1"], r["p2"]], [10 * math.tan(angle), 0, 0])
    assert np.allclose([r["d0"], r["d1"], r["d2"]], [math.sin(inner), 0, -math.cos(inner)])
    # out of the water at a flat angle: all light stays inside; along the plane: no meeting
    out = G.refract([F.lit(0.0), F.lit(0.0), F.lit(-1.0)], [F.lit(1.0), F.lit(0.0), F.lit(0.2)], (0.0, 0.0, -1.0), 0.0, 1 / 1.33)[1]
    flat = G.refract([F.lit(0.0), F.lit(0.0), F.lit(1.0)], [F.lit(1.0), F.lit(0.0), F.lit(0.0)], (0.0, 0.0, 1.0), 0.0, 1.33)[0]
    assert spark.range(1).select(out[0].alias("a"), flat[0].alias("b")).first() == (None, None)
