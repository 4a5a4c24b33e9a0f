"""Block matching, blends by border weights and limited pairings against plain loops."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import geometry
from terraloom.operators import joins, mosaic, neighbourhood, stereo


def frame(spark, a, first=(0, 0)):
    rows = [(c + first[0], r + first[1], None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "col long, row long, v double")


def plain_cost(l, r, cost, band):  # noqa: E741
    if np.isnan(l).any() or np.isnan(r).any():
        return None
    m = l.shape[0] // 2
    if cost == "absolute":
        return np.abs(l - r).sum()
    if cost == "squared":
        return ((l - r) ** 2).sum()
    if cost in ("ncc", "zncc"):
        l, r = (l - l.mean(), r - r.mean()) if cost == "zncc" else (l, r)  # noqa: E741
        n = math.sqrt((l * l).sum() * (r * r).sum())
        return -(l * r).sum() / n if n > 1e-9 else None
    sign = lambda a: np.where(a - a[m, m] > band, 1, np.where(a - a[m, m] < -band, -1, 0))
    return ((l > l[m, m]) != (r > r[m, m])).sum() if cost == "census" else np.abs(sign(l) - sign(r)).sum()


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(5)
    left = rng.integers(0, 50, (14, 19)).astype(float)
    right = np.roll(left, (1, -2), (0, 1)) + rng.integers(0, 4, left.shape)
    left[3, 4] = right[9, 9] = np.nan
    left[8:12, 12:16] = 7.0  # flat: some correlations are undefined
    return left, right


@pytest.mark.parametrize("cost", stereo.COSTS)
def test_block_match(spark, images, cost):
    left, right = images
    search, half, apart = (-3, 1, -1, 2), 1, 1
    off = (-4, 3)  # a frame that starts below 0 and crosses tiles
    got = {(r["col"] - off[0], r["row"] - off[1]): r for r in stereo.block_match(frame(spark, left, off), frame(spark, right, off), search, half, cost, tile=5, band=3.0, apart=apart).collect()}
    seen = 0
    for r, c in itertools.product(range(1, 13), range(1, 18)):
        costs = {}
        for dy, dx in itertools.product(range(search[2], search[3] + 1), range(search[0], search[1] + 1)):
            y, x = r + dy, c + dx
            if 1 <= y < 13 and 1 <= x < 18:
                k = plain_cost(left[r - 1 : r + 2, c - 1 : c + 2], right[y - 1 : y + 2, x - 1 : x + 2], cost, 3.0)
                if k is not None:
                    costs[dx, dy] = float(k)
        row = got.get((c, r))
        if not costs:
            assert row is None
            continue
        seen += 1
        best = min(costs.values())
        assert row["cost"] == pytest.approx(best, abs=1e-9)
        at = row["dx"], row["dy"]
        if cost not in ("ncc", "zncc"):  # whole numbers: ties go to the smaller dy, then dx
            assert at == min((d for d, k in costs.items() if k == best), key=lambda d: (d[1], d[0]))
        for name, d in {"before_x": (-1, 0), "after_x": (1, 0), "before_y": (0, -1), "after_y": (0, 1)}.items():
            wanted = costs.get((at[0] + d[0], at[1] + d[1]))
            assert (row[name] is None) == (wanted is None) and (wanted is None or row[name] == pytest.approx(wanted, abs=1e-9))
        far = [k for d, k in costs.items() if max(abs(d[0] - at[0]), abs(d[1] - at[1])) > apart]
        assert row["others"] == len(far)
        if far:
            assert (row["second"], row["others_mean"], row["others_std"]) == pytest.approx((min(far), np.mean(far), np.std(far)), abs=1e-6)
        else:
            assert row["second"] is None and row["others_mean"] is None and row["others_std"] is None
    assert len(got) == seen > 100


def test_planted_shift(spark):
    rng = np.random.default_rng(6)
    y, x = np.mgrid[0:30, 0:40]
    surface = lambda x, y: sum(a * np.sin(b * x + c * y + d) for a, b, c, d in waves)
    turns, speeds = rng.uniform(0, 2 * math.pi, (2, 60)), rng.uniform(0.4, 1.0, 60)
    waves = [(1.0, v * math.cos(t), v * math.sin(t), p) for v, t, p in zip(speeds, turns[0], turns[1], strict=True)]  # no direction is preferred
    left, right = frame(spark, surface(x, y)), frame(spark, surface(x - 2.3, y + 1.4))  # right(x + 2.3, y - 1.4) is left(x, y)
    found = stereo.block_match(left, right, (-5, 5, -4, 4), 4, "zncc", tile=16)
    back = stereo.block_match(right, left, (-5, 5, -4, 4), 4, "zncc", tile=16)
    kept = stereo.refined(stereo.peak_quality(stereo.agreeing(found, back, 1))).collect()
    assert len(kept) > 400
    assert np.abs(np.median([r["x"] for r in kept]) - 2.3) < 0.1 and np.abs(np.median([r["y"] for r in kept]) + 1.4) < 0.1
    assert all(0 <= r["peak_ratio"] <= 1 and r["snr"] >= 0 for r in kept) and np.median([r["score"] for r in kept]) > 0.9


def test_matches_of_nothing(spark, images):
    left = frame(spark, images[0])
    empty = left.filter("false")
    for a, b in ((empty, empty), (left, empty), (empty, left)):
        assert stereo.block_match(a, b, (-1, 1, -1, 1), 1).count() == 0
    with pytest.raises(ValueError):
        stereo.block_match(left, left, (-1, 1, -1, 1), 1, "unknown")
    twice = left.unionByName(left.withColumn("v", F.col("v") - 1))  # of equal cells the largest counts
    key = lambda r: (r["col"], r["row"])
    once, again = (sorted(map(tuple, stereo.block_match(a, left, (-1, 1, 0, 0), 1, "absolute", tile=7).select("col", "row", "dx", "dy", "cost").collect())) for a in (left, twice))
    assert once == again and all(c[4] == 0 for c in once)


def depth_of(a):
    rows, cols = a.shape
    holes = list(zip(*np.nonzero(np.isnan(a)), strict=True))
    edge = lambda r, c: min(r + 1, c + 1, rows - r, cols - c)
    return np.array([[0 if np.isnan(a[r, c]) else min([edge(r, c), *(abs(r - y) + abs(c - x) for y, x in holes)]) for c in range(cols)] for r in range(rows)], float)


def plain_blend(inputs, most, sigma, power):
    half = math.ceil(3 * sigma)
    taps = np.array([math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)])
    taps /= taps.sum()
    up, down = np.zeros_like(inputs[0]), np.zeros_like(inputs[0])
    for a in inputs:
        w = np.minimum(depth_of(a), most)
        wide = np.pad(w, half)
        smooth = sum(taps[i] * taps[j] * wide[i : i + w.shape[0], j : j + w.shape[1]] for i in range(len(taps)) for j in range(len(taps)))
        w = np.where(w > 0, smooth, 0.0) ** power
        up, down = up + w * np.nan_to_num(a), down + w
    return {(c, r): up[r, c] / down[r, c] for r in range(up.shape[0]) for c in range(up.shape[1]) if down[r, c] > 0}


@pytest.fixture(scope="module")
def inputs():
    rng = np.random.default_rng(7)
    found = [rng.uniform(0, 100, (12, 15)) for _ in range(3)]
    found[0][:, 9:] = np.nan
    found[1][:, :4] = np.nan
    found[1][6, 10] = found[2][2, 2] = np.nan
    return found


def test_blends_by_borders(spark, inputs):
    df = frame(spark, inputs[0]).withColumn("idx", F.lit(0))
    for i in (1, 2):
        df = df.unionByName(frame(spark, inputs[i]).withColumn("idx", F.lit(i)))
    got = {(r["col"], r["row"]): r["blend"] for r in mosaic.blurred_blend(df, 4.0, 1.0, 2.0).collect()}
    assert got == pytest.approx(plain_blend(inputs, 4.0, 1.0, 2.0))
    depths, kept = [depth_of(a) for a in inputs], [a.copy() for a in inputs]
    for r, c in itertools.product(range(12), range(15)):
        room = math.inf
        for i in range(3):
            w = min(room, depths[i][r, c])
            room = min(room, max(0.0, 3.0 - w)) if depths[i][r, c] > 0 else room
            if w <= 0:
                kept[i][r, c] = np.nan
    assert sum(np.isnan(k).sum() for k in kept) > sum(np.isnan(a).sum() for a in inputs)
    got = {(r["col"], r["row"]): r["blend"] for r in mosaic.border_priority_blend(df, 3.0, 4.0, 1.0, 2.0).collect()}
    assert got == pytest.approx(plain_blend(kept, 4.0, 1.0, 2.0))
    assert mosaic.border_priority_blend(df.filter("false"), 3.0).count() == 0


@pytest.mark.parametrize("wrap", [False, True])
def test_limited_overlaps(spark, wrap):
    rng = np.random.default_rng(8)
    boxes = [(i, float(x), float(y), float(x + 4), float(y + 4)) for i, (x, y) in enumerate(rng.uniform(0, 20, (60, 2)))]
    hit = lambda p, q: p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]
    most, wanted = 3, set()
    for i in range(60):
        added = 0
        for k in range(i + 1, 60 + (most if wrap else 0)):
            j = k % 60
            pair = (min(i, j), max(i, j))
            if i != j and hit(boxes[i], boxes[j]) and pair not in wanted and added < most:
                wanted.add(pair)
                added += 1
    df = spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double")
    got = [(r["a"], r["b"]) for r in joins.limited_overlaps(df, 3.0, most, wrap).collect()]
    assert sorted(got) == sorted(wanted)


@pytest.mark.parametrize("block, wait", [(1024, 4096), (7, 5)])
def test_overlaps_in_crowded_cells(spark, monkeypatch, block, wait):
    monkeypatch.setattr(joins, "BLOCK_ROWS", block)
    monkeypatch.setattr(joins, "WAITING", wait)
    monkeypatch.setattr(joins, "STEP", wait)
    rng = np.random.default_rng(9)
    boxes = [(i, float(x), float(y), float(x + w), float(y + 1)) for i, (x, y, w) in enumerate(rng.uniform(0, 6, (150, 3)))]
    boxes += [(i, 1.0, 1.0, 2.0, 2.0) for i in range(150, 200)] + [(250, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double")
    hit = lambda p, q: p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]
    wanted = [(p[0], q[0]) for p in boxes[:200] for q in boxes[p[0] + 1 : 200] if hit(p, q)]
    assert sorted((r["a"], r["b"]) for r in joins.box_overlaps(df, 3.0).collect()) == wanted
    first = [p for k, p in enumerate(wanted) if k < 4 or wanted[k - 4][0] != p[0]]
    limited = joins.limited_overlaps(df, 3.0, 4)
    assert sorted((r["a"], r["b"]) for r in limited.collect()) == first
    assert "Join" not in limited._jdf.queryExecution().toString()  # no pairs beyond the first are made


def test_near_pairs(spark):
    items = spark.createDataFrame([(i, float(i * i), 0.0, None if i == 2 else 0.0) for i in range(5)], "i long, x double, y double, z double")
    pairs = lambda *a: sorted((r["i"], r["j"]) for r in joins.near_pairs(items, *a).collect())
    assert pairs(1) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert pairs(1, True) == [(0, 1), (0, 4), (1, 2), (2, 3), (3, 4)]
    assert pairs(1, True, 6.0) == [(0, 1), (1, 2), (2, 3)]  # 2 is nowhere, so it is near all
    assert pairs(9, True) == [(i, j) for i in range(5) for j in range(i + 1, 5)]


def test_quantile_and_refraction(spark):
    cells = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate([1, -2, 3, 4, -50, 6, 7, 100, 9, 10])], "col long, row long, v double")
    left = {r["v"] for r in neighbourhood.clean_by_quantile(cells, 0.7, 1.5).collect()}
    assert left == {1, -2, 3, 4, 6, 7, 9, 10}  # the eighth size is 10, and 1.5 times that is 15
    assert neighbourhood.clean_by_quantile(cells.filter("false"), 0.7, 1.5).count() == 0
    response = spark.createDataFrame([(250.0, 9.0), (400.0, 2.0), (500.0, 2.0), (600.0, 0.0), (700.0, -1.0), (450.0, None)], "w double, r double")
    found = geometry.effective_wavelength(F.col("w"), F.col("r"), 300, 1100)
    assert tuple(response.agg(*found.values()).first()) == (450.0, 400.0)
    fresh, sea = response.limit(1).select(*(geometry.refraction_index_by_salinity(F.lit(532.0), F.lit(20.0), F.lit(s)) for s in (0.0, 35.0))).first()
    assert fresh == pytest.approx(1.33507, abs=2e-5) and sea == pytest.approx(1.34155, abs=2e-4)


def test_hole_fills(spark):
    a = np.arange(42.0).reshape(6, 7) ** 1.5
    for r, c in [(1, 1), (2, 3), (2, 4), (3, 3), (0, 5), (4, 6)]:
        a[r, c] = np.nan
    cells = lambda df: {(r["col"], r["row"]): r["v"] for r in df.collect()}
    got, wanted = cells(neighbourhood.fill_short_holes(frame(spark, a), 2)), a.copy()
    for r, c in [(1, 1), (2, 3), (2, 4), (3, 3)]:  # the other two are at the frame's end
        ends = [next((k, a[r + k * y, c + k * x]) for k in range(1, 7) if not np.isnan(a[r + k * y, c + k * x])) for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        wanted[r, c] = sum(v / k for k, v in ends) / sum(1 / k for k, _ in ends)
    assert all(got[c, r] is None if np.isnan(wanted[r, c]) else got[c, r] == pytest.approx(wanted[r, c]) for r in range(6) for c in range(7)) and len(got) == 42
    narrow = cells(neighbourhood.fill_short_holes(frame(spark, a), 1))
    assert narrow[1, 1] is not None and narrow[3, 2] is None and narrow[4, 2] is None and narrow[3, 3] is None
    now = a.copy()
    disc = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if (x, y) != (0, 0)]
    for _ in range(2):
        before = now.copy()
        for r, c in zip(*np.nonzero(np.isnan(before)), strict=True):
            near = [(before[r + y, c + x], 1 / (math.hypot(x, y) ** 2 + 1)) for x, y in disc if 0 <= r + y < 6 and 0 <= c + x < 7 and not np.isnan(before[r + y, c + x])]
            if len(near) >= 0.7 * 8:
                now[r, c] = sum(v * w for v, w in near) / sum(w for _, w in near)
    got = cells(neighbourhood.fill_in_passes(frame(spark, a), 1.5, 2.0, 0.7, 2))
    assert all(got[c, r] is None if np.isnan(now[r, c]) else got[c, r] == pytest.approx(now[r, c]) for r in range(6) for c in range(7))
    assert 0 < np.isnan(now).sum() < 6 and neighbourhood.fill_in_passes(frame(spark, a).filter("false"), 1.5, 2.0, 0.7, 1).count() == 0
