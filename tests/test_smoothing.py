"""Windows of differing sizes and smoothing by texture against brute force; networks completed by hand-computed disparities."""

import random

import pytest
from pyspark.sql import functions as F

from terraloom.operators.composites import pan_sharpened
from terraloom.operators.networks import complete_network, sweep
from terraloom.operators.smoothing import smooth_by_texture, texture, window_means

SCHEMA = "col long, row long, v double, half int"


def grid(seed, cols=23, rows=17, at=(-9, -5)):
    r = random.Random(seed)
    out = []
    for c in range(cols):
        for w in range(rows):
            if r.random() < 0.9:
                out.append((c + at[0], w + at[1], 1e9 + r.randrange(1000) if r.random() < 0.8 else None, r.choice([None, 0, 1, 2, 5])))
    return out


@pytest.mark.parametrize("tile", [4, 7, 256])
def test_window_means(spark, tile):
    cells = grid(1)
    got = {(r.col, r.row): (r.mean, r.n) for r in window_means(spark.createDataFrame(cells, SCHEMA), "half", 5, tile).collect()}
    assert len(got) == len(cells)
    for col, row, _, half in cells:
        inside = [v for c, w, v, _ in cells if v is not None and abs(c - col) <= (half or 0) and abs(w - row) <= (half or 0)]
        mean, n = got[col, row]
        assert n == len(inside) and (mean is None if not inside else mean == pytest.approx(sum(inside) / n, abs=1e-5))


def test_windows_beyond_the_largest_raise_and_nulls_are_left_out(spark):
    with pytest.raises(Exception, match="above 5"):
        window_means(spark.createDataFrame([(0, 0, 1.0, 6)], SCHEMA), "half", 5).collect()
    rows = [(0, 0, 1.0, 1), (0, 0, 3.0, 1), (None, 0, 9.0, 1), (1, None, 9.0, 1), (1, 0, None, 0)]
    found = window_means(spark.createDataFrame(rows, SCHEMA), "half", 2).collect()
    assert sorted((r.col, r.row, r.mean, r.n) for r in found if r.mean is not None) == [(0, 0, 2.0, 2), (0, 0, 2.0, 2)]
    assert [(r.mean, r.n) for r in found if r.col == 1] == [(None, 0)]
    assert window_means(spark.createDataFrame([], SCHEMA), "half", 2).count() == 0


@pytest.mark.parametrize("median", [0, 1])
def test_smoothing(spark, median):
    cells = {(c, w): v for c, w, v, _ in grid(2)}
    image = {(c, w): v and (v - 1e9 if c > 0 else 7.0) for c, w, v, _ in grid(3)}
    frame = lambda d: spark.createDataFrame([(c, w, v) for (c, w), v in d.items()], "col long, row long, v double")
    got = {(r.col, r.row): (r.v, r.half) for r in smooth_by_texture(frame(cells), frame(image), 2, 900.0, 11, median, 8).collect()}
    valid = {k: v for k, v in cells.items() if v is not None}
    near = lambda d, k, h: sorted(v for o, v in d.items() if abs(o[0] - k[0]) <= h and abs(o[1] - k[1]) <= h)
    if median:
        squares = {k: near(valid, k, median) for k in valid}
        valid = {k: s[len(s) // 2] for k, s in squares.items()}
    change = {}
    for (c, w), v in image.items():
        e, s = image.get((c + 1, w)), image.get((c, w + 1))
        if v is not None and e is not None and s is not None:
            change[c, w] = abs(e - v) + abs(s - v)
    assert set(got) == set(valid)
    halves = set()
    for k in valid:
        around = near(change, k, 2) if k in image else []
        half = max(0, (int(11 * (1 - sum(around) / len(around) / 900.0) // 1) - 1) // 2) if around else 0
        inside = near(valid, k, half)
        assert got[k][1] == half and got[k][0] == pytest.approx(sum(inside) / len(inside), abs=1e-5)
        halves.add(half)
    assert {0, 5} <= halves and len(halves) > 3


def test_texture_of_nothing(spark):
    lone = spark.createDataFrame([(0, 0, 1.0)], "col long, row long, v double")
    assert [tuple(r) for r in texture(lone, 1).collect()] == [(0, 0, None)]
    assert [tuple(r) for r in smooth_by_texture(lone, lone.limit(0), 1, 5.0, 9).collect()] == [(0, 0, 1.0, 0)]
    with pytest.raises(ValueError, match="above 0"):
        smooth_by_texture(lone, lone, 1, 0.0, 9)


def test_completed_network(spark):
    moves = spark.createDataFrame([(0, c, r, 2.0 * c, -1.0 if (c, r) != (3, 3) else None) for c in range(5) for r in range(5)], "cid long, col long, row long, dx double, dy double")
    aligned = spark.createDataFrame([(0, [1.0, 0.0, 1.0, 0.0, 1.0, 0.0], [2.0, 0.0, 0.5, 1.0, 4.0, 0.0])], "cid long, l array<double>, r array<double>")
    seen = [(1, 0, 0.5, 1.0), (1, 0, 0.5, 1.0), (2, 0, 1.5, 2.5), (3, 0, 9.0, 1.0), (4, 0, 2.0, 2.0), (5, 0, None, 1.0)]
    o = spark.createDataFrame(seen, "pid long, cid long, x double, y double").withColumn("dx", F.lit("other"))
    got = [tuple(r) for r in complete_network(o, moves, aligned, 10).collect()]
    # 1: aligned (1.5, 1), moved by (3, -1) to (4.5, 0), back: x = (4.5 - 0.5) / 2 = 2, y = (0 - 2) / 4; 2 and 3 meet a hole and the outside
    # 4: aligned (3, 2) is a node: moved by (6, -1) to (9, 1), back: x = 4.25, y = (1 - 4.25) / 4
    assert sorted(g for g in got if g[1] == 10) == [(1, 10, 2.0, -0.5), (1, 10, 2.0, -0.5), (4, 10, 4.25, -0.8125)]
    assert len([g for g in got if g[1] == 0]) == 6
    with pytest.raises(Exception, match="no transforms"):
        complete_network(o.withColumn("cid", F.lit(3)), moves, aligned, 10).collect()
    with pytest.raises(Exception, match="no inverse"):
        complete_network(o, moves, aligned.withColumn("r", F.array_repeat(F.lit(1.0), 6)), 10).collect()


def test_sweep(spark):
    df = spark.createDataFrame([(1, None), (2, 0.5)], "k long, v double")
    got = [tuple(r) for r in sweep(df, a=[1, 2, 3], b=["x", "y"]).collect()]
    assert sorted(got, key=str) == sorted(((k, v, a, b) for k, v in [(1, None), (2, 0.5)] for a in (1, 2, 3) for b in "xy"), key=str)
    assert sweep(df, a=[]).count() == 0
    with pytest.raises(ValueError, match="named like"):
        sweep(df, k=[1])


def test_pan_sharpening(spark):
    grey = spark.createDataFrame([(0, 0, 90.0, 0.5, 0.0), (1, 0, None, 0.5, 0.0), (2, 0, 90.0, 0.5, 0.5), (3, 0, 90.0, 7.0, 0.0), (4, 0, 300.0, 0.0, 0.0), (5, 0, 90.0, None, 0.0)], "col long, row long, v double, px double, py double")
    colours = spark.createDataFrame([(0, 0, 100.0, 100.0, 100.0), (1, 0, 200.0, 100.0, 0.0), (0, 1, 1.0, 1.0, 1.0), (1, 1, None, 1.0, 1.0)], "col long, row long, r double, g double, b double")
    got = {r["col"]: (r.r, r.g, r.b) for r in pan_sharpened(grey, colours).collect()}
    cb, cr = -0.168736 * 150 - 0.331264 * 100 + 0.5 * 50, 0.5 * 150 - 0.418688 * 100 - 0.081312 * 50  # of (150, 100, 50)
    assert got[0] == pytest.approx((90 + 1.402 * cr, 90 - 0.34414 * cb - 0.71414 * cr, 90 + 1.772 * cb))
    assert got[1] == got[2] == got[3] == got[5] == (None, None, None)
    assert got[4] == (255.0, 255.0, 255.0)


def test_means_of_whole_numbers_are_exact(spark):
    r = random.Random(4)
    cells = [(c, 0, float(r.randrange(100, 400)), 3) for c in range(200)]
    value = {c: v for c, _, v, _ in cells}
    for row in window_means(spark.createDataFrame(cells, SCHEMA), "half", 3).collect():
        inside = [value[c] for c in range(row.col - 3, row.col + 4) if c in value]
        assert row["mean"] == sum(inside) / len(inside)
