"""Operators against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from terraloom.functions import geometry as G
from terraloom.functions import statistics as S
from terraloom.operators import filters, gridding, joins, mosaic, neighbourhood, networks, reports, series
from terraloom.sources import networks as N


def column(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v double")


def plane_cells(spark, f, n=3):
    return spark.createDataFrame([(c, r, f(c, r)) for c in range(n) for r in range(n)], "col long, row long, v double")


@pytest.mark.parametrize(
    ("slope_of", "azimuth"),
    # rows grow southwards; the aspect is where the surface looks: down its slope
    [(lambda c, r: -10.0 * c, 90.0), (lambda c, r: 10.0 * c, 270.0), (lambda c, r: 10.0 * r, 0.0), (lambda c, r: -10.0 * r, 180.0)],
)
def test_aspect_is_an_azimuth(spark, slope_of, azimuth):
    got = neighbourhood.slope_aspect(plane_cells(spark, slope_of), 10.0).collect()
    assert len(got) == 1 and got[0]["slope"] == pytest.approx(45.0) and got[0]["aspect"] == pytest.approx(azimuth)


def test_flat_cells_have_no_aspect(spark):
    row = neighbourhood.slope_aspect(plane_cells(spark, lambda c, r: 5.0), 10.0).first()
    assert (row["slope"], row["aspect"]) == (0.0, None)


def test_centreline_weight(spark):
    cells = spark.createDataFrame([(c, 0, 1.0) for c in range(5)] + [(2, 1, 1.0), (2, 2, 1.0)], "col long, row long, v double")
    got = {(r["col"], r["row"]): r["weight"] for r in neighbourhood.centreline_weight(cells).collect()}
    assert got[2, 0] == pytest.approx(2 * 1e-8, rel=1e-6)  # the middle of a row of half width 2, the end of a column of half width 1
    assert got[0, 0] == 0 and got[2, 1] == 0  # alone in their column, or row
    square = {(r["col"], r["row"]): r["weight"] for r in neighbourhood.centreline_weight(plane_cells(spark, lambda c, r: 1.0, 5), 1.0).collect()}
    assert square[2, 2] == 1.0 and square[1, 2] == pytest.approx(1.0, rel=1e-6)


def test_gaussian_weight_is_sampled(spark):
    got = spark.createDataFrame([(d,) for d in (0.0, 0.0004, 0.0006, 1.0)], "d double").select(gridding.gaussian_weight(F.col("d"), 1.0, 0.999).alias("w")).collect()
    at = lambda d: math.exp(math.log(0.25) * d * d)
    assert [r["w"] for r in got] == pytest.approx([1.0, 1.0, at(0.001), at(1.0)], rel=1e-12)


def test_empty_cells_of_a_frame(spark):
    points = spark.createDataFrame([(0.0, 0.0, 7.0), (0.0, 0.1, 9.0)], "x double, y double, z double")
    frame = spark.createDataFrame([(0, 0), (5, 5)], "col long, row long")
    got = {r["col"]: (r["count"], r["80-pct"]) for r in gridding.grid(points, 1.0, 0.5, ("count", "80-pct"), frame=frame).collect()}
    assert got == {0: (2, pytest.approx(8.6)), 5: (0, None)}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 300])
def test_ranks_and_picks(spark, n):
    df = column(spark, *(float(i * 7919 % n) for i in range(n)), None)
    row = S.picks(df, "v", {"u": S.upper_middle(), "f": S.floor_place(0.75), "r": S.rounded_place(0.16)}).first()
    assert (row["u"], row["f"], row["r"]) == (n // 2, min(int(0.75 * n), n - 1), min(int(0.16 * n + 0.5), n - 1))
    assert S.medians(df, "v").first()["median"] == (n - 1) / 2


def test_ranks_of_ties_null_keys_and_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), (None, 5.0)], "k string, v double")
    got = {(r["k"], r["v"]): (r["c"], r["upto"], r["n"]) for r in S.value_ranks(df, "v", ["k"]).collect()}
    assert got == {("a", 1.0): (2, 2, 3), ("a", 2.0): (1, 3, 3), (None, 5.0): (1, 1, 1)}
    assert S.picks(df.limit(0), "v", {"u": S.upper_middle()}).first()["u"] is None


def test_error_summary(spark):
    row = reports.error_summary(column(spark, 4.0, 1.0, 3.0, 2.0), "v").first().asDict()
    assert (row["p16"], row["p84"], row["p50"]) == (2.0, 4.0, 2.5)
    assert [row[f"best{q}"] for q in (25, 50, 75, 100)] == [1.0, 1.5, 2.0, 2.5]
    assert row["rmse"] == pytest.approx(math.sqrt(7.5)) and row["nmad"] == pytest.approx(1.4826) and row["stddev"] == pytest.approx(math.sqrt(1.25))


def test_stretch_rounds_and_fills_holes(spark):
    cells = spark.createDataFrame([(0, c, 0, float(c)) for c in range(100)] + [(0, 100, 0, None)], "idx long, col long, row long, v double")
    got = {r["col"]: r["stretched"] for r in reports.percentile_stretch(cells).collect()}
    assert got[100] == 0 and got[0] == 0 and got[99] == 255 and got[50] == math.floor((50 - 2) / 96 * 255 + 0.5)


def test_normalisation_bounds(spark):
    stats = spark.createDataFrame([(0, 0.0, 10.0, 5.0, 1.0, 1.0, 9.0), (1, 2.0, 30.0, 8.0, 2.0, 3.0, 20.0)], "idx long, min double, max double, median double, nmad double, p2 double, p98 double")
    bounds = lambda **k: [tuple(r)[1:] for r in reports.normalisation_bounds(stats, **k).orderBy("idx").collect()]
    assert bounds() == [(3.0, 12.0)] * 2 and bounds(each=True) == [(3.0, 7.0), (4.0, 12.0)]
    assert bounds(whole_range=True) == [(0.0, 30.0)] * 2 and bounds(percentiles=True, each=True) == [(1.0, 9.0), (3.0, 20.0)]
    assert bounds(stay_inside=True) == [(3.0, 10.0), (3.0, 12.0)]


def test_inlier_box_is_most_generous_in_z(spark):
    points = spark.createDataFrame([(float(i), float(i), float(i)) for i in range(101)], "x double, y double, z double")
    box = filters.inlier_box(points, 75, 3).first()
    assert box["x_lo"] == pytest.approx(12.5 - 6 * 75) and box["x_hi"] == pytest.approx(87.5 + 6 * 75)
    assert box["z_lo"] == pytest.approx(6.25 - 6 * 87.5) and box["z_hi"] == pytest.approx(93.75 + 6 * 87.5)


def test_control_points_are_no_outliers(spark):
    means = spark.createDataFrame([(i, 1.0, False) for i in range(20)] + [(20, 99.0, True), (21, 99.0, False), (22, 4.0, False)], "pid long, m double, gcp boolean")
    assert [r["pid"] for r in filters.adjustment_outliers(means, "m", 75, 3, 5, 8, "gcp").collect()] == [21]


def test_spread_filter_leaves_the_upper_border_out(spark):
    assert sorted(r["v"] for r in filters.spread_filter(column(spark, 1.0, 5.0, 9.0, 3.0, 7.0), ["v"], 4.0).collect()) == [3.0, 5.0]


def test_error_clusters(spark):
    good, bad = [1.0 + 0.01 * (i % 7) for i in range(200)], [500.0 + 40 * i for i in range(40)]
    left = [r["v"] for r in filters.error_clusters(column(spark, *good, *bad, 0.0), "v").collect()]
    assert len(left) == 200 and max(left) < 2
    assert filters.error_clusters(column(spark).limit(0), "v").count() == 0


def test_search_range_cuts_until_it_fits(spark):
    df = column(spark, *(float(i) for i in range(100)))
    assert tuple(filters.search_range(df, "v", 1000.0).first()) == (0.0, 99.0)
    assert tuple(filters.search_range(df, "v", 80.0).first()) == (10.0, 90.0)


def test_same_frame_raises_on_another_size(spark):
    a, b = plane_cells(spark, lambda c, r: 1.0), plane_cells(spark, lambda c, r: 1.0, 4)
    assert joins.same_frame([a, a]).count() == 9
    with pytest.raises(Exception, match="different size"):
        joins.same_frame([a, b]).collect()


def test_lookup_codes(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 0, None), (0, 1, 3.0), (1, 1, 5.0)], "col long, row long, v double")
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.0), (3, 9.0, 9.0)], "id int, px double, py double")
    assert {r["id"]: r["code"] for r in joins.bilinear(pts, cells, codes=True).collect()} == {1: 1, 2: -1, 3: 0}


def test_edge_mask(spark):
    # A frame of 10 x 10 whose active area is columns and rows 2 to 4
    cells = plane_cells(spark, lambda c, r: 1.0 if 2 <= c <= 4 and 2 <= r <= 4 else None, 10)
    assert {(r["col"], r["row"]) for r in neighbourhood.edge_mask(cells).collect()} == {(c, r) for c in (2, 3, 4) for r in (2, 3, 4)}
    assert {(r["col"], r["row"]) for r in neighbourhood.edge_mask(cells, 1).collect()} == {(3, 3)}


def test_blobs(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (1, 1, 1.0), (3, 3, 1.0), (2, 0, None)], "col long, row long, v double")
    got = neighbourhood.blobs(cells, 2).collect()
    assert {(r["col"], r["row"]) for r in got} == {(0, 0), (1, 0), (1, 1)} and {r["area"] for r in got} == {3}


def test_fill_holes(spark):
    cells = plane_cells(spark, lambda c, r: None if (c, r) == (1, 1) else 4.0)
    assert {r["v"] for r in neighbourhood.fill_holes(cells, 1, 2.0, 1.0).collect()} == {4.0}
    edge = plane_cells(spark, lambda c, r: None if (c, r) == (0, 0) else 4.0)
    assert None in {r["v"] for r in neighbourhood.fill_holes(edge, 1, 2.0, 0.75).collect()}


def test_priority_blend(spark):
    cells = spark.createDataFrame([(0, 0, 0, 10.0, 8.0), (1, 0, 0, 20.0, 8.0), (0, 1, 0, 10.0, 1.0), (1, 1, 0, 20.0, 1.0)], "idx long, col long, row long, v double, depth double")
    got = {r["col"]: r["v"] for r in mosaic.priority_blend(cells, "depth", 4.0, 1.0).collect()}
    assert got[0] == 10.0 and got[1] == pytest.approx((10 + 0.75 * 20) / 1.75)


def test_map_correspondences(spark):
    obs = "pid long, cid long, fid long"
    a = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 0, 2)], obs)
    b = spark.createDataFrame([(7, 0, 0), (7, 0, 1), (8, 0, 2)], obs)
    shared = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 0, 1), (0, 2, 0, 1)], "cid_a long, fid_a long, cid_b long, fid_b long")
    assert [tuple(r) for r in networks.map_correspondences(a, b, shared).collect()] == [(1, 7, 2)]


def test_names_that_raise(spark):
    with pytest.raises(Exception, match="two files are named"):
        networks.check_names(spark.createDataFrame([("a/x.tif",), ("b/x.xml",)], "p string"), "p").collect()
    names = spark.createDataFrame([("x", 0)], "name string, place long")
    with pytest.raises(Exception, match="unknown image"):
        joins.overlap_list(names, spark.createDataFrame([("x", "y")], "a string, b string")).collect()
    with pytest.raises(ValueError, match="different columns"):
        series.common_shift([spark.createDataFrame([(1.0, 2.0)], "x double, y double"), spark.createDataFrame([(1.0, 2.0)], "x double, z double")])


def test_greedy_subset(spark):
    seen = spark.createDataFrame([("a", c) for c in range(5)] + [("b", c) for c in range(3, 9)] + [("c", 0), ("c", 8)], "image string, cell long")
    assert [tuple(r) for r in networks.greedy_subset(seen, 1).collect()] == [("b", 6), ("a", 3)]


def test_greedy_subset_takes_a_rows_choice_in_all_regions_at_once(spark, monkeypatch):
    import random

    from terraloom.operators import storage

    r, seen = random.Random(5), []
    for region in range(12):
        seen += [(region * 10 + r.randrange(10), region * 40 + r.randrange(40)) for _ in range(150)]
    left, wanted = {i: {c for k, c in seen if k == i} for i, _ in seen}, []
    while True:
        image = min(left, key=lambda i: (-len(left[i]), i))
        if len(left[image]) < 3:
            break
        wanted.append((image, len(left[image])))
        taken = set(left[image])
        for cells in left.values():
            cells -= taken
    written, stored = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name: written.append(name) or stored(df, name))
    got = networks.greedy_subset(spark.createDataFrame([*seen, seen[0], (None, 1), (7, None)], "image long, cell long"), 3)
    assert [tuple(x) for x in got.collect()] == wanted
    assert len(wanted) > 30 and len(written) < len(wanted)  # not a round for each choice


def test_merged_poses(spark):
    poses = spark.createDataFrame([(0, "a", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), (1, "a", 2.0, 4.0, 6.0, -1.0, 0.0, 0.0, 0.0)], "map int, name string, x double, y double, z double, qw double, qx double, qy double, qz double")
    assert tuple(networks.merged_poses(poses).first()) == ("a", 1.0, 2.0, 3.0, 1.0, 0.0, 0.0, 0.0)


def test_transform_and_plane(spark):
    a = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    turned = [(-2 * y + 5, 2 * x - 1, 2 * z) for x, y, z in a]  # a quarter turn about z, twice the size, moved
    df = spark.createDataFrame([(*p, *q) for p, q in zip(a, turned, strict=True)], "ax double, ay double, az double, bx double, by double, bz double")
    r, t, s = reports.similarity_transform(df, ("ax", "ay", "az"), ("bx", "by", "bz"))
    assert s == pytest.approx(2) and list(t) == pytest.approx([5, -1, 0]) and r[0] == pytest.approx([0, -1, 0], abs=1e-9)
    flat = spark.createDataFrame([(float(x), float(y), 3.0) for x in range(4) for y in range(4)], "x double, y double, z double")
    normal, offset = reports.plane(flat)
    assert list(normal) == pytest.approx([0, 0, 1], abs=1e-9) and offset == pytest.approx(3)


def test_erf_step(spark):
    xs = [-1.0, 0.0, 1.0, 2.5, 4.0, 5.0, 9.0]
    got = [r["s"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(G.erf_step(F.col("x"), 5.0, 2.0).alias("s")).collect()]
    want = [0 if x <= 0 else 5 if x >= 5 else 2.5 * (1 + math.erf(0.5 * math.sqrt(math.pi) * (2 * x * 2 / 5 - 2))) for x in xs]
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("stamp", "wanted"), [("2003-01-01T00:00:00.5Z", "2003-01-01T00:00:00.500000Z"), ("2003-01-01T00:00:00.12345678", "2003-01-01T00:00:00.123456"), ("2003-01-01 00:00:00", "2003-01-01 00:00:00")])
def test_stamps(spark, stamp, wanted):
    assert spark.range(1).select(G.timestamp_text(F.lit(stamp)).alias("s")).first()["s"] == wanted


def test_network_text(spark):
    def of(*rows):
        return spark.createDataFrame(list(enumerate(rows)), "line long, value string")

    cameras, points, obs = N.parse_network(of("NVM_V3", "1", "a.tif 2 1 0 0 0 5 6 7 0 0", "1", "1 2 3 0 0 0 2 0 4 1.5 2.5 0 9 3.5 4.5"))
    assert tuple(cameras.first()) == (0, "a.tif", 2.0, 1.0, 0.0, 0.0, 0.0, 5.0, 6.0, 7.0) and tuple(points.first()) == (0, 1.0, 2.0, 3.0)
    assert sorted(tuple(r) for r in obs.collect()) == [(0, 0, 4, 1.5, 2.5), (0, 0, 9, 3.5, 4.5)]
    with pytest.raises(ValueError, match="not a network"):
        N.parse_network(of("other", "1"))
    with pytest.raises(Exception, match="too few measures"):
        N.parse_network(of("NVM_V3", "0", "1", "1 2 3 0 0 0 2 0 4 1 2"))[2].collect()
    with pytest.raises(Exception, match="fewer than two"):
        N.network_lines(cameras, points, obs.limit(1)).collect()


def test_polygons(spark):
    rows = [("f", i, v) for i, v in enumerate(["x y", "1 2", "3 4", "", "color = red", "anno 1 2 here", "5 6"])]
    got = N.parse_polygons(spark.createDataFrame(rows, "file string, line long, value string")).orderBy("line").collect()
    assert [(r["block"], r["x"], r["y"]) for r in got] == [(1, 1.0, 2.0), (1, 3.0, 4.0), (2, 5.0, 6.0)]


def test_nearest_in_time_prefers_the_earlier(spark):
    left = spark.sql("SELECT 'k' AS k, timestamp'2020-01-01 00:00:10' AS ts UNION ALL SELECT 'k', timestamp'2020-01-01 01:00:00'")
    right = spark.sql("SELECT 'k' AS k, timestamp'2020-01-01 00:00:05' AS ts, 1 AS v UNION ALL SELECT 'k', timestamp'2020-01-01 00:00:15', 2")
    got = [r["o"] for r in joins.nearest_in_time(left, right, ["k"], "ts", "v", "o", 900.0).orderBy("ts").collect()]
    assert got == [1, None]
