import pytest
from pyspark.sql import functions as F

from terraloom.functions import statistics as S
from terraloom.functions.expressions import calculate, polynomial, postfix
from terraloom.operators import joins, neighbourhood, tracks


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).cast("double").alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_right_grouping_and_missing_values(spark):
    v = {"var_0": F.col("a"), "var_1": F.col("b")}
    assert one(spark, calculate("var_0 - var_1 - 1", v), a=10, b=4) == 7
    assert one(spark, calculate("max(var_0, var_1)", v), a=10, b=None) is None
    assert one(spark, calculate("lt(var_0, var_1, 1, 2)", v), a=1, b=1) == 2
    assert one(spark, calculate("-(var_0 + 2) * 3", v), a=1, b=0) == -9
    assert one(spark, calculate("var_0 / var_1", v), a=1, b=0) == float("inf")
    assert one(spark, calculate("var_0 / var_1", v), a=-1, b=0) == float("-inf")
    assert one(spark, calculate("var_0 / var_1", v), a=0, b=0) != one(spark, calculate("var_0 / var_1", v), a=0, b=0)
    assert 0 <= one(spark, calculate("rand() + 0 * var_0", v), a=0, b=0) < 1


@pytest.mark.parametrize("text", ["1 +", "foo(1)", "(1", "1 $ 2", "pow(1, 2"])
def test_bad_expressions(spark, text):
    with pytest.raises(ValueError):
        calculate(text, {})


def test_ephemeris_formulas(spark):
    t = F.col("t")
    assert one(spark, postfix("3 t t * * 1 +", t), t=-1.5) == 7.75
    assert one(spark, postfix("t sin 4 * t +", t), t=-1.5) == pytest.approx(-5.48997994641622)
    assert one(spark, postfix("t t 2 * * 5 t / - abs", t), t=-1.5) == pytest.approx(7.8333333333)
    assert one(spark, polynomial([], t), t=2) == 0
    assert one(spark, polynomial([1, 2, 3], t), t=2) == 17
    with pytest.raises(ValueError):
        postfix("t t", t)


def test_order_statistics(spark):
    for n in (1, 2, 3, 4, 5):
        df = spark.createDataFrame([(float(i),) for i in range(n)], "v double")
        row = df.agg(S.upper_median(F.col("v")).alias("u"), S.middle_median(F.col("v")).alias("m"), S.floor_percentile(F.col("v"), 0.5).alias("f"), S.rounded_percentile(F.col("v"), 0.5).alias("r")).first()
        assert row["u"] == n // 2 and row["m"] == (n - 1) / 2 and row["f"] == int(0.5 * n) and row["r"] == int(0.5 * (n - 1) + 0.5)
    empty = spark.createDataFrame([], "v double").agg(S.upper_median(F.col("v")).alias("u")).first()
    assert empty["u"] is None


def test_bilinear_nodes_and_holes(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 0, None), (0, 1, 3.0), (1, 1, 5.0)], "col long, row long, v double")
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.0), (3, 0.0, 0.5), (4, 0.5, 1.0), (5, 9.0, 9.0)], "id int, px double, py double")
    got = {r["id"]: r["value"] for r in joins.bilinear(pts, cells).collect()}
    assert got == {1: 1.0, 2: None, 3: 2.0, 4: 4.0, 5: None}


def test_as_of_ties_and_ends(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9)], "key string, ts int")
    right = spark.createDataFrame([("k", 5, 7), ("k", 5, 8), ("k", 6, 1)], "key string, ts int, v int")
    back = {r["ts"]: r["o"] for r in joins.as_of(left, right, ["key"], "ts", "v", "o").collect()}
    ahead = {r["ts"]: r["o"] for r in joins.as_of(left, right, ["key"], "ts", "v", "o", forward=True).collect()}
    assert back == {1: None, 5: 8, 9: 1} and ahead == {1: 8, 5: 8, 9: None}


def test_erosion_keeps_the_edge_of_the_raster(spark):
    cells = spark.createDataFrame([(c, r, None if (c, r) == (4, 4) else 1.0) for c in range(5) for r in range(5)], "col long, row long, v double")
    assert neighbourhood.erode(cells, 1).count() == 21


def test_tracks(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (20, 21), (5, 5)], "a long, b long")
    got = {r["node"]: r["track"] for r in tracks.tracks(chain).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20}
    assert tracks.tracks(spark.createDataFrame([], "a long, b long")).count() == 0


def test_segment_borders_are_not_listed(spark, tmp_path):
    from terraloom.plans.matches import segment_borders

    lengths = [1, 64, 65, 129, 1000, 3 * 10**11 + 7]
    spark.createDataFrame(list(enumerate(lengths)), "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["o_orderkey"]: (r["pieces"], r["middle"], r["last"]) for r in segment_borders(spark, str(tmp_path)).collect()}
    for i, n in enumerate(lengths):
        pieces = -(-n // 64)
        small, big = divmod(n, pieces)
        assert got[i] == (pieces, pieces // 2 * small + min(pieces // 2, big), n)
