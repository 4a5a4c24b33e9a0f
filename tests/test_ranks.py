"""Picks of sorted values by group: groups sorted whole, ranked in ranges, and both; and steps that are done once a row."""

import random

from pyspark.sql import functions as F

from terraloom.functions import statistics as S
from terraloom.sources import text


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_picks_of_small_and_large_groups(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(None if k == 9 else k, rng.choice([None, float("nan"), rng.uniform(-5, 5), 1.5])) for k in range(10) for _ in range(200 if k == 3 else 1 + k)]
    df = spark.createDataFrame(rows, "k int, v double")
    want = {}
    for k in {k for k, _ in rows}:
        s = sorted((v for key, v in rows if key == k and v is not None), key=lambda v: (v != v, v))
        if s:
            want[k] = (str(s[len(s) // 2]), str(s[min(len(s) // 4, len(s) - 1)]), len(s))
    for most, large in ((100_000, 1000), (100, 1000), (0, 1000), (0, 0)):  # all whole, one in ranges, all in ranges, too many to tell apart
        monkeypatch.setattr(S, "WHOLE_ROWS", most)
        monkeypatch.setattr(S, "MOST_LARGE", large)
        found = S.picks(df, "v", {"m": S.upper_middle(), "q": S.floor_place(0.25)}, ["k"], "num")
        assert {r["k"]: (str(r["m"]), str(r["q"]), r["num"]) for r in found.collect()} == want
    monkeypatch.undo()
    assert "Window" not in _plan(S.medians(df, "v", ["k"]))  # small groups are not ranked one by one


def test_range_of_a_value(spark):
    for parts in (2, 3, 64, 65, 128):
        cuts = sorted(random.Random(parts).choices(range(50), k=parts - 1))
        df = spark.range(-1, 52).select(F.col("id").cast("double").alias("v")).withColumn("cuts", F.lit(cuts).cast("array<double>"))
        assert all(r["at"] == sum(c < r["v"] for c in cuts) for r in df.select("v", S._range_of(F.col("cuts"), F.col("v"), parts).alias("at")).collect())


def test_a_line_is_split_once(spark):
    lines = spark.createDataFrame([("f, 1, 2, 3",), ("f 1 nan 3",), ("f,1,inf,3",), ("f,1,x,3",), ("# f,1,2,3",), (None,), ("f,1",), (" f\t4, 5,6 ",)], "value string").repartition(2)
    out = text.parse_points(lines, "1:file 2:x 3:y 4:z")
    assert sorted(map(tuple, out.collect())) == [(1.0, 2.0, 3.0, "f"), (4.0, 5.0, 6.0, "f")]
    assert _plan(out).count("split(") == 1
