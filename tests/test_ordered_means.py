"""Means at a cutoff, whose rounding depends on the order of the sum."""

import itertools

import duckdb

from terraloom.functions import statistics as S
from terraloom.plans import registry


def in_order(values):
    total = 0.0
    for v in values:
        total += v
    return total / len(values)


def test_outliers_add_up_in_the_order_of_the_files(spark, tmp_path):
    # five lines of mean 6, one in the first file and four in the second: partial sums of the files round otherwise
    fives = [[k / 100 * 100 for k in c] for c in itertools.product((0, 1, 2, 6, 7, 8, 9), repeat=5) if sum(c) == 30]
    differ = [v for v in fives if (in_order(v) > 6) != ((v[0] + (v[1] + v[2] + v[3] + v[4])) / 5 > 6)]
    assert len(differ) > 10
    (tmp_path / "lineitem.parquet").mkdir()
    for part, places in enumerate(((0,), (1, 2, 3, 4))):
        rows = [(p, 1, v[i] / 100, 0.0) for i in places for p, v in enumerate(differ)] + [(1000 + i, 1, i % 7 / 100, 0.0) for i in range(500)] + [(2000 + part, 1, 0.1, 0.0)]
        made = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_discount double, l_tax double").toPandas()
        made.to_parquet(tmp_path / f"lineitem.parquet/part-{part}.parquet")
    got = {tuple(r) for r in registry.queries()["adjustment_outliers"](spark, str(tmp_path)).collect()}
    assert {p for p, _ in got} == {p for p, v in enumerate(differ) if in_order(v) > 6}
    db = duckdb.connect(config={"threads": 1})
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet(['{tmp_path}/lineitem.parquet/part-0.parquet', '{tmp_path}/lineitem.parquet/part-1.parquet'])")
    assert got == set(db.execute(registry.oracle_sql()["adjustment_outliers"]).fetchall())


def test_ordered_means_leave_out_nulls(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 1, None), ("a", 3, 4.0), (None, 1, 5.0), ("b", 1, None)], "k string, i int, v double")
    got = {(r["k"], r["mean"], r["n"]) for r in S.ordered_means(df, "v", ["k"], ["i"]).collect()}
    assert got == {("a", 2.5, 3), (None, 5.0, 1), ("b", None, 1)}
