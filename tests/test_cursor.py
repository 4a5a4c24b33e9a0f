"""The forward-only cursor against its batch form, over files that come one after the other, with a restart and with disorder."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraloom.operators.storage import shared_path
from terraloom.streaming import cursor, frames

SCHEMA = "key string, ts timestamp, t long, asked boolean, id long, v double, w double"


def chunks():
    rng = np.random.default_rng(5)
    n = 400
    t = np.sort(rng.integers(0, 900, n))  # with equal times
    rows = pd.DataFrame({"key": rng.choice(["a", "b", None], n), "t": t, "asked": rng.random(n) < 0.4, "id": np.arange(n), "v": rng.normal(size=n), "w": rng.normal(size=n)})
    rows["ts"] = pd.to_datetime(rows["t"], unit="s")
    cuts = [0, *(int(np.searchsorted(t, x)) for x in (250, 251, 600)), n]  # a time is whole in one file
    return [rows.iloc[a:b].sample(frac=1, random_state=1) for a, b in zip(cuts, cuts[1:])]


def put(folder, name, rows, age):
    path = os.path.join(folder, name)
    rows.astype({"ts": "datetime64[us]"}).to_parquet(path, index=False)
    os.utime(path, (1_600_000_000 + age, 1_600_000_000 + age))


def stream(spark, folder):
    return cursor.between(frames.frame_stream(spark, str(folder), "*.parquet", 1).select("key", "t", "asked", "id", "v", "w"), "key", ["v", "w"])


def rows_of(df):
    return sorted((tuple("NULL" if x is None or x != x else x for x in r) for r in df.collect()), key=str)


def test_cursor_over_files_and_a_restart(spark, tmp_path):
    parts = chunks()
    for i, rows in enumerate(parts[:3]):
        put(tmp_path, f"p{i}.parquet", rows, i)
    at = shared_path(spark, "cursor-test")
    columns = ["key", "id", "t", "before", "before_t", "after", "after_t", "before_v", "before_w", "after_v", "after_w"]
    batch = lambda n: cursor.between_batch(spark.createDataFrame(pd.concat(parts[:n])[["key", "t", "asked", "id", "v", "w"]].replace({np.nan: None}), "key string, t long, asked boolean, id long, v double, w double"), "key", ["v", "w"]).select(columns)
    first = rows_of(cursor.run_forward(stream(spark, tmp_path), "cursor", at).select(columns))
    assert first == rows_of(batch(3)) and len(first) > 50
    put(tmp_path, "p3.parquet", parts[3], 3)
    second = rows_of(cursor.run_forward(stream(spark, tmp_path), "cursor", at).select(columns))
    assert second == rows_of(batch(4)) and len(second) > len(first)
    found = {(r["key"], r["id"]): r for r in cursor.interpolated(batch(4), ["v"]).collect()}
    for key, i, t, before, bt, after, at_, bv, _, av, _ in second:
        if before != "NULL":
            want = bv if bt == at_ else np.interp(t, [bt, at_], [bv, av])
            assert np.isclose(found[None if key == "NULL" else key, i]["v"], want)
        else:
            assert (None if key == "NULL" else key, i) not in found


def test_many_keys_in_few_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cursor, "GROUPS", 3)
    rng = np.random.default_rng(7)
    n = 2000
    rows = pd.DataFrame({"key": [f"k{i}" for i in rng.integers(0, 120, n)], "t": np.sort(rng.integers(0, 300, n)), "asked": rng.random(n) < 0.4, "id": np.arange(n), "v": rng.normal(size=n), "w": rng.normal(size=n)})
    rows["ts"] = pd.to_datetime(rows["t"], unit="s")
    cuts = [0, *(int(np.searchsorted(rows["t"], x)) for x in (90, 91, 200)), n]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        put(tmp_path, f"p{i}.parquet", rows.iloc[a:b].sample(frac=1, random_state=2), i)
    columns = ["key", "id", "t", "before", "before_t", "after", "after_t", "before_v", "before_w", "after_v", "after_w"]
    at = shared_path(spark, "cursor-groups")
    got = rows_of(cursor.run_forward(stream(spark, tmp_path), "cursor", at).select(columns))
    wanted = cursor.between_batch(spark.createDataFrame(rows[["key", "t", "asked", "id", "v", "w"]]), "key", ["v", "w"]).select(columns)
    assert got == rows_of(wanted) and len(got) > 400
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{at}/state")
    assert state.count() == 120 and state.select("key").distinct().count() == 3  # one list of last samples for a group


def test_time_that_goes_back(spark, tmp_path):
    parts = chunks()
    put(tmp_path, "p0.parquet", parts[2], 0)
    put(tmp_path, "p1.parquet", parts[0], 1)
    with pytest.raises(Exception, match="time goes back"):
        cursor.run_forward(stream(spark, tmp_path), "cursor").collect()
    assert spark.conf.get(cursor.PROVIDER, None) != cursor.ROCKS


def test_plain_rule(spark):
    rows = [("k", 5, True, 1, 0.0), ("k", 7, False, 10, 1.0), ("k", 7, False, 12, 2.0), ("k", 7, True, 2, 0.0), ("k", 8, True, 3, 0.0), ("k", 9, False, 9, 3.0), ("k", 11, True, 4, 0.0), ("k", None, True, 5, 0.0)]
    df = spark.createDataFrame(rows, "key string, t long, asked boolean, id long, v double")
    got = {r["id"]: (r["before"], r["after"]) for r in cursor.between_batch(df, "key", ["v"]).collect()}
    assert got == {1: (None, 12), 2: (12, 12), 3: (12, 9)}
    assert cursor.between_batch(df.filter(F.lit(False)), "key", ["v"]).count() == 0
