"""Every query with an SQL twin against DuckDB."""

import math
import os

import duckdb
import numpy as np
import pytest

from terraloom.operators import tracks
from terraloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9) or math.isnan(a) and math.isnan(b))
    return a == b


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf_dir, db, name):
    df = registry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cursor = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    wanted = [tuple(r[i] for i in at) for r in cursor.fetchall()]
    key = lambda r: tuple((x is None, f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)) for x in r)
    got.sort(key=key)
    wanted.sort(key=key)
    assert len(got) == len(wanted)
    assert all(same(x, y) for g, w in zip(got, wanted, strict=True) for x, y in zip(g, w, strict=True))


def test_tracks_without_conflicts(spark):
    # node = 10 * image + feature: a chain of 4, a cycle, a track that hits image 2 twice, a pair, a match of one feature with another of its image
    chain, cycle, twice, pair, same_image = [(10, 20), (20, 30), (30, 40)], [(11, 21), (21, 31), (31, 11)], [(12, 22), (12, 23)], [(13, 24)], [(14, 15)]
    links = spark.createDataFrame(chain + cycle + twice + pair + same_image, "a long, b long")
    found = tracks.tracks(links).selectExpr("node", "node div 10 AS image", "track")
    got = {(r["track"], r["node"]) for r in tracks.without_conflicts(found).collect()}
    assert got == {(10, 10), (10, 20), (10, 30), (10, 40), (11, 11), (11, 21), (11, 31), (13, 13), (13, 24)}
    assert {r["track"] for r in tracks.without_conflicts(found, 3).collect()} == {10, 11}


def test_tracks_of_chains_and_cycles(spark):
    rng = np.random.default_rng(3)
    names = rng.permutation(400).tolist()
    links = list(zip(names[:150], names[1:150])) + list(zip(names[150:300], [*names[151:300], names[150]]))  # a chain of 150, a cycle of 150
    links += [(b, a) for a, b in links[::3]] + [(names[300], names[300])] + [(names[301], n) for n in names[302:340]]
    got = {r["node"]: r["track"] for r in tracks.tracks(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    groups = [names[:150], names[150:300], names[301:340]]
    assert got == {n: min(g) for g in groups for n in g}
    assert tracks.tracks(spark.createDataFrame([], "a long, b long")).count() == 0
