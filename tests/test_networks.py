"""Pairs of cameras counted in bounded parts, and networks completed without a row for each node."""

import random

import pytest
from pyspark.sql import functions as F

from terraloom.operators import networks, storage


def test_track_pairs_in_parts(spark, monkeypatch):
    obs = spark.createDataFrame([(p, c) for p in range(40) for c in range(p % 5)] + [(1, 0), (None, 1), (2, None)], "pid int, cid int")
    want = {(a, b): sum(p % 5 > b for p in range(40)) for a in range(5) for b in range(a + 1, 5) if any(p % 5 > b for p in range(40))}
    for size in (2_000_000, 3):
        monkeypatch.setattr(networks, "PART_PAIRS", size)
        found = networks.track_pairs(obs)
        assert {(r["c1"], r["c2"]): r["matches"] for r in found.collect()} == want
    assert found.rdd.getNumPartitions() > 4  # parts follow the pairs


def test_an_observation_is_met_once(spark):
    obs = spark.createDataFrame([(1, 0, 0.5, 0.5), (1, 0, 0.5, 0.5), (2, 0, 1.0, 0.0), (3, 0, 1.5, 0.5), (4, 0, None, 0.0)], "pid long, cid long, x double, y double")
    moves = spark.createDataFrame([(0, 0, 0, 4.0, 1.0), (0, 1, 0, 8.0, 1.0), (0, 0, 1, 4.0, 1.0), (0, 1, 1, 8.0, 3.0), (0, 2, 0, None, 1.0)], "cid long, col long, row long, dx double, dy double")
    same = F.array(*(F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0)))
    out = networks.complete_network(obs, moves, spark.range(1).select(F.col("id").alias("cid"), same.alias("l"), same.alias("r")), 3)
    assert sorted(map(tuple, out.filter("cid = 3").collect())) == [(1, 3, 6.5, 2.0), (1, 3, 6.5, 2.0), (2, 3, 9.0, 1.0)]
    left = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "explode" not in left and "Aggregate" not in left


def greedy(seen, least):
    left, wanted = {}, []
    for image, cell in seen:
        left.setdefault(image, set()).add(cell)
    while left:
        image = min(left, key=lambda i: (-len(left[i]), i))
        if len(left[image]) < least:
            break
        wanted.append((image, len(left[image])))
        taken = set(left[image])
        for cells in left.values():
            cells -= taken
    return wanted


@pytest.mark.parametrize("pool, rounds", [(4_000_000, 1), (1000, 12)])
def test_images_that_all_meet_are_chosen_in_few_rounds(spark, monkeypatch, pool, rounds):
    r = random.Random(3)
    seen = [(i, r.randrange(500)) for i in range(60) for _ in range(r.randrange(5, 70))]
    chosen, names = greedy(seen, 2), []
    assert len(chosen) == 30
    monkeypatch.setattr(networks, "POOL", pool, raising=False)
    stored = storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name: names.append(name) or stored(df, name))
    got = networks.greedy_subset(spark.createDataFrame(seen, "image long, cell long"), 2)
    assert [tuple(x) for x in got.collect()] == chosen
    assert names.count("subset-gains") <= rounds


def test_regions_are_chosen_from_apart(spark, monkeypatch):
    r = random.Random(4)
    # 30 regions of images named by text, a chain of images that meet the next only, and a region beyond the pool
    seen = [(f"r{g}-{r.randrange(8)}", f"{g}:{r.randrange(30)}") for g in range(30) for _ in range(60)]
    seen += [(f"chain{i:02}", f"c{i + j}") for i in range(20) for j in (0, 1)]
    seen += [(f"large{i}", f"l{r.randrange(150)}") for i in range(12) for _ in range(40)]
    monkeypatch.setattr(networks, "POOL", 200, raising=False)
    monkeypatch.setattr(networks, "PART", 300, raising=False)
    rows, names, stored = spark.createDataFrame(seen, "image string, cell string"), [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name: names.append(name) or stored(df, name))
    assert [tuple(x) for x in networks.greedy_subset(rows, 1).collect()] == greedy(seen, 1)
    assert names.count("subset-parts") == 1 and names.count("subset-gains") < 15
    # an image larger than the pool is chosen without its rows
    monkeypatch.setattr(networks, "POOL", 30)
    assert [tuple(x) for x in networks.greedy_subset(rows.filter("image LIKE 'large%'"), 1).collect()] == greedy([x for x in seen if x[0].startswith("large")], 1)
    assert networks.greedy_subset(rows.limit(0), 1).isEmpty()
