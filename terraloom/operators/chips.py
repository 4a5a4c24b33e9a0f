"""Points cut into chips of few near points, tile by tile, and the choice that a sequential pass makes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.operators.storage import stored

#: Points that one task halves; larger parts of a tile are quartered first, by counts.
TASK_POINTS = 50_000
#: Quarterings after which points still together are dealt by the hash of their id; how many are counted at once.
MOST_QUARTERINGS, AT_ONCE = 40, 5


def _halves(x: np.ndarray, y: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, list[str]]:
    """Each point's chip, as a number, and the chips' paths of halvings along the longer side, ties by the other coordinate and the id.

    Both orders are made once; a half keeps them.
    """
    chip, names, in_half = np.zeros(len(x), np.int64), [], np.zeros(len(x), bool)
    open_ = [(np.lexsort((ids, y, x)), np.lexsort((ids, x, y)), "")]
    while open_:
        by_x, by_y, name = open_.pop()
        if len(by_x) <= most:
            chip[by_x] = len(names)
            names.append(name)
            continue
        wide = x[by_x[-1]] - x[by_x[0]] >= y[by_y[-1]] - y[by_y[0]]
        along, across = (by_x, by_y) if wide else (by_y, by_x)
        half = len(along) // 2
        in_half[along[:half]] = True
        first = in_half[across]
        in_half[along[:half]] = False
        for part, other, digit in ((along[:half], across[first], "0"), (along[half:], across[~first], "1")):
            open_.append((part, other, name + digit) if wide else (other, part, name + digit))
    return chip, names


def _parts(counts: DataFrame, levels: int) -> DataFrame:
    """counts(tile_x, tile_y, part, cx, cy, n) by cells -> the same with _at: the level of the largest square of the cell with TASK_POINTS points at most, null if none has."""
    found = F.lit(None).cast("int")
    for level in range(levels, 0, -1):
        square = Window.partitionBy("tile_x", "tile_y", "part", F.shiftright("cx", levels - level), F.shiftright("cy", levels - level))
        found = F.when(F.sum("n").over(square) <= TASK_POINTS, F.lit(level)).otherwise(found)
    return counts.withColumn("_at", found)


def chips(points: DataFrame, tile: float, most: int = 128) -> DataFrame:
    """points(id long, x, y, ...) with tile_x, tile_y and chip: within a tile, chips are disjoint, compact and of `most` points at most.

    Parts of a tile with more than TASK_POINTS points are quartered by their middle, on counts alone, so no task holds a
    whole tile: AT_ONCE quarterings are decided at once by the counts of their smallest squares, and only points of squares
    that are still too full go on. Then each part is halved along its longer side until chips are small enough. Points at one
    place are split by id. Points without coordinates are left out.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    named = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumns({"_row": F.monotonically_increasing_id(), "tile_x": F.floor(F.col("x") / tile), "tile_y": F.floor(F.col("y") / tile)})
    named = stored(named, "chips-points")
    key, done, depth = ["tile_x", "tile_y"], [], 0
    large = stored(named.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > TASK_POINTS).select(*key, F.lit("").alias("part")), "chips-large")
    done.append(named.join(large, key, "left_anti").withColumn("part", F.lit("")))
    open_ = None if large.isEmpty() else named.join(large, key)
    while open_ is not None and depth < MOST_QUARTERINGS:
        levels = min(AT_ONCE, MOST_QUARTERINGS - depth)
        depth += levels

        def place(c: Column, at: str) -> Column:
            """The place of a coordinate among the smallest squares of its part."""
            whole = F.floor((c / tile - F.col(at)) * 2.0**depth).cast("long")  # noqa: B023
            return F.pmod(F.least(F.greatest(whole, F.lit(0).cast("long")), F.lit(2**depth - 1).cast("long")), F.lit(2**levels).cast("long"))  # noqa: B023

        open_ = open_.withColumns({"cx": place(x, "tile_x"), "cy": place(y, "tile_y")})
        cells = stored(_parts(open_.groupBy(*key, "part", "cx", "cy").agg(F.count("*").alias("n")), levels), "chips-cells")
        digits = [(F.shiftright("cx", levels - i) % 2 + 2 * (F.shiftright("cy", levels - i) % 2)).cast("string") for i in range(1, levels + 1)]
        path = F.concat("part", *(F.when(F.coalesce(F.col("_at"), F.lit(levels)) >= i, d).otherwise("") for i, d in enumerate(digits, 1)))
        cells = cells.select(*key, "part", "cx", "cy", "_at", path.alias("_path"))
        put = open_.join(cells, [*key, "part", "cx", "cy"])
        done.append(put.filter("_at IS NOT NULL").select(*named.columns, F.col("_path").alias("part")))
        crowded = cells.filter("_at IS NULL")
        open_ = None if crowded.isEmpty() else stored(put.filter("_at IS NULL").select(*named.columns, F.col("_path").alias("part")), "chips")
    if open_ is not None:
        full = open_.groupBy(*key, "part").agg(F.count("*").alias("_n"))
        dealt = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("long"), F.lit(-1)), "_row"), F.ceil(2 * F.col("_n") / TASK_POINTS)).cast("string")
        done.append(open_.join(full, [*key, "part"]).select(*named.columns, F.concat("part", F.lit("/"), dealt).alias("part")))
    columns = [c for c in named.columns if c != "_row"]
    parts = reduce(DataFrame.unionByName, done).withColumns({"_x": x, "_y": y, "_id": F.coalesce(F.col("id").cast("long"), F.lit(-1))})

    def halve(part: pa.Table) -> pa.Table:
        part = part.sort_by("_row")
        chip, names = _halves(*(part[c].to_numpy() for c in ("_x", "_y", "_id")), most)
        start = part["part"][0].as_py()
        return part.select(columns).append_column("chip", pa.array([f"{start}.{n}" for n in names]).take(pa.array(chip)))

    return parts.groupBy(*key, "part").applyInArrow(halve, T.StructType([*(named.schema[c] for c in columns), T.StructField("chip", T.StringType())]))


def first_come(rows: DataFrame, left: list[str], right: list[str], order: list[str]) -> DataFrame:
    """The rows that a pass in this order takes, when a row is taken unless its left or its right key is taken already.

    Rounds: a row that comes first of all open rows of both its keys is taken, and all others of these keys are out; what is
    left is decided in the next round. Each round decides at least the first open row. order must tell rows apart.
    """
    open_, taken = stored(rows, "first-come"), []
    place = F.struct(*order)
    while not open_.isEmpty():
        firsts = [open_.groupBy(*keys).agg(F.min(place).alias("_first")) for keys in (left, right)]
        now = open_.withColumn("_own", place)
        for keys, first in zip((left, right), firsts, strict=True):
            now = now.join(first, keys).filter(F.col("_own") == F.col("_first")).drop("_first")
        now = stored(now.select(*rows.columns), "first-come-taken")
        taken.append(now)
        open_ = stored(open_.join(now.select(*left), left, "left_anti").join(now.select(*right), right, "left_anti"), "first-come")
    return reduce(DataFrame.unionByName, taken) if taken else rows.limit(0)
