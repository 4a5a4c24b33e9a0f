"""Joins that plain equality can't express, without theta joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str, out: str, forward: bool = False) -> DataFrame:
    """left with the right value of the last time up to its own (or, forward, the first from it on); null if none.

    Union and a running window: one shuffle by key, no pairs. Of equal right times the largest value counts.
    """
    r = right.groupBy(*keys, ts).agg(F.max(value).alias("_v"))
    both = left.withColumns({"_v": F.lit(None).cast(r.schema["_v"].dataType), "_q": F.lit(1)}).unionByName(r.withColumn("_q", F.lit(0)), allowMissingColumns=True)
    order = [F.col(ts).desc() if forward else F.col(ts), F.col("_q")]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(out, F.last("_v", ignorenulls=True).over(w))
    return found.filter("_q = 1").drop("_v", "_q")


def band_pairs(items: DataFrame, key: str, limit: int) -> DataFrame:
    """Pairs i < j <= i + limit of a whole-number key, by listing the partners of each."""
    left = items.select(F.col(key).alias("i"), F.explode(F.sequence(F.col(key) + 1, F.col(key) + limit)).alias("j"))
    return left.join(items.select(F.col(key).alias("j")), "j").select("i", "j")


#: Boxes of a block of a cell, on average.
BLOCK_ROWS = 1024
#: Waiting boxes that are compared with the next STEP boxes at once.
WAITING, STEP = 4096, 256


def _in_cells(boxes: DataFrame, size: float) -> DataFrame:
    """boxes(id, x0, y0, x1, y1) once for each cell cx, cy that they touch."""
    def cells(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))

    return boxes.withColumn("cx", F.explode(cells("x0", "x1"))).withColumn("cy", F.explode(cells("y0", "y1")))


def _meet(size: float) -> Column:
    """Whether boxes a and b overlap (closed), and the corner of their intersection is in a's cell."""
    hit = (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1")) & (F.col("a.y0") <= F.col("b.y1")) & (F.col("b.y0") <= F.col("a.y1"))
    return hit & (F.floor(F.greatest("a.x0", "b.x0") / size) == F.col("a.cx")) & (F.floor(F.greatest("a.y0", "b.y0") / size) == F.col("a.cy"))


def box_overlaps(boxes: DataFrame, size: float) -> DataFrame:
    """Pairs a < b of boxes(id, x0, y0, x1, y1) that overlap (closed), through cells of a given size.

    A pair is reported in the cell that holds the corner of its intersection only, so nothing is de-duplicated. A cell's
    boxes are cut into blocks, and each pair of blocks is a group of rows: so a crowded cell spreads over tasks, and each
    pair of boxes is compared once.
    """
    put = _in_cells(boxes, size)
    parts = put.groupBy("cx", "cy").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    put = put.join(parts, ["cx", "cy"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    columns = ("id", "x0", "y0", "x1", "y1", "cx", "cy")
    a = put.select(*columns, F.col("own").alias("i"), F.explode(F.sequence("own", F.col("parts") - 1)).alias("j")).alias("a")
    b = put.select(*columns, F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j")).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("cx", "cy", "i", "j")]
    # blocks of one pair hold different ids unless they are the same
    once = (F.col("a.id") < F.col("b.id")) | ((F.col("a.i") < F.col("a.j")) & (F.col("a.id") > F.col("b.id")))
    joined = a.hint("merge").join(b, same[0] & same[1] & same[2] & same[3] & once & _meet(size))
    return joined.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))


def _first_partners(boxes: DataFrame, size: float, most: int) -> DataFrame:
    """Pairs a < b that overlap in a cell of which b is one of the first `most` of a there: all of a's first ones are among them.

    Boxes go through a cell in the order of their ids; those that still lack partners wait, so crowded cells cost little
    more than their rows, and a task holds the waiting boxes of one cell.
    """
    put = _in_cells(boxes.select("id", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).dropna(), size)
    put = put.select("cx", "cy", "id", "x0", "y0", "x1", "y1").repartition("cx", "cy").sortWithinPartitions("cx", "cy", "id")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, box, lacks = None, None, None, None
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own, places = batch.column(2), np.stack([batch.column(c).to_numpy() for c in range(3, 7)])
            edges = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])).tolist() if len(x) else []
            out = []
            for start, stop in zip(edges, [*edges[1:], len(x)], strict=True):
                if (x[start], y[start]) != cell:
                    cell, ids, box, lacks = (x[start], y[start]), np.zeros(0, own.to_numpy(zero_copy_only=False).dtype), np.zeros((4, 0)), np.zeros(0, np.int64)
                for at in range(start, stop, STEP):
                    new = slice(at, min(at + STEP, stop))
                    there, fresh = places[:, new], own.slice(new.start, new.stop - new.start).to_numpy(zero_copy_only=False)
                    ids, box, lacks = np.concatenate([ids, fresh]), np.concatenate([box, there], axis=1), np.concatenate([lacks, np.full(len(fresh), most)])
                    q = there[:, None, :]
                    for w in range(0, len(ids), WAITING):
                        p, named = box[:, w : w + WAITING, None], ids[w : w + WAITING]
                        met = (p[0] <= q[2]) & (q[0] <= p[2]) & (p[1] <= q[3]) & (q[1] <= p[3]) & (fresh[None, :] > named[:, None])
                        met &= (np.floor(np.maximum(p[0], q[0]) / size) == cell[0]) & (np.floor(np.maximum(p[1], q[1]) / size) == cell[1])
                        met &= np.cumsum(met, axis=1) <= lacks[w : w + WAITING, None]
                        i, j = np.nonzero(met)
                        out.append((named[i], fresh[j]))
                        lacks[w : w + WAITING] -= met.sum(axis=1)
                    wait = lacks > 0
                    ids, box, lacks = ids[wait], box[:, wait], lacks[wait]
            if out:
                kind = batch.schema.field(2).type
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), kind) for k in (0, 1)], names=["a", "b"])

    kind = boxes.schema["id"].dataType
    return put.mapInArrow(look, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def limited_overlaps(boxes: DataFrame, size: float, most: int, wrap: bool = False) -> DataFrame:
    """Pairs a < b of boxes that overlap, as a pass over the boxes in the order of their ids (from 0, gapless) picks them.

    Each box takes the next ones that overlap it, at most `most` pairs a box. With wrap the pass goes on, after the last, with the
    first `most` boxes; pairs that are there already aren't counted again. Only a box's first partners of each cell are ever
    made, and ranked together; with wrap also the pairs of the first `most` boxes.
    """
    nth = F.row_number()
    forward = _first_partners(boxes, size, most).withColumn("_n", nth.over(Window.partitionBy("a").orderBy("b"))).filter(F.col("_n") <= most).drop("_n")
    if not wrap:
        return forward
    taken = forward.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("_taken"))
    few, put = F.broadcast(_in_cells(boxes.filter(F.col("id") < most), size)).alias("a"), _in_cells(boxes, size).alias("b")
    pairs = put.join(few, (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.id") < F.col("b.id")) & _meet(size)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    again = pairs.join(forward.filter(F.col("a") < most), ["a", "b"], "left_anti").join(taken, "b", "left")
    again = again.withColumn("_n", nth.over(Window.partitionBy("b").orderBy("a"))).filter(F.col("_n") <= most - F.coalesce("_taken", F.lit(0)))
    return forward.unionByName(again.select("a", "b"))


def near_pairs(items: DataFrame, limit: int, wrap: bool = False, reach: float | None = None) -> DataFrame:
    """Pairs i < j of items(i, x, y, z), i from 0 without gaps, at most `limit` apart in order, with wrap also around the end.

    With reach, pairs whose positions are both known (no null coordinate) and farther apart are left out.
    """
    ahead = items.select("i", F.explode(F.sequence(F.col("i") + 1, F.col("i") + limit)).alias("j"))
    if wrap:
        last = items.agg((F.max("i") + 1).alias("_size"))  # one row
        ahead = ahead.crossJoin(F.broadcast(last)).select("i", F.pmod("j", "_size").alias("j")).filter("i <> j")
    ahead = ahead.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    at = lambda name, end: items.select(F.col("i").alias(name), F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull(), F.array("x", "y", "z")).alias(end))
    out = ahead.join(at("i", "_p"), "i").join(at("j", "_q"), "j")
    if reach is not None:
        apart = F.sqrt(F.aggregate(F.zip_with("_p", "_q", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d))
        out = out.filter(F.coalesce(apart <= reach, F.lit(True)))
    return out.select("i", "j")


def bilinear(points: DataFrame, cells: DataFrame, codes: bool = False) -> DataFrame:
    """points(px, py, ...) with the raster's value between its four nodes.

    A node with weight counts only if it is there: on a node its own value is enough, between nodes all must be valid.
    With codes, a point outside the raster's frame (cells of null value are inside) has `value` null and `code` 0, one
    next to a hole null and -1, others 1. One join and one aggregation: each point asks for its four nodes.
    """
    c, r = F.floor("px"), F.floor("py")
    fx, fy = F.col("px") - c, F.col("py") - r
    nodes = F.array(*(F.struct((c + dx).alias("col"), (r + dy).alias("row"), ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("w")) for dx in (0, 1) for dy in (0, 1)))
    asked = points.withColumn("_id", F.monotonically_increasing_id()).withColumn("_n", F.explode(F.filter(nodes, lambda n: n["w"] > 0)))
    asked = asked.select(*points.columns, "_id", F.col("_n.col").alias("_c"), F.col("_n.row").alias("_r"), F.col("_n.w").alias("_w"))
    there = cells.select(F.col("col").alias("_c"), F.col("row").alias("_r"), F.col("v").alias("_v"), F.lit(1).alias("_in"))
    found = asked.join(there, ["_c", "_r"], "left").groupBy("_id", *points.columns).agg(
        F.when(F.count("_v") == F.count("*"), F.sum(F.col("_w") * F.col("_v"))).alias("value"),
        F.when(F.count("_in") < F.count("*"), 0).when(F.count("_v") < F.count("*"), -1).otherwise(1).alias("code"),
    )
    return found.select(*points.columns, "value", *(["code"] if codes else []))


def raster_difference(a: DataFrame, b: DataFrame, absolute: bool = False) -> DataFrame:
    """Cells(col, row, v) valid in both rasters with a - b, or its absolute value."""
    both = a.filter("v IS NOT NULL").join(b.filter("v IS NOT NULL").select("col", "row", F.col("v").alias("_b")), ["col", "row"])
    diff = F.col("v") - F.col("_b")
    return both.select("col", "row", (F.abs(diff) if absolute else diff).alias("diff"))


def points_difference(points: DataFrame, cells: DataFrame, height: str) -> DataFrame:
    """Raster less point height for the points(px, py, ...) that fall between valid nodes."""
    return bilinear(points, cells).filter(F.col("value").isNotNull() & F.col(height).isNotNull()).withColumn("diff", F.col("value") - F.col(height)).drop("value")


def nearest_in_time(asked: DataFrame, ref: DataFrame, keys: list[str], ts: str, value: str, out: str, most_seconds: float | None = None) -> DataFrame:
    """asked with the ref value nearest in absolute time, the earlier one on ties; null beyond `most_seconds`.

    Two as-of passes over one partitioning, so no pairs are made.
    """
    ref = ref.withColumn("_rv", F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))).select(*keys, ts, "_rv")
    found = as_of(as_of(asked, ref, keys, ts, "_rv", "_lo"), ref, keys, ts, "_rv", "_hi", forward=True)
    gap = lambda side: F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(f"{side}.t").cast("timestamp"))) / 1e6
    low = gap("_lo").isNotNull() & (gap("_hi").isNull() | (gap("_lo") <= gap("_hi")))
    best, far = F.when(low, F.col("_lo.v")).otherwise(F.col("_hi.v")), F.when(low, gap("_lo")).otherwise(gap("_hi"))
    return found.withColumn(out, best if most_seconds is None else F.when(far <= most_seconds, best)).drop("_lo", "_hi")


def bracket_nearest_midpoint(ref: DataFrame, frames: DataFrame, keys: list[str], ts: str, value: str, most_seconds: float) -> DataFrame:
    """For each interval of neighbouring reference times (keys, start, end), at most `most_seconds` long, the frame of
    each sensor inside it that is nearest to its middle, the earliest on ties.

    Each frame finds its interval as of its own time: an interval is its start, with the end beside it.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    spans = ref.select(*keys, ts).distinct().withColumn("_end", F.lead(ts).over(w)).filter(F.col("_end").isNotNull())
    spans = spans.withColumn("_span", F.struct(F.col(ts).alias("a"), F.col("_end").alias("b"))).select(*keys, ts, "_span")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    inside = as_of(frames, spans, keys, ts, "_span", "_in").filter(F.col("_in").isNotNull() & (F.col(ts) < F.col("_in.b")))
    inside = inside.filter(us(F.col("_in.b")) - us(F.col("_in.a")) <= most_seconds * 1e6)
    off = F.abs(2 * us(F.col(ts)) - us(F.col("_in.a")) - us(F.col("_in.b")))
    best = F.min(F.struct(off.alias("off"), F.col(ts).alias("t"), F.col(value).alias("v")))
    return inside.groupBy(*keys, "sensor", F.col("_in.a").alias("start"), F.col("_in.b").alias("end")).agg(best.alias("m")).select(*keys, "sensor", "start", "end", F.col("m.v").alias(value))


def nearest_click(points: DataFrame, x: float, y: float, limit: float) -> DataFrame:
    """The point(id, x, y) nearest to a place, if within the limit; the smallest id on ties."""
    dist = F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2))
    return points.withColumn("distance", dist).filter(F.col("distance") <= limit).orderBy("distance", "id").limit(1).select("id", "distance")


def tiles_with_margin(points: DataFrame, tile: float, margin: float) -> DataFrame:
    """points(x, y, ...) once for each tile(tx, ty) whose square, grown by the margin, holds them."""
    cells = lambda c: F.sequence(F.floor((F.col(c) - margin) / tile), F.floor((F.col(c) + margin) / tile))
    return points.withColumn("tx", F.explode(cells("x"))).withColumn("ty", F.explode(cells("y")))


def triangles(cells: DataFrame) -> DataFrame:
    """Two triangles (a, b, c: dense numbers of cells from 0, row by row) for each square of four valid cells.

    Numbers are ranks in (row, col) order, from counts of each row, so no task holds them all.
    """
    v = cells.filter(F.col("v").isNotNull()).select("col", "row")
    rows = v.groupBy("row").agg(F.count("*").alias("n")).withColumn("_one", F.lit(1))
    before = rows.select("row", (F.sum("n").over(Window.partitionBy("_one").orderBy("row")) - F.col("n")).alias("_before"))  # one line a raster row
    ids = v.join(before, "row").select("col", "row", (F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1 + F.col("_before")).alias("v"))
    from terraloom.operators.neighbourhood import around

    q = around(ids, {"a": (0, 0), "b": (1, 0), "c": (0, 1), "d": (1, 1)}).dropna(subset=["a", "b", "c", "d"])
    pair = F.array(F.struct(F.col("a").alias("a"), F.col("c").alias("b"), F.col("b").alias("c")), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), F.col("d").alias("c")))
    return q.select(F.explode(pair).alias("t")).select("t.*")


def same_frame(rasters: list[DataFrame]) -> DataFrame:
    """The rasters (col, row, v) side by side as v0, v1, ...; a raster of another number of cells raises when it is read."""
    parts = [r.select("col", "row", F.col("v").alias(f"v{i}"), F.lit(True).alias(f"_in{i}")) for i, r in enumerate(rasters)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["col", "row"], "full_outer")
    there = F.array(*(F.col(f"_in{i}").isNotNull() for i in range(len(rasters))))
    bad = F.array_contains(there, False)
    return out.select("col", "row", *(F.when(bad, F.raise_error(F.lit("rasters of different size"))).otherwise(F.col(f"v{i}")).alias(f"v{i}") for i in range(len(rasters))))


def overlap_list(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) of names as places i, j in names(name, place); a name that isn't listed raises when it is read."""
    known = names.select("name", "place")
    out = pairs.join(known.select(F.col("name").alias("a"), F.col("place").alias("i")), "a", "left").join(known.select(F.col("name").alias("b"), F.col("place").alias("j")), "b", "left")
    unknown = lambda side, at: F.when(F.col(at).isNull(), F.raise_error(F.concat(F.lit("unknown image: "), F.col(side)))).otherwise(F.col(at))
    return out.select(unknown("a", "i").alias("i"), unknown("b", "j").alias("j"))


def blunder_filter(rows: DataFrame, ref: DataFrame, key: str, value: str, most: float) -> DataFrame:
    """rows within `most` of the mean of the reference's rows of their key; rows without a reference stay."""
    mean = ref.groupBy(key).agg(F.avg(value).alias("_m"))
    return rows.join(mean, key, "left").filter(F.coalesce(F.abs(F.col(value) - F.col("_m")) <= most, F.lit(True))).drop("_m")


def points_by_disparity(points: DataFrame, disparity: DataFrame, heights: DataFrame) -> DataFrame:
    """points(id, col, row) carried by disparity(col, row, dx, dy) to a reference raster heights(col, row, height).

    id, col, row, rx, ry and the height there; points without a disparity, or that land on no height, are left out.
    """
    moved = points.join(disparity.dropna(subset=["dx", "dy"]), ["col", "row"]).withColumns({"rx": F.col("col") + F.col("dx"), "ry": F.col("row") + F.col("dy")})
    at = heights.filter(F.col("height").isNotNull()).select(F.col("col").alias("_c"), F.col("row").alias("_r"), "height")
    return moved.join(at, (F.floor(F.col("rx") + 0.5) == F.col("_c")) & (F.floor(F.col("ry") + 0.5) == F.col("_r"))).select("id", "col", "row", "rx", "ry", "height")
