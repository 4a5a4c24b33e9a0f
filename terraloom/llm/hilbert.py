"""Approximate nearest neighbours by inner product over shifted Hilbert curves.

Vectors are projected on principal axes (fitted on a bounded sample), turned by another rotation and shifted for each
curve, and ordered by their place on a Hilbert curve. Each ordering is cut into BLOCKS ranges of equal share; a query
is compared with its own range and the neighbouring ones of every ordering. What all orderings find merges, and the
nearest by exact inner product stay.

A window is a share of the table, so recall is the same at every size; so is the number of inner products for each
query relative to the table. Large ranges are split into pieces by hash, and the queries that meet a piece into groups,
so that no task holds more than PIECE_ROWS vectors and GROUP_QUERIES queries or so. Where ranges would hold fewer than
LEAST_RANGE distinct vectors, or fewer than are asked for, there are fewer ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.bsi import _matrix
from terraloom.llm.common import materialize, table
from terraloom.llm.vectors import usable

CURVES = 10
BLOCKS = 16
DIMENSIONS, BITS = 16, 4
SAMPLE_ROWS = 16_384
PIECE_ROWS = 16_384
LEAST_RANGE = 64
GROUP_QUERIES = 4_096


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates below 2**bits, as unsigned 64-bit numbers.

    A point descends from the coarsest bit; at each level the curve's orientation (a swap with the first axis or a
    reflection for each axis) is applied to the finer bits, and the Gray code of the outcome is read off.
    """
    axes = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = np.uint64((1 << level) - 1)
        for i, axis in enumerate(axes):
            set_ = (axis >> np.uint64(level)) & np.uint64(1) == 1
            swap = np.where(set_, np.uint64(0), (axes[0] ^ axis) & low)
            flip = np.where(set_, low, np.uint64(0))
            axes[0] = axes[0] ^ swap ^ flip
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    twist = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        twist ^= np.where((axes[-1] >> np.uint64(level)) & np.uint64(1) == 1, np.uint64((1 << level) - 1), np.uint64(0))
    key = np.zeros_like(twist)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << np.uint64(1)) | (((axis ^ twist) >> np.uint64(bit)) & np.uint64(1))
    return key


class Curves:
    """Projections, shifts and range splitters of all orderings, fitted on a sample."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, blocks: int = BLOCKS, seed: int = 5) -> None:
        self.width = sample.shape[1]
        self.mean = sample.mean(axis=0)
        axes = np.linalg.svd(sample - self.mean, full_matrices=False)[2]
        rng = np.random.default_rng(seed)
        d = min(DIMENSIONS, len(axes))
        self.turns, self.low, self.span = [], [], []
        for c in range(curves):
            n = len(axes) if c % 2 else d  # by turns all axes and the leading ones
            turn = np.linalg.qr(rng.normal(size=(n, n)))[0][:, :d]
            self.turns.append(axes[:n].T @ turn)
            at = (sample - self.mean) @ self.turns[-1]
            span = np.maximum(at.max(axis=0) - at.min(axis=0), 1e-12)
            self.low.append(at.min(axis=0) - rng.random(d) * span / 2)
            self.span.append(1.5 * span)
        self.splits = [np.quantile(self.key(sample, c).astype(float), np.arange(1, blocks) / blocks) for c in range(curves)]

    def key(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        v = vectors[:, : self.width]
        if v.shape[1] < self.width:
            v = np.pad(v, ((0, 0), (0, self.width - v.shape[1])))
        at = ((v - self.mean) @ self.turns[curve] - self.low[curve]) / self.span[curve]
        return hilbert_key(np.clip((at * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS)

    def blocks(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        return np.searchsorted(self.splits[curve], self.key(vectors, curve).astype(float), "right")


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """Equal vectors as one row: class_id (their smallest id), embedding, ids (the k + 1 smallest, sorted)."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = vectors.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("class_id"), "embedding", "ids")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, curves: int = CURVES, blocks: int = BLOCKS) -> DataFrame:
    """vectors and queries, both (vec_id, embedding) -> query_id, rank (from 1), vec_id, score (inner product, double).

    For each query its k nearest found, without rows of its own id, ties to the smaller vec_id. Rows that take no part:
    see vectors.usable. Equal vectors are searched as one and told apart at the end, so copies cost no room in a window.
    Fewer candidates give fewer results; an empty table none. Of several queries with one id the smallest vector counts.
    """
    spark = vectors.sparkSession
    usable_rows = materialize(usable(vectors, nonzero=True), "ann-rows")
    classes = materialize(classes_of(usable_rows, k), "ann-classes")
    asked = usable(queries, nonzero=True).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select(F.col("vec_id").alias("query_id"), "embedding")
    n = classes.count()
    result = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return spark.createDataFrame([], result)
    blocks = max(1, min(blocks, n // max(LEAST_RANGE, k + 1)))  # a range holds enough for a whole answer
    sampled = classes.filter(F.pmod(F.xxhash64("class_id"), F.lit(max(1, -(-n // SAMPLE_ROWS)))) == 0).select("embedding").limit(2 * SAMPLE_ROWS).toArrow()
    fitted = spark.sparkContext.broadcast(Curves(_matrix(sampled.column(0).combine_chunks()).astype(float), curves, blocks))
    pieces = max(1, -(-n // (blocks * PIECE_ROWS)))
    groups = max(1, -(-3 * asked.count() // (blocks * GROUP_QUERIES)))

    def placed(id_name: str):
        def place(batches):
            for batch in batches:
                vectors_ = _matrix(batch.column(1)).astype(float)
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(vectors_), c), pa.int32()), pa.array(fitted.value.blocks(vectors_, c), pa.int32())], names=[id_name, "embedding", "curve", "block"])

        return place

    kind = classes.schema["embedding"].dataType.simpleString()
    rows = classes.select("class_id", "embedding").mapInArrow(placed("class_id"), f"class_id long, embedding {kind}, curve int, block int")
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("class_id"), F.lit(pieces))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    wanted = asked.mapInArrow(placed("query_id"), f"query_id long, embedding {kind}, curve int, block int")
    near = F.sequence(F.greatest(F.col("block") - 1, F.lit(0)), F.least(F.col("block") + 1, F.lit(blocks - 1)))
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("block", F.explode(near))
    wanted = wanted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asked_ids = left.column("class_id").to_numpy(), right.column("query_id").to_numpy()
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(ids) and len(asked_ids):
            x, q = (_matrix(t.column("embedding").combine_chunks()).astype(float) for t in (left, right))
            d = min(x.shape[1], q.shape[1])
            x, q, m = x[:, :d], q[:, :d], min(k + 1, len(ids))
            for at in range(0, len(q), 512):
                score = q[at : at + 512] @ x.T
                top = np.argpartition(-score, m - 1, axis=1)[:, :m]
                edge = np.take_along_axis(score, top, axis=1).min(axis=1)
                who, which = np.nonzero(score >= edge[:, None] - 1e-12)  # all that tie at the edge, ids decide later
                out.append((asked_ids[at + who], ids[which], np.einsum("ij,ij->i", q[at + who], x[which])))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "class_id", "score"])

    keys = ["curve", "block", "piece", "part"]
    found = rows.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(rerank, "query_id long, class_id long, score double")
    found = found.groupBy("query_id", "class_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "class_id")
    found = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    members = found.join(classes.select("class_id", "ids"), "class_id").select("query_id", "score", F.explode("ids").alias("vec_id")).filter(F.col("vec_id") != F.col("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return members.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found for each query of embeddings."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
