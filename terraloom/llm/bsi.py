"""Exact top-k by inner product of integers over a bit-sliced index.

Each block of rows is stored as bitmaps: slice (attribute, bit) has a bit for each row. A query adds the slices of its
non-zero attributes, shifted by the bits of its coefficients, with carry-save bitmap arithmetic; slices of attributes
with negative coefficients are complemented, which turns the sum into one of non-negative terms plus a constant. The top
rows are found from the most significant slice of the sum downwards, and the rows at the boundary by exact score and id.

Chunks of queries are copied for the blocks, not blocks for the chunks: a task gets a block once, indexes it, and answers the
chunks that follow it, at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import materialize, table
from terraloom.llm.vectors import usable

BLOCK_ROWS = 32_768
CHUNK_QUERIES = 64
#: A task's work: chunks that a block answers at most before another task takes a copy of it.
TASK_CHUNKS = 64
#: Tasks of a search at most; beyond that a task takes several blocks, one after the other.
MOST_TASKS = 50_000


class SlicedBlock:
    """The bit-sliced index of some rows: attributes as whole numbers, each offset by its minimum."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows, self.attributes = values.shape
        self.least = values.min(axis=0) if self.rows else np.zeros(self.attributes, np.int64)
        lifted = (values - self.least).astype(np.uint64)
        self.width = max(1, int(lifted.max(initial=0)).bit_length())
        words = -(-self.rows // 64)
        self.slices = np.zeros((self.attributes, self.width, words), np.uint64)
        for bit in range(self.width):
            packed = np.packbits(((lifted >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
            whole = np.zeros((self.attributes, words * 8), np.uint8)
            whole[:, : packed.shape[1]] = packed
            self.slices[:, bit] = whole.view(np.uint64)

    def everything(self) -> np.ndarray:
        out = np.full(self.slices.shape[2], ~np.uint64(0))
        if self.rows % 64:
            out[-1] = (np.uint64(1) << np.uint64(self.rows % 64)) - np.uint64(1)
        return out

    def add(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the sum, least significant first, and the constant to add to each row's sum."""
        d = min(len(query), self.attributes)
        used = np.flatnonzero(query[:d])
        constant = 0
        piles: dict[int, list[np.ndarray]] = {}
        for j in used.tolist():
            c = int(query[j])
            constant += c * int(self.least[j])
            bitmaps = self.slices[j]
            if c < 0:
                constant += c * ((1 << self.width) - 1)
                bitmaps = ~bitmaps
                c = -c
            shift = 0
            while c:
                if c & 1:
                    for bit in range(self.width):
                        piles.setdefault(bit + shift, []).append(bitmaps[bit])
                c >>= 1
                shift += 1
        out, at = [], 0
        while piles:
            pile = piles.pop(at, [])
            if not pile:
                out.append(np.zeros(self.slices.shape[2], np.uint64))
            else:
                held = np.stack(pile)
                while len(held) > 1:  # three bitmaps of a weight become one of it and one of the next
                    n = len(held) // 3 * 3
                    if n:
                        a, b, c = held[0:n:3], held[1:n:3], held[2:n:3]
                        half = a ^ b
                        carry, total = (a & b) | (half & c), half ^ c
                        held = np.concatenate([total, held[n:]]) if n < len(held) else total
                    else:
                        carry, held = held[:1] & held[1:2], held[:1] ^ held[1:2]
                    piles.setdefault(at + 1, []).extend(carry)
                out.append(held[0])
            at += 1
        return out, constant

    def top(self, query: np.ndarray, k: int, ids: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k highest scores among the allowed ones, ties to the smaller id, and their scores."""
        sums, constant = self.add(query)
        sure, open_ = np.zeros_like(allowed), allowed.copy()
        for s in reversed(sums):
            more = sure | (open_ & s)
            n = int(np.bitwise_count(more).sum())
            if n > k:
                open_ &= s
            else:
                sure, open_ = more, open_ & ~s
                if n == k:
                    open_[:] = 0
                    break
        rows, edge = _rows(sure), _rows(open_)  # all at the edge have one score
        if len(rows) + len(edge) > k:
            edge = edge[np.argsort(ids[edge], kind="stable")[: k - len(rows)]]
        rows = np.concatenate([rows, edge])
        at, bit = rows >> 6, (rows & 63).astype(np.uint64)
        score = np.full(len(rows), constant, np.int64)
        for weight, s in enumerate(sums):
            score += ((s[at] >> bit) & np.uint64(1)).astype(np.int64) << weight
        return rows, score


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def quantise(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, q: each component x as floor(scale * x)."""
    return usable(vectors, nonzero=False).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("q"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; short rows are filled with zeros, as absent components add nothing."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    width = int(lengths.max(initial=0))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _packed(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """rows(vec_id, q) in groups of about `size`: (group, n, width, kind of number, ids, values), stored in the shared folder, and the number of groups."""
    groups = max(1, -(-rows.count() // size))

    def pack(part: pa.Table) -> pa.Table:
        values = _matrix(part.column("q").combine_chunks())
        ids = part.column("vec_id").to_numpy()
        kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if values.min(initial=0) >= np.iinfo(k).min and values.max(initial=0) <= np.iinfo(k).max)
        return pa.table({"group": pa.array([part.column("group")[0].as_py()], pa.int64()), "n": [values.shape[0]], "width": [values.shape[1]], "kind": [kind], "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "q": pa.array([values.astype(kind).tobytes()], pa.binary())})

    dealt = rows.select("vec_id", "q", F.pmod(F.xxhash64("vec_id", "q"), F.lit(groups)).alias("group"))
    return materialize(dealt.groupBy("group").applyInArrow(pack, "group long, n long, width long, kind string, ids binary, q binary"), name), groups


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """rows and queries, both (vec_id, q array<long>) -> query_id, rank (from 1), vec_id, score.

    For each query the k rows of the highest inner products, ties to the smaller vec_id, without rows of the query's own
    id. Fewer rows give fewer results; an empty table none. Of several queries with one id the smallest vector counts.
    Vectors of other lengths count as filled with zeros. Scores must fit 64 bits.
    """
    queries = queries.groupBy("vec_id").agg(F.min("q").alias("q"))
    blocks, n_blocks = _packed(rows, BLOCK_ROWS, "bsi-rows")
    chunks, n_chunks = _packed(queries, CHUNK_QUERIES, "bsi-queries")
    # a chunk for each block: the stated query set against all rows, in blocks; a block for each lane of chunks
    wanted = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = min(n_chunks, max(-(-n_chunks // TASK_CHUNKS), -(-wanted // n_blocks)))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    columns = ["block", "lane", "asked", "n", "width", "kind", "ids", "q"]
    indexed = blocks.withColumnRenamed("group", "block").withColumns({"lane": upto(lanes), "asked": F.lit(0)}).select(columns)
    asking = chunks.withColumns({"lane": F.pmod("group", F.lit(lanes)), "block": upto(n_blocks), "asked": F.lit(1)}).select(columns)
    dealt = indexed.unionByName(asking).repartition(min(n_blocks * lanes, MOST_TASKS), "block", "lane").sortWithinPartitions("block", "lane", "asked")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                number, lane, asked, n, w, kind, ids, q = (batch.column(c)[r].as_py() for c in range(8))
                if not asked:
                    if at != number:  # the next lane of the same block finds it indexed
                        at, block, ids_of = number, SlicedBlock(np.frombuffer(q, kind).reshape(n, w).astype(np.int64)), np.frombuffer(ids, "<i8")
                        all_rows, order = block.everything(), np.argsort(ids_of, kind="stable")
                        sorted_ids = ids_of[order]
                    continue
                if at != number:
                    continue  # chunks of a group of rows that is empty
                found = []
                for query_id, query in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(q, kind).reshape(n, w), strict=True):
                    allowed = all_rows.copy()
                    for own in order[np.searchsorted(sorted_ids, query_id, "left") : np.searchsorted(sorted_ids, query_id, "right")].tolist():
                        allowed[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
                    rows_, score = block.top(query, k, ids_of, allowed)
                    found.append((np.full(len(rows_), query_id, np.int64), ids_of[rows_], score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products for each query of embeddings."""
    rows = materialize(quantise(table(spark, sf_dir, "embeddings")), "bsi-quantised")
    return top_k(rows, rows.filter(F.col("vec_id") % 20 == 0))


OP4_SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::DOUBLE) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
