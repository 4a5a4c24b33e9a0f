"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Count the rows of each input partition (no column is read for that).
2. The matrix "rows that partition p sends to chunk c" follows the multivariate hypergeometric law with both margins
   fixed: rows of p by count, rows of c by exact size; a shard is a run of chunks of at most CHUNK_ROWS slots. It is never
   held as a whole: a binary tree over the partitions splits the chunks' sizes between its halves, each node with a
   generator of its own, and a task walks from the root to its own row. The law is closed under such splits.
3. Each partition permutes its rows locally and deals them out by its row of the matrix.
4. The rows are exchanged, and each chunk permutes what arrived; a row's place there is its slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.llm.common import materialize, table

#: Slots of a shard that one task of the exchange permutes.
CHUNK_ROWS = 50_000
#: From here on numpy's samplers take no more rows; draws go by inversion instead, with the same law.
SAMPLER_ROWS = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn from good + bad are good.

    Beyond the sampler's range by inversion: probabilities relative to the mode come from the exact ratios of neighbours,
    over 14 standard deviations to either side, which leaves out less than a generator of 53 bits can tell.
    """
    lo, hi = max(0, n - bad), min(good, n)
    if lo == hi:
        return lo
    if good < SAMPLER_ROWS and bad < SAMPLER_ROWS:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), lo), hi)
    spread = int(14 * (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5) + 20
    first, last = max(lo, mode - spread), min(hi, mode + spread)
    k = np.arange(first, last, dtype=np.longdouble)  # from k to k + 1
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    log_p = np.concatenate([[np.longdouble(0)], np.cumsum(steps)])
    sums = np.cumsum(np.exp(log_p - log_p.max()))
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def split(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many rows of each kind n rows hold that are drawn from kinds of these sizes."""
    total = int(sizes.sum())
    if len(sizes) == 1:
        return np.array([n], np.int64)
    if total < SAMPLER_ROWS:
        return rng.multivariate_hypergeometric(sizes, n, method="marginals")
    half = len(sizes) // 2
    left = int(sizes[:half].sum())
    here = hypergeometric(rng, left, total - left, n)
    return np.concatenate([split(rng, sizes[:half], here), split(rng, sizes[half:], n - here)])


def matrix_row(upto: np.ndarray, sizes: np.ndarray, seed: int, p: int) -> np.ndarray:
    """Row p of the matrix. upto: rows before each partition, with the total at the end; sizes: of the chunks."""
    lo, hi, here = 0, len(upto) - 1, np.asarray(sizes, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, lo, hi]))), here, int(upto[mid] - upto[lo]))
        lo, hi, here = (lo, mid, left) if p < mid else (mid, hi, here - left)
    return here


def communication_matrix(counts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """All rows of the matrix; its row sums are counts, its column sums are sizes."""
    upto = np.concatenate([[0], np.cumsum(counts)])
    return np.stack([matrix_row(upto, sizes, seed, p) for p in range(len(counts))])


def chunks_of(n: int, n_shards: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, first slot, size) of every chunk: shards of n // n_shards rows, one more in the first n % n_shards."""
    shard, first, size = [], [], []
    for s in range(n_shards):
        whole = n // n_shards + (s < n % n_shards)
        starts = np.arange(0, max(whole, 1), rows)
        shard.append(np.full(len(starts), s))
        first.append(starts)
        size.append(np.minimum(rows, whole - starts))
    return tuple(np.concatenate(x).astype(np.int64) for x in (shard, first, size))


def hypergeometric_shuffle(df: DataFrame, n_shards: int, seed: int = 7, shard_col: str = "shard", slot_col: str = "slot", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """All rows and columns of df with a shard (0 .. n_shards-1) and a slot in it (from 0, without gaps).

    The shuffle is uniform over all assignments with shard sizes n // n_shards, plus one for the first n % n_shards
    shards. Cost: a count without columns, one pass and one exchange of the rows. Eight bytes for each partition are
    broadcast.

    Nulls and repeated rows are rows like others; an empty table gives an empty result. Columns of df named like the two
    new ones, or _chunk, _first, _key or _at, raise ValueError. A df that isn't a plain scan is written to the shared
    folder first, as both passes must see the same partitions; a pass that doesn't fails.
    """
    extra = ["_chunk", "_first", "_key", "_at"]
    if {shard_col, slot_col, *extra} & set(df.columns):
        raise ValueError(f"the table has a column {shard_col}, {slot_col} or one of {extra}")
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = materialize(df, "sharding-input")
    found = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()  # a row for each partition
    counts = np.zeros(1 + max((r["p"] for r in found), default=0), np.int64)
    for r in found:
        counts[r["p"]] = r["count"]
    upto = np.concatenate([[0], np.cumsum(counts)])
    shared = df.sparkSession.sparkContext.broadcast(upto)
    fields = [T.StructField(shard_col, T.IntegerType(), False), *(T.StructField(c, T.LongType(), False) for c in extra)]
    schema = T.StructType([*df.schema.fields, *fields])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto, p = shared.value, TaskContext.get().partitionId()
        shard_of, first_of, sizes = chunks_of(int(upto[-1]), n_shards, chunk_rows)
        expected = int(upto[p + 1] - upto[p]) if p + 1 < len(upto) else 0
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, p])))
        order = rng.permutation(expected)
        edges = np.cumsum(matrix_row(upto, sizes, seed, p)) if expected else np.zeros(0, np.int64)
        at = 0
        for batch in batches:
            if at + batch.num_rows > expected:
                raise RuntimeError("the input changed between two passes; write it to a table first")
            chunk = np.searchsorted(edges, order[at : at + batch.num_rows], "right")
            place = upto[p] + np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            key = rng.integers(-(1 << 63), (1 << 63) - 1, batch.num_rows)
            made = [pa.array(shard_of[chunk], pa.int32()), *(pa.array(x, pa.int64()) for x in (chunk, first_of[chunk], key, place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, shard_col, *extra])
        if at != expected:
            raise RuntimeError("the input changed between two passes; write it to a table first")

    order = Window.partitionBy("_chunk").orderBy("_key", "_at")
    slot = (F.col("_first") + F.row_number().over(order) - 1).cast("long")
    return df.mapInArrow(deal, schema).withColumn(slot_col, slot).drop(*extra)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards with counts at most one apart (law "rows")."""
    dealt = hypergeometric_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return dealt.select(
        "doc_id",
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
