"""Centroid clustering of whole-number vectors by Yinyang bounds: the same result as assigning every vector to every centroid.

Centroids are cut into groups once. A vector keeps an upper bound of the distance to its centroid and, for each group, one
lower bound of the distance to the group's other centroids. When centroids have moved, bounds are widened by how far. A vector
whose upper bound is below all lower ones stays; else only groups whose bound is reached are looked at, in them only centroids
that their own drift lets come near enough, and those by exact whole-number distances, ties to the smaller number.

Vectors and bounds are one written table a round, read by the next, so a lost executor costs tasks of one round. What reaches
the driver is the sums of each cluster: k rows of one vector's length, however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import materialize, remove_path, table
from terraloom.operators.storage import shared_path

#: Components may be up to this size: squared distances of 64 of them fit 64 bits.
LARGEST = 1 << 27
#: Bounds are widened by this part of their size at every step, more than the rounding of a double.
SLACK = 1e-12
#: Centroids to a group.
GROUP_SIZE = 10

STATE = "vec_id long, q binary, cluster int, upper double, lower binary"


def whole_numbers(vectors: DataFrame, size: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and q, floor(scale * x) of each component, of the vectors of exactly `size` components, none null or non-finite.

    Repeated rows stay. A component beyond LARGEST raises.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == size) & fine)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    too_large = F.exists(whole, lambda x: F.abs(x) > F.lit(LARGEST))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(too_large, F.raise_error(F.lit("a component is too large for distances of 64 bits"))).otherwise(whole).alias("q"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest sha256 of `seed:vec_id`, in that order; null ids last, then ties by the vector."""
    keyed = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = keyed.orderBy(F.asc_nulls_last("h"), "q").limit(k).select("q").collect()
    return np.array([r["q"] for r in first], np.int64)


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid, from a few rounds of clustering the centroids themselves."""
    groups = max(1, min(groups, len(centroids)))
    points = centroids.astype(float)
    heads = points[np.linspace(0, len(points) - 1, groups).astype(int)]
    for _ in range(10):
        of = ((points[:, None] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)
        heads = np.stack([points[of == g].mean(axis=0) if (of == g).any() else heads[g] for g in range(groups)])
    return of


def _squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid."""
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    exact = vectors.shape[1] * 4 * largest * largest < 1 << 53  # then a double holds every sum
    v, c = (vectors.astype(float), centroids.astype(float)) if exact else (vectors, centroids)
    return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None]).astype(np.int64)


def _one_each(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = vectors - centroids
    return np.einsum("ij,ij->i", d, d)


def assign(vectors: np.ndarray, centroids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First assignment by all distances: cluster, upper bound, lower bounds by group."""
    squares = _squares(vectors, centroids)
    cluster = squares.argmin(axis=1)
    rows = np.arange(len(vectors))
    upper = np.sqrt(squares[rows, cluster].astype(float)) * (1 + SLACK)
    squares[rows, cluster] = np.iinfo(np.int64).max
    lower = np.stack([np.sqrt(squares[:, of == g].min(axis=1, initial=np.iinfo(np.int64).max).astype(float)) * (1 - SLACK) for g in range(of.max() + 1)], axis=1)
    return cluster, upper, lower


def reassign(vectors, centroids, drift, of, cluster, upper, lower) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """cluster, upper and lower bounds after the centroids drifted, and the number of exact distances it took."""
    groups = of.max() + 1
    before = lower
    moved = np.array([drift[of == g].max(initial=0.0) for g in range(groups)])
    lower = np.maximum(0.0, (lower - moved) * (1 - SLACK) - SLACK)
    upper = (upper + drift[cluster]) * (1 + SLACK)
    cluster = cluster.copy()
    asked = np.flatnonzero(upper >= lower.min(axis=1))  # the global filter
    exact = _one_each(vectors[asked], centroids[cluster[asked]])
    taken = len(asked)
    upper[asked] = np.sqrt(exact.astype(float)) * (1 + SLACK)
    still = upper[asked] >= lower[asked].min(axis=1)
    asked, exact = asked[still], exact[still]
    held = cluster[asked]  # where the vectors were
    best, at = exact.copy(), held.copy()
    second = np.full((len(asked), groups), np.inf)  # bounds of the groups that are looked at, without the best
    open_ = upper[asked, None] >= lower[asked]  # the group filter
    distances: list[tuple[int, np.ndarray, np.ndarray]] = []
    for j in range(len(centroids)):
        g = of[j]
        bound = np.maximum(0.0, (before[asked, g] - drift[j]) * (1 - SLACK) - SLACK)
        # the filter of single centroids: what the best distance so far can't exclude
        look = open_[:, g] & (held != j)
        near = look & (bound <= np.sqrt(best.astype(float)) * (1 + SLACK))
        far = look & ~near
        second[far, g] = np.minimum(second[far, g], bound[far])
        rows = np.flatnonzero(near)
        if len(rows):
            d = _one_each(vectors[asked[rows]], centroids[j])
            taken += len(rows)
            distances.append((j, rows, d))
            wins = (d < best[rows]) | ((d == best[rows]) & (j < at[rows]))
            best[rows[wins]], at[rows[wins]] = d[wins], j
    for j, rows, d in distances:
        lost = at[rows] != j
        second[rows[lost], of[j]] = np.minimum(second[rows[lost], of[j]], np.sqrt(d[lost].astype(float)) * (1 - SLACK))
    new = np.where(open_, second, lower[asked])
    left = np.flatnonzero(at != held)  # the centroid that lost a vector counts in its group's bound again
    new[left, of[held[left]]] = np.minimum(new[left, of[held[left]]], np.sqrt(exact[left].astype(float)) * (1 - SLACK))
    lower[asked], cluster[asked], upper[asked] = new, at, np.sqrt(best.astype(float)) * (1 + SLACK)
    return cluster, upper, lower, taken


def _read(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _bytes(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.dtype.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _state(vec_id, q: pa.Array, cluster, upper, lower) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([vec_id, q, pa.array(cluster, pa.int32()), pa.array(upper), _bytes(lower)], names=["vec_id", "q", "cluster", "upper", "lower"])


class Clusters:
    """One clustering: its centroids, groups and written states."""

    def __init__(self, vectors: DataFrame, k: int, seed: int, width: int) -> None:
        self.spark, self.width, self.path = vectors.sparkSession, width, None
        self.centroids = first_centroids(vectors, k, seed)
        self.of = grouped(self.centroids, -(-k // GROUP_SIZE)) if len(self.centroids) else np.zeros(0, int)
        self.kind = "<i4"

    def _write(self, state: DataFrame) -> None:
        old, self.path = self.path, shared_path(self.spark, "yinyang")
        state.write.parquet(self.path)
        self.state = self.spark.read.schema(STATE).parquet(self.path)
        if old:  # nothing reads the round before any more
            remove_path(self.spark, old)

    def begin(self, vectors: DataFrame) -> None:
        centroids, of, width, kind = self.centroids, self.of, self.width, self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)
                    yield _state(batch.column(0), _bytes(v.astype(kind)), *assign(v, centroids, of))

        self._write(vectors.select("vec_id", "q").mapInArrow(run, STATE))

    def move(self) -> np.ndarray:
        """Centroids become the floor of their vectors' means; how far each went."""
        width, kind, k = self.width, self.kind, len(self.centroids)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
            for batch in batches:
                if batch.num_rows:
                    cluster, v = batch.column(0).to_numpy(), _read(batch.column(1), kind, width).astype(np.int64)
                    order = np.argsort(cluster, kind="stable")
                    here, first = np.unique(cluster[order], return_index=True)
                    sums[here] += np.add.reduceat(v[order], first)
                    counts += np.bincount(cluster, minlength=k)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

        parts = self.state.select("cluster", "q").mapInArrow(add, "cluster long, n long, s array<long>")
        totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width))).collect()  # k rows
        old, new = self.centroids, self.centroids.copy()
        for r in totals:
            new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        self.centroids = new
        return np.sqrt(_one_each(new, old).astype(float)) * (1 + SLACK)

    def step(self, drift: np.ndarray) -> None:
        centroids, of, width, kind = self.centroids, self.of, self.width, self.kind
        groups = int(of.max()) + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v, lower = _read(batch.column(1), kind, width).astype(np.int64), _read(batch.column(4), "<f8", groups)
                    yield _state(batch.column(0), batch.column(1), *reassign(v, centroids, drift, of, batch.column(2).to_numpy(), batch.column(3).to_numpy(), lower)[:3])

        self._write(self.state.mapInArrow(run, STATE))

    def distances(self) -> DataFrame:
        centroids, width, kind = self.centroids, self.width, self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cluster = batch.column(1).to_numpy()
                    d = _one_each(_read(batch.column(2), kind, width).astype(np.int64), centroids[cluster])
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["vec_id", "cluster", "distance"])

        return self.state.select("vec_id", "cluster", "q").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, width: int = 64) -> DataFrame:
    """vectors(vec_id, q array<long> of `width`) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Each of `rounds` assigns every vector to its nearest centroid (ties to the smaller number) and moves the centroids; then
    vectors are assigned once more. Empty centroids stay where they are. Fewer vectors than k give as many centroids; equal
    vectors may be several centroids, of which the first takes all. A null id takes part and is chosen as a first centroid
    only where ids run out. Repeated rows count each. Empty input gives no rows. Sums must fit 64 bits.
    """
    spark = vectors.sparkSession
    made = Clusters(vectors, k, seed, width)
    if not len(made.centroids):
        nothing = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], nothing)
    made.begin(vectors)
    for _ in range(rounds):
        made.step(made.move())
    ended = materialize(made.distances(), "yinyang-distances")
    # one row for each of k clusters
    by = ended.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    inertia = sum(r["cluster_inertia"] for r in by)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in made.centroids.tolist()]
    known = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], inertia, digest[r["cluster"]]) for r in by], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return ended.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_yinyang(spark, sf_dir: str) -> DataFrame:
    """40 clusters of the embeddings after five rounds."""
    return cluster(whole_numbers(table(spark, sf_dir, "embeddings")))


def _sql(rounds: int = 5, k: int = 40, width: int = 64) -> str:
    fine = f"embedding IS NOT NULL AND len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE {fine})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, q) - 1)::INT AS cluster, q FROM v ORDER BY sha256('2:' || vec_id) NULLS LAST, q LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(vq) AS q, min((d, cluster)) AS near FROM "
            f"(SELECT v.r, v.vec_id, v.q AS vq, c.cluster, (list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q))::BIGINT AS d FROM v, c{i} c) GROUP BY r)"
        )
        if i < rounds:
            parts.append(
                f"m{i} AS MATERIALIZED (SELECT cluster, list(f ORDER BY i) AS q FROM (SELECT near[2] AS cluster, i, floor(sum(x) / count(*)) AS f FROM "
                f"(SELECT near, unnest(q) AS x, unnest(range({width})) AS i FROM a{i}) GROUP BY near[2], i) GROUP BY cluster)"
            )
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster)")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, a.near[2]::INT AS cluster, a.near[1] AS distance, (sum(a.near[1]) OVER (PARTITION BY a.near[2]))::BIGINT AS cluster_inertia, "
        f"(sum(a.near[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.q, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.near[2]"
    )


OP12_SQL = _sql()
