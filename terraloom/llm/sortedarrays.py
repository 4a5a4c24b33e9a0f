"""Counts as sorted arrays in the shared folder, memory-mapped by the workers.

A set of arrays has shards; shard k is the files <name>-<k>.keys (ascending whole numbers of 8 bytes) and <name>-<k>.counts
(8 bytes each). Workers map them where they are if the folder is a mounted one, and otherwise map a copy of their own,
which goes with the worker.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terraloom.llm.common import materialize

NAMES = ["shard", "key", "count"]
ROWS = "shard int, key long, count long"


def local_of(uri: str) -> str | None:
    """The path, if uri is on a mounted file system."""
    at = urlparse(uri)
    return at.path if at.scheme in ("", "file") else None


def write_file(uri: str, parts: list[bytes | np.ndarray]) -> None:
    """Writes a whole file under another name and renames it, so a second attempt of a task does no harm."""
    path = local_of(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            for p in parts:
                f.write(memoryview(p).cast("B") if len(p) else b"")
        os.replace(own, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        for p in parts:
            f.write(memoryview(p).cast("B") if len(p) else b"")


_copies: list[str] = []


def map_file(uri: str, dtype: str) -> np.ndarray:
    path = local_of(uri)
    if path is None:
        from pyarrow import fs

        if not _copies:
            _copies.append(tempfile.mkdtemp())
            atexit.register(shutil.rmtree, _copies[0], True)
        store, at = fs.FileSystem.from_uri(uri)
        path = os.path.join(_copies[0], os.path.basename(at))
        if not os.path.exists(path):
            with store.open_input_stream(at) as f, open(path + ".part", "wb") as out:
                shutil.copyfileobj(f, out)
            os.replace(path + ".part", path)
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


class Combiner:
    """Rows (shard, key, count...) that arrive sorted become whole shards; sums of equal keys are taken across batches.

    Keys whose sum stays below `least` are left out.
    """

    def __init__(self, uri: str, name: str, least: int = 1) -> None:
        self.uri, self.name, self.least = uri, name, least
        self.shard: int | None = None
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yields (shard, keys, counts) of every shard that is complete."""
        edges = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else np.zeros(0, int)
        for a, b in zip(edges, [*edges[1:], len(shards)], strict=True):
            if self.shard is not None and self.shard != shards[a]:
                yield self.close()
            self.shard = int(shards[a])
            k, c = keys[a:b], counts[a:b]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            k, c = k[first], np.add.reduceat(c, first, axis=0)
            if self.keys and self.keys[-1][-1] == k[0]:
                self.counts[-1][-1] += c[0]
                k, c = k[1:], c[1:]
            if len(k):
                self.keys.append(k)
                self.counts.append(c)

    def close(self) -> tuple[int, np.ndarray, np.ndarray] | None:
        if self.shard is None:
            return None
        out = self.shard, np.concatenate(self.keys), np.concatenate(self.counts)
        if self.least > 1:
            out = out[0], *(x[out[2] >= self.least] for x in out[1:])
        write_file(f"{self.uri}/{self.name}-{out[0]}.keys", [np.ascontiguousarray(out[1], "<i8")])
        write_file(f"{self.uri}/{self.name}-{out[0]}.counts", [np.ascontiguousarray(out[2], "<i8")])
        self.shard, self.keys, self.counts = None, [], []
        return out


class SortedArrays:
    """Looks keys up in shards; shard_of maps keys to shards."""

    def __init__(self, uri: str, name: str, shards: set[int], columns: int = 1) -> None:
        self.uri, self.name, self.shards, self.columns = uri, name, shards, columns
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.open:
            keys, counts = map_file(f"{self.uri}/{self.name}-{k}.keys", "<i8"), map_file(f"{self.uri}/{self.name}-{k}.counts", "<i8")
            self.open[k] = keys, counts.reshape(-1, self.columns) if self.columns > 1 else counts
        return self.open[k]

    def find(self, keys: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank in its shard or -1, counts) for sorted or unsorted keys."""
        rank = np.full(len(keys), -1, np.int64)
        counts = np.zeros((len(keys), self.columns) if self.columns > 1 else len(keys), np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.unique(shard))
        for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
            rows = order[a:b]
            if int(shard[rows[0]]) not in self.shards:
                continue
            have, numbers = self._shard(int(shard[rows[0]]))
            if not len(have):
                continue
            at = np.searchsorted(have, keys[rows])
            inside = np.minimum(at, len(have) - 1)
            hit = have[inside] == keys[rows]
            rank[rows[hit]] = at[hit]
            counts[rows[hit]] = numbers[at[hit]]
        return rank, counts


def count_batch(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=NAMES)


def counted(held: list[np.ndarray], shard_of) -> Iterator[pa.RecordBatch]:
    """Rows (shard, key, count) for all keys of some arrays."""
    keys, counts = np.unique(np.concatenate(held), return_counts=True)
    for at in range(0, len(keys), 500_000):
        k = keys[at : at + 500_000]
        yield count_batch(k, counts[at : at + 500_000], shard_of(k))


def write_arrays(df: DataFrame, uri: str, name: str, parts: int, emit=None, least: int = 1) -> DataFrame:
    """Writes rows (shard, key, count) as sorted arrays. Returns a row (shard, -1, size) for each shard and what emit makes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner = Combiner(uri, name, least)

        def out(done):
            shard, keys, counts = done
            yield count_batch(np.array([-1]), np.array([len(keys)]), np.array([shard]))
            if emit is not None:
                yield from emit(keys, counts)

        for b in batches:
            for done in combiner.add(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().copy()):
                yield from out(done)
        if (done := combiner.close()) is not None:
            yield from out(done)

    return materialize(df.repartition(parts, "shard").sortWithinPartitions("shard", "key").mapInArrow(run, ROWS), f"arrays-{name}")
