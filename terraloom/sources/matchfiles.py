"""Binary match files as a Spark data source: spark.read.format("match_files"), df.write.format("match_files").

A file belongs to a pair of images: two counts (64 bits), the points of the left image, then those of the right one; the
k-th of both are a match. A point is a record of fixed fields and a descriptor of its own length, all little-endian.

    spark.dataSource.register(MatchFiles)
    spark.read.format("match_files").load(folder)

The rows are file, k (from 0) and the points left and right. A partition is a file, read forwards by two cursors, so that
memory doesn't grow with it. A file that ends within a record, or whose counts differ, raises ValueError.

Rows to be written must come file by file in the order of their matches (`write_matches` sees to that). A task writes into
_temporary below the folder; the commit moves what the successful attempts wrote, and an abort removes it. A null file
name or point, or a file met twice, raises ValueError; null fields are written as 0, null descriptors as empty.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# fixed values: the fields of a record in their order, with their widths in the file
FIELDS = (("x", "f"), ("y", "f"), ("ix", "i"), ("iy", "i"), ("orientation", "f"), ("scale", "f"), ("interest", "f"), ("polarity", "B"), ("octave", "I"), ("level", "I"))
HEAD = struct.Struct("<" + "".join(kind for _, kind in FIELDS) + "Q")
COUNTS = struct.Struct("<QQ")
LENGTH = struct.Struct("<Q")
_HEADS = np.dtype([*((name, {"f": "<f4", "i": "<i4", "B": "u1", "I": "<u4"}[kind]) for name, kind in FIELDS), ("n", "<u8")])

_SPARK = {"f": "float", "i": "int", "B": "boolean", "I": "long"}
_ARROW = {"f": pa.float32(), "i": pa.int32(), "B": pa.bool_(), "I": pa.int64()}
POINT = f"struct<{', '.join(f'{n}: {_SPARK[kind]}' for n, kind in FIELDS)}, descriptor: array<float>>"
SCHEMA = f"file string, k long, left {POINT}, right {POINT}"
_POINT = pa.struct([*((n, _ARROW[kind]) for n, kind in FIELDS), ("descriptor", pa.list_(pa.float32()))])
_ROWS = pa.schema([("file", pa.string()), ("k", pa.int64()), ("left", _POINT), ("right", _POINT)])
ROWS_A_BATCH = 4096
COPY_BYTES = 1 << 20


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


def _take(stream, n: int, file: str) -> bytes:
    data = stream.read(n)
    if len(data) < n:
        raise ValueError(f"{file} ends within a record")
    return data


class _Cursor:
    """Records of a stream, read forwards; a chunk of the file and the records asked for are in memory."""

    def __init__(self, stream, file: str) -> None:
        self.stream, self.file, self.held, self.at = stream, file, b"", 0

    def _reach(self, n: int) -> None:
        """Holds n bytes from the place on."""
        parts, have = [self.held[self.at :]], len(self.held) - self.at
        while have < n:
            more = self.stream.read(COPY_BYTES)
            if not more:
                raise ValueError(f"{self.file} ends within a record")
            parts.append(more)
            have += len(more)
        self.held, self.at = b"".join(parts), 0

    def take(self, n: int) -> tuple[bytes, np.ndarray]:
        """The bytes of the next n records and where each starts in them."""
        starts, taken, done = np.empty(n, np.int64), [], 0
        begin = self.at
        for i in range(n):
            for size in (HEAD.size, None):
                size = size or HEAD.size + 4 * LENGTH.unpack_from(self.held, self.at + HEAD.size - LENGTH.size)[0]
                if self.at + size > len(self.held):
                    taken.append(self.held[begin : self.at])
                    done += self.at - begin
                    self._reach(size)
                    begin = 0
            starts[i] = done + self.at - begin
            self.at += size
        taken.append(self.held[begin : self.at])
        return b"".join(taken), starts


def _heads_of(whole: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the bytes of the records' fixed fields are, and a mask of all others."""
    at = starts[:, None] + np.arange(HEAD.size)
    others = np.ones(len(whole), bool)
    others[at] = False
    return at, others


def _points(data: bytes, starts: np.ndarray) -> pa.StructArray:
    whole = np.frombuffer(data, np.uint8)
    at, others = _heads_of(whole, starts)
    heads = whole[at].view(_HEADS)[:, 0]
    columns = [pa.array(heads[name] != 0 if kind == "B" else heads[name], _ARROW[kind]) for name, kind in FIELDS]
    ends = np.concatenate([[0], np.cumsum(heads["n"].astype(np.int64))])
    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole[others].view("<f4"))))
    return pa.StructArray.from_arrays(columns, fields=list(_POINT))


def _packed(points: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """The records of points as bytes, and where each starts and the last one ends."""
    heads = np.zeros(len(points), _HEADS)
    for name, kind in FIELDS:
        values = points.field(name).fill_null(False if kind == "B" else 0).to_numpy(zero_copy_only=False)
        if kind == "I" and len(values) and not 0 <= values.min() <= values.max() < 1 << 32:
            raise ValueError(f"{name} doesn't fit 32 bits without a sign")
        heads[name] = values
    descriptors = points.field("descriptor")
    heads["n"] = pc.list_value_length(descriptors).fill_null(0).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(HEAD.size + 4 * heads["n"].astype(np.int64))])
    whole = np.empty(starts[-1], np.uint8)
    at, others = _heads_of(whole, starts[:-1])
    whole[at] = heads.view(np.uint8).reshape(-1, HEAD.size)
    whole[others] = descriptors.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype("<f4").view(np.uint8)
    return whole, starts


@dataclass
class _File(InputPartition):
    path: str

    def __post_init__(self) -> None:
        super().__init__(self.path)


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, path = _store(self.path)
        found = store.get_file_info(path)
        if found.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        inside = store.get_file_info(pa.fs.FileSelector(path)) if found.type == pa.fs.FileType.Directory else [found]
        files = sorted(f.path for f in inside if f.type == pa.fs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [_File(f) for f in files] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:  # an empty folder
            return
        store, _ = _store(self.path)
        path, name = partition.path, partition.path.rsplit("/", 1)[-1]
        with store.open_input_stream(path, buffer_size=COPY_BYTES) as left, store.open_input_stream(path, buffer_size=COPY_BYTES) as right:
            n, others = COUNTS.unpack(_take(left, COUNTS.size, path))
            if n != others:
                raise ValueError(f"{path} has {n} points of the left image and {others} of the right one")
            _take(right, COUNTS.size, path)
            cursors = _Cursor(left, path), _Cursor(right, path)
            pieces = [min(ROWS_A_BATCH, n - start) for start in range(0, n, ROWS_A_BATCH)]
            for piece in pieces:
                cursors[1].take(piece)
            for i, piece in enumerate(pieces):
                k = np.arange(piece, dtype=np.int64) + i * ROWS_A_BATCH
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name), piece), pa.array(k), *(_points(*c.take(piece)) for c in cursors)], schema=_ROWS)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (temporary path, name)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.attempt = path, overwrite, uuid.uuid4().hex

    def _folder(self) -> tuple[pa.fs.FileSystem, str, str]:
        store, path = _store(self.path)
        return store, path.rstrip("/"), f"{path.rstrip('/')}/_temporary/{self.attempt}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, _, work = self._folder()
        store.create_dir(work, recursive=True)
        done: list[tuple[str, str]] = []
        seen: set[str] = set()
        name, n, parts, sides = None, 0, [], []

        def finish() -> None:
            for s in sides:
                s.close()
            whole = f"{work}/{uuid.uuid4().hex}"
            with store.open_output_stream(whole) as out:
                out.write(COUNTS.pack(n, n))
                for part in parts:
                    with store.open_input_stream(part) as held:
                        while data := held.read(COPY_BYTES):
                            out.write(data)
                    store.delete_file(part)
            done.append((whole, name))

        for batch in batches:
            files, points = batch.column("file"), [batch.column(side) for side in ("left", "right")]
            if files.null_count or any(p.null_count for p in points):
                raise ValueError("a match needs a file name and both points")
            packed = [_packed(p) for p in points]
            runs = pc.run_end_encode(files)
            start = 0
            for file, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if file != name:
                    if name is not None:
                        finish()
                    if file in seen or "/" in file or file.startswith(("_", ".")):
                        raise ValueError(f"{file!r} comes twice, or is no name of a file")
                    name, n = file, 0
                    seen.add(name)
                    parts = [f"{work}/{uuid.uuid4().hex}" for _ in range(2)]
                    sides = [store.open_output_stream(p, buffer_size=COPY_BYTES) for p in parts]
                for side, (whole, starts) in zip(sides, packed, strict=True):
                    side.write(whole[starts[start] : starts[end]])
                n += end - start
                start = end
        if name is not None:
            finish()
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path, work = self._folder()
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            store.delete_dir(work)
            raise ValueError("a file was written by several tasks: bring the rows of a file together first")
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(pa.fs.FileSelector(path)):
                if old.type == pa.fs.FileType.File:
                    store.delete_file(old.path)
        elif any(f.type != pa.fs.FileType.NotFound for f in store.get_file_info([f"{path}/{name}" for name in names])):
            store.delete_dir(work)
            raise ValueError("a file of one of these names is there already")
        for made, name in files:
            store.move(made, f"{path}/{name}")
        if store.get_file_info(work).type == pa.fs.FileType.Directory:
            store.delete_dir(work)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _, work = self._folder()
        if store.get_file_info(work).type == pa.fs.FileType.Directory:
            store.delete_dir(work)


class MatchFiles(DataSource):
    """The data source `match_files`; its path is a folder of match files, or one file to read."""

    @classmethod
    def name(cls) -> str:
        return "match_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def read_matches(spark, path: str) -> DataFrame:
    """file, k, left, right of a folder of match files, or of one."""
    spark.dataSource.register(MatchFiles)
    return spark.read.format("match_files").load(path)


def write_matches(matches: DataFrame, path: str, mode: str = "append") -> None:
    """matches(file, k, left, right) written as match files, a file a task at a time, its matches in the order of k.

    Fields of a point that aren't given are written as 0; other columns are left out. A file is the work of one task, as
    it is one pair of images; a pair's matches are as many as its interest points.
    """
    matches.sparkSession.dataSource.register(MatchFiles)
    fields = [(n, _SPARK[kind]) for n, kind in FIELDS] + [("descriptor", "array<float>")]

    def point(side: str):
        there = matches.schema[side].dataType.names
        filled = F.struct(*((F.col(side)[n] if n in there else F.lit(None)).cast(kind).alias(n) for n, kind in fields))
        return F.when(F.col(side).isNotNull(), filled).alias(side)

    rows = matches.select(F.col("file").cast("string").alias("file"), F.col("k").cast("long").alias("k"), point("left"), point("right"))
    rows.repartition("file").sortWithinPartitions("file", "k").write.format("match_files").mode(mode).save(path)
