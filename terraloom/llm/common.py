"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators.storage import shared_path

#: ASCII white space that separates words; every other character belongs to a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Tables up to this size are sent to every task; larger ones are joined by shuffling.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a path that shared_path() gave, on whatever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def is_small(df: DataFrame, bytes_a_row: int) -> bool:
    """Whether a written table's rows take BROADCAST_BYTES at most, by their number; such a table may be broadcast."""
    return df.count() * bytes_a_row <= BROADCAST_BYTES


def crc32_of(doc_id: Column) -> Column:
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def word_count(text: Column) -> Column:
    """Number of words of the whole text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (splitmix64's)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


SEGMENT = 1 << 19


class WordHasher:
    """64-bit hashes of all words of a batch of texts, found with whole-array operations on a few MB at a time.

    hash(texts) -> (hashes, first): hashes of all words in order, and for each text the index of its first word, with
    the total at the end. ASCII letters are lower-cased. Texts are UTF-8 bytes; None counts as empty.
    """

    def __init__(self) -> None:
        self.size = 0

    def hash(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
        ends = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))
        at, hashes, starts = 0, [], []
        while at < len(data):
            stop = min(at + SEGMENT, len(data))
            while stop < len(data) and not _IS_SPACE[data[stop - 1]]:  # a segment ends between words
                back = np.flatnonzero(_IS_SPACE[data[at:stop]][::-1])
                stop = stop - int(back[0]) if len(back) else min(stop + SEGMENT, len(data))
            h, s = self._segment(data[at:stop])
            hashes.append(h)
            starts.append(s + at)
            at = stop
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        first = np.zeros(len(texts) + 1, np.int64)
        first[1:] = np.searchsorted(start, ends, "left")
        return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), first

    def _segment(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = _LOWER[data]
        n = len(b)
        if n > self.size:
            self.size = n
            self.up, self.down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        space = _IS_SPACE[b]
        before = np.empty(n, bool)
        before[0] = True
        before[1:] = space[:-1]
        starts = np.flatnonzero(~space & before)
        stops = np.flatnonzero(space & ~before)  # the first space after each word; the segment ends with one
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_CODE[b] * self.up[:n], out=sums[1:])
        return mix64((sums[stops] - sums[starts]) * self.down[starts] + (stops - starts).astype(np.uint64)), starts


def batched(columns: list, size: int):
    """Row ranges of columns[0] (a list of bytes or None) so that each range holds about size bytes and at least a row."""
    at, held = 0, 0
    for i, t in enumerate(columns[0]):
        held += len(t or b"") + 1
        if held >= size:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(columns[0]):
        yield at, len(columns[0])
