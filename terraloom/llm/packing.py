"""Best-fit-decreasing packing of token sequences.

Only lengths matter to best fit, and there are at most `capacity` of them. So the packing runs on the histogram of piece
lengths: whole runs of equal pieces go into whole groups of equal bins, and a segment tree over remaining capacities
finds the tightest open group in logarithmic time. The outcome is that of best-fit decreasing piece by piece over the
whole corpus, found on the driver from at most `capacity` numbers.

The plan it leaves says where the k-th piece of each length goes. Each length opens at most three groups, and a bin's
distinct lengths sum to at most the capacity, so the plan has at most 3 * capacity * sqrt(2 * capacity) lines, about
1.1 million for 4096, however many documents there are. That bound makes it fit to broadcast.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import batched, materialize, table

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that one task ranks.
BLOCK_ROWS = 2_000
#: Words that a worker keeps with their ids, and the length from which a word isn't kept.
CACHE_WORDS, LONG_WORD = 300_000, 64
#: Bytes of text encoded at a time; a longer document is a batch of its own.
BATCH_BYTES = 1 << 19


class OpenBins:
    """A segment tree over remaining capacities 1..n; each leaf holds groups (first bin, number of bins)."""

    def __init__(self, n: int) -> None:
        self.leaves = 1 << n.bit_length()
        self.tree = np.zeros(2 * self.leaves, np.int32)  # groups below each node
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]

    def _add(self, capacity: int, change: int) -> None:
        at = capacity + self.leaves
        while at:
            self.tree[at] += change
            at >>= 1

    def push(self, capacity: int, first: int, count: int) -> None:
        if capacity and count:
            self.groups[capacity].append((first, count))
            self._add(capacity, 1)

    def pop(self, capacity: int) -> tuple[int, int]:
        self._add(capacity, -1)
        return self.groups[capacity].pop()

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least `least` that has a bin."""
        at = least + self.leaves
        if self.tree[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(plan, bins). Plan lines are (length, from rank, first bin, pieces a bin, offset), sorted by length and rank."""
    bins, opened, plan = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room, first, count = capacity, opened, math.ceil(left / (capacity // length))
                opened += count
            else:
                first, count = bins.pop(room)
            each = room // length
            full = min(count, left // each)
            if full:
                plan.append((length, rank, first, each, capacity - room))
                bins.push(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < count:  # fewer than a bin takes
                plan.append((length, rank, first + full, left, capacity - room))
                bins.push(room - left * length, first + full, 1)
                full, left = full + 1, 0
            bins.push(room, first + full, count - full)
    return np.array(sorted(plan), np.int64).reshape(-1, 5), opened


def place(plan: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of the rank-th pieces of given lengths."""
    line = np.searchsorted((plan[:, 0] << 48) + plan[:, 1], (length << 48) + rank, "right") - 1
    past = rank - plan[line, 1]
    return plan[line, 2] + past // plan[line, 3], plan[line, 4] + past % plan[line, 3] * length


class Encoder:
    """Token ids of texts as bytes of little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and no token crosses it, so each word between blanks has ids of its own; those of up
    to CACHE_WORDS words are kept. The words of a batch that aren't kept are encoded as one text, and their ids told
    apart by the tokens' offsets. The tokenizer lower-cases, so ASCII texts are lower-cased first and their words kept in one
    form, unless an added token would come of that.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        self.lowers = self._lowers()
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _lowers(self) -> bool:
        upper = "".join(map(chr, range(0x41, 0x5B)))
        return self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str(upper) == upper.lower()

    def _plain(self, text: str) -> str:
        if self.lowers and text.isascii():
            low = text.lower()
            if not any(t in low for t in self.added):
                return low
        return text

    def _ids(self, words: list[str]) -> list[bytes]:
        encoding = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        offsets = np.array([o[0] for o in encoding.offsets], np.int64)
        ends = 4 * np.searchsorted(offsets, starts)
        ids = np.array(encoding.ids, "<u4").tobytes()
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._plain(t).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        words = list(chain.from_iterable(split))
        ids = list(map(self.kept.get, words))
        unknown = [i for i, x in enumerate(ids) if x is None]
        if unknown:
            new = list({words[i] for i in unknown})
            found = dict(zip(new, self._ids(new), strict=True))
            for i in unknown:
                ids[i] = found[words[i]]
            if len(self.kept) < CACHE_WORDS:
                self.kept |= {w: x for w, x in found.items() if len(w) < LONG_WORD}
        ends = list(accumulate(map(len, split), initial=0))
        return [b"".join(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """A worker process keeps one encoder from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, and ids (binary) if asked for.

    Null and invalid texts: null counts as empty (its only id is the end), bytes that aren't UTF-8 as U+FFFD. Only
    documents of more than `capacity` ids are cut.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer_path), np.array([end_id], "<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            raw = batch.column(1).to_pylist()
            for a, b in batched([raw], BATCH_BYTES):
                part = batch.slice(a, b - a)
                texts = [(t or b"").decode("utf-8", "replace") for t in raw[a:b]]
                out: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), width)):
                        piece = ids[start : start + width]
                        out.append((doc_id, k, start // 4, len(piece) // 4, zlib.crc32(piece), *([piece] if with_ids else [])))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(encode, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(doc_id, piece, length, ...) with 1 <= length <= capacity -> the same with sequence_id and offset.

    Best-fit decreasing over all pieces. Pieces of equal length are interchangeable: those of equal id and number too. An
    empty table gives an empty result. Needs pieces that read the same twice (a table). Columns of pieces named block,
    blocks, before, rank, sequence_id or offset raise ValueError.
    """
    if {"block", "blocks", "before", "rank", "sequence_id", "offset"} & set(pieces.columns):
        raise ValueError("the table has a column named block, blocks, before, rank, sequence_id or offset")
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    plan, _ = best_fit_decreasing({r["length"]: r["count"] for r in counts}, capacity)
    shared = spark.sparkContext.broadcast(plan)
    blocks = spark.createDataFrame([(r["length"], math.ceil(r["count"] / BLOCK_ROWS)) for r in counts], "length long, blocks int")
    dealt = pieces.join(F.broadcast(blocks), "length").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.col("blocks")))
    sums = dealt.groupBy("length", "block").count()
    sums = sums.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("block")) - F.col("count"))
    order = Window.partitionBy("length", "block").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(sums.drop("count"), ["length", "block"])
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("rank")).alias("rank"))
    length_at = ranked.columns.index("length")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bin_, offset = place(shared.value, batch.column(length_at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bin_), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    from pyspark.sql import types as T

    fields = [f for f in ranked.schema.fields if f.name != "rank"]
    return ranked.mapInArrow(put, T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encodes docs(doc_id, text), cuts what is too long and packs all pieces; other columns of docs are left out."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(materialize(encode_pieces(docs, tokenizer_path, capacity, with_ids=with_ids), "packing-pieces"), capacity)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
