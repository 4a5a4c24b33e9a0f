"""Repeated passages by suffix arrays: finds every byte covered by a string of `length` bytes that also starts earlier.

Equal strings must meet in one shard, wherever they occur. So each string is dealt by its anchor: of its GRAM-byte pieces
the one of the smallest hash, which depends on the string alone. Runs of neighbouring strings share an anchor and travel
as one stretch.

1. Count anchors; those that occur once can't repeat. Counts are sorted arrays in the shared folder, memory-mapped.
2. Stretches of the other anchors, as (anchor, hash of the stretch, place). Equal stretches are one from there on: all but
   the first go whole.
3. Where an anchor has several stretches, one text of each is fetched, in shards of about SORT_BYTES of them. Those of
   which no string has the hash of another string of the shard can't repeat, as in 1. The others are sorted by external
   induced sorting (induced.py): of the suffix tuples and common prefixes in its queues, no more than QUEUED_TUPLES are in
   memory, the others on disk. Neighbours whose carried prefix is `length` or more form groups; all of a group but the
   first in document order are repeats.
4. The stretches of an anchor with more than SORT_BYTES of them aren't sorted: each of their strings becomes a row with
   128 bits of hash, and all of equal hash but the first are repeats.
5. Covered bytes are merged for each document.

A hot anchor costs a row for each string of its different stretches, and a hot stretch or string a row for each
occurrence, joined by a skew-proof sort-merge join; texts are fetched once for each different stretch.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.llm.common import _BASE, _BASE_INVERSE, _BYTE_CODE, BROADCAST_BYTES, _powers, batched, materialize, mix64, shared_path, table
from terraloom.llm.induced import InducedSorter, repeat_groups
from terraloom.llm.sortedarrays import ROWS, SortedArrays, counted, local_of, write_arrays

LENGTH = 100
GRAM = 32
BATCH_BYTES = 1 << 19
#: Bytes whose strings are hashed at a time, before they are sorted.
HASHED_BYTES = 1 << 18
KEPT_ANCHORS = 400_000
#: Bytes whose anchors are found at a time.
PIECE_BYTES = 1 << 20
BYTES_A_SHARD = 64 << 20
SORT_BYTES = 1 << 20
QUEUED_TUPLES = 1 << 16
MOST_SHARDS = 4096
SEPARATOR = 0xFF  # a byte that UTF-8 never has


class Anchors:
    """Stretches of all strings of `length` bytes of a batch of texts: runs of neighbours that share an anchor."""

    def __init__(self, length: int) -> None:
        self.length, self.size = length, 0

    def _room(self, n: int) -> None:
        if n > self.size:
            self.size = n
            self.up, self.down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
            self.sums, self.gram, self.ordered, self.spare = (np.empty(n + 1, np.uint64) for _ in range(4))

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(anchor, stretch hash, text number, first start in the text, number of strings); hashes of 63 bits.

        Long texts are cut into pieces that share length - 1 bytes, which cuts stretches but no string.
        """
        step = PIECE_BYTES - self.length + 1
        pieces = [(i, at, t[at : at + PIECE_BYTES]) for i, t in enumerate(texts) for at in range(0, max(len(t) - self.length + 1, 1), step)]
        found, held, size = [], [], 0
        for piece in pieces:
            if held and size + len(piece[2]) > PIECE_BYTES:
                found.append(self._find(held))
                held, size = [], 0
            held.append(piece)
            size += len(piece[2])
        if held:
            found.append(self._find(held))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(5))

    def _find(self, pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        texts = [p[2] for p in pieces]
        number, offset = (np.array([p[k] for p in pieces], np.int64) for k in (0, 1))
        data = np.frombuffer(b"".join(texts), np.uint8)
        n, length = len(data), self.length
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        if n < length or lengths.max() < length:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        self._room(n)
        sums, grams = self.sums[: n + 1], n - GRAM + 1
        sums[0] = 0
        np.take(_BYTE_CODE, data, out=self.spare[:n])
        np.multiply(self.spare[:n], self.up[:n], out=self.spare[:n])
        np.cumsum(self.spare[:n], out=sums[1:])
        gram, ordered, spare = self.gram[:grams], self.ordered[:grams], self.spare[:grams]
        np.subtract(sums[GRAM:], sums[:-GRAM], out=gram)
        gram *= self.down[:grams]
        np.right_shift(gram, np.uint64(29), out=spare)
        gram ^= spare
        gram *= np.uint64(0xBF58476D1CE4E5B9)
        np.right_shift(gram, np.uint64(32), out=spare)
        gram ^= spare
        # the leading bits of a gram's hash with its place: the smallest in a window is the leftmost of the smallest; the
        # number of bits is fixed, so that a string has the same anchor in every batch
        bits = np.uint64(PIECE_BYTES.bit_length())
        np.bitwise_and(gram, ~((np.uint64(1) << bits) - np.uint64(1)), out=ordered)
        ordered |= np.arange(grams, dtype=np.uint64)
        window, have = length - GRAM + 1, 1
        while have < window:
            step = min(have, window - have)
            np.minimum(ordered[:-step], ordered[step:], out=spare[: len(ordered) - step])
            ordered, spare = spare[: len(ordered) - step], ordered
            have += step
        # runs of windows with one anchor, cut where texts start and where their last window ends
        ends = np.cumsum(lengths)
        cuts = np.concatenate([np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, ends - lengths, np.maximum(ends - length + 1, ends - lengths)])
        cuts = np.unique(cuts[cuts < len(ordered)])
        which = np.searchsorted(ends, cuts, "right")
        run = np.diff(np.append(cuts, len(ordered)))
        fine = cuts + length <= ends[which]
        a, which, run = cuts[fine], which[fine], run[fine]
        place = (ordered[a] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        stretch = mix64((sums[a + run + length - 1] - sums[a]) * self.down[a] + run.astype(np.uint64))
        return (gram[place] >> np.uint64(1)).astype(np.int64), (stretch >> np.uint64(1)).astype(np.int64), number[which], a - (ends - lengths)[which] + offset[which], run


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(keys.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(doc, tag, raw) -> doc, tag, spans array<struct<start, end>>: merged, sorted; only documents with repeats.

    Earlier is the smaller (doc, tag), or the earlier start in a document.
    """
    spark = docs.sparkSession
    uri = shared_path(spark, "anchors")
    size = docs.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-size // BYTES_A_SHARD)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held, n = Anchors(length), [], 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in batched([texts], BATCH_BYTES):
                held.append(anchors.find(texts[a:b])[0])
                n += len(held[-1])
                if n >= KEPT_ANCHORS:
                    yield from counted(held, lambda k: _shard(k, shards))
                    held, n = [], 0
        if n:
            yield from counted(held, lambda k: _shard(k, shards))

    facts = write_arrays(docs.select("raw").mapInArrow(count, ROWS), uri, "anchors", shards, least=2)
    have = {r["shard"] for r in facts.filter("key = -1").select("shard").collect()}
    fields = [docs.schema["doc"], docs.schema["tag"]]
    place = T.StructType([*fields, T.StructField("anchor", T.LongType()), T.StructField("stretch", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("run", T.IntegerType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, arrays = Anchors(length), SortedArrays(uri, "anchors", have)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in batched([texts], BATCH_BYTES):
                key, stretch, which, start, run = anchors.find(texts[a:b])
                if not len(key):
                    continue
                unique, back = np.unique(key, return_inverse=True)
                rank, _ = arrays.find(unique, _shard(unique, shards))
                hit = np.flatnonzero(rank[back] >= 0)
                rows = pa.array(a + which[hit])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(key[hit]), pa.array(stretch[hit]), pa.array(start[hit], pa.int32()), pa.array(run[hit], pa.int32())], names=place.names)

    rows = materialize(docs.select("doc", "tag", "raw").mapInArrow(mark, place), "stretches")
    firsts = rows.groupBy("anchor", "stretch").agg(F.min(F.struct("doc", "tag", "start")).alias("first"), F.min("run").alias("run"))
    firsts = materialize(firsts, "first-stretches")
    several = firsts.groupBy("anchor").count().filter(F.col("count") > 1).select("anchor")
    doubtful = firsts.join(several, "anchor").select("anchor", F.col("first.doc").alias("fdoc"), F.col("first.tag").alias("ftag"), F.col("first.start").alias("start"), "run")
    doubtful = materialize(doubtful, "doubtful-stretches")
    repeats = rows.join(firsts.select("anchor", "stretch", "first"), ["anchor", "stretch"]).filter(F.struct("doc", "tag", "start") != F.col("first"))
    spans = repeats.select("doc", "tag", "start", (F.col("start") + F.col("run") + (length - 1)).alias("end"))
    sizes = doubtful.groupBy("anchor").agg(F.sum(F.col("run") + (length - 1)).alias("bytes"))
    hot = materialize(sizes.filter(F.col("bytes") > SORT_BYTES).select("anchor"), "hot-anchors")
    spans = spans.unionByName(_sorted_repeats(docs, doubtful.join(hot, "anchor", "left_anti"), length))
    spans = spans.unionByName(_hashed_repeats(docs, doubtful.join(hot, "anchor", "left_semi"), length))
    return _merged(spans, fields)


def _parts(docs: DataFrame, doubtful: DataFrame, length: int) -> DataFrame:
    """anchor, doc, tag, start, part (its bytes) of each stretch."""
    texts = docs.join(doubtful, (docs["doc"] == doubtful["fdoc"]) & (docs["tag"] == doubtful["ftag"]))
    return texts.select("anchor", "doc", "tag", "start", F.expr(f"substring(raw, start + 1, run + {length - 1})").alias("part"))


def _string_hashes(parts: list[bytes], length: int, codes: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Part, start in it and a hash by each code of all strings of the parts; equal strings have equal hashes."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    runs = lengths - length + 1
    owner = np.repeat(np.arange(len(parts)), runs)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = (np.cumsum(lengths) - lengths)[owner] + inside
    up, down = _powers(_BASE, len(data)), _powers(_BASE_INVERSE, len(data))
    hashes = []
    for code in codes:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code[data] * up)])
        hashes.append(mix64((sums[at + length] - sums[at]) * down[at]))
    return owner, inside, hashes


def _may_repeat(parts: list[bytes], length: int) -> np.ndarray:
    """Numbers of the parts that have a string whose hash another of the strings has; the others share no string."""
    h = np.concatenate([np.zeros(0, np.uint64), *(_string_hashes(parts[a:b], length, (_BYTE_CODE,))[2][0] for a, b in batched([parts], HASHED_BYTES))])
    ordered = np.sort(h)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(again):
        return np.zeros(0, np.int64)
    ends = np.cumsum([len(p) - length + 1 for p in parts])
    found = []
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        at = np.minimum(np.searchsorted(again, h[a:b]), len(again) - 1)
        found.append((again[at] == h[a:b]).any())
    return np.flatnonzero(found)


def _hashed_repeats(docs: DataFrame, doubtful: DataFrame, length: int) -> DataFrame:
    """Repeats among different stretches of hot anchors, by hashes of each string: doc, tag, start, end."""
    kind = T.StructType([docs.schema["doc"], docs.schema["tag"], T.StructField("start", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(4).to_pylist()
            for a, b in batched([parts], BATCH_BYTES):
                owner, inside, found = _string_hashes(parts[a:b], length, (_BYTE_CODE, mix64(_BYTE_CODE)))
                hashes = [pa.array(h.astype(np.int64)) for h in found]
                rows = pa.array(a + owner)
                start = batch.column(3).to_numpy()[a + owner] + inside
                yield pa.RecordBatch.from_arrays([batch.column(1).take(rows), batch.column(2).take(rows), pa.array(start, pa.int32()), *hashes], names=kind.names)

    rows = materialize(_parts(docs, doubtful, length).mapInArrow(strings, kind), "hot-strings")
    place = F.struct("doc", "tag", "start")
    firsts = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(firsts, ["h1", "h2"]).filter(place != F.col("first")).select("doc", "tag", "start", (F.col("start") + length).alias("end"))


def _sorted_repeats(docs: DataFrame, doubtful: DataFrame, length: int) -> DataFrame:
    """Repeats among different stretches of one anchor, by suffix sorting: doc, tag, start, end."""
    facts = doubtful.agg(F.sum(F.col("run") + (length - 1)).alias("bytes")).first()
    shards = min(1 << 20, max(1, -(-(facts["bytes"] or 0) // SORT_BYTES)))
    texts = _parts(docs, doubtful, length).select((F.pmod(F.xxhash64("anchor"), F.lit(shards))).cast("int").alias("shard"), "doc", "tag", "start", "part")
    out = T.StructType([docs.schema["doc"], docs.schema["tag"], T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    queues = shared_path(docs.sparkSession, "suffix-queues")

    def sort(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        whole = whole.take(pa.array(_may_repeat(whole.column(4).to_pylist(), length)))
        parts = whole.column(4).to_pylist()
        if not parts:
            return pa.RecordBatch.from_arrays([pa.array([], kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.int32())], names=out.names)
        order = np.lexsort((whole.column(3).to_numpy(), whole.column(2).to_numpy(), whole.column(1).fill_null(np.iinfo(np.int64).max).to_numpy()))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))  # stretches in document order
        starts = np.cumsum([0] + [len(p) + 1 for p in parts])
        text = np.frombuffer(bytes([SEPARATOR]).join(parts) + bytes([SEPARATOR]), np.uint8)
        # where the shared store isn't mounted, queues are scratch of this task, which starts anew if its executor is lost
        folder = local_of(queues)
        if folder is not None:
            os.makedirs(folder, exist_ok=True)
        order, lcp = InducedSorter(text, length, QUEUED_TUPLES, folder).sort_with_prefixes()
        suffixes, group = repeat_groups(order, lcp, length, len(text))
        owner = np.searchsorted(starts, suffixes, "right") - 1
        inside = suffixes - starts[owner]
        valid = inside + length <= np.fromiter(map(len, parts), np.int64, len(parts))[owner]
        owner, inside, group = owner[valid], inside[valid], group[valid]
        # within a stretch no string occurs twice, so the order of stretches and starts tells which came first
        when = (rank[owner] << np.int64(24)) + inside
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
        least = np.minimum.reduceat(when, edges) if len(edges) else when
        again = when > least[np.cumsum(np.concatenate([[0], (group[1:] != group[:-1])]))] if len(group) else np.zeros(0, bool)
        at = np.lexsort((inside[again], owner[again]))
        owner, inside = owner[again][at], inside[again][at]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1] + 1)])) if len(owner) else np.zeros(0, int)
        run = np.diff(np.append(first, len(owner)))
        rows = pa.array(owner[first])
        begin = whole.column(3).to_numpy()[owner[first]] + inside[first]
        return pa.RecordBatch.from_arrays([whole.column(1).take(rows), whole.column(2).take(rows), pa.array(begin, pa.int32()), pa.array(begin + run + length - 1, pa.int32())], names=out.names)

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
            for a, b in zip(edges, [*edges[1:], len(shard)], strict=True):
                if held and shard[a] != last:
                    yield sort(held)
                    held = []
                last = shard[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield sort(held)

    dealt = texts.repartition(F.col("shard")).sortWithinPartitions("shard")
    return dealt.mapInArrow(run_, out)


def _merged(spans: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Merges the spans of each document."""
    dealt = spans.repartition("doc", "tag").sortWithinPartitions("doc", "tag", "start")
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        ready: list[tuple] = []
        for batch in batches:
            for doc, tag, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != (doc, tag):
                    if held:
                        ready.append((last, held))
                    last, held = (doc, tag), [[a, b]]
                elif a <= held[-1][1]:
                    held[-1][1] = max(b, held[-1][1])
                else:
                    held.append([a, b])
            if len(ready) >= 1000:
                yield _span_batch(ready)
                ready = []
        if held:
            ready.append((last, held))
        if ready:
            yield _span_batch(ready)

    return dealt.mapInArrow(merge, T.StructType([*fields, T.StructField("spans", SPANS)]))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _span_batch(ready: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in ready], pa.int64()), pa.array([k[1] for k, _ in ready], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in held] for _, held in ready], _SPANS)], names=["doc", "tag", "spans"])


def keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with doc (the id, null last), tag (crc32 of the text) and raw (its bytes, null: empty)."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "tag": F.crc32(raw), "raw": raw})


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text, ...) with spans (removed stretches of bytes) and kept (the remaining bytes) beside its columns.

    Null texts count as empty and stay without repeats. Rows of equal id and text are one document: each keeps and loses
    the same; rows of equal id and other texts follow in the order of their texts' checksums. Null ids come last. An
    empty table gives an empty result. Columns of docs named doc, tag, raw, spans or kept raise ValueError.
    """
    if {"doc", "tag", "raw", "spans", "kept"} & set(docs.columns):
        raise ValueError("the table has a column named doc, tag, raw, spans or kept")
    whole = keyed(docs)
    spans = materialize(repeated_spans(whole.select("doc", "tag", "raw"), length), "spans")
    size = spans.agg(F.count("*"), F.sum(F.size("spans"))).first()
    spans = F.broadcast(spans) if 40 * size[0] + 8 * (size[1] or 0) <= BROADCAST_BYTES else spans
    joined = whole.join(spans, ["doc", "tag"], "left").select(*(whole[c] for c in docs.columns), whole["raw"], spans["spans"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for raw, held in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                at, parts = 0, []
                for s in held or ():
                    parts.append(raw[at : s["start"]])
                    at = s["end"]
                kept.append(b"".join([*parts, raw[at:]]) if held else raw)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], batch.columns[-1], pa.array(kept, pa.binary())], names=[*batch.schema.names[:-2], "spans", "kept"])

    return joined.mapInArrow(cut, T.StructType([*docs.schema.fields, T.StructField("spans", SPANS), T.StructField("kept", T.BinaryType())]))


def op7_suffix(spark, sf_dir: str) -> DataFrame:
    """Removed bytes and the digest of what stays, for every document."""
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate(F.coalesce("spans", F.array().cast(SPANS)), F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]).cast("long"))
    return done.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP7_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, (len(h) // 2)::BIGINT AS n_bytes FROM t),
p AS (SELECT doc_id, unnest(range(1, n_bytes - 98)) AS i FROM n WHERE n_bytes >= 100),
k AS (SELECT p.doc_id, i, md5(substr(h, 2 * i - 1, 200)) AS k FROM p JOIN n ON n.doc_id = p.doc_id),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM k) WHERE r > 1),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (
    SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM again)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, span),
parts AS (SELECT s.doc_id, a, substr(h, 2 * before - 1, 2 * (a - before)) AS part FROM (
    SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS before FROM s) s JOIN n ON n.doc_id = s.doc_id),
kept AS (SELECT doc_id, string_agg(part, '' ORDER BY a) AS first_parts FROM parts GROUP BY doc_id),
e AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last_end FROM s GROUP BY doc_id)
SELECT n.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last_end IS NULL THEN h ELSE first_parts || substr(h, 2 * last_end - 1) END)) AS kept_sha256
FROM n LEFT JOIN e ON e.doc_id = n.doc_id LEFT JOIN kept ON kept.doc_id = n.doc_id
"""
