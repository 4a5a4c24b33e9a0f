"""Interpolated modified Kneser-Ney bigram model, counted in Spark over the whole corpus.

1. Words: counts by hash, sorted arrays in shards by leading bits. A word's number is its place in that order.
2. Bigrams of numbers: counts in sorted arrays, sharded by hash of the pair. From each sorted shard come the sums that
   the model needs: for a context its count and how many words follow once, twice or more often; for a word how many
   contexts it follows; and the counts of counts for the discounts.
3. Those sums, by word number, are arrays of the same kind.
4. Scoring maps all arrays and looks up the words and pairs of a batch of documents at a time.

What reaches the driver is the sizes of shards and the counts of counts. A task holds one batch of texts (a few MB) and,
when it writes, one shard; shards grow in number with the corpus up to MOST_SHARDS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import WordHasher, batched, crc32_of, materialize, mix64, shared_path, table
from terraloom.llm.sortedarrays import ROWS, Combiner, SortedArrays, count_batch, counted, write_arrays

END = np.int64(0x5EED_0F_7E_27)  # stands for the end of a text beside the hashes of words
SMOOTHING = 0.1
BATCH_BYTES = 2 << 20
KEPT_TOKENS = 2_000_000
BYTES_A_SHARD = 16 << 20
MOST_SHARDS = 4096
#: Two word numbers share 64 signed bits.
MOST_WORDS = 1 << 31


def _tokens(hasher: WordHasher, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (63 bits) of the words of each text and its end; where each text starts."""
    hashes, first = hasher.hash(texts)
    starts = first + np.arange(len(first))
    out = np.full(len(hashes) + len(texts), END, np.int64)
    spots = np.ones(len(out), bool)
    spots[starts[1:] - 1] = False
    out[spots] = (hashes >> np.uint64(1)).astype(np.int64)
    return out, starts


def _word_shard(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.int64(63 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def _pair_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(keys.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)


class Words:
    """Numbers and counts of words, through a table of words looked up before."""

    def __init__(self, uri: str, bits: int, base: dict[int, int]) -> None:
        self.arrays, self.bits, self.base = SortedArrays(uri, "words", set(base)), bits, base
        self.first = np.zeros(1 << bits, np.int64)
        for k, b in base.items():
            self.first[k] = b
        self.keys = np.full(1 << 20, -1, np.int64)
        self.numbers = np.zeros(1 << 20, np.int64)
        self.counts = np.zeros(1 << 20, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of each key."""
        slot = keys & np.int64((1 << 20) - 1)
        number, count = self.numbers[slot], self.counts[slot]
        missed = np.flatnonzero(self.keys[slot] != keys)
        if len(missed):
            new, back = np.unique(keys[missed], return_inverse=True)
            shard = _word_shard(new, self.bits)
            rank, c = self.arrays.find(new, shard)
            n = np.where(rank >= 0, rank + self.first[shard], -1)
            number[missed], count[missed] = n[back], c[back]
            at = new & np.int64((1 << 20) - 1)
            self.keys[at], self.numbers[at], self.counts[at] = new, n, c
        return number, count


def _pair_sums(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of one sorted shard of pairs: rows (kind, word number, amount); kinds see SUMS."""
    context, word = keys >> np.int64(32), keys & np.int64(0xFFFF_FFFF)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, int)
    for kind, amount in ((0, counts), (1, counts == 1), (2, counts == 2), (3, counts >= 3)):
        if len(first):
            sums = np.add.reduceat(amount.astype(np.int64), first)
            some = np.flatnonzero(sums)
            yield count_batch(context[first[some]], sums[some], np.full(len(some), kind))
    w, n = np.unique(word, return_counts=True)
    yield count_batch(w, n, np.full(len(w), 4))
    for c in range(1, 5):
        yield count_batch(np.array([-2 - c]), np.array([int((counts == c).sum())]), np.array([5]))


#: Sums by word number, as columns: of a context its count and words that follow once, twice, more often; of a word the contexts it follows.
SUMS = 5
#: Word numbers in a shard of sums.
SUMS_SHARD = 1 << 22


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts of one, two and more from the counts of counts; within 0 and the count, 0.5, 1, 1.5 if unknown."""
    if not all(n[:3]):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    out = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(out, (1, 2, 3), strict=True))


class Model:
    """Where the arrays are and the numbers they need; small, so it travels with tasks."""

    def __init__(self, **facts) -> None:
        self.__dict__.update(facts)

    def open(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.m = model
        self.hasher = WordHasher()
        self.words = Words(model.uri, model.bits, model.base)
        self.pairs = SortedArrays(model.uri, "pairs", model.pair_shards)
        self.sums = SortedArrays(model.uri, "sums", model.sum_shards, SUMS)

    def score(self, texts: list[bytes | None]) -> dict[str, np.ndarray]:
        m = self.m
        keys, starts = _tokens(self.hasher, texts)
        number, count = self.words.find(keys)
        known = number >= 0
        base = np.log10((count + SMOOTHING) / (m.tokens + SMOOTHING * (m.words + 1)))
        before = np.empty_like(number)
        before[1:] = number[:-1]
        before[starts[:-1]] = m.words  # a text's start
        every, back = np.unique(np.concatenate([number[known], before[before >= 0]]), return_inverse=True)
        _, sums = self.sums.find(every, (every // SUMS_SHARD).astype(np.int32))
        own, ahead = np.zeros(len(number), np.int64), np.zeros((len(number), 4), np.int64)
        n_known = int(known.sum())
        own[known] = sums[back[:n_known], 4]
        ahead[before >= 0] = sums[back[n_known:], :4]
        cut = np.array([0.0, *m.low])
        lower = (own - cut[np.minimum(own, 3)]).clip(0) / max(m.pair_types, 1) + m.low_rest / (m.words + 1)
        pair = np.where(known & (before >= 0), (before << np.int64(32)) | np.maximum(number, 0), -1)
        asked, back = np.unique(pair, return_inverse=True)
        _, c = self.pairs.find(asked, _pair_shard(asked, m.n_pair_shards))
        c = np.where(asked >= 0, c, 0)[back]
        total = np.maximum(ahead[:, 0], 1)
        cut = np.array([0.0, *m.high])
        rest = (ahead[:, 1:] @ np.array(m.high)) / total
        p = np.where(ahead[:, 0] > 0, (c - cut[np.minimum(c, 3)]).clip(0) / total + rest * lower, lower)
        at = starts[:-1]
        return {
            "n_tokens": np.diff(starts),
            "n_known": np.add.reduceat((count > 0).astype(np.int64), at),
            "base_score": np.add.reduceat(base, at),
            "score": np.add.reduceat(np.log10(p), at),
        }


def train(docs: DataFrame) -> Model:
    """Counts all texts of docs(text). Null counts as empty. Without rows the model has no words and every token is unknown."""
    spark = docs.sparkSession
    uri = shared_path(spark, "lm")
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = min(MOST_SHARDS, max(1, -(-size // BYTES_A_SHARD)))
    bits = min(12, max(0, int(size // (256 << 20)).bit_length()))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, n = WordHasher(), [], 0
        for batch in batches:
            column = batch.column(0).to_pylist()
            for a, b in batched([column], BATCH_BYTES):
                held.append(_tokens(hasher, column[a:b])[0])
                n += len(held[-1])
                if n >= KEPT_TOKENS:
                    yield from counted(held, lambda k: _word_shard(k, bits))
                    held, n = [], 0
        if held:
            yield from counted(held, lambda k: _word_shard(k, bits))

    sizes = write_arrays(texts.mapInArrow(count_words, ROWS), uri, "words", min(n_shards, 1 << bits), _total)
    facts = sizes.filter("key = -1").select("shard", "count").collect()
    tokens = sizes.filter("key = -2").agg(F.sum("count")).first()[0] or 0
    base, words = {}, 0
    for r in sorted(facts, key=lambda r: r["shard"]):
        base[r["shard"]] = words
        words += r["count"]
    if words >= MOST_WORDS:
        raise ValueError(f"{words} distinct words: pairs of their numbers have room for {MOST_WORDS - 1}")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, numbers, held, n = WordHasher(), Words(uri, bits, base), [], 0
        for batch in batches:
            column = batch.column(0).to_pylist()
            for a, b in batched([column], BATCH_BYTES):
                keys, starts = _tokens(hasher, column[a:b])
                number, _ = numbers.find(keys)
                before = np.empty_like(number)
                before[1:] = number[:-1]
                before[starts[:-1]] = words
                held.append((before << np.int64(32)) | number)
                n += len(held[-1])
                if n >= KEPT_TOKENS:
                    yield from counted(held, lambda k: _pair_shard(k, n_shards))
                    held, n = [], 0
        if held:
            yield from counted(held, lambda k: _pair_shard(k, n_shards))

    sums = write_arrays(texts.mapInArrow(count_pairs, ROWS), uri, "pairs", n_shards, _pair_sums)
    pair_facts = sums.filter("key = -1").select("shard", "count").collect()
    seen = {r["key"]: r["n"] for r in sums.filter("key < -2").groupBy("key").agg(F.sum("count").alias("n")).collect()}
    wide = sums.filter("key >= 0").groupBy("key").agg(*(F.sum(F.when(F.col("shard") == k, F.col("count")).otherwise(0)).alias(f"s{k}") for k in range(SUMS)))
    wide = wide.withColumn("shard", (F.col("key") / SUMS_SHARD).cast("int"))

    def write_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner = Combiner(uri, "sums")

        def out(done):
            shard, keys, counts = done
            yield count_batch(np.array([-1]), np.array([len(keys)]), np.array([shard]))
            for c in range(1, 5):
                yield count_batch(np.array([-2 - c]), np.array([int((counts[:, 4] == c).sum())]), np.array([5]))
            yield count_batch(np.array([-10]), np.array([int((counts[:, 4] >= 3).sum())]), np.array([5]))

        for b in batches:
            counts = np.stack([b.column(2 + k).to_numpy() for k in range(SUMS)], axis=1)
            for done in combiner.add(b.column(0).to_numpy(), b.column(1).to_numpy(), counts):
                yield from out(done)
        if (done := combiner.close()) is not None:
            yield from out(done)

    wide = wide.select("shard", "key", *(f"s{k}" for k in range(SUMS)))
    written = materialize(wide.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(write_sums, ROWS), "lm-sums")
    low_seen = {r["key"]: r["n"] for r in written.filter("key < -2").groupBy("key").agg(F.sum("count").alias("n")).collect()}
    sum_shards = {r["shard"] for r in written.filter("key = -1").select("shard").collect()}
    pair_types = sum(r["count"] for r in pair_facts)
    high = discounts([seen.get(-2 - c, 0) for c in range(1, 5)])
    low = discounts([low_seen.get(-2 - c, 0) for c in range(1, 5)])
    low_rest = (low[0] * low_seen.get(-3, 0) + low[1] * low_seen.get(-4, 0) + low[2] * low_seen.get(-10, 0)) / max(pair_types, 1) if pair_types else 1.0
    return Model(uri=uri, bits=bits, base=base, words=words, tokens=int(tokens), n_pair_shards=n_shards, pair_shards={r["shard"] for r in pair_facts}, sum_shards=sum_shards, pair_types=pair_types, high=high, low=low, low_rest=low_rest)


def _total(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield count_batch(np.array([-2]), np.array([int(counts.sum())]), np.array([0]))


def perplexity(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, n_known, base_score, score; scores are sums of log10 over words and the end."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.open()
        for batch in batches:
            column = batch.column(1).to_pylist()
            for a, b in batched([column], BATCH_BYTES):
                got = scorer.score(column[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(got[n]) for n in names[1:])], names=names)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op10_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) mod 10 isn't 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_of(F.col("doc_id")) % 10 == 0
    model = train(docs.filter(~held_out))
    return perplexity(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
