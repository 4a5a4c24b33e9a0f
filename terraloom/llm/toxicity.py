"""Toxicity by a gap-weighted subsequence kernel SVM with Nystroem landmarks.

Kernel: two words are alike by their common subsequences of three characters (word ends marked), each weighted by
DECAY to the power of its span, spans up to SPAN; so inserted characters weaken a match without ending it. It is
normalised to 1 for equal words. Words are lower-cased and keep their letters and digits only, and runs of single
characters count as one word, so "i.d.i-o_t" and "i d i o t" read as the word.

A sentence's decision is the largest over its words, a document's bags are its sentences. Landmarks are words of the
training sentences, chosen by their odds in toxic documents and for being unlike each other, with frequent clean words
beside them. The machine is trained as a latent one: toxic documents give their strongest words, clean ones the words
nearest to the boundary. Nystroem's map is linear in the kernel values, and those in the subsequences, so the whole
decision folds into one weight for each subsequence.

A document's score is a logistic function of its three largest word decisions, fitted on labelled documents that the
machine hasn't seen. The only bound is that on the labelled rows used for fitting: TRAIN_ROWS of each class.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import batched, crc32_of, mix64, table

TRAIN_ROWS = 1_500
LANDMARKS, CLEAN_LANDMARKS = 128, 32
SPAN, DECAY = 6, 0.7
TABLE_BITS = 20
THRESHOLD = 0.3
#: Word decisions are clipped to this range before calibration: below it, one clean word is as clean as another. This range,
#: and how often a document is covered (`explain`), have the least logistic loss over folds of the training rows (remainders
#: 0, 1 and 3: fitted on two, measured on the third); rows with remainder 2 had no part in the choice.
DECISIONS = (-0.5, 3.0)
KEPT_WORDS = 200_000
#: Bytes of text scored at a time; a longer document is a batch of its own.
BATCH_BYTES = 1 << 19
PATTERNS = [(a, b, DECAY ** (b + 1)) for b in range(2, SPAN) for a in range(1, b)]
SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
SENTENCE = re.compile(r"[.!?\n]+")


def plain(word: str) -> str:
    return "".join(filter(str.isalnum, word.lower()))


def words_of(text: str) -> list[str]:
    """Words between white space, and runs of single characters as one word."""
    words = text.split()
    words += [m.group().replace(" ", "").replace("\n", "").replace("\t", "") for m in SPACED.finditer(text)]
    return words


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, hashed subsequence, weight), one line for each pair; weights of equal subsequences are summed."""
    marked = ["\x02" + w + "\x03" for w in words]
    lengths = np.array([len(w) for w in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters from here to the word's end
    keys, weights = [], []
    for a, b, weight in PATTERNS:
        at = np.flatnonzero(left > b)
        hashed = mix64((codes[at] << np.uint64(42)) ^ (codes[at + a] << np.uint64(21)) ^ codes[at + b]) >> np.uint64(64 - TABLE_BITS)
        keys.append((owner[at].astype(np.uint64) << np.uint64(TABLE_BITS)) | hashed)
        weights.append(np.full(len(at), weight))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    summed = np.add.reduceat(weight, first) if len(first) else weight
    key = key[first]
    return (key >> np.uint64(TABLE_BITS)).astype(np.int64), (key & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64), summed


def norms(n: int, owner: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.bincount(owner, weight * weight, n), 1e-12))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values of words and landmarks."""
    lo, lh, lw = subsequences(landmarks)
    lw = lw / norms(len(landmarks), lo, lw)[lo]
    used, index = np.unique(lh, return_inverse=True)
    small = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    small[index, lo] = lw
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for at in range(0, len(words), 20_000):
        part = words[at : at + 20_000]
        o, h, w = subsequences(part)
        w = w / norms(len(part), o, w)[o]
        slot = np.searchsorted(used, h)
        hit = (slot < len(used)) & (used[np.minimum(slot, len(used) - 1)] == h) if len(used) else np.zeros(len(h), bool)
        o, slot, w = o[hit], slot[hit], w[hit]
        if len(o):
            first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            for k in range(0, len(first), 2_000):  # bounded memory
                lo_, hi_ = first[k], first[k + 2_000] if k + 2_000 < len(first) else len(o)
                sums = np.add.reduceat(small[slot[lo_:hi_]] * w[lo_:hi_, None].astype(np.float32), first[k : k + 2_000] - lo_, axis=0)
                out[at + o[first[k : k + 2_000]]] = sums
    return out


@dataclass
class ToxicityModel:
    """weights: of each hashed subsequence; bias; coefficients: of 1 and the three largest decisions; floor: a document without words."""

    weights: np.ndarray
    bias: float
    coefficients: np.ndarray
    constant: float | None = None

    def decide(self, words: list[str]) -> np.ndarray:
        """The machine's decision for each (plain) word."""
        if not words:
            return np.zeros(0)
        owner, hashed, weight = subsequences(words)
        return np.bincount(owner, weight * self.weights[hashed], len(words)) / norms(len(words), owner, weight) + self.bias

    def probability(self, top: np.ndarray) -> np.ndarray:
        """top: the three largest decisions of each document, absent ones at the bias."""
        if self.constant is not None:
            return np.full(len(top), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + top @ self.coefficients[1:], -50, 50)))


class Scorer:
    """Scores texts; decisions of up to KEPT_WORDS words are kept from batch to batch."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.kept = model, {}

    def top(self, texts: list[str]) -> np.ndarray:
        sets = [set(words_of(t)) for t in texts]
        new = list(set().union(*sets) - self.kept.keys())
        found = dict(zip(new, self.model.decide([plain(w) for w in new]).tolist(), strict=True))
        if len(self.kept) < KEPT_WORDS:
            self.kept |= {w: x for w, x in found.items() if len(w) < 64}
        kept, out = self.kept, np.full((len(texts), 3), self.model.bias)
        for i, words in enumerate(sets):
            got = sorted([kept[w] if w in kept else found[w] for w in words], reverse=True)[:3]
            out[i, : len(got)] = got
        return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 60) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3

    def loss(w: np.ndarray) -> float:
        short = np.maximum(1 - y * (x @ w), 0)
        return float(w @ ridge @ w / 2 + c * (weight * short * short).sum())

    now = loss(w)
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        step = np.linalg.solve(ridge + 2 * c * (xa.T * wa) @ xa, 2 * c * (xa.T * wa) @ y[active]) - w
        t = 1.0
        while t > 1e-4 and loss(w + t * step) > now - 1e-12:
            t /= 2
        if t <= 1e-4 or now - loss(w + t * step) < 1e-7 * now:
            break
        w = w + t * step
        now = loss(w)
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + penalty, x.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def explain(docs: list[set[str]], words: set[str], cost, times: int = 3, least: int = 2) -> list[str]:
    """Greedy cover: words that explain the documents, each up to `times` times, while one explains `least` more than its cost."""
    holders: dict[str, list[int]] = {}
    for i, doc in enumerate(docs):
        for w in doc & words:
            holders.setdefault(w, []).append(i)
    need = np.full(len(docs), times)
    gain = {w: len(h) - 3 * cost(w) for w, h in holders.items()}
    out: list[str] = []
    while gain:
        best = max(gain, key=lambda w: (gain[w], w))
        now = int((need[holders[best]] > 0).sum()) - 3 * cost(best)
        if now < gain[best]:  # what it explained is explained meanwhile
            gain[best] = now
            if now < least:
                del gain[best]
            continue
        if now < least:
            break
        out.append(best)
        need[holders[best]] -= 1
        del gain[best]
    return out


def fit(texts: list[str], labels: list[int], seed: int = 3) -> ToxicityModel:
    """Fits machine and calibration; with one class only the score is that class, with no rows 0."""
    if len(set(labels)) < 2:
        return ToxicityModel(np.zeros(1 << TABLE_BITS), 0.0, np.zeros(4), float(labels[0]) if labels else 0.0)
    order = np.random.default_rng(seed).permutation(len(texts))
    ranks = {y: 0 for y in set(labels)}
    learn, check = [], []
    for i in order.tolist():  # each class by turns
        (learn if ranks[labels[i]] % 3 < 2 else check).append(i)
        ranks[labels[i]] += 1
    one: dict[str, str] = {}  # equal words are one object
    sentences = [[[one.setdefault(w, w) for w in {plain(w) for w in words_of(s)} - {""}] for s in SENTENCE.split(texts[i])] for i in learn]
    y = np.array([labels[i] for i in learn])
    seen = [Counter(), Counter()]
    for bags, label in zip(sentences, y, strict=True):
        seen[label].update({w for bag in bags for w in bag})
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    odds = {w: np.log((c + 0.5) / (n1 + 1)) - np.log((seen[0][w] + 0.5) / (n0 + 1)) for w, c in seen[1].items()}
    told_words = [{w for bag in doc for w in bag} for doc, label in zip(sentences, y, strict=True) if label]
    rarely = {w for w in odds if seen[1][w] >= 2 and odds[w] - 1.0 / np.sqrt(seen[1][w]) > 1.0}
    chosen = explain(told_words, rarely, lambda w: seen[0][w] * n1 / max(n0, 1))
    landmarks = chosen[:LANDMARKS]
    # beside the chosen words, those of toxic documents that are like one of them
    others = sorted(rarely - set(chosen))
    near = kernel(others, landmarks).max(axis=1) if others and landmarks else np.zeros(len(others))
    telling = chosen + [w for w, k in zip(others, near, strict=True) if k >= 0.5]
    landmarks += [w for w, _ in seen[0].most_common(CLEAN_LANDMARKS) if w not in set(landmarks)]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(float))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    words = sorted(set(seen[0]) | set(seen[1]))
    number = {w: i for i, w in enumerate(words)}
    mapped = np.empty((len(words), len(landmarks)), np.float32)
    for at in range(0, len(words), 20_000):
        mapped[at : at + 20_000] = kernel(words[at : at + 20_000], landmarks) @ root.astype(np.float32)
    bags = [[np.array([number[w] for w in bag]) for bag in doc if bag] for doc in sentences]
    told = {number[w]: float(np.sqrt(seen[1][w])) for w in telling}
    decision = np.array([odds.get(w, -1.0) for w in words])
    hard = {number[w] for w, _ in seen[0].most_common(1_000)} - told.keys()
    w = None
    for _ in range(8):
        positive: dict[int, float] = {}
        for doc, label in zip(bags, y, strict=True):
            best = sorted((int(bag[np.argmax(decision[bag])]) for bag in doc), key=lambda i: -decision[i])
            if label:  # the strongest words of its sentences, if they tell
                positive |= {i: told[i] for bag in doc for i in bag.tolist() if i in told}
            else:
                hard.update(i for i in best[:3] if i not in told)
        if not positive or not hard:
            break
        negative = sorted(hard)
        x = mapped[[*positive, *negative]].astype(float)
        target = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        w = _svm(x, target, np.concatenate([np.array(list(positive.values())), np.ones(len(negative))]))
        decision = mapped @ w[:-1].astype(np.float32) + w[-1]
    weights = np.zeros(1 << TABLE_BITS)
    bias = 0.0
    if w is not None:
        alpha = root @ w[:-1]
        owner, hashed, weight = subsequences(landmarks)
        np.add.at(weights, hashed, alpha[owner] * weight / norms(len(landmarks), owner, weight)[owner])
        bias = float(w[-1])
    model = ToxicityModel(weights, bias, np.zeros(4))
    top = Scorer(model).top([texts[i] for i in check])
    model.coefficients = _logistic(np.clip(top, *DECISIONS), np.array([labels[i] for i in check], float))
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """docs(doc_id, text), labels(doc_id, toxic): learns from at most `rows` rows of each class whose crc32(doc_id) mod 4 isn't 2."""
    fair = labels.filter(F.col("toxic").isin(0, 1) & (crc32_of(F.col("doc_id")) % 4 != 2)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    some = [fair.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * rows lines
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(chosen, "doc_id").select("doc_id", "text", "toxic")
    texts = texts.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(4 * rows)
    rows_ = texts.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("doc_id"), "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        model = fit([r[1] for r in got], [r[2] for r in got])
        used = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((used, model.weights[used], model.bias, model.coefficients, model.constant))], pa.binary())], names=["model"])

    # one task fits the bounded sample: an executor has more room than the driver
    found = rows_.repartition(1).mapInArrow(run, "model binary").first()
    if found is None:  # no rows, and so no task
        return fit([], [])
    used, values, bias, coefficients, constant = pickle.loads(found["model"])
    weights = np.zeros(1 << TABLE_BITS)
    weights[used] = values
    return ToxicityModel(weights, bias, coefficients, constant)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with toxicity, 0 to 1, from the whole text. Null and empty texts get the score of a text without words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    if "toxicity" in docs.columns:
        raise ValueError("the table has a column toxicity")
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            for a, b in batched([texts], BATCH_BYTES):
                part = batch.slice(a, b - a)
                top = scorer.top([t or "" for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.probability(np.clip(top, *DECISIONS)))], names=[*part.schema.names, "toxicity"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())]))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and decision for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc32_of(F.col("doc_id")) % 4 == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
