"""Each stage of the pipeline, and run(), against brute force on a small corpus with nulls, ties, repeats and clashing columns."""

import collections
import re

import corpus_pipeline as pipeline
import duckdb
import numpy as np
import pytest

from terraloom.llm import mixing, toxicity
from terraloom.llm.common import materialize

STAGES = dict(pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "kept", "mix_u", "toxicity", "carried"]
INSULTS = ["grumbel", "snarkip", "blathor"]


def corpus():
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(400)]
    clean = [" ".join(rng.choice(words, int(n))) for n in rng.integers(20, 90, 60)]
    toxic = [f"{t} {' '.join(rng.choice(INSULTS, 2))}" for t in clean[:20]]
    passage = " ".join(rng.choice(words, 60))
    near = [t.replace(t.split()[0], "other", 1) for t in clean[20:30]]
    texts = [*clean, *toxic, *near, clean[3], clean[3], f"{clean[40]} {passage}", f"{passage} {clean[41]}", "", None, "é" * 80]
    rows = [(i, t, "en", None if i % 9 == 0 else "abc"[i % 3], len(t or ""), i % 2 == 0, f"m{i}", 0.5, i) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[62], (None, clean[7], None, "b", 3, None, None, None, 1), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long, kept boolean, mix_u string, toxicity double, carried long").write.parquet(f"{at}/documents.parquet")
    labels = [(i, i % 2, int(60 <= i < 80)) for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def inputs(spark, folder):
    """The input of each stage, and the result of the last."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        out[name] = docs
        docs = materialize(stage(spark, docs, folder), f"test-{name}")
    return out | {"end": docs}


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def after(inputs, name):
    names = [*STAGES, "end"]
    return inputs[names[names.index(name) + 1]]


def test_columns_stay(inputs):
    for name in list(STAGES)[:-1]:
        assert inputs[name].columns == after(inputs, name).columns == COLUMNS


def test_toxicity(spark, inputs, folder):
    docs = inputs["toxicity"]
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    clean = lambda t: float(model.probability(np.clip(scorer.top([t or ""]), *toxicity.DECISIONS))[0]) < toxicity.THRESHOLD
    got = rows_of(after(inputs, "toxicity"), *COLUMNS)
    assert got == [r for r in rows_of(docs, *COLUMNS) if clean(r[1])]
    assert not any(set(INSULTS) & set((r[1] or "").split()) for r in got) and len(got) >= docs.count() - 25


def shingles(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_dedup(inputs):
    rows = sorted({(r[0], r[1]) for r in rows_of(inputs["near-dedup"], "doc_id", "text")}, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {rows[i][0] for i in range(len(rows)) if find(i) == i}
    assert rows_of(after(inputs, "near-dedup"), "doc_id", "text") == sorted([r for r in rows if r[0] in kept], key=repr)


def test_suffix_dedup(inputs):
    rows = sorted(rows_of(inputs["suffix-dedup"], "doc_id", "text"), key=lambda r: (r[0] is None, r[0] or 0))
    seen, wanted = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        new = None if t is None else bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "replace")
        wanted.append((i, new, None if new is None else len(new)))
    got = rows_of(after(inputs, "suffix-dedup"), "doc_id", "text", "n_chars")
    assert got == sorted(wanted, key=repr) and any(a != b for a, b in zip([t for _, t in rows], [w[1] for w in wanted]))


def test_mixing(inputs, tmp_path):
    inputs["mixing"].write.parquet(str(tmp_path / "docs"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/docs/*.parquet'")
    taken = {r[0]: r[4] for r in con.execute(mixing.OP8_SQL).fetchall() if r[1]}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before = set(rows_of(inputs["mixing"], *COLUMNS))
    got = collections.Counter()
    for r in rows_of(after(inputs, "mixing"), *COLUMNS):
        assert r in before
        got[r[0]] += words(r[1])
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}


def brute_packing(docs, capacity=4096):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for (text,) in rows_of(docs, "text"):
        n = len(t.encode(text or "", add_special_tokens=False).ids) + 1
        pieces += [capacity] * (n // capacity) + [n % capacity] * (n % capacity > 0)
    bins = []
    for n in sorted(pieces, reverse=True):
        fit = min((b for b in bins if b >= n), default=None)
        if fit is None:
            fit = capacity
        else:
            bins.remove(fit)
        bins.append(fit - n)
    return pieces, bins


def check_packing(got, pieces, bins):
    assert sorted(r["length"] for r in got) == sorted(pieces)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(by) == len(bins)
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096


def test_packing(inputs):
    check_packing(inputs["end"].collect(), *brute_packing(inputs["packing"]))


def test_run(spark, folder, inputs):
    got = pipeline.run(spark, folder)
    assert rows_of(got, "doc_id", "piece", "length", "ids_crc32") == rows_of(inputs["end"], "doc_id", "piece", "length", "ids_crc32")
    check_packing(got.collect(), *brute_packing(inputs["packing"]))


def test_nothing(spark, folder, inputs):
    none = inputs["toxicity"].filter("false")
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
