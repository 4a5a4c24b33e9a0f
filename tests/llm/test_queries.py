"""Every registered query on one small folder: null and repeated ids, repeated rows, empty and long texts, columns with clashing names."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import tokenizers

from terraloom.llm import registry, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "size long, shard int, slot long, score double, kept boolean, rank int, word string, key long, copies int"


def documents():
    rng = np.random.default_rng(21)
    words = [f"word{i}" for i in range(250)]
    draw = lambda n: " ".join(rng.choice(words, int(n)))
    texts = [draw(n) for n in rng.integers(1, 90, 50)]
    texts += [t.replace(t.split()[0], "other", 1) for t in texts[:8]] + [f"{draw(30)} {rng.choice(['grumbel', 'snarkip'])} blathor" for _ in range(20)]
    passage = draw(40)
    texts += [f"{texts[9]} {passage}", f"{passage} {texts[10]}", texts[3], "", None, "é" * 70, "A b\tC d E f", "x" * 300, draw(4000)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(22)
    rows = documents()
    rows += [rows[5], (None, rows[7][1]), (None, None), (12, rows[30][1])]  # a repeated row, null ids, one id with two texts
    extra = lambda i: (7, 1, 2, 0.5, False, 3, "w", 4, i)
    docs = [(i, t, "en", None if k % 9 == 0 else f"s{k % 4}", *extra(k)) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, f"doc_id long, text string, lang string, source string, {EXTRA}").repartition(3).write.parquet(f"{at}/documents.parquet")
    whole = [d for d in docs if d[0] is not None]
    whole = [d for k, d in enumerate(whole) if d[0] not in {e[0] for e in whole[:k]}]
    at2 = str(tmp_path_factory.mktemp("distinct"))
    spark.createDataFrame(whole, f"doc_id long, text string, lang string, source string, {EXTRA}").write.parquet(f"{at2}/documents.parquet")
    labels = spark.createDataFrame([(i, int(58 <= i < 78), 1, "t") for i in range(87)], "doc_id long, toxic int, quality int, text string")
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, 64)]) for i in range(60)]
    vectors += [(60, vectors[3][1]), (61, vectors[3][1]), (62, [0.0] * 64), (63, None), (64, [None] * 64), (65, [math.nan] * 64), (None, vectors[4][1]), (80, vectors[3][1])]
    pages = [(i, f"u{i}", h, "t") for i, h in enumerate(["<p>short</p>", None, "", "<p>" + "word " * 50, "<p>" + "word " * 50, "<p>" + "é" * 100_000, "<p>short</p>", "<p>" + "word " * 50])]
    for to in (at, at2):
        labels.write.parquet(f"{to}/labels.parquet")
        spark.createDataFrame([(*v, 1, 0.5) for v in vectors if to == at or v[0] is not None], "vec_id long, embedding array<float>, rank int, score double").write.parquet(f"{to}/embeddings.parquet")
        spark.createDataFrame([(*p, "d") for p in pages], "page_id long, url string, html string, text string, payload_digest string").write.parquet(f"{to}/pages.parquet")
    return at, at2, rows


def run(spark, folder, name):
    return [r.asDict() for r in registry.queries()[name](spark, folder).collect()]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twins(spark, folder, name):
    """The SQL twins, over distinct ids (the twins join by id)."""
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder[1]}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, folder[1])
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[k] for k in at) for r in cursor.fetchall()), key=repr) and got


def test_op1(spark, folder):
    got = run(spark, folder[0], "op1_sharding")
    texts = [(i, (t or "").encode()) for i, t in folder[2]]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((i, len(t) + 16, zlib.crc32(t)) for i, t in texts), key=repr)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    shards = collections.defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(40)) and {len(s) for s in shards.values()} <= {len(got) // 40, len(got) // 40 + 1}
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_op2(spark, folder):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder[1]}/embeddings.parquet").collect()}
    good = {i: np.array(v, float) for i, v in vectors.items() if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    got = collections.defaultdict(dict)
    for r in run(spark, folder[1], "op2_ann"):
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {0, 20, 40, 60, 80}
    hits = 0
    for q, found in got.items():
        scores = {i: math.fsum((good[q] * v).tolist()) for i, v in good.items() if i != q}
        assert all(s == pytest.approx(scores[i], abs=1e-12) for i, s in found.values())
        ranked = [found[k] for k in sorted(found)]
        assert sorted(found) == list(range(1, len(found) + 1)) and [(-s, i) for i, s in ranked] == sorted((-s, i) for i, s in ranked)
        hits += len({i for i, _ in ranked} & set(sorted(scores, key=lambda i: (-scores[i], i))[:20]))
    assert hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("name", ["op2_ann", "op4_topk", "op12_yinyang"])
def test_vectors_without_ids(spark, folder, name):
    """Null ids ask nothing; the others' results have their rows as before."""
    with_null = [r for r in run(spark, folder[0], name) if r["vec_id"] is not None]
    without = run(spark, folder[1], name)
    ids = lambda rows: {r.get("query_id", r["vec_id"]) for r in rows}
    assert ids(with_null) == ids(without) and None not in ids(with_null)


def test_op3(spark, folder):
    tokenizer = tokenizers.Tokenizer.from_file("/opt/tokenizers/word_bpe_49k.json")
    wanted = collections.Counter()
    for i, t in folder[2]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            wanted[i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = run(spark, folder[0], "op3_packing")
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *itertools.accumulate(n for _, n in b[:-1])] and sum(n for _, n in b) <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in got) // 4096) + 1


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words)} - {()} if len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_op6(spark, folder):
    rows, got = folder[2], run(spark, folder[0], "op6_minhash")
    sets = [shingles(t) for _, t in rows]
    assert sorted(((r["doc_id"], r["n_shingles"]) for r in got), key=repr) == sorted(((i, len(s)) for (i, _), s in zip(rows, sets, strict=True)), key=repr)
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    wanted = collections.Counter((i, len(sets[k]), least[root[k]]) for k, (i, _) in enumerate(rows) if i is not None)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_op7(spark, folder):
    rows = sorted((i, (t or "").encode()) for i, t in documents())
    seen, wanted = set(), {}
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(t[k : k + 100])
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        wanted[i] = (len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(spark, folder[1], "op7_suffix")}
    assert got == wanted and sum(w[1] for w in wanted.values()) > 500
    assert len(run(spark, folder[0], "op7_suffix")) == len(folder[2])


def test_op8(spark, folder):
    got = run(spark, folder[0], "op8_mixing")
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=repr) == sorted(((i, len(WORD.findall(t or ""))) for i, t in folder[2]), key=repr)
    assert all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in got)
    taken, targets, largest = collections.Counter(), {}, collections.Counter()
    for r in got:
        largest[r["source_size"], r["target"]] = max(largest[r["source_size"], r["target"]], r["size"])
        taken[r["source_size"], r["target"]] += r["taken"]
        targets[r["source_size"], r["target"]] = r["target"]
    assert sum(targets.values()) == pytest.approx(sum(s for s, _ in targets)) and all(abs(taken[k] - t) <= largest[k] for k, t in targets.items())  # whole documents are taken
    assert sorted(map(repr, got)) == sorted(map(repr, run(spark, folder[0], "op8_mixing")))


def test_op9(spark, folder):
    got = run(spark, folder[0], "op9_toxicity")
    remainder = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4
    assert sorted((repr(r["doc_id"]), r["held_out"]) for r in got) == sorted((repr(i), remainder(i) == 2) for i, _ in folder[2])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    by_text = dict(documents())
    held = [(r["predicted"], int(58 <= r["doc_id"] < 78)) for r in got if r["held_out"] and r["doc_id"] is not None and by_text[r["doc_id"]]]
    assert np.mean([p == w for p, w in held]) >= 0.8


def plain_kernel(a, b):
    """All common subsequences of three characters, each by its decay to the power of its span, in words with marked ends."""

    def features(word):
        marked, out = f"\x02{word}\x03", collections.Counter()
        for i, j, k in itertools.combinations(range(len(marked)), 3):
            if k - i < toxicity.SPAN:
                out[marked[i] + marked[j] + marked[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = features(a), features(b)
    size = lambda f: math.sqrt(sum(w * w for w in f.values()))
    return sum(w * y[s] for s, w in x.items()) / max(size(x) * size(y), 1e-12)


def test_kernel_counts_gapped_subsequences():
    rng = np.random.default_rng(23)
    words = ["".join(rng.choice(list("abcdé"), int(n))) for n in rng.integers(1, 12, 40)] + ["grumbel", "gr.um.bel", "grxumbel", "a"]
    got = toxicity.kernel(words, words[:20] + ["grumbel"])
    wanted = [[plain_kernel(a, b) for b in words[:20] + ["grumbel"]] for a in words]
    assert np.allclose(got, wanted, atol=2e-3)  # hashed features may meet
    assert plain_kernel("grumbel", "grxumbel") > 0.5 > plain_kernel("grumbel", "abcde")


def test_op10(spark, folder):
    rows, got = folder[2], run(spark, folder[0], "op10_lm")
    remainder = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    tokens = lambda t: [*WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), None]
    counts = collections.Counter(w for i, t in rows if remainder(i) != 0 for w in tokens(t))
    total = sum(counts.values())
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in tokens(t))
    wanted = sorted(((i, remainder(i) == 0, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(base(t), 6)) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr) == wanted
    assert all(r["score"] < 0 for r in got)


