"""Each operator against brute force on small tables with nulls, empty and repeated texts, ties and extra columns."""

import collections
import gzip
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import bsi, forest, hilbert, induced, kneserney, mixing, packing, sharding, suffixes, toxicity, warc
from terraloom.llm.common import shared_path

WORDS = [f"w{i}" for i in range(300)]


def texts():
    rng = np.random.default_rng(4)
    base = [" ".join(rng.choice(WORDS, int(n))) for n in rng.integers(1, 120, 40)]
    near = [b.replace(b.split()[0], "other", 1) for b in base[:10]]
    passage = " ".join(rng.choice(WORDS, 60))
    out = [*base, *near, base[3], base[3], f"{base[5]} {passage}", f"{passage} {base[6]}", "", None, "é" * 70 + " ü", "A b\tC\n d E", "a B c D e"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", len(t or ""), i) for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, u long")


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_sharding(docs, none):
    rows = sharding.hypergeometric_shuffle(docs, 7).collect()
    assert sorted(r["doc_id"] for r in rows) == [i for i, _ in texts()]
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.hypergeometric_shuffle(none, 7).count() == 0
    with pytest.raises(ValueError):
        sharding.hypergeometric_shuffle(docs.withColumn("slot", F.lit(1)), 7)


def test_communication_matrix():
    counts, sizes = np.array([5, 0, 9]), np.array([7, 7])
    m = sharding.communication_matrix(counts, sizes, 1)
    assert m.sum(axis=1).tolist() == counts.tolist() and m.sum(axis=0).tolist() == sizes.tolist()


def test_hypergeometric_beyond_the_sampler(monkeypatch):
    rng = np.random.default_rng(1)
    draw = lambda *a: np.array([sharding.hypergeometric(rng, *a) for _ in range(4000)])
    exact = [math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5) for k in range(6)]
    monkeypatch.setattr(sharding, "SAMPLER_ROWS", 1)
    got = np.bincount(draw(6, 9, 5), minlength=6)
    assert sum((g - 4000 * e) ** 2 / (4000 * e) for g, e in zip(got, exact)) < 25  # 5 degrees of freedom
    assert set(draw(3, 0, 2)) == {2} and set(draw(0, 3, 2)) == {0}
    big = draw(3 * 10**9, 7 * 10**9, 10**6)
    assert abs(big.mean() - 300_000) < 5 * (210_000 / 4000) ** 0.5 and abs(big.var() / 210_000 - 1) < 0.15
    parts = sharding.split(rng, np.array([2 * 10**9, 5, 10**9, 0]), 10**6)
    assert parts.sum() == 10**6 and parts[3] == 0


def test_sharding_is_uniform(spark):
    # every row meets every slot equally often: chi-square over 5 shards of 4 slots, chunks of 2
    df = spark.range(20).repartition(3).sortWithinPartitions("id")
    path = shared_path(spark, "twenty")
    df.write.parquet(path)
    df, seen = spark.read.parquet(path), np.zeros((20, 20))
    rounds = 60
    for seed in range(rounds):
        for r in sharding.hypergeometric_shuffle(df, 5, seed, chunk_rows=2).collect():
            seen[r["id"], 4 * r["shard"] + r["slot"]] += 1
    assert (seen.sum(axis=0) == rounds).all() and (seen.sum(axis=1) == rounds).all()
    assert ((seen - rounds / 20) ** 2 / (rounds / 20)).sum() < 361 + 5 * (2 * 361) ** 0.5


def test_hilbert_curve_is_continuous():
    cells = np.array([(x, y, z) for x in range(4) for y in range(4) for z in range(4)])
    key = hilbert.hilbert_key(cells, 2)
    assert len(set(key.tolist())) == 64 and np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(200)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, [0.0] * 8), (204, [float("nan")] + [0.0] * 7), (205, [None] + [1.0] * 7), rows[1]]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_nearest(spark):
    rows, df = vectors(spark)
    good = {i: np.array(v) for i, v in rows if v and all(x is not None and not math.isnan(x) for x in v) and any(v)}
    got = collections.defaultdict(list)
    for r in hilbert.nearest(df, df.filter("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    hits = 0
    for q in [i for i in good if i % 20 == 0]:
        best = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:5]
        assert len(got[q]) == 5
        hits += len({i for _, i in best} & set(got[q]))
    assert hits >= 0.9 * 5 * len(got)
    assert hilbert.nearest(df.filter("false"), df).count() == 0


def test_nearest_of_few(spark):
    v = np.random.default_rng(7).normal(size=(15, 8)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in hilbert.nearest(df, df, k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    found = sum(map(len, got.values()))
    assert found == 15 * 14
    for q in range(15):
        assert got[q] == sorted(set(range(15)) - {q}, key=lambda i: -float(v[q] @ v[i]))


def test_bit_sliced_top_k(spark):
    rows, df = vectors(spark)
    q = bsi.quantise(df)
    good = {i: [math.floor(64 * x) for x in v] for i, v in rows if v and all(x is not None and not math.isnan(x) for x in v)}
    got = collections.defaultdict(list)
    for r in bsi.top_k(q, q.filter("vec_id % 20 = 0"), 6).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for i in [i for i in good if i % 20 == 0]:
        best = sorted((-sum(a * b for a, b in zip(good[i], v)), j) for j, v in good.items() if j != i)[:6]
        assert got[i] == [(j, -s) for s, j in best]
    assert bsi.top_k(q.filter("false"), q).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = rng.integers(1, 33, int(rng.integers(1, 80))).tolist()
        bins = []
        for n in sorted(lengths, reverse=True):
            fit = [r for r in bins if r >= n]
            if fit:
                bins.remove(min(fit))
                bins.append(min(fit) - n)
            else:
                bins.append(32 - n)
        plan, opened = packing.best_fit_decreasing(collections.Counter(lengths), 32)
        assert opened == len(bins)
        used = collections.defaultdict(list)
        for n, c in collections.Counter(lengths).items():
            at, offset = packing.place(plan, np.full(c, n), np.arange(c))
            for b, o in zip(at.tolist(), offset.tolist()):
                used[b].append((o, n))
        for parts in used.values():
            end = 0
            for o, n in sorted(parts):
                assert o == end
                end += n
            assert end <= 32


def test_packing_tokens(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack_documents(docs, capacity=64).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, text in texts():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for r in by[i]:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in by[i]) == len(ids)
    assert packing.pack_documents(none).count() == 0


def test_arc_round_trip(spark):
    big = "x" * 150
    pages = spark.createDataFrame([(1, "http://a b/\n", big), (2, None, big), (3, "http://c", None), (4, "http://d", "HTTP\r\n\r\nWARC/1.1\r\n"), (5, "http://e", "short"), (6, "http://f", "short"), (1, "http://a", big), (0, "http://é", big)], "page_id long, url string, html string")
    arc, out = shared_path(spark, "arc"), shared_path(spark, "warc")
    warc.write_arc(pages, arc)
    warc.convert_arc(spark, arc, out)
    rows = [tuple(r) for r in warc.read_warc(spark, out).select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest").collect()]
    d = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    assert sorted(rows) == sorted([(0, "response", None, 150, d(big)), *[(i, "revisit", 0, 150, d(big)) for i in (1, 1, 2)], (3, "response", None, 0, d("")), (4, "response", None, 18, d("HTTP\r\n\r\nWARC/1.1\r\n")), (5, "response", None, 5, d("short")), (6, "response", None, 5, d("short"))])
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://x 1 2\nabc"))
    assert warc.read_arc(spark, arc).count() == 8
    warc.write_arc(pages.filter("false"), arc + "-none")
    warc.convert_arc(spark, arc + "-none", out + "-none")
    assert warc.read_warc(spark, out + "-none").count() == 0


def arc_file(version, *records):
    block = f"{version} 0 x\n{warc.ARC_TITLES[version]}\n\n".encode()
    more = " 200 - - 0 f" if version == 2 else ""
    parts = [f"filedesc://f 0.0.0.0 20200101 text/plain{more} {len(block)}\n".encode() + block + b"\n"]
    return [*parts, *(f"http://x 1.2.3.4 20200102030405 {kind}{more} {len(body)}\n".encode() + body + b"\n" for kind, body in records)]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [b"".join, lambda parts: gzip.compress(b"".join(parts)), lambda parts: b"".join(map(gzip.compress, parts))])
def test_archives_of_others(version, packed):
    records = [("text/html; charset=utf-8", b"HTTP/1.1 200 OK\nA: b\n\npay"), ("text/html", b"HTTP/1.1 200 OK\r\nA: b"), ("text/dns", b"no http"), ("text/html", b"HTTP/1.0 200 OK\r\n\r\n" + b"z" * 300_000)]
    got = list(warc.parse_arc(packed(arc_file(version, *records))))
    assert [(r["type"], r["head"] + r["payload"]) for r in got] == records
    assert [r["payload"] for r in got[:3]] == [b"pay", b"", b"no http"]
    first = {"page_id": 3, "url": "http://first", "date": "2019"}
    written = [warc.warc_record(r, "d", 7, first if r["head"] else None) for r in got]
    heads = [h.decode() for h, _ in warc.parse_warc(packed([warc.warc_opening(written[0]), *written]))]
    assert [re.search("WARC-Type: (.*)\r", h)[1] for h in heads] == ["warcinfo", "revisit", "revisit", "resource", "revisit"]
    assert "WARC-Refers-To-Target-URI: http://first\r\nWARC-Refers-To-Date: 2019-01-01T00:00:00Z" in heads[1] and "Content-Type: text/dns" in heads[3]
    assert warc.record_id(3, "http://first", "2019-01-01T00:00:00Z", "d") in heads[1]
    with pytest.raises(ValueError):
        list(warc.parse_arc(packed(arc_file(version, *records))[:-20]))


def test_near_duplicates(docs, none):
    sets = {}
    for i, t in texts():
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for r in forest.near_duplicates(docs).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert forest.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_crowded_region(spark, monkeypatch):
    # 140 shared and 30 other shingles a document: 140 / 200 in common; pairs share 6 of the others: 146 / 194
    template = " ".join(f"t{i}" for i in range(144))
    rows = [(2 * i + side, " ".join([template, *(f"p{i}x{k}" for k in range(6)), *(f"d{i}x{side}x{k}" for k in range(24))])) for i in range(800) for side in (0, 1)]
    monkeypatch.setattr(forest, "BLOCK_ROWS", 100)  # several blocks a region
    for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r["n_shingles"], r["component_id"]) == (170, r["doc_id"] // 2 * 2)


def test_near_duplicates_far_from_each_other_in_a_crowd(spark):
    # 1,000 near copies with a word of their own, and 30 documents that are linked (255 / 339) to one of them only
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join([*base, f"own{i}"])) for i in range(1000)]
    for j in range(30):
        gone = set(rng.choice(np.arange(0, 292, 8), 8, replace=False).tolist())
        rows.append((1000 + j, " ".join([*(f"x{j}y{k}" if k in gone else w for k, w in enumerate(base)), f"own{33 * j}"])))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    alone = {1000 + j for j in range(30) if not any(100 * len(sets[1000 + j] & s) >= 75 * len(sets[1000 + j] | s) for s in sets[:1000])}
    got = {r["doc_id"]: r["component_id"] for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in got if got[i] != 0 and i not in alone} == set() and {i for i in alone if got[i] == 0} == set()


def common_prefix(a: list[int], b: list[int]) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize(("chunk", "least", "often"), [(1 << 18, 1 << 12, 16), (3, 4, 1), (7, 8, 2)])
def test_suffix_order(monkeypatch, chunk, least, often):
    """Order and prefixes of all suffixes, with names sorted by pairs or by recursion, chunks and queues of any size, prefixes up to a depth."""
    for name, value in (("CHUNK", chunk), ("LEAST_NAMES", least), ("OFTEN", often)):
        monkeypatch.setattr(induced, name, value)
    rng = np.random.default_rng(3)
    for trial in range(40):
        t = rng.integers(0, 1 + trial % 4, int(rng.integers(0, 90))).astype(np.uint8)
        if trial % 3 == 0:
            t = np.tile(t, 2)
        texts = t.tolist()
        for depth, budget in ((1000, 1 << 20), (1000, 4), (1, 9), (10, 9)):
            order, lcp = induced.InducedSorter(t, depth, budget).sort_with_prefixes()
            heads = [texts[i : i + depth] for i in order]
            assert heads == sorted(heads) and sorted(order.tolist()) == list(range(len(t)))
            assert lcp.tolist() == [0] * (len(t) > 0) + [common_prefix(a, b) for a, b in zip(heads, heads[1:])]


def test_suffix_queues_go_to_disk(tmp_path):
    """A shard of many times the tuples that may wait in memory, by the query's own budget, sorts the same from files."""
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, int(n)).astype(np.uint8)) for n in rng.integers(2, 9, 400)]
    text = np.frombuffer(b" ".join(words[int(i)] for i in rng.integers(0, 400, 120_000)), np.uint8)
    outside = induced.InducedSorter(text, 100, suffixes.QUEUED_TUPLES, str(tmp_path))
    order, lcp = outside.sort_with_prefixes()
    assert len(text) > 8 * suffixes.QUEUED_TUPLES and outside.spilled > 0 and not list(tmp_path.iterdir())
    inside = induced.InducedSorter(text, 100, 1 << 24)
    assert all((a == b).all() for a, b in zip((order, lcp), inside.sort_with_prefixes())) and inside.spilled == 0
    raw = text.tobytes()
    heads = [raw[i : i + 100] for i in order]
    assert all(a <= b for a, b in zip(heads, heads[1:]))
    assert [a == b and len(a) == 100 for a, b in zip(heads, heads[1:])] == (lcp[1:] >= 100).tolist()


def test_repeats(docs, none):
    seen, wanted = set(), {}
    for i, t in texts():
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        wanted[i] = bytes(c for c, g in zip(raw, gone) if not g)
    for r in suffixes.remove_repeats(docs).collect():
        assert bytes(r["kept"]) == wanted[r["doc_id"]]
    assert suffixes.remove_repeats(none).count() == 0


def test_anchors_dont_depend_on_the_batch(monkeypatch):
    rng = np.random.default_rng(9)
    text = bytes(rng.integers(97, 101, 9000).astype(np.uint8))

    def by_string(texts):
        out = {}
        for key, _, which, start, run in zip(*suffixes.Anchors(100).find(texts)):
            for k in range(start, start + run):
                out.setdefault(texts[which][k : k + 100], set()).add(int(key))
        return out

    whole = by_string([text])
    assert len(whole) == 8901 and all(len(v) == 1 for v in whole.values())
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 1 << 10)
    assert by_string([b"", text[:50], text, text[100:300]]).keys() == whole.keys()
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 1 << 20)
    assert by_string([bytes(rng.integers(97, 101, 200_000).astype(np.uint8)), text])[text[:100]] == whole[text[:100]]


def test_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 1 << 10)
    rng = np.random.default_rng(10)
    passage = " ".join(rng.choice(WORDS, 50))
    long = " ".join(rng.choice(WORDS, 3000)) + passage + "q" * 700
    rows = [(1, passage), (2, long), (3, long), (3, long), (None, passage), (4, "word" * 500)]
    got = [(r["doc_id"], len(r["kept"])) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    # strings may overlap: of 700 equal letters all but the first go, of a period of four all but the first four
    assert sorted(got, key=str) == sorted([(1, len(passage)), (2, len(long) - len(passage) - 699), (3, 0), (3, 0), (4, 4), (None, 0)], key=str)


def test_stretches_without_a_repeated_string_are_not_sorted(monkeypatch):
    import random

    r = random.Random(1)
    for _ in range(200):
        monkeypatch.setattr(suffixes, "HASHED_BYTES", r.choice([10, 40, 1 << 18]))
        parts = [bytes(r.choice(r.choice([b"ab", b"cdefghijklmnop"])) for _ in range(r.randrange(5, 14))) for _ in range(r.randrange(9))]
        holders = {}
        for i, part in enumerate(parts):
            for at in range(len(part) - 4):
                holders.setdefault(part[at : at + 5], []).append(i)
        assert suffixes._may_repeat(parts, 5).tolist() == sorted({i for own in holders.values() if len(own) > 1 for i in own})


def test_repeats_of_a_hot_anchor(spark, monkeypatch):
    rng = np.random.default_rng(6)
    footer = " ".join(rng.choice(WORDS, 40))
    rows = [(i, f"{' '.join(rng.choice(WORDS, 30))} {footer} {' '.join(rng.choice(WORDS[:3], 12))}") for i in range(60)]
    sort, given = suffixes._sorted_repeats, []
    monkeypatch.setattr(suffixes, "SORT_BYTES", 2000)
    monkeypatch.setattr(suffixes, "_sorted_repeats", lambda docs, doubtful, length: given.append(doubtful) or sort(docs, doubtful, length))
    seen = set()
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        assert got[i] == bytes(c for c, g in zip(raw, gone) if not g)
    assert all(r["n"] <= 2000 for r in given[0].groupBy("anchor").agg(F.sum(F.col("run") + 99).alias("n")).collect())


def test_mixing(docs, none):
    assert mixing.water_fill([10, 100, 0], [1, 1, 3], 110) == [30.0, 80.0, 0.0]
    rows = mixing.plan_mix(mixing.size_documents(docs)).collect()
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for r in rows:
        assert abs(taken[r["source"]] - r["target"]) <= 60
    assert mixing.mix_sources(docs).columns == docs.columns
    assert mixing.mix_sources(none).count() == 0


def test_kneser_ney(docs, none):
    model = kneserney.train(docs)
    rows = {r["doc_id"]: r for r in kneserney.perplexity(docs, model).collect()}
    tok = lambda t: [*[w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")], None]
    counts = collections.Counter(w for _, t in texts() for w in tok(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in texts():
        assert rows[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t)))
        assert rows[i]["n_tokens"] == len(tok(t)) == rows[i]["n_known"]
    assert sum(r["score"] for r in rows.values()) > sum(r["base_score"] for r in rows.values())
    empty = kneserney.train(none)
    assert all(math.isfinite(r["score"]) for r in kneserney.perplexity(docs, empty).collect())


def plain_kneser_ney(train):
    """Log10 probability of a list of words (the end is None) by interpolated modified Kneser-Ney, straight from its definition."""
    pairs = collections.Counter((a, b) for words in train for a, b in zip(["<s>", *words], words))
    vocabulary = {w for words in train for w in words}
    follows = collections.Counter(b for _, b in pairs)  # how many contexts a word follows
    context = collections.Counter()
    for (a, _), c in pairs.items():
        context[a] += c

    def cuts(amounts):
        n = [sum(x == k for x in amounts) for k in range(1, 5)]
        if not all(n[:3]):
            return (0.5, 1.0, 1.5)
        y = n[0] / (n[0] + 2 * n[1])
        return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))

    high, low = cuts(pairs.values()), cuts(follows.values())
    cut = lambda d, c: d[min(c, 3) - 1] if c else 0.0
    left = sum(cut(low, c) for c in follows.values()) / len(pairs)

    def p(a, b):
        lower = max(follows[b] - cut(low, follows[b]), 0) / len(pairs) + left / (len(vocabulary) + 1)
        if not context[a]:
            return lower
        rest = sum(cut(high, c) for (x, _), c in pairs.items() if x == a) / context[a]
        return max(pairs[a, b] - cut(high, pairs[a, b]), 0) / context[a] + rest * lower

    return p, vocabulary, lambda words: sum(math.log10(p(a, b)) for a, b in zip(["<s>", *words], words))


def test_kneser_ney_scores(spark, docs):
    tok = lambda t: [*[w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")], None]
    taught = [t for i, t in texts() if i % 3]
    p, vocabulary, wanted = plain_kneser_ney([tok(t) for t in taught])
    model = kneserney.train(docs.filter("doc_id % 3 <> 0"))
    asked = [*texts(), (1000, "w1 never seen w2 seen never"), (1001, "unseen"), (1002, " \t"), (1003, (texts()[0][1] + " ") * 500)]
    got = kneserney.perplexity(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    assert len(got) == len(asked)
    for r in got:
        assert r["score"] == pytest.approx(wanted(tok(dict(asked)[r["doc_id"]])), rel=1e-9)
    for a in ("<s>", "w1", None, "never"):  # every known word and an unknown one: a distribution
        assert sum(p(a, b) for b in [*vocabulary, "never"]) == pytest.approx(1)


def test_toxicity():
    rng = np.random.default_rng(5)
    clean = [" ".join(rng.choice(WORDS, 30)) for _ in range(200)]
    toxic = [c + " " + " ".join(rng.choice(["grumbel", "snarkip", "blathor"], 2)) for c in clean[:60]]
    model = toxicity.fit(clean + toxic, [0] * 200 + [1] * 60)
    p = lambda t: float(model.probability(np.clip(toxicity.Scorer(model).top([t]), *toxicity.DECISIONS))[0])
    assert p("w1 w2 grumbel w5 snarkip") > 0.3 and p("w1 w2 g.r.u.m.b.e.l w5 s n a r k i p") > 0.3
    assert p("w1 w2 w3") < 0.3 and p("") < 0.3
    assert toxicity.fit([], []).constant == 0.0


def test_curves_decide(spark):
    # 5,000 vectors: 16 ranges a curve
    rng = np.random.default_rng(11)
    heads = rng.normal(size=(60, 24))
    v = (heads[rng.integers(0, 60, 5000)] + rng.normal(0, 0.5, (5000, 24))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in hilbert.nearest(df, df.filter("vec_id % 50 = 0"), k=20).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = sum(len(got[q] & set(sorted(set(range(5000)) - {q}, key=lambda i: -float(v[q] @ v[i]))[:20])) for q in range(0, 5000, 50))
    assert all(len(x) == 20 for x in got.values()) and hits >= 0.9 * 20 * 100


def test_one_text_in_two_sources(spark):
    rows = [(1, "a", "one two three")] * 2 + [(1, "b", "one two three"), (1, None, "one two three")] + [(i, "a", "x " * 50) for i in range(2, 30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = collections.Counter()
    for r in mixing.plan_mix(mixing.size_documents(df)).collect():
        plan[r["source"], r["doc_id"]] += r["copies"]
    got = collections.Counter((r["source"], r["doc_id"]) for r in mixing.mix_sources(df).collect())
    assert got == +plan and len({plan["a", 1] / 2, plan["b", 1], plan[None, 1]}) > 1


def test_buckets_are_of_one_size(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)
    seen = []
    monkeypatch.setattr(mixing, "_fill", lambda keyed: seen.append(keyed.groupBy("bucket").count().collect()) or keyed)
    sized = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 0.1).otherwise(1.0).alias("weight"), mixing.uniform_of(1, F.col("id")).alias("u"))
    mixing.plan_mix(sized)
    assert len(seen[0]) == 200 and max(r["count"] for r in seen[0]) < 200


@pytest.mark.parametrize("ids", ["null", "one", "own"])
def test_near_duplicates_without_ids(spark, ids):
    rng = np.random.default_rng(8)
    doc_id = lambda i: {"null": None, "one": i // 3, "own": i}[ids]
    far, near = [], []
    for i in range(20):
        words = [f"q{i}x{j}" for j in rng.integers(0, 10**6, 60)]
        other = [*words[:-11], *(f"z{i}y{j}" for j in range(11))]  # 45 of 67 shingles: 0.67
        far += [" ".join(words), " ".join(other)]
        near += [" ".join(words), " ".join([*words[:-5], *other[-5:]])]  # 51 of 61: 0.84
    for texts_, linked in ((far, 0), (near, 40)):
        for step in (1, 7):
            rows = [(doc_id(i), t) for i, t in enumerate(texts_)][::-1 if step == 7 else 1]
            df = spark.createDataFrame(rows, "doc_id long, text string").repartition(step)
            described = forest.describe(df)
            assert forest.link_classes(df, described).count() == linked


def test_too_many_words_raise(spark, monkeypatch):
    from terraloom.llm import kneserney

    monkeypatch.setattr(kneserney, "MOST_WORDS", 3)
    with pytest.raises(ValueError, match="distinct words"):
        kneserney.train(spark.createDataFrame([("a b c d",)], "text string"))


def test_classes_of_pairs_make_no_rows_for_ends(spark):
    from terraloom.llm.forest import ends

    found = ends(spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 9)], "a long, b long"))
    assert sorted(r["class"] for r in found.collect()) == [1, 2, 3, 9]
    assert "Generate" not in found._jdf.queryExecution().toString()


def test_words_of_ascii_texts_are_kept_in_one_case():
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Some some SOME", "x <|EndOfText|> Y", "x <|endoftext|> Y", "It'S DON'T\tA_B", "ÀB Some", ""]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    encoder.kept.clear()
    encoder.encode(texts[:1])
    assert list(encoder.kept) == ["some"]
