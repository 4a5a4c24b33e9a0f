"""Divergence, clustering and page extraction against plain implementations."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import contentmodel, divergence, yinyang
from terraloom.llm.common import shared_path
from terraloom.llm.dom import AT, Page

# ---- op11


def plain_audit(rows, least, top):
    """The contract, word by word."""
    rows = [(t or "", la or "", so or "") for t, la, so in rows]
    occurs, docs = defaultdict(Counter), defaultdict(Counter)
    for t, la, so in rows:
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
        occurs[la, so].update(found)
        docs[la].update(set(found))
    out = []
    for lang in {la for _, la, _ in rows}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        sources = sorted({so for _, la, so in rows if la == lang})
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 1) // (sum(counts[x] for x in kept) + len(kept)) for t in kept}
        p = {so: share(occurs[lang, so]) for so in sources}
        every = share(sum((occurs[lang, so] for so in sources), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for so in sources:
            pairs = [("pair", other, sum(f(p[so][t], p[other][t]) for t in kept)) for other in sources if other != so]
            terms = [("term", t, f(p[so][t], every[t])) for t in kept if occurs[lang, so][t] and p[so][t] > every[t]]
            for some, most in ((pairs, None), (terms, top)):
                some.sort(key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, so, *x, i + 1) for i, x in enumerate(some[:most])]
    return sorted(out)


def audit_rows():
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in ("a", "ab", "É", "ünder", "Zz", "the", "THE", "漢字", "𝒳y") for b in ("", "x", "é", "Q", "xx", "zé")]
    rows = [(" ".join(rng.choice(words, int(n))) + rng.choice([" 7!", "'s", ""]), f"l{i % 3}", None if i % 7 == 0 else f"s{i % 4}") for i, n in enumerate(rng.integers(0, 60, 70))]
    return [*rows, rows[0], rows[0], (None, "l0", "s9"), ("", None, "only"), ("12 34", "l4", "a"), ("56", "l4", "b"), ("one", "l4", "b"), ("a " * 5000, "l1", "s1")]


@pytest.mark.parametrize("open_rows", [2_000, 1])
def test_audit(spark, monkeypatch, open_rows):
    monkeypatch.setattr(divergence, "OPEN_ROWS", open_rows)
    rows = audit_rows()
    df = spark.createDataFrame([(i, *r, "z") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string").repartition(5)
    for least, top in ((3, 5), (1, 200)):
        got = sorted(tuple(r) for r in divergence.audit(df, least, top).collect())
        assert got == plain_audit(rows, least, top)
    assert divergence.audit(df.filter("false")).collect() == []


def test_radix_selection_of_ties(spark, monkeypatch):
    monkeypatch.setattr(divergence, "OPEN_ROWS", 3)
    # one value, names that begin alike and end early
    names = ["a" * n for n in range(1, 40)] + [f"aaaa{c}" for c in "bcdé漢"] + ["b"]
    rows = [(g, n, v) for g in ("hot", None) for n in names for v in ([5] if n != "b" else [9])]
    df = spark.createDataFrame(rows, "g string, item string, value long")
    path = shared_path(spark, "ties")
    df.write.parquet(path)
    got = divergence.radix_top(spark.read.parquet(path), ["g"], "value", "item", 7).collect()
    want = sorted(((9 if n == "b" else 5), n) for n in names)
    want = [n for _, n in sorted(((-v, n.encode()) for v, n in want))][:7]
    for g in ("hot", None):
        assert [r["item"].encode() for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == want


def test_terms_of_long_texts(monkeypatch):
    text = ("Word über x1y " * 3000).encode()
    whole = divergence._terms(text)
    monkeypatch.setattr(divergence, "TEXT_BYTES", 7)
    assert divergence._terms(text) == whole == Counter({b"word": 3000, "über".encode(): 3000, b"x": 3000, b"y": 3000})
    assert divergence._terms(b"") == Counter() and divergence._terms(b"q" * 50) == Counter({b"q" * 50: 1})


def test_shares_of_huge_counts(spark):
    n = 10**14
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(3 * n), F.lit(5)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 1) // (3 * n + 5)


# ---- op12


def plain_clusters(rows, k=40, rounds=5, seed=2, width=64):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: ((0, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()) if r[0] is not None else (1, ""), r[1]))[:k]
    centres = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    ended = [(i, *near(v)) for i, v in kept]
    sums = Counter()
    for _, d, j in ended:
        sums[j] += d
    return sorted(((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in ended), key=str)


def vectors(n=260, seed=1):
    rng = np.random.default_rng(seed)
    heads = rng.normal(0, 0.4, (30, 64))
    rows = [(i, (heads[i % 30] + rng.normal(0, 0.15, 64)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (900, rows[7][1]), (None, rows[8][1]), (901, None), (902, [1.0] * 63), (903, [None] + [1.0] * 63)]
    return [*rows, (904, [float("nan")] + [0.0] * 63), (905, [float("-inf")] + [0.0] * 63), (906, [0.0] * 64), (907, [-0.001] * 64), (908, [])]


@pytest.mark.parametrize("n, k", [(260, 40), (9, 40), (60, 7)])
def test_clusters(spark, n, k):
    rows = vectors(n)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, label int").repartition(3)
    got = yinyang.cluster(yinyang.whole_numbers(df), k=k)
    want = plain_clusters(rows, k)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert yinyang.cluster(yinyang.whole_numbers(df.filter("false"))).collect() == []


def test_equal_vectors_and_ties(spark):
    rows = [(i, [0.25 * (i % 3)] * 64) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = yinyang.cluster(yinyang.whole_numbers(df)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(rows)


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(5)
    heads = rng.integers(-400, 400, (40, 64))
    v = heads[rng.integers(0, 40, 4000)] + rng.integers(-120, 120, (4000, 64))
    c = v[:40].copy()
    of = yinyang.grouped(c, 4)
    cluster, upper, lower = yinyang.assign(v, c, of)
    taken = 0
    for _ in range(6):
        new = np.stack([v[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else c[j] for j in range(40)])
        drift = np.sqrt(((new - c) ** 2).sum(axis=1).astype(float))
        c = new
        cluster, upper, lower, n = yinyang.reassign(v, c, drift, of, cluster, upper, lower)
        taken += n
        d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        assert (cluster == d.argmin(axis=1)).all()
        root = np.sqrt(d.astype(float))
        assert (upper >= root[np.arange(4000), cluster]).all()
        root[np.arange(4000), cluster] = np.inf
        for g in range(of.max() + 1):
            assert (lower[:, g] <= root[:, of == g].min(axis=1)).all()
    assert taken < 0.3 * 6 * 4000 * 40


def test_components_too_large(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        yinyang.cluster(yinyang.whole_numbers(df)).collect()


# ---- op13


def texts_of(html):
    return [t for t in Page(html).text if t is not None]


@pytest.mark.parametrize(
    "html, blocks",
    [
        ("<p>a<b>b</b> c<p>d", ["ab c", "d"]),
        ("<p><b>One<br><p>two</p>", ["One", "two"]),
        ("x<div>y<!-- <p>no --> z</div>w", ["x", "y z", "w"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>1<td>2<tr><th>3</table>", ["1", "2", "3"]),
        ('<script>var t="</p><p>no";</script><style>p{}</style><title>t</title>yes', ["yes"]),
        ("<textarea><p>no</textarea><select><option>no</select>yes<noscript><p>no</p></noscript>", ["yes"]),
        ("a &amp; b&nbsp;&nbsp;&#99;\n\t d &lt;p&gt; &bogus; 1 < 2", ["a & b c d <p> &bogus; 1 < 2"]),
        ('<p title="a>b">x</p><p title=\'>\'>y</p><a href=x>z', ["x", "y", "z"]),
        ("</div></p>a</b></ul>b<script>open", ["ab"]),
        ("<p>a<hr>b<h1>c<h2>d</h2>", ["a", "b", "c", "d"]),
        ("<my-box>a</my-box>b<pre> c\n  d </pre>", ["a", "b", "c d"]),
        ("<![CDATA[no]]><!DOCTYPE html><?xml?>a<", ["a<"]),
        ("", []),
        (" \n<p> </p>", []),
    ],
)
def test_blocks(html, blocks):
    assert texts_of(html) == blocks


def test_deep_and_long_pages():
    deep = Page("<div>" * 5000 + "x" + "<b>" * 5000 + "y" + "</i></section>" * 5000)
    assert [t for t in deep.text if t] == ["xy"] and len(deep.parent) == 5002
    assert texts_of("<p>" + "word " * 200_000)[0].count("word") == 200_000
    assert texts_of('<p title="' + "<a " * 20_000) == []


def plain_marginals(forest, weights):
    n = len(forest.parent)
    own = np.bincount(forest.node, weights[forest.feature], n)
    tables = weights[contentmodel.NAMES :].reshape(2, 2, 2)
    total, at = 0.0, np.zeros(n)
    for labels in itertools.product((0, 1), repeat=n):
        score = sum(own[i] * labels[i] + (tables[int(forest.block[i]), labels[q], labels[i]] if (q := forest.parent[i]) >= 0 else 0) for i in range(n))
        total += np.exp(score)
        at += np.exp(score) * np.array(labels)
    return at / total, np.log(total)


def test_messages_give_exact_marginals_and_gradients():
    pages = [Page("<nav><a>m</a></nav><main><h1>t</h1><p>Some text, here.</main>"), Page("<ul><li>a<li>b</ul>"), Page("")]
    rng = np.random.default_rng(2)
    weights = rng.normal(0, 1, contentmodel.SIZE)
    parts = [plain_marginals(contentmodel.Forest([p]), weights) for p in pages]
    forest = contentmodel.Forest(pages)
    p, _, partition = forest.marginals(weights)
    assert np.allclose(p, np.concatenate([x for x, _ in parts])) and np.isclose(partition, sum(z for _, z in parts))
    label = rng.integers(0, 2, len(p))
    value, gradient = forest.likelihood(weights, label)
    for i in [AT["b:any"], AT["e:nav"], AT["b:sentence"], *range(contentmodel.NAMES, contentmodel.SIZE)]:
        step = np.zeros_like(weights)
        step[i] = 1e-6
        assert np.isclose((forest.likelihood(weights + step, label)[0] - value) / 1e-6, gradient[i], atol=1e-4)


def held_out():
    return contentmodel.composed(120, seed=99)


@pytest.fixture(scope="module")
def page_rows():
    shop = '<header>Shop | <a href="/">home</a></header>'
    story = "<article><h1>A title</h1><p>First words, of some length, are here.</p><p>Second &amp; last of them.</article>"
    talk = '<section id="comments"><div class="comment"><p>I do not agree with this at all.</p></div></section>'
    rows = [(1, "u1", f"<body>{shop}{story}{talk}<footer>&copy; x</footer></body>", "t"), (2, None, None, None), (3, "u3", "", "n"), (None, "u4", f"<body><nav><a>m</a></nav>{story}"[:-10], "x")]
    rows += [(5, "u5", "<nav><ul><li><a href=a>one</a><li><a href=b>two</a></ul></nav>", ""), rows[0]]
    return rows + [(100 + i, "c", h, "") for i, h in enumerate(held_out())]


def test_pages(spark, page_rows, tmp_path):
    df = spark.createDataFrame(page_rows, "page_id long, url string, html string, text string")
    df.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    rows = contentmodel.op13_html(spark, str(tmp_path)).collect()
    assert len(rows) == len(page_rows) and all(r["n_chars"] == len(r["text"]) for r in rows)
    got = defaultdict(list)
    for r in rows:
        got[r["page_id"]].append((r["url"], r["text"]))
    story = "A title\nFirst words, of some length, are here.\nSecond & last of them."
    assert got[1] == [("u1", story)] * 2 and got[2] == [(None, "")] and got[3] == [("u3", "")] and got[None] == [("u4", story)] and got[5] == [("u5", "")]
    right = found = wanted = 0
    for i, html in enumerate(held_out()):
        page = Page(html, contentmodel.given_label)
        want = Counter(t for t, x in zip(page.text, page.label) if t and x)
        have = Counter(got[100 + i][0][1].split("\n")) - Counter([""])
        right, found, wanted = right + (want & have).total(), found + have.total(), wanted + want.total()
    assert right / found > 0.98 and right / wanted > 0.98
    assert contentmodel.extract(df.filter("false"), np.zeros(contentmodel.SIZE)).collect() == []


def test_pages_of_the_table(spark, sf_dir):
    # these pages have an article each: whatever else they hold isn't main text
    for r in contentmodel.op13_html(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        page = Page(r["html"], contentmodel.own_label)
        assert r["text"] == "\n".join(t for t, x in zip(page.text, page.label) if t is not None and x)


def test_queries_of_audit_and_clusters(spark, tmp_path):
    docs = [(i, *r) for i, r in enumerate(audit_rows())]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in divergence.op11_divergence(spark, str(tmp_path)).collect()) == plain_audit([r[1:] for r in docs], 3, 200)
    spark.createDataFrame(vectors(), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted((tuple(r) for r in yinyang.op12_yinyang(spark, str(tmp_path)).collect()), key=str) == plain_clusters(vectors())
