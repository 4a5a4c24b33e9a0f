"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Each node of a page has a hidden label: is it (or does it contain) main content? A node's features give it a potential, and
each parent and child share one that depends on both labels and on the child's kind. The page is a tree, so one pass of
sum-product messages upward and one downward give every node's exact marginal; text blocks whose marginal reaches one half
are the main text. Weights are fitted by gradient ascent on the likelihood of labelled pages, whose gradient needs the same
marginals.

Labelled pages are of two kinds: pages put together from labelled parts (below), and up to SELF_LABELLED pages of the corpus
that label themselves by article or main elements. Some are seen again with their telling names (elements, then classes as well)
taken away, so that what text and links look like must carry the label too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import materialize, table
from terraloom.llm.dom import FEATURES, SIGN_OF, SIGN_WORD, Page, main_blocks

#: Pages of the corpus that may be used as labelled pages, and the longest that are.
SELF_LABELLED, LONGEST_LABELLED = 120, 64_000
#: Pages put together from labelled parts.
COMPOSED = 400
#: Of so many labelled pages one is seen again without telling elements, and one without classes too.
PLAIN_ELEMENTS, PLAIN_PAGES = 4, 12
STEPS, RATE, SHRINK = 160, 0.15, 5e-5
THRESHOLD = 0.5
#: Bytes of html that a task parses before it sends messages through all trees of them.
BATCH_BYTES = 4 << 20

NAMES = len(FEATURES)
#: Weights: one a feature, then a table of four (parent label x child label) for child elements and one for text blocks.
SIZE = NAMES + 8


class Forest:
    """Trees of many pages, their nodes by depth."""

    def __init__(self, pages: list[Page]) -> None:
        sizes = [len(p.parent) for p in pages]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        parts = [np.array(p.parent, np.int64) for p in pages]
        self.parent = np.concatenate([np.where(q < 0, -1, q + s) for q, s in zip(parts, self.start[:-1], strict=True)])
        self.block = np.array([t is not None for p in pages for t in p.text])
        flat = [f for p in pages for f in p.features]
        self.node = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
        self.feature = np.fromiter((x for f in flat for x in f), np.int64)
        depth = [0] * len(flat)
        for i, q in enumerate(self.parent.tolist()):
            if q >= 0:
                depth[i] = depth[q] + 1
        depth = np.array(depth)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)

    def _tables(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.bincount(self.node, weights[self.feature], len(self.parent))
        return own, weights[NAMES:].reshape(2, 2, 2)[self.block.astype(int)]  # node x parent label x own label

    def marginals(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(label = 1) of each node, P(parent label, own label) of each node but roots, and the sum of log partition functions."""
        own, table_ = self._tables(weights)
        n = len(own)
        inside = np.zeros((n, 2))  # own potential and all messages from below
        inside[:, 1] = own
        message = np.zeros((n, 2))
        for level in reversed(self.levels[1:]):  # upward
            message[level] = np.logaddexp(table_[level, :, 0] + inside[level, None, 0], table_[level, :, 1] + inside[level, None, 1])
            np.add.at(inside, self.parent[level], message[level])
        outside = np.zeros((n, 2))  # all messages from above and beside
        for level in self.levels[1:]:  # downward
            above = self.parent[level]
            from_parent = outside[above] + inside[above] - message[level]
            outside[level] = np.logaddexp(table_[level, 0] + from_parent[:, :1], table_[level, 1] + from_parent[:, 1:])
        belief = inside + outside
        total = np.logaddexp(belief[:, 0], belief[:, 1])
        pair = np.zeros((n, 2, 2))
        low = np.concatenate(self.levels[1:]) if len(self.levels) > 1 else np.zeros(0, np.int64)
        above = self.parent[low]
        joint = (outside[above] + inside[above] - message[low])[:, :, None] + table_[low] + inside[low][:, None, :]
        pair[low] = np.exp(joint - total[low][:, None, None])
        return np.exp(belief[:, 1] - total), pair, float(total[self.levels[0]].sum())

    def likelihood(self, weights: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
        """Log likelihood of the labels, and its gradient."""
        own, table_ = self._tables(weights)
        p, pair, partition = self.marginals(weights)
        low = np.flatnonzero(self.parent >= 0)
        up = label[self.parent[low]]
        value = float((own * label).sum() + table_[low, up, label[low]].sum()) - partition
        gradient = np.bincount(self.feature, (label - p)[self.node], SIZE)
        seen = np.zeros((2, 2, 2))
        np.add.at(seen, (self.block[low].astype(int), up, label[low]), 1)
        for kind in (0, 1):
            seen[kind] -= pair[low[self.block[low] == kind]].sum(axis=0)
        gradient[NAMES:] = seen.ravel()
        return value, gradient


def fit(pages: list[Page]) -> np.ndarray:
    """Weights of the largest likelihood of the pages' labels less a penalty on their squares, by adaptive gradient steps."""
    forest = Forest(pages)
    label = np.array([x for p in pages for x in p.label])
    weights, mean, square = np.zeros(SIZE), np.zeros(SIZE), np.zeros(SIZE)
    for step in range(1, STEPS + 1):
        _, gradient = forest.likelihood(weights, label)
        gradient = gradient / len(label) - SHRINK * weights
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        weights = weights + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return weights


# Parts of labelled pages. $S is a sentence, $T a title, $L a few words, $P one to five sentences, $C a short remark,
# $D a date, $N a name. What stands below data-label="1" is main content, below data-label="0" isn't.
HEADS = """
<header><a href="/">$L</a><p>$L</p></header>
<header class="site-header"><div class="logo"><a href="/">$L</a></div><p class="tagline">$S</p></header>
<div id="header"><h1><a href="/">$L</a></h1><div>$L</div></div>
<div class="topbar">$L | <a href="/a">$L</a> | <a href="/b">$L</a></div>
""".strip().split("\n")
MENUS = """
<nav><ul><li><a href="/a">$L</a><li><a href="/b">$L</a><li><a href="/c">$L</a><li><a href="/d">$L</a></ul></nav>
<div id="menu"><a href="/a">$L</a> <a href="/b">$L</a> <a href="/c">$L</a></div>
<ul class="navigation"><li><a href="/a">$L</a></li><li><a href="/b">$L</a></li><li><a href="/c">$L</a></li></ul>
<div><a href="/a">$L</a> &raquo; <a href="/b">$L</a> &raquo; $T</div>
<table><tr><td><a href="/a">$L</a></td><td><a href="/b">$L</a></td><td><a href="/c">$L</a></td></tr></table>
""".strip().split("\n")
NOTICES = """
<div class="cookie-consent"><p>$S $S</p><button>$L</button></div>
<div id="gdpr" role="dialog"><p>$S</p><a href="/p">$L</a></div>
<div class="notice">$S</div>
<div class="alert alert-warning"><strong>$L</strong> $S</div>
<div class="modal popup"><h3>$T</h3><p>$S</p><form><input name="mail"><button>$L</button></form></div>
<section class="banner"><p>$S</p></section>
<noscript><p>$S</p></noscript>
""".strip().split("\n")
ADVERTS = """
<div class="ad">$S</div>
<div class="advertisement"><a href="/x">$L</a><p>$S</p></div>
<aside class="sponsored"><h4>$L</h4><p>$S $S</p></aside>
<div id="promo-box"><p>$P</p></div>
<ins class="adsbygoogle">$S</ins>
""".strip().split("\n")
SIDES = """
<aside><h3>$L</h3><ul><li><a href="/a">$T</a></li><li><a href="/b">$T</a></li><li><a href="/c">$T</a></li></ul></aside>
<div class="sidebar"><h4>$L</h4><p>$S</p><ul><li><a href="/a">$L</a> $D</li><li><a href="/b">$L</a> $D</li></ul></div>
<aside><p>$P</p></aside>
<div id="secondary" class="widget-area"><div class="widget"><h4>$L</h4><p>$S <a href="/m">$L</a></p></div></div>
<div><h3>$L</h3><ul><li><a href="/a">$T</a></li><li><a href="/b">$T</a></li></ul></div>
""".strip().split("\n")
FORMS = """
<form action="/s"><label>$L</label><input name="q"><button>$L</button></form>
<form class="newsletter"><h4>$T</h4><p>$S</p><input type="email"><input type="submit" value="go"></form>
<div class="login-form"><form><p>$L <input name="u"></p><p>$L <input name="p"></p><button>$L</button></form></div>
<form id="contact"><fieldset><legend>$L</legend><p>$S</p><textarea>$S</textarea></fieldset></form>
""".strip().split("\n")
COMMENTS = """
<section id="comments"><h3>$L</h3><div class="comment"><b>$N</b> <span>$D</span><p>$C</p></div><div class="comment"><b>$N</b><p>$C</p></div></section>
<div class="comments"><h2>$L</h2><ol class="commentlist"><li class="comment"><p>$N $L</p><p>$C</p><a href="/r">$L</a></li><li class="comment"><p>$N</p><p>$C</p></li></ol></div>
<div id="disqus_thread"><article class="comment"><header>$N, $D</header><p>$C</p></article><article class="comment"><header>$N</header><p>$P</p></article></div>
<ul class="replies"><li><strong>$N:</strong> $C</li><li><strong>$N:</strong> $C</li><li><strong>$N:</strong> $C</li></ul>
<div class="discussion"><p>$N: $C</p><p>$N: $C</p><form><input name="c"><button>$L</button></form></div>
<div class="reader-comments"><p>$C</p><p>$P</p><p>$C</p></div>
""".strip().split("\n")
FEET = """
<footer>&copy; example.org &middot; $S</footer>
<footer><p>&copy; 2020 $L. $L.</p><ul><li><a href="/a">$L</a></li><li><a href="/b">$L</a></li></ul></footer>
<div id="footer"><p>$S</p><p><a href="/p">$L</a> | <a href="/t">$L</a></p></div>
<div class="copyright">&copy; 2019 $N. $S</div>
<div><a href="/p">$L</a> <a href="/t">$L</a> &copy; 2021 $L</div>
""".strip().split("\n")
ASIDES = """
<div class="share"><a href="/f">$L</a> <a href="/t">$L</a></div>
<div class="related"><h4>$L</h4><ul><li><a href="/a">$T</a></li><li><a href="/b">$T</a></li></ul></div>
<nav class="toc"><ol><li><a href="#a">$L</a></li><li><a href="#b">$L</a></li></ol></nav>
<p class="tags"><a href="/a">$L</a> <a href="/b">$L</a> <a href="/c">$L</a></p>
""".strip().split("\n")
OPENINGS = """
<article>|</article>
<main>|</main>
<main><article>|</article></main>
<div id="content"><div class="post">|</div></div>
<div class="article-body" itemprop="articleBody">|</div>
<div class="entry-content">|</div>
<section class="story">|</section>
<div>|</div>
<div><div><div>|</div></div></div>
<table><tr><td>|</td></tr></table>
<div role="main">|</div>
""".strip().split("\n")
BODIES = """
<p>$P</p>
<p>$P</p>
<p>$P</p>
<p><b>$P<br>
<p>$S
<p>$L.</p>
<h2>$T</h2>
<h3>$L</h3>
<p>$S <a href="/x">$L</a> $S</p>
<ul><li>$S</li><li>$S</li><li>$L</li></ul>
<ol><li>$S<li>$S</ol>
<blockquote><p>$P</p></blockquote>
<blockquote>$S</blockquote>
<pre>$S</pre>
<figure><img src="i"><figcaption>$S</figcaption></figure>
<table><tr><th>$L</th><th>$L</th></tr><tr><td>$L</td><td>$L</td></tr></table>
<div>$P</div>
<section><h2>$T</h2><p>$P</p><p>$P</p></section>
""".strip().split("\n")
SYLLABLES = "an be co du er fi gon hal in ka lo men nor os pre qui ren sto ta un ver wi xa yo zen".split()


class Composer:
    """Pages put together from the parts above, the same in every run."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def words(self, least: int, most: int) -> str:
        return " ".join("".join(self.rng.choice(SYLLABLES, self.rng.integers(1, 4))) for _ in range(self.rng.integers(least, most + 1)))

    def sentence(self, least: int = 5, most: int = 24) -> str:
        words = self.words(least, most).capitalize()
        cut = words.find(" ", len(words) // 2)
        return f"{words[:cut]},{words[cut:]}." if cut > 0 and self.rng.random() < 0.4 else f"{words}."

    def sentences(self, least: int, most: int) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.integers(least, most + 1)))

    def filled(self, part: str) -> str:
        out = part.split("$")
        made = {
            "S": self.sentence, "P": lambda: self.sentences(1, 5), "T": lambda: self.words(3, 10).capitalize(), "L": lambda: self.words(1, 3).capitalize(),
            "C": lambda: self.sentences(1, 3), "N": lambda: self.words(1, 2).title(), "D": lambda: f"{self.rng.integers(1, 29)}.{self.rng.integers(1, 13)}.20{self.rng.integers(10, 30)}",
        }
        return out[0] + "".join(made[x[0]]() + x[1:] for x in out[1:])

    def some(self, parts: list[str], chance: float) -> str:
        return self.filled(str(self.rng.choice(parts))) if self.rng.random() < chance else ""

    def page(self) -> str:
        body = [self.filled(str(self.rng.choice(BODIES))) for _ in range(int(self.rng.integers(1, 3) if self.rng.random() < 0.3 else self.rng.integers(3, 14)))]
        if self.rng.random() < 0.8:
            body.insert(0, self.filled("<h1>$T</h1>"))
        apart = [f'<div data-label="0">{self.some(x, 1)}</div>' if self.rng.random() < 0.3 else self.some(x, 1).replace(">", ' data-label="0">', 1) for x in (ASIDES, ADVERTS, FORMS, COMMENTS, NOTICES, SIDES) if self.rng.random() < 0.15]
        for x in apart:
            body.insert(int(self.rng.integers(1, len(body) + 1)), x)
        before, after = str(self.rng.choice(OPENINGS)).split("|")
        main = before.replace(">", ' data-label="1">', 1) + "".join(body) + after
        outer = self.rng.random() < 0.4
        out = [self.some(NOTICES, 0.3), self.some(HEADS, 0.6), self.some(MENUS, 0.8), self.some(FORMS, 0.2), self.some(ADVERTS, 0.4), self.some(SIDES, 0.2)]
        out += [("<div>" if outer else "") + main, self.some(ASIDES, 0.3), self.some(SIDES, 0.4), self.some(COMMENTS, 0.5), self.some(FORMS, 0.2), "</div>" if outer else "", self.some(NOTICES, 0.2), self.some(FEET, 0.9)]
        return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(out) + "</body></html>"


def given_label(name: str, attributes: dict) -> int | None:
    """The label that a composed page carries."""
    return int(attributes["data-label"]) if "data-label" in attributes else None


#: Elements that are none of the article even within it, for pages that label themselves.
APART = frozenset("nav aside footer form".split())
#: Signs that say the same.
APART_SIGNS = frozenset("comment side menu foot advert notice share related form".split())


def own_label(name: str, attributes: dict) -> int | None:
    """The label that a page gives itself: article, main and their roles are content, what is set apart in them isn't."""
    said = {SIGN_OF.get(w.lower()) for w in SIGN_WORD.findall(" ".join(attributes.get(k, "") for k in ("class", "id", "role")))}
    if name in APART or said & APART_SIGNS:
        return 0
    if name in ("article", "main") or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody":
        return 1
    return None


SELF_LABEL = r"(?i)<(?:article|main)\b|role\s*=\s*.?(?:main|article)\b|itemprop\s*=\s*.?articleBody"
TELLING = frozenset("article main nav aside footer header section form dialog".split())


def plain_elements(name: str, attributes: dict) -> tuple[str, dict]:
    """Telling elements look like div."""
    return ("div" if name in TELLING else name), attributes


def plain_page(name: str, attributes: dict) -> tuple[str, dict]:
    """And classes are gone as well."""
    return plain_elements(name, {})


def labelled(htmls: list[str], label_of) -> list[Page]:
    plain = [Page(h, label_of, plain_elements) for h in htmls[::PLAIN_ELEMENTS]] + [Page(h, label_of, plain_page) for h in htmls[::PLAIN_PAGES]]
    return [Page(h, label_of) for h in htmls] + plain


def composed(n: int = COMPOSED, seed: int = 13) -> list[str]:
    maker = Composer(seed)
    return [maker.page() for _ in range(n)]


def train(pages: DataFrame) -> np.ndarray:
    """Weights from composed pages and at most SELF_LABELLED pages of the corpus, those of the smallest hash among the shorter ones.

    Fitted in one task, as what it reads is bounded; one row of SIZE numbers comes back.
    """
    own = pages.filter(F.col("html").rlike(SELF_LABEL) & (F.length("html") <= LONGEST_LABELLED)).select("html", F.xxhash64("html").alias("h"))
    first = own.select("h").distinct().orderBy("h").limit(SELF_LABELLED)
    chosen = own.join(F.broadcast(first), "h").groupBy("h").agg(F.min("html").alias("html"))  # only hashes and chosen pages are shuffled
    found = chosen.groupBy().agg(F.sort_array(F.collect_list("html")).alias("html"))  # one row, bounded by the two above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for htmls in batch.column(0).to_pylist():
                known = labelled(composed(), given_label) + labelled(htmls, own_label)
                yield pa.RecordBatch.from_arrays([pa.array([fit(known).tolist()])], names=["w"])

    # written, so that every later use has one model
    return np.array(materialize(found.mapInArrow(run, "w array<double>"), "dom-model").collect()[0]["w"])


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars.

    Null html counts as empty; a page without content has an empty text; null ids and urls are passed on; rows that repeat
    are extracted each; other columns are ignored. Pages of any length are read whole; those of a batch share one pass of messages.
    """

    def read(rows: list) -> pa.RecordBatch:
        parsed = [Page(html or "") for _, _, html in rows]
        forest = Forest(parsed)
        chosen = forest.marginals(weights)[0] >= THRESHOLD
        text = [main_blocks(p, chosen[a:b]) for p, a, b in zip(parsed, forest.start[:-1], forest.start[1:], strict=True)]
        ids, urls, _ = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                row = tuple(batch.column(c)[i].as_py() for c in range(3))
                rows.append(row)
                held += len(row[2] or "")
                if held >= BATCH_BYTES:
                    yield read(rows)
                    rows, held = [], 0
            if rows:
                yield read(rows)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
