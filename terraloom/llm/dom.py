"""Web pages as trees of block elements and text blocks, and the features of their nodes.

A text block is a run of text between two borders of block elements; inline markup doesn't end it. Its references are
decoded and its white space is one space. What a browser doesn't show as text (scripts, styles, comments, titles, choices of
lists, embedded frames) is no text here. End tags that are left out are supplied as browsers do for paragraphs, list items,
table cells and headings; other mistakes close what they can and never raise.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

# Element names by their role in HTML.
BLOCKS = frozenset(
    "html body div section article main nav header footer aside form fieldset ul ol menu li dl dt dd table thead tbody tfoot tr td th caption p h1 h2 h3 h4 h5 h6 "
    "blockquote pre figure figcaption address details summary dialog center hgroup search legend head hr".split()
)
UNSEEN = frozenset("script style template noscript iframe noembed noframes object svg math canvas select datalist textarea title audio video xmp".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("table td th caption html object button dialog".split())
#: What an opening tag ends, and the elements beyond which it doesn't reach.
ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("thead tbody tfoot", "table"), "thead": ("thead tbody tfoot", "table"), "tfoot": ("thead tbody tfoot", "table"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}

# Words of class, id, role and itemprop that tell what an element is for.
SIGNS = {
    "comment": "comment comments commentlist reply replies respond disqus discussion thread feedback reviews responses",
    "side": "sidebar side aside rail widget widgets secondary complementary",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs pagination pager toc tabs skip sitemap",
    "foot": "footer foot copyright colophon contentinfo legal imprint",
    "head": "header masthead topbar branding logo banner",
    "advert": "ad ads advert adverts advertisement adsense advertising sponsor sponsored promo promotion promoted dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay paywall toast disclaimer warning message announcement",
    "share": "share sharing social follow tweet facebook twitter",
    "related": "related recommended recommendations suggested trending popular latest next teaser",
    "form": "form search login signin signup subscribe subscription newsletter contact",
    "content": "content article post entry story body text main prose articlebody",
    "meta": "byline author date meta tags category categories timestamp",
}
#: Elements that say the same by their name.
TAG_SIGNS = {"nav": "menu", "aside": "side", "footer": "foot", "header": "head", "form": "form", "article": "content", "main": "content"}
SIGN_OF = {word: sign for sign, words in SIGNS.items() for word in words.split()}

TAG_NAMES = (
    "html body div section article main nav header footer aside form fieldset ul ol menu li dl dt dd table tr td p h1 h2 h3 blockquote pre figure figcaption address details dialog".split()
)
WORD_STEPS = (2, 5, 10, 20, 60)
CHAR_STEPS = (1, 30, 120, 500, 2000)
LINK_STEPS = (0.01, 0.2, 0.5, 0.9)

#: All features; those of a text block begin with "b:", those of an element with "e:".
FEATURES = (
    ["e:any", "b:any", "e:other", "e:hidden", "b:sentence", "b:comma", "b:copyright", "b:control", "b:time", "e:control"]
    + [f"e:{t}" for t in TAG_NAMES] + [f"b:in {t}" for t in [*TAG_NAMES, "other"]]
    + [f"e:{s}" for s in SIGNS] + [f"b:{s}" for s in SIGNS] + [f"b:under {s}" for s in SIGNS]
    + [f"b:words {i}" for i in range(len(WORD_STEPS) + 1)] + [f"b:links {i}" for i in range(len(LINK_STEPS) + 1)]
    + [f"e:chars {i}" for i in range(len(CHAR_STEPS) + 1)] + [f"e:links {i}" for i in range(len(LINK_STEPS) + 1)] + [f"e:words {i}" for i in range(len(WORD_STEPS) + 1)]
)
AT = {name: i for i, name in enumerate(FEATURES)}

MARKUP = re.compile(
    r"<(?:!--(?:(?!-->).)*+(?:-->|\Z)|!\[CDATA\[(?:(?!\]\]>).)*+(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|/(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|(?P<start>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SIGN_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TIME = re.compile(r"\d{1,2}:\d\d|\b(?:19|20)\d\d\b")


def step_of(value: float, steps: tuple) -> int:
    return sum(value >= s for s in steps)


class Page:
    """Nodes in page order, parents before children: parent (-1 for the root), features, text (None for elements) and label.

    label_of(name, attributes) gives a known label (0 or 1) for what is below an element, or None to inherit; it is used for
    training. rename(name, attributes) may change how an element looks to the features.
    """

    def __init__(self, html: str, label_of=None, rename=None) -> None:
        self.parent, self.text, self.features, self.label = [-1], [None], [[]], [0]
        self.kind, self.blocks = ["html"], []
        self.under: list[frozenset] = [frozenset()]  # the signs of a node and of all that it is in
        self.label_of, self.rename = label_of, rename
        #: of each open element: name, node (None if inline), the label of what is below, whether it is a link, signs, control
        self.stack = [("html", 0, 0, False, frozenset())]
        self.above = [0]  # the nodes among them
        self.open: Counter = Counter()
        self.links = self.unseen = 0
        self.pieces: list[str] = []
        self.linked = self.controls = 0
        self.signs: Counter = Counter()
        self.piece_label = 0
        self._read(html)
        self._flush()
        self._measure()

    def _node(self, parent: int, kind: str, text: str | None, features: list[int], label: int, signs: frozenset = frozenset()) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.under.append(self.under[parent] | signs)
        self.text.append(text)
        self.features.append(features)
        self.label.append(label)
        return len(self.parent) - 1

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self._say(html[at:lt])
            if lt == n:
                break
            tag = MARKUP.match(html, lt)
            if not tag:  # a bare "<"
                self._say("<")
                at = lt + 1
                continue
            at = tag.end()
            if tag["end"]:
                self._end(tag["end"].lower())
            elif tag["start"]:
                name = tag["start"].lower()
                self._start(name, tag["attributes"])
                if name in RAW and not tag["attributes"].endswith("/"):
                    closer = CLOSERS[name].search(html, at)
                    at = closer.start() if closer else n

    def _say(self, raw: str) -> None:
        if self.unseen or not raw:
            return
        self.pieces.append(unescape(raw) if "&" in raw else raw)
        size = len(raw) - raw.count(" ")
        if self.links:
            self.linked += size
        name, _, label, _, signs = self.stack[-1]
        if not raw.isspace():
            self.piece_label = max(self.piece_label, label)
            for s in signs:
                self.signs[s] += size

    def _flush(self) -> None:
        """The text since the last border becomes a block of the innermost block element."""
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                parent = self.above[-1]
                kind = self.kind[parent]
                words, chars = text.count(" ") + 1, max(1, len(text) - text.count(" "))
                share = min(1.0, self.linked / chars)
                f = ["b:any", f"b:in {kind if kind in TAG_NAMES else 'other'}", f"b:words {step_of(words, WORD_STEPS)}", f"b:links {step_of(share, LINK_STEPS)}"]
                f += [f"b:{s}" for s, size in self.signs.items() if 2 * size >= chars]
                f += [f"b:under {s}" for s in self.under[parent]]
                f += ["b:sentence"] * (text[-1] in ".!?…。！？:\"”»") + ["b:comma"] * (", " in text) + ["b:copyright"] * ("©" in text) + ["b:control"] * (self.controls > 0)
                f += ["b:time"] * (words < 12 and TIME.search(text) is not None)
                node = self._node(parent, "#text", text, [AT[x] for x in f], self.piece_label)
                self.blocks.append((node, words, chars, share * chars))
        self.pieces, self.linked, self.controls, self.piece_label = [], 0, 0, 0
        self.signs.clear()

    def _pop(self, depth: int) -> None:
        """Closes all open elements from this depth on."""
        nodes = sum(e[1] is not None for e in self.stack[depth:])
        if nodes:
            self._flush()
            del self.above[-nodes:]
        for name, _, _, link, _ in self.stack[depth:]:
            self.open[name] -= 1
            self.links -= link
            self.unseen -= name in UNSEEN
        del self.stack[depth:]

    def _close(self, names: frozenset, borders: frozenset) -> None:
        """Closes the innermost of these names unless a border is above it."""
        if not any(self.open[x] for x in names):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self.stack[depth][0]
            if name in names:
                self._pop(depth)
                return
            if name in borders:
                return

    def _start(self, name: str, raw: str) -> None:
        if name == "br":
            self._say(" ")
            return
        if name in ("html", "body", "head") and self.open[name]:
            return
        block = name in BLOCKS or "-" in name
        if block and not self.unseen:
            self._flush()
            if name in HEADINGS and self.stack[-1][0] in HEADINGS:
                self._pop(len(self.stack) - 1)
            self._close(frozenset(["p"]), SCOPES)
            if name in ENDS:
                self._close(*ENDS[name])
            if name == "body":
                self._close(frozenset(["head"]), SCOPES)
        if name in ("input", "button", "select", "textarea"):
            self.controls += 1
        if name in VOID:
            return
        attributes = {k.lower(): unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}
        label = self.stack[-1][2]
        if self.label_of:
            given = self.label_of(name, attributes)
            label = label if given is None else given
        shown, seen = (name, attributes) if not self.rename else self.rename(name, attributes)
        said = " ".join(seen.get(k, "") for k in ("class", "id", "role", "itemprop") if k in seen)
        signs = frozenset(SIGN_OF[w] for x in SIGN_WORD.findall(said) if (w := x.lower()) in SIGN_OF) if said else frozenset()
        node = None
        if block and not self.unseen:
            parent = self.above[-1]
            if shown in TAG_SIGNS:
                signs |= {TAG_SIGNS[shown]}
            f = ["e:any", f"e:{shown}" if shown in TAG_NAMES else "e:other", *(f"e:{s}" for s in signs)]
            if "hidden" in seen or seen.get("aria-hidden") == "true" or HIDDEN_STYLE.search(seen.get("style", "")):
                f.append("e:hidden")
            node = self._node(parent, shown, None, [AT[x] for x in f], 0, signs)
            self.above.append(node)
            signs = frozenset()  # they belong to the element, not to its text
        elif self.stack[-1][1] is None:
            signs |= self.stack[-1][4]  # inline elements in inline ones
        self.stack.append((name, node, label, name == "a", signs))
        self.open[name] += 1
        self.links += name == "a"
        self.unseen += name in UNSEEN

    def _end(self, name: str) -> None:
        if not self.open[name] or name in ("html", "body"):
            if name in ("p", "br"):
                self._flush() if name == "p" else self._say(" ")
            return
        inline = name not in BLOCKS and "-" not in name and name not in UNSEEN
        for depth in range(len(self.stack) - 1, 0, -1):
            other, node, *_ = self.stack[depth]
            if other == name or (name in HEADINGS and other in HEADINGS):
                self._pop(depth)
                return
            if (inline and node is not None) or (other in SCOPES and not inline and name not in SCOPES and name not in ("tr", "tbody", "thead", "tfoot", "form")):
                return

    def _measure(self) -> None:
        """Features of elements from what is below them: size, links, words a block; labels likewise."""
        n = len(self.parent)
        chars, linked, words, count = [0.0] * n, [0.0] * n, [0] * n, [0] * n
        for node, w, c, share in self.blocks:
            chars[node], linked[node], words[node], count[node] = c, share, w, 1
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            words[p] += words[i]
            count[p] += count[i]
            self.label[p] = max(self.label[p], self.label[i])  # an element is content if anything below it is
        for i in range(n):
            if self.text[i] is None:
                share = linked[i] / chars[i] if chars[i] else 0.0
                mean = words[i] / count[i] if count[i] else 0
                f = [f"e:chars {step_of(chars[i], CHAR_STEPS)}", f"e:links {step_of(share, LINK_STEPS)}", f"e:words {step_of(mean, WORD_STEPS)}"]
                self.features[i] = self.features[i] + [AT[x] for x in f]
        self.features[0] = self.features[0] + [AT["e:any"], AT["e:html"]]


def main_blocks(page: Page, chosen) -> str:
    """The texts of the chosen blocks in page order, a line each."""
    return "\n".join(t for t, c in zip(page.text, chosen, strict=True) if t is not None and c)
