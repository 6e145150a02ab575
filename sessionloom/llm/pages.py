"""Main text of web pages by a tree-structured graphical model over the DOM.

Nodes are the page's block elements and its text blocks (runs of text not broken by a block element). Each node is frame (a wrapper
around content), content or boilerplate. A node's features (tag, words of its class and id, length, links) depend on its label, and its label on its parent's; so the model is a tree
and sum-product is exact: messages go from the leaves up, then from the root down, and give every node's probability of being content
given the whole page. Text blocks above one half are kept, in page order.

The tables are counted from labelled pages: those that mark their article (one `article` or `main` element), where blocks inside it
are content unless they lie in an element that names itself otherwise; what surrounds the article is frame, all else boilerplate. Training
reads a bounded sample (`sample` pages of smallest hash). The counted tables are mixed with prior tables, which speak for marks that a
sample may lack. Counting is distributed; the tables have a fixed vocabulary.

Defined results: null or empty html gives an empty text of 0 characters; text without any block element is all content; unclosed
or misnested elements are closed as browsers do for paragraphs, items and cells; every input row gives one row; the whole html is read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.session import cut_lineage

# Element kinds of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "img", "wbr",
}
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "select", "textarea", "button"}
#: What may stand in a head; anything else ends it, as in browsers.
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: Hidden elements that can't hold these blocks end where one opens.
PHRASES = {"button", "select", "svg"}
BREAKS = {
    "address", "article", "aside", "blockquote", "body", "dl", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "main", "nav", "ol", "p",
    "pre", "section", "table", "ul",
}
#: An opening tag closes these, up to the nearest element that may hold it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
TAGS = (
    "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "tr", "td", "th", "pre",
    "blockquote", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "fieldset", "menu", "address", "details", "body", "html",
)
_AGAINST = re.compile(
    r"(?i)(^|[-_ ])(ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|login|masthead|menu|modal|nav\w*|newsletter|notices?|"
    r"pager|pagination|popup|promo\w*|related|replies|reply|respond|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|tags?|toolbar|widgets?)($|[-_ ])"
)
#: What a page has or lacks doesn't name the element.
_ABOUT = re.compile(r"(?i)\b(has|with|without|no|is)-\S+")
_FOR = re.compile(r"(?i)(^|[-_ ])(article\w*|body|content|entry|main|post|story|text)($|[-_ ])")

STATES = ("frame", "content", "boilerplate")
#: Prior weights of (feature, value) by state, 1 where none is given; each feature's weights are scaled to one. An element that names
#: itself boilerplate is never content, whatever it holds; a form may be a frame.
NEVER = 1e-100
PRIOR = {
    **{("tag", t): (0.05, NEVER, 30.0) for t in ("nav", "footer", "aside", "menu", "fieldset")},
    ("tag", "form"): (1.0, NEVER, 30.0), ("tag", "header"): (0.5, 0.001, 10.0),
    **{("tag", t): (1e-9, 10.0, 0.05) for t in ("article", "main")},
    **{("tag", t): (0.1, 20.0, 60.0) for t in ("p", "blockquote", "pre", "h1", "h2", "h3")},
    **{("tag", t): (30.0, 0.1, 0.1) for t in ("html", "body")},
    **{("tag", t): (30.0, 10.0, 30.0) for t in ("div", "section", "table", "tbody", "tr")},
    **{("tag", t): (1.0, 30.0, 30.0) for t in ("ul", "ol", "li", "dl", "dd", "td")},
    **{("holder", t): (1.0, 10.0, 10.0) for t in ("p", "h1", "h2", "h3", "h4", "pre", "blockquote", "div")},
    **{("holder", t): (1.0, 30.0, 10.0) for t in ("li", "td", "dd")},
    ("class", "against"): (NEVER, NEVER, 3.0), ("class", "for"): (2.0, 3.0, 0.1),
}
#: How much of a state's tables is prior: boilerplate looks like anything, also like text.
SHARE = (0.1, 0.3, 0.5)
#: Prior of a child's state by its parent's, and how much of the counted moves it replaces.
MOVES = ((0.3, 0.35, 0.35), (1e-9, 0.985, 0.015), (1e-12, 1e-12, 1.0))
MOVED = 0.3
SCOPES = ("element", "block")


class Page(HTMLParser):
    """Nodes of a page, parents before children: parent, scope, features, text. Lists run in parallel."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.mark, self.text, self.linked = [-1], ["html"], ["none"], [None], [0]
        self.open: list[tuple[str, int]] = []  # inline elements too, with the node they belong to
        self.hidden = 0
        self.links = 0
        self.at = 0
        self.run: list[str] = []
        self.run_linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            self._node(self.at, self.tag[self.at], "none", text, min(self.run_linked, len(text)))
        self.run, self.run_linked = [], 0

    def _node(self, parent: int, tag: str, mark: str, text: str | None, linked: int) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.mark, mark), (self.text, text), (self.linked, linked)):
            column.append(value)
        return len(self.parent) - 1

    def _close_to(self, depth: int) -> None:
        """Close open elements until `depth` are left."""
        while len(self.open) > depth:
            tag, before = self.open.pop()
            if tag in HIDDEN:
                self.hidden -= 1
            elif tag not in INLINE:
                self.flush()
                self.at = before
            elif tag == "a":
                self.links -= 1

    def _end_hidden(self, tag: str) -> None:
        """Close a head or another hidden element that was left open and can't hold this tag."""
        if self.open[-1][0] == "head":
            if tag not in IN_HEAD:
                self._close_to(len(self.open) - 1)
        elif tag in BREAKS:
            for depth in range(len(self.open) - 1, -1, -1):
                name = self.open[depth][0]
                if name in PHRASES:
                    self._close_to(depth)
                elif name in HIDDEN or name == "foreignobject":
                    break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden:
            self._end_hidden(tag)
        if tag == "br":
            self.run.append(" ")
            return
        if tag in VOID:
            if tag not in INLINE:
                self.flush()
            return
        if tag not in INLINE and tag not in HIDDEN:
            for depth in range(len(self.open) - 1, -1, -1):
                name = self.open[depth][0]
                if name == "p":
                    self._close_to(depth)
                    break
                if name not in INLINE:
                    break
            shut, scope = CLOSES.get(tag, (set(), set()))
            for depth in range(len(self.open) - 1, -1, -1):
                name = self.open[depth][0]
                if name in scope:
                    break
                if name in shut:
                    self._close_to(depth)
        if tag == "a" and any(name == "a" for name, _ in self.open):
            self.links = max(0, self.links - 1)
            last = max(d for d, (name, _) in enumerate(self.open) if name == "a")
            self.open[last] = ("span", self.open[last][1])
        self.open.append((tag, self.at))
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "a":
            self.links += 1
        elif tag not in INLINE:
            self.flush()
            names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
            names = "" if tag in ("html", "body") else _ABOUT.sub(" ", names)
            mark = "against" if _AGAINST.search(names) else "for" if _FOR.search(names) else "none"
            self.at = self._node(self.at, tag, mark, None, 0)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "br":
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.open[depth][0]
            if name == tag:
                if tag in INLINE:
                    # Only the inline element ends; what was opened inside it goes on.
                    del self.open[depth]
                    self.links -= tag == "a"
                else:
                    self._close_to(depth)
                return
            if tag in INLINE and name not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if self.hidden and self.open[-1][0] == "head" and data.strip():
            self._close_to(len(self.open) - 1)
        if not self.hidden:
            self.run.append(data)
            if self.links:
                self.run_linked += len(data.strip())


def parse(html: str) -> Page:
    page = Page()
    page.feed(html)
    page.close()
    page._close_to(0)
    page.flush()
    return page


def _bucket(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= e for e in edges)


def features(page: Page) -> list[tuple[tuple[str, object], ...]]:
    """Feature values of every node; an element sums the blocks below it."""
    n = len(page.parent)
    chars, linked = [0] * n, [0] * n
    for v in range(n - 1, -1, -1):
        if page.text[v] is not None:
            chars[v], linked[v] = len(page.text[v]), page.linked[v]
        if v:
            chars[page.parent[v]] += chars[v]
            linked[page.parent[v]] += linked[v]
    out = []
    for v in range(n):
        density = _bucket(linked[v] / chars[v] if chars[v] else 0.0, (0.05, 0.3, 0.7))
        if page.text[v] is None:
            tag = page.tag[v] if page.tag[v] in TAGS else "other"
            out.append((("tag", tag), ("class", page.mark[v]), ("links", density), ("chars", _bucket(chars[v], (1, 50, 200, 1000)))))
        else:
            size = _bucket(page.text[v].count(" ") + 1, (3, 6, 10, 30))
            out.append((("holder", page.tag[v] if page.tag[v] in TAGS else "other"), ("linked", density), ("words", size), ("ends", page.text[v][-1] in ".!?:\"”")))
    return out


def labelled(page: Page) -> list[int] | None:
    """States of the nodes of a page that marks its one article; None for other pages."""
    roots = [v for v, t in enumerate(page.tag) if page.text[v] is None and t == "article"] or [
        v for v, t in enumerate(page.tag) if page.text[v] is None and t == "main"
    ]
    if len(roots) != 1:
        return None
    label = [2] * len(page.parent)
    above = roots[0]
    while above >= 0:
        label[above] = 0
        above = page.parent[above]
    label[roots[0]] = 1
    for v in range(roots[0] + 1, len(label)):
        own = page.text[v] is None and (page.mark[v] == "against" or page.tag[v] in ("nav", "footer", "aside", "form", "menu"))
        if label[page.parent[v]] == 1 and not own:
            label[v] = 1
    return label


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    for batch in batches:
        for html in batch["html"]:
            page = parse(html)
            label = labelled(page)
            if label is None:
                continue
            for v, values in enumerate(features(page)):
                scope = SCOPES[page.text[v] is not None]
                if v:
                    seen[("label", f"{scope}{label[page.parent[v]]}", label[v])] += 1
                for name, value in values:
                    seen[(name, str(value), label[v])] += 1
    rows = [(a, b, y, n) for (a, b, y), n in seen.items()]
    yield pd.DataFrame(rows, columns=["feature", "value", "label", "n"])


VALUES = {
    "tag": [*TAGS, "other"], "holder": [*TAGS, "other"], "class": ["none", "for", "against"], "links": range(4), "linked": range(4), "chars": range(5),
    "words": range(5), "ends": [False, True],
}


class Model:
    """Log tables: emit[(feature, value)] by state, move[scope][parent's state] by the child's state."""

    def __init__(self, counts: dict[tuple[str, str, int], int]) -> None:
        states = range(len(STATES))
        self.emit: dict[tuple[str, object], tuple[float, ...]] = {}
        for name, values in VALUES.items():
            prior = {v: PRIOR.get((name, v), (1.0,) * len(STATES)) for v in values}
            scale = [sum(p[y] for p in prior.values()) for y in states]
            total = [sum(counts.get((name, str(v), y), 0) for v in values) for y in states]
            for v in values:
                self.emit[(name, v)] = tuple(
                    math.log(_mixed(counts.get((name, str(v), y), 0), total[y], prior[v][y] / scale[y], SHARE[y])) for y in states
                )
        self.move = {}
        for scope in SCOPES:
            seen = [[counts.get(("label", f"{scope}{up}", y), 0) for y in states] for up in states]
            self.move[scope] = [tuple(math.log(_mixed(seen[up][y], sum(seen[up]), MOVES[up][y], MOVED)) for y in states) for up in states]


def _mixed(count: int, total: int, prior: float, share: float) -> float:
    """Share in the sample, mixed with the prior; the prior alone where there is no sample."""
    return (1 - share) * count / total + share * prior if total else prior


def _sum(values: list[float]) -> float:
    high = max(values)
    return high + math.log(sum(math.exp(x - high) for x in values)) if high > -math.inf else high


def marginals(page: Page, model: Model) -> list[float]:
    """Probability of content of every node, by one pass up and one down the tree."""
    n, states = len(page.parent), range(len(STATES))
    below = [[sum(e) for e in zip(*(model.emit[f] for f in values), strict=True)] for values in features(page)]
    moves = [model.move[SCOPES[t is not None]] for t in page.text]
    up: list[list[float]] = [[]] * n
    for v in range(n - 1, 0, -1):
        own, move = below[v], moves[v]
        up[v] = [_sum([m + o for m, o in zip(move[y], own, strict=True)]) for y in states]
        target = below[page.parent[v]]
        for y in states:
            target[y] += up[v][y]
    # The root, the page itself, is frame.
    belief: list[list[float]] = [[0.0, -math.inf, -math.inf]] * n
    out = [0.0] * n
    for v in range(1, n):
        p, move = page.parent[v], moves[v]
        # What the parent believes without this child's own message.
        outer = [belief[p][y] - up[v][y] for y in states]
        own = [below[v][y] + _sum([outer[x] + move[x][y] for x in states]) for y in states]
        norm = _sum(own)
        belief[v] = [x - norm for x in own]
        out[v] = math.exp(belief[v][1])
    return out


def main_text(html: str | None, model: Model) -> str:
    if not html:
        return ""
    page = parse(html)
    if all(t is not None for t in page.text[1:]):
        return "\n\n".join(page.text[1:])
    chance = marginals(page, model)
    return "\n\n".join(t for t, c in zip(page.text, chance, strict=True) if t is not None and c > 0.5)


def train(pages: DataFrame, sample: int = 2_000, html: str = "html") -> Model:
    """Tables from at most `sample` pages."""
    own = pages.select(F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("order", F.xxhash64("html"))
    # Only hashes are ordered; at most `sample` of them are sent back to the pages.
    chosen = F.broadcast(own.select("order").distinct().orderBy("order").limit(sample))
    drawn = cut_lineage(own.join(chosen, "order").dropDuplicates(["order"]).repartition(16))
    rows = drawn.select("html").mapInPandas(_counts, "feature string, value string, label int, n long")
    counted = rows.groupBy("feature", "value", "label").agg(F.sum("n").alias("n")).collect()  # a fixed vocabulary
    return Model({(r["feature"], r["value"], r["label"]): r["n"] for r in counted})


def extract(pages: DataFrame, model: Model, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page, in one pass without a shuffle."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(h, held.value) for h in pages], dtype=object)

    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    own = own.select("page_id", "url", extracted("html").alias("text"))
    return own.withColumn("n_chars", F.length("text").cast("long"))
