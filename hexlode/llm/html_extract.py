"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree of block elements with leaves for the text between them. Every node has a hidden label, content or
not; parent-child potentials connect the labels, and node potentials score tags, words of class, id and role, and a leaf's
length, links and punctuation. All potentials are relative frequencies from labelled pages (`labelled_pages`, or the
caller's own). Sum-product messages upward and downward give each leaf's exact marginal; leaves that are content more likely
than not become the text's blocks.

A block is the text between two block-level tags; its character references are decoded, its white space is turned into single
spaces, and empty blocks go. br is white space. Unclosed and misnested tags are taken as browsers do it: a block's tag closes an
open p, and an end tag closes what stands open inside its element. Scripts, styles, head, text fields and embedded objects hold no text and end no block.

Null and empty html give an empty text. Repeated rows give equal texts. Other columns stay as they are.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: Fixed values of HTML: elements without content, with raw text, that are never shown, and that stand inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noframes xmp iframe noembed".split())
UNSEEN = frozenset("script style template noscript svg math iframe object embed canvas audio video head title noframes noembed map datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br picture source input meter progress output".split()
)
#: Fixed values of HTML: which open elements a start tag closes, and at which ancestors the search for them ends.
CLOSES = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"table", "tr"}), "th": ({"td", "th", "p"}, {"table", "tr"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "p"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "p"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
_MARKUP = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_INSIDE = re.compile(r"""=\s*(?:(["'])|[^\s"'>][^\s>]*)|>""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
#: Words of names; numbers and single letters tell nothing.
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]{2,}")


@dataclass(slots=True)
class Node:
    parent: int
    features: tuple[str, ...]
    text: str | None = None  # of leaves
    label: int | None = None


@dataclass(slots=True)
class _Open:
    tag: str
    node: int
    label: int | None = None


def _features(tag: str, attributes: str) -> tuple[tuple[str, ...], str | None]:
    """An element's features, and the value of data-main in labelled pages."""
    found, main = ["tag:" + tag], None
    if attributes:
        for name, a, b, c in _ATTR.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role", "aria-label", "itemprop"):
                found += ["word:" + w.lower() for w in _WORD.findall(value) if len(w) > 1]
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                found.append("hidden")
            elif name == "data-main":
                main = value
    return tuple(dict.fromkeys(found)), main


def _leaf_features(text: str, linked: int) -> tuple[str, ...]:
    n = len(text)
    share = linked / n if n else 0.0
    return (
        f"length:{min(6, n.bit_length() // 2)}",
        f"links:{0 if share < 0.05 else 1 if share < 0.5 else 2}",
        f"stop:{any(c in text for c in '.!?,;')}",
    )


class _Tags:
    """A page's tags in one forward pass: what earlier searches have found to be missing from a place on is not sought again, so time grows with the page's length alone."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.missing = dict.fromkeys("\"'>", len(page))  # a character isn't found from this place on
        self.dead: set[int] = set()  # places outside of quotes from which no tag ends

    def find(self, c: str, at: int) -> int:
        if at >= self.missing[c]:
            return -1
        if (found := self.page.find(c, at)) < 0:
            self.missing[c] = at
        return found

    def end(self, at: int) -> int:
        """Behind the > that ends the tag whose name ends at at: the first outside of quoted values, or else the first; -1 if there is none."""
        if (first := self.find(">", at)) < 0:
            return -1
        tried, search = [], _INSIDE.search
        while at not in self.dead and self.find(">", at) >= 0 and (m := search(self.page, at)):
            if m[0] == ">":
                return m.end()
            tried.append(at)
            close = self.find(m[1], m.end()) if m[1] else -1
            at = close + 1 if close >= 0 else m.end()
        self.dead.update(tried)
        return first + 1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, whether it is an end tag, attributes); the name is empty for comments and declarations. send() a place to go on from."""
        at, page = 0, self.page
        while m := _MARKUP.search(page, at):
            if m[1]:
                close = re.compile(r"-?>").match(page, m.end())
                end = close.end() if close else page.find("-->", m.end()) + 3
                at = end if end > 2 else len(page)
                jump = yield m.start(), at, "", False, ""
            elif m[3] is None:
                if (end := self.find(">", m.end())) < 0:
                    return
                at = end + 1
                jump = yield m.start(), at, "", False, ""
            else:
                if (at := self.end(m.end())) < 0:
                    return
                jump = yield m.start(), at, m[3], bool(m[2]), page[m.end() : at - 1]
            at = jump or at


def dom(page: str, cache: dict | None = None) -> list[Node]:
    """The page's nodes, parents before children; the first is the root."""
    cache = {} if cache is None else cache
    nodes, stack = [Node(-1, ("tag:#root",))], [_Open("#root", 0)]
    standing: Counter[str] = Counter()  # open elements by tag
    runs: list[str] = []
    linked = links = unseen = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if runs:
            text = " ".join("".join(runs).split())
            runs.clear()
            if text:
                top = stack[-1]
                nodes.append(Node(top.node, _leaf_features(text, linked), text, top.label))
        linked = 0

    def pop(n: int) -> None:
        nonlocal unseen
        flush()
        while len(stack) > n:
            tag = stack.pop().tag
            standing[tag] -= 1
            unseen -= tag in UNSEEN

    def push(tag: str, node: int, label: int | None) -> None:
        stack.append(_Open(tag, node, label))
        standing[tag] += 1

    def words(raw: str) -> None:
        nonlocal linked
        if raw and not unseen:
            text = _html.unescape(raw) if "&" in raw else raw
            runs.append(text)
            if links:
                linked += len(text.strip())

    def one(tag: str, close: bool, attributes: str) -> int | None:
        """Takes in a tag; the place to go on from, if it isn't the tag's end."""
        nonlocal at, links, unseen
        if tag in INLINE:
            if tag == "a":
                links = 0 if close else 1
            elif tag == "br" and not unseen:
                runs.append(" ")
            return None
        if close:
            for k in range(len(stack) - 1, 0, -1) if standing[tag] else ():
                if stack[k].tag == tag:
                    if tag in UNSEEN and k == len(stack) - 1:
                        stack.pop()
                        standing[tag] -= 1
                        unseen -= 1
                    else:
                        pop(k)
                    break
            links = 0 if tag != "p" else links
            return None
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = page.find(">", stop.end()) + 1 if stop else end
            at = at or end
            return at
        if tag in UNSEEN:
            push(tag, stack[-1].node, stack[-1].label)
            unseen += 1
            return None
        if tag in CLOSES:
            inside, bound = CLOSES[tag]
            lowest, left = None, sum(standing[t] for t in inside)
            for k in range(len(stack) - 1, 0, -1):
                if not left or stack[k].tag in bound:
                    break
                if stack[k].tag in inside:
                    lowest, left = k, left - 1
            if lowest is not None:
                pop(lowest)
        elif stack[-1].tag == "p":
            pop(len(stack) - 1)
        flush()
        if tag in VOID:
            return None
        if (made := cache.get((tag, attributes))) is None:
            if len(cache) > 50_000:
                cache.clear()
            made = cache[tag, attributes] = _features(tag, attributes)
        found, main = made
        if unseen:
            push(tag, stack[-1].node, stack[-1].label)
        else:
            label = int(main) if main is not None else stack[-1].label
            nodes.append(Node(stack[-1].node, found, None, label))
            push(tag, len(nodes) - 1, label)
        return None

    tags = iter(_Tags(page))
    found = next(tags, None)
    while found:
        start, stop, tag, close, attributes = found
        words(page[at:start])
        at, jump = stop, None
        if tag:
            jump = one(tag.lower(), close, attributes)
        try:
            found = tags.send(jump)
        except StopIteration:
            break
    rest = page[at:]
    cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that the page's end cuts off is no text
    words(rest[: cut.start()] if cut else rest)
    pop(0)
    return nodes


@dataclass
class Model:
    """Log-potentials: of (parent's label, kind of child) to the child's label, and of features by label."""

    edge: dict[tuple[int, str], tuple[float, float]]
    feature: dict[str, tuple[float, float]]
    memo: dict = field(default_factory=dict)

    def node(self, features: tuple[str, ...]) -> tuple[float, float]:
        got = self.memo.get(features)
        if got is None:
            if len(self.memo) > 50_000:
                self.memo.clear()
            known = [self.feature[f] for f in features if f in self.feature]
            got = self.memo[features] = (sum(x for x, _ in known), sum(y for _, y in known))
        return got


def _sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def marginals(nodes: list[Node], model: Model) -> list[float]:
    """Each node's probability of being content, by one upward and one downward sweep of sum-product messages."""
    n = len(nodes)
    own = [model.node(x.features) for x in nodes]
    edges = [(model.edge[0, kind], model.edge[1, kind]) for kind in ("leaf", "element")]
    up0, up1 = [x for x, _ in own], [y for _, y in own]
    sent: list[tuple[float, float]] = [(0.0, 0.0)] * n
    for v in range(n - 1, 0, -1):
        from0, from1 = edges[0 if nodes[v].text is not None else 1]
        m0, m1 = _sum(from0[0] + up0[v], from0[1] + up1[v]), _sum(from1[0] + up0[v], from1[1] + up1[v])
        sent[v] = (m0, m1)
        p = nodes[v].parent
        up0[p] += m0
        up1[p] += m1
    down: list[tuple[float, float]] = [(0.0, 0.0)] * n
    out = [0.0] * n
    for v in range(n):
        if v:
            p = nodes[v].parent
            # The parent's belief without what v itself sent to it.
            a0, a1 = up0[p] + down[p][0] - sent[v][0], up1[p] + down[p][1] - sent[v][1]
            from0, from1 = edges[0 if nodes[v].text is not None else 1]
            down[v] = (_sum(a0 + from0[0], a1 + from1[0]), _sum(a0 + from0[1], a1 + from1[1]))
        b0, b1 = up0[v] + down[v][0], up1[v] + down[v][1]
        out[v] = 1 / (1 + math.exp(min(700.0, b0 - b1)))
    return out


def train(pages: Iterable[str]) -> Model:
    """A model from pages whose elements carry data-main="1" or "0", inherited by what they hold; a node above content is content."""
    edge, feature, totals = Counter(), Counter(), Counter()
    for page in pages:
        nodes = dom(page)
        labels = [0] * len(nodes)
        for v in range(len(nodes) - 1, -1, -1):
            if nodes[v].text is not None:
                labels[v] = nodes[v].label or 0
            if labels[v] and v:
                labels[nodes[v].parent] = 1
        for v, x in enumerate(nodes):
            kind = "leaf" if x.text is not None else "element"
            if v:
                edge[labels[x.parent], kind, labels[v]] += 1
            totals[kind, labels[v]] += 1
            for f in x.features:
                feature[f, labels[v]] += 1
    names = {f for f, _ in feature}
    leaf = {f: f.split(":")[0] in ("length", "links", "stop") for f in names}
    edges = {(a, k): tuple(math.log((edge[a, k, b] + 0.1) / (edge[a, k, 0] + edge[a, k, 1] + 0.2)) for b in (0, 1)) for a in (0, 1) for k in ("leaf", "element")}
    likely = {f: tuple(math.log((feature[f, b] + 0.5) / (totals["leaf" if leaf[f] else "element", b] + 1)) for b in (0, 1)) for f in names}
    return Model(edges, likely)


#: Usual names of parts of pages, for the labelled pages; other words of class and id say nothing, nor do those that name layout alone.
SHELLS = ("main", "content", "post", "article", "entry", "story", "body", "page-content", "main-content", "text")
PLAIN = ("col", "row", "box", "wrap", "inner", "block", "grid", "cell", "css", "section", "left", "right", "center", "panel", "module")
BOILERPLATE = {
    "nav": ("nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "navigation", "pagination", "pager", "toc", "topbar"),
    "header": ("header", "masthead", "site-header", "branding", "logo"),
    "footer": ("footer", "site-footer", "copyright", "colophon", "legal", "bottom"),
    "aside": ("sidebar", "aside", "related", "widget", "recommended", "trending", "popular", "rail"),
    "notice": ("cookie", "cookies", "consent", "notice", "banner", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "promo", "disclaimer", "overlay"),
    "ad": ("ad", "ads", "advert", "advertisement", "adsense", "sponsor", "sponsored", "ad-slot", "dfp"),
    "comments": ("comments", "comment", "comment-list", "discussion", "replies", "respond", "disqus", "reader-comments"),
    "share": ("share", "social", "social-links", "tags", "byline-tools", "toolbar"),
}


def labelled_pages(n: int = 1500, seed: int = 11) -> Iterator[str]:
    """Made-up pages of many shapes, labelled by data-main."""
    r = random.Random(seed)

    def words(k: int) -> str:
        return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(k))

    def prose(low: int = 1, high: int = 60) -> str:
        return ". ".join(words(r.randint(1, 14)) for _ in range(max(1, r.randint(low, high) // 8))) + r.choice((".", ".", "!", "?", ""))

    def link() -> str:
        return f'<a href="/x">{words(r.randint(1, 3))}</a>'

    def named(names: tuple[str, ...]) -> str:
        """A class or id: one of the names, or one that tells nothing."""
        random_name = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 3))) + str(r.randint(0, 99))
        name = r.choice(names) if r.random() < 0.9 else r.choice((random_name, random_name, f"{r.choice(PLAIN)}-{r.randint(1, 12)}", f"{r.choice(PLAIN)} {r.randint(1, 12)}"))
        return f'{r.choice(("class", "id", "class"))}="{name}{r.choice(("", "", "-1", " box", " wrap", " " + r.choice(PLAIN)))}"'

    def block() -> str:
        kind = r.random()
        if kind < 0.62:
            return f"<p>{prose(1, 160)}{' ' + link() + ' ' + prose(1, 20) if r.random() < 0.15 else ''}</p>"
        if kind < 0.72:
            return f"<h{(k := r.randint(1, 4))}>{words(r.randint(1, 9))}</h{k}>"
        if kind < 0.8:
            return f"<{(k := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{prose(1, 30)}</li>" for _ in range(r.randint(1, 5))) + f"</{k}>"
        if kind < 0.85:
            return f"<blockquote><p>{prose()}</p></blockquote>"
        if kind < 0.88:
            return f"<pre><code>{words(r.randint(2, 20))}</code></pre>"
        if kind < 0.92:
            return f"<figure><img src=x><figcaption>{prose(1, 20)}</figcaption></figure>"
        if kind < 0.95:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{words(r.randint(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        return f"<{(k := r.choice(('div', 'section')))}>{prose(4, 120)}</{k}>"

    def other(kind: str) -> str:
        name = r.choice(BOILERPLATE[kind])
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside"}.get(kind, "div")
        bare = tag != "div" and r.random() < 0.6
        tag = tag if bare or r.random() < 0.4 else r.choice(("div", "section", "div", "ul") if kind == "nav" else ("div", "section", "div"))
        attribute = "" if bare else f" {named((name,))}"
        if kind in ("nav", "share"):
            inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))) + "</ul>" if r.random() < 0.7 else " ".join(link() for _ in range(r.randint(2, 6)))
        elif kind == "comments":
            inner = "".join(f"<{(k := r.choice(('div', 'li', 'p', 'div', 'li', 'p', 'div', 'li', 'p', 'article')))}><b>{words(1)}</b> {prose(1, 60)}</{k}>" for _ in range(r.randint(1, 5)))
        elif kind == "aside":
            inner = f"<h3>{words(2)}</h3>" + r.choice((f"<p>{prose(1, 40)}</p>", "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(4)) + "</ul>"))
        elif kind == "header":
            inner = r.choice((f"<h1>{words(2)}</h1>", f"<p>{words(3)}</p>", words(3))) + r.choice(("", other("nav")))
        else:
            inner = r.choice((prose(1, 40), f"<p>{prose(1, 40)}</p>", f"&copy; {words(2)} {prose(1, 12)}", f"<p>{prose(1, 12)}</p>{link()}", f"<button>{words(1)}</button> {prose(1, 20)}"))
        return f'<{tag}{attribute} data-main="0">{inner}</{tag}>'

    def form() -> str:
        attribute = "" if r.random() < 0.5 else " " + named(("form", "signup", "login", "search"))
        return f'<form{attribute} data-main="0"><label>{words(2)}</label><input name=q><select><option>{words(1)}<option>{words(1)}</select><p>{prose(1, 20)}</p><button>{words(1)}</button></form>'

    kinds = list(BOILERPLATE)
    for _ in range(n):
        inner = [block() for _ in range(r.randint(1, 14))]
        if r.random() < 0.5:
            inner.insert(0, f"<h1>{words(r.randint(2, 9))}</h1>")
        if bare := r.random() < 0.08:
            inner = [re.sub(r"^<([a-z0-9]+)", r'<\1 data-main="1"', x) for x in inner]
        for _ in range(r.randint(0, 2)):
            inner.insert(r.randint(0, len(inner)), form() if r.random() < 0.25 else other(r.choice(kinds)))
        shell = r.random()
        body = "".join(inner)
        if bare:
            pass
        elif shell < 0.45:
            body = f'<article data-main="1">{body}</article>'
        elif shell < 0.6:
            body = f'<main data-main="1">{r.choice((body, f"<article>{body}</article>"))}</main>'
        elif shell < 0.85:
            body = f'<{(k := r.choice(("div", "section", "div")))} {named(SHELLS)} data-main="1">{body}</{k}>'
        else:
            body = f'<div{r.choice(("", f" {named(PLAIN)}"))} data-main="1">{body}</div>'
        around = [other(r.choice(kinds)) if r.random() < 0.9 else form() for _ in range(r.randint(0, 5))]
        k = r.randint(0, len(around))
        page = "".join(around[:k]) + body + "".join(around[k:])
        if r.random() < 0.3:
            page = f'<div class="{r.choice(("wrapper", "container", "page", "site"))}">{page}</div>'
        yield f"<html><head><title>{words(3)}</title><script>var a;</script></head><body>{page}</body></html>"


_own: list[Model] = []


def default_model() -> Model:
    if not _own:
        _own.append(train(labelled_pages()))
    return _own[0]


def main_text(page: str | None, model: Model, cache: dict | None = None) -> str:
    if not page:
        return ""
    nodes = dom(page, cache)
    belief = marginals(nodes, model)
    return "\n".join(x.text for x, b in zip(nodes, belief, strict=True) if x.text is not None and b >= 0.5)


def extract(pages: DataFrame, html: str = "html", model: Model | None = None) -> DataFrame:
    """pages with text, its main text, and n_chars, the text's code points, in place of columns of these names."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # as large as the model's vocabulary

    @F.pandas_udf(T.StringType())
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict = {}
        for batch in batches:
            yield pd.Series([main_text(x, shared.value, cache) for x in batch], dtype="object")

    out = pages.withColumn("text", extracted(pages[html]))
    return out.withColumn("n_chars", F.length("text").cast("long"))
