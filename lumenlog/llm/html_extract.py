"""Main text of web pages by boosted trees over DOM nodes.

A tolerant parser makes a tree of block elements. Each gets features of its
subtree (text density, link share), attribute tokens, depth and siblings, also
its ancestors' tokens. Gradient-boosted trees, trained here on generated pages
whose main nodes are known, give each node's log odds. Decoding goes from the
leaves up: a subtree is taken whole, left out whole, or opened so that its parts
are decided one by one; so no choice of a node contradicts one above it.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select button".split())
#: Where one of these begins, an open one of its kind has no end tag.
ALONE = frozenset("noscript select button".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation annotation-xml".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: An element of these ends an open one of those.
ENDS = {
    "p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "option": frozenset(["option"]), "optgroup": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
    **{t: frozenset(["p"]) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul figure figcaption details".split()},
}
#: Elements beyond which nothing is ended by implication.
SCOPE = frozenset("html body table ul ol dl div article section main aside nav header footer form td th blockquote object canvas datalist".split())
_STOPS = {tag: SCOPE - ended for tag, ended in ENDS.items()}
TAGS = "html head body div p article section main aside nav header footer form ul ol li dl dt dd table tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address fieldset details".split()
#: Attribute tokens and roles that tell of text and of what surrounds it.
MAIN_WORDS = frozenset("article articlebody body content entry main post story text page column blog news hentry prose richtext".split())
SIDE_WORDS = frozenset(
    """nav navbar navigation menu menus submenu header masthead head top topbar footer foot bottom colophon copyright sidebar side aside rail widget
    widgets related recommended trending popular more ad ads advert advertisement adverts banner sponsor sponsored promo promotion promoted cookie cookies
    consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register search searchbox form forms comment
    comments commentlist reply replies respond disqus discussion reader share sharing social follow breadcrumb breadcrumbs crumbs pager pagination
    toolbar tags tagcloud meta byline author skip legal disclaimer privacy contentinfo complementary""".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>]))*+)>|<[!?][^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>" + (rf"|<{t}(?=[\s/>])" if t in ALONE else ""), re.IGNORECASE) for t in RAW}
_END_TAG = re.compile(r"</([a-zA-Z][a-zA-Z0-9:-]*)")


@dataclass(slots=True)
class Node:
    tag: str
    attributes: str = ""
    parent: Node | None = None
    parts: list = field(default_factory=list)  # texts and nodes, in page order
    chars: int = 0
    links: int = 0
    link_chars: int = 0


def parse(page: str) -> Node:
    """The tree of block elements. Inline elements' text is their block's; scripts, styles, comments and form controls have none.

    A script or style without an end tag lasts to the end of an element it is in; the start tag of another raw element without one is passed over.
    """
    root = Node("html")
    now, at, in_link = root, 0, False
    size = len(page)
    endless: set[str] = set()  # raw elements that have no end tag from here on

    def text(raw: str) -> None:
        if raw:
            now.parts.append(raw)
            if not raw.isspace():
                n = len(raw.strip())
                now.chars += n
                now.link_chars += n if in_link else 0

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!?][^<>]*\Z", rest)  # a tag that the page's end cuts off
            text(rest[: cut.start()] if cut else rest)
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[0].endswith("/>"):
                end = None if tag in endless else _RAW_END[tag].search(page, at)
                if end is None:
                    endless.add(tag)
                if end is not None and end[0].startswith("</"):
                    at = end.end()
                elif tag in ("script", "style"):
                    open_tags, up = set(), now
                    while up is not None:
                        open_tags.add(up.tag)
                        up = up.parent
                    at = next((e.start() for e in _END_TAG.finditer(page, at) if e[1].lower() in open_tags), size)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
                now.links += not closing
            continue
        if tag == "br" or tag in VOID:
            now.parts.append("\n")
            continue
        if closing:
            up = now
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                now, in_link = up.parent, False
            continue
        if tag in ("html", "body", "head") and (tag == "html" or any(isinstance(p, Node) and p.tag == tag for p in root.parts)):
            continue
        ended = ENDS.get(tag)
        if ended:
            up = now
            stops = _STOPS[tag]
            while up.parent is not None and up.tag not in stops:
                if up.tag in ended:
                    now = up.parent
                up = up.parent
        if tag == "body" and now.tag == "head":
            now = root
        child = Node(tag, m[3] or "", now)
        now.parts.append(child)
        if not m[0].endswith("/>"):
            now, in_link = child, False
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(p for p in reversed(n.parts) if isinstance(p, Node))
    return out


def attribute_words(node: Node) -> list[str]:
    if not node.attributes:
        return []
    return _WORDS.findall(" ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(node.attributes)).lower())


N_FEATURES = 23 + len(TAGS)


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node; nodes: as nodes_of gives them."""
    place = {id(n): i for i, n in enumerate(nodes)}
    count = len(nodes)
    up = np.array([place[id(n.parent)] if n.parent is not None and id(n.parent) in place else -1 for n in nodes])
    own = np.array([[n.chars, n.links, n.link_chars, 1] for n in nodes], dtype=np.float64)
    whole = own.copy()
    for i in range(count - 1, 0, -1):
        whole[up[i]] += whole[i]
    said = [attribute_words(n) for n in nodes]
    main = np.array([sum(w in MAIN_WORDS for w in s) for s in said], dtype=np.float64)
    side = np.array([sum(w in SIDE_WORDS for w in s) for s in said], dtype=np.float64)
    out = np.zeros((count, N_FEATURES))
    depth, up_main, up_side, up_tag = np.zeros(count), np.zeros(count), np.zeros(count), np.zeros((count, 6))
    kinds = ("nav", "header", "footer", "aside", "form", "article")
    for i in range(count):
        p = up[i]
        if p >= 0:
            depth[i], up_main[i], up_side[i], up_tag[i] = depth[p] + 1, up_main[p] + main[p], up_side[p] + side[p], up_tag[p]
            if nodes[p].tag in kinds:
                up_tag[i, kinds.index(nodes[p].tag)] = 1
        if nodes[i].tag == "main":
            up_main[i] += 1
        if p >= 0 and out[p, 22] == 0:  # places are set for all children at once
            siblings = [q for q in nodes[p].parts if isinstance(q, Node)]
            if (k := len(siblings)) > 1:
                alike = Counter(s.tag for s in siblings)
                for j, s in enumerate(siblings):
                    out[place[id(s)], 14:17] = j / (k - 1), k, alike[s.tag] / k
            out[p, 22] = 1
        if nodes[i].tag in TAGS:
            out[i, 23 + TAGS.index(nodes[i].tag)] = 1
    total = max(whole[0, 0], 1.0)
    out[:, 0], out[:, 1] = np.log1p(own[:, 0]), np.log1p(whole[:, 0])
    out[:, 2], out[:, 3] = whole[:, 0] / total, own[:, 0] / total
    out[:, 4] = np.log1p(whole[:, 0] / whole[:, 3])
    out[:, 5] = whole[:, 2] / np.maximum(whole[:, 0], 1)
    out[:, 6] = own[:, 2] / np.maximum(own[:, 0], 1)
    out[:, 7], out[:, 8] = np.log1p(whole[:, 1]), np.log1p(whole[:, 3])
    out[:, 9], out[:, 10], out[:, 11] = depth, main, side
    out[:, 12], out[:, 13] = up_main, up_side
    out[:, 17] = np.where(up >= 0, whole[:, 0] / np.maximum(whole[up, 0], 1), 1)
    out[:, 18:22] = up_tag[:, :4].sum(1, keepdims=True) * [1, 0, 0, 0] + up_tag[:, 4:5] * [0, 1, 0, 0] + up_tag[:, 5:6] * [0, 0, 1, 0]
    out[:, 22] = 0
    return out


class Boosted:
    """Gradient-boosted regression trees with logistic loss on binned features; trees are full, of a fixed depth."""

    def __init__(self, edges: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], base: float, depth: int):
        self.edges, self.trees, self.base, self.depth = edges, trees, base, depth

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        base = float(np.log(share / (1 - share)))
        score, made = np.full(len(x), base), []
        inner = 2**depth - 1
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut, at = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(len(x), dtype=np.int64)
            for node in range(inner):
                here = np.flatnonzero(at == node)
                best = (1e-9, 0, np.inf, 0)
                if len(here) > 8:
                    g, h = grad[here], hess[here]
                    whole = g.sum() ** 2 / (h.sum() + 1)
                    for j, e in enumerate(edges):
                        if len(e):
                            gs = np.cumsum(np.bincount(binned[here, j], g, minlength=len(e) + 1))
                            hs = np.cumsum(np.bincount(binned[here, j], h, minlength=len(e) + 1))
                            gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - whole
                            b = int(gain.argmax())
                            if gain[b] > best[0]:
                                best = (gain[b], j, e[b], b)
                _, feature[node], cut[node], b = best
                right = binned[here, feature[node]] > b if np.isfinite(cut[node]) else np.zeros(len(here), bool)
                at[here] = 2 * node + 1 + right
            leaf_at = at - inner
            leaf = rate * np.bincount(leaf_at, grad, minlength=inner + 1) / (np.bincount(leaf_at, hess, minlength=inner + 1) + 1)
            score += leaf[leaf_at]
            made.append((feature, cut, leaf))
        return cls(np.array([]), made, base, depth)


# Training pages. Their main nodes carry a marker attribute that no feature reads.

_MARK = "data-main"


def _prose(rng: random.Random, sentences: int) -> str:
    word = lambda: "".join(rng.choice("aeioubcdfghlmnprstvw") for _ in range(rng.randint(1, 9)))
    said = []
    for _ in range(sentences):
        said.append(" ".join(word() for _ in range(rng.randint(3, 18))).capitalize() + rng.choice(". . . ! ? ; :".split()))
    return " ".join(said)


def _links(rng: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{_prose(rng, 1)[: rng.randint(3, 20)]}</a></li>' for i in range(n))


def training_page(rng: random.Random) -> str:
    """A page of random layout; every block of main text is marked."""
    pick = rng.choice

    def side() -> str:
        kind = rng.randrange(12)
        short = _prose(rng, rng.randint(1, 4))
        name = lambda *names: f'{pick(["class", "id"])}="{pick(names)}"'
        match kind:
            case 0 | 1:
                return f"<nav><ul>{_links(rng, rng.randint(2, 9))}</ul></nav>" if rng.random() < 0.6 else f"<div {name('main-menu', 'navbar', 'site-nav', 'top-menu')}><ul>{_links(rng, rng.randint(2, 9))}</ul></div>"
            case 2:
                return f"<header><h1>{short[:30]}</h1><p>{short}</p></header>" if rng.random() < 0.5 else f"<div {name('header', 'masthead', 'site-header', 'page-head')}><p>{short}</p></div>"
            case 3:
                return f"<footer><p>&copy; {short}</p></footer>" if rng.random() < 0.3 else f"<footer>&copy; example &middot; {short}</footer>" if rng.random() < 0.6 else f"<div {name('footer', 'page-footer', 'copyright', 'bottom')}><p>{short}</p><ul>{_links(rng, 3)}</ul></div>"
            case 4:
                return f"<aside><h3>{short[:20]}</h3><p>{_prose(rng, rng.randint(1, 8))}</p></aside>" if rng.random() < 0.5 else f"<div {name('sidebar', 'side-bar', 'right-rail', 'widget')}><h3>{short[:20]}</h3><p>{_prose(rng, rng.randint(1, 8))}</p><ul>{_links(rng, 4)}</ul></div>"
            case 5:
                return f"<div {name('cookie-notice', 'consent', 'gdpr-banner', 'notice', 'alert', 'popup')}><p>{short}</p></div>"
            case 6 | 7:
                return f"<div {name('ad', 'ads', 'advert', 'ad-banner', 'sponsored', 'promo')}>{short}</div>" if rng.random() < 0.6 else f"<section {name('advertisement', 'sponsor', 'promo-box')}><p>{short}</p></section>"
            case 8:
                return f"<form {name('search', 'login', 'newsletter', 'subscribe')}><p>{short}</p><label>{short[:10]}</label><input></form>"
            case 9 | 10:
                inner = "".join(f'<{t} class="{pick(["comment", "reply", "comment-body"])}"><p>{_prose(rng, rng.randint(1, 6))}</p></{t}>' for t in [pick(["div", "li", "article"])] * rng.randint(1, 5))
                return f"<{pick(['div', 'section'])} {name('comments', 'discussion', 'comment-list', 'reader-comments', 'replies')}><h3>{short[:15]}</h3>{inner}</div></section>"
            case _:
                return f"<div {name('related', 'share', 'social', 'breadcrumbs', 'tags', 'pagination')}><ul>{_links(rng, rng.randint(2, 6))}</ul></div>"

    def block() -> str:
        kind, n = rng.randrange(10), rng.choice([1, 1, 1, 2, 4, 9])
        match kind:
            case 0:
                return f"<h2 {_MARK}>{_prose(rng, 1)}</h2>"
            case 1:
                return f"<ul {_MARK}>" + "".join(f"<li {_MARK}>{_prose(rng, 1)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>"
            case 2:
                return f"<blockquote {_MARK}><p {_MARK}>{_prose(rng, n)}</p></blockquote>"
            case 3:
                return f"<p {_MARK}><b>{_prose(rng, n)}<br>"
            case 4:
                return f"<table {_MARK}><tr {_MARK}><td {_MARK}>{_prose(rng, 1)}</td><td {_MARK}>{_prose(rng, 1)}</td></tr></table>"
            case 5:
                return f'<p {_MARK}>{_prose(rng, n)} <a href="/x">{_prose(rng, 1)}</a> {_prose(rng, 1)}</p>'
            case _:
                return f"<p {_MARK}>{_prose(rng, n)}</p>"

    title = f"<h1 {_MARK}>{_prose(rng, 1)}</h1>" if rng.random() < 0.85 else ""
    inside = [block() for _ in range(rng.choice([0, 1, 1, 2, 3, 6, 12, 20]))]
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        inside.insert(rng.randint(0, len(inside)), side())
    tag, attributes = pick([("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("div", ' class="article-body"'), ("section", ' class="entry"'), ("div", ' class="story"')])
    main = f"<{tag}{attributes}>{title}{''.join(inside)}</{tag}>"
    if rng.random() < 0.25:
        main = f"<main>{main}</main>"
    before, after = [side() for _ in range(rng.randint(0, 4))], [side() for _ in range(rng.randint(0, 4))]
    page = f"<body>{''.join(before)}{main}{''.join(after)}</body>"
    if rng.random() < 0.2:
        page = f'<body><div class="wrapper">{"".join(before)}{main}{"".join(after)}</div></body>'
    return f"<html><head><title>x</title></head>{page}</html>"


def train(pages: int = 400, seed: int = 11) -> Boosted:
    """Fit on so many generated pages. A node counts as main if nearly all its text is, as not if nearly none is; others aren't used."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes = nodes_of(parse(training_page(rng)))
        place = {id(n): i for i, n in enumerate(nodes)}
        good = np.array([n.chars if _MARK in n.attributes else 0 for n in nodes], dtype=np.float64)
        whole = np.array([n.chars for n in nodes], dtype=np.float64)
        for i in range(len(nodes) - 1, 0, -1):
            p = place[id(nodes[i].parent)]
            good[p] += good[i]
            whole[p] += whole[i]
        part = good / np.maximum(whole, 1)
        use = (whole > 0) & ((part > 0.9) | (part < 0.1))
        xs.append(features(nodes)[use])
        ys.append((part > 0.5)[use])
    return Boosted.fit(np.concatenate(xs), np.concatenate(ys).astype(np.float64))


def decode(nodes: list[Node], odds: np.ndarray, opening: float = 0.5) -> np.ndarray:
    """Which nodes' own text is taken: the best of whole, none and opened, from the leaves up.

    A node counts by its text; opening a node costs a little, so that mixed
    evidence within a block of one kind doesn't tear it apart.
    """
    count = len(nodes)
    place = {id(n): i for i, n in enumerate(nodes)}
    up = [place[id(n.parent)] if n.parent is not None and id(n.parent) in place else -1 for n in nodes]
    weight = np.array([np.log1p(n.chars) for n in nodes])
    gain = np.clip(odds, -6, 6) * weight
    whole, opened = gain.copy(), np.maximum(gain, 0)
    choice = np.zeros(count, dtype=np.int8)  # 0 none, 1 whole, 2 opened
    for i in range(count - 1, -1, -1):
        leaf = not any(isinstance(p, Node) for p in nodes[i].parts)
        options = (0.0, whole[i], -np.inf if leaf else opened[i] - opening)
        choice[i] = int(np.argmax(options))
        if up[i] >= 0:
            whole[up[i]] += whole[i]
            opened[up[i]] += max(options)
    taken, state = np.zeros(count, dtype=bool), np.zeros(count, dtype=np.int8)
    for i in range(count):
        above = 2 if up[i] < 0 else state[up[i]]
        state[i] = choice[i] if above == 2 else above
        taken[i] = state[i] == 1 or state[i] == 2 and gain[i] > 0
    return taken


def blocks(nodes: list[Node], taken: np.ndarray) -> Iterator[str]:
    """The taken blocks' text in page order: references decoded, white space one space, trimmed; empty ones are none."""
    place = {id(n): i for i, n in enumerate(nodes)}

    def visit(root: Node) -> Iterator[str]:
        todo: list[tuple[Node, int]] = [(root, 0)]
        run: list[str] = []
        while todo:
            node, k = todo.pop()
            use = taken[place[id(node)]]
            while k < len(node.parts) and not isinstance(node.parts[k], Node):
                if use:
                    run.append(node.parts[k])
                k += 1
            if run:
                if said := " ".join(html.unescape("".join(run)).split()):
                    yield said
                run = []
            if k < len(node.parts):
                todo.append((node, k + 1))
                todo.append((node.parts[k], 0))

    return visit(nodes[0])


def main_text(page: str, model: Boosted) -> str:
    nodes = nodes_of(parse(page))
    return " ".join(blocks(nodes, decode(nodes, model.predict(features(nodes)))))


def extract(pages: DataFrame, model: Boosted | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every row's (id_col, url_col, text, n_chars): the page's main text, and its length in code points.

    Null or empty html: empty text. Rows stand alone, so ties, repeated and
    null ids are no matter; other columns are not read. The whole page is
    parsed, whatever its length. No shuffle. The model is trained on the driver
    on generated pages, whose number is a parameter of train().
    """
    need(pages, id_col, url_col, html_col)
    held = pages.sparkSession.sparkContext.broadcast(model or train())  # forty trees of 46 numbers
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))

    def run(batches):
        own = held.value
        for batch in batches:
            texts = []
            pages_now = batch.column(2).to_pylist()
            for a in range(0, len(pages_now), 256):
                trees = [nodes_of(parse(p)) for p in pages_now[a : a + 256]]
                odds = own.predict(np.concatenate([features(t) for t in trees]))
                at = 0
                for t in trees:
                    texts.append(" ".join(blocks(t, decode(t, odds[at : at + len(t)]))))
                    at += len(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], [id_col, url_col, "text", "n_chars"])

    rows = pages.select(pages[id_col], pages[url_col], F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("\x00html"))
    return rows.mapInArrow(run, f"{fields}, text string, n_chars long")
