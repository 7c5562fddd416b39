"""The main text of web pages: boosted trees over features of DOM nodes, decoded so that choices agree along the tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtables.llm._text import column

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>""", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\s*>|</{t}\b[^>]*>|\Z", re.I) for t in ("script", "style", "title", "textarea", "noscript", "template", "svg", "iframe", "xmp", "select")}
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What a start tag ends.
ENDS = {**dict.fromkeys(BLOCK - {"html", "body"}, frozenset({"p"})), "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"})}
SCOPE = frozenset("table ul ol dl article section main div body html nav aside header footer form td".split())
WORDS = re.compile(r"[a-z]+")
GOOD = frozenset("article main content post entry story body text articlebody".split())
BAD = frozenset("nav menu navbar header footer sidebar aside ad ads advert advertisement banner promo cookie notice consent comment comments reply form subscribe newsletter related share social breadcrumb breadcrumbs login search widget popup modal sponsor sponsored toolbar pagination".split())
TAGS = ("p", "div", "li", "ul", "article", "main", "section", "nav", "aside", "header", "footer", "form", "td", "h1", "h2", "blockquote", "pre")
NAMES = ("own", "subtree", "density", "link_share", "own_link_share", "depth", "children", "place", "siblings", "stops", "own_stops", "mean_word", "tag", "good", "bad", "good_above", "bad_above", "neighbours", "share_of_page", "sibling_text", "paragraphs")
#: Features that name tags or attributes; training also sees every node without them.
NAMED = tuple(NAMES.index(x) for x in ("tag", "good", "bad", "good_above", "bad_above"))


@dataclass
class Page:
    """The block-level nodes of a page, parents before children, and its texts in order with the node of each."""

    parent: list[int]
    tag: list[str]
    tokens: list[frozenset[str]]
    text: list[tuple[int, str, int]]  # node, text, characters inside links


def parse(source: str) -> Page:
    """Tolerates unclosed, misnested and unknown tags. Scripts, styles, titles and comments have no text."""
    parent, tag, tokens, texts = [-1], ["#root"], [frozenset()], []
    opened: list[tuple[str, int]] = [("#root", 0)]  # (tag, node or -1 for inline)
    at, piece, linked, links = 0, [], 0, 0

    def flush() -> None:
        nonlocal piece, linked
        if piece:
            t = " ".join(html.unescape("".join(piece)).split())
            if t:
                texts.append((next(n for _, n in reversed(opened) if n >= 0), t, linked))
            piece, linked = [], 0

    def close(upto: int) -> None:
        nonlocal links
        for name, _ in opened[upto:]:
            links -= name == "a"
        del opened[upto:]

    def add(s: str) -> None:
        nonlocal linked
        piece.append(s)
        if links > 0:
            linked += len(s)

    while m := TOKEN.search(source, at):
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            for i in range(len(opened) - 1, 0, -1):
                if opened[i][0] == name:
                    if name in BLOCK:
                        flush()
                    close(i)
                    break
                if name not in BLOCK and opened[i][1] >= 0:
                    break
            continue
        if name in RAW:
            if not (m[3] or m[6] or "").endswith("/"):
                at = RAW[name].search(source, at).end()
            continue
        if name == "br":
            piece.append(" ")
            continue
        if name in BLOCK:
            flush()
            for i in range(len(opened) - 1, 0, -1):
                if opened[i][0] in ENDS.get(name, ()):
                    close(i)
                elif opened[i][0] in SCOPE:
                    break
            if name in VOID:
                continue
            parent.append(next(n for _, n in reversed(opened) if n >= 0))
            tag.append(name)
            attrs = m[3] or m[6] or ""
            tokens.append(frozenset(WORDS.findall(attrs.lower())) | {name} if attrs else frozenset({name}))
            opened.append((name, len(tag) - 1))
        elif name not in VOID:
            links += name == "a"
            opened.append((name, -1))
    add(source[at:])
    flush()
    return Page(parent, tag, tokens, texts)


def node_features(page: Page) -> np.ndarray:
    """A row of NAMES for each node."""
    n = len(page.tag)
    own, link, stops, spaces = [0] * n, [0] * n, [0] * n, [0] * n
    for k, t, a in page.text:
        own[k] += len(t)
        link[k] += a
        stops[k] += t.count(".") + t.count(",") + t.count("!") + t.count("?")
        spaces[k] += t.count(" ") + 1
    sub, sub_link, sub_stops, size, paragraphs = own[:], link[:], stops[:], [1] * n, [t == "p" for t in page.tag]
    children, place, depth, good_above, bad_above = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    good, bad = [len(t & GOOD) for t in page.tokens], [len(t & BAD) for t in page.tokens]
    for i in range(1, n):
        p = page.parent[i]
        place[i], depth[i] = children[p], depth[p] + 1
        children[p] += 1
        good_above[i], bad_above[i] = good_above[p] + (good[p] > 0), bad_above[p] + (bad[p] > 0)
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        sub[p] += sub[i]
        sub_link[p] += sub_link[i]
        sub_stops[p] += sub_stops[i]
        size[p] += size[i]
        paragraphs[p] += paragraphs[i]
    page_text = max(1, sub[0])
    up = [max(0, p) for p in page.parent]
    kind = {t: i + 1 for i, t in enumerate(TAGS)}
    return np.array(
        [own, sub, [s / z for s, z in zip(sub, size, strict=True)], [a / max(1, s) for a, s in zip(sub_link, sub, strict=True)], [a / max(1, s) for a, s in zip(link, own, strict=True)], depth, children, place, [children[p] for p in up], [a / max(1, s) for a, s in zip(sub_stops, sub, strict=True)], stops, [s / max(1, w) for s, w in zip(own, spaces, strict=True)], [kind.get(t, 0) for t in page.tag], good, bad, good_above, bad_above, [paragraphs[p] for p in up], [s / page_text for s in sub], [sub[p] - s for p, s in zip(up, sub, strict=True)], paragraphs],
        np.float32,
    ).T


def teacher(page: Page) -> list[int]:
    """What page markup says where it is explicit: 1 inside article or main, 0 inside what is named as something else, -1 unknown."""
    out = [-1] * len(page.tag)
    for i in range(1, len(out)):
        up = out[page.parent[i]]
        named = page.tokens[i]
        if up == 0 or named & BAD:
            out[i] = 0
        elif up == 1 or page.tag[i] in {"article", "main"}:
            out[i] = 1
    if 1 in out:  # with an article, what lies outside is not of it
        out = [0 if x < 0 and t not in {"#root", "html", "body"} else x for x, t in zip(out, page.tag, strict=True)]
    return out


class Trees:
    """Gradient-boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 5.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.base, self.made = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        self.made = []
        if not len(y):
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
        z = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            feature, limit, node = np.zeros(2**self.depth, np.int64), np.full(2**self.depth, np.inf, np.float32), np.ones(len(y), np.int64)
            for level in range(self.depth):
                first, m = 2**level, 2**level
                best, what = np.zeros(m), np.zeros((m, 2), np.int64) - 1
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    at = (node - first) * self.bins + binned[:, f]
                    gs, hs = (np.bincount(at, weights=v, minlength=m * self.bins).reshape(m, self.bins) for v in (g, h))
                    left_g, left_h = gs.cumsum(1)[:, : len(c)], hs.cumsum(1)[:, : len(c)]
                    all_g, all_h = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = left_g**2 / (left_h + self.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + self.ridge) - all_g**2 / (all_h + self.ridge)
                    k = gain.argmax(1)
                    top = gain[np.arange(m), k]
                    better = top > best + 1e-9
                    best[better] = top[better]
                    what[better] = np.stack([np.full(m, f), k], 1)[better]
                for i in range(m):
                    if what[i, 0] >= 0:
                        feature[first + i], limit[first + i] = what[i, 0], cuts[what[i, 0]][what[i, 1]]
                node = 2 * node + (x[np.arange(len(x)), feature[node]] > limit[node])
            leaf = node - 2**self.depth
            value = self.rate * np.bincount(leaf, weights=g, minlength=2**self.depth) / (np.bincount(leaf, weights=h, minlength=2**self.depth) + self.ridge)
            self.made.append((feature, limit, value))
            z += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1."""
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, value in self.made:
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (x[rows, feature[node]] > limit[node])
            z += value[node - 2**self.depth]
        return z


def decode(page: Page, z: np.ndarray) -> list[bool]:
    """Which nodes are main text, so that the sum of log-odds (weighted by own text) is largest.

    Along each path down, nodes are first undecided, then main text, then not: nothing below a rejected node is main
    text, and what is rejected inside main text is rejected with all that it holds.
    """
    n = len(page.tag)
    own = [0] * n
    for k, t, _ in page.text:
        own[k] += len(t)
    weight = (z * np.log1p(own)).tolist()
    main, open_ = weight[:], [0.0] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        main[p] += max(main[i], 0.0)
        open_[p] += max(open_[i], main[i], 0.0)
    state = [0] * n  # 0 undecided, 1 main text, 2 not
    for i in range(1, n):
        up = state[page.parent[i]]
        if up == 2:
            state[i] = 2
        elif up == 1:
            state[i] = 1 if main[i] > 0 or not own[i] and main[i] == 0 else 2
        elif main[i] > 0 and main[i] >= open_[i]:
            state[i] = 1
        else:
            state[i] = 0 if open_[i] > 0 else 2
    return [s == 1 for s in state]


def train(pages: DataFrame, most_pages: int = 400, key: str = "page_id", source: str = "html") -> Trees:
    """Fits the trees on the nodes of `most_pages` pages at most, those whose key has the least hash; of several of one key the first in order.

    Their labels are what explicit markup says (see teacher()); each node is learnt a second time without what its tags and
    attributes say, so that pages without such markup are judged by their structure.
    """
    keys = [r[0] for r in pages.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(most_pages).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in column(batch, source):
                page = parse(s or "")
                rows += [(x.tolist(), y) for x, y in zip(node_features(page), teacher(page), strict=True) if y >= 0]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.list_(pa.float32())), pa.array([y for _, y in rows], pa.int32())], ["x", "y"])

    chosen = pages.where(F.col(key).isin(keys)).groupBy(key).agg(F.min(source).alias(source)).select(source)
    rows = sorted((r.x, r.y) for r in chosen.mapInArrow(run, "x array<float>, y int").collect())
    x, y = np.array([r[0] for r in rows], np.float32).reshape(-1, len(NAMES)), np.array([r[1] for r in rows], float)
    plain = x.copy()
    plain[:, NAMED] = 0
    return Trees().fit(np.concatenate([x, plain]), np.concatenate([y, y]))


def extract(pages: DataFrame, model: Trees, key: str = "page_id", source: str = "html") -> DataFrame:
    """key, url, text and n_chars: the main text of each whole page, its blocks joined by two line ends.

    A null or empty page has an empty text; repeated rows stay. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = column(batch, source)
            for lo in range(0, len(sources), 500):
                parsed = [parse(s or "") for s in sources[lo : lo + 500]]
                z = model.predict(np.concatenate([node_features(p) for p in parsed]))
                out, at = [], 0
                for p in parsed:
                    chosen = decode(p, z[at : at + len(p.tag)])
                    at += len(p.tag)
                    out.append("\n\n".join(t for k, t, _ in p.text if chosen[k]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(out)), batch.column(1).slice(lo, len(out)), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [key, "url", "text", "n_chars"])

    return pages.select(key, "url", source).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, url string, text string, n_chars long")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, by trees that are fitted on some of the same pages.

    White space is what Unicode calls so, no-break spaces included. A null or empty page has an empty text, null ids and
    urls stay null, repeated rows stay and an empty table stays empty; pages without any markup of use leave the trees
    without labels, and then nothing is taken for main text unless its structure says so.
    """
    return extract(pages, train(pages))
