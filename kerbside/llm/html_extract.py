"""Main-text extraction from web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of elements by the usual rules (void and raw-text elements, implied ends, unclosed tags). Each element
has features: its tag, hashed tokens of its class, id and role, depth, place among its siblings, and of its subtree the
text, link share, density and punctuation, also relative to its parent. Boosted trees, trained here in numpy, give each
element the odds of being main content. A Viterbi pass over the tree then picks the most likely labelling with a
cost for each change between parent and child, so that an element and its ancestors don't contradict each other.

There are no labels for pages, so training pages are made from at most SAMPLE of the given pages (the bound is the
parameter `sample`; different texts, those with a marked article first; of each the training copy ends after LONGEST characters): their marked
article is the content, or their paragraphs where no page is marked, and blocks of the kinds that pages carry (menus, notices,
comments and so on, filled with text of other pages) are grafted around and into it under varied names, as are the
containers of the article itself and parts such as lists, tables and figures. Whole pages are extracted, whatever their length.

Edge cases: null or empty html gives an empty text; broken or cut-off markup is parsed as far as it goes; null ids and
urls are returned as they are; repeated rows give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import common as C

SAMPLE = 250
#: Characters of a training page's copy.
LONGEST = 20_000
#: Elements by what the markup's rules say of them (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output picture q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var".split())
FLOWS = INLINE | frozenset("area embed iframe img input link map meta noscript script source style svg template track wbr".split())  # these don't cut a line of text
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEVER = RAW | frozenset("head form button select nav footer aside".split())
TAGS = ("html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "a", "b", "span", "nav", "header", "footer", "aside", "form", "blockquote", "pre", "table", "figure")
#: A quote opens a value only after an equals sign, and only if it is closed.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|=|[^>=]+)*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BUCKETS = 48
SWITCH = 2.5


def raw_end(source: str, tag: str, place: int, closed: bool) -> int:
    """Where a raw element ends that starts before `place`.

    One that closes itself is empty, unless its end tag comes before another start (`<script/>...</script>`). An unclosed one goes
    on to the end of the page.
    """
    m = re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*?(/?)>", re.I).search(source, place)
    while m is not None and not m[1]:
        if closed:
            return place
        m = re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*?(/?)>", re.I).search(source, m.end())
    return m.end() if m else place if closed else len(source)


def nested_ends(source: str, tag: str) -> dict[int, int]:
    """Of drawings and templates, which nest: the end of each start tag and that of the end tag that belongs to it. Unclosed ones aren't there."""
    open_, found = [], {}
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*?(/?)>", re.I).finditer(source):
        if not m[1]:
            if not m[2]:
                open_.append(m.end())
        elif open_:
            found[open_.pop()] = m.end()
    return found


class Stack:
    """The open elements, and for each tag the places where it is open: every question takes the same time at any depth."""

    def __init__(self) -> None:
        self.nodes, self.tags, self.places = [0], ["html"], {"html": [0]}

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def last(self, tags) -> int:
        """The deepest place of one of the tags; 0 if none is open (the root isn't asked for)."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, place: int) -> None:
        while len(self.nodes) > place:
            self.nodes.pop()
            self.places[self.tags.pop()].pop()


class Page:
    """The elements in document order: tags, parents, tokens; and the text runs with the element of each."""

    def __init__(self, source: str):
        self.tags, self.parent, self.tokens, self.end = ["html"], [-1], [()], [0]
        self.runs: list[tuple[int, int, str]] = []  # element, block number, text
        stack, place, block, nested = Stack(), 0, 0, {}
        while True:
            m = TOKEN.search(source, place)
            text = source[place : m.start() if m else len(source)]
            if text:
                self.runs.append((stack.nodes[-1], block, entities.unescape(text)))
            if m is None:
                break
            place = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag not in FLOWS:
                    block += 1
                if at := stack.last((tag,)):
                    stack.close(at)
                continue
            if tag in ("html", "body") and stack.places.get(tag):
                continue
            if tag in CLOSES_P:
                at = stack.last(("p",))
                if at > stack.last(("td", "th", "button", "table")):
                    stack.close(at)
            if tag in SIBLINGS:
                at = stack.last(SIBLINGS[tag])
                if at > stack.last(("ul", "ol", "dl", "table", "select")):
                    stack.close(at)
            if tag == "br":
                self.runs.append((stack.nodes[-1], block, " "))
                continue
            if tag not in FLOWS:
                block += 1
            if tag in VOID:
                continue
            own = ()
            if m[3]:
                own = tuple(t for a in ATTRIBUTE.findall(m[3]) for t in re.split(r"[^a-z]+", (a[1] or a[2] or a[3]).lower()) if t)
            self.tags.append(tag)
            self.parent.append(stack.nodes[-1])
            self.tokens.append(own)
            closed = m[3].rstrip().endswith("/")
            if tag in ("svg", "template"):
                if not (closed and tag == "svg"):
                    if tag not in nested:
                        nested[tag] = nested_ends(source, tag)
                    place = nested[tag].get(place, place)
            elif tag in RAW:
                place = raw_end(source, tag, place, closed)
            elif not closed:
                stack.push(len(self.tags) - 1, tag)

    def text(self, chosen: np.ndarray) -> str:
        """The chosen elements' own text, block by block."""
        blocks: dict[int, list[str]] = {}
        for node, block, text in self.runs:
            if chosen[node]:
                blocks.setdefault(block, []).append(text)
        return "\n".join(x for x in (" ".join("".join(parts).split()) for parts in blocks.values()) if x)

    def features(self) -> np.ndarray:
        n = len(self.tags)
        parent = np.array(self.parent)
        own = np.zeros((n, 4))  # characters, link characters, stops, elements
        own[:, 3] = 1
        link = np.zeros(n, bool)
        depth = np.zeros(n)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
            link[i] = link[parent[i]] or self.tags[i] == "a"
        for node, _, text in self.runs:
            size = len(text.strip())
            own[node, 0] += size
            own[node, 1] += size * link[node]
            own[node, 2] += sum(map(text.count, ".,;!?"))
        whole = own.copy()
        paragraphs = np.array([t == "p" for t in self.tags], float)
        for i in range(n - 1, 0, -1):
            whole[parent[i]] += whole[i]
            paragraphs[parent[i]] += paragraphs[i]
        children = np.bincount(parent[1:], minlength=n).astype(float) if n > 1 else np.zeros(n)
        seen, order = {}, np.zeros(n)
        for i in range(1, n):
            order[i] = seen.get(parent[i], 0)
            seen[parent[i]] = order[i] + 1
        up = np.maximum(parent, 0)
        chars = whole[:, 0]
        out = np.zeros((n, 13 + 2 * (len(TAGS) + BUCKETS) + 7), np.float32)
        out[:, 0], out[:, 1], out[:, 2] = depth, order, children
        out[:, 3] = children[up] - 1
        out[:, 4] = order / np.maximum(children[up] - 1, 1)
        out[:, 5] = np.log1p(chars)
        out[:, 6] = whole[:, 1] / np.maximum(chars, 1)
        out[:, 7] = chars / whole[:, 3]
        out[:, 8] = whole[:, 2] / np.maximum(chars, 1)
        out[:, 9] = chars / np.maximum(chars[up], 1)
        out[:, 10] = chars / max(chars[0], 1)
        out[:, 11], out[:, 12] = paragraphs, own[:, 0] / np.maximum(chars, 1)
        for i, tag in enumerate(self.tags):
            if tag in TAGS:
                out[i, 13 + TAGS.index(tag)] = 1
            for t in self.tokens[i]:
                out[i, 13 + len(TAGS) + bucket(t)] = 1
        # the tags and tokens of the element and all above it, and what its parent is like
        first, width = 13, len(TAGS) + BUCKETS
        out[:, first + width : first + 2 * width] = out[:, first : first + width]
        for i in range(1, n):
            np.maximum(out[i, first + width : first + 2 * width], out[parent[i], first + width : first + 2 * width], out=out[i, first + width : first + 2 * width])
        # its text by its largest sibling's, and what its parent is like
        largest = np.zeros(n)
        np.maximum.at(largest, up[1:], chars[1:])
        among = chars / np.maximum(largest[up], 1)
        out[:, first + 2 * width :] = np.column_stack((among, among[up], out[up][:, [5, 6, 7, 10, 11]]))
        return out


def bucket(token: str) -> int:
    h = 2166136261
    for b in token.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h >> 7) % BUCKETS


class Boosted:
    """Gradient-boosted regression trees for log odds, grown level by level on binned features."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32):
        self.n_trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.binned(x)
        n, width = x.shape[1], self.bins + 1
        f, self.trees = np.zeros(len(y)), []
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (y - p), weight * p * (1 - p)
            node, feature, cut = np.zeros(len(y), np.int64), [], []
            for level in range(self.depth):
                k = 1 << level
                flat = (node[:, None] * n + np.arange(n)) * width + b
                sums = [np.bincount(flat.ravel(), np.repeat(v, n), k * n * width).reshape(k, n, width).cumsum(2) for v in (g, h)]
                (gl, hl), (gt, ht) = sums, [s[:, :1, -1:] for s in sums]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1)
                gain[:, :, -1] = -1
                best = gain.reshape(k, -1).argmax(1)
                feature.append(best // width)
                cut.append(best % width)
                node = 2 * node + (b[np.arange(len(y)), feature[-1][node]] > cut[-1][node])
            k = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, k) / (np.bincount(node, h, k) + 1)
            f += leaf[node]
            self.trees.append((feature, cut, leaf))
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        out = np.zeros(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for f, c in zip(feature, cut, strict=True):
                node = 2 * node + (b[rows, f[node]] > c[node])
            out += leaf[node]
        return out


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """The labelling of the tree with the largest sum of log odds, less SWITCH for each change from parent to child.

    Where that labels nothing as content, the element whose content speaks most for itself is taken, if any does: a page's only
    change from outside to content costs nothing.
    """
    n = len(odds)
    odds = np.clip(odds, -6, 6).tolist()
    parent = page.parent
    inline = [t in INLINE for t in page.tags]  # as their parent
    gain = [[0.0, -1e9 if t in NEVER else 0.0 if t in INLINE else odds[i]] for i, t in enumerate(page.tags)]
    cost = [1e9 if x else SWITCH for x in inline]
    for i in range(n - 1, 0, -1):
        off, on = gain[i]
        up = gain[parent[i]]
        up[0] += max(off, on - cost[i])
        up[1] += max(on, off - cost[i])
    chosen = np.zeros(n, bool)
    chosen[0] = gain[0][1] > gain[0][0]
    for i in range(1, n):
        off, on = gain[i]
        chosen[i] = on > off - cost[i] if chosen[parent[i]] else on - cost[i] > off
    if not chosen.any():
        best = max(range(n), key=lambda i: -1e9 if inline[i] else gain[i][1] - gain[i][0])
        if gain[best][1] > gain[best][0]:
            chosen[best] = True
            for i in range(best + 1, n):  # its elements alone
                if chosen[parent[i]]:
                    chosen[i] = gain[i][1] > gain[i][0] - cost[i]
    return chosen


#: Names under which training pages carry blocks and articles: (element, attribute's tokens).
BOILERPLATE = (
    ("nav", "menu"), ("ul", "menu nav"), ("div", "navbar"), ("header", "site header"), ("div", "header banner"), ("footer", ""), ("div", "footer"), ("aside", "sidebar"), ("div", "sidebar widget"), ("div", "ad"),
    ("div", "advert ads"), ("div", "sponsored promo"), ("div", "cookie notice"), ("div", "notice alert"), ("div", "banner consent"), ("form", "search"), ("form", "newsletter subscribe"), ("form", ""), ("form", "contact"),
    ("div", "related recommended"), ("ul", "share"), ("div", "share social"), ("div", "breadcrumb"), ("div", "popup modal"), ("aside", ""), ("aside", "more"), ("header", ""), ("nav", ""),
)
COMMENTS = ("comments", "comment list", "comment", "replies", "reply", "responses", "discussion", "reader comments", "thread comments", "disqus thread", "reactions")
CONTAINERS = (("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article body"), ("section", "post entry"), ("div", "main"), ("div", "story"), ("div", "story text"), ("div", "page"), ("section", ""), ("div", ""), ("div", ""))
HIDDEN = ("<template><p>{}</p></template>", "<noscript>{}</noscript>", "<script>var a='{}'</script>", "<style>p{{}}</style>", "<iframe src=a></iframe>", "<svg><text>{}</text></svg>")
MARKED = re.compile(r"<(article|main)\b[^>]*>(.*?)(?:</\1\s*>|$)", re.S | re.I)


PARAGRAPH = re.compile(r"<p\b[^>]*>.*?(?:</p\s*>|(?=<p\b)|$)", re.S | re.I)


def marked(source: str) -> str:
    """A page with a marked article: its own, or one of its paragraphs, or of its words if it has no paragraphs."""
    if MARKED.search(source):
        return source
    body = "".join(PARAGRAPH.findall(source)) or "<p>" + re.sub(r"<[^>]*>", " ", source) + "</p>"
    return f"<html><body><article>{body}</article></body></html>"


def training_page(sources: list[str], rng: random.Random) -> tuple[Page, np.ndarray]:
    """A page with its elements' labels: 1 in the article, 0 elsewhere, -1 above both. The sources have marked articles."""
    pick = rng.choice(sources)
    m = MARKED.search(pick)
    others = [re.sub(r"<[^>]*>", " ", MARKED.search(rng.choice(sources))[2]).split() for _ in range(3)]
    others = [x for x in others if x] or [["text"]]

    def prose(most: int) -> str:
        words = rng.choice(others)
        a = rng.randrange(len(words))
        return " ".join(words[a : a + rng.randint(1, most)])

    def word() -> str:
        return re.sub(r"[^a-z]", "", prose(1).lower()) or "x"

    def named(tag: str, name: str, inner: str, mark: int) -> str:
        label = rng.choice((" ", "-", "_")).join(x for x in (*name.split(), rng.choice(("", "", "box", "wrap", "inner", word()))) if x) if name else rng.choice(("", "", word()))
        return f'<{tag} data-k={mark}{f""" {rng.choice(("class", "id"))}="{label}\"""" if label else ""}>{inner}</{tag}>'

    def comments() -> str:
        """Blocks of one shape, one for each reader, perhaps with a name and a date, under a name that says so."""
        tag, shape = rng.choice((("div", "div"), ("section", "div"), ("section", "p"), ("div", "p"), ("ol", "li"), ("ul", "li"), ("div", "article")))
        by = rng.choice(("", "", f"<b>{prose(2)}</b> ", f"<span class=author>{prose(2)}</span> <time>{rng.randint(1, 28)} May</time> ", f"<h4>{prose(2)}</h4>"))
        each = "".join(f"<{shape}>{by}{f'<p>{prose(40)}</p>' if shape not in ('p',) and rng.random() < 0.5 else prose(40)}</{shape}>" for _ in range(rng.randint(1, 6)))
        head = rng.choice(("", "", f"<h3>{prose(2)}</h3>")) if tag not in ("ol", "ul") else ""
        return named(tag, rng.choice(COMMENTS), head + each, 0)

    def graft() -> str:
        tag, name = rng.choice(BOILERPLATE)
        if tag == "form":
            fields = "".join(rng.choice((f"<label>{prose(3)}</label><input name=q>", f"<p>{prose(12)}</p>", "<input type=text>", f"<textarea>{prose(3)}</textarea>")) for _ in range(rng.randint(1, 3)))
            return named(tag, name, fields + rng.choice((f"<button>{prose(2)}</button>", "<input type=submit>", "")), 0)
        kind = rng.random()
        link = kind < 0.4
        items = [f'<a href="/">{prose(3)}</a>' if link else f"<p>{prose(60)}</p>" if kind < 0.8 else prose(25) for _ in range(rng.randint(1, 6) if kind < 0.8 else 1)]
        return named(tag, name, "".join(f"<li>{x}</li>" if tag == "ul" or (link and rng.random() < 0.7) else x for x in items), 0)

    def inserted(body: str, part: str, end: float = 0.3) -> str:
        """A part before some block of the body, or at its end."""
        places = [x.start() for x in re.finditer(r"<(?:p|h\d|div)\b|<br><br>", body)]
        at = rng.choice(places) if places and rng.random() > end else len(body)
        return body[:at] + part + body[at:]

    # some of the paragraphs, in one of the shapes that articles have; links and marks in running text are part of it
    heading = (re.findall(r"<h1\b[^>]*>.*?</h1\s*>", m[2], re.S) or [""])[0]
    paragraphs = [x for x in re.split(r"</?p\b[^>]*>", m[2].replace(heading, "")) if x.strip()][: rng.randint(1, 9)] or [prose(30)]
    if rng.random() < 0.2:
        paragraphs = [prose(rng.choice((15, 40, 90))) for _ in range(rng.randint(1, 8))]
    paragraphs = [(f'{prose(8)} <a href="/">{prose(3)}</a> ' if rng.random() < 0.2 else f"<em>{prose(2)}</em> " if rng.random() < 0.1 else "") + x for x in paragraphs]
    shape = rng.random()
    if shape < 0.35:
        body = "".join(f"<p>{x}" + rng.choice(("", "</p>")) for x in paragraphs)
    elif shape < 0.6:
        body = "".join(f"<p{rng.choice(('', f' class={word()}'))}>{x}</p>" for x in paragraphs)
    elif shape < 0.8:
        body = "".join(f"<div>{x}</div>" for x in paragraphs)
    else:
        body = rng.choice(("<br><br>", "<br><br>", "<br>")).join(paragraphs)
    for _ in range(rng.choice((0, 0, 0, 1, 2))):  # article parts of other kinds
        rows = range(rng.randint(1, 4))
        part = rng.choice((
            f"<ul>{''.join(f'<li>{prose(20)}</li>' for _ in rows)}</ul>",
            f"<ol>{''.join(f'<li>{prose(20)}</li>' for _ in rows)}</ol>",
            f"<table>{''.join(f'<tr><th>{prose(3)}</th><td>{prose(5)}</td></tr>' for _ in rows)}</table>",
            f"<table><tbody>{''.join(f'<tr><td>{prose(3)}</td><td>{prose(3)}</td></tr>' for _ in rows)}</tbody></table>",
            f"<dl>{''.join(f'<dt>{prose(3)}</dt><dd>{prose(20)}</dd>' for _ in rows)}</dl>",
            f"<figure><img src=a.png><figcaption>{prose(12)}</figcaption></figure>",
            f"<pre>{prose(20)}</pre>",
            f"<blockquote><p>{prose(40)}</p></blockquote>",
            f"<h2>{prose(6)}</h2><p>{prose(80)}</p>",
            f"<div><p>{prose(60)}</p></div>",
        ))
        body = inserted(body, part)
    for _ in range(rng.choice((0, 0, 1))):
        body = inserted(body, rng.choice(HIDDEN).format(prose(6)))
    for _ in range(rng.choice((0, 0, 1, 2))):  # blocks of other kinds within the article
        body = inserted(body, graft())
    after = rng.random()
    if after < 0.2:
        body += comments()
    if heading and (where := rng.random()) < 0.7:
        body = heading + body
    if rng.random() < 0.25:
        body = f"<div>{body}</div>"
    article = named(*rng.choice(CONTAINERS), body, 1)
    if heading and where > 0.85:
        article = heading.replace("<h1", "<h1 data-k=1", 1) + article
    if 0.2 < after < 0.45:
        article += comments()
    shell = rng.random()
    outside = [graft() for _ in range(rng.randint(0, 3))], [graft() for _ in range(rng.randint(0, 3))]
    if shell < 0.35:  # the page's own surroundings
        made = pick[: m.start()] + "".join(outside[0]) + article + "".join(outside[1]) + pick[m.end() :]
    else:
        if shell < 0.6:  # a short page's
            outside = [named("nav", "", f'<a href="/">{prose(2)}</a>', 0)], [named("footer", "", prose(4), 0)]
        made = "".join(outside[0]) + article + "".join(outside[1])
        for _ in range(rng.choice((0, 0, 1, 2))):
            tag = rng.choice(("div", "div", "main", "section"))
            made = f"<{tag}{rng.choice(('', f' id={word()}', ' class=wrapper', ' class=container'))}>{made}</{tag}>"
        made = f"<html><body>{made}</body></html>"
    page = Labelled(made)
    return page, page.labels()


class Labelled(Page):
    """A training page: elements know the mark data-k of their nearest marked ancestor."""

    def __init__(self, source: str):
        self.marks: list[int] = []
        super().__init__(re.sub(r"data-k=(\d)( (?:class|id)=\"([^\"]*)\")?", lambda m: f'class="{m[3] or ""} kmark{"no" if m[1] == "0" else "yes"}"', source))

    def labels(self) -> np.ndarray:
        marks = [1 if "kmarkyes" in t else 0 if "kmarkno" in t else None for t in self.tokens]
        self.tokens = [tuple(x for x in t if not x.startswith("kmark")) for t in self.tokens]
        out = np.zeros(len(marks), np.int64)
        for i in range(len(marks)):
            out[i] = marks[i] if marks[i] is not None else out[self.parent[i]] if i and out[self.parent[i]] >= 0 else 0
        inside = np.array([bool(x == 1) for x in marks])
        for i in range(len(marks) - 1, 0, -1):
            if inside[i] and marks[self.parent[i]] != 1:
                inside[self.parent[i]] = True
                if out[self.parent[i]] == 0:
                    out[self.parent[i]] = -1
        return out


def train(sources: list[str], pages: int = 1500, seed: int = 0) -> Boosted:
    """Trees over the elements of made pages; containers that hold both kinds count as outside, at a low weight."""
    rng = random.Random(seed)
    own = [x for x in sources if MARKED.search(x)] or [marked(x) for x in sources or [""]]
    made = [training_page(own, rng) for _ in range(pages)]
    x = np.concatenate([p.features() for p, _ in made])
    y = np.concatenate([labels for _, labels in made])
    return Boosted().fit(x, (y == 1).astype(float), np.where(y < 0, 0.3, 1.0))


def extract(model: Boosted, sources: list[str]) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    x = [p.features() for p in pages]
    odds = model.log_odds(np.concatenate(x))
    bounds = np.cumsum([0, *map(len, x)])
    return [p.text(decode(p, odds[a:b])) for p, a, b in zip(pages, bounds[:-1], bounds[1:], strict=True)]


def extract_pages(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    own = C.with_defaults(pages, page_id="bigint", url="string", html="string")
    # of each of `sample` shares of the texts' hashes the least one, marked pages first
    place = F.shiftrightunsigned(F.xxhash64("html"), 2) + F.when(F.col("html").rlike(r"(?i)<(article|main)\b"), F.lit(0)).otherwise(F.lit(1 << 62))
    copies = own.where("html is not null").select(F.substring("html", 1, LONGEST).alias("html")).withColumn("place", place)
    least = [r["place"] for r in copies.groupBy(F.col("place").bitwiseAND(F.lit((1 << 62) - 1)) % F.lit(sample)).agg(F.min("place").alias("place")).collect()]  # at most `sample` numbers
    chosen = copies.where(F.col("place").isin(least)).groupBy("place").agg(F.min("html").alias("html")).orderBy("place").collect()  # at most `sample` copies of LONGEST characters
    shared = pages.sparkSession.sparkContext.broadcast(train([r["html"] for r in chosen]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for first in range(0, batch.num_rows, 64):
                texts += extract(shared.value, [x or "" for x in batch.column(2).slice(first, 64).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return own.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
