"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text inside a tree of elements; both are nodes of a graph. A logistic classifier,
trained here on generated pages, gives each block a cost from its text and layout alone, and a second one gives a
cost to each element whose tag or name tells what it is for: the capacities to the two terminals. Smoothness edges
join blocks that follow each other, the nearer in the tree the stronger, and blocks and elements with the element
that holds them. The minimum cut labels all of them at once: what a block looks like, what it stands in and what
it stands beside are weighed together.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shipped
from tessera.llm.mincut import min_cut

# Elements of HTML by their role.
RAW = frozenset("script style noscript template textarea svg math iframe object canvas select button title".split())
#: Of these, the ones that browsers read up to the page's end where the end tag is missing.
TO_END = frozenset("script style textarea iframe title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav aside footer form menu dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
CONTAINERS = frozenset("address article aside body details dialog div dl fieldset footer form header hgroup html main menu nav section table".split())
#: Signs of the page itself where it has an element for the main text.
OUTSIDE = (0.0,) * 9 + (1.0,)
# Words of class, id and role that tell what an element is for.
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertisements adverts alert banner bottombar breadcrumb breadcrumbs comment commentlist comments "
    "consent cookie cookies copyright discussion disqus dropdown footer form gdpr header legal login masthead menu menubar modal nav "
    "navbar navbox navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion reactions "
    "recommended register related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags toolbar topbar warning widget widgets complementary contentinfo".split()
)
MAIN_WORDS = frozenset("article body content entry main post story text".split())

#: Elements nested deeper are read as lying side by side, as browsers do.
DEPTH = 512

_SCAN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
_PART = re.compile(r"[A-Z]*[a-z]+|[A-Z]+")
_ENDS = tuple(".!?…:;\"”»")


@dataclass
class Element:
    tag: str
    parent: int
    main: bool  # here or further up is an element for the main text
    signs: tuple[float, ...] | None  # what its tag and name tell; None if nothing


@dataclass
class Block:
    """A run of text inside one block element."""

    parent: int
    order: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Elements (0 is the page itself) and the blocks that hold text, in page order."""
    elements = [Element("", -1, False, None)]
    stack, links, blocks = [0], 0, []
    now: Block | None = None
    at, n = 0, len(page)
    last = max(page.rfind(">") + 1, n if "<!--" in page else 0)  # beyond it no tag can end

    def text(piece: str) -> None:
        nonlocal now
        if not piece:
            return
        holder = next(e for e in reversed(stack) if elements[e].tag in BLOCK or e == 0 or apart(elements[e]))
        if now is None or now.parent != holder:
            if not piece.strip():
                return
            now = Block(holder, len(blocks))
            blocks.append(now)
        piece = _html.unescape(piece) if "&" in piece else piece
        now.pieces.append(piece)
        if links:
            now.linked += len(piece)

    def leave(to: int) -> None:
        nonlocal links, now
        while len(stack) > to:
            gone = stack.pop()
            tag = elements[gone].tag
            links -= tag == "a"
            if tag in BLOCK or apart(elements[gone]):
                now = None

    endless: set[str] = set()
    while at < n:
        m = _SCAN.search(page, at, last)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if elements[stack[k]].tag == tag:
                    leave(k)
                    break
            if tag in BLOCK:
                now = None
            continue
        attrs = m[3] if m[2] else m[6]
        closed = attrs.endswith("/")
        if tag == "head":  # its end tag may be left out; it holds no text but that of elements in RAW
            continue
        if tag in RAW and not closed:
            end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if not end:
                endless.add(tag)  # so that no page is searched to its end more than once a tag
            if end or tag in TO_END:
                at = end.end() if end else n
            continue  # without its end tag any other is passed over, and what follows is text like other text
        if tag in ("br", "hr", "wbr", "img", "input"):
            if tag == "hr":
                now = None
            elif now and tag != "wbr":
                now.pieces.append(" ")
        if tag in VOID or closed:
            continue
        if tag in CLOSES_P:
            now = None
            if tag in ("li", "dd", "dt", "tr", "td", "th"):
                for k in range(len(stack) - 1, 0, -1):
                    t = elements[stack[k]].tag
                    if t == tag or t in ("dd", "dt") and tag in ("dd", "dt") or t in ("td", "th") and tag in ("td", "th"):
                        leave(k)
                        break
                    if t in ("ul", "ol", "dl", "table", "menu"):
                        break
            for k in range(len(stack) - 1, 0, -1):
                t = elements[stack[k]].tag
                if t == "p":
                    leave(k)
                    break
                if t in BLOCK:
                    break
        if len(stack) > DEPTH:
            leave(DEPTH)
        up = elements[stack[-1]]
        whole, parts, hidden = set(), set(), False
        if attrs:
            for key, *values in _NAMES.findall(attrs):
                hidden |= key.lower() == "hidden"
                for name in "".join(values).split():
                    found = [w.lower() for w in _PART.findall(name)]
                    (whole if len(found) == 1 else parts).update(found)
        signs = (
            float(tag in BOILER_TAGS),
            float(tag in MAIN_TAGS),
            float(tag == "header" and not up.main),
            float(bool(whole & BOILER_WORDS)),
            float(bool(parts & BOILER_WORDS)),
            float(bool(whole & MAIN_WORDS)),
            float(bool(parts & MAIN_WORDS)),
            float(hidden),
            float(bool((whole | parts) & BOILER_WORDS) and bool((whole | parts) & MAIN_WORDS)),
            0.0,
        )
        elements.append(Element(tag, stack[-1], up.main or tag in MAIN_TAGS, signs if any(signs) and tag not in ("html", "body") else None))
        stack.append(len(elements) - 1)
        links += tag == "a"
        if apart(elements[-1]):
            now = None
    if any(e.main for e in elements):
        elements[0].signs = OUTSIDE
    for b in blocks:
        raw = "".join(b.pieces)
        b.text = " ".join(raw.split())
        b.linked = min(b.linked, len(raw))
    return elements, [b for b in blocks if b.text]


def apart(element: Element) -> bool:
    """Named as boilerplate or hidden: its text is a block of its own even inside a line."""
    return element.signs is not None and bool(element.signs[3] or element.signs[7])


def features(elements: list[Element], blocks: list[Block]) -> list[list[float]]:
    """What a block's text and its own element tell, whatever it stands in."""
    out = []
    for b in blocks:
        e = elements[b.parent]
        words, size = b.text.count(" ") + 1, len(b.text)
        out.append(
            [
                1.0,
                min(math.log1p(words), 5.0),
                min(1.0, b.linked / size),
                float(e.tag in HEADINGS),
                float(e.tag in ("p", "blockquote", "pre")),
                float(e.tag in ("li", "td", "th", "dt", "dd")),
                float(b.text.endswith(_ENDS)),
            ]
        )
    return out


def governors(elements: list[Element], blocks: list[Block]) -> dict[int, int]:
    """Elements with signs, and how many blocks have them as the nearest such element."""
    out: dict[int, int] = {}
    for b in blocks:
        e = b.parent
        while e >= 0 and elements[e].signs is None:
            e = elements[e].parent
        if e >= 0:
            out[e] = out.get(e, 0) + 1
    return out


def _train_page(rng: random.Random) -> str:
    """A generated page; words of content begin with k, others with z.

    Names are often neutral, and some belong to the other side: a text in ``related-article``, an advert in ``content``.
    """
    plain = "site js c block wrap inner outer box row col grid item unit layout region zone panel x1 b42".split()

    def words(k: str, low: int, high: int) -> str:
        return " ".join(k + "".join(rng.choice(("ra", "lo", "ti", "en", "us")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def name(own: frozenset[str], other: frozenset[str]) -> str:
        out = []
        for _ in range(rng.randint(1, 2)):
            kind = rng.random()
            w = rng.choice(sorted(own if rng.random() < (0.98 if kind < 0.65 else 0.85) else other))
            out.append(rng.choice(plain) if kind < 0.35 else w if kind < 0.65 else f"{rng.choice(plain)}-{w}" if kind < 0.85 else f"{w}-{rng.choice(sorted(other if rng.random() < 0.3 else own))}")
        return f"{rng.choice(('class', 'class', 'id'))}='{' '.join(out)}'"

    def boiler(inside: bool) -> str:
        w, named = lambda a, b: words("z", a, b), name(BOILER_WORDS, MAIN_WORDS)
        items = "".join(f"<li><a href='/'>{w(1, 5)}</a></li>" for _ in range(rng.randint(2, 7)))
        stop = rng.choice((".", "", "!", "…"))
        kinds = [
            f"<div {named}>{w(3, 40)}{stop}</div>",
            f"<div hidden {named if rng.random() < 0.5 else ''}><p>{w(3, 40)}{stop}</p></div>",
            f"<div {named}><p>{w(3, 60)}{stop}</p></div>",
            f"<div {named}><ul>{items}</ul></div>",
            f"<section {named}><div><p>{w(5, 60)}.</p><p>{w(2, 30)}</p></div></section>",
            f"<aside><h3>{w(1, 4)}</h3><p>{w(5, 40)}.</p></aside>",
            f"<form><label>{w(1, 4)}</label><p>{w(2, 15)}</p></form>",
            f"<ul>{items}</ul>",
            f"<p><a href='/'>{w(1, 4)}</a></p>",
            f"<p>{w(1, 4)}</p>",
        ]
        if not inside:
            kinds += [f"<nav><ul>{items}</ul></nav>", f"<footer><p>{w(3, 30)}.</p></footer>", f"<header><a href='/'>{w(1, 3)}</a><p>{w(1, 8)}</p></header>", f"<div><p>{w(1, 6)}</p></div>"]
        return rng.choice(kinds)

    def content() -> str:
        kind, w = rng.randrange(9), lambda a, b: words("k", a, b)
        if kind == 7:
            return f"<ul><li>{w(2, 20)}</li><li>{w(2, 20)}.</li></ul>"
        if kind == 8:
            return f"<blockquote>{w(4, 40)}.</blockquote>"
        stop = rng.choice((".", ".", ".", "", "!", "…", " |"))
        return f"<h2>{w(1, 8)}</h2>" if kind == 6 else f"<p>{w(1, 6)}{stop}</p>" if kind == 5 else f"<p>{w(1, 90)}{stop}</p>" if kind else f"<p>{w(4, 60)} <a href='/'>{w(1, 3)}</a>{stop}</p>"

    body = [f"<h1>{words('k', 2, 10)}</h1>", *(content() for _ in range(rng.randint(1, 9)))]
    for _ in range(rng.randrange(3)):
        body.insert(rng.randint(1, len(body)), boiler(True))
    kind = rng.random()
    start, end = ("<article>", "</article>") if kind < 0.3 else ("<main>", "</main>") if kind < 0.4 else (f"<div {name(MAIN_WORDS, BOILER_WORDS)}>", "</div>") if kind < 0.8 else ("<div>", "</div>")
    before, after = [boiler(False) for _ in range(rng.randint(0, 4))], [boiler(False) for _ in range(rng.randint(0, 4))]
    return "".join([*before, start, *body, end, *after])


@dataclass(frozen=True)
class Weights:
    """Of the two classifiers: for blocks, and for elements that have signs."""

    block: tuple[float, ...]
    element: tuple[float, ...]


@lru_cache
def train(pages: int = 600, seed: int = 5, rounds: int = 400) -> Weights:
    """Both classifiers, by gradient descent on ``pages`` generated pages (the bound of their sample)."""
    rng = random.Random(seed)
    text, named = ([], []), ([], [])
    for _ in range(pages):
        elements, blocks = parse(_train_page(rng))
        truth = [b.text.startswith("k") for b in blocks]
        for b, t, f in zip(blocks, truth, features(elements, blocks), strict=True):
            if not set(governors(elements, [b])) - {0}:  # where no sign tells, text has to
                text[0].append(f)
                text[1].append(t)
        kept: dict[int, list[bool]] = {}
        for b, t in zip(blocks, truth, strict=True):
            for e in governors(elements, [b]):
                kept.setdefault(e, []).append(t)
        for e, t in kept.items():
            named[0].append([1.0, *elements[e].signs])
            named[1].append(2 * sum(t) > len(t))

    def fit(x: list, y: list) -> tuple[float, ...]:
        a, b = np.array(x), np.array(y, float)
        w, share = np.zeros(a.shape[1]), np.where(b > 0, 0.5 / b.sum(), 0.5 / (1 - b).sum())  # both classes count alike
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-a @ w))
            w -= 2.0 * (a.T @ ((p - b) * share) + 1e-4 * w)
        return tuple(float(v) for v in w)

    return Weights(fit(*text), fit(*named))


#: Costs are whole thousandths. Text alone is held within HIGH, a block of links may go lower by LINKED; signs are held
#: within SURE for each block that they govern.
SCALE, HIGH, LINKED, SURE = 1000, 2000, 1500, 5000
#: Edges: between a block and the one after it, less the further apart they stand; between a block or element and what
#: holds it (more than HIGH, so that no block outvotes a clear sign); and for a part of another kind inside a container.
FOLLOWS, HOLDS, OTHER = 600, 2500, 300


def graph(elements: list[Element], blocks: list[Block], weights: Weights) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """Costs of all nodes, blocks first and then the elements above them, and the edges between."""
    score = np.array(features(elements, blocks)) @ np.array(weights.block)
    links = [min(1.0, b.linked / len(b.text)) for b in blocks]
    unary = [int(max(-HIGH - share * LINKED, min(HIGH, v * SCALE))) for v, share in zip(score, links, strict=True)]
    node: dict[int, int] = {}
    edges = []

    def of(element: int) -> int:
        """The node of an element; where it is new, with those above it. The page itself holds nothing together."""
        at = element
        while at >= 0 and at not in node:
            node[at] = len(unary)
            unary.append(0)
            at = elements[at].parent
        at = element
        while at > 0 and (up := elements[at].parent) > 0 and elements[up].tag not in ("html", "body"):
            if (at, up) in linked:
                break
            linked.add((at, up))
            edges.append((node[at], node[up], HOLDS, OTHER if elements[at].tag in CONTAINERS or elements[at].signs else HOLDS))
            at = up
        return node[element]

    linked: set[tuple[int, int]] = set()
    for k, b in enumerate(blocks):
        edges.append((k, of(b.parent), HOLDS, HOLDS))
    for e, n in governors(elements, blocks).items():
        value = float(np.dot((1.0, *elements[e].signs), weights.element))
        if e:
            unary[of(e)] += n * int(max(-SURE, min(SURE, value * SCALE)))
    if elements[0].signs:  # blocks that stand outside the page's main element
        value = int(max(-SURE, min(SURE, float(np.dot((1.0, *elements[0].signs), weights.element)) * SCALE)))
        for k, b in enumerate(blocks):
            if 0 in governors(elements, [b]):
                unary[k] += value
    chains = [_chain(elements, b.parent) for b in blocks]
    for k in range(1, len(blocks)):
        a, b = chains[k - 1], chains[k]
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        w = FOLLOWS // (1 + max(0, len(a) - same - 1) + max(0, len(b) - same - 1))
        edges.append((k - 1, k, w, w))
    return unary, edges


def _chain(elements: list[Element], element: int) -> list[int]:
    out = []
    while element >= 0:
        out.append(element)
        element = elements[element].parent
    return out[::-1]


def labels(elements: list[Element], blocks: list[Block], weights: Weights) -> list[bool]:
    """Content (True) or boilerplate for each block, by the minimum cut. A page without any element is text as it stands."""
    if len(elements) == 1:
        return [True] * len(blocks)
    return min_cut(*graph(elements, blocks, weights))[: len(blocks)] if blocks else []


def main_text(page: str | None, weights: Weights) -> str:
    """The article's blocks joined by an empty line; empty if there are none."""
    if not page:
        return ""
    elements, blocks = parse(page)
    return "\n\n".join(b.text for b, keep in zip(blocks, labels(elements, blocks, weights), strict=True) if keep)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars (code points). Pages are not shuffled.

    A null or empty page, or one without content, has the empty text. Repeated rows give repeated results; only
    key, url and html are read.
    """
    weights = train()

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["key", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.transform(shipped).mapInArrow(run, "key long, url string, text string, n_chars long").withColumnRenamed("key", key)
