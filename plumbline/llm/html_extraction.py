"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a node with a hidden state, content or not.  A child's state depends on its parent's and on the child's
tag; class words, text length and link share are evidence.  Sum-product messages passed up and down the tree give each
element's probability of being content.  The tables are counts over labelled pages.
"""
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import pick

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text that a page never shows as reading matter: code, titles, controls, and the source notation beside a formula.
HIDDEN = frozenset("script style head title template iframe select textarea button annotation annotation-xml desc metadata".split())
RAW = frozenset("script style title textarea iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Elements and class words that are not the article by their meaning; the prior of the model and of the page labels.  A
#: class, id or role counts as a whole ("header", not "legal-header") and on containers alone: the ids of headings and
#: paragraphs are slugs of their own text, and classes of cells and inline text are styles.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie consent footer form header legal login masthead menu "
    "nav navbar navigation newsletter notice pagination popup promo promotion related reply respond share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget".split())
MAIN_TAGS = frozenset(["article", "main"])
NAMED = frozenset("address article center details dir div dl fieldset figure li ol section summary table ul".split())
#: Attributes as HTML reads them: a quote opens a value after "=" only, a value ends at its own quote however long it is; a
#: quote that nothing closes is a character like others.
VALUE = r"\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))"
ATTRIBUTES = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:" + re.sub(r"\((?!\?)", "(?:", VALUE) + r"|\s*+=)?+)*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})>", re.S)
ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:{VALUE}|\s*+=)?+")
SPACE = re.compile(r"[ \t\n\r\f\v  -     　 \x85]+")
BUCKETS = 512
PRIOR, SMOOTH = 50.0, 50.0
#: Sightings that the name of an aside part is worth, and the most that one class word tilts the log odds.
NAME_PRIOR, WORD_MOST = 20.0, 2.0
#: Text evidence says nothing below so many sightings, and tilts the odds by a factor of e to the MOST at most: many short
#: paragraphs shall not outweigh the element they stand in.
LEAST, MOST = 20, 1.0


@dataclass
class Page:
    """Elements in page order and the text runs with element and block number."""
    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    words: list[tuple[str, ...]] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    runs: list[tuple[int, int, str]] = field(default_factory=list)


def parse(html: str) -> Page:
    """Tolerant element tree: void and unclosed elements, implied ends, stray end tags.  Hidden elements have no text."""
    page = Page([-1], ["#root"], [()], [0])
    stack, block, at, hidden = [0], 0, 0, 0

    def text(until: int) -> None:
        if until > at and not hidden:
            page.runs.append((stack[-1], block, html[at:until]))

    def pop() -> None:
        nonlocal hidden
        hidden -= page.tag[stack.pop()] in HIDDEN

    while m := TOKEN.search(html, at):
        text(m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        block += tag in BLOCK
        if m[1]:
            if any(page.tag[i] == tag for i in stack):
                while page.tag[stack[-1]] != tag:
                    pop()
                pop()
            continue
        if tag in BLOCK and tag != "hr" and any(page.tag[i] == "p" for i in stack[-12:]) or tag == "p":
            for k in range(len(stack) - 1, 0, -1):
                name = page.tag[stack[k]]
                if name == "p":
                    while len(stack) > k:
                        pop()
                    break
                if name in BLOCK:
                    break
        for k in range(len(stack) - 1, 0, -1):
            name = page.tag[stack[k]]
            if name in SCOPE.get(tag, ()) or tag not in CLOSES:
                break
            if name in CLOSES[tag]:
                while len(stack) > k:
                    pop()
        words = tuple(w for a in ATTRIBUTE.finditer(m[3]) if a[1].lower() in ("class", "id", "role")
                      for w in unescape(a[2] or a[3] or a[4] or "").lower().split()) if m[3] else ()
        page.parent.append(stack[-1])
        page.tag.append(tag)
        page.words.append(words)
        page.depth.append(len(stack))
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            if tag == "br" and not hidden:
                page.runs.append((stack[-1], block, " "))
            continue
        stack.append(len(page.tag) - 1)
        hidden += tag in HIDDEN
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(html, at)
            at = end.start() if end else len(html)
    text(len(html))
    return page


def labels(page: Page) -> np.ndarray:
    """States that a page's own markup gives: inside an article or main element and not inside an aside part.  A part named
    as aside that holds half of the text or more is the article under an unlucky name."""
    out = np.zeros(len(page.tag), bool)
    main = [-1] * len(page.tag)  # the outermost article or main element around
    cut = np.zeros(len(page.tag), bool)
    chars, _ = _sizes(page)
    for i, up in enumerate(page.parent):
        main[i] = main[up] if up >= 0 and main[up] >= 0 else i if page.tag[i] in MAIN_TAGS else -1
        aside = page.tag[i] in ASIDE_TAGS or page.tag[i] in HIDDEN or main[i] >= 0 and _named(page, i) and 2 * chars[i] < chars[main[i]]
        cut[i] = aside or (up >= 0 and cut[up])
        out[i] = main[i] >= 0 and not cut[i]
    return out


def _named(page: Page, i: int) -> bool:
    return page.tag[i] in NAMED and any(w in ASIDE_WORDS for w in page.words[i])


def masked(page: Page) -> Page:
    """The page without telling tags and class words: it trains the evidence of text alone."""
    tags = ["div" if t in MAIN_TAGS or t in ASIDE_TAGS else t for t in page.tag]
    return Page(page.parent, tags, [()] * len(tags), page.depth, page.runs)


def kinds(page: Page) -> list[str]:
    """What the step into an element depends on: its tag, or that a container's class words name an aside part."""
    return ["#aside" if _named(page, i) else tag for i, tag in enumerate(page.tag)]


def _group(tag: str) -> str:
    return tag if tag in ("p", "li", "a", "div", "section") else "heading" if tag[:1] == "h" and tag[1:].isdigit() else "block" if tag in BLOCK else "inline"


def _sizes(page: Page) -> tuple[list[int], list[int]]:
    """Characters of each element's subtree, and those of them inside links."""
    n = len(page.tag)
    chars, linked, inside = [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        inside[i] = page.tag[i] == "a" or inside[page.parent[i]]
    for node, _, run in page.runs:
        size = len(run.strip())
        chars[node] += size
        linked[node] += size if inside[node] else 0
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
        linked[page.parent[i]] += linked[i]
    return chars, linked


def evidence(page: Page) -> list[list[str]]:
    """Evidence of every element: class words by hash, text length and link share of the subtree by kind of element."""
    chars, linked = _sizes(page)
    out = []
    for i in range(len(page.tag)):
        kind = _group(page.tag[i])
        share = linked[i] / chars[i] if chars[i] else 0.0
        out.append([f"len|{kind}|{min(6, (chars[i] + 15).bit_length() - 4) if chars[i] else 0}", f"link|{kind}|{math.ceil(share * 4)}",
                    *{f"word|{xxhash.xxh32_intdigest(w) % BUCKETS}" for w in page.words[i]}])
    return out


def count(page: Page, states: np.ndarray, into: Counter) -> None:
    for i, (kind, found) in enumerate(zip(kinds(page), evidence(page))):
        y = int(states[i])
        if i:
            into[f"step|{kind}|{int(states[page.parent[i]])}|{y}"] += 1
        into[f"all|{y}"] += 1
        for f in found:
            into[f"{f}|{y}"] += 1


class Model:
    """Log potentials from counts.  Rare evidence leans to what both states share.  Aside parts carry a prior whatever their
    parent is, so that an article is not doubted for a share bar inside it."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total = [counts.get(f"all|{y}", 0) + 1.0 for y in (0, 1)]
        self.kinds: dict[str, list[float]] = {}
        for key, n in counts.items():
            name, kind, *rest = key.split("|")
            if name in ("len", "link"):
                self.kinds.setdefault(f"{name}|{kind}", [0.0, 0.0])[int(rest[1])] += n
        self._steps: dict[str, np.ndarray] = {}
        self._weights: dict[str, np.ndarray] = {}

    def step(self, tag: str) -> np.ndarray:
        """log P(child | parent) as [parent, child] for a child's tag."""
        if tag not in self._steps:
            c = np.array([[self.counts.get(f"step|{tag}|{p}|{y}", 0) for y in (0, 1)] for p in (0, 1)], float)
            c += np.array([[0.97, 0.03], [0.03, 0.97]])
            if tag == "#aside":
                c[:, 0] += NAME_PRIOR
            elif tag in ASIDE_TAGS or tag in HIDDEN:
                c[:, 0] += PRIOR
            elif tag in MAIN_TAGS:
                c[:, 1] += PRIOR
            self._steps[tag] = np.log(c / c.sum(axis=1, keepdims=True))
        return self._steps[tag]

    def weight(self, f: str) -> np.ndarray:
        """log P(evidence | state) for both states."""
        if f not in self._weights:
            seen = [float(self.counts.get(f"{f}|{y}", 0)) for y in (0, 1)]
            name, kind, *_ = f.split("|")
            if name == "word":
                w, most = [(seen[y] + 0.5) / (self.total[y] + 1) for y in (0, 1)], WORD_MOST
            else:
                of = self.kinds.get(f"{name}|{kind}", [0.0, 0.0])
                both = (sum(seen) + 0.1) / (sum(of) + 1.0)
                w, most = [(seen[y] + SMOOTH * both) / (of[y] + SMOOTH) for y in (0, 1)], MOST
            tilt = float(np.clip(math.log(w[1] / w[0]), -most, most)) if sum(seen) >= LEAST else 0.0
            self._weights[f] = np.array([-tilt / 2, tilt / 2])
        return self._weights[f]


def marginals(pages: list[Page], model: Model) -> list[np.ndarray]:
    """P(content) of every element of many pages: messages pass level by level, upward then downward, for all at once."""
    sizes = [len(p.tag) for p in pages]
    first = np.cumsum([0, *sizes])
    parent = np.concatenate([np.array(p.parent) + f for p, f in zip(pages, first)])
    depth = np.concatenate([np.array(p.depth) for p in pages])
    steps = np.stack([model.step(k) for p in pages for k in kinds(p)])
    up = np.stack([sum((model.weight(f) for f in found), np.zeros(2)) for p in pages for found in evidence(p)])
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1)))
    message = np.zeros_like(up)  # to the parent, by the parent's state
    for nodes in reversed(levels[1:]):
        message[nodes] = np.logaddexp.reduce(steps[nodes] + up[nodes][:, None, :], axis=2)
        np.add.at(up, parent[nodes], message[nodes])
    full = up.copy()
    full[levels[0]] += np.log([0.999, 0.001])
    for nodes in levels[1:]:
        above = full[parent[nodes]] - message[nodes]  # what the parent knows without this child
        full[nodes] += np.logaddexp.reduce(steps[nodes] + above[:, :, None], axis=1)
        full[nodes] -= full[nodes].max(axis=1, keepdims=True)
    content = 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -700, 700)))
    return np.split(content, first[1:-1])


def blocks(page: Page, content: np.ndarray) -> str:
    """Text of the content elements: references decoded, white space of a block as one space, a block per line."""
    out: list[str] = []
    last = None
    for node, block, run in page.runs:
        if content[node] >= 0.5:
            if block != last:
                out.append("")
            out[-1] += run
            last = block
    lines = (SPACE.sub(" ", unescape(x)).strip(" ") for x in out)
    return "\n".join(x for x in lines if x)


def train(labelled: DataFrame, max_pages: int = 3000) -> dict[str, int]:
    """Counts over about ``max_pages`` pages (page_id, html) chosen by hash, each as it is and masked.  Pages without an
    article or main element carry no label and are left out."""
    n = labelled.count()
    below = int(1_000_000 * min(1.0, max_pages / max(n, 1)))
    chosen = labelled.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for html in batch.column("html").to_pylist():
                page = parse(html or "")
                if any(t in MAIN_TAGS for t in page.tag):
                    states = labels(page)
                    count(page, states, found)
                    count(masked(page), states, found)
        yield pa.RecordBatch.from_pydict({"key": list(found), "n": list(found.values())},
                                         schema=pa.schema([("key", pa.string()), ("n", pa.int64())]))

    rows = chosen.select("page_id", "html").mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return {r["key"]: r["n"] for r in rows.collect()}  # bounded by tags and buckets, not by pages


def extract(pages: DataFrame, labelled: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html",
            max_pages: int = 3000) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    ``labelled`` are the pages to train on, by default ``pages`` themselves as their own markup labels them.  A null or empty
    html, and a page without content elements, has an empty text.  Repeated rows give repeated rows.  Without any labelled
    page the model falls back to its prior.
    """
    rows = pick(pages, page_id=page_id, url=url, html=html)
    counts = train(rows if labelled is None else pick(labelled, page_id=page_id, html=html), max_pages)
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                parsed = [parse(h or "") for h in batch.column("html").to_pylist()]
                texts = [blocks(p, c) for p, c in zip(parsed, marginals(parsed, model))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
