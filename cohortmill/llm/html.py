"""Operator 5: main text of web pages by minimum-cut labelling.

Blocks of text are the nodes. What a classifier, fitted on labelled pages, says against calling a block content or
boilerplate becomes the capacity of its arcs to the two terminals; neighbours in page order and blocks that stand close in the document tree
get smoothness arcs. The minimum cut separates content from boilerplate.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm import page_sample
from cohortmill.llm.common import small_batches, text_blocks

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>")
_ATTR = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[a-z0-9]+(?:[_-]+[a-z0-9]+)*")
#: Elements that begin and end blocks.
_BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html ins li main nav ol p pre section summary table tbody td tfoot th thead tr ul dialog center".split())
#: Elements whose text is never shown as such. Where one is left open, it ends with the element it stands in.
_DROPPED = frozenset("head script style noscript template svg title textarea iframe select button object canvas audio video math".split())
_RAW = frozenset("script style title textarea iframe".split())
_CLOSES = frozenset("li dt dd tr td th h1 h2 h3 h4 h5 h6".split())
_TELLING = frozenset("article main nav footer aside header form dialog".split())


#: What a heading or paragraph inside ends where it is left open.
_ENDED = frozenset("button select".split())
#: Elements around a block that are looked at, from the inside out. Names further out count for less than a thousandth.
_AROUND = 40


class _Element(NamedTuple):
    tag: str
    number: int
    names: tuple[str, ...]
    mark: int | None
    parent: _Element | None
    telling: tuple[str, ...]  # the telling tags from here out, the innermost first


class Block(NamedTuple):
    text: str
    element: _Element | None  # the innermost open one
    depth: int  # how many are open
    shared: int  # how many of those the block before stands in too
    linked: float  # share of the characters that are in links
    label: int | None  # of the nearest marked element, on pages to learn from


def _around(b: Block) -> Iterator[_Element]:
    e = b.element
    for _ in range(_AROUND):
        if e is None:
            return
        yield e
        e = e.parent


def _names(attributes: str) -> tuple[tuple[str, ...], int | None]:
    """The words of class, id, role and aria-label, and the mark data-l."""
    out, mark = [], None
    for name, a, b, c in _ATTR.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label"):
            out += _NAME.findall((a or b or c).lower())
        elif name == "data-l":
            mark = int(a or b or c)
    return tuple(dict.fromkeys(out)), mark


class _Ahead:
    """Where texts stand next in a page, whatever their case; each is looked for once from one of its places to the next."""

    def __init__(self, page: str):
        self.page, self.at = page.lower(), {}

    def find(self, text: str, start: int) -> int:
        """The next place from `start` on; beyond the page if there is none."""
        known = self.at.get(text, -1)
        if known < start:
            known = self.page.find(text, start)
            self.at[text] = known = known if known >= 0 else len(self.page) + 1
        return known


def _pieces(page: str) -> Iterator[tuple[str, str, str, int]]:
    """('text', text, '', end), ('open', tag, attributes, end) and ('close', tag, '', end) in order, with the place where each ends. Comments and the text of raw elements are left out."""
    at, n, missing = 0, len(page), set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], "", n
            return
        if lt > at:
            yield "text", page[at:lt], "", lt
        if page.startswith("<!--", lt) and "-->" not in missing:
            end = page.find("-->", lt + 4)
            if end >= 0:
                at = end + 3
                continue
            missing.add("-->")
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m:
            tag, at = m[2].lower(), m.end()
            if m[1]:
                yield "close", tag, "", at
                continue
            yield "open", tag, m[3], at
            if tag in _RAW and tag not in missing and not m[3].endswith("/"):
                end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                    yield "close", tag, "", at
                else:
                    missing.add(tag)
            continue
        gt = page.find(">", lt) if page[lt + 1 : lt + 2] in ("!", "?", "/") else -1
        if gt >= 0:
            at = gt + 1
        else:
            yield "text", "<", "", lt + 1
            at = lt + 1


def blocks_of(page: str) -> list[Block]:
    """The blocks of text of a page, in order. Elements that are left open end with their parents."""
    out: list[Block] = []
    stack: list[_Element] = []
    held: list[str] = []
    ahead = _Ahead(page)
    count = linked = links = dropped = low = 0

    def flush() -> None:
        nonlocal held, linked, low
        if held:
            raw = "".join(held)
            text = " ".join(html_lib.unescape(raw).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, len(stack), min(low, len(stack)), linked / max(1, len(raw)), stack[-1].mark if stack else None))
                low = len(stack)
            held, linked = [], 0

    def cut(i: int) -> None:
        nonlocal dropped, low
        dropped -= sum(e.tag in _DROPPED for e in stack[i:])
        del stack[i:]
        low = min(low, i)

    open_of: Counter[str] = Counter()
    for kind, tag, attributes, end in _pieces(page):
        if kind == "text":
            if not dropped:
                held.append(tag)
                linked += len(tag) * bool(links)
            continue
        if tag == "a":
            links = int(kind == "open")
        elif tag == "br" and not dropped:
            held.append(" ")
        if tag not in _BLOCK and tag not in _DROPPED:
            continue
        if tag in _BLOCK:
            flush()
            links = 0
        if kind == "close":
            i = len(stack) - 1 if open_of[tag] else -1
            while i >= 0 and stack[i].tag != tag:
                i -= 1
            if i >= 0:
                open_of.subtract(e.tag for e in stack[i:])
                cut(i)
            continue
        if tag == "hr" or attributes.endswith("/") and tag in _DROPPED:
            continue
        ends = len(stack)
        if tag in _BLOCK:
            if tag == "body" and open_of["head"]:
                ends = next(i for i, e in enumerate(stack) if e.tag == "head")
            while ends and (stack[ends - 1].tag == "p" or stack[ends - 1].tag == tag and tag in _CLOSES):
                ends -= 1
            if ends and stack[ends - 1].tag == "head":
                ends -= 1
            if dropped and ends and (name := stack[ends - 1].tag) in _ENDED and ahead.find(f"</{name}", end) > min(len(page), ahead.find(f"<{name}", end)):
                ends -= 1  # its end tag is missing
        if ends < len(stack):
            open_of.subtract(e.tag for e in stack[ends:])
            cut(ends)
        names, mark = _names(attributes) if attributes else ((), None)
        count += 1
        parent = stack[-1] if stack else None
        telling = parent.telling if parent else ()
        if tag in _TELLING:
            telling = (tag, *(t for t in telling if t != tag))
        stack.append(_Element(tag, count, names, mark if mark is not None or parent is None else parent.mark, parent, telling))
        open_of[tag] += 1
        dropped += tag in _DROPPED
    flush()
    return out


def features(b: Block, at: float) -> dict[str, float]:
    """What the classifier looks at: length, links, marks, the place `at` in the page (0 to 1), the tags around, and names of elements around, fading with distance."""
    n = len(b.text)
    x = {"one": 1.0, "length": min(n, 400) / 200, "short": float(n < 25), "linked": b.linked, "all linked": float(b.linked > 0.8), "sentence": float(b.text[-1] in ".!?:" and n > 20), "copyright": float("©" in b.text), "place": at}
    telling = b.element.telling if b.element else ()
    x |= {f"in {t}": 1.0 for t in telling} | {f"nearest {t}": 1.0 for t in telling[:1]}
    fade = 1.0
    for e in _around(b):
        tag, names = e.tag, e.names
        if tag not in _TELLING and tag not in ("div", "section", "body", "html"):
            x.setdefault(f"tag {tag}", fade)
        for name in names:
            x[f"name {name}"] = max(x.get(f"name {name}", 0.0), fade)
            parts = re.split("[_-]+", name)
            if len(parts) > 1:
                for i, p in enumerate(parts):
                    key = f"{'last' if i == len(parts) - 1 else 'part'} {p}"
                    x[key] = max(x.get(key, 0.0), fade)
        fade *= 0.85
    return x


_FITTED: dict[tuple[int, int], dict[str, float]] = {}


def fit_costs(pages: int = 700, seed: int = 1, rounds: int = 12, ridge: float = 0.3) -> dict[str, float]:
    """Weights of the block classifier: regularised logistic regression on `pages` labelled pages of `page_sample`."""
    if (pages, seed) not in _FITTED:
        rows, labels = [], []
        for page in page_sample.pages(pages, seed):
            blocks = blocks_of(page)
            for i, b in enumerate(blocks):
                rows.append(features(b, i / len(blocks)))
                labels.append(b.label or 0)
        seen = Counter(k for x in rows for k in x)
        index = {k: i for i, k in enumerate(sorted(k for k, c in seen.items() if c >= 8))}
        x, y = np.zeros((len(rows), len(index)), np.float32), np.array(labels, np.float32)
        for i, r in enumerate(rows):
            for k, v in r.items():
                if k in index:
                    x[i, index[k]] = v
        w = np.zeros(len(index), np.float32)
        for _ in range(rounds):  # Newton's steps
            p = 1 / (1 + np.exp(-(x @ w)))
            curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(index), dtype=np.float32)
            step = np.linalg.solve(curve, x.T @ (y - p) - ridge * w)
            w = w + step
            if np.abs(step).max() < 0.05:
                break
        _FITTED[pages, seed] = {k: float(w[i]) for k, i in index.items()}
    return _FITTED[pages, seed]


def costs(blocks: list[Block], weights: dict[str, float]) -> list[tuple[float, float]]:
    """What speaks against calling each block boilerplate and against calling it content: the two sides of the classifier's log odds, 8 at most."""
    out = []
    for i, b in enumerate(blocks):
        score = sum(weights.get(k, 0.0) * v for k, v in features(b, i / len(blocks)).items())
        out.append((min(score, 8.0), 0.0) if score > 0 else (0.0, min(-score, 8.0)))
    return out


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node stays with the source in the minimum cut; level graphs and blocking flows (Dinic)."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def add(u: int, v: int, a: float, b: float) -> None:
        arcs[u].append(len(to))
        to.append(v)
        cap.append(a)
        arcs[v].append(len(to))
        to.append(u)
        cap.append(b)

    for i in range(n):
        if source[i] > 0:
            add(s, i, source[i], 0.0)
        if sink[i] > 0:
            add(i, t, sink[i], 0.0)
    for u, v, w in edges:
        add(u, v, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in arcs[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[u] < len(arcs[u]):
                e = arcs[u][at[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(arcs[u]):
                path.append(e)
                u = to[e]
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break


def label(blocks: list[Block], weights: dict[str, float], adjacency: float = 0.2, proximity: float = 0.8) -> list[bool]:
    """True for content. Neighbours in page order are tied by `adjacency`, and by up to `proximity` more the deeper their common ancestor is; the last block that had the same parent is a neighbour too."""
    pairs = costs(blocks, weights)
    edges = []
    seen: dict[int, int] = {}
    for i, b in enumerate(blocks):
        parent = b.element.parent.number if b.element and b.element.parent else 0
        for j in {i - 1, seen.get(parent, i - 1)}:
            if j >= 0:
                # a block with the same parent shares all elements but the innermost
                common = b.shared if j == i - 1 else b.depth - 1
                edges.append((j, i, adjacency * (j == i - 1) + proximity * (common / max(b.depth, blocks[j].depth, 1)) ** 2))
        seen[parent] = i
    return min_cut([a for a, _ in pairs], [b for _, b in pairs], edges)


def main_text(page: str | None, weights: dict[str, float] | None = None) -> str:
    """The content blocks of a page, joined by line ends; empty for null, empty or pure boilerplate."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks, weights or fit_costs())) if keep)


def extract_pages(pages: DataFrame, sample_pages: int = 700, seed: int = 1, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of each whole page.

    The classifier is fitted on `sample_pages` labelled pages of `page_sample`. A null or empty page, or one without content, has an empty
    text. Repeated rows give repeated rows, null ids and urls
    stay, other columns are ignored, an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    weights = fit_costs(sample_pages, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, urls = 0, b.column(2)
            for ids, block in text_blocks(iter([b.select([0, 1])]), 2_000_000):
                texts = [main_text(x, weights) for x in block]
                yield pa.RecordBatch.from_arrays([ids, urls.slice(start, len(block)), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                start += len(block)

    t = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.col(url_col).alias("url"))
    return t.mapInArrow(run, f"page_id {t.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
