"""Main text of web pages by minimum cuts.

A page becomes a sequence of text blocks with their place in the element tree. A classifier gives each
block a cost of being content and a cost of being boilerplate; these are the capacities to the
two terminals. Neighbouring blocks, and blocks that follow each other under one
parent, are joined by edges whose capacity grows with the part of the tree they share. The
maximum flow's minimum cut is the cheapest labelling; blocks on the content side are the text.

The classifier weighs what marks say (elements and class names, fixed values) and the shape of the block; the
shape's weights are fitted by logistic regression on a bounded sample of pages, with blocks
whose marks are plain as examples.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Pages whose blocks the shape classifier is fitted on at most, about.
SAMPLE_PAGES = 2_000
SMOOTH = 1.0
SAYS_CONTENT, SAYS_BOILERPLATE = 4.0, -9.0

#: Elements and names.
_RAW = "script|style|noscript|template|iframe|svg|math|object|select|textarea|title"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I,
)
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
_BOILERPLATE = frozenset("nav footer aside form menu button dialog head fieldset".split())
_CONTENT = frozenset("article main".split())
_NAMED_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|foot|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|"
    r"outbrain|pagination|pager|popup|promo\w*|recommended|related|replies|reply|respond|rss|search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|"
    r"taboola|toolbar|widgets?)(?:$|[\s_-])", re.I,
)
_NAMED_CONTENT = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)
_ROLES = re.compile(r"navigation|banner|complementary|contentinfo|search|form|dialog|alert", re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block:
    """A run of text between block boundaries. `path`: numbers of the elements around it; `says`: 1 content, -1 boilerplate, 0 nothing."""

    __slots__ = ("text", "path", "says", "linked", "heading")

    def __init__(self, text: str, path: tuple[int, ...], says: int, linked: int, heading: bool):
        self.text, self.path, self.says, self.linked, self.heading = text, path, says, linked, heading

    def shape(self) -> list[float]:
        words, n = self.text.split(" "), max(1, len(self.text))
        stops = sum(self.text.count(c) for c in ".,;:!?")
        return [
            1.0, np.log1p(len(words)), self.linked / n, min(1.0, 5 * stops / n * 2), float(len(words) < 5), float(self.heading),
            sum(map(str.isupper, self.text)) / n, float(self.text[-1:] in ".!?"), sum(map(str.isdigit, self.text)) / n, float(any(c in self.text for c in "©|»·")),
        ]


def _says(name: str, attributes: str, above: int) -> int:
    """What an element's marks say of its text; boilerplate holds for all below it."""
    if above < 0:
        return -1
    said = 1 if name in _CONTENT else -1 if name in _BOILERPLATE or name == "header" and above <= 0 else 0
    if attributes.strip():
        found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")) or _ROLES.match(found.get("role", "")):
            return -1
        if name not in ("html", "body", "article", "main") and _NAMED_BOILERPLATE.search(names):
            return -1
        if not said and (found.get("role") in ("main", "article") or _NAMED_CONTENT.search(names)):
            said = 1
    return said or above


def blocks_of(page: str | None) -> list[Block]:
    """Text blocks of a page in order; broken markup is read as far as it makes sense."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, int, int]] = []
    buffer: list[str] = []
    linked = links = number = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            out.append(Block(text, tuple(x[1] for x in stack), stack[-1][2] if stack else 0, linked, bool(stack) and stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit()))
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            part = entities.unescape(page[at:m.start()])
            buffer.append(part)
            linked += len(part) if links else 0
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "a":
            links = 0 if m["close"] else 1
        elif name == "br":
            buffer.append(" ")
        elif name in _BLOCKS:
            flush()
            if m["close"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif name not in _VOID:
                if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option") or name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    # an open paragraph ends here; so does an open element of the same kind
                    if stack and (stack[-1][0] == "p" or stack[-1][0] == name):
                        stack.pop()
                elif stack and stack[-1][0] == "p":
                    stack.pop()
                number += 1
                stack.append((name, number, _says(name, m["attributes"] or "", stack[-1][2] if stack else 0)))
    buffer.append(entities.unescape(page[at:]) if "<" not in page[at:] else entities.unescape(page[at:page.index("<", at)]))
    flush()
    return out


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) that minimise the sum of |gain| lost and of the capacities of cut edges.

    gain > 0 is lost by labelling a node boilerplate, gain < 0 by labelling it content. Nodes whose terminal outweighs
    all their edges are settled first, which changes no minimum cut; augmenting paths solve what is left. Of
    equal cuts the one with less content is taken.
    """
    n = len(gain)
    gain, near = list(gain), [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        a = waiting.popleft()
        if label[a] is None and abs(gain[a]) > sum(near[a].values()):
            label[a] = gain[a] > 0
            for b, c in near[a].items():
                gain[b] += c if label[a] else -c
                del near[b][a]
                waiting.append(b)
    for a in range(n):
        if label[a] is None:
            _flow(a, gain, near, label)
    return [bool(x) for x in label]


def _flow(first: int, gain: list[float], near: list[dict[int, float]], label: list[bool | None]) -> None:
    """Label the unsettled component around a node by maximum flow."""
    part, waiting = {first}, [first]
    while waiting:
        for b in near[waiting.pop()]:
            if label[b] is None and b not in part:
                part.add(b)
                waiting.append(b)
    source = {a: gain[a] for a in part if gain[a] > 0}
    sink = {a: -gain[a] for a in part if gain[a] < 0}
    left = {a: {b: c for b, c in near[a].items() if b in part} for a in part}
    while True:
        # shortest augmenting path from any node with supply to any with demand
        came = {a: None for a in sorted(source) if source[a] > 1e-12}
        queue, end = deque(came), None
        while queue and end is None:
            a = queue.popleft()
            if sink.get(a, 0.0) > 1e-12:
                end = a
                break
            for b, c in left[a].items():
                if c > 1e-12 and b not in came:
                    came[b] = a
                    queue.append(b)
        if end is None:
            break
        path, a = [end], end
        while came[a] is not None:
            a = came[a]
            path.append(a)
        flow = min([source[a], sink[end], *(left[y][x] for x, y in zip(path, path[1:]))])
        source[a] -= flow
        sink[end] -= flow
        for x, y in zip(path, path[1:]):
            left[y][x] -= flow
            left[x][y] = left[x].get(y, 0.0) + flow
    for a in part:
        label[a] = a in came


class BlockClassifier:
    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def gain(self, block: Block) -> float:
        """Log-odds of content."""
        z = float(np.clip(np.dot(self.weights, block.shape()), -3, 3))
        return z + (SAYS_CONTENT if block.says > 0 else SAYS_BOILERPLATE if block.says < 0 else 0.0)

    def text(self, page: str | None) -> str:
        blocks = blocks_of(page)
        edges, last_of = [], {}
        for k, b in enumerate(blocks):
            parent = b.path[-2:-1]
            for j in {k - 1, last_of.get(parent, k - 1)}:
                if j >= 0:
                    edges.append((j, k, SMOOTH * _shared(blocks[j].path, b.path)))
            last_of[parent] = k
        keep = minimum_cut([self.gain(b) for b in blocks], edges)
        return "\n".join(b.text for b, x in zip(blocks, keep) if x)


def _shared(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    """Part of the longer path to the parent that the two have in common."""
    a, b = a[:-1], b[:-1]
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return (n + 1) / (max(len(a), len(b)) + 1)


#: Weights of the shape before any example is seen, in the order of Block.shape.
PRIOR = np.array([-1.5, 0.9, -4.0, 1.0, -0.5, 0.5, -1.0, 1.0, -1.0, -1.5])


def train_blocks(pages: DataFrame, column: str = "html", sample_pages: int = SAMPLE_PAGES, seed: int = 31) -> BlockClassifier:
    """Fit the shape's weights on blocks with plain marks; without such blocks the prior weights hold."""
    rows = pages.select(F.col(column).alias("html")).where("html is not null")
    n = rows.count()
    bar = int(min(1.0, sample_pages / max(n, 1)) * (1 << 30))
    sample = rows.where(F.pmod(F.xxhash64("html", F.lit(seed)), F.lit(1 << 30)) < bar)

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[tuple, int] = {}
        for b in batches:
            for page in b["html"]:
                for block in blocks_of(page):
                    if block.says:
                        key = (block.says > 0, *np.round(block.shape(), 1))
                        kept[key] = kept.get(key, 0) + 1
        yield pd.DataFrame({"y": [k[0] for k in kept], "x": pd.Series([[float(v) for v in k[1:]] for k in kept], dtype=object), "n": list(kept.values())})

    rows = sample.mapInPandas(examples, "y boolean, x array<double>, n long").groupBy("y", "x").agg(F.sum("n").alias("n")).collect()
    if len({r.y for r in rows}) < 2:
        return BlockClassifier(PRIOR)
    rows.sort(key=lambda r: (r.y, r.x))
    x, y, m = np.array([r.x for r in rows]), np.array([r.y for r in rows], float), np.array([r.n for r in rows], float)
    # both labels weigh alike
    m *= np.where(y > 0, 0.5 / m[y > 0].sum(), 0.5 / m[y == 0].sum())
    w = PRIOR.copy()
    for _ in range(50):  # Newton steps, held near the prior
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (m * (p - y)) + 0.01 * (w - PRIOR)
        h = (x * (m * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2 / max(np.abs(step).max(), 1e-9))
    return BlockClassifier(w)


def main_text(html: Column, model: BlockClassifier, spark) -> Column:
    """The main text; empty for null and empty pages and where nothing is content."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([shared.value.text(p) for p in pages], dtype=object)

    return extract(html)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    Repeated rows come as often as they stand; ids and addresses may be null; n_chars counts code points.
    """
    text = main_text(F.col("html"), train_blocks(pages), pages.sparkSession)
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
