"""Main text of web pages by a minimum cut between content and boilerplate.

A page is a sequence of text blocks. A logistic classifier gives each block the log-odds of being
content, from its text (length, links, sentences, paragraph) and from the tree around it (tags,
roles, words of class and id); they are its capacities from the source (content) or to the sink
(boilerplate). Blocks that follow each other, and blocks of one container with others between them,
are joined by smoothness edges: different labels cost the log-odds that such blocks share one, at
most ``JOIN_MOST``, by how close they stand in the tree. A maximum flow finds the labels of least
total cost; blocks on the source's side of the cut are the text. Nothing overrules the cut.

Weights and edges are learned without labels, on a bounded sample of pages: the sample is cut with
the prior ones, a logistic regression drawn towards the prior is fitted to the labels of the cut,
the labels of joined blocks are counted, and again, ``ROUNDS`` times. What the sample never shows
keeps its prior weight. Pages are labelled one by one in a narrow stage.

Defined results: a null, empty or unreadable page has the empty text; unfinished markup ends
where the page does; a page without any block of content has the empty text; repeated rows each
give a row; an empty table gives none; further columns are ignored.
"""

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.llm.blocks import Block, blocks
from eventfold.llm.common import bounded_sample, whole

# Documented bounds of the sample: pages, and neighbouring blocks of one page.
SAMPLE_PAGES = 512
SAMPLE_BLOCKS = 300
ROUNDS, STEPS, RATE, DRAWN = 3, 200, 0.5, 0.05
TEXT = ("bias", "length", "linked", "sentence", "commas", "paragraph", "heading")
TREE = ("content_tag", "content_word", "other_tag", "other_word", "comment", "hidden", "form")
# Prior weights of both, as log-odds.
PRIOR = np.array([-1.0, 0.6, -2.0, 0.8, 0.3, 0.8, 0.3] + [3.0, 2.0, -6.0, -5.0, -7.0, -8.0, -5.0])
# Kinds of edges: blocks in a row within a container, near, far; and a container's, not in a row.
INSIDE, NEAR, FAR, ACROSS = range(4)
NEAR_STEPS = 4
JOIN_MOST = 1.2
# Prior counts of joined blocks with one label and with two.
COUNTED = np.array([[25.0, 10.0], [15.0, 10.0], [10.0, 10.0], [20.0, 10.0]])
Links = list[tuple[int, int, int]]


def features(block: Block) -> list[float]:
    """What a block's text tells, then what the tree does: ``TEXT`` and ``TREE``."""
    n = len(block.text)
    return [
        1.0,
        min(math.log1p(n) / 3, 3.0),
        min(1.0, block.linked / n),
        float(block.text[-1] in ".!?:;…\"”"),
        min(2.0, 40 * block.text.count(",") / n),
        float(block.tag in ("p", "pre", "blockquote")),
        float(block.tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
        *(float(getattr(block.tree, name)) for name in TREE),
    ]


def links(page: list[Block]) -> Links:
    """Blocks that should share a label, and the kind of edge between them."""
    found = []
    last: dict[int, int] = {}
    for i, block in enumerate(page):
        together = last.get(block.container)
        if i:
            inside = together == i - 1 or block.element == page[i - 1].element
            kind = INSIDE if inside else NEAR if block.apart <= NEAR_STEPS else FAR
            found.append((i - 1, i, kind))
        if together is not None and together < i - 1:
            found.append((together, i, ACROSS))
        last[block.container] = i
    return found


def joins(counts: np.ndarray) -> np.ndarray:
    """What it costs, for each kind of edge, to give its ends different labels."""
    return np.clip(np.log(counts[:, 0] / counts[:, 1]), 0.0, JOIN_MOST)


Model = tuple[np.ndarray, np.ndarray]
FIRST: Model = (PRIOR, joins(COUNTED))


def labels(x: np.ndarray, linked: Links, model: Model) -> list[bool]:
    """Which blocks are content, by the cut."""
    weights, cost = model
    return minimum_cut(x @ weights, [(a, b, float(cost[kind])) for a, b, kind in linked if cost[kind]])


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights near the prior ones, both classes weighing the same."""
    if not len(y) or y.min() == y.max():
        return PRIOR
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w = PRIOR.copy()
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= RATE * (x.T @ (share * (p - y)) + DRAWN * (w - PRIOR))
    return w


def learned(sample: list[tuple[np.ndarray, Links]]) -> Model:
    """Weights and edges from pages without labels: cut, fit to the cut, and again."""
    model = FIRST
    for _ in range(ROUNDS if sample else 0):
        cut = [labels(x, linked, model) for x, linked in sample]
        counts = COUNTED.copy()
        for kept, (_, linked) in zip(cut, sample):
            for a, b, kind in linked:
                counts[kind, int(kept[a] != kept[b])] += 1
        y = np.concatenate([np.array(kept, dtype=float) for kept in cut])
        model = fitted(np.concatenate([x for x, _ in sample]), y), joins(counts)
    return model


def classifier(pages: DataFrame) -> Model:
    """The model learned from a bounded sample of the pages."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ends = [], []
            for page in batch.column(0).to_pylist():
                found = blocks(page)
                first = zlib.crc32(page.encode()) % max(1, len(found) - SAMPLE_BLOCKS + 1)
                part = found[first : first + SAMPLE_BLOCKS]
                if part:
                    x.append([v for b in part for v in features(b)])
                    ends.append([v for link in links(part) for v in link])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.float64())), pa.array(ends, pa.list_(pa.int64()))],
                ["x", "ends"],
            )

    sample = bounded_sample(pages.where("html IS NOT NULL").select("html"), SAMPLE_PAGES)
    rows = sorted(map(tuple, sample.mapInArrow(seen, "x array<double>, ends array<long>").collect()))
    return learned(
        [
            (
                np.array(x).reshape(-1, len(PRIOR)),
                [tuple(e) for e in np.array(ends, dtype=int).reshape(-1, 3).tolist()],
            )
            for x, ends in rows
        ]
    )


def minimum_cut(gain: np.ndarray, joined: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut.

    A node's gain is its capacity from the source if positive, to the sink if negative; what
    could flow through one node alone is already taken off. Flow is pushed along shortest paths
    from nodes with gain to nodes with loss, found by levels (Dinic's algorithm).
    """
    n = len(gain)
    excess = [float(g) for g in gain]
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, weight in joined:
        for x, y in ((a, b), (b, a)):
            out[x].append(len(to))
            to.append(y)
            room.append(weight)
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if excess[i] > tiny]
        for i in queue:
            level[i] = 0
        reached = False
        for i in queue:
            reached |= excess[i] < -tiny
            for e in out[i]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        tried = [0] * n
        for source in [i for i in range(n) if level[i] == 0 and excess[i] > tiny]:
            path: list[int] = []
            while excess[source] > tiny:
                at = to[path[-1]] if path else source
                if excess[at] < -tiny:
                    flow = min([excess[source], -excess[at], *(room[e] for e in path)])
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    excess[source] -= flow
                    excess[at] += flow
                    path = []
                    continue
                while tried[at] < len(out[at]):
                    e = out[at][tried[at]]
                    if room[e] > tiny and level[to[e]] == level[at] + 1:
                        break
                    tried[at] += 1
                if tried[at] < len(out[at]):
                    path.append(out[at][tried[at]])
                elif path:
                    back = path.pop()
                    tried[to[back ^ 1]] += 1
                else:
                    break


def main_text(page: str, model: Model = FIRST) -> str:
    """The blocks of content, a line each."""
    found = blocks(page)
    if not found:
        return ""
    kept = labels(np.array([features(b) for b in found]), links(found), model)
    return "\n".join(b.text for b, keep in zip(found, kept) if keep)


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages`` (page_id, url, html)."""
    model = classifier(pages)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, model) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select("page_id", "url", whole("html").alias("html"))
    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
