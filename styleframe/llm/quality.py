"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 6).

Statistics of a whole text (byte classes, word and line shape, repetition, and
the worst line) are computed for whole Arrow batches with numpy.  Trees are grown
by depth on binned statistics with logistic loss; gradients are summed per bin,
and a node takes the split of the largest gain.  All trees are complete and lie
in three arrays (feature, threshold, leaf), so a batch goes down one level of a
tree at a time by indexing.

Scale: learning sees at most ``SAMPLE`` labelled rows (a documented bound,
chosen by hash of the id), which are the only statistics to reach the driver.
Scoring is one pass without a shuffle.

Edge rows: a null or empty text has all-zero statistics and is scored like any
other; repeated rows each return a row; without labels every score is 0.5, with
one class only the trees have no split and all scores are alike; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleframe.llm.textbytes import column_bytes, map_texts, row_ranges, words

SAMPLE = 8000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 80, 4, 32, 0.2, 1.0, 10
ACCEPT = 0.7
#: byte classes: other, letter a-z or non-ASCII, A-Z, digit, blank, newline, full stop or comma, | or tab, ! or ?, other symbol
CLASSES = 10
CLASS = np.full(256, 9, np.uint8)
CLASS[0:32] = 0
CLASS[97:123] = CLASS[128:] = 1
CLASS[65:91], CLASS[48:58], CLASS[32], CLASS[10] = 2, 3, 4, 5
for _c, _k in ((".,", 6), ("|\t", 7), ("!?", 8)):
    for _x in _c:
        CLASS[ord(_x)] = _k
#: lines shorter than this do not count as a worst line
LINE = 20


# -- statistics --------------------------------------------------------------------

def _per(total: np.ndarray, by: np.ndarray) -> np.ndarray:
    return total / np.maximum(by, 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, features) of a batch of texts."""
    n = len(offsets) - 1
    length = np.diff(offsets).astype(np.float64)
    kind = CLASS[data]
    # lines: cut at row ends and after newlines
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(kind == 5) + 1]))
    line_row = np.searchsorted(offsets, cuts[:-1], side="right") - 1
    line_len = np.diff(cuts).astype(np.float64)
    long_line = line_len >= LINE

    def worst(value: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        np.maximum.at(out, line_row[long_line], value[long_line])
        return out

    cols = [np.log1p(length)]
    for k in range(1, CLASSES):
        run = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind == k, out=run[1:])
        cols.append(_per(run[offsets[1:]] - run[offsets[:-1]], length))
        if k in (2, 3, 7, 8, 9):
            cols.append(worst(_per(run[cuts[1:]] - run[cuts[:-1]], line_len)))
    h, row, start, end = words(data, offsets)
    count = np.bincount(row, minlength=n).astype(np.float64)
    size = (end - start).astype(np.float64)
    cols += [np.log1p(count), _per(np.bincount(row, size, n), count), _per(np.bincount(row, size ** 2, n), count)]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    cols.append(_per(np.bincount(row, same, n), count))
    line = np.searchsorted(cuts, start, side="right") - 1
    line_words = np.bincount(line, minlength=len(line_len)).astype(np.float64)
    cols.append(worst(_per(np.bincount(line, same, len(line_len)), line_words)))
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(h))).astype(np.float64)
    top = np.zeros(n)
    np.maximum.at(top, rs[at], times)
    cols += [_per(np.bincount(rs[at], minlength=n), count), _per(top, count)]
    lines = np.bincount(line_row, minlength=n).astype(np.float64)
    cols += [np.log1p(lines), _per(length, lines)]
    return np.nan_to_num(np.stack(cols, axis=1))


# -- trees ---------------------------------------------------------------------------

class Trees:
    """Complete trees in arrays: feature and threshold of inner nodes, values of leaves."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner] if len(node) else 0
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each feature, the distinct inner quantiles."""
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees for labels 0 and 1."""
    inner, leaves = 2 ** depth - 1, 2 ** depth
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if not len(y):
        return Trees(base, feature, threshold, leaf)
    edges = bin_edges(x)
    width = max(len(e) for e in edges) + 1
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])  # x > e[b] iff bin > b
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n_nodes = 2 ** level - 1, 2 ** level
            local = node - first
            best = np.full(n_nodes, 1e-9)
            for j, b in enumerate(binned):
                key = local * width + b
                G, H, C = (np.bincount(key, w, n_nodes * width).reshape(n_nodes, width) for w in (g, h, None))
                gl, hl, cl = G.cumsum(1)[:, :-1], H.cumsum(1)[:, :-1], C.cumsum(1)[:, :-1]
                ga, ha, ca = G.sum(1)[:, None], H.sum(1)[:, None], C.sum(1)[:, None]
                gain = gl ** 2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga ** 2 / (ha + RIDGE)
                gain[(cl < LEAST_ROWS) | (ca - cl < LEAST_ROWS)] = 0
                gain = gain[:, :len(edges[j])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(1)
                better = np.flatnonzero(gain[np.arange(n_nodes), at] > best)
                best[better] = gain[better, at[better]]
                feature[t, first + better], threshold[t, first + better] = j, edges[j][at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        G, H = np.bincount(node - inner, g, leaves), np.bincount(node - inner, h, leaves)
        leaf[t] = RATE * G / (H + RIDGE)
        raw += leaf[t, node - inner]
    return Trees(base, feature, threshold, leaf)


# -- on Spark ------------------------------------------------------------------------

def _statistics_texts(col: pa.Array, model: tuple | None = None) -> list[pa.Array]:
    data, offsets = column_bytes(col)
    found = []
    for lo, hi in row_ranges(offsets, 1 << 22):
        a = offsets[lo]
        x = statistics(data[a:offsets[hi]], offsets[lo:hi + 1] - a)
        found.append(x if model is None else Trees(*model).score(x)[:, None])
    x = np.concatenate(found) if found else np.zeros((0, 1))
    if model is not None:
        return [pa.array(x[:, 0])]
    flat = pa.array(x.reshape(-1))
    return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` labelled rows (labels of an id that differ count as the larger)."""
    marked = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("i"))
              .agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("i"), "i").limit(sample))
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("text")).join(F.broadcast(marked), "i")  # <= sample rows
    stats = map_texts(rows, "text", _statistics_texts, "x array<double>").select(F.xxhash64("row.i").alias("k"), "row.y", "x")
    got = stats.orderBy("k", "x").limit(sample).collect()
    x = np.array([r["x"] for r in got]) if got else np.zeros((0, 1))
    return grow(x, np.array([float(r["y"]) for r in got]))


def score(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """(row struct of the columns of ``docs``, score)."""
    parts = (model.base, model.feature, model.threshold, model.leaf)
    return map_texts(docs, text, functools.partial(_statistics_texts, model=parts), "score double")
