"""Benchmark decontamination by SimHash windows (operator 4).

Each benchmark item has a 64-bit SimHash of its five-word shingles.  A document
is read through windows of as many words as an item has; a window's fingerprint
comes from running sums of shingle bits.  Windows within ``RADIUS`` bits of an
item are found by multi-index blocks: the 64 bits are cut into ``BLOCKS``
blocks, and a pair within the radius must agree to RADIUS // BLOCKS bits in some
block, so looking up all block values that near finds every such pair.  Found
pairs are then verified exactly: multiset (weighted) Jaccard similarity of the
shingles of 0.8 or more.

A window without a single shingle of some item of its size has similarity 0, so
only windows that hold one are fingerprinted (this skips nothing that could be
verified).  The radius is wide: at similarity 0.8 the expected distance is 10
bits with a deviation of 3.

Scale: one pass over the documents without a shuffle.  The benchmark is cut by
hash into chunks of about ``CHUNK_BYTES``, each broadcast for a pass of its own,
so what a task holds is bounded for a benchmark of any size.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased.
An item of fewer than five words is one shingle of that many words, and documents
are read in shingles of that size for it, so it is found where it stands intact.
Edge rows: a null or wordless text has no hits, a null or wordless item none
either; a document shorter than an item is one window; repeated items are reported each by its id; an empty
benchmark leaves all documents clean.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleframe.llm.textbytes import column_bytes, map_texts, row_ranges, shingles, words

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS, BLOCKS = 20, 8
CHUNK_BYTES = 4 << 20
HIT_FIELDS = ("item_id", "first_word", "last_word", "similarity", "distance")
HIT_TYPE = pa.list_(pa.struct(list(zip(HIT_FIELDS, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())))))
HIT_SCHEMA = "hits array<struct<item_id:bigint,first_word:int,last_word:int,similarity:double,distance:int>>"


def _bits(h: np.ndarray) -> np.ndarray:
    """(n, 64) of -1 and 1."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16) * 2 - 1


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).reshape(-1)


def _words_of(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return words(data, np.array([0, len(data)]))[0]


def _shingles_of(h: np.ndarray, k: int) -> np.ndarray:
    """Shingle hashes of one text of at least ``k`` words."""
    return shingles(h, np.zeros(len(h), np.int64), k)[0]


def _near_values(bits: int, radius: int) -> np.ndarray:
    """(values, values): whether two block values differ in at most ``radius`` bits."""
    v = np.arange(1 << bits, dtype=np.uint64)
    return np.bitwise_count(v[:, None] ^ v[None, :]) <= radius


class Index:
    """Items of at least ``k`` words: shingle table, and for each size the multi-index blocks."""

    def __init__(self, items: list[tuple[int, bytes]], k: int = SHINGLE_WORDS, radius: int = RADIUS, blocks: int = BLOCKS):
        self.k, self.radius, self.blocks = k, radius, blocks
        near = _near_values(64 // blocks, radius // blocks)
        by_size: dict[int, list] = {}
        for item_id, text in items:
            h = _words_of(text)
            by_size.setdefault(len(h), []).append((item_id, _shingles_of(h, k)))
        self.sizes = []
        pairs = []
        for size, rows in sorted(by_size.items()):
            fp = np.concatenate([_fingerprint(_bits(s).sum(axis=0, keepdims=True)) for _, s in rows])
            part = fp.view(np.uint8).reshape(-1, 8)  # BLOCKS == 8 blocks of 8 bits
            table = np.stack([near[:, part[:, b]] for b in range(blocks)])  # block, value, item
            self.sizes.append((size, rows, fp, table))
            pairs += [(x, len(self.sizes) - 1) for x in np.unique(np.concatenate([s for _, s in rows]))]
        pairs.sort()
        self.known = np.array([x for x, _ in pairs], np.uint64)
        self.size_of = np.array([s for _, s in pairs], np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.known >> np.uint64(44)] = True

    def anchors(self, sh: np.ndarray) -> np.ndarray:
        """Positions in ``sh`` that hold a shingle of some item."""
        at = np.flatnonzero(self.filter[sh >> np.uint64(44)])
        if not len(at) or not len(self.known):
            return at[:0]
        i = np.minimum(np.searchsorted(self.known, sh[at]), len(self.known) - 1)
        return at[self.known[i] == sh[at]]

    def hits(self, sh: np.ndarray, n_words: int, similarity: float) -> list[tuple]:
        """Verified, non-overlapping windows of one document, best first for each item."""
        at = self.anchors(sh)
        if not len(at):
            return []
        lo = np.searchsorted(self.known, sh[at], side="left")
        hi = np.searchsorted(self.known, sh[at], side="right")
        where: dict[int, list[int]] = {}
        for p, a, b in zip(at, lo, hi):
            for s in self.size_of[a:b]:
                where.setdefault(int(s), []).append(int(p))
        out = []
        for s, places in where.items():
            size, rows, fps, table = self.sizes[s]
            span = min(max(1, size - self.k + 1), len(sh))  # shingles of a window
            starts = np.unique((np.array(places)[:, None] - np.arange(span)).reshape(-1))
            starts = starts[(starts >= 0) & (starts + span <= len(sh))]
            found = []
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
                for c in range(0, len(run), 4096):
                    found += self._run(sh, run[c:c + 4096], span, rows, fps, table, similarity)
            found.sort(key=lambda f: (-f[0], f[1], f[3]))
            taken: dict[int, list[int]] = {}
            for sim, item, dist, start in found:
                if all(abs(start - x) >= span for x in taken.get(item, [])):
                    taken.setdefault(item, []).append(start)
                    last = min(n_words, start + span - 1 + self.k) - 1
                    out.append((rows[item][0], start, last, sim, dist))
        return out

    def _run(self, sh, starts, span, rows, fps, table, similarity):
        base = int(starts[0])
        sums = np.zeros((int(starts[-1]) + span - base + 1, 64), np.int32)
        np.cumsum(_bits(np.ascontiguousarray(sh[base:base + len(sums) - 1])), axis=0, out=sums[1:])
        fp = _fingerprint(sums[starts - base + span] - sums[starts - base])
        part = fp.view(np.uint8).reshape(-1, 8)
        candidate = np.zeros((len(fp), len(fps)), bool)
        for b in range(self.blocks):
            candidate |= table[b][part[:, b]]
        w, i = np.nonzero(candidate)
        dist = np.bitwise_count(fp[w] ^ fps[i])
        ok = dist <= self.radius
        out = []
        for w_, i_, d in zip(w[ok], i[ok], dist[ok]):
            a, x = sh[starts[w_]:starts[w_] + span], rows[i_][1]
            sim = weighted_jaccard(a, x)
            if sim >= similarity:
                out.append((sim, int(i_), int(d), int(starts[w_])))
        return out


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of smaller over sum of larger counts, over all shingles of either."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    same = int(np.minimum(ca[i], cb[j]).sum())
    return same / max(1, len(a) + len(b) - same)


def indexes(items: list[tuple[int, bytes]]) -> list[Index]:
    """An index for each shingle length that the items need: ``SHINGLE_WORDS``, or all words of a shorter item."""
    by_length: dict[int, list] = {}
    for item in items:
        k = min(SHINGLE_WORDS, len(_words_of(item[1])))
        if k:
            by_length.setdefault(k, []).append(item)
    return [Index(rows, k) for k, rows in sorted(by_length.items())]


def _scan_texts(col: pa.Array, items, similarity: float, held: dict) -> list[pa.Array]:
    if "indexes" not in held:
        held["indexes"] = indexes(items.value)
    data, offsets = column_bytes(col)
    hits: list[list] = []
    for lo, hi in row_ranges(offsets, 1 << 22):
        a = offsets[lo]
        h, row, _, _ = words(data[a:offsets[hi]], offsets[lo:hi + 1] - a)
        edges = np.searchsorted(row, np.arange(hi - lo + 1))
        n = np.diff(edges)
        found: list[list] = [[] for _ in range(hi - lo)]
        for index in held["indexes"]:
            sh, at = shingles(h, row, index.k)
            first = np.searchsorted(at, edges)
            for r in np.unique(row[at[index.anchors(sh)]]):
                found[r] += index.hits(sh[first[r]:first[r + 1]], int(n[r]), similarity)
        hits += [sorted(f, key=lambda o: (o[1], -o[3], o[2], o[0] is None, o[0])) for f in found]
    return [pa.array([[dict(zip(HIT_FIELDS, x)) for x in row] for row in hits], HIT_TYPE)]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         similarity: float = SIMILARITY) -> DataFrame:
    """(row struct of the columns of ``docs``, hits): the windows of benchmark items in each text."""
    bench = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    total = bench.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    chunks = max(1, math.ceil(total / CHUNK_BYTES))
    for c in range(chunks):
        rows = bench.where(F.pmod(F.xxhash64("t"), F.lit(chunks)) == c).collect()  # about CHUNK_BYTES
        rows.sort(key=lambda r: (r["i"] is None, r["i"], r["t"]))
        items = docs.sparkSession.sparkContext.broadcast([(r["i"], r["t"].encode()) for r in rows])
        step = functools.partial(_scan_texts, items=items, similarity=similarity, held={})
        if c == 0:
            out = map_texts(docs, text, step, HIT_SCHEMA)
            continue
        wide = out.select(F.col("row").getField(text).alias("text"), "row", "hits")
        out = map_texts(wide, "text", step, HIT_SCHEMA).select("row.row", F.concat("row.hits", "hits").alias("hits"))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per matched window: doc_id, item_id, first_word, last_word, similarity, distance."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return scan(slim, benchmark).where(F.size("hits") > 0).select("row.doc_id", F.inline("hits"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those in which a window matches a benchmark item."""
    return scan(docs, benchmark, text).where(F.size("hits") == 0).select("row.*")
