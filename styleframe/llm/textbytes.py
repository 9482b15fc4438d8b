"""Vectorised helpers over Arrow string columns, used inside tasks.

An Arrow string column is one byte buffer plus offsets, so whole batches are
tokenised and hashed with numpy, without a Python object per text or per word.
Work goes through the buffer in pieces of at most ``PIECE`` bytes (a longer
run without a separator is one piece), so memory does not follow the length of
a text beyond a few numbers per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

#: lower-cases A-Z, keeps every other byte
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of words: ASCII letters and digits, and every byte of a non-ASCII character
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = True
WORD_BYTE[128:] = True


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i is bytes[offsets[i]:offsets[i + 1]]; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, wide)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_ranges(offsets: np.ndarray, limit: int):
    """Consecutive (lo, hi) row ranges of at most ``limit`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("b")
    if have is None or len(have) < n:
        size = max(n, PIECE + 64)
        for key, base in (("b", _BASE), ("i", _INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["b"], _POWERS["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Final avalanche of 64-bit hashes (unsigned, wraps)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _cuts(is_word: np.ndarray) -> list[int]:
    """Piece boundaries, each right after a byte that ends no word."""
    n, cuts, at = len(is_word), [0], 0
    while n - at > PIECE:
        back = np.flatnonzero(~is_word[at:at + PIECE])
        if len(back):
            at += int(back[-1]) + 1
        else:
            ahead = np.flatnonzero(~is_word[at + PIECE:])
            at = at + PIECE + int(ahead[0]) + 1 if len(ahead) else n
        cuts.append(at)
    if cuts[-1] != n:
        cuts.append(n)
    return cuts


def words(data: np.ndarray, offsets: np.ndarray):
    """All words of a batch: (hash uint64, row int64, start int64, end int64).

    A word is a maximal run of WORD_BYTE within one row; hashes are of the
    bytes with A-Z lower-cased.  Starts and ends are byte offsets into ``data``.
    """
    hs, ss, es = [], [], []
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    for lo, hi in _pieces(data, offsets):
        part = data[lo:hi]
        w = WORD_BYTE[part]
        if not w.any():
            continue
        first = w.copy()
        first[1:] &= ~w[:-1] | edge[lo + 1:hi]
        last = w.copy()
        last[:-1] &= ~w[1:] | edge[lo + 1:hi]
        s = np.flatnonzero(first)
        e = np.flatnonzero(last) + 1
        power, inverse = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((LOWER[part].astype(np.uint64) + np.uint64(1)) * power[:len(part)], out=total[1:])
        hs.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)))
        ss.append(s + lo)
        es.append(e + lo)
    if not hs:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    start = np.concatenate(ss)
    return (np.concatenate(hs), np.searchsorted(offsets, start, side="right") - 1,
            start, np.concatenate(es))


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """Byte ranges of about PIECE bytes that end at a row end, or between words of a longer row."""
    for lo, hi in row_ranges(offsets, PIECE):
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= PIECE:
            if b > a:
                yield a, b
            continue
        cuts = _cuts(WORD_BYTE[data[a:b]])
        for x, y in zip(cuts, cuts[1:]):
            yield a + x, a + y


def shingles(h: np.ndarray, row: np.ndarray, k: int):
    """Hashes of every run of ``k`` words of one row, and the index of the first word of each."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        acc = acc * np.uint64(_BASE) + h[i:i + n]
    at = np.flatnonzero(row[:n] == row[k - 1:k - 1 + n])
    return mix(acc[at]), at


def characters_before(data: np.ndarray, lo: int, at: int) -> int:
    """Code points in bytes lo..at (for spans in characters)."""
    return int(np.count_nonzero((data[lo:at] & 0xC0) != 0x80))


def _map_task(batches, fn, at: int, names: list[str]):
    for b in batches:
        row = b.column(0)
        yield pa.RecordBatch.from_arrays([row, *fn(row.field(at))], names=["row", *names])


def map_texts(docs, text: str, fn, fields: str):
    """(row struct of all columns of ``docs``, then ``fields``): ``fn`` maps an Arrow array of texts to
    one Arrow array per field.  Keeping the row in a struct means that no column name can clash."""
    import functools

    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    src = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    added = T._parse_datatype_string(fields)
    schema = T.StructType([*src.schema.fields, *added.fields])
    return src.mapInArrow(functools.partial(_map_task, fn=fn, at=docs.columns.index(text), names=added.names), schema)
