"""License scan by winnowed fingerprints and banded alignment (operator 7).

Templates and texts are word sequences.  Of every ``WINDOW`` consecutive
``GRAM``-word hashes the smallest is a fingerprint (winnowing), so a template
and a text that share a run of GRAM + WINDOW - 1 words share a fingerprint.  An
inverted index from fingerprints to (template, position) gives candidates; hits
of a template on nearby diagonals are one candidate place.  Each place is
aligned with its whole template in a band around the diagonal (match 2, mismatch
and gap -1, free ends in the text).  Places where at least ``COVERAGE`` of the
template's words match are reported; of overlapping places the one with more
matched words stays.

Scale: templates are a parameter of the job (a list, so bounded), sent with the
task; one pass without a shuffle; alignment only runs where fingerprints meet.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased.
Edge rows: a null or wordless text has no matches; templates shorter than GRAM
words are one gram; repeated rows each give their matches; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleframe.llm.textbytes import characters_before, column_bytes, map_texts, row_ranges, shingles, words

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8

#: Notices that are looked for by default (public texts).
TEMPLATES = (
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
     "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("BSD-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
)
FIELDS = (("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("start", pa.int64()), ("end", pa.int64()))
SCHEMA = "hits array<struct<license:string,coverage:double,matched:int,start:bigint,end:bigint>>"


def winnow(grams: np.ndarray, row: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Indices of fingerprints: the last smallest hash of every ``window`` consecutive ones of a row
    (of all of them, where a row has fewer)."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    for i in range(1, window):  # best[j]: of grams j .. j + i in the same row
        j = np.arange(n - i)
        ok = row[j] == row[j + i]
        better = ok & (grams[j + i] <= grams[best[j]])
        best[j[better]] = j[better] + i
    full = np.zeros(n, bool)
    full[:max(0, n - window + 1)] = row[:max(0, n - window + 1)] == row[window - 1:]
    first = np.r_[True, row[1:] != row[:-1]]
    return np.unique(best[full | first])


def align(t: np.ndarray, d: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, last matched index in d): best alignment of all of ``t`` inside ``d`` with
    t[i] near d[i + shift], within ``band`` words of that diagonal."""
    m, width = len(t), 2 * band + 1
    low = shift - band  # column c of row i stands for d[..low + i + c]
    gap = np.arange(width)
    h = np.full((m + 1, width), -1e9)
    ends = low + np.arange(width)
    h[0, (ends >= 0) & (ends <= len(d))] = 0
    for i in range(1, m + 1):
        at = low + i + np.arange(width)  # words of d consumed
        ok = (at >= 1) & (at <= len(d))
        same = np.zeros(width, bool)
        same[ok] = d[at[ok] - 1] == t[i - 1]
        diag = h[i - 1] + np.where(same, 2, -1)
        diag[~ok] = -1e9
        up = np.append(h[i - 1, 1:], -1e9) - 1
        up[(at < 0) | (at > len(d))] = -1e9
        best = np.maximum(diag, up)
        h[i] = np.maximum.accumulate(best + gap) - gap
        h[i, (at < 0) | (at > len(d))] = -1e9
    c, i = int(h[m].argmax()), m
    matched, first, last = 0, -1, -1
    while i > 0:
        at = low + i + c
        same = 1 <= at <= len(d) and d[at - 1] == t[i - 1]
        if 1 <= at <= len(d) and h[i, c] == h[i - 1, c] + (2 if same else -1):
            if same:
                matched, first, last = matched + 1, at - 1, max(last, at - 1)
            i -= 1
        elif c + 1 < width and h[i, c] == h[i - 1, c + 1] - 1:
            i, c = i - 1, c + 1
        else:
            c -= 1
            if c < 0:
                break
    return matched, first, last


class Index:
    """Templates and the inverted index of their fingerprints."""

    def __init__(self, templates):
        self.names, self.texts = [], []
        keys, where = [], []
        for name, text in templates:
            data = np.frombuffer(text.encode(), np.uint8)
            h = words(data, np.array([0, len(data)]))[0]
            if not len(h):
                continue
            g, at = shingles(h, np.zeros(len(h), np.int64), min(GRAM, len(h)))
            if len(h) < GRAM:
                raise ValueError(f"template {name} has fewer than {GRAM} words")
            pick = winnow(g, np.zeros(len(g), np.int64))
            keys += g[pick].tolist()
            where += [(len(self.names), int(a)) for a in at[pick]]
            self.names.append(name)
            self.texts.append(h)
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        self.keys = np.array([keys[i] for i in order], np.uint64)
        self.where = [where[i] for i in order]

    def matches(self, h: np.ndarray, grams: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, matched, first word, last word) in one text, given its fingerprints that are in the index."""
        places: dict[int, list[tuple[int, int]]] = {}
        lo, hi = np.searchsorted(self.keys, grams, "left"), np.searchsorted(self.keys, grams, "right")
        for a, x, y in zip(at, lo, hi):
            for t, p in self.where[x:y]:
                places.setdefault(t, []).append((int(a), p))
        found = []
        for t, pairs in places.items():
            pairs.sort()
            start, after = None, 0  # the diagonal of the last place, the word after its last match
            for a, p in pairs:
                s = a - p
                if start is not None and abs(s - start) <= BAND and a < after:
                    continue
                base = max(0, after, s - BAND)
                part = h[base:max(base, s + len(self.texts[t]) + 2 * BAND)]
                n, first, last = align(self.texts[t], part, s - base)
                start, after = s, max(after, a + 1)
                if n >= COVERAGE * len(self.texts[t]):
                    found.append((t, n, first + base, last + base))
                    after = last + base + 1
        found.sort(key=lambda f: (-f[1], -f[1] / len(self.texts[f[0]]), f[2], f[0]))
        kept: list[tuple[int, int, int, int]] = []
        for f in found:
            if all(f[3] < k[2] or f[2] > k[3] for k in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: f[2])


def _scan_texts(col: pa.Array, templates, held: dict) -> list[pa.Array]:
    if not held:
        held["index"] = Index(templates)
    index = held["index"]
    data, offsets = column_bytes(col)
    hits: list[list] = []
    for lo, hi in row_ranges(offsets, 1 << 22):
        a = offsets[lo]
        part, offs = data[a:offsets[hi]], offsets[lo:hi + 1] - a
        h, row, start, end = words(part, offs)
        g, at = shingles(h, row, GRAM)
        pick = winnow(g, row[at])
        g, at = g[pick], at[pick]
        known = np.isin(g, index.keys)
        g, at = g[known], at[known]
        edges = np.searchsorted(row, np.arange(hi - lo + 1))
        own = np.searchsorted(at, edges)
        for r in range(hi - lo):
            s = slice(own[r], own[r + 1])
            if s.start == s.stop:
                hits.append([])
                continue
            e = edges[r]
            hits.append([(index.names[t], n / len(index.texts[t]), n, characters_before(part, offs[r], start[e + x]),
                          characters_before(part, offs[r], end[e + y]))
                         for t, n, x, y in index.matches(h[e:edges[r + 1]], g[s], at[s] - e)])
    names = [f for f, _ in FIELDS]
    return [pa.array([[dict(zip(names, x)) for x in row] for row in hits], pa.list_(pa.struct(list(FIELDS))))]


def scan(docs: DataFrame, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per match: doc_id, license, coverage, matched (words), start, end (code points, end exclusive)."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = map_texts(slim, "text", functools.partial(_scan_texts, templates=tuple(templates), held={}), SCHEMA)
    return out.where(F.size("hits") > 0).select("row.doc_id", F.inline("hits"))
