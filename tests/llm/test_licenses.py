import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from styleframe.llm import licenses as L
from styleframe.llm.textbytes import column_bytes, words


def brute_score(t, d):
    """Best alignment score of all of t inside d, without a band."""
    h = np.zeros((len(t) + 1, len(d) + 1))
    h[:, 0] = -np.arange(len(t) + 1)
    for i in range(1, len(t) + 1):
        for j in range(1, len(d) + 1):
            h[i, j] = max(h[i - 1, j - 1] + (2 if t[i - 1] == d[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h[-1].max()


@settings(max_examples=150, database=None, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=3, max_size=8), st.lists(st.integers(0, 3), max_size=8))
def test_band_as_wide_as_the_texts_gives_the_best_alignment(t, d):
    t, d = np.array(t), np.array(d, np.int64)
    matched, first, last = L.align(t, d, 0, band=16)
    # the alignment's score follows from its matches at best: matched * 2 - (others) and never beats the optimum
    best = brute_score(t, d)
    assert 2 * matched >= best
    assert matched <= min(len(t), len(d))
    if matched:
        assert d[first] in t and d[last] in t and first <= last


def test_winnowing_guarantee():
    r = random.Random(0)
    for _ in range(300):
        shared = [r.getrandbits(60) for _ in range(L.WINDOW)]
        a = np.array([r.getrandbits(60) for _ in range(r.randint(0, 6))] + shared + [r.getrandbits(60) for _ in range(r.randint(0, 6))], np.uint64)
        b = np.array([r.getrandbits(60) for _ in range(r.randint(0, 6))] + shared, np.uint64)
        fa, fb = (set(x[L.winnow(x, np.zeros(len(x), int))].tolist()) for x in (a, b))
        assert fa & fb


def test_words_match_a_pattern():
    texts = ["", None, "One two,three", "é-ß 1.2", "x" * 50, " a ", "\U0001f600b"]
    data, offsets = column_bytes(pa.array(texts, pa.string()))
    h, row, start, end = words(data, offsets)
    want = [(i, m) for i, t in enumerate(texts) for m in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())]
    assert [(int(r), bytes(data[s:e])) for r, s, e in zip(row, start, end)] == want
    assert len(set(h.tolist())) == len({w.lower() for _, w in want})


def test_pieces_do_not_change_words(monkeypatch):
    from styleframe.llm import textbytes
    r = random.Random(1)
    texts = ["".join(r.choice("ab é,\n") for _ in range(r.randint(0, 300))) for _ in range(40)] + ["z" * 500]
    batch = column_bytes(pa.array(texts))
    whole = words(*batch)
    for piece in (1, 16, 100):
        monkeypatch.setattr(textbytes, "PIECE", piece)
        monkeypatch.setattr(textbytes, "_POWERS", {})
        for a, b in zip(words(*batch), whole):
            assert (a == b).all()


def test_planted_notices(spark, make):
    gpl = dict(L.TEMPLATES)["GPL-3.0-or-later"]
    edited = gpl.replace("redistribute", "share").replace("Free Software Foundation", "Free  Software, Foundation Inc")
    rows = [
        (1, "Éa words.\nReleased under the MIT License.\nmore", "en", "s"), (2, "released UNDER the mit  license", "en", "s"),
        (3, "x " * 500 + edited + " y" * 10, "en", "s"), (4, "released under the sea, a license to sing", "en", "s"),
        (5, None, None, None), (6, "", "en", "s"), (7, dict(L.TEMPLATES)["Apache-2.0-header"], "en", "s"),
        (8, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "en", "s"), (1, "Éa words.\nReleased under the MIT License.\nmore", "en", "s"),
    ]
    got = sorted((r["doc_id"], r["license"], r["start"], r["end"]) for r in L.scan(make(rows)).collect())
    text = rows[0][1]
    at = text.index("Released")
    assert got[:3] == [(1, "MIT", at, at + 30)] * 2 + [(2, "MIT", 0, 31)]
    assert got[3][:3] == (3, "GPL-3.0-or-later", 1000)
    assert [g[:2] for g in got[4:]] == [(7, "Apache-2.0-header"), (8, "CC-BY-NC-4.0"), (8, "CC-BY-NC-4.0")]
    assert L.scan(make([]).limit(0)).count() == 0


def test_notices_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    short = {n: t for n, t in L.TEMPLATES if len(t) < 90}
    want = {(r["doc_id"], n) for r in docs.collect() for n, t in short.items() if t in r["text"]}
    got = {(r["doc_id"], r["license"]) for r in L.scan(docs).collect()}
    assert want <= got and len(got - want) <= 0.1 * len(want) + 1
