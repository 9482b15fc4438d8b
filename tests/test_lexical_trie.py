"""N-grams of a vocabulary are found by a trie, totals are added up as numbers: both equal plain cutting."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from styleframe.operators import lexical


def cut(text, lo=2, hi=6):
    padded = [f" {w} " for w in text.split(" ") if w]
    return Counter(p[o:o + n] for p in padded for n in range(lo, hi + 1) for o in range(len(p) - n + 1))


TEXTS = ["the cat  sat", "", "  a", "été 😀x the", "x\0y a\0", "".join(map(chr, range(0x4e00, 0x5400))), "the the the"]


@pytest.mark.parametrize("table", (1 << 24, 10))
@pytest.mark.parametrize("piece", (1 << 17, 5))
def test_trie_finds_what_cutting_finds(monkeypatch, table, piece):
    """In a plain table and a hash table, in one piece and cut anywhere, with documents over several rows and batches."""
    monkeypatch.setattr(lexical, "TABLE", table)
    monkeypatch.setattr(lexical, "PIECE", piece)
    terms = sorted(set(cut("the cat sat 😀x x\0y a 丁丂七丄丅 zzz")) - {"th"})

    class Sent:
        value = (terms, np.arange(len(terms)))

    docs, texts = [None, None, 1, 2, 2, 3, 4], [TEXTS[i] for i in (0, 1, 6, 3, 0, 4, 5)]
    want, rows = {}, Counter(docs)
    for d, t in zip(docs, texts):
        want[d] = want.get(d, Counter()) + Counter({g: c for g, c in cut(t).items() if g in terms})
    for size in (1, 3, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(docs[i:i + size], pa.int64()), pa.array(texts[i:i + size])], names=["d", "t"]) for i in range(0, 7, size)]
        got = {}
        for b in lexical._gram_task(batches, Sent, 2, 6, every=True):
            for d, n, idx, tf in zip(*(c.to_pylist() for c in b.columns)):
                assert idx == sorted(idx) and n == rows[d] and d not in got
                got[d] = Counter({terms[i]: c for i, c in zip(idx, tf)})
        assert got == want
        (df,) = lexical._frequency_task(batches, Sent, 2, 6)
        assert {terms[i]: n for i, n in zip(*(c.to_pylist() for c in df.columns))} == Counter(g for c in want.values() for g in c)


@pytest.mark.parametrize("room", (4_000_000, 50))
def test_totals_equal_cutting(monkeypatch, room):
    monkeypatch.setattr(lexical, "TOTALS", room)
    words = Counter(w for t in TEXTS for w in t.split(" ") if w)
    words.update({chr(0x5400 + i) + chr(0x6000 + i // 2): i + 1 for i in range(1500)})
    want = Counter()
    for w, c in words.items():
        for g, n in cut(w).items():
            want[g] += n * c
    w, c = list(words), list(words.values())
    got = Counter()
    for b in lexical._total_task([pa.RecordBatch.from_arrays([pa.array(w[i:i + 400]), pa.array(c[i:i + 400])], names=["word", "cnt"]) for i in range(0, len(w), 400)], 2, 6):
        for t, n in zip(*(x.to_pylist() for x in b.columns)):
            got[t] += n
    assert got == want


def test_weights_are_made_where_ngrams_are_counted(spark):
    """The known n-grams of a text, many times as long, do not pass through the JVM on their way to the weights."""
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "a cat"), (3, "")], "doc_id long, text string")
    vocab = lexical.fit_tfidf(docs, docs=docs.select("doc_id"))
    tf = lexical.char_ngrams(docs, vocab=vocab)
    w = lexical.tfidf(tf, vocab)
    assert w._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    again = lexical.tfidf(tf.where(F.col("doc_id") > 0), vocab)   # not straight from the counts
    assert {r.doc_id: (r.idx, r.w) for r in w.collect()} == {r.doc_id: (r.idx, r.w) for r in again.collect()}
