import zlib

import numpy as np
import pyarrow as pa

from styleframe.llm import quality as Q
from styleframe.llm import queries
from styleframe.llm.textbytes import column_bytes


def stats(texts):
    return Q.statistics(*column_bytes(pa.array(texts, pa.string())))


def test_statistics_do_not_depend_on_the_batch():
    texts = ["", None, "one", "A b\nC!! d|", "é é é \n\n x", "word " * 3000, "l1 words words words words\nl2 $$$$$ %%%%% ##### &&&&&", " "]
    together = stats(texts)
    assert together.shape[0] == len(texts) and np.isfinite(together).all()
    for i, t in enumerate(texts):
        assert np.allclose(stats([t])[0], together[i])
    assert not together[0].any() and not together[1].any()
    rep = together[5]
    assert rep.max() > 0 and np.isclose(rep, (3000 - 1) / 3000).any()


def test_traversal_equals_walking_each_tree():
    r = np.random.RandomState(0)
    x = r.randn(600, 5)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    m = Q.grow(x, y, trees=20, depth=3)
    want = []
    for row in x:
        s = m.base
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf):
            n = 0
            while n < len(f):
                n = 2 * n + (2 if row[f[n]] > t[n] else 1)
            s += leaf[n - len(f)]
        want.append(s)
    assert np.allclose(m.raw(x), want)
    assert np.mean((m.score(x) > 0.5) == y) > 0.85


def test_first_split_is_the_best_one():
    x = np.stack([np.arange(100.0), np.random.RandomState(1).rand(100)], axis=1)
    y = (x[:, 0] > 49).astype(float)
    m = Q.grow(x, y, trees=1, depth=1)
    assert m.feature[0, 0] == 0 and 46 <= m.threshold[0, 0] <= 53


def test_held_out_accuracy(spark):
    got = queries.op6_quality(spark, "/root/testdata/sf0.01").collect()
    label = {r["doc_id"]: r["quality"] for r in queries.read(spark, "/root/testdata/sf0.01", "labels").collect()}
    assert len(got) == 1000
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in got if r["held_out"] and r["doc_id"] in label]
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in held]) >= 0.95


def test_edge_tables(spark, make):
    docs = make([(1, None, None, None), (2, "", "en", "s"), (3, "a " * 200000, "en", "s"), (3, "b", "en", "s"), (None, "c", "en", "s")])
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        got = Q.score(docs, Q.fit(docs, lab)).select("row.doc_id", "score").collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in Q.score(docs, Q.fit(docs, labels.limit(0))).select("score").collect()} == {0.5}
    assert Q.score(make([]).limit(0), Q.fit(docs, labels)).count() == 0
