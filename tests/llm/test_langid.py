import zlib

import numpy as np
import pytest

from styleframe.llm import langid, queries


def test_gradients_match_differences():
    r = np.random.RandomState(0)
    p = {k: v.astype(np.float64) for k, v in langid.initial(3, hidden=3, seed=1).items()}
    x = r.randint(97, 105, size=(4, 9)).astype(np.uint8)
    x[0, 6:] = 0
    y = np.array([0, 1, 2, 1])
    real = np.float32
    _, g = langid.gradients({k: v.astype(real) for k, v in p.items()}, x, y)
    for name in ("w", "b", "uf", "ub", "ef", "eb"):
        flat = p[name].reshape(-1)
        spots = r.choice(len(flat), min(6, len(flat)), replace=False) if name[0] != "e" else [100 * p[name].shape[1] + 1, 98 * p[name].shape[1] + 4]
        for i in spots:
            keep, h = flat[i], 1e-2
            flat[i] = keep + h
            up, _ = langid.gradients({k: v.astype(real) for k, v in p.items()}, x, y)
            flat[i] = keep - h
            down, _ = langid.gradients({k: v.astype(real) for k, v in p.items()}, x, y)
            flat[i] = keep
            assert g[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * h), abs=3e-3)


def test_inference_equals_training_network():
    p = langid.initial(4, seed=3)
    r = np.random.RandomState(1)
    x = r.randint(65, 250, size=(5, langid.SEGMENT)).astype(np.uint8)
    hf, _ = langid._forward(np.ascontiguousarray(x.T), p["ef"], p["uf"])
    hb, _ = langid._forward(np.ascontiguousarray(x.T[::-1]), p["eb"], p["ub"])
    z = np.concatenate([hf[1:], hb[1:][::-1]], axis=2) @ p["w"] + p["b"]
    want = np.exp(z) / np.exp(z).sum(axis=2, keepdims=True)
    for t, got in langid.position_probabilities(p, x):
        assert np.allclose(got.T, want[t], atol=1e-4)


def test_held_out_accuracy(spark):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in queries.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang").collect()}
    assert len(got) == len(lang)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.97


def test_texts_without_letters_and_clashing_columns(spark, make):
    train = make([(i, "the cat and the dog sat on a mat " * 3, "en", "s") for i in range(20)] + [(100 + i, "der hund und die katze auf der matte " * 3, "de", "s") for i in range(20)]
                 + [(7, "no label", None, "s")])
    model = langid.fit(train)
    assert model["names"] == ["de", "en"]
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "123 !? \U0001f600", "en", "s"), (4, "Ω", "el", "s"), (5, "the cat " * 40000, "en", "s"), (5, "the cat", "en", "s"), (5, "the cat", "en", "s")]
    docs = make(rows).withColumnRenamed("lang", "lang_pred")
    got = langid.predict(docs, model).select("row.doc_id", "lang_pred", "score").collect()
    by = sorted((r["doc_id"], r["lang_pred"]) for r in got)
    assert by[:3] == [(1, "und"), (2, "und"), (3, "und")] and by[4:] == [(5, "en")] * 3 and by[3][1] in ("de", "en")
    assert langid.predict(make([]).limit(0), model).count() == 0


def test_no_labels_at_all(spark, make):
    docs = make([(1, "words", None, None)])
    model = langid.fit(docs)
    assert [(r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()] == [("und", 0.0)]
