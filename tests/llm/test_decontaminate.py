import random
import re
from collections import Counter

import numpy as np

from styleframe.llm import decontaminate as D


def tokens(t):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode().lower())


def shingle_counts(ws, k=5):
    if not ws:
        return Counter()
    return Counter(tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1)))


def brute(docs, items, least=0.8):
    """(doc, item) pairs with some window of the item's size that is similar enough."""
    out = set()
    for i, t in docs:
        ws = tokens(t)
        for j, u in items:
            us = tokens(u)
            if not us or not ws:
                continue
            b = shingle_counts(us)
            for s in range(max(1, len(ws) - len(us) + 1)):
                a = shingle_counts(ws[s:s + len(us)])
                if sum((a & b).values()) >= least * sum((a | b).values()):
                    out.add((i, j))
                    break
    return out


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    items = [(j, " ".join(word() for _ in range(n))) for j, n in enumerate((3, 4, 5, 6, 9, 15, 30, 60, 30, 12))]
    items += [(50, "same same same same same same same same"), (51, items[6][1]), (52, None), (53, " .,!"), (None, "null id item words here now then")]
    docs = []
    for i in range(150):
        ws = [word() for _ in range(r.randint(0, 60))]
        if i % 2:
            u = tokens(items[i % 10][1])
            u = [x.decode() for x in u]
            for _ in range(i % 5):
                if u:
                    u[r.randrange(len(u))] = "EDIT"
            if i % 3 == 0:
                u = u[1:]
            at = r.randint(0, len(ws))
            ws[at:at] = u
        docs.append((i, ("  " if i % 7 else ", ").join(ws).upper() if i % 4 == 0 else " ".join(ws)))
    docs += [(900, None), (901, ""), (902, "same " * 30), (903, "null ID item, words here now then?")]
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, hits int").repartition(3)
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, row int")
    return d, b


def test_matches_equal_brute_force(spark):
    docs, items = corpus()
    d, b = run(spark, docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in D.hits(d, b).collect()}
    assert got == brute(docs, items)
    assert len(got) >= 20


def test_short_items_inside_long_texts(spark):
    r = random.Random(8)
    items = [(1, "Quokka"), (2, "silver quokka"), (3, "a silver quokka"), (4, "one silver quokka sleeps"), (5, "one silver quokka sleeps here")]
    docs = []
    for i in range(60):
        ws = [f"w{r.randrange(50)}" for _ in range(r.randrange(80))]
        u = items[i % 5][1].split()
        if i % 4 == 3:
            u[r.randrange(len(u))] = "edit"
        at = r.randint(0, len(ws))
        ws[at:at] = u
        docs.append((i, " ".join(ws)))
    docs += [(100, "quokka"), (101, "silver QUOKKA"), (102, "one silver quokka"), (103, None), (104, "")]
    d, b = run(spark, docs, items)
    rows = D.hits(d, b).collect()
    assert {(x["doc_id"], x["item_id"]) for x in rows} == brute(docs, items)
    size = {j: len(tokens(t)) for j, t in items}
    text = dict(docs)
    for x in rows:
        assert x["similarity"] == 1.0 or size[x["item_id"]] >= 5
        if size[x["item_id"]] < 5:
            assert tokens(text[x["doc_id"]])[x["first_word"]:x["last_word"] + 1] == tokens(dict(items)[x["item_id"]])


def test_every_pair_within_the_radius_is_a_candidate():
    r = np.random.RandomState(0)
    near = D._near_values(8, D.RADIUS // D.BLOCKS)
    for _ in range(2000):
        a = r.randint(0, 256, 8).astype(np.uint8)
        b = np.packbits(np.unpackbits(a) ^ np.isin(np.arange(64), r.choice(64, D.RADIUS, replace=False)))
        assert any(near[x, y] for x, y in zip(a, b))


def test_chunks_of_the_benchmark_give_the_same(spark, monkeypatch):
    docs, items = corpus()
    d, b = run(spark, docs, items)
    key = lambda df: sorted(map(str, df.collect()))
    whole = key(D.hits(d, b))
    monkeypatch.setattr(D, "CHUNK_BYTES", 300)
    assert key(D.hits(d, b)) == whole


def test_clean_keeps_columns_and_clean_documents(spark):
    docs, items = corpus()
    d, b = run(spark, docs, items)
    out = D.clean(d, b)
    assert out.columns == d.columns
    dirty = {i for i, _ in brute(docs, items)}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, _ in docs if i not in dirty)


def test_empty_sides(spark):
    docs, items = corpus()
    d, b = run(spark, docs, items)
    assert D.clean(d, b.limit(0)).count() == len(docs)
    assert D.hits(d.limit(0), b).count() == 0


def test_spans_of_planted_items(spark):
    item = " ".join(f"item{i}" for i in range(20))
    d, b = run(spark, [(1, "one two " + item + " three " + item), (2, ("x " * 300000) + item)], [(9, item)])
    got = sorted((r["doc_id"], r["first_word"], r["last_word"], r["similarity"]) for r in D.hits(d, b).collect())
    assert got == [(1, 2, 21, 1.0), (1, 23, 42, 1.0), (2, 300000, 300019, 1.0)]
