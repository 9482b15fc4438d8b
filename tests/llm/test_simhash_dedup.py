import random
import re

import numpy as np
import xxhash

from styleframe.llm import simhash_dedup as S


def brute_fingerprint(text, k=3):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    sh = [" ".join(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(items, radius=3):
    """items: (id, fp) -> component id per item."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= radius:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return [best.get(find(i)) for i in range(len(items))]


def test_fingerprints_match_brute_force():
    texts = ["", " \t\n", "One", "one two", "A b C d", "É é ß x\x0by\x0cz", "a b c " * 50, "x" * 1000, "a b c d", "w " * 3]
    r = random.Random(3)
    texts += [" ".join(r.choice("AaBbé-1") * r.randint(1, 4) for _ in range(r.randint(1, 80))) for _ in range(60)]
    for t in texts:
        assert S.simhash(t.encode()) & (1 << 64) - 1 == brute_fingerprint(t), t


def test_pieces_of_a_long_text_give_the_same_fingerprint(monkeypatch):
    r = random.Random(5)
    text = " ".join(str(r.randint(0, 999)) for _ in range(3000)).encode()
    whole = S.simhash(text)
    for piece in (7, 50, 1000):
        monkeypatch.setattr(S, "PIECE", piece)
        assert S.simhash(text) == whole


def test_masks_cover_every_difference():
    masks = S.covering_masks(list(range(64)))
    assert len(masks) == 15
    r = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << b for b in r.sample(range(64), 3))
        assert any(m & diff == 0 for m in masks)
    fine = S._refined(masks, 3)
    for i, m in enumerate(masks):
        rest = [b for b in range(64) if not m >> b & 1]
        diff = sum(1 << b for b in r.sample(rest, 3))
        assert any(x & diff == 0 and x & m == m for x in fine[i * 15:i * 15 + 15])


def clustered(n, seed):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        x = r.choice(centres)
        for b in r.sample(range(64), r.randint(0, 6)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def test_components_match_brute_force_in_every_kind_of_bucket(spark):
    fps = clustered(500, 2)
    rows = [(i * 3 % 500, S._signed(x)) for i, x in enumerate(fps)]
    want = dict(zip([S._signed(x) for x in fps], brute_components([(i, x & (1 << 64) - 1) for i, x in rows])))
    df = spark.createDataFrame(rows, "id long, fp long").cache()
    from styleframe.llm.components import components
    for block, heavy in ((1024, 1 << 14), (4, 1 << 14), (4, 8)):
        e = S.links(df.select("fp"), 3, block, heavy).cache()
        for u, v in e.collect():
            assert want[u] == want[v]
        root = {r["node"]: r["root"] for r in components(e).collect()}
        groups = {}
        for f in want:
            groups.setdefault(root.get(f, f), set()).add(want[f])
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == len(set(want.values()))


def variants(n=40):
    r = random.Random(9)
    words = [f"w{r.randint(0, 400)}" for _ in range(400)]
    rows = [(1000 + i, " ".join(w if r.random() > 0.01 else "Q" for w in words), "en", "s") for i in range(n)]
    rows += [(i, " ".join(f"z{r.randint(0, 9999)}" for _ in range(30)), "en", "s") for i in range(n)]
    rows += [(None, rows[0][1], None, None), (777, rows[0][1], "en", "s"), (2000, None, "en", "s"), (2001, "  ", "en", "s"), (2002, "", "en", "s")]
    return rows + [rows[3]] * 2


def test_documents_match_brute_force(spark, make):
    rows = variants()
    items = [(i, brute_fingerprint(t)) for i, t, _, _ in rows]
    want = sorted((i is None, i or 0, f"{f:016x}", c) for (i, f), c in zip(items, brute_components(items)))
    got = S.near_duplicates(make(rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in got) == want


def test_one_of_each_group_stays_with_all_columns(spark, make):
    rows = variants()
    docs = make(rows)
    items = [(i, brute_fingerprint(t)) for i, t, _, _ in rows]
    comps = brute_components(items)
    got = S.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(comps))


def test_empty_table_and_only_null_ids(spark, make):
    assert S.near_duplicates(make([]).limit(0)).count() == 0
    assert S.keep_one(make([]).limit(0)).count() == 0
    docs = make([(None, "a b c d", None, None), (None, "a b c d", None, None), (None, "one other text here", None, None)])
    assert [r["component_id"] for r in S.near_duplicates(docs).collect()] == [None] * 3
    assert S.keep_one(docs).count() == 2


def test_stars_connect_what_pairs_connect():
    fps = np.array([S._signed(x) for x in clustered(200, 7)], np.int64)
    want = brute_components([(i, int(x) & (1 << 64) - 1) for i, x in enumerate(fps)])
    root = {}
    for a, b in S.stars(fps, 3):
        root[b] = a
    label = [root.get(int(x), int(x)) for x in fps]
    assert len(set(zip(label, want))) == len(set(want)) == len(set(label))


