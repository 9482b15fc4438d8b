import hashlib
import re

from styleframe.llm import mixing


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes):
    """Shares by weight, the excess over the caps reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        above = [s for s in open_ if left * w[s] / total >= 2 * sizes[s]]
        if not above:
            out.update({s: left * w[s] / total for s in open_})
            break
        for s in above:
            out[s] = 2.0 * sizes[s]
            open_.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


def brute_hash(i, t):
    key = ("" if i is None else str(i)) + ":" + hashlib.md5((t or "").encode()).hexdigest()
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def brute_mix(rows):
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = brute_targets(sizes)
    taken = []
    for i, t, _, s in rows:
        if not sizes[s]:
            taken.append(0)
            continue
        copies = min(2, int(target[s] / sizes[s]))
        rest = target[s] - copies * sizes[s]
        h = brute_hash(i, t)
        own = [(brute_hash(a, b), size(b)) for a, b, _, c in rows if c == s]
        below, here = sum(n for x, n in own if x < h), sum(n for x, n in own if x == h)
        taken.append(size(t) * min(2, copies + (2 * rest >= 2 * below + here)))
    return target, sizes, taken


def rows_of(n=300):
    out = []
    for i in range(n):
        src = "hot" if i % 3 == 0 else (None if i % 17 == 0 else f"s{i % 7}é")
        out.append((i, " ".join(["w"] * (i * 37 % 90)), "en", src))
    out += [(1, None, None, "empty"), (None, "a b c", None, None), (2, "", "en", "s1é")]
    return out + [out[5], out[5]]


def test_mix_matches_brute_force(spark, make):
    rows = rows_of()
    target, sizes, taken = brute_mix(rows)
    got = mixing.mix(make(rows)).collect()
    want = sorted((i is None, i or 0, size(t), sizes[s], round(target[s], 6), n) for (i, t, _, s), n in zip(rows, taken))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == want


def test_sources_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
            {"taken": "sum", "target": "max", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"] / 2 + 1


def test_mixed_rows_follow_the_mix(spark, make):
    rows = rows_of()
    _, _, taken = brute_mix(rows)
    docs = make(rows)
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    want = {}
    for (i, t, _, _), n in zip(rows, taken):
        if size(t):
            want[(i, t)] = want.get((i, t), 0) + n // size(t)
    have = {}
    for r in got.collect():
        have[(r["doc_id"], r["text"])] = have.get((r["doc_id"], r["text"]), 0) + 1
    assert have == {k: v for k, v in want.items() if v}


def test_empty_tables_and_wordless_ones(spark, make):
    assert mixing.mix(make([]).limit(0)).count() == 0
    assert mixing.mixed(make([]).limit(0)).count() == 0
    got = mixing.mix(make([(1, None, None, None), (2, " ", "en", "a")])).collect()
    assert [r["taken"] for r in got] == [0, 0]


def test_only_dataframe_functions(spark, make):
    plan = mixing.mix(make(rows_of(20)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
