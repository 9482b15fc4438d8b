import random
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from styleframe.llm import sharding


def plain_best_fit(sizes, capacity):
    rest, out = [], []
    for s in sizes:
        fit = [(r, i) for i, r in enumerate(rest) if r >= s]
        if fit:
            _, i = min(fit)
        else:
            rest.append(capacity)
            i = len(rest) - 1
        rest[i] -= s
        out.append(i)
    return out


@settings(max_examples=200, database=None, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.integers(100, 300))
def test_packing_matches_a_plain_search(sizes, capacity):
    sizes.sort(reverse=True)
    assert sharding.best_fit_decreasing(sizes, capacity) == plain_best_fit(sizes, capacity)


def test_packing_needs_no_more_bins_than_asked():
    r = random.Random(4)
    for n in (0, 1, 5, 100, 3000):
        sizes = sorted((r.randint(1, 1000) for _ in range(n)), reverse=True)
        where = sharding.pack(sizes, 16)
        assert len(where) == n and all(0 <= w < 16 for w in where)
        if n >= 100:
            load = Counter()
            for s, w in zip(sizes, where):
                load[w] += s
            assert max(load.values()) <= 1.05 * sum(sizes) / 16 + 20


def check(rows, got):
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
        assert 0 <= r["shard"] < 16 and r["law"] == "bytes" and r["grown_shard"] is None
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    where = defaultdict(set)
    for r in got:
        where[(r["size"], r["text_crc32"])].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_groups_stay_together_and_sizes_are_near_equal(spark, make):
    r = random.Random(6)
    rows = [(i, "é" * r.randint(1, 400), "en", "s") for i in range(900)]
    rows += [(2000 + i, f"copy {i % 5}", "en", "s") for i in range(300)] + [(None, None, None, None), (7, "", "en", "s"), rows[0], rows[0]]
    got = sharding.shard(make(rows)).collect()
    check(rows, got)
    load = Counter()
    for x in got:
        load[x["shard"]] += x["size"]
    assert max(load.values()) - min(load.values()) <= 0.03 * sum(load.values()) / 16 + 801


def test_a_group_above_an_even_share_has_a_shard_for_itself(spark, make):
    rows = [(i, "big text " * 20, "en", "s") for i in range(100)] + [(1000 + i, "x" * (i % 50 + 10), "en", "s") for i in range(300)]
    got = sharding.shard(make(rows)).collect()
    check(rows, got)
    big = {r["shard"] for r in got if r["doc_id"] < 1000}
    assert len(big) == 1 and not big & {r["shard"] for r in got if r["doc_id"] >= 1000}
    assert len({r["shard"] for r in got}) == 16


def test_small_grain_bundles_the_rest(spark, make):
    rows = [(i, f"text {i} " * (i % 9 + 1), "en", "s") for i in range(500)]
    got = sharding.place(make(rows), grain=32).collect()
    load = Counter()
    for r in got:
        load[r["_shard"]] += r["_size"]
    assert len(load) == 16 and sum(load.values()) == sum(len(t) + 1 for _, t, _, _ in rows)


def test_empty_table_and_columns(spark, make):
    assert sharding.shard(make([]).limit(0)).count() == 0
    docs = make([(1, "a", "en", "s")])
    assert sharding.sharded(docs).columns == [*docs.columns, "shard", "slot"]
