import math

import numpy as np

from styleframe.llm import kdtree

SCHEMA = "vec_id long, embedding array<double>, id int, v string, shard long, dim int, score int"


def brute(rows, k=10):
    whole = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x * 1024) for x in v):
            continue
        whole.setdefault(i, set()).add(tuple(math.floor(1024 * x) for x in v))
    out = []
    for q in sorted(whole):
        if q % 100:
            continue
        best = []
        for c in whole:
            s = [sum(a * b for a, b in zip(x, y)) for x in whole[q] for y in whole[c] if len(x) == len(y)]
            if c != q and s:
                best.append((-min(max(max(s), -(1 << 63)), (1 << 63) - 1), c))
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(best)[:k])]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3, 4) for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in kdtree.top_products(df, lambda i: i % 100 == 0, **kw).collect())


def test_against_brute_force(spark):
    rng = np.random.RandomState(3)
    rows = [(i, rng.randn(6).round(2).tolist()) for i in range(700)]
    rows += [(i, [0.5, 0.25, 0.0, -0.25, 0.1, 0.2]) for i in range(1000, 1300)]     # copies tie
    rows += [(100, rows[100][1]), (300, [9.0] * 6), (9, [1.0] * 6)]                 # a repeated row, ids with two vectors
    rows += [(2000, None), (2001, [None, 1.0]), (2100, [float("nan")] * 6), (2200, [float("inf")] * 6), (2300, [1e308] * 6), (None, [1.0] * 6)]
    rows += [(2400, [0.0] * 6), (3000, [1.0, 2.0]), (3001, [2.0, -1e-9]), (3100, []), (3101, [])]
    rows += [(4000, [1e12, 1e12, 0.5]), (4001, [-3e12, 1.0, 2.0]), (4002, [2e12, 1e11, 1.0]), (4100, [1e200, 1.0, 1.0]), (4101, [-1e200, 1.0, 1.0])]
    assert run(spark, rows, shard=150, leaf=16, block=3) == brute(rows)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 2 << 20)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_boxes_leave_vectors_out():
    """Clustered data: the walk is exact and compares a small share."""
    rng = np.random.RandomState(5)
    centres = rng.randn(20, 16) * 100
    x = np.floor(centres[rng.randint(20, size=4000)] * 10 + rng.randn(4000, 16))
    order, *rest = kdtree.build(x)
    tree, ids = (order, *rest), np.arange(4000)[order]
    for q in x[::400]:
        found, seen = kdtree.search(tree, x[order], ids, q, -1, 10, None)
        assert sorted(s for s, _ in found) == sorted(int(s) for s in np.sort(x @ q)[-10:])
        assert seen < 2000
    floor = float(np.sort(x @ x[0])[-1])
    found, seen = kdtree.search(tree, x[order], ids, x[0], -1, 10, floor + 1)
    assert found == [] and seen < 800
