import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from styleframe.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int, cid long"


def brute(rows, k=10, step=100):
    """query -> [(id, distance)]."""
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v
          and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for i, v in ok:
        if i % step:
            continue
        best = out.setdefault(i, {})
        for j, w in ok:
            if j != i:
                best[j] = min(best.get(j, np.inf), float(np.sqrt(((v - w) ** 2).sum())))
    return {i: sorted(b.items(), key=lambda x: (x[1], x[0]))[:k] for i, b in out.items()}


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, 5) for i, v in rows], SCHEMA).repartition(3)
    out = {}
    for r in N.nearest(df, lambda i: i % 100 == 0, **how).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(got, want):
    assert got.keys() == {q for q, w in want.items() if w}
    for q, w in want.items():
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in w]
        assert np.allclose([d for _, d in got.get(q, [])], [d for _, d in w])


def vectors(n, dim=8, seed=0):
    return [(i, v.tolist()) for i, v in enumerate(np.random.RandomState(seed).randn(n, dim).astype(np.float32))]


def test_all_leaves_visited_is_exact_with_copies_and_ties(spark):
    rows = vectors(400)
    hot = rows[3][1]
    rows += [(1000 + i, hot) for i in range(200)] + [(401, [2.0] + [0.0] * 7), (402, [-2.0] + [0.0] * 7)]
    rows += [rows[7], rows[7], (500, [0.0] * 8), (600, None), (700, [1.0] * 7 + [None]), (800, [float("nan")] + [1.0] * 7),
             (900, [float("inf")] * 8), (None, hot), (100, rows[9][1])]
    same(run(spark, rows, recall=1.0, leaf=16), brute(rows))


def test_chunks_and_depth_do_not_change_results(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 7)
    monkeypatch.setattr(N, "QUERY_CHUNK", 2)
    rows = vectors(600, 4)
    same(run(spark, rows, recall=1.0, leaf=8, sample=50), brute(rows))


def test_fewer_candidates_than_k_and_empty(spark):
    same(run(spark, vectors(4)), brute(vectors(4)))
    same(run(spark, vectors(1)), {0: []})
    assert run(spark, [(None, None)]) == {}


def test_shared_queue_visits_leaves_by_margin():
    x = np.random.RandomState(2).randn(500, 6)
    forest = N.build_forest(x, 3, 20)
    q = x[0]
    margins = {}
    for t, (dirs, cuts, left, right, _) in enumerate(forest):
        work = [(0, 0.0)]
        while work:
            node, far = work.pop()
            s = dirs[node] @ q - cuts[node]
            for child, on in ((left[node], s <= 0), (right[node], s > 0)):
                m = far if on else max(far, abs(s))
                if child < 0:
                    margins[(t, -child - 1)] = m
                else:
                    work.append((child, m))
    got = N.visited_leaves(forest, q, 25)
    assert len(set(got)) == 25
    assert np.allclose(sorted(margins[g] for g in got), sorted(margins.values())[:25])
    for t, tree in enumerate(forest):
        assert (t, N.leaf_of(tree, x[:1])[0]) in got


def test_recall_with_production_parameters(spark):
    import duckdb
    r = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet' order by 1").fetchnumpy()
    ids, x = r["vec_id"], np.stack(r["embedding"]).astype(float)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert recall_of(N.nearest(df, lambda i: i % 100 == 0), ids, x) >= 0.9


def recall_of(found, ids, x, step=100):
    got = {}
    for row in found.collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    hits = total = 0
    for at in np.flatnonzero(ids % step == 0):
        d = ((x - x[at]) ** 2).sum(axis=1)
        d[at] = np.inf
        hits += len(got[ids[at]] & set(ids[np.argsort(d)[:10]].tolist()))
        total += 10
    return hits / total


def compared(x):
    """Share of all vectors whose distance a query computes, copies in several trees counted again."""
    forest = N.build_forest(x)
    return N.visits_for(forest, x) * N.TREES / sum(t[4] for t in forest)


def test_recall_and_work_at_twenty_thousand(spark, tmp_path):
    rnd = np.random.RandomState(4)
    middles = rnd.randn(200, 64)
    for name, x, most in (("random", rnd.randn(20_000, 64), 1.3), ("clusters", middles[rnd.randint(200, size=20_000)] + 0.4 * rnd.randn(20_000, 64), 0.1)):
        x = x.astype(np.float32)
        pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}), tmp_path / f"{name}.parquet")
        df = spark.read.parquet(str(tmp_path / f"{name}.parquet"))
        assert recall_of(N.nearest(df, lambda i: i % 400 == 0), np.arange(len(x)), x.astype(float), 400) >= 0.9
        assert compared(x.astype(float)) <= most


def test_work_grows_slower_than_the_square():
    """Queries are a hundredth of the vectors: a full scan is quadratic, the search of clusters is not."""
    rnd = np.random.RandomState(6)
    shares = []
    for n in (5_000, 20_000, 60_000):
        middles = rnd.randn(n // 100, 32)
        shares.append(compared(middles[rnd.randint(len(middles), size=n)] + 0.3 * rnd.randn(n, 32)))
    assert shares[2] < shares[1] < shares[0] and shares[2] < 0.05


def test_visits_of_few_vectors():
    for n in (1, 2, 5):
        x = np.random.RandomState(n).randn(n, 3)
        assert N.visits_for(N.build_forest(x), x) >= 1
    assert N.visits_for([], np.zeros((0, 1))) == 0
