"""Hand-worked numeric fixtures (grades, ties, thresholds, centring, history)."""

import math

from pyspark.sql import functions as F

from styleframe.functions import vectors as V
from styleframe.operators import classify, ranking, vectors


def test_grades_for_anchor_rows(spark):
    items = spark.createDataFrame([(0, p, [float(p == q) for q in range(16)]) for p in range(16)],
                                  "group_id long, pos int, vec array<double>")
    g = ranking.score_groups(items, size=16)
    row = lambda a: [r.grade for r in g.filter(F.col("anchor") == a).orderBy("item").collect()]  # noqa
    assert row(0) == [4, 3, 2, 2, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0]
    assert row(5) == [1, 1, 1, 1, 3, 4, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0]
    assert row(12) == [0] * 8 + [1, 1, 1, 1, 4, 3, 2, 2]
    small = spark.createDataFrame([(0, p, [1.0]) for p in range(4)], "group_id long, pos int, vec array<double>")
    g4 = ranking.score_groups(small, size=4)
    assert [r.grade for r in g4.filter("anchor = 2").orderBy("item").collect()] == [0, 0, 2, 1]


def test_jaccard_ties_and_zero_row(spark):
    feats = [[1, 1, 0, 0, 0], [1, 0, 0, 0, 0], [0, 1, 0, 0, 0], [1, 1, 1, 0, 0], [0, 0, 0, 1, 1],
             [0, 0, 0, 0, 0]]
    df = spark.createDataFrame([(0, i, [float(x) for x in f]) for i, f in enumerate(feats)],
                               "b long, k int, f array<double>")
    w = {(r.i, r.j): r.weight for r in ranking.jaccard_topk(df, "b", "k", "f", k=2).collect()}
    # row 0: 3 -> 2/3, then 1 and 2 tie at 1/2 for the 2nd place: all three kept
    assert abs(w[(0, 3)] - 2 / 3) < 1e-6
    assert abs(w[(0, 1)] - 0.5) < 1e-6 and abs(w[(0, 2)] - 0.5) < 1e-6
    # row 1: 0 -> 1/2, 3 -> 1/3 kept (k = 2); nothing else
    assert abs(w[(1, 0)] - 0.5) < 1e-6 and abs(w[(1, 3)] - 1 / 3) < 1e-6 and w[(1, 2)] == 0.0
    # all-zero row: every weight 0; self is always 0
    assert all(w[(5, j)] == 0.0 for j in range(6))
    assert all(w[(i, i)] == 0.0 for i in range(6))


def test_argmax_first_index_and_strict_unknown(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.2, 0.3, 0.5],), ([0.5, 0.25, 0.25],)], "p array<double>")
    r = df.select(V.argmax("p").alias("a"), classify.apply_unknown(F.col("p"), 0.5, 3).alias("u")).collect()
    assert [x.a for x in r] == [0, 2, 0]
    assert [x.u for x in r] == [3, 2, 0]   # 0.5 is not < 0.5


def test_blend_smallest_weight_wins(spark):
    # both probability tables agree -> every weight gives the same F1: smallest (0.0) wins
    rows = [(i, i % 3, [float(i % 3 == c) for c in range(3)], [float(i % 3 == c) for c in range(3)])
            for i in range(20)]
    df = spark.createDataFrame(rows, "id long, y int, pa array<double>, pb array<double>")
    sc, best = classify.tune_blend(df, "pa", "pb", "y")
    assert best.first()[0] == 0.0
    assert sc.count() == 21


def test_centre_normalise_zero_vector(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [1.0, 1.0, 1.0]),
            (4, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    mu = vectors.centroid(df, "v")
    assert [round(x, 9) for x in mu.first()["mean"]] == [0.5, 0.5, 0.5]
    out = {r.id: r.c for r in vectors.center_normalise(df, mu, "v", out="c").collect()}
    assert out[4] == [0.0, 0.0, 0.0]                      # norm floor, no division error
    assert abs(math.sqrt(sum(x * x for x in out[0])) - 1) < 1e-12


def test_best_run_plateau(spark):
    vals = [0.5, 0.6, 0.6, 0.55, 0.7, 0.7, 0.7, 0.7]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "run long, ep long, f1 double")
    r = classify.best_run(df, ["run"], ["ep"], "f1", patience=3).first()
    assert r.best_epoch == 5 and r.best_value == 0.7 and r.stop_epoch == 8
