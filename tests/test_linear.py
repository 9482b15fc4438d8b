"""Many targets in one run: gradients, optima, and probabilities recomputed by SQL from exported weights."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from styleframe.operators import linear

SCHEMA = "id long, features array<double>, targets array<double>"


def table(spark, kind, n=300, d=5, k=3, seed=0):
    rnd = np.random.RandomState(seed)
    x = rnd.randn(n, d)
    label = (x @ rnd.randn(d, k) + rnd.gumbel(size=(n, k))).argmax(axis=1)
    y = np.eye(k)[label]
    rows = [(i, x[i].tolist(), y[i].tolist()) for i in range(n)]
    if kind == "ovr":
        rows = [(i, a, [None if (i + j) % 7 == 0 else v for j, v in enumerate(b)]) for i, a, b in rows]
    odd = [(900, None, [0.0] * k), (901, [1.0], [0.0] * k), (902, [0.0] * d, None), (903, [0.0] * d, [1.0])]
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(3).cache(), rows


def objective(rows, w, kind, reg):
    """Plain loss, a row at a time."""
    total = 0.0
    for _, x, y in rows:
        z = w[:, :-1] @ np.array(x) + w[:, -1]
        if kind == "multinomial":
            total -= sum(t * (v - np.log(np.exp(z).sum())) for t, v in zip(y, z))
        else:
            total += sum(np.log(1 + np.exp(v)) - t * v for t, v in zip(y, z) if t is not None)
    return total / len(rows) + reg / 2 * (w[:, :-1] ** 2).sum()


def test_gradient_vanishes_at_a_plain_optimum(spark):
    for kind in ("ovr", "multinomial"):
        df, rows = table(spark, kind)
        m = linear.fit_linear(df, 5, 3, kind, reg=0.01)
        assert m.gradient_norm <= 1e-6 * max(1, np.linalg.norm(m.weights)) and m.passes < 100
        best = objective(rows, m.weights, kind, 0.01)
        assert np.isclose(best, m.loss, rtol=1e-9)
        rnd = np.random.RandomState(1)
        for _ in range(40):  # convex: every step away from the optimum costs
            assert objective(rows, m.weights + 1e-2 * rnd.randn(3, 6), kind, 0.01) > best


def test_one_run_equals_a_run_for_each_target(spark):
    df = table(spark, "ovr")[0].where("id < 900")
    whole = linear.fit_linear(df, 5, 3, reg=0.01, tol=1e-8)
    for j in range(3):
        one = linear.fit_linear(df.withColumn("targets", F.slice("targets", j + 1, 1)), 5, 1, reg=0.01, tol=1e-8)
        assert np.allclose(one.weights[0], whole.weights[j], atol=1e-5)


def test_probabilities_equal_sql_on_exported_weights(spark):
    for kind in ("ovr", "multinomial"):
        df, _ = table(spark, kind)
        m = linear.fit_linear(df, 5, 3, kind, reg=0.01)
        z = linear.logits(m, F.col("features"))
        ok = df.where("size(features) = 5")
        got = ok.select("id", F.posexplode(linear.probabilities(m, z)).alias("k", "p")).toPandas()  # noqa: F841
        x, w = ok.select("id", "features").toPandas(), linear.weight_rows(spark, m).toPandas()  # noqa: F841
        total = "sum(s) OVER (PARTITION BY id)" if kind == "multinomial" else "s + 1"
        sql = f"""WITH z AS (SELECT id, target, exp(intercept + list_dot_product(features, weights)) AS s FROM x, w),
                  p AS (SELECT id, target, s / ({total}) AS p FROM z)
                  SELECT count(*), max(abs(p.p - got.p)) FROM p JOIN got ON p.id = got.id AND p.target = got.k"""
        n, off = duckdb.sql(sql).fetchall()[0]
        assert n == 3 * len(x) and off < 1e-9


def test_empty_and_too_large(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert not linear.fit_linear(none, 4, 2).weights.any()
    assert linear.fit_linear(none, 4, 0).weights.shape == (0, 5)
    try:
        linear.fit_linear(none, linear.MODEL_SIZE, 2)
    except ValueError as e:
        assert "MODEL_SIZE" in str(e)
    else:
        raise AssertionError("too large a model was taken")
