import numpy as np

from styleframe.operators import vectors


def test_covariance_of_vectors_far_from_zero(spark):
    """Blocks of unequal size, many tasks, and vectors shifted by 1e6: equal to numpy's."""
    rng = np.random.RandomState(4)
    x = rng.randn(500, 70) @ rng.randn(70, 70) * 0.1
    for shift in (0.0, 1e6):
        rows = [(i, v.tolist()) for i, v in enumerate(x + shift)] + [(900, None), (901, [1.0, 2.0])]
        df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(40)
        got = np.zeros((70, 70))
        for i, j, c in vectors.covariance(df).collect():
            got[i, j] = c
        assert np.allclose(got, np.cov((x + shift).T), rtol=1e-6, atol=1e-8)


def test_covariance_of_nothing(spark):
    assert vectors.covariance(spark.createDataFrame([], "embedding array<double>")).count() == 0
