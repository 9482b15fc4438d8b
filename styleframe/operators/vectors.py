"""Vector aggregates over tables of embeddings: centroids / style profiles,
centring, pooling, embedding health, losses.

Vector means use MLlib's ``Summarizer`` (a JVM aggregate with partial merge:
a hot group costs one partial buffer per task).  Covariance uses per-task
Gram matrices (numpy, Arrow batches) summed by (i, j): the shuffle carries
d*d numbers per task, independent of the row count.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleframe.functions import vectors as V


def _cols(c) -> list[str]:
    return [] if c is None else ([c] if isinstance(c, str) else list(c))


def centroid(df: DataFrame, vec: str = "embedding", by=None, out: str = "mean",
             where=None) -> DataFrame:
    """Exact mean vector per group (or overall): (by..., mean array<double>, n)."""
    if where is not None:
        df = df.filter(where)
    by = _cols(by)
    summ = Summarizer.metrics("mean", "count")
    g = df.select(*by, array_to_vector(F.col(vec)).alias("_v"))
    agg = (g.groupBy(*by) if by else g.groupBy()).agg(summ.summary(F.col("_v")).alias("_s"))
    return agg.select(*by, vector_to_array(F.col("_s.mean")).alias(out),
                      F.col("_s.count").alias("n"))


def mean_by(df: DataFrame, key, vec: str = "embedding", where=None) -> DataFrame:
    """Filtered mean of vectors per key (token -> text, text -> user/dialect)."""
    return centroid(df, vec, by=key, where=where)


def center_normalise(df: DataFrame, mu: DataFrame, vec: str = "embedding",
                     out: str = "centred", mu_col: str = "mean") -> DataFrame:
    """(x - mu) / max(||x - mu||, 1e-12).  ``mu`` is one row (the global centroid),
    attached by a broadcast of that single row."""
    m = mu.select(F.col(mu_col).alias("_mu"))
    return (df.crossJoin(F.broadcast(m))
            .withColumn(out, V.unit(V.sub(V.as_double(vec), "_mu"))).drop("_mu"))


def last_by(df: DataFrame, key, vec: str, order: str, out: str = "last") -> DataFrame:
    """Vector of the last position per group (``max_by``: one pass, partial agg)."""
    return df.groupBy(*_cols(key)).agg(F.max_by(vec, order).alias(out))


def span_mean(df: DataFrame, key, vec: str, pos: str, start: str, end: str,
              out: str = "pooled") -> DataFrame:
    """Mean over positions in [start, end) per group; if none, the last vector."""
    key = _cols(key)
    d = df.withColumn("_in", (F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end)))
    inside = centroid(d.filter("_in"), vec, by=key, out="_m").drop("n")
    last = last_by(d, key, vec, pos, out="_last")
    return (last.join(inside, key, "left")
            .select(*key, F.coalesce(F.col("_m"), V.as_double("_last")).alias(out)))


#: dimensions of one block of co-moments, and groups in which the blocks of all tasks are first merged
BLOCK, LOTS = 64, 32
_MOMENTS = "bi int, bj int, lot int, n long, mi array<double>, mj array<double>, m array<double>"


def _moments_task(vec: str, dim: int):
    """Centred co-moments of a task's rows: a row for each block of the upper triangle."""
    def run(it):
        from pyspark import TaskContext
        lot = TaskContext.get().partitionId() % LOTS
        n, mean, m = 0, np.zeros(dim), np.zeros((dim, dim))
        for pdf in it:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
            k, mu = len(x), x.mean(axis=0)
            y, d = x - mu, mu - mean
            m += y.T @ y + np.outer(d, d) * (n * k / (n + k))
            mean += d * (k / (n + k))
            n += k
        if n:
            cuts = [(i, slice(lo, min(lo + BLOCK, dim))) for i, lo in enumerate(range(0, dim, BLOCK))]
            rows = [(i, j, lot, n, mean[a], mean[b], m[a, b].ravel()) for i, a in cuts for j, b in cuts if i <= j]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _MOMENTS.split(", ")])
    return run


def _merge_moments(pdf: pd.DataFrame) -> pd.DataFrame:
    """The co-moments of one block over several sets of rows, merged pairwise: no difference of large sums."""
    first = pdf.iloc[0]
    n, mi, mj, m = 0, np.zeros(len(first["mi"])), np.zeros(len(first["mj"])), np.zeros(len(first["m"]))
    for k, a, b, c in zip(pdf["n"], pdf["mi"], pdf["mj"], pdf["m"]):
        di, dj = a - mi, b - mj
        m = m + c + np.outer(di, dj).ravel() * (n * k / (n + k))
        mi, mj, n = mi + di * (k / (n + k)), mj + dj * (k / (n + k)), n + k
    return pd.DataFrame([(first["bi"], first["bj"], first["lot"], n, mi, mj, m)], columns=list(pdf.columns))


def covariance(df: DataFrame, vec: str = "embedding", dim: int | None = None) -> DataFrame:
    """Sample covariance as a long table (i, j, cov), n-1 in the denominator.

    Each task sends one row for each block of ``BLOCK`` x ``BLOCK`` numbers of the upper triangle;
    blocks are merged in ``LOTS`` groups, then once more, so no task holds the blocks of all others.
    Rows without a vector, or with another number of dimensions than ``dim`` (the most that a row
    has), are left out."""
    if dim is None:
        dim = df.select(F.max(F.size(vec))).first()[0]
    dim = max(dim or 0, 0)
    parts = df.select(vec).where(F.size(vec) == dim).mapInPandas(_moments_task(vec, dim), _MOMENTS)
    lots = parts.groupBy("bi", "bj", "lot").applyInPandas(_merge_moments, _MOMENTS)
    blocks = lots.groupBy("bi", "bj").applyInPandas(_merge_moments, _MOMENTS)
    wide = F.size("mj")
    cells = blocks.select("bi", "bj", "n", wide.alias("w"), F.posexplode("m").alias("at", "c")).select(
        (F.col("bi") * BLOCK + F.floor(F.col("at") / F.col("w"))).cast("int").alias("i"),
        (F.col("bj") * BLOCK + F.col("at") % F.col("w")).cast("int").alias("j"),
        (F.col("bi") < F.col("bj")).alias("off"), (F.col("c") / (F.col("n") - 1)).alias("cov"))
    both = F.when(F.col("off"), F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).otherwise(F.array(F.struct("i", "j")))
    return cells.select(F.explode(both).alias("p"), "cov").select("p.i", "p.j", "cov")


def embedding_health(df: DataFrame, vec: str = "embedding", eps: float = 1e-4,
                     gamma: float = 1.0, beta: float = 1.0, dim: int | None = None) -> DataFrame:
    """One row: variance term mean(relu(1 - (sd + eps))) with sd over n-1, the
    decorrelation term mean over d*d of squared off-diagonal covariance, and
    their weighted sum."""
    cov = covariance(df, vec, dim)
    var = cov.filter("i = j").agg(
        F.avg(F.greatest(F.lit(0.0), F.lit(1.0) - (F.sqrt("cov") + F.lit(eps)))).alias("var_loss"))
    dec = cov.agg(F.avg(F.when(F.col("i") != F.col("j"), F.col("cov") * F.col("cov"))
                        .otherwise(F.lit(0.0))).alias("decor_loss"))
    return var.crossJoin(dec).withColumn(
        "vicreg", F.lit(gamma) * F.col("var_loss") + F.lit(beta) * F.col("decor_loss"))


def bce(df: DataFrame, logit: str, target: str) -> DataFrame:
    """Mean binary cross-entropy from logits over rows x positions (stable form)."""
    z = F.arrays_zip(F.col(logit).alias("x"), F.col(target).alias("y"))
    terms = F.transform(z, lambda p: F.greatest(p["x"], F.lit(0.0)) - p["x"] * p["y"]
                        + F.log1p(F.exp(-F.abs(p["x"]))))
    return df.select(F.explode(terms).alias("_t")).agg(F.avg("_t").alias("bce"))


def cosine_gap(df: DataFrame, a: str, b: str) -> DataFrame:
    """1 - mean cosine(prediction, target)."""
    return df.agg((F.lit(1.0) - F.avg(V.cosine(a, b))).alias("cosine_gap"))


def explode_vector(df: DataFrame, keys: Sequence[str], vec: str, val: str = "value") -> DataFrame:
    """Long form (keys..., dim, value) for export and comparison."""
    return df.select(*keys, F.posexplode(vec).alias("dim", val))


__all__ = ["centroid", "mean_by", "center_normalise", "last_by", "span_mean", "covariance",
           "embedding_health", "bce", "cosine_gap", "explode_vector"]
