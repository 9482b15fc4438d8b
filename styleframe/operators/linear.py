"""Many linear targets in one optimiser run: one-vs-rest, multinomial, feature probes.

Every pass over the rows gives the loss and the gradient of all targets at once:
tasks add up blocks in numpy, Spark sums one block of each target over the tasks,
and the driver holds the model alone (targets x (features + 1) numbers, bounded by
``MODEL_SIZE``), on which it takes an L-BFGS step.  The objective is

    mean over rows of the log losses  +  reg / 2 * |weights without intercepts|^2

Rows are (features array<double>, targets array<double>): for ``kind='ovr'`` a
target is 0, 1, or null where it is not known (that entry has no loss); for
``kind='multinomial'`` the array is one-hot.  Rows with null features or targets,
or of other sizes than the model's, take no part.  An empty table gives zeros.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styleframe.functions import vectors as V

#: numbers of a model that travel with every pass (16 MB as doubles)
MODEL_SIZE = 2_000_000
HISTORY = 8


@dataclass(frozen=True)
class LinearModel:
    weights: np.ndarray  # targets x (features + 1), the intercept last
    kind: str
    loss: float
    gradient_norm: float
    passes: int


def _block(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; null entries are NaN."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), width)


def _losses(x: np.ndarray, y: np.ndarray, w: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(loss of each target, gradient block) summed over the rows of ``x`` (intercept column included)."""
    z = x @ w.T
    if kind == "multinomial":
        top = z.max(axis=1, keepdims=True)
        log_p = z - top - np.log(np.exp(z - top).sum(axis=1, keepdims=True))
        return -(y * log_p).sum(axis=0), (np.exp(log_p) - y).T @ x
    known = ~np.isnan(y)
    y = np.where(known, y, 0.0)
    loss = np.where(known, np.logaddexp(0.0, z) - y * z, 0.0)
    p = np.exp(-np.logaddexp(0.0, -z))
    return loss.sum(axis=0), np.where(known, p - y, 0.0).T @ x


def _pass(rows: DataFrame, w: np.ndarray, kind: str) -> tuple[float, np.ndarray]:
    sent = rows.sparkSession.sparkContext.broadcast(w)
    k, d = w.shape

    def task(batches):
        loss, grad = np.zeros(k), np.zeros((k, d))
        for b in batches:
            x = np.hstack([_block(b.column(0), d - 1), np.ones((len(b), 1))])
            some_loss, some_grad = _losses(x, _block(b.column(1), k), sent.value, kind)
            loss += some_loss
            grad += some_grad
        at = np.tile(np.arange(d + 1, dtype=np.int32), k)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), d + 1)), pa.array(at),
                                          pa.array(np.hstack([grad, loss[:, None]]).ravel())], names=["k", "i", "v"])

    sums = rows.mapInArrow(task, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toArrow()
    full = np.zeros((k, d + 1))
    full[sums.column("k").to_numpy(), sums.column("i").to_numpy()] = sums.column("v").to_numpy()
    sent.unpersist()
    return float(full[:, -1].sum()), full[:, :-1]


def _direction(g: np.ndarray, steps: deque) -> np.ndarray:
    """Minus the gradient, scaled by the curvature of the last steps (two-loop recursion)."""
    q, kept = g.copy(), []
    for s, y in reversed(steps):
        a = (s * q).sum() / (s * y).sum()
        q -= a * y
        kept.append(a)
    if steps:
        s, y = steps[-1]
        q *= (s * y).sum() / (y * y).sum()
    for (s, y), a in zip(steps, reversed(kept)):
        q += s * (a - (y * q).sum() / (s * y).sum())
    return -q


def fit_linear(rows: DataFrame, n_features: int, n_targets: int, kind: str = "ovr", reg: float = 1e-3,
               max_passes: int = 200, tol: float = 1e-6, features: str = "features", targets: str = "targets") -> LinearModel:
    """All targets in one run; ``rows`` should be a written or checkpointed table, as each pass reads it.
    Ends when the gradient's norm is at most ``tol`` times max(1, norm of the weights)."""
    if kind not in ("ovr", "multinomial"):
        raise ValueError(f"unknown kind {kind!r}")
    if n_targets * (n_features + 1) > MODEL_SIZE:
        raise ValueError(f"a model of {n_targets} x {n_features + 1} numbers is over MODEL_SIZE = {MODEL_SIZE}")
    ok = (F.size(features) == n_features) & (F.size(targets) == n_targets)
    rows = rows.where(F.col(features).isNotNull() & F.col(targets).isNotNull() & ok).select(
        F.col(features).cast("array<double>").alias("x"), F.col(targets).cast("array<double>").alias("y"))
    n = rows.count()
    w = np.zeros((n_targets, n_features + 1))
    if n == 0 or n_targets == 0:
        return LinearModel(w, kind, 0.0, 0.0, 0)

    def value(at):
        loss, grad = _pass(rows, at, kind)
        free = at.copy()
        free[:, -1] = 0.0
        return loss / n + reg / 2 * (free ** 2).sum(), grad / n + reg * free

    steps: deque = deque(maxlen=HISTORY)
    f, g = value(w)
    passes = 1
    while passes < max_passes and np.linalg.norm(g) > tol * max(1.0, np.linalg.norm(w)):
        step = _direction(g, steps)
        slope = (step * g).sum()
        if slope >= 0:  # curvature that rounding has spoilt
            steps.clear()
            step, slope = -g, -(g * g).sum()
        t = 1.0 if steps else min(1.0, 1.0 / np.linalg.norm(g))
        while True:
            new_f, new_g = value(w + t * step)
            passes += 1
            if new_f <= f + 1e-4 * t * slope or passes >= max_passes:
                break
            t /= 2
        if new_f > f:
            break
        s, y = t * step, new_g - g
        if (s * y).sum() > 1e-12 * (y * y).sum():
            steps.append((s, y))
        w, f, g = w + s, new_f, new_g
    return LinearModel(w, kind, f, float(np.linalg.norm(g)), passes)


def weight_rows(spark, model: LinearModel) -> DataFrame:
    """(target, weights, intercept): the exported model."""
    rows = [(k, w[:-1].tolist(), float(w[-1])) for k, w in enumerate(model.weights)]
    return spark.createDataFrame(rows, "target int, weights array<double>, intercept double")


def logits(model: LinearModel, features: Column) -> Column:
    """Array of the targets' logits, on the JVM: weights are literals of a model of bounded size."""
    def one(w):
        products = F.zip_with(features, F.array(*[F.lit(float(v)) for v in w[:-1]]), lambda a, b: a * b)
        return F.aggregate(products, F.lit(float(w[-1])), lambda t, v: t + v)

    return F.array(*[one(w) for w in model.weights]) if len(model.weights) else F.array().cast("array<double>")


def probabilities(model: LinearModel, z: Column) -> Column:
    """Of logits: softmax (multinomial) or one sigmoid each (one-vs-rest)."""
    return V.sigmoid(z) if model.kind == "ovr" else V.softmax(z)
