"""Language identification by a bidirectional gated recurrent network over bytes (operator 1).

Each direction has one gate and one candidate per unit:
``s = softsign(E[byte] + h U)``, ``z = (1 + s_gate) / 2``, ``h += z (s_cand - h)``.
A softmax over both directions' states labels every byte position; a text's
language probabilities are the mean over its letter positions.  Trained in numpy
by backpropagation through time with Adam.

Scale: training sees at most ``SAMPLE`` texts of each language (an excerpt of
``EXCERPT`` characters each; a bound, whatever the input), taken by a per-group
top-k that Spark applies before its shuffle.  Prediction reads whole texts, cut
into segments of ``SEGMENT`` bytes that run as one matrix; no shuffle.

Edge rows: a null text and one without a letter (Unicode) give ``und`` with
score 0; every other text gets a learned label; ties go to the first label in
order; repeated rows each return a row; with no labelled row at all every text
is ``und``; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from styleframe.llm.textbytes import column_bytes, map_texts, row_ranges

UNDETERMINED = "und"
HIDDEN = 8
SEGMENT = 128
#: bounds of the training sample: texts of a language, characters of a text, languages
SAMPLE, EXCERPT, MAX_LANGUAGES = 500, 400, 500
WINDOW, BATCH, STEPS, RATE = 64, 128, 400, 0.02
#: byte 0 pads segments; its gate is shut, so it leaves the state as it is
SHUT = -1e9
LETTER_BYTE = np.zeros(256, dtype=np.float32)
LETTER_BYTE[65:91] = LETTER_BYTE[97:123] = LETTER_BYTE[128:] = 1


# -- network ------------------------------------------------------------------

def _forward(x: np.ndarray, e: np.ndarray, u: np.ndarray):
    """States after each step, and what backpropagation needs.  x: (steps, n) bytes."""
    steps, n = x.shape
    h = np.zeros((steps + 1, n, u.shape[0]), np.float32)
    s = np.empty((steps, n, u.shape[1]), np.float32)
    k = u.shape[0]
    for t in range(steps):
        a = e[x[t]] + h[t] @ u
        s[t] = a / (1 + np.abs(a))
        z = 0.5 + 0.5 * s[t][:, :k]
        h[t + 1] = h[t] + z * (s[t][:, k:] - h[t])
    return h, s


def _backward(x: np.ndarray, u: np.ndarray, h: np.ndarray, s: np.ndarray, up: np.ndarray):
    """Gradients of byte inputs and recurrent weights.  up: loss gradient of each step's state."""
    steps, n = x.shape
    k = u.shape[0]
    da = np.empty_like(s)
    dh = np.zeros((n, k), np.float32)
    for t in range(steps - 1, -1, -1):
        dh = dh + up[t]
        z = 0.5 + 0.5 * s[t][:, :k]
        da[t][:, :k] = 0.5 * dh * (s[t][:, k:] - h[t])
        da[t][:, k:] = dh * z
        da[t] *= (1 - np.abs(s[t])) ** 2
        dh = dh * (1 - z) + da[t] @ u.T
    du = h[:-1].reshape(-1, k).T @ da.reshape(-1, 2 * k)
    flat, order = x.reshape(-1), np.argsort(x.reshape(-1), kind="stable")
    first = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
    de = np.zeros((256, 2 * k), np.float32)
    de[flat[order][first]] = np.add.reduceat(da.reshape(-1, 2 * k)[order], first, axis=0)
    return de, du


def gradients(p: dict, x: np.ndarray, y: np.ndarray):
    """Mean cross-entropy over letter positions and its gradients.  x: (n, steps), y: (n,) labels."""
    xf, xb = np.ascontiguousarray(x.T), np.ascontiguousarray(x.T[::-1])
    hf, sf = _forward(xf, p["ef"], p["uf"])
    hb, sb = _forward(xb, p["eb"], p["ub"])
    states = np.concatenate([hf[1:], hb[1:][::-1]], axis=2)
    logits = states @ p["w"] + p["b"]
    logits -= logits.max(axis=2, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=2, keepdims=True)
    weight = LETTER_BYTE[xf]
    weight = weight / max(weight.sum(), 1)
    at = prob[:, np.arange(len(y)), y]
    loss = float(-(weight * np.log(at + 1e-12)).sum())
    d = prob
    d[:, np.arange(len(y)), y] -= 1
    d *= weight[:, :, None]
    g = {"w": states.reshape(-1, states.shape[2]).T @ d.reshape(-1, d.shape[2]), "b": d.sum(axis=(0, 1))}
    up = d @ p["w"].T
    k = p["uf"].shape[0]
    g["ef"], g["uf"] = _backward(xf, p["uf"], hf, sf, up[:, :, :k])
    g["eb"], g["ub"] = _backward(xb, p["ub"], hb, sb, up[::-1, :, k:])
    g["ef"][0] = g["eb"][0] = 0
    return loss, g


def initial(classes: int, hidden: int = HIDDEN, seed: int = 7) -> dict:
    r = np.random.RandomState(seed)
    p = {"w": r.randn(2 * hidden, classes) * 0.3, "b": np.zeros(classes)}
    for side in "fb":
        p["e" + side] = r.randn(256, 2 * hidden) * 0.5
        p["u" + side] = r.randn(hidden, 2 * hidden) * 0.3
    p = {k: v.astype(np.float32) for k, v in p.items()}
    for side in "fb":
        p["e" + side][0, :hidden], p["e" + side][0, hidden:] = SHUT, 0
    return p


def train(texts: list[bytes], labels: list[int], classes: int, steps: int = STEPS, seed: int = 7) -> dict:
    """Adam on windows drawn at random from the texts, each language as often."""
    r = np.random.RandomState(seed)
    p = initial(classes, seed=seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    of = [[t for t, y in zip(texts, labels) if y == c and t] for c in range(classes)]
    some = [c for c in range(classes) if of[c]]
    for step in range(1, steps + 1 if some else 1):
        y = np.array([some[i] for i in r.randint(len(some), size=BATCH)])
        x = np.zeros((BATCH, WINDOW), np.uint8)
        for i, c in enumerate(y):
            t = of[c][r.randint(len(of[c]))]
            at = r.randint(max(1, len(t) - WINDOW + 1))
            part = t[at:at + WINDOW]
            x[i, :len(part)] = np.frombuffer(part, np.uint8)
        _, g = gradients(p, x, y)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
            p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return p


def position_probabilities(p: dict, x: np.ndarray):
    """Yields (step, probabilities (classes, n)) for each position of segments x (n, steps), last first."""
    xt = np.ascontiguousarray(x.T)
    steps, n = xt.shape
    k = p["uf"].shape[0]
    kept = np.empty((steps, n, k), np.float32)
    a, b = np.empty((n, 2 * k), np.float32), np.empty((n, 2 * k), np.float32)
    z, d = np.empty((n, k), np.float32), np.empty((n, k), np.float32)

    def step(h, t, e, u):
        np.take(e, xt[t], axis=0, out=a, mode="clip")
        np.matmul(h, u, out=b)
        np.add(a, b, out=a)
        np.abs(a, out=b)
        np.add(b, 1, out=b)
        np.divide(a, b, out=a)
        np.multiply(a[:, :k], 0.5, out=z)
        np.add(z, 0.5, out=z)
        np.subtract(a[:, k:], h, out=d)
        np.multiply(z, d, out=d)
        return d

    h = np.zeros((n, k), np.float32)
    for t in range(steps):
        np.add(h, step(h, t, p["ef"], p["uf"]), out=kept[t])
        h = kept[t]
    wf, wb, bias = p["w"][:k].T.copy(), p["w"][k:].T.copy(), p["b"][:, None]
    h = np.zeros((n, k), np.float32)
    for t in range(steps - 1, -1, -1):
        h += step(h, t, p["eb"], p["ub"])
        logits = wf @ kept[t].T + wb @ h.T + bias
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        yield t, logits


def pooled(p: dict, data: np.ndarray, offsets: np.ndarray, rows_at_once: int = 1024) -> np.ndarray:
    """(rows, classes): mean probabilities over each row's letter positions (zeros without any)."""
    n, classes = len(offsets) - 1, len(p["b"])
    out, letters = np.zeros((n, classes)), np.zeros(n)
    lengths = np.diff(offsets)
    parts = -(-lengths // SEGMENT)
    row = np.repeat(np.arange(n), parts)
    start = offsets[row] + SEGMENT * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
    for lo in range(0, len(row), rows_at_once):
        r, s = row[lo:lo + rows_at_once], start[lo:lo + rows_at_once]
        at = s[:, None] + np.arange(SEGMENT)
        inside = at < offsets[r + 1][:, None]
        x = np.where(inside, data[np.minimum(at, len(data) - 1)], 0)
        weight = np.ascontiguousarray(LETTER_BYTE[x].T)
        total = np.zeros((classes, len(r)), np.float32)
        for t, prob in position_probabilities(p, x):
            total += prob * weight[t]
        base = r[0]
        span = r[-1] - base + 1
        for c in range(classes):
            out[base:base + span, c] += np.bincount(r - base, weights=total[c], minlength=span)
        letters[base:base + span] += np.bincount(r - base, weights=weight.sum(axis=0), minlength=span)
    return out / np.maximum(letters, 1)[:, None]


# -- on Spark -------------------------------------------------------------------

def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> dict:
    """Model from at most ``sample`` texts of each language (``MAX_LANGUAGES`` at most; more is an error)."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("y"), F.xxhash64(F.col(text)).alias("k"), F.col(text).alias("t"))
    room = F.greatest(F.length("t") - EXCERPT, F.lit(0)) + 1
    rows = rows.select("y", "k", F.substring(F.col("t"), F.pmod(F.col("k"), room) + 1, F.lit(EXCERPT)).alias("t"))
    rank = F.row_number().over(Window.partitionBy("y").orderBy("k", "t"))
    got = rows.withColumn("n", rank).where(F.col("n") <= sample).select("y", "t", "k").orderBy("y", "k", "t")
    got = got.limit(sample * MAX_LANGUAGES + 1).collect()
    names = sorted({r["y"] for r in got})
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    index = {y: i for i, y in enumerate(names)}
    model = train([r["t"].encode() for r in got], [index[r["y"]] for r in got], len(names)) if names else None
    return {"names": names, "net": model}


def _predict_texts(col: pa.Array, model: dict) -> list[pa.Array]:
    labels, scores = np.zeros(len(col), np.int32), np.zeros(len(col))
    data, offsets = column_bytes(col)
    for lo, hi in row_ranges(offsets, 1 << 22):
        a, z = offsets[lo], offsets[hi]
        prob = pooled(model["net"], data[a:z], offsets[lo:hi + 1] - a)
        labels[lo:hi] = prob.argmax(axis=1)
        scores[lo:hi] = prob.max(axis=1)
    names = pa.DictionaryArray.from_arrays(pa.array(labels), pa.array(model["names"])).cast(pa.string())
    return [names, pa.array(np.clip(scores, 0, 1))]


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """(row struct of the columns of ``docs``, lang_pred, score)."""
    if not model["names"]:
        return docs.select(F.struct("*").alias("row"), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    out = map_texts(docs, text, functools.partial(_predict_texts, model=model), "lang_pred string, score double")
    letters = F.coalesce(F.col("row").getField(text).rlike(r"\p{L}"), F.lit(False))
    return out.select("row", F.when(letters, F.col("lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
                      F.when(letters, F.col("score")).otherwise(0.0).alias("score"))
