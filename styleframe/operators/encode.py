"""Bring-your-own encoder / predictor over a table.

``encode_texts`` runs a user callable over fixed-size batches inside tasks
(Arrow batches via ``mapInPandas``) with the key carried in each row, so the
result joins back by key, never by position.  The model is whatever the
callable closes over; load it lazily inside the callable so each Python
worker loads it once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def encode_texts(df: DataFrame, fn: Callable[[list[str]], np.ndarray], key: Sequence[str],
                 text: str = "text", batch: int = 64, out: str = "vec") -> DataFrame:
    """(key..., vec array<double>) from ``fn(list of texts) -> (n, d) array``."""
    key = list(key)
    schema = T.StructType([df.schema[k] for k in key]
                          + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(it):
        for pdf in it:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s:s + batch]
                v = np.asarray(fn(part[text].fillna("").tolist()), dtype=np.float64)
                o = part[key].copy()
                o[out] = list(v)
                yield o

    return df.select(*key, text).mapInPandas(run, schema)


def letter_encoder(letters: str):
    """A small deterministic stand-in encoder: L2-normalised counts of the given letters (lower-cased
    text), counted by ``str.count``."""
    def fn(texts: list[str]) -> np.ndarray:
        low = [t.lower() for t in texts]
        out = np.array([[t.count(x) for x in letters] for t in low], dtype=np.float64).reshape(len(texts), len(letters))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return fn


__all__ = ["encode_texts", "letter_encoder"]
