"""Language identification for the language predicate: an MLlib pipeline of
character n-gram hashing + multinomial logistic regression, trained on text
whose language is known.  The n-grams of a whole Arrow batch are counted at
once (no string per n-gram); the model is MLlib's."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasNumFeatures, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleframe.functions.text import flatten_newlines

#: places of a batch that are worked on at a time, and the size of a table over all n-grams of its characters
STRETCH, TABLE = 1 << 20, 1 << 22


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint32(r) | x >> np.uint32(32 - r)


def term_hashes(grams: np.ndarray) -> np.ndarray:
    """``HashingTF``'s hash (murmur3 of the UTF-8 bytes, seed 42) of terms: the characters of a row of
    ``grams``, UTF-16 units, joined by blanks.  Half of a pair is "?" in UTF-8, as Java has it."""
    g = np.where((grams >= 0xD800) & (grams < 0xE000), 0x3F, grams).astype(np.uint32)
    n, rows = g.shape[1], np.arange(len(g))
    raw, at = np.zeros((len(g), n * 4), np.uint8), np.zeros(len(g), np.int64)
    for i in range(n):
        c = g[:, i]
        size = 1 + (c >= 0x80) + (c >= 0x800)
        raw[rows, at] = np.where(size == 1, c, np.where(size == 2, 0xC0 | c >> 6, 0xE0 | c >> 12))
        for k in (1, 2):                               # further bytes, six bits each
            more = np.flatnonzero(size > k)
            raw[more, at[more] + k] = 0x80 | c[more] >> (6 * (size[more] - 1 - k)).astype(np.uint32) & 0x3F
        at += size
        if i < n - 1:
            raw[rows, at] = 0x20
            at += 1
    h = np.full(len(g), 42, np.uint32)
    for w, word in enumerate(raw.view("<u4").T):       # bytes past the end are zero
        k = _rotl(word * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        whole, part = at >= 4 * w + 4, at > 4 * w
        h = np.where(whole, _rotl(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64), np.where(part, h ^ k, h))
    h ^= at.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def _hashed(units: np.ndarray, n: int, size: int) -> np.ndarray:
    """Index (hash modulo ``size``) of the n-gram at each place of ``units``; each distinct one is hashed once."""
    seen = np.bincount(units, minlength=1 << 16) > 0
    letters = np.flatnonzero(seen)
    code, m = (np.cumsum(seen) - 1)[units], len(units) - n + 1
    parts = [code[i:i + m] for i in range(n)]
    if len(letters) ** n <= TABLE:
        key = np.zeros(m, np.int64)
        for p in parts:
            key = key * len(letters) + p
        found = np.zeros(len(letters) ** n, bool)
        found[key] = True
        each = np.flatnonzero(found)
        place = (np.cumsum(found) - 1)[key]
        grams = np.stack([letters[each // len(letters) ** (n - 1 - i) % len(letters)] for i in range(n)], 1)
    else:
        grams, place = np.unique(np.stack(parts, 1), axis=0, return_inverse=True)
        grams, place = letters[grams], place.reshape(-1)
    return (term_hashes(grams) % size)[place]


def count_grams(texts: list[str | None], n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, index, count): the hashed character n-grams of each text, by index."""
    raw = [(t or "").encode("utf-16-le", "surrogatepass") for t in texts]
    sizes = np.array([len(r) // 2 for r in raw], np.int64)
    ends = np.cumsum(sizes)
    units = np.frombuffer(b"".join(raw), "<u2")
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0)]
    for lo in range(0, len(units) - n + 1, STRETCH):
        part = units[lo:lo + STRETCH + n - 1]
        hi = lo + len(part) - n + 1
        a, b = np.searchsorted(ends, (lo, hi - 1), side="right")
        share = np.minimum(ends[a:b + 1], hi) - np.maximum(ends[a:b + 1] - sizes[a:b + 1], lo)   # places of each text
        inside = np.ones(hi - lo, bool)
        for i in range(1, n):                            # the last places of a text
            late = ends[a:b + 1] - i - lo
            inside[late[(late >= 0) & (late < hi - lo) & (sizes[a:b + 1] >= i)]] = False
        key = np.sort((np.repeat(np.arange(a, b + 1) * size, share) + _hashed(part, n, size))[inside])
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        keys.append(key[at])
        counts.append(np.diff(np.r_[at, len(key)]).astype(float))
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")               # a text may go on in the next stretch
    key, count = key[order], count[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(count, at) if len(at) else count
    offsets = np.searchsorted(key[at], np.arange(len(texts) + 1) * size)
    return offsets.astype(np.int32), (key[at] % size).astype(np.int32), total


class CharGrams(Transformer, HasInputCol, HasOutputCol, HasNumFeatures, DefaultParamsReadable, DefaultParamsWritable):
    """Text -> counts of its hashed character n-grams, as a tokenizer of single characters, ``NGram`` and
    ``HashingTF`` give them; a null text has none."""

    n = Param(Params._dummy(), "n", "characters of an n-gram", TypeConverters.toInt)

    def __init__(self, **params):
        super().__init__()
        self._set(**params)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n, size = self.getOrDefault("n"), self.getNumFeatures()

        def vectors(texts: pa.Array) -> pa.Array:
            offsets, index, count = count_grams(texts.to_pylist(), n, size)
            k = len(texts)
            return pa.StructArray.from_arrays(
                [pa.array(np.zeros(k, np.int8)), pa.array(np.full(k, size, np.int32)),
                 pa.ListArray.from_arrays(offsets, pa.array(index)), pa.ListArray.from_arrays(offsets, pa.array(count))],
                fields=[pa.field("type", pa.int8(), False), pa.field("size", pa.int32()),
                        pa.field("indices", pa.list_(pa.int32())), pa.field("values", pa.list_(pa.float64()))])

        # not deterministic in name only: the planner may not run it again for a filter on the prediction
        udf = F.arrow_udf(vectors, VectorUDT()).asNondeterministic()
        return dataset.withColumn(self.getOutputCol(), udf(F.col(self.getInputCol())))


def fit_language_model(df: DataFrame, text: str = "text", lang: str = "lang", n: int = 3,
                       features: int = 1 << 16, max_iter: int = 30) -> PipelineModel:
    """Character n-grams (hashed) -> logistic regression; labels kept as strings."""
    d = df.select(flatten_newlines(F.lower(F.col(text))).alias("_t"), F.col(lang).alias("_lang"))
    stages = [
        StringIndexer(inputCol="_lang", outputCol="_y", handleInvalid="skip"),
        CharGrams(inputCol="_t", outputCol="_f", numFeatures=features, n=n),
        LogisticRegression(featuresCol="_f", labelCol="_y", maxIter=max_iter, regParam=1e-4,
                           predictionCol="_p", probabilityCol="_prob", rawPredictionCol="_raw"),
    ]
    model = Pipeline(stages=stages).fit(d)
    labels = model.stages[0].labels
    return PipelineModel(stages=model.stages[1:] + [
        IndexToString(inputCol="_p", outputCol="_pred_lang", labels=labels)])


def predict_language(df: DataFrame, model: PipelineModel, text: str = "text",
                     out: str = "pred_lang") -> DataFrame:
    """Newline-flattened, lower-cased text -> predicted language code."""
    d = df.withColumn("_t", flatten_newlines(F.lower(F.col(text))))
    p = model.transform(d)
    return p.drop("_t", "_f", "_raw", "_prob", "_p").withColumnRenamed("_pred_lang", out)


def keep_predicted(df: DataFrame, model: PipelineModel, codes: Sequence[str], text: str = "text") -> DataFrame:
    """The language predicate with a model: keep rows predicted in ``codes``
    (apply the cheap removed / length filters first)."""
    return predict_language(df, model, text, "_pl").filter(F.col("_pl").isin(*codes)).drop("_pl")
