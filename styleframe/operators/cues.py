"""Sentence features: rule-based surface cues, annotator-response parsing and a
pluggable batch annotator.

Surface cues compile to ONE projection of ``rlike`` tests (no join, no
explode, one pass); the annotator is the only Python step and runs as an
Arrow-batched ``mapInPandas`` with the key carried in the row.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: surface cues (feature name, Java/RE2 regex) --------------
# Names are the feature keys of the published feature lists; the patterns are
# our rules for the surface cue each name describes.
SURFACE_CUES: tuple[tuple[str, str], ...] = (
    ("contains_inverted_question_mark", "¿"),
    ("contains_inverted_exclamation_mark", "¡"),
    ("contains_all_caps_word", "(^|[^\\p{L}])\\p{Lu}{2,}([^\\p{L}]|$)"),
    ("contains_repeated_punctuation", "[!?؟.,]{2,}"),
    ("contains_arabic_question_mark_؟", "؟"),
    ("contains_question_mark_?", "\\?"),
    ("contains_exclamation_mark_!", "!"),
    ("contains_ellipsis_..._or_…", "\\.\\.\\.|…"),
    ("contains_tatweel_ـ", "ـ"),
    ("contains_letter_lengthening_هههه_يييي",
     "(\\p{L})\\1\\1"),
    ("contains_laughter_token_هههه_هاها_lol",
     "(?i)(ههه|هاها|lol|haha)"),
    ("contains_explicit_subject_tu", "(?i)(^|[^\\p{L}])tú([^\\p{L}]|$)"),
    ("contains_explicit_subject_usted", "(?i)(^|[^\\p{L}])usted([^\\p{L}]|$)"),
    ("contains_explicit_subject_vos", "(?i)(^|[^\\p{L}])vos([^\\p{L}]|$)"),
    ("contains_explicit_subject_vosotros_or_vosotras", "(?i)(^|[^\\p{L}])vosotr[oa]s([^\\p{L}]|$)"),
    ("contains_explicit_subject_ustedes", "(?i)(^|[^\\p{L}])ustedes([^\\p{L}]|$)"),
    ("contains_2pl_present_suffix_ais", "(?i)\\p{L}áis([^\\p{L}]|$)"),
    ("contains_2pl_present_suffix_eis", "(?i)\\p{L}éis([^\\p{L}]|$)"),
    ("contains_diminutive_suffix_ito_or_ita", "(?i)\\p{L}{2,}it[oa]s?([^\\p{L}]|$)"),
    ("contains_diminutive_suffix_illo_or_illa", "(?i)\\p{L}{2,}ill[oa]s?([^\\p{L}]|$)"),
    ("contains_diminutive_suffix_ico_or_ica", "(?i)\\p{L}{2,}ic[oa]s?([^\\p{L}]|$)"),
    ("contains_diminutive_suffix_ete", "(?i)\\p{L}{2,}etes?([^\\p{L}]|$)"),
)
# ---------------------------------------------------------------------------


_LITERAL = re.compile(r"^(?:\\[^A-Za-z0-9]|[^\\.^$*+?{}\[\]|()])+$")


def _as_literal(rx: str) -> str | None:
    """The plain string a pattern matches, when it has no regex operators."""
    if not _LITERAL.match(rx):
        return None
    return re.sub(r"\\(.)", r"\1", rx)


def cue_columns(text: Column, cues: Sequence[tuple[str, str]] = SURFACE_CUES) -> list[Column]:
    """One 0/1 column per cue; literal cues use a substring test, the rest rlike."""
    out = []
    for _, rx in cues:
        lit = _as_literal(rx)
        hit = text.contains(lit) if lit is not None else text.rlike(rx)
        out.append(F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0)))
    return out


def surface_cues(df: DataFrame, text: str = "sentence",
                 cues: Sequence[tuple[str, str]] = SURFACE_CUES,
                 out: str = "feature") -> DataFrame:
    """Add array<double> of 0/1 cue values in cue-list order (single pass)."""
    return df.withColumn(out, F.array(*cue_columns(F.col(text), cues)))


def parse_features(response: Column, names: Sequence[str]) -> Column:
    """Annotator JSON ``{"features": {name: 0|1|true|"1"...}}`` -> array<double>
    in ``names`` order.  A missing name is 0; bad JSON, a missing ``features``
    object, or any present value that is not a number or boolean (including
    null) turns the whole vector into zeros.  Repeated names keep two slots."""
    m = F.from_json(response, T.MapType(T.StringType(), T.StringType()))
    feats = F.from_json(m.getItem("features"), T.MapType(T.StringType(), T.StringType()))
    has = F.map_contains_key
    vals = []
    bad = []
    for n in names:
        raw = feats.getItem(n)
        num = F.when(F.lower(raw) == "true", F.lit(1.0)) \
            .when(F.lower(raw) == "false", F.lit(0.0)) \
            .otherwise(raw.try_cast("double"))
        present = F.coalesce(has(feats, F.lit(n)), F.lit(False))
        vals.append(F.when(present, num).otherwise(F.lit(0.0)))
        bad.append(present & num.isNull())
    any_bad = F.lit(False)
    for b in bad:
        any_bad = any_bad | b
    zeros = F.array(*[F.lit(0.0) for _ in names])
    return F.when(feats.isNull() | any_bad, zeros).otherwise(F.array(*vals))


def pending(df: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not yet in ``done`` (skip work already processed).

    Keys of finished work lie tightly packed in files: by file size they would be broadcast, and each
    task would hold all of them.  Both sides are dealt out by key instead."""
    return df.join(done.select(*key).hint("merge"), on=list(key), how="left_anti")


def attach(df: DataFrame, feats: DataFrame, key: Sequence[str], feature: str = "feature",
           width: int | None = None) -> DataFrame:
    """Join computed features (and any other columns of ``feats``) back by key
    (never by position); a missing feature vector -> zeros."""
    out = df.join(feats, on=list(key), how="left")
    if width is not None:
        out = out.withColumn(feature, F.coalesce(
            F.col(feature), F.array(*[F.lit(0.0) for _ in range(width)])))
    return out


def annotate(df: DataFrame, fn: Callable[[list[str]], list[list[float]]], key: Sequence[str],
             text: str = "sentence", width: int = 1, batch: int = 50, tries: int = 3,
             backoff: float = 1.0) -> DataFrame:
    """Run a user annotator over fixed-size batches of texts inside tasks.

    ``fn(texts) -> list of vectors``.  A batch that still fails after ``tries``
    attempts (doubling wait) yields zero vectors and ``ok = false`` for its rows.
    Spark retries the task on executor loss; the function should be idempotent.
    """
    key = list(key)
    schema = T.StructType(
        [df.schema[k] for k in key]
        + [T.StructField("feature", T.ArrayType(T.DoubleType())),
           T.StructField("ok", T.BooleanType())])

    def run(it):
        for pdf in it:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch]
                texts = part[text].fillna("").tolist()
                vecs, ok = None, False
                for attempt in range(tries):
                    try:
                        vecs = fn(texts)
                        if len(vecs) != len(texts):
                            raise ValueError("annotator returned a wrong count")
                        ok = True
                        break
                    except Exception:
                        if attempt + 1 < tries:
                            time.sleep(backoff * (2 ** attempt))
                if not ok:
                    vecs = [[0.0] * width for _ in texts]
                out = part[key].copy()
                out["feature"] = [list(map(float, v)) for v in vecs]
                out["ok"] = ok
                yield out

    return df.select(*key, text).mapInPandas(run, schema)


def load_feature_names(spark, path: str) -> list[str]:
    """A feature list file is a JSON array of names (a configuration file, read through Spark)."""
    text = spark.read.text(path, wholetext=True).first()
    return [str(n) for n in json.loads(text[0])] if text else []


def annotate_text(df: DataFrame, fn: Callable[[list[str]], list[str | None]], key: Sequence[str],
                  text: str = "request", out: str = "answer", batch: int = 50, tries: int = 3,
                  backoff: float = 1.0) -> DataFrame:
    """(key..., out): text answers of a user annotator, asked in batches inside tasks.

    A batch that still fails after ``tries`` attempts (doubling wait), and every
    null answer, drops its rows: the result holds answered rows only."""
    key = list(key)
    schema = T.StructType([*[df.schema[k] for k in key], T.StructField(out, T.StringType())])

    def run(it):
        for pdf in it:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch]
                texts = part[text].fillna("").tolist()
                for attempt in range(tries):
                    try:
                        got = fn(texts)
                        if len(got) != len(texts):
                            raise ValueError("annotator returned a wrong count")
                        rows = part[key].copy()
                        rows[out] = got
                        yield rows[[x is not None for x in got]]
                        break
                    except Exception:
                        if attempt + 1 < tries:
                            time.sleep(backoff * (2 ** attempt))

    return df.select(*key, text).mapInPandas(run, schema)


__all__ = ["SURFACE_CUES", "surface_cues", "parse_features", "pending", "attach",
           "annotate", "annotate_text", "load_feature_names", "cue_columns"]
