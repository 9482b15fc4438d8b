"""Classification queries: label spaces, nearest-centroid probe, metrics,
sweeps, reports, early stopping."""

from __future__ import annotations

from pyspark.sql import functions as F

from styleframe.functions import vectors as V
from styleframe.operators import classify, vectors
from styleframe.plans import sqlx
from styleframe.plans.registry import register
from styleframe.session import checkpoint
from styleframe.sources.tables import table

C = F.col
KNOWN = 8          # open-set: labels >= KNOWN are "unknown" (sentinel KNOWN)


def centroid_probs(spark, sf, temp: float = 10.0, kind: str = "cos", known: int | None = None):
    """(vec_id, label, proba array<double>) — softmax over class centroids."""
    return centroid_tables(spark, sf, {"proba": (temp, kind)}, known)


def centroid_tables(spark, sf, kinds: dict[str, tuple[float, str]], known: int | None = None):
    """(vec_id, label, one probability array per entry of ``kinds``) in one scan of the vectors.

    The classes are the model: one row of K mean vectors, attached to every row by a broadcast.  Dot
    products with them are computed once and shared by all kinds."""
    e = table(spark, sf, "embeddings").withColumn("v", V.as_double("embedding"))
    src = e if known is None else e.filter(C("label") < known)
    per_class = vectors.centroid(src, "v", by="label").withColumn("norm", V.norm("mean"))
    cents = per_class.agg(F.array_sort(F.collect_list(F.struct("label", "mean", "norm"))).alias("_cl"))
    x = e.crossJoin(F.broadcast(cents))

    def probs(temp, kind):
        scale = (lambda n, d: d["n"] * n) if kind == "cos" else (lambda n, d: F.lit(1.0))
        return lambda n, ds: V.softmax(F.transform(ds, lambda d: F.lit(temp) * d["d"] / scale(n, d)))

    dots = F.transform("_cl", lambda c: F.struct(V.dot(C("v"), c["mean"]).alias("d"), F.greatest(c["norm"], F.lit(1e-12)).alias("n")))
    both = V.bind(dots, lambda ds: V.bind(F.greatest(V.norm("v"), F.lit(1e-12)), lambda n: F.struct(
        *[probs(*how)(n, ds).alias(name) for name, how in kinds.items()])))
    return x.select("vec_id", "label", F.explode(F.array(both)).alias("_p")).select("vec_id", "label", "_p.*")


def _probs_sql(name: str, temp: float = 10.0, kind: str = "cos", known: int | None = None) -> str:
    where = "" if known is None else f"WHERE label < {known}"
    if kind == "cos":
        s = (f"{temp} * {sqlx.vdot('v', 'mv')} / (greatest({sqlx.vnorm('v')}, 1e-12) * "
             f"greatest({sqlx.vnorm('mv')}, 1e-12))")
    else:
        s = f"{temp} * {sqlx.vdot('v', 'mv')}"
    return f"""
{name}_mu AS (SELECT label AS c, dim, avg(x) AS m FROM ev {where} GROUP BY label, dim),
{name}_ml AS (SELECT c, list(m ORDER BY dim) AS mv FROM {name}_mu GROUP BY c),
{name}_s AS (SELECT vec_id, label, c, {s} AS s
             FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
                   FROM embeddings), {name}_ml),
{name}_s2 AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS es FROM {name}_s),
{name} AS (SELECT vec_id, label, c, es / sum(es) OVER (PARTITION BY vec_id) AS p FROM {name}_s2)"""


EV = """ev AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x,
                      CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim
               FROM embeddings)"""


def _argmax_sql(src: str) -> str:
    return f"""(SELECT vec_id, label, c AS pred, p AS p_max FROM
   (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) AS rn FROM {src}) WHERE rn = 1)"""


def predictions(spark, sf):
    p = centroid_probs(spark, sf)
    return p.withColumn("pred", V.argmax("proba")).withColumn("p_max", F.array_max("proba"))


PRED_SQL = f"""{EV},
{_probs_sql('pa')},
pred AS {_argmax_sql('pa')}"""


# -- O-104 / O-106 / O-74 ---------------------------------------------------------
@register("nearest_centroid", ops=("O-104", "O-106", "O-74"), sql=f"""
WITH {PRED_SQL}
SELECT vec_id, CAST(pred AS INTEGER) AS pred, round(p_max, 6) AS p_max FROM pred
""")
def nearest_centroid(spark, sf):
    return predictions(spark, sf).select("vec_id", "pred", F.round("p_max", 6).alias("p_max"))


def _report_sql(src: str, by: str = "", labels: str | None = None) -> str:
    """per (by..., label): tp, n_true, n_pred, precision, recall, f1."""
    byc = f"{by}, " if by else ""
    if labels is None:
        base = (f"(SELECT DISTINCT {byc}label AS l FROM {src} UNION "
                f"SELECT DISTINCT {byc}pred AS l FROM {src})")
    else:
        base = f"(SELECT DISTINCT {byc}l FROM {src}, (SELECT unnest({labels}) AS l))"
    jb = " AND ".join([f"x.{b.strip()} = b.{b.strip()}" for b in by.split(",")] if by else ["TRUE"])
    return f"""(SELECT {', '.join('b.' + b.strip() for b in by.split(',')) + ', ' if by else ''}b.l AS label,
       count(*) FILTER (WHERE x.label = b.l AND x.pred = b.l) AS tp,
       count(*) FILTER (WHERE x.label = b.l) AS n_true,
       count(*) FILTER (WHERE x.pred = b.l) AS n_pred
  FROM {base} b JOIN {src} x ON {jb}
  GROUP BY ALL)"""


def _prf_sql(counts: str) -> str:
    return f"""(SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                        ELSE 0.0 END AS f1
  FROM (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
                  CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END AS recall FROM {counts}))"""


# -- O-71 -----------------------------------------------------------------------------
@register("class_report", ops=("O-71",), sql=f"""
WITH {PRED_SQL},
rep AS {_prf_sql(_report_sql('pred'))}
SELECT CAST(label AS INTEGER) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, n_true AS support FROM rep
""")
def class_report(spark, sf):
    rep = classify.class_report(predictions(spark, sf), "label", "pred")
    return rep.select(C("label").cast("int").alias("label"), F.round("precision", 6).alias("precision"),
                      F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "support")


# -- O-72 / O-70 ----------------------------------------------------------------------
@register("f1_scores", ops=("O-72", "O-70"), sql=f"""
WITH {PRED_SQL},
rep AS {_prf_sql(_report_sql('pred'))},
b AS (SELECT vec_id, label, pred, p_max, CAST(floor(vec_id / 16) AS BIGINT) AS batch FROM pred),
lp AS (SELECT pa.vec_id, -ln(pa.p) AS loss, CAST(floor(pa.vec_id / 16) AS BIGINT) AS batch
       FROM pa WHERE pa.c = pa.label),
bl AS (SELECT batch, avg(loss) AS l FROM lp GROUP BY batch)
SELECT (SELECT round(avg(f1), 9) FROM rep) AS macro_f1,
       (SELECT round(count(*) FILTER (WHERE label = pred) / greatest(count(*), 1), 9) FROM b) AS accuracy,
       (SELECT round(avg(l), 9) FROM bl) AS mean_loss
""")
def f1_scores(spark, sf):
    # one scan: counts by (batch, true, predicted) with the loss summed; all scores come from them
    p = predictions(spark, sf).withColumn("loss", -F.log(F.element_at("proba", C("label") + 1)))
    cells = checkpoint(p.groupBy(F.floor(C("vec_id") / 16).alias("batch"), C("label").alias("_t"), C("pred").alias("_p"))
                       .agg(F.count(F.lit(1)).alias("_n"), F.sum("loss").alias("_loss")))
    pairs = cells.groupBy("_t", "_p").agg(F.sum("_n").alias("_n"))
    m = classify.prf(classify.counts_of_pairs(pairs, [])).agg(F.avg("f1").alias("macro_f1"))
    acc = pairs.agg((F.sum(F.when(C("_t") == C("_p"), C("_n")).otherwise(0)) / F.greatest(F.sum("_n"), F.lit(1)))
                    .alias("accuracy"))
    # loss averaged per batch of 16, then over batches
    loss = cells.groupBy("batch").agg((F.sum("_loss") / F.sum("_n")).alias("l")).agg(F.avg("l").alias("mean_loss"))
    return m.crossJoin(acc).crossJoin(loss).select(
        F.round("macro_f1", 9).alias("macro_f1"), F.round("accuracy", 9).alias("accuracy"),
        F.round("mean_loss", 9).alias("mean_loss"))


# -- O-107 / O-108 / O-52 ------------------------------------------------------------------
@register("blend_sweep", ops=("O-107", "O-108", "O-52"), sql=f"""
WITH {EV},
{_probs_sql('pa')},
{_probs_sql('pb', temp=20.0, kind='dot')},
g AS (SELECT k, k / 20 AS w FROM (SELECT unnest(range(0, 21)) AS k)),
bl AS (SELECT g.k, g.w, pa.vec_id, pa.label, pa.c, g.w * pa.p + (1 - g.w) * pb.p AS p
       FROM pa JOIN pb USING (vec_id, c), g),
pr AS (SELECT k, w, vec_id, label, c AS pred FROM
       (SELECT *, row_number() OVER (PARTITION BY k, vec_id ORDER BY p DESC, c) AS rn FROM bl) WHERE rn = 1),
rep AS {_prf_sql(_report_sql('pr', by='k'))},
sc AS (SELECT k, avg(f1) AS macro_f1 FROM rep GROUP BY k),
mx AS (SELECT max(round(macro_f1, 12)) AS m FROM sc),
best AS (SELECT coalesce(min(CASE WHEN round(macro_f1, 12) = m AND m > 0 THEN k END), 10) AS bk FROM sc, mx)
SELECT round(k / 20, 2) AS w, round(macro_f1, 9) AS macro_f1, k = bk AS is_best FROM sc, best
""")
def blend_sweep(spark, sf):
    both = centroid_tables(spark, sf, {"pa": (10.0, "cos"), "pb": (20.0, "dot")})
    sc, best = classify.tune_blend(both, "pa", "pb", "label")
    return sc.crossJoin(best).select(F.round("w", 2).alias("w"), F.round("macro_f1", 9).alias("macro_f1"),
                                     (F.round(C("w"), 9) == F.round(C("best_w"), 9)).alias("is_best"))


# -- O-109 / O-110 ---------------------------------------------------------------------------
@register("unknown_threshold", ops=("O-109", "O-110"), sql=f"""
WITH {EV},
{_probs_sql('pk', known=KNOWN)},
mx0 AS (SELECT vec_id, CASE WHEN label < {KNOWN} THEN label ELSE {KNOWN} END AS label, c, p,
               max(p) OVER (PARTITION BY vec_id) AS pm FROM pk),
am AS (SELECT vec_id, label, c AS am, pm FROM
       (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) AS rn FROM mx0) WHERE rn = 1),
g AS (SELECT k, k / 100 AS t FROM (SELECT unnest(range(0, 101)) AS k)),
pr AS (SELECT k, vec_id, label, CASE WHEN pm < t THEN {KNOWN} ELSE am END AS pred FROM am, g),
rep AS {_prf_sql(_report_sql('pr', by='k', labels=f'range(0, {KNOWN + 1})'))},
sc AS (SELECT k, avg(f1) AS macro_f1 FROM rep GROUP BY k),
mx AS (SELECT max(round(macro_f1, 12)) AS m FROM sc),
best AS (SELECT coalesce(min(CASE WHEN round(macro_f1, 12) = m AND m > 0 THEN k END), 0) AS bk FROM sc, mx)
SELECT round(k / 100, 2) AS t, round(macro_f1, 9) AS macro_f1, k = bk AS is_best FROM sc, best
""")
def unknown_threshold(spark, sf):
    p = centroid_probs(spark, sf, known=KNOWN).withColumn(
        "y", F.when(C("label") < KNOWN, C("label")).otherwise(F.lit(KNOWN)))
    sc, best = classify.tune_unknown(p, "proba", "y", KNOWN, steps=100)
    return sc.crossJoin(best).select(F.round("t", 2).alias("t"), F.round("macro_f1", 9).alias("macro_f1"),
                                     (F.round(C("t"), 9) == F.round(C("best_t"), 9)).alias("is_best"))


# -- O-59 ---------------------------------------------------------------------------------------
@register("label_map", ops=("O-59", "O-58"), sql="""
SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS idx,
       count(*) OVER () AS n_classes
FROM (SELECT DISTINCT 'c' || CAST(label AS VARCHAR) AS label FROM embeddings)
""")
def label_map(spark, sf):
    e = table(spark, sf, "embeddings").select(F.array(F.concat(F.lit("c"), C("label").cast("string")))
                                              .alias("tags"))
    lm = classify.label_map(e, "tags")
    n = e.select(F.element_at("tags", 1).alias("t")).agg(F.count_distinct("t").alias("n_classes"))
    return lm.crossJoin(n)


# -- O-112 -----------------------------------------------------------------------------------------
@register("prediction_report", ops=("O-112",), sql=f"""
WITH {PRED_SQL}
SELECT pa.vec_id, 'c' || CAST(pred.label AS VARCHAR) AS true_label, 'c' || CAST(pred.pred AS VARCHAR) AS pred_label,
       'c' || CAST(pa.c AS VARCHAR) AS class, round(pa.p, 4) AS p
FROM pa JOIN pred USING (vec_id)
""")
def prediction_report(spark, sf):
    p = predictions(spark, sf)
    e = table(spark, sf, "embeddings").select(F.array(F.concat(F.lit("c"), C("label").cast("string")))
                                              .alias("tags"))
    labels = classify.label_map(e, "tags")
    return classify.prediction_report(p, "vec_id", "label", "pred", "proba", labels)


# -- O-60 / O-111 / O-72 (multi-label) --------------------------------------------------------
def _ml_frame(spark, sf):
    lab = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    tags = F.filter(F.array(F.when(C("quality") == 1, F.lit("quality")),
                            F.when(C("toxic") == 1, F.lit("toxic"))), lambda x: x.isNotNull())
    return lab.join(d, "doc_id").select("doc_id", "n_chars", tags.alias("tags"))


@register("multi_label_eval", ops=("O-60", "O-111", "O-72"), sql="""
WITH x AS (SELECT l.doc_id, quality, toxic, d.n_chars FROM labels l JOIN documents d USING (doc_id)),
p AS (SELECT doc_id, quality AS t0, toxic AS t1,
             CASE WHEN 1 / (1 + exp(-((n_chars - 2000) / 1000.0))) >= 0.5 THEN 1 ELSE 0 END AS p0,
             CASE WHEN 1 / (1 + exp(-((n_chars - 6000) / 1000.0))) >= 0.5 THEN 1 ELSE 0 END AS p1
      FROM x),
c AS (SELECT sum(t0 * p0) AS tp0, sum(t0) AS nt0, sum(p0) AS np0,
             sum(t1 * p1) AS tp1, sum(t1) AS nt1, sum(p1) AS np1,
             avg(CASE WHEN t0 = p0 AND t1 = p1 THEN 1.0 ELSE 0.0 END) AS em FROM p),
f AS (SELECT *, CASE WHEN np0 > 0 THEN tp0 / np0 ELSE 0 END AS pr0, CASE WHEN nt0 > 0 THEN tp0 / nt0 ELSE 0 END AS rc0,
                CASE WHEN np1 > 0 THEN tp1 / np1 ELSE 0 END AS pr1, CASE WHEN nt1 > 0 THEN tp1 / nt1 ELSE 0 END AS rc1 FROM c)
SELECT round(((CASE WHEN pr0 + rc0 > 0 THEN 2 * pr0 * rc0 / (pr0 + rc0) ELSE 0 END)
            + (CASE WHEN pr1 + rc1 > 0 THEN 2 * pr1 * rc1 / (pr1 + rc1) ELSE 0 END)) / 2, 9) AS macro_f1,
       round(CASE WHEN nt0 + nt1 + np0 + np1 > 0 THEN 2.0 * (tp0 + tp1) / (nt0 + nt1 + np0 + np1) ELSE 0 END, 9)
         AS micro_f1,
       round(em, 9) AS exact_match
FROM f
""")
def multi_label_eval(spark, sf):
    x = _ml_frame(spark, sf)
    classes = classify.label_map(x, "tags", multi=True)
    y = classify.encode_labels(x, classes, "tags", multi=True, out="y")
    z = F.array(((C("n_chars") - 2000) / 1000.0), ((C("n_chars") - 6000) / 1000.0))
    pred = F.transform(V.sigmoid(z), lambda p: F.when(p >= 0.5, 1.0).otherwise(0.0))
    s = classify.multilabel_scores(y.withColumn("pred", pred), "y", "pred")
    return s.select(F.round("macro_f1", 9).alias("macro_f1"), F.round("micro_f1", 9).alias("micro_f1"),
                    F.round("exact_match", 9).alias("exact_match"))


# -- O-85 -----------------------------------------------------------------------------------------
PATIENCE = 3


@register("best_run", ops=("O-85",), sql=f"""
WITH h AS (SELECT user_id, event_id, ts, value,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
                  coalesce(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS prev
           FROM events),
h2 AS (SELECT *, value > greatest(prev, 0.0) AS imp FROM h),
h3 AS (SELECT *, sum(CAST(imp AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM h2),
h4 AS (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS k FROM h3),
h5 AS (SELECT *, CASE WHEN grp = 0 THEN k ELSE k - 1 END AS miss FROM h4),
st AS (SELECT user_id, min(epoch) AS stop_epoch FROM h5 WHERE miss >= {PATIENCE} GROUP BY user_id),
kept AS (SELECT h5.* FROM h5 LEFT JOIN st USING (user_id) WHERE stop_epoch IS NULL OR epoch <= stop_epoch),
b AS (SELECT user_id, max(epoch) AS best_epoch, arg_max(value, epoch) AS best_value FROM kept WHERE imp
      GROUP BY user_id),
n AS (SELECT user_id, count(*) AS n_epochs FROM kept GROUP BY user_id)
SELECT user_id, n_epochs, CAST(best_epoch AS INTEGER) AS best_epoch, best_value,
       CAST(stop_epoch AS INTEGER) AS stop_epoch
FROM n LEFT JOIN b USING (user_id) LEFT JOIN st USING (user_id)
""")
def best_run(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    return classify.best_run(e, ["user_id"], ["ts", "event_id"], "value", patience=PATIENCE) \
        .select("user_id", "n_epochs", "best_epoch", "best_value", "stop_epoch")


# -- O-86 --------------------------------------------------------------------------------------------
@register("head_limit", ops=("O-86",), sql="""
SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 10
""")
def head_limit(spark, sf):
    return table(spark, sf, "benchmark").orderBy("item_id").limit(10).select("item_id", "text")
