"""Vector, ranking and embedding-health queries over ``embeddings``
(vec_id, embedding float[64], label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from styleframe.functions import vectors as V
from styleframe.operators import ranking, vectors
from styleframe.plans import sqlx
from styleframe.plans.registry import register
from styleframe.sources.tables import table

C = F.col
EV = """ev AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x,
                      CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim
               FROM embeddings)"""


def emb(spark, sf):
    return table(spark, sf, "embeddings")


def _long(df, keys, vec, val="value", digits=6):
    return df.select(*keys, F.posexplode(vec).alias("dim", "_v")).select(
        *keys, C("dim").cast("bigint").alias("dim"), F.round("_v", digits).alias(val))


# -- O-61 / O-63 -------------------------------------------------------------------
@register("centroids", ops=("O-61", "O-63"), sql=f"""
WITH {EV}
SELECT label, dim, round(avg(x), 6) AS mean, count(*) AS n FROM ev GROUP BY label, dim
UNION ALL
SELECT -1 AS label, dim, round(avg(x), 6) AS mean, count(*) AS n FROM ev GROUP BY dim
""")
def centroids(spark, sf):
    e = emb(spark, sf)
    per = vectors.centroid(e, "embedding", by="label")
    glob = vectors.centroid(e, "embedding").withColumn("label", F.lit(-1))
    both = per.unionByName(glob)
    return both.select("label", "n", F.posexplode("mean").alias("dim", "_v")).select(
        "label", C("dim").cast("bigint").alias("dim"), F.round("_v", 6).alias("mean"), "n")


# -- O-62 -------------------------------------------------------------------------------
@register("center_normalise", ops=("O-62",), sql=f"""
WITH {EV},
mu AS (SELECT dim, avg(x) AS m FROM ev GROUP BY dim),
c AS (SELECT vec_id, ev.dim, x - m AS y FROM ev JOIN mu USING (dim)),
nrm AS (SELECT vec_id, greatest(sqrt(sum(y * y)), 1e-12) AS nn FROM c GROUP BY vec_id)
SELECT vec_id, dim, round(y / nn, 6) AS value FROM c JOIN nrm USING (vec_id)
""")
def center_normalise(spark, sf):
    e = emb(spark, sf)
    mu = vectors.centroid(e, "embedding")
    c = vectors.center_normalise(e, mu, "embedding")
    return _long(c, ["vec_id"], "centred")


# -- O-64 -------------------------------------------------------------------------------
@register("last_vector", ops=("O-64",), sql=f"""
WITH {EV},
lastid AS (SELECT label, max(vec_id) AS vec_id FROM embeddings GROUP BY label)
SELECT label, dim, round(x, 6) AS value FROM ev JOIN lastid USING (label, vec_id)
""")
def last_vector(spark, sf):
    lv = vectors.last_by(emb(spark, sf), "label", "embedding", "vec_id")
    return _long(lv.withColumn("last", V.as_double("last")), ["label"], "last")


# -- O-65 -------------------------------------------------------------------------------
@register("span_mean", ops=("O-65",), sql=f"""
WITH {EV},
sp AS (SELECT label, label * 50 AS s, label * 50 + (label % 3) * 10 AS e FROM
       (SELECT DISTINCT label FROM embeddings)),
inside AS (SELECT ev.label, dim, avg(x) AS v FROM ev JOIN sp ON ev.label = sp.label
           WHERE vec_id >= s AND vec_id < e GROUP BY ev.label, dim),
lastid AS (SELECT label, max(vec_id) AS vec_id FROM embeddings GROUP BY label),
lastv AS (SELECT label, dim, x AS v FROM ev JOIN lastid USING (label, vec_id))
SELECT l.label, l.dim, round(coalesce(i.v, l.v), 6) AS value
FROM lastv l LEFT JOIN inside i ON i.label = l.label AND i.dim = l.dim
WHERE i.v IS NOT NULL OR NOT EXISTS (SELECT 1 FROM inside i2 WHERE i2.label = l.label)
""")
def span_mean(spark, sf):
    e = emb(spark, sf).withColumn("start", C("label") * 50) \
        .withColumn("end", C("label") * 50 + (C("label") % 3) * 10)
    p = vectors.span_mean(e, "label", "embedding", "vec_id", "start", "end")
    return _long(p, ["label"], "pooled")


# -- O-67 -------------------------------------------------------------------------------
@register("embedding_health", ops=("O-67",), sql=f"""
WITH {EV},
mu AS (SELECT dim, avg(x) AS m, count(*) AS n FROM ev GROUP BY dim),
c AS (SELECT vec_id, ev.dim, x - m AS y, n FROM ev JOIN mu USING (dim)),
cov AS (SELECT a.dim AS i, b.dim AS j, sum(a.y * b.y) / (any_value(a.n) - 1) AS cov
        FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY a.dim, b.dim),
v AS (SELECT avg(greatest(0.0, 1.0 - (sqrt(cov) + 0.0001))) AS var_loss FROM cov WHERE i = j),
d AS (SELECT avg(CASE WHEN i <> j THEN cov * cov ELSE 0.0 END) AS decor_loss FROM cov)
SELECT round(var_loss, 9) AS var_loss, round(decor_loss * 1e6, 6) AS decor_loss_e6,
       round(var_loss + decor_loss, 9) AS vicreg
FROM v, d
""")
def embedding_health(spark, sf):
    h = vectors.embedding_health(emb(spark, sf), "embedding", dim=None)
    return h.select(F.round("var_loss", 9).alias("var_loss"),
                    F.round(C("decor_loss") * 1e6, 6).alias("decor_loss_e6"),
                    F.round("vicreg", 9).alias("vicreg"))


# -- O-68 / O-32 ---------------------------------------------------------------------
@register("bce", ops=("O-68", "O-32"), sql=f"""
WITH {EV},
t AS (SELECT vec_id, dim, x * 10 AS z, CASE WHEN label = dim THEN 1.0 ELSE 0.0 END AS y
      FROM ev)
SELECT round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 9) AS bce,
       CAST(sum(CASE WHEN z / 10 > 0.05 THEN 1 ELSE 0 END) AS DOUBLE) AS n_positive
FROM t
""")
def bce(spark, sf):
    e = emb(spark, sf)
    z = F.transform("embedding", lambda x: x.cast("double") * 10)
    y = F.transform("embedding", lambda x, j: F.when(C("label") == j, F.lit(1.0)).otherwise(F.lit(0.0)))
    d = e.select(z.alias("z"), y.alias("y"), V.binarise(V.as_double("embedding"), 0.05).alias("b"))
    loss = vectors.bce(d, "z", "y")
    pos = d.agg(F.sum(V.vsum("b")).alias("n_positive"))
    return loss.crossJoin(pos).select(F.round("bce", 9).alias("bce"), "n_positive")


# -- O-69 -------------------------------------------------------------------------------
@register("cosine_gap", ops=("O-69",), sql=f"""
WITH {EV},
mu AS (SELECT label, dim, avg(x) AS m FROM ev GROUP BY label, dim),
p AS (SELECT vec_id, sum(x * m) AS d, sqrt(sum(x * x)) AS na, sqrt(sum(m * m)) AS nb
      FROM ev JOIN mu USING (label, dim) GROUP BY vec_id)
SELECT round(1 - avg(d / (greatest(na, 1e-12) * greatest(nb, 1e-12))), 9) AS cosine_gap FROM p
""")
def cosine_gap(spark, sf):
    e = emb(spark, sf)
    mu = vectors.centroid(e, "embedding", by="label")
    j = e.join(mu, "label").withColumn("embedding", V.as_double("embedding"))
    return vectors.cosine_gap(j, "embedding", "mean").select(
        F.round("cosine_gap", 9).alias("cosine_gap"))


# -- O-78 / O-76 / O-77 / O-81 / O-73 -------------------------------------------------
GROUP = 16


def group_items(spark, sf):
    """Embeddings as graded groups of up to 16 consecutive ids, unit-normalised."""
    return emb(spark, sf).select(F.floor(C("vec_id") / GROUP).cast("bigint").alias("group_id"),
                                 (C("vec_id") % GROUP).cast("int").alias("pos"),
                                 V.unit(V.as_double("embedding")).alias("vec"))


GROUP_SQL = f"""
g AS (SELECT CAST(floor(vec_id / {GROUP}) AS BIGINT) AS group_id, CAST(vec_id % {GROUP} AS INTEGER) AS pos,
             {sqlx.vunit('embedding')} AS vec FROM embeddings),
gf AS (SELECT * FROM g),
sc AS (SELECT a.group_id, a.pos AS anchor, b.pos AS item, {sqlx.vdot('a.vec', 'b.vec')} AS score,
              4 - (CASE WHEN xor(a.pos, b.pos) = 0 THEN 0 WHEN xor(a.pos, b.pos) = 1 THEN 1
                        WHEN xor(a.pos, b.pos) < 4 THEN 2 WHEN xor(a.pos, b.pos) < 8 THEN 3
                        ELSE 4 END) AS grade
       FROM gf a JOIN gf b USING (group_id)),
na AS (SELECT * FROM sc WHERE item <> anchor)"""


def _ndcg_sql(k):
    disc = ("(CASE WHEN p < {k} THEN 1.0 / log2(p + 2) ELSE 0.0 END)".format(k=k)
            if k else "(1.0 / log2(p + 2))")
    return f"""(SELECT group_id, anchor, CASE WHEN sum(idcg) > 0 THEN sum(dcg) / sum(idcg) ELSE 0.0 END AS v
  FROM (SELECT group_id, anchor,
          avg_g * list_reduce(list_transform(range(st, st + sz), lambda p: {disc}), lambda x, y: x + y, 0.0) / sz AS dcg,
          grade * list_reduce(list_transform(range(ip, ip + 1), lambda p: {disc}), lambda x, y: x + y, 0.0) AS idcg
        FROM (SELECT *, rank() OVER (PARTITION BY group_id, anchor ORDER BY score DESC) - 1 AS st,
                     count(*) OVER (PARTITION BY group_id, anchor, score) AS sz,
                     avg(grade) OVER (PARTITION BY group_id, anchor, score) AS avg_g,
                     row_number() OVER (PARTITION BY group_id, anchor ORDER BY grade DESC, item) - 1 AS ip
              FROM na))
  GROUP BY group_id, anchor)"""


RANK_SQL = f"""
WITH {GROUP_SQL},
n0 AS {_ndcg_sql(None)}, n1 AS {_ndcg_sql(1)}, n3 AS {_ndcg_sql(3)},
rr AS (SELECT group_id, anchor, 1.0 / min(CASE WHEN grade > 0 THEN r END) AS v
       FROM (SELECT *, row_number() OVER (PARTITION BY group_id, anchor ORDER BY score DESC, item) AS r
             FROM na) GROUP BY group_id, anchor),
rc AS (SELECT group_id, anchor, 1.0 / arg_max(p, (score, -p)) AS v
       FROM (SELECT *, row_number() OVER (PARTITION BY group_id, anchor ORDER BY grade DESC, item) AS p
             FROM na WHERE grade > 0) GROUP BY group_id, anchor),
ml AS (SELECT a.group_id, a.anchor,
              avg(greatest(0.0, 0.5 - sign(a.grade - b.grade) * (a.score - b.score))) AS v
       FROM sc a JOIN sc b ON a.group_id = b.group_id AND a.anchor = b.anchor
       WHERE a.grade <> b.grade GROUP BY a.group_id, a.anchor)
SELECT n0.group_id, round(avg(n0.v), 9) AS ndcg, round(avg(n1.v), 9) AS ndcg_at_1,
       round(avg(n3.v), 9) AS ndcg_at_3, round(avg(coalesce(rr.v, 0)), 9) AS mrr,
       round(avg(coalesce(rc.v, 0)), 9) AS mrr_compat,
       round(sum(ml.v), 9) AS margin_loss
FROM n0 JOIN n1 USING (group_id, anchor) JOIN n3 USING (group_id, anchor)
     LEFT JOIN rr USING (group_id, anchor) LEFT JOIN rc USING (group_id, anchor)
     LEFT JOIN ml USING (group_id, anchor)
GROUP BY n0.group_id
"""


def group_metrics(spark, sf):
    sc = ranking.score_groups(group_items(spark, sf), size=GROUP)
    m = ranking.query_metrics(sc, ["group_id"], "anchor", ks=(None, 1, 3), margin=0.5)
    return m.groupBy("group_id").agg(
        F.round(F.avg("ndcg"), 9).alias("ndcg"), F.round(F.avg("ndcg_1"), 9).alias("ndcg_at_1"),
        F.round(F.avg("ndcg_3"), 9).alias("ndcg_at_3"), F.round(F.avg("rr"), 9).alias("mrr"),
        F.round(F.avg("rr_compat"), 9).alias("mrr_compat"),
        F.round(F.sum("margin_loss"), 9).alias("margin_loss"))


register("group_ranking", sql=RANK_SQL,
         ops=("O-78", "O-76", "O-77", "O-81"))(group_metrics)


@register("metric_means", ops=("O-73",), sql=f"""
WITH r AS ({RANK_SQL.replace(chr(10), ' ')})
SELECT round(avg(ndcg), 9) AS ndcg, round(avg(mrr), 9) AS mrr, round(avg(margin_loss), 9) AS loss
FROM r
""")
def metric_means(spark, sf):
    m = group_metrics(spark, sf)
    return m.agg(F.round(F.avg("ndcg"), 9).alias("ndcg"), F.round(F.avg("mrr"), 9).alias("mrr"),
                 F.round(F.avg("margin_loss"), 9).alias("loss"))


# -- O-75 / O-51 / O-32 ----------------------------------------------------------------
def group_feats(spark, sf):
    return emb(spark, sf).select(F.floor(C("vec_id") / GROUP).cast("bigint").alias("group_id"),
                                 (C("vec_id") % GROUP).cast("int").alias("pos"),
                                 V.binarise(V.as_double("embedding"), 0.0).alias("feat"),
                                 V.unit(V.as_double("embedding")).alias("vec"))


JACC_SQL = f"""
{GROUP_SQL.replace('{sqlx.vunit', '{sqlx.vunit')}
, f AS (SELECT CAST(floor(vec_id / {GROUP}) AS BIGINT) AS group_id, CAST(vec_id % {GROUP} AS INTEGER) AS pos,
              list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS feat
       FROM embeddings),
pw AS (SELECT a.group_id, a.pos AS i, b.pos AS j,
              CASE WHEN a.pos = b.pos THEN 0.0 ELSE
                {sqlx.vdot('a.feat', 'b.feat')} / ({sqlx.vsum('a.feat')} + {sqlx.vsum('b.feat')}
                 - {sqlx.vdot('a.feat', 'b.feat')} + 1e-8) END AS w
       FROM f a JOIN f b USING (group_id)),
kth AS (SELECT group_id, i, w AS kw FROM
        (SELECT *, row_number() OVER (PARTITION BY group_id, i ORDER BY w DESC) AS rn,
                count(*) OVER (PARTITION BY group_id, i) AS n FROM pw)
        WHERE rn = least(5, n - 1)),
jw AS (SELECT group_id, i, j, CASE WHEN w >= coalesce(kw, 0.0) THEN w ELSE 0.0 END AS weight
       FROM pw LEFT JOIN kth USING (group_id, i))"""


@register("jaccard_weights", ops=("O-75", "O-51", "O-32"), sql=f"""
WITH {JACC_SQL}
SELECT group_id, i, j, round(weight, 9) AS weight FROM jw
""")
def jaccard_weights(spark, sf):
    w = ranking.jaccard_topk(group_feats(spark, sf), "group_id", "pos", "feat", k=5)
    return w.select("group_id", "i", "j", F.round("weight", 9).alias("weight"))


@register("contrastive_loss", ops=("O-82",), sql=f"""
WITH {JACC_SQL},
s AS (SELECT a.group_id, a.pos AS i, b.pos AS j, {sqlx.vdot('a.vec', 'b.vec')} / 0.07 AS sim
      FROM gf a JOIN gf b USING (group_id)),
l AS (SELECT *, max(sim) OVER (PARTITION BY group_id, i) AS m FROM s),
l2 AS (SELECT *, m + ln(sum(exp(sim - m)) OVER (PARTITION BY group_id, i)) AS lse FROM l)
SELECT group_id, round(-sum(coalesce(weight, 0.0) * (sim - lse)) / (sum(coalesce(weight, 0.0)) + 1e-8), 9)
       AS contrastive
FROM l2 LEFT JOIN jw USING (group_id, i, j)
GROUP BY group_id
""")
def contrastive_loss(spark, sf):
    g = group_feats(spark, sf)
    w = ranking.jaccard_topk(g, "group_id", "pos", "feat", k=5)
    c = ranking.contrastive(g, w, "group_id", "pos", "vec", tau=0.07)
    return c.select("group_id", F.round("contrastive", 9).alias("contrastive"))
