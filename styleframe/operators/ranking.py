"""Graded-group scoring and ranking metrics.

All-pairs work happens only inside an equi key (a group of 16 or 4, or a
batch), so it is bounded by the group size squared and never crosses groups.
Windows are partitioned by (group, anchor): at most one group per window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from styleframe.functions import vectors as V

C = F.col


def bit_length(x: Column) -> Column:
    """Number of bits needed for a small non-negative int (0 -> 0)."""
    return (F.when(x == 0, 0).when(x == 1, 1).when(x < 4, 2).when(x < 8, 3)
            .when(x < 16, 4).otherwise(F.floor(F.log2(x)) + 1)).cast("int")


def score_groups(items: DataFrame, group: str = "group_id", pos: str = "pos",
                 vec: str = "vec", size: int = 16) -> DataFrame:
    """Every item is anchor once: (group, anchor, item, score, grade).

    score = dot(anchor, item); grade = log2(size) - bit_length(anchor XOR item),
    i.e. the anchor 4 (2 for size 4), its cluster partner 3, and so on."""
    a = items.select(C(group), C(pos).alias("anchor"), C(vec).alias("_va"))
    b = items.select(C(group), C(pos).alias("item"), C(vec).alias("_vb"))
    top = int(math.log2(size))
    return (a.join(b, group)
            .select(group, "anchor", "item", V.dot("_va", "_vb").alias("score"),
                    (F.lit(top) - bit_length(C("anchor").bitwiseXOR(C("item")))).alias("grade")))


def _disc_sum(lo: Column, n: Column, k: int | None) -> Column:
    """sum of 1/log2(p+2) for p in [lo, lo+n), zero at p >= k."""
    def term(p):
        d = F.lit(1.0) / F.log2(p + F.lit(2))
        return d if k is None else F.when(p < k, d).otherwise(F.lit(0.0))
    return F.aggregate(F.sequence(lo, lo + n - 1), F.lit(0.0), lambda acc, p: acc + term(p))


def ndcg(scores: DataFrame, query: Sequence[str], k: int | None = None,
         item: str = "item", score: str = "score", grade: str = "grade") -> DataFrame:
    """Per-query NDCG with linear gain and log2 discount; tied scores share
    the average gain of their tie group (so the order inside a tie does not
    matter).  A query whose ideal DCG is 0 scores 0."""
    q = list(query)
    by_score = Window.partitionBy(*q).orderBy(C(score).desc())
    tie = Window.partitionBy(*q, score)
    d = (scores.withColumn("_start", F.rank().over(by_score) - 1)
         .withColumn("_size", F.count(F.lit(1)).over(tie))
         .withColumn("_avg", F.avg(grade).over(tie)))
    d = d.withColumn("_dcg", C("_avg") * _disc_sum(C("_start"), C("_size"), k) / C("_size"))
    ideal_w = Window.partitionBy(*q).orderBy(C(grade).desc(), C(item))
    d = d.withColumn("_ip", F.row_number().over(ideal_w) - 1)
    d = d.withColumn("_idcg", C(grade) * _disc_sum(C("_ip"), F.lit(1), k))
    agg = d.groupBy(*q).agg(F.sum("_dcg").alias("_dcg"), F.sum("_idcg").alias("_idcg"))
    return agg.select(*q, F.when(C("_idcg") > 0, C("_dcg") / C("_idcg"))
                      .otherwise(F.lit(0.0)).alias("ndcg"))


def mrr(scores: DataFrame, query: Sequence[str], item: str = "item", score: str = "score",
        grade: str = "grade", compat: bool = False) -> DataFrame:
    """Reciprocal rank per query.

    Default: 1 / rank (by score, ties by item) of the first relevant item.
    ``compat``: 1 / position, in grade order, of the best-scoring relevant
    item among the relevant ones (a non-standard variant)."""
    q = list(query)
    rel = C(grade) > 0
    if not compat:
        w = Window.partitionBy(*q).orderBy(C(score).desc(), C(item))
        r = scores.withColumn("_r", F.row_number().over(w))
        return r.groupBy(*q).agg(F.min(F.when(rel, C("_r"))).alias("_best")) \
            .select(*q, F.coalesce(F.lit(1.0) / C("_best"), F.lit(0.0)).alias("rr"))
    rs = scores.filter(rel)
    w = Window.partitionBy(*q).orderBy(C(grade).desc(), C(item))
    rs = rs.withColumn("_p", F.row_number().over(w))
    best = rs.groupBy(*q).agg(F.max_by("_p", F.struct(C(score), -C("_p"))).alias("_bp"))
    return best.select(*q, (F.lit(1.0) / C("_bp")).alias("rr"))


def margin_loss(scores: DataFrame, query: Sequence[str], item: str = "item",
                score: str = "score", grade: str = "grade", margin: float = 0.5) -> DataFrame:
    """Per query: mean over ordered item pairs with unequal grades of
    max(0, margin - sign(g_i - g_j) * (s_i - s_j)).  Pairs are formed inside
    the query (equi-join on the query key, bounded by its size squared)."""
    q = list(query)
    a = scores.select(*q, C(score).alias("_si"), C(grade).alias("_gi"))
    b = scores.select(*q, C(score).alias("_sj"), C(grade).alias("_gj"))
    p = a.join(b, q).filter(C("_gi") != C("_gj"))
    sgn = F.signum(C("_gi") - C("_gj"))
    loss = F.greatest(F.lit(0.0), F.lit(margin) - sgn * (C("_si") - C("_sj")))
    return p.groupBy(*q).agg(F.avg(loss).alias("margin_loss"))


def query_metrics(scores: DataFrame, query: Sequence[str], anchor: str = "anchor", item: str = "item",
                  score: str = "score", grade: str = "grade", ks: Sequence[int | None] = (None,),
                  margin: float = 0.5) -> DataFrame:
    """(query..., anchor, ndcg per k, rr, rr_compat, margin_loss) of every anchor, in one pass.

    The rank, tie and ideal-position columns are shared by all metrics, and all windows and the
    aggregate are over one (query, anchor), so the rows move once.  The anchor's own row counts
    for the margin loss only; an anchor without relevant items has reciprocal ranks 0."""
    q = [*query, anchor]
    own = C(item) == C(anchor)
    w = Window.partitionBy(*q, "_own")
    s = scores.withColumn("_own", own)
    by_score = w.orderBy(C(score).desc())
    tie = Window.partitionBy(*q, "_own", score)
    s = (s.withColumn("_start", F.rank().over(by_score) - 1).withColumn("_size", F.count(F.lit(1)).over(tie))
         .withColumn("_avg", F.avg(grade).over(tie))
         .withColumn("_r", F.row_number().over(w.orderBy(C(score).desc(), C(item))))
         .withColumn("_ip", F.row_number().over(w.orderBy(C(grade).desc(), C(item))) - 1))
    rel = ~C("_own") & (C(grade) > 0)
    aggs = []
    for k in ks:
        gain = C("_avg") * _disc_sum(C("_start"), C("_size"), k) / C("_size")
        ideal = C(grade) * _disc_sum(C("_ip"), F.lit(1), k)
        aggs += [F.sum(F.when(~C("_own"), gain)).alias(f"_d{k or ''}"), F.sum(F.when(~C("_own"), ideal)).alias(f"_i{k or ''}")]
    g = s.groupBy(*q).agg(
        *aggs, F.min(F.when(rel, C("_r"))).alias("_first"),
        F.max(F.when(rel, F.struct(C(score).alias("s"), (-C("_ip")).alias("p")))).alias("_best"),
        F.collect_list(F.struct(C(score).alias("s"), C(grade).cast("int").alias("g"))).alias("_l"),
        F.count_if(~C("_own")).alias("_n")).filter(C("_n") > 0)
    pairs = F.flatten(F.transform("_l", lambda x: F.transform(F.filter("_l", lambda y: y["g"] != x["g"]), lambda y: F.greatest(
        F.lit(0.0), F.lit(margin) - F.signum(x["g"] - y["g"]) * (x["s"] - y["s"])))))
    mean = V.bind(pairs, lambda p: F.when(F.size(p) > 0, V.vsum(p) / F.size(p)))
    cols = [F.when(C(f"_i{k or ''}") > 0, C(f"_d{k or ''}") / C(f"_i{k or ''}")).otherwise(F.lit(0.0)).alias(f"ndcg_{k}" if k else "ndcg") for k in ks]
    return g.select(*q, *cols, F.coalesce(F.lit(1.0) / C("_first"), F.lit(0.0)).alias("rr"),
                    F.coalesce(F.lit(1.0) / (1 - C("_best.p")), F.lit(0.0)).alias("rr_compat"), mean.alias("margin_loss"))


def jaccard_topk(feats: DataFrame, batch: str, key: str, feature: str, k: int = 5) -> DataFrame:
    """Pair weights inside a batch: inter / (|a| + |b| - inter + 1e-8), self 0;
    per row keep every weight >= the k-th largest of the row (ties kept;
    k = min(k, n - 1); k <= 0 keeps all).  Returns (batch, i, j, weight)."""
    a = feats.select(C(batch), C(key).alias("i"), C(feature).alias("_fa"))
    b = feats.select(C(batch), C(key).alias("j"), C(feature).alias("_fb"))
    inter = V.dot("_fa", "_fb")
    union = V.vsum("_fa") + V.vsum("_fb") - inter + F.lit(1e-8)
    p = (a.join(b, batch)
         .withColumn("w", F.when(C("i") == C("j"), F.lit(0.0)).otherwise(inter / union))
         .select(batch, "i", "j", "w"))
    if k <= 0:
        return p.withColumnRenamed("w", "weight")
    n = Window.partitionBy(batch, "i")
    kk = F.least(F.lit(k), F.count(F.lit(1)).over(n) - 1)
    ordered = Window.partitionBy(batch, "i").orderBy(C("w").desc())
    p = p.withColumn("_rn", F.row_number().over(ordered)).withColumn("_k", kk)
    kth = p.filter(C("_rn") == C("_k")).select(batch, "i", C("w").alias("_kth"))
    return (p.join(kth, [batch, "i"], "left")
            .select(batch, "i", "j", F.when(C("w") >= F.coalesce(C("_kth"), F.lit(0.0)), C("w"))
                    .otherwise(F.lit(0.0)).alias("weight")))


def contrastive(vecs: DataFrame, weights: DataFrame, batch: str, key: str, vec: str,
                tau: float = 0.07) -> DataFrame:
    """Supervised contrastive loss per batch with weighted positives:
    -sum w * (sim/tau - logsumexp_row) / (sum w + 1e-8); self is in the
    denominator.  The log-sum-exp is the two-step max + sum(exp) form."""
    a = vecs.select(C(batch), C(key).alias("i"), C(vec).alias("_va"))
    b = vecs.select(C(batch), C(key).alias("j"), C(vec).alias("_vb"))
    s = a.join(b, batch).select(batch, "i", "j", (V.dot("_va", "_vb") / F.lit(tau)).alias("sim"))
    row = Window.partitionBy(batch, "i")
    s = s.withColumn("_m", F.max("sim").over(row))
    s = s.withColumn("_lse", C("_m") + F.log(F.sum(F.exp(C("sim") - C("_m"))).over(row)))
    j = s.join(weights.select(batch, "i", "j", "weight"), [batch, "i", "j"], "left")
    w = F.coalesce(C("weight"), F.lit(0.0))
    return j.groupBy(batch).agg(
        (-F.sum(w * (C("sim") - C("_lse"))) / (F.sum(w) + F.lit(1e-8))).alias("contrastive"))
