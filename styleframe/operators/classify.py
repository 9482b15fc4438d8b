"""Label spaces, metrics, parameter sweeps and reports.

Metrics are aggregates over (by..., true, pred) counts — one shuffle of small
partial counts however many rows there are.  Sweeps read each row once: a row's
predictions for all weights, or the threshold from which it is unknown, are
counted directly; no grid is joined to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from styleframe.functions import vectors as V
from styleframe.operators.hierarchy import prefix_offsets
from styleframe.session import checkpoint

C = F.col
UNK_LABEL = "<UNK>"


def _cols(c) -> list[str]:
    return [] if c is None else ([c] if isinstance(c, str) else list(c))


def label_map(df: DataFrame, tags: str = "tags", multi: bool = False) -> DataFrame:
    """Sorted distinct labels (first tag, or every tag when ``multi``) -> dense idx.

    Ranks come from a distributed prefix sum over the distinct labels."""
    lab = F.explode(tags) if multi else F.element_at(C(tags), 1)
    d = df.select(lab.alias("label")).filter(C("label").isNotNull()).distinct()
    return prefix_offsets(d.withColumn("_one", F.lit(1)), ["label"], "_one", out="idx").select("label", C("idx").cast("int").alias("idx"))


def encode_labels(df: DataFrame, labels: DataFrame, tags: str = "tags", multi: bool = False,
                  out: str = "y") -> DataFrame:
    """Single label: first tag -> idx; unseen or '<UNK>' -> K (= number of
    classes).  Multi-label: 0/1 per known class in idx order, unknown ignored."""
    if not multi:
        k = labels.agg(F.count(F.lit(1)).cast("int").alias("_k"))
        j = (df.withColumn("_t", F.element_at(C(tags), 1))
             .join(labels.select(C("label").alias("_t"), C("idx").alias("_i")), "_t", "left")
             .crossJoin(F.broadcast(k)))
        y = F.when(C("_t") == UNK_LABEL, C("_k")).otherwise(F.coalesce(C("_i"), C("_k")))
        return j.withColumn(out, y).drop("_t", "_i", "_k")
    classes = labels.agg(F.array_sort(F.collect_list(F.struct("idx", "label"))).alias("_cl"))
    j = df.crossJoin(F.broadcast(classes))  # one row, one entry per class
    y = F.transform(C("_cl"), lambda c: F.when(F.array_contains(C(tags), c["label"]), F.lit(1.0))
                    .otherwise(F.lit(0.0)))
    return j.withColumn(out, y).drop("_cl")


def class_counts(df: DataFrame, true: str, pred: str, by=None,
                 labels: Sequence[int] | None = None) -> DataFrame:
    """(by..., label, tp, n_true, n_pred) over the label set: the given labels,
    else every label seen in truth or prediction within the group.

    The rows are read once, into counts per (by..., true, pred); all else comes from that table."""
    by = _cols(by)
    pairs = df.groupBy(*by, C(true).alias("_t"), C(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    return counts_of_pairs(pairs, by, labels, df.schema[true].dataType)


def counts_of_pairs(pairs: DataFrame, by: Sequence[str], labels: Sequence[int] | None = None, kind=None) -> DataFrame:
    """``class_counts`` from (by..., _t, _p, _n)."""
    kind = kind or pairs.schema["_t"].dataType

    def entry(label, true, pred, hit):
        return F.struct(label.cast(kind).alias("label"), *[x.cast("bigint").alias(n) for n, x in (("tp", hit), ("n_true", true), ("n_pred", pred))])

    none = F.lit(0)
    entries = F.array(entry(C("_t"), C("_n"), none, F.when(C("_t") == C("_p"), C("_n")).otherwise(0)),
                      entry(C("_p"), none, C("_n"), none))
    if labels is not None:
        entries = F.concat(entries, F.array(*[entry(F.lit(int(x)), none, none, none) for x in labels]))
    rows = pairs.select(*by, F.explode(entries).alias("_e")).select(*by, "_e.*")
    if labels is not None:
        if not by:
            zero = pairs.sparkSession.createDataFrame([(int(x), 0, 0, 0) for x in labels], "label int, tp bigint, n_true bigint, n_pred bigint")
            rows = rows.unionByName(zero.withColumn("label", C("label").cast(kind)))
        rows = rows.filter(C("label").isin(*[int(x) for x in labels]))
    return rows.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "n_true", "n_pred")])


def prf(counts: DataFrame) -> DataFrame:
    """precision / recall / f1 / support per label; zero division -> 0."""
    p = F.when(C("n_pred") > 0, C("tp") / C("n_pred")).otherwise(F.lit(0.0))
    r = F.when(C("n_true") > 0, C("tp") / C("n_true")).otherwise(F.lit(0.0))
    return (counts.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", F.when(C("precision") + C("recall") > 0,
                                     2 * C("precision") * C("recall") / (C("precision") + C("recall")))
                        .otherwise(F.lit(0.0)))
            .withColumn("support", C("n_true")))


def class_report(df: DataFrame, true: str, pred: str, by=None, labels=None) -> DataFrame:
    return prf(class_counts(df, true, pred, by, labels))


def macro_f1(df: DataFrame, true: str, pred: str, by=None, labels=None) -> DataFrame:
    by = _cols(by)
    rep = class_report(df, true, pred, by, labels)
    return rep.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def exact_match(df: DataFrame, true: str, pred: str) -> Column:
    return F.avg((C(true) == C(pred)).cast("double"))


def multilabel_scores(df: DataFrame, true: str, pred: str, by=None) -> DataFrame:
    """macro F1 over classes, micro F1, exact match for 0/1 arrays (per ``by``)."""
    by = _cols(by)
    ex = df.select(*by, F.posexplode(F.arrays_zip(C(true).alias("t"), C(pred).alias("p")))
                   .alias("k", "z"))
    per = ex.groupBy(*by, "k").agg(
        F.sum(F.when((C("z.t") == 1) & (C("z.p") == 1), 1).otherwise(0)).alias("tp"),
        F.sum(C("z.t")).alias("n_true"), F.sum(C("z.p")).alias("n_pred"))
    rep = prf(per)
    macro = rep.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.sum("tp").alias("_tp"),
                                 F.sum("n_true").alias("_nt"), F.sum("n_pred").alias("_np"))
    micro = F.when(C("_nt") + C("_np") > 0, 2 * C("_tp") / (C("_nt") + C("_np"))).otherwise(F.lit(0.0))
    em = df.groupBy(*by).agg(F.avg((C(true) == C(pred)).cast("double")).alias("exact_match"))
    out = macro.select(*by, "macro_f1", micro.alias("micro_f1"))
    return out.join(em, by) if by else out.crossJoin(em)


def grid(spark, n: int, lo: float = 0.0, hi: float = 1.0, name: str = "t") -> DataFrame:
    """n+1 evenly spaced values lo..hi built as lo + k*(hi-lo)/n (exact at the ends)."""
    return spark.range(n + 1).select(
        C("id").cast("int").alias("_k"),
        (F.lit(lo) + C("id") * F.lit(hi - lo) / F.lit(n)).alias(name))


def best_param(scores: DataFrame, param: str, metric: str, default: float) -> DataFrame:
    """Smallest parameter with the highest metric (strictly above 0), else default.
    Metrics are compared after rounding to 12 digits so float noise cannot flip it."""
    r = scores.withColumn("_m", F.round(metric, 12))
    mx = r.agg(F.max("_m").alias("_mx"))
    best = r.crossJoin(mx).filter((C("_m") == C("_mx")) & (C("_mx") > 0)) \
        .agg(F.min(param).alias("_b"))
    return best.select(F.coalesce(C("_b"), F.lit(default)).alias("best_" + param))


def blend(pa: str, pb: str, w: Column) -> Column:
    return F.zip_with(C(pa), C(pb), lambda x, y: w * x + (F.lit(1.0) - w) * y)


def tune_blend(df: DataFrame, pa: str, pb: str, true: str, steps: int = 20,
               multi: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sweep w in k/steps: macro F1 of argmax(w*pa + (1-w)*pb) (or >= .5 per
    label when ``multi``).  Returns (per-w scores, best-w row; default .5).

    Each row is read once: it yields its prediction for every weight (a number
    or a 0/1 array), which is counted at once by (weight, true, prediction)."""
    def predicted(p):
        return F.transform(p, lambda v: F.when(v >= 0.5, 1.0).otherwise(0.0)) if multi else V.argmax(p)

    ks = F.sequence(F.lit(0), F.lit(steps))
    each = F.transform(ks, lambda k: F.struct(k.alias("_k"), V.bind(blend(pa, pb, k / F.lit(steps)), predicted).alias("_pred")))
    x = df.select(C(true).alias("_true"), F.explode(each).alias("_x")).select("_true", "_x._k", "_x._pred")
    if multi:
        sc = multilabel_scores(x, "_true", "_pred", by=["_k"]).select("_k", "macro_f1")
    else:
        sc = macro_f1(x, "_true", "_pred", by=["_k"])
    sc = sc.select("_k", (C("_k") / F.lit(steps)).alias("w"), "macro_f1")
    return sc, best_param(sc, "w", "macro_f1", 0.5)


def apply_unknown(p: Column, t, k: int) -> Column:
    """argmax, or class k when the top probability is below t (strict)."""
    tt = t if isinstance(t, Column) else F.lit(t)
    return F.when(F.array_max(p) < tt, F.lit(k)).otherwise(V.argmax(p))


def tune_unknown(df: DataFrame, proba: str, true: str, k: int, steps: int = 100,
                 lo: float = 0.0, hi: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Sweep thresholds; macro F1 over all k+1 labels (unknown included, absent
    labels score 0).  Returns (per-threshold scores, best-t row; default 0).

    A row is unknown from the first threshold above its top probability on, so
    rows are counted once by (true, argmax, that threshold's number), and the
    counts of every threshold are running sums over (k+1) x (steps+2) numbers."""
    spark = df.sparkSession

    def at(i):
        return F.lit(lo) + i * F.lit(hi - lo) / F.lit(steps)

    guess = F.floor((C("_m") - F.lit(lo)) * F.lit(steps) / F.lit(hi - lo)).cast("int")
    near = F.sequence(F.greatest(guess - 1, F.lit(0)), F.greatest(guess + 2, F.lit(0)))
    first = F.least(F.coalesce(F.array_min(F.filter(near, lambda i: C("_m") < at(i))), F.lit(steps + 1)), F.lit(steps + 1))
    rows = df.select(C(true).cast("int").alias("_y"), V.argmax(proba).alias("_a"), F.array_max(proba).alias("_m"))
    counts = rows.groupBy("_y", "_a", first.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))

    def entry(label):
        return F.struct(label.alias("label"), C("_n").alias("n"), F.when(C("_y") == label, C("_n")).otherwise(0).alias("hit"))

    hist = (counts.select("_k", F.explode(F.array(entry(C("_a")), entry(F.lit(k)))).alias("_e"))
            .groupBy(C("_e.label").alias("label"), "_k").agg(F.sum("_e.n").alias("n"), F.sum("_e.hit").alias("hit")))
    truth = counts.groupBy(C("_y").alias("label")).agg(F.sum("_n").alias("n_true"))
    cells = spark.range((k + 1) * (steps + 2)).select((C("id") % (k + 1)).cast("int").alias("label"), F.floor(C("id") / (k + 1)).cast("int").alias("_k"))
    cells = cells.join(hist, ["label", "_k"], "left").join(truth, "label", "left").na.fill(0, ["n", "hit", "n_true"])
    upto = Window.partitionBy("label").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("label").orderBy("_k").rowsBetween(1, Window.unboundedFollowing)

    def counted(c):  # unknown: rows up to the threshold; other labels: rows still above it
        return F.when(C("label") == k, F.sum(c).over(upto)).otherwise(F.coalesce(F.sum(c).over(after), F.lit(0)))

    cells = cells.select("_k", "label", counted("hit").alias("tp"), "n_true", counted("n").alias("n_pred")).filter(C("_k") <= steps)
    sc = prf(cells).groupBy("_k").agg(F.avg("f1").alias("macro_f1")).select("_k", at(C("_k")).alias("t"), "macro_f1")
    return sc, best_param(sc, "t", "macro_f1", 0.0)


def best_run(history: DataFrame, run: Sequence[str], order: Sequence[str], metric: str,
             patience: int = 3, higher: bool = True, start: float = 0.0) -> DataFrame:
    """Best epoch and early-stop epoch per run over a metric-history table.

    An epoch improves when strictly better than every earlier one (and than
    ``start``); training stops at the first epoch that makes ``patience``
    misses in a row.

    Epochs are dealt by range of (run, order), so a run that holds a third of
    all rows is spread; each piece of a run is scanned by itself, and what the
    pieces before it hold (a count, a maximum, the last improvement) is added
    from a table of one row per piece."""
    run, order = list(run), list(order)
    n = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    piece = run + ["_pid"]
    m = C(metric) if higher else -C(metric)
    floor = F.lit(start if higher else -start)
    h = checkpoint(history.repartitionByRange(n, *run, *order).withColumn("_pid", F.spark_partition_id()).withColumn("_m", m))
    w = Window.partitionBy(*piece).orderBy(*order)
    before = Window.partitionBy(*run).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = h.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n"), F.max("_m").alias("_mx"))
    sizes = sizes.select(*piece, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.max("_mx").over(before).alias("_m0"))
    h = (h.withColumn("_i", F.row_number().over(w))
         .withColumn("_l", F.max("_m").over(w.rowsBetween(Window.unboundedPreceding, -1))).join(sizes, piece))
    h = checkpoint(h.withColumn("epoch", (C("_n0") + C("_i")).cast("int"))
                   .withColumn("_imp", C("_m") > F.greatest(C("_l"), C("_m0"), floor)).drop("_i", "_l", "_n0", "_m0", "_m"))
    won = F.when(C("_imp"), C("epoch"))
    last = h.groupBy(*piece).agg(F.max(won).alias("_w")).select(*piece, F.max("_w").over(before).alias("_w0"))
    h = h.withColumn("_w", F.max(won).over(w.rowsBetween(Window.unboundedPreceding, 0))).join(last, piece)
    h = h.withColumn("_miss", C("epoch") - F.coalesce(F.greatest("_w", "_w0"), F.lit(0)))
    stop = h.filter(C("_miss") >= patience).groupBy(*run).agg(F.min("epoch").alias("stop_epoch"))
    h2 = h.join(stop, run, "left").filter(C("stop_epoch").isNull() | (C("epoch") <= C("stop_epoch")))
    best = h2.filter("_imp").groupBy(*run).agg(F.max_by("epoch", "epoch").alias("best_epoch"),
                                               F.max_by(metric, "epoch").alias("best_value"))
    n = h2.groupBy(*run).agg(F.count(F.lit(1)).alias("n_epochs"))
    return n.join(best, run, "left").join(stop, run, "left")


def prediction_report(df: DataFrame, key: str, true: str, pred: str, proba: str,
                      labels: DataFrame, digits: int = 4) -> DataFrame:
    """Long per-sample report: (key, true_label, pred_label, class, p rounded)."""
    names = labels.select(C("idx").alias("_i"), C("label").alias("_n"))
    unk = F.lit(UNK_LABEL)
    b = names
    out = (df.select(key, true, pred, F.posexplode(proba).alias("_c", "_p"))
           .join(b.select(C("_i").alias(true), C("_n").alias("true_label")), true, "left")
           .join(b.select(C("_i").alias(pred), C("_n").alias("pred_label")), pred, "left")
           .join(b.select(C("_i").alias("_c"), C("_n").alias("class")), "_c", "left"))
    return out.select(key, F.coalesce("true_label", unk).alias("true_label"),
                      F.coalesce("pred_label", unk).alias("pred_label"), "class",
                      F.round("_p", digits).alias("p"))
