"""Dialect -> user -> comment -> sentence hierarchy: flat entries, a dense
global sentence index and the three half-open spans each sentence lives in.

The global index is an exclusive prefix sum over comments in
(dialect, user, comment) order.  It is computed without a one-partition
window: comments are range-partitioned (sampled bounds split even a hot user
across tasks), each task computes local running sums in Arrow batches, and the
per-partition totals (one row per partition — a proven bound) become offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from styleframe.session import checkpoint


def flatten_entries(sent: DataFrame, dialect: str = "lang", user: str = "source",
                    idx: str = "sent_idx", text: str = "sentence") -> DataFrame:
    """(sentence, tags=[dialect, user or 'unknown', 'line_<idx>']) + ids/feature when present."""
    tags = F.array(F.col(dialect), F.coalesce(F.col(user), F.lit("unknown")),
                   F.concat(F.lit("line_"), F.col(idx).cast("string")))
    keep = [c for c in ("input_ids", "feature") if c in sent.columns]
    return sent.select(F.col(text).alias("sentence"), tags.alias("tags"), *keep)


def prefix_offsets(df: DataFrame, order: Sequence[str], weight: str, out: str = "start",
                   partitions: int | None = None) -> DataFrame:
    """Exclusive running sum of ``weight`` in ``order`` (keys must be unique).

    Distributed: range partitioning + per-task cumulative sums + a tiny table
    of per-partition totals.  No task holds more than its range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = list(order)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = T.StructType(ranged.schema.fields + [
        T.StructField("_pid", T.IntegerType()), T.StructField("_local", T.LongType())])

    def local_sums(it):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        carry = 0
        for pdf in it:
            w = pdf[weight].to_numpy(dtype=np.int64)
            cs = np.cumsum(w) - w + carry
            carry += int(w.sum())
            pdf = pdf.assign(_pid=np.int32(pid), _local=cs.astype(np.int64))
            yield pdf

    # The local sums are read twice (totals and the join back); a reliable
    # checkpoint pins one partitioning for both reads and cuts the lineage.
    local = checkpoint(ranged.mapInPandas(local_sums, schema))
    totals = local.groupBy("_pid").agg(F.sum(weight).alias("_tot"))
    # one row per partition: a global window over it is bounded by `n`
    offs = totals.withColumn("_off", F.coalesce(
        F.sum("_tot").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).cast("bigint")).select("_pid", "_off")
    return (local.join(F.broadcast(offs), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint"))
            .drop("_pid", "_local", "_off"))


def line_numbers(df: DataFrame, group: Sequence[str], order: Sequence[str],
                 out: str = "line_no") -> DataFrame:
    """0-based position of each row inside its group in ``order`` (keys unique; rows equal in
    group and order share a position).

    Only the keys are numbered: distributed prefix sum over the distinct (group, order), minus
    the group's first offset, joined back on the keys.  No text enters the range shuffle, the
    checkpoint or Python, and a group holding a third of the rows is still spread over many
    tasks, unlike ``row_number() over (partition by group)``."""
    keys = list(dict.fromkeys([*group, *order]))
    short = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct().withColumn("_one", F.lit(1))
    names = short.columns[:-1]
    g = prefix_offsets(short, names, "_one", out="_goff").drop("_one")
    heads = names[:len(group)]
    first = g.groupBy(*heads).agg(F.min("_goff").alias("_first")).select(*[F.col(h).alias(f"_g{h}") for h in heads], "_first")
    same = F.lit(True)
    for h in heads:
        same = same & F.col(h).eqNullSafe(F.col(f"_g{h}"))
    at = g.join(first, same).select(*names, (F.col("_goff") - F.col("_first")).cast("bigint").alias(out))
    match = F.lit(True)
    for k, n in zip(keys, names):
        match = match & df[k].eqNullSafe(at[n])
    return df.join(at, match).drop(*names)


def comment_spans(comments: DataFrame, dialect: str = "lang", user: str = "source",
                  comment: str = "doc_id", n: str = "n") -> DataFrame:
    """[start, end) of the comment, user and dialect for each comment of ``n`` sentences, in the
    order dialect, user, comment; sentence ``p`` of a comment has index comment_start + p.

    Works on one short row per comment: no sentence is exploded, counted or joined."""
    keys = [dialect, user, comment]
    cs = prefix_offsets(comments.select(*keys, F.col(n).cast("bigint").alias(n)), keys, n, out="comment_start") \
        .withColumn("comment_end", F.col("comment_start") + F.col(n))
    users = cs.groupBy(dialect, user).agg(F.min("comment_start").alias("user_start"),
                                          F.max("comment_end").alias("user_end"))
    dialects = users.groupBy(dialect).agg(F.min("user_start").alias("dialect_start"),
                                          F.max("user_end").alias("dialect_end"))
    return cs.join(users.join(dialects, dialect), [dialect, user])


def with_spans(sent: DataFrame, dialect: str = "lang", user: str = "source",
               comment: str = "doc_id", pos: str = "sent_idx") -> DataFrame:
    """Add idx and [start, end) of the comment, user and dialect to rows that already are sentences
    (positions dense 0..n-1 inside a comment, as ``explode_sentences`` produces).  From comments,
    ``comment_spans`` and an explode are cheaper."""
    keys = [dialect, user, comment]
    per_comment = sent.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))  # partial agg
    spans = comment_spans(per_comment, dialect, user, comment).drop("n")
    return (sent.join(spans, keys)
            .withColumn("idx", (F.col("comment_start") + F.col(pos)).cast("bigint")))


SPAN_COLS = ("comment_start", "comment_end", "user_start", "user_end",
             "dialect_start", "dialect_end")


def nest(sent: DataFrame, dialect: str = "lang", user: str = "source",
         comment: str = "doc_id", pos: str = "sent_idx",
         fields: Sequence[str] = ("sentence",)) -> DataFrame:
    """Nested export shape, one row per comment: (dialect, user, comment,
    sentences array<struct> in position order).

    Nesting stops at the comment: a row is bounded by one comment, never by a
    user or a dialect (a hot user would otherwise become one giant row)."""
    sents = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("_p"),
                                                 *[F.col(f) for f in fields])))
    strip = F.transform("_s", lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    return (sent.groupBy(dialect, user, comment).agg(sents.alias("_s"))
            .select(dialect, user, comment, strip.alias("sentences")))


__all__ = ["flatten_entries", "prefix_offsets", "comment_spans", "with_spans", "nest", "SPAN_COLS"]
