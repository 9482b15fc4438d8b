"""Keyed sampling: relation pickers over the span table, graded groups, batch
assignment, capped per-source sampling, ratio cap and holdout.

Every draw is ``keyed.uniform(seed, key...)``, so results are independent of
partitioning and retries.  Per-group top-k uses ``row_number() <= k`` (Spark
plans a partial top-k before the shuffle); cut-offs come from a digest histogram
(``first_of``) and the spans of a drawn index from a span index by blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from styleframe.functions import keyed
from styleframe.operators.hierarchy import SPAN_COLS, prefix_offsets
from styleframe.session import scratch_path

C = F.col


def _skip(lo: Column, hi: Column, skip_from: Column, skip_len: Column, u: Column) -> Column:
    """Uniform over [lo, hi) minus a block of ``skip_len`` starting at ``skip_from``:
    draw in [lo, hi - skip_len), then step over the block.  Null when empty."""
    n = hi - skip_len - lo
    new = lo + F.floor(u * n).cast("bigint")
    return F.when(n > 0, F.when(new >= skip_from, new + skip_len).otherwise(new))


def same_comment(u: Column, idx: str = "idx") -> Column:
    """Another sentence of the same comment (the comment minus itself)."""
    return _skip(C("comment_start"), C("comment_end"), C(idx), F.lit(1), u)


def same_author(u: Column) -> Column:
    """A sentence of another comment by the same user."""
    return _skip(C("user_start"), C("user_end"), C("comment_start"),
                 C("comment_end") - C("comment_start"), u)


def same_dialect(u: Column) -> Column:
    """A sentence by another user of the same dialect."""
    return _skip(C("dialect_start"), C("dialect_end"), C("user_start"),
                 C("user_end") - C("user_start"), u)


def other_dialect(u: Column, total: Column) -> Column:
    """A sentence of another dialect (the whole range minus this dialect)."""
    return _skip(F.lit(0), total, C("dialect_start"),
                 C("dialect_end") - C("dialect_start"), u)


RELATIONS = ("comment", "author", "dialect", "language")


def _total(spans: DataFrame) -> DataFrame:
    return spans.agg(F.max("dialect_end").alias("_total"))


def pick(spans: DataFrame, relation: str, seed: int = 42, step: int = 0,
         out: str = "picked") -> DataFrame:
    """Add one keyed pick per row for ``relation`` (see RELATIONS)."""
    u = keyed.uniform(seed, F.lit(relation), C("idx"), F.lit(step))
    if relation == "comment":
        return spans.withColumn(out, same_comment(u))
    if relation == "author":
        return spans.withColumn(out, same_author(u))
    if relation == "dialect":
        return spans.withColumn(out, same_dialect(u))
    if relation == "language":
        # a one-row scalar attached by a broadcast (size 1 by construction)
        return (spans.crossJoin(F.broadcast(_total(spans)))
                .withColumn(out, other_dialect(u, C("_total"))).drop("_total"))
    raise ValueError(relation)


def picks(spans: DataFrame, seed: int = 42, step: int = 0) -> DataFrame:
    """(idx, relation, picked): one keyed pick per row and relation, drawn in one pass over the rows."""
    total = spans.crossJoin(F.broadcast(_total(spans)))  # one-row scalar
    u = {r: keyed.uniform(seed, F.lit(r), C("idx"), F.lit(step)) for r in RELATIONS}
    drawn = {"comment": same_comment(u["comment"]), "author": same_author(u["author"]),
             "dialect": same_dialect(u["dialect"]), "language": other_dialect(u["language"], C("_total"))}
    rows = F.array(*[F.struct(F.lit(r).alias("relation"), drawn[r].alias("picked")) for r in RELATIONS])
    return total.select("idx", F.explode(rows).alias("_x")).select("idx", "_x.relation", "_x.picked")


def gather(df: DataFrame, spans: DataFrame, picked: str, cols: Sequence[str],
           prefix: str = "picked_") -> DataFrame:
    """The columns of the comment that a picked global index lies in (null for no pick), through the span index.

    ``cols`` are columns of comments, equal for all sentences of one."""
    index = span_index(spans, cols).select("block", "comment_start", "comment_end", *[C(c).alias(prefix + c) for c in cols])
    left = df.withColumn("_row", C(picked))
    return locate(left, index.withColumnsRenamed({"comment_start": "_from", "comment_end": "_to"}), picked, "_row", "_from", "_to") \
        .drop("_row", "_from", "_to")


# span index --------------------------------------------------------------------
#: sentences of one block: a comment stands in each block that it reaches into
SPAN_BLOCK = 16


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: read again at its real size, and a place to go on from."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def span_index(spans: DataFrame, cols: Sequence[str] = ()) -> DataFrame:
    """(block, spans of a comment, cols): the comments that reach into each block of ``SPAN_BLOCK`` indices.

    One row a comment and block instead of one a sentence; a block has at most ``SPAN_BLOCK`` comments.
    It is written once, so that Spark knows its size: under the broadcast bound it is broadcast, beyond
    it both sides are dealt by block."""
    one = spans.filter(C("idx") == C("comment_start")).select(*SPAN_COLS, *[c for c in cols if c not in SPAN_COLS])
    first, last = (F.floor(c / SPAN_BLOCK).cast("bigint") for c in (C("comment_start"), C("comment_end") - 1))
    return _written(one.withColumn("block", F.explode(F.sequence(first, last))), "span-index")


def locate(df: DataFrame, index: DataFrame, at: str, spread: str, start: str = "comment_start", end: str = "comment_end") -> DataFrame:
    """Add the index row of the comment that index ``at`` lies in: an equi-join on the block, then the
    bounds of at most ``SPAN_BLOCK`` comments.  A null ``at`` gets a block of its own from ``spread`` (an
    impossible draw), so such rows spread over all partitions and match nothing."""
    look = index.withColumnRenamed("block", "_in")
    left = df.withColumn("_at", F.coalesce(F.floor(C(at) / SPAN_BLOCK).cast("bigint"), -1 - F.coalesce(C(spread), F.lit(0))))
    return left.join(look, (C("_at") == C("_in")) & (C(at) >= C(start)) & (C(at) < C(end)), "left").drop("_at", "_in")


# graded groups ---------------------------------------------------------------
# --- fixed values: relevance grades by position in a group ------------------
GRADES_16 = (4, 3, 2, 2, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0)
GRADES_4 = (2, 1, 0, 0)
# -----------------------------------------------------------------------------

# the 16-item chain: (relation, source position).  Position p is drawn from the
# item at the source position with the given relation; "self" starts a cluster.
CHAIN_16 = (
    ("self", None), ("comment", 0), ("author", 1), ("comment", 2),
    ("dialect", 3), ("comment", 4), ("author", 5), ("comment", 6),
    ("language", 7), ("comment", 8), ("author", 9), ("comment", 10),
    ("dialect", 11), ("comment", 12), ("author", 13), ("comment", 14),
)
CHAIN_4 = (("self", None), ("dialect_any", 0), ("language", 0), ("dialect_any", 2))


def graded_groups(spans: DataFrame, seed: int = 42, mini: bool = False) -> DataFrame:
    """Every sentence anchors one group of 16 (or 4): (anchor, pos, item, grade).

    Each position is drawn from an earlier one by a relation (cluster = self,
    same comment, same author other comment, same comment; clusters chained by
    same dialect other user, other dialect, same dialect).  The spans of a drawn
    item are looked up in the span index only when the draw can leave the
    current comment (7 lookups for 16 items, 1 for 4).  What goes from one
    lookup to the next is (anchor, drawn index) alone: the items drawn so far
    are written as they are drawn (one table a lookup, in the shared folder),
    which is also where a job that lost executors goes on.
    The mini variant draws a same-dialect item with replacement (self allowed).
    """
    chain = CHAIN_4 if mini else CHAIN_16
    grades = F.array(*[F.lit(x) for x in (GRADES_4 if mini else GRADES_16)])
    index = span_index(spans)
    total = F.lit(index.agg(F.max("dialect_end")).first()[0]).cast("bigint")
    home = index.filter(C("block") == F.floor(C("comment_start") / SPAN_BLOCK))
    state = home.select(F.explode(F.sequence(C("comment_start"), C("comment_end") - 1)).alias("anchor"), *SPAN_COLS) \
        .withColumn("i0", C("anchor")).withColumn("idx", C("anchor"))
    drawn, parts, at = [0], [], 0  # positions in the state, finished parts, position whose spans the state holds
    for p, (rel, src) in enumerate(chain[1:], 1):
        if src != at:
            raise ValueError("chain must draw from the current item")
        u = keyed.uniform(seed, C("anchor"), F.lit(p))
        if rel == "dialect_any":          # leaf draw, state unchanged
            state = state.withColumn(f"i{p}", keyed.randint(
                seed, C("dialect_start"), C("dialect_end"), C("anchor"), F.lit(p)))
            drawn.append(p)
            continue
        if rel == "comment":              # stays in the comment: same spans
            state = state.withColumn(f"i{p}", same_comment(u)).withColumn("idx", C(f"i{p}"))
            drawn.append(p)
        else:
            new = same_author(u) if rel == "author" else \
                same_dialect(u) if rel == "dialect" else other_dialect(u, total)
            done = _written(state.select("anchor", *[f"i{q}" for q in drawn], new.alias("idx")), "graded-groups")
            parts.append((done, drawn))
            state = locate(done.select("anchor", "idx"), index, "idx", "anchor").withColumn(f"i{p}", C("idx"))
            drawn = [p]
        at = p
    parts.append((state, drawn))
    out = None
    for rows, at in parts:
        pairs = F.array(*[F.struct(F.lit(p).alias("pos"), C(f"i{p}").alias("item")) for p in at])
        rows = rows.select("anchor", F.explode(pairs).alias("_x")).select("anchor", "_x.pos", "_x.item")
        out = rows if out is None else out.unionAll(rows)
    return out.withColumn("grade", F.element_at(grades, C("pos") + 1))


# batching ----------------------------------------------------------------------
def to_batches(groups: DataFrame, order: Sequence[str], batch_size: int = 16,
               group_size: int = 16, drop_last: bool = False) -> DataFrame:
    """Consecutive groups (one row per group, in ``order``) -> batch ids.

    ``batch_size`` counts items; a batch holds batch_size // group_size groups.
    The incomplete last batch is kept unless ``drop_last``."""
    per = max(batch_size // group_size, 1)
    ranked = prefix_offsets(groups.withColumn("_one", F.lit(1)), order, "_one", out="_rank") \
        .drop("_one")
    out = ranked.withColumn("batch_id", F.floor(C("_rank") / per).cast("bigint"))
    if drop_last:
        full = out.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n")) \
            .filter(C("_n") >= per).select("batch_id")
        out = out.join(full, "batch_id", "left_semi")
    return out.drop("_rank")


# capped sampling ----------------------------------------------------------------
def cap_per_source(df: DataFrame, cap: int = 500, targets: Sequence[str] = (),
                   source: str = "source", dialect: str = "dialect",
                   key: Sequence[str] = ("text",), seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per source: target dialects first (keyed shuffle),
    then the others fill the rest.  ``row_number() <= cap`` is planned as a
    per-partition partial top-k, so a source with a third of all rows ships at
    most ``cap`` rows per map task to the final window."""
    is_t = F.col(dialect).isin(*targets) if targets else F.lit(False)
    w = Window.partitionBy(source).orderBy(is_t.desc(), keyed.order_key(seed, *key), *key)
    return df.withColumn("_rn", F.row_number().over(w)).filter(C("_rn") <= cap).drop("_rn")


#: hex digits by which a round of the selection narrows the cut-off: 4096 counts reach the driver
DIGITS = 3


def first_of(df: DataFrame, n: int, key: Sequence[str], seed: int = 42, out: str = "_first") -> DataFrame:
    """Add ``out``: whether the row is one of the first ``n`` in keyed-shuffle order, with no sort.

    Distributed selection by digest histogram: rows are counted by the first digits of their digest,
    and only the bucket that holds the ``n``-th row is refined, three digits a round (about log(rows)
    / log(4096) rounds, each over the key columns alone).  Rows with one and the same key are told
    apart, if the cut falls among them, by a distributed number; the others never move."""
    digest = keyed.order_key(seed, *key)
    keys = df.select(digest.alias("_d"))
    prefix, left = "", n
    while True:
        size = len(prefix) + DIGITS
        counts = keys.filter(F.substring("_d", 1, len(prefix)) == prefix) if prefix else keys
        counts = sorted((r[0], r[1]) for r in counts.groupBy(F.substring("_d", 1, size)).agg(F.count(F.lit(1))).collect())
        cut = None
        for value, c in counts:
            if c > left:
                cut = value, c
                break
            left -= c
        if cut is None:        # the bucket ends where the selection ends
            bound = (prefix + "~") if prefix else "~"
            return df.withColumn(out, digest < F.lit(bound))
        prefix = cut[0]
        if left == 0:
            return df.withColumn(out, digest < F.lit(prefix))
        if size >= 32:
            break
    tied = digest == F.lit(prefix)
    numbered = prefix_offsets(df.filter(tied).withColumn("_one", F.lit(1)), list(key), "_one", out="_rank").drop("_one")
    rest = df.filter(~tied | digest.isNull()).withColumn(out, digest < F.lit(prefix))
    return rest.unionByName(numbered.withColumn(out, C("_rank") < left).drop("_rank"))


def cap_rest(df: DataFrame, targets: Sequence[str], ratio: float = 0.2, floor: int = 100,
             dialect: str = "dialect", key: Sequence[str] = ("text",),
             seed: int = 42) -> DataFrame:
    """Keep all target rows; the others are capped at max(int(ratio * targets), floor)."""
    is_t = F.coalesce(F.col(dialect).isin(*targets), F.lit(False))
    n_t = df.agg(F.count_if(is_t)).first()[0]
    cap = max(math.floor(n_t * ratio), floor)
    others = first_of(df.filter(~is_t), cap, key, seed).filter("_first").drop("_first")
    return df.filter(is_t).unionByName(others)


def holdout(df: DataFrame, ratio: float = 0.02, key: Sequence[str] = ("text",),
            seed: int = 42) -> DataFrame:
    """Keyed shuffle, then the first int(n * (1 - ratio)) rows are train and
    the rest val: adds ``split``."""
    cut = math.floor(df.count() * (1.0 - ratio))
    return first_of(df, cut, key, seed).withColumn("split", F.when(C("_first"), "train").otherwise("val")).drop("_first")
