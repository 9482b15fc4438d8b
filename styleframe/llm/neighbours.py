"""Approximate nearest neighbours by a forest of random-projection trees (operator 3).

A tree cuts its vectors at the median along the line between two of them, down
to leaves of about ``LEAF``.  A query walks all trees through one shared priority
queue: the branch with the smallest margin so far is next, until it has made the
forest's number of visits.  That number is measured, at every size in the same
way: ``PROBES`` vectors of the fitted sample are searched among the others, and it
is the fewest visits in which the share ``RECALL`` of their true neighbours is met.
So vectors in clusters take a few leaves, and vectors without structure, where no
cut tells much, more than half of all.  Every vector in a visited leaf is a
candidate, and candidates are ranked by their exact Euclidean distance in double
precision.

Scale: equal vectors are one class, so a vector that holds a third of all rows
fills no leaf; a class keeps its k + 1 smallest ids, which is all that any query
can return of it.  The trees are fitted on at most ``SAMPLE`` classes (a bound),
sent to every task, and every class is routed to its leaves: beyond ``SAMPLE`` a leaf
holds more, so the visits meet more neighbours than was measured.  Vectors and
queries meet by an equi-join on (tree, leaf) in chunks of bounded size, and each
pair of chunks returns its k + 1 best per query, never all pairs.

Edge rows: vectors that are null, zero, or hold a null or non-finite number take
no part, nor do rows without an id or with other than the most frequent
dimension; a query is a (vec_id, vector) row, and an id with several vectors
is as near as its nearest one; repeated rows count once; fewer than k others
give fewer rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from styleframe.session import checkpoint

K = 10
TREES, LEAF, SAMPLE = 8, 128, 65_536
RECALL, PROBES = 0.95, 100
#: vectors and queries of a leaf that meet in one piece of work
CHUNK, QUERY_CHUNK = 4096, 256


# -- trees -----------------------------------------------------------------------

def build_tree(x: np.ndarray, rng: np.random.RandomState, leaf: int = LEAF) -> tuple:
    """(directions, cuts, left, right): children >= 0 are nodes, children < 0 are leaves -1, -2, ...
    The first node is the root; a tree of one leaf has no node."""
    dirs, cuts, left, right = [], [], [], []
    leaves = 0
    work = [(np.arange(len(x)), None, 0)]
    while work:
        idx, parent, side = work.pop()
        split = None
        if len(idx) > leaf:
            for _ in range(3):
                a, b = x[rng.choice(idx, 2, replace=False)]
                d = (a - b) / max(np.linalg.norm(a - b), 1e-300)
                at = x[idx] @ d
                cut = np.median(at)
                low = at <= cut
                if low.any() and not low.all():
                    split = d, cut, low
                    break
        if split is None:
            leaves += 1
            child = -leaves
        else:
            child = len(dirs)
            dirs.append(split[0])
            cuts.append(split[1])
            left.append(0)
            right.append(0)
            work += [(idx[split[2]], child, 0), (idx[~split[2]], child, 1)]
        if parent is not None:
            (left if side == 0 else right)[parent] = child
    dim = x.shape[1]
    return (np.array(dirs).reshape(-1, dim), np.array(cuts, float), np.array(left, np.int64), np.array(right, np.int64), leaves)


def build_forest(x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> list[tuple]:
    rng = np.random.RandomState(seed)
    return [build_tree(x, rng, leaf) for _ in range(trees)]


def leaf_of(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Leaf number (from 0) of each vector."""
    dirs, cuts, left, right, _ = tree
    out = np.zeros(len(x), np.int64)
    work = [(0, np.arange(len(x)))] if len(dirs) else []
    while work:
        node, idx = work.pop()
        low = x[idx] @ dirs[node] <= cuts[node]
        for child, part in ((left[node], idx[low]), (right[node], idx[~low])):
            if child < 0:
                out[part] = -child - 1
            elif len(part):
                work.append((int(child), part))
    return out


def visited_leaves(forest: list[tuple], q: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """(tree, leaf) of the first ``visits`` leaves that one shared priority queue reaches."""
    margin = [(t[0] @ q - t[1]).tolist() for t in forest]
    sides = [(t[2].tolist(), t[3].tolist()) for t in forest]
    heap = [(0.0, i, 0 if margin[i] else -1) for i in range(len(forest))]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < visits:
        far, tree, node = heapq.heappop(heap)
        m, (left, right) = margin[tree], sides[tree]
        while node >= 0:
            s = m[node]
            near, other = (left[node], right[node]) if s <= 0 else (right[node], left[node])
            heapq.heappush(heap, (max(far, abs(s)), tree, other))
            node = near
        out.append((tree, -node - 1))
    return out


def visits_for(forest: list[tuple], x: np.ndarray, k: int = K, recall: float = RECALL, probes: int = PROBES, seed: int = 13) -> int:
    """The fewest visits in which ``probes`` of the vectors ``x`` together meet the share ``recall`` of their
    ``k`` nearest others in ``x``; all leaves for a recall of 1."""
    total = sum(t[4] for t in forest)
    if recall >= 1 or len(x) < 2:
        return total
    leaves = [leaf_of(t, x) for t in forest]
    first = []  # the visit that meets a true neighbour
    for i in np.random.RandomState(seed).permutation(len(x))[:probes]:
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[:min(k, len(x) - 1)]
        at = {place: n for n, place in enumerate(visited_leaves(forest, x[i], total), 1)}
        first += [min(at[tree, of[j]] for tree, of in enumerate(leaves)) for j in near]
    return int(np.sort(first)[int(np.ceil(recall * len(first))) - 1])


# -- tasks -------------------------------------------------------------------------

def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dim)


def _route_task(batches, forest, dim: int):
    forest = forest.value
    for b in batches:
        x = _matrix(b.column(1), dim)
        for i, tree in enumerate(forest):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), pa.array(leaf_of(tree, x).astype(np.int32)),
                                              b.column(0), b.column(1), b.column(2)], names=["tree", "leaf", "cid", "v", "c"])


def _visit_task(batches, forest, dim: int, visits: int):
    forest = forest.value
    for b in batches:
        x = _matrix(b.column(1), dim)
        for lo in range(0, len(x), 64):
            found = [visited_leaves(forest, q, visits) for q in x[lo:lo + 64]]
            row = np.repeat(np.arange(lo, lo + len(found)), [len(f) for f in found])
            flat = np.array([p for f in found for p in f], np.int32).reshape(-1, 2)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), b.column(0).take(take), b.column(1).take(take)],
                                             names=["tree", "leaf", "qid", "q"])


#: found rows that a task holds before it keeps only the best of each query
HOLD = 500_000


def _best(parts: list[tuple], keep: int) -> tuple:
    """The ``keep`` nearest classes of each query, by (distance, smallest id), each once."""
    q, cid, c, d = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((cid, c, d, q))
    q, cid, c, d = q[order], cid[order], c[order], d[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (cid[1:] != cid[:-1])]  # a class met in several trees has equal rows side by side
    q, cid, c, d = q[new], cid[new], c[new], d[new]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return tuple(x[rank < keep] for x in (q, cid, c, d))


def _rank_task(batches, dim: int, keep: int):
    """(qid, cid, c, d): of all pairs that this task meets, the best of each query."""
    parts, held = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _best(parts, keep)], names=["qid", "cid", "c", "d"])

    for b in batches:
        for queries, members in zip(b.column(0), b.column(1)):
            queries, members = queries.values, members.values
            qid, cid, c = (s.to_numpy(zero_copy_only=False) for s in (queries.field(0), members.field(0), members.field(2)))
            q, x = _matrix(queries.field(1), dim), _matrix(members.field(1), dim)
            for i in range(len(q)):
                d = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
                if len(d) > keep:
                    edge = np.partition(d, keep - 1)[keep - 1]
                    best = np.flatnonzero(d <= edge)
                    best = best[np.lexsort((c[best], d[best]))][:keep]
                else:
                    best = np.arange(len(d))
                parts.append((np.full(len(best), qid[i], np.int64), cid[best].astype(np.int64), c[best].astype(np.int64), d[best]))
                held += len(best)
            if held > HOLD:
                parts = [_best(parts, keep)]
                held = len(parts[0][0])
                if held > HOLD // 2:
                    yield out()
                    parts, held = [], 0
    if parts:
        yield out()


# -- on Spark ----------------------------------------------------------------------

def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Distinct (id, v) rows that take part, in the most frequent dimension."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v")).where("id is not null and v is not null")
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 0
    return rows.where(F.size("v") == dim).distinct(), dim


def nearest(vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K,
            trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest candidates of each row for which
    ``is_query`` (a function of the id column) holds, among all other ids; a ``recall`` of 1
    visits every leaf."""
    spark = vectors.sparkSession
    rows, dim = _usable(vectors, vec_id, embedding)
    rows = checkpoint(rows)
    # the k + 1 smallest ids of each class: a window limit that Spark applies before its shuffle
    number = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    ids = rows.withColumn("n", number).where(F.col("n") <= k + 1)
    classes = checkpoint(ids.groupBy("v").agg(F.min("id").alias("c"), F.sort_array(F.collect_list("id")).alias("ids")))
    # an id may have several vectors, so classes are named by their own number: the hash of the vector
    classes = classes.withColumn("cid", F.xxhash64("v"))
    asked = rows.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), F.xxhash64("v").alias("qid"), "v")
    picked = classes.select("v", "cid").orderBy("cid").limit(sample).toArrow()
    x = _matrix(picked.column("v").combine_chunks(), dim) if picked.num_rows else np.zeros((0, 1))
    forest = build_forest(x, trees, leaf) if len(x) else []
    visits = visits_for(forest, x, k, recall)
    sent = spark.sparkContext.broadcast(forest)
    kind = classes.schema["v"].dataType.simpleString()
    placed = classes.select("cid", "v", "c").mapInArrow(functools.partial(_route_task, forest=sent, dim=dim), f"tree int, leaf int, cid bigint, v {kind}, c bigint")
    walked = asked.select("qid", F.col("v").alias("q")).distinct().mapInArrow(
        functools.partial(_visit_task, forest=sent, dim=dim, visits=visits), f"tree int, leaf int, qid bigint, q {kind}")
    # chunks of a leaf: their number follows from its size
    counts = placed.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    counted = walked.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    members = _chunked(placed, counts, ("cid", "v", "c"), CHUNK, "members")
    queries = _chunked(walked, counted, ("qid", "q"), QUERY_CHUNK, "queries")
    # merge joins by hint: Spark takes an array for one element when it guesses a table's size for a broadcast
    met = queries.join(members.hint("merge"), ["tree", "leaf"]).select("queries", "members")
    near = met.mapInArrow(functools.partial(_rank_task, dim=dim, keep=k + 1), "qid bigint, cid bigint, c bigint, d double")
    # k + 1 nearest classes of a query vector hold its k nearest other ids
    best = F.row_number().over(Window.partitionBy("qid").orderBy("d", "c"))
    near = (near.distinct().withColumn("n", best).where(F.col("n") <= k + 1)
            .join(classes.select("cid", "ids").hint("merge"), "cid").select("qid", "d", F.explode("ids").alias("vec_id")))
    pairs = (asked.select("query_id", "qid").join(near, "qid").where("vec_id <> query_id")
             .groupBy("query_id", "vec_id").agg(F.min("d").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _chunked(rows: DataFrame, counts: DataFrame, fields: tuple[str, ...], size: int, name: str) -> DataFrame:
    part = F.pmod(F.xxhash64(fields[0]), F.ceil(F.col("n") / size)).cast("int")
    return (rows.join(counts, ["tree", "leaf"]).groupBy("tree", "leaf", part.alias("part"))
            .agg(F.collect_list(F.struct(*fields)).alias(name)).drop("part"))
