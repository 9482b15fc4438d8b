"""Exact top-k search by KD-trees per shard (operator 11).

Each component x becomes floor(1024 * x); a pair's score is the integer inner
product.  Vectors are dealt to shards of about ``SHARD`` rows by hash.  A shard's
tree splits at the median of its widest dimension down to leaves of ``LEAF``,
and every node keeps the tight box of its vectors.  The largest score that a box
allows is the sum over dimensions of max(q * low, q * high).  A query walks the
boxes from the best bound down and stops when the next bound is below its k-th
score.  Every query first searches its own shard; the k-th score found there goes
with it to all other shards, where whole shards may fall away by their root box.

Scale: trees are rows of a checkpointed table, one a shard, so a lost executor
rebuilds none but its own.  Queries travel in blocks of ``BLOCK`` to each shard,
an equi-join on (dimension, shard) of rows of bounded size; a shard returns at most k
rows a query, and a second rank over those gives the result.  Exact search by
inner product compares on vectors without structure almost all leaves, so the
work is queries times rows there; the bounds only save work on clustered data.

Edge rows: vectors that are null or hold a null or non-finite number take no
part, nor do rows without an id or with a number whose 1024-fold is no finite double; zero vectors take part; vectors meet only those
of their own length; an id is one row: a (vec_id, vector) repeated counts once,
and of several vectors of an id the best counts, as query and as candidate; a
score beyond 64 bits becomes the nearest such number; ties go to the smaller vec_id;
fewer than k others give fewer rows; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from styleframe.session import checkpoint

K, SCALE = 10, 1024
SHARD, LEAF, BLOCK = 4096, 64, 64
#: below this all sums of products are whole numbers in double precision
EXACT = float(1 << 53)
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


# -- tree of one shard --------------------------------------------------------------

def build(x: np.ndarray, leaf: int = LEAF) -> tuple:
    """(order, low, high, left, right, first, last): node 0 is the root; a node of ``left`` -1 is a leaf,
    and its vectors are order[first:last]."""
    order = np.arange(len(x))
    low, high, left, right, first, last = [], [], [], [], [], []
    work = [(0, len(x), -1)]
    while work:
        a, b, parent = work.pop()
        me = len(low)
        if parent >= 0:
            if left[parent] < 0:
                left[parent] = me
            else:
                right[parent] = me
        part = x[order[a:b]]
        low.append(part.min(axis=0))
        high.append(part.max(axis=0))
        left.append(-1)
        right.append(-1)
        first.append(a)
        last.append(b)
        wide = high[me] - low[me]
        if b - a > leaf and wide.size and wide.max() > 0:
            at = part[:, int(wide.argmax())]
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(at, mid)]
            work += [(a + mid, b, me), (a, a + mid, me)]
    return (order, np.array(low), np.array(high), *(np.array(v, np.int64) for v in (left, right, first, last)))


def search(tree: tuple, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, floor: float | None) -> tuple[list[tuple], int]:
    """([(score, id)] of the best ``k`` ids but ``own``, number of vectors compared); ``floor``: scores below are of no use."""
    _, low, high, left, right, first, last = tree
    exact = q.dtype != object
    bound = (np.maximum(low * q, high * q)).sum(axis=1) if low.size else np.zeros(len(low))
    best: list[tuple] = []                         # heap of (score, -id)
    have: dict[int, float] = {}
    kth, seen = floor, 0
    heap = [(-bound[0], 0)]
    while heap:
        least, node = heapq.heappop(heap)
        if kth is not None and -least < kth:
            break
        if left[node] >= 0:
            for child in (int(left[node]), int(right[node])):
                if kth is None or bound[child] >= kth:
                    heapq.heappush(heap, (-bound[child], child))
            continue
        a, b = int(first[node]), int(last[node])
        score = x[a:b] @ q if x.shape[1] else np.zeros(b - a)
        seen += b - a
        near = range(b - a) if kth is None else np.flatnonzero(score >= kth)
        for i in near:
            s, who = (float(score[i]) if exact else int(score[i])), int(ids[a + i])
            if who == own or have.get(who, s - 1) >= s:
                continue
            if who in have:
                best = [p for p in best if p[1] != -who]
                heapq.heapify(best)
            elif len(best) == k:
                if (s, -who) < best[0]:
                    continue
                del have[-heapq.heappop(best)[1]]
            heapq.heappush(best, (s, -who))
            have[who] = s
            if len(best) == k:
                kth = best[0][0] if floor is None else max(floor, best[0][0])
    return [(int(s), -who) for s, who in best], seen


# -- tasks ----------------------------------------------------------------------------

_TREE = "dim int, shard bigint, ids array<bigint>, v array<double>, low array<double>, high array<double>, links array<bigint>"


def _tree_task(batches, leaf: int):
    for b in batches:
        for i in range(b.num_rows):
            dim, members = b.column(0)[i].as_py(), b.column(2)[i].values
            ids = members.field(0).to_numpy(zero_copy_only=False)
            x = members.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
            order, low, high, *links = build(x, leaf)
            lists = [ids[order], x[order].ravel(), low.ravel(), high.ravel(), np.concatenate(links)]
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1),
                                              *(pa.array([v], pa.list_(t)) for v, t in zip(lists, kinds))], names=[f.split()[0] for f in _TREE.split(", ")])


_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _search_task(batches, k: int):
    """Rows of (dim, shard, queries, ids, v, low, high, links) -> the best of each query in that shard."""
    kept, tree = None, None
    for b in batches:
        out = [[], [], []]
        for i in range(b.num_rows):
            dim, shard = b.column(0)[i].as_py(), b.column(1)[i].as_py()
            if (dim, shard) != kept:
                ids, v, low, high, links = (b.column(j)[i].values.to_numpy(zero_copy_only=False) for j in range(3, 8))
                links = links.reshape(4, -1)
                x = v.reshape(len(ids), dim)
                nodes = links.shape[1]
                tree, kept = (None, low.reshape(nodes, dim), high.reshape(nodes, dim), *links), (dim, shard)
                most = np.abs(x).max(initial=0.0)
                big = None
            queries = b.column(2)[i].values
            q = queries.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(queries), dim)
            floors = queries.field(2).to_pylist()
            for own, one, floor in zip(queries.field(0).to_pylist(), q, floors):
                if most * np.abs(one).max(initial=0.0) * max(dim, 1) < EXACT:
                    found, _ = search(tree, x, ids, one, own, k, floor)
                else:                                # whole numbers of any length
                    if big is None:
                        whole = lambda m: np.array([[int(c) for c in r] for r in m], object).reshape(m.shape)
                        big = (None, whole(tree[1]), whole(tree[2]), *tree[3:]), whole(x)
                    # a floor at either end of 64 bits may stand for any larger or smaller score
                    sure = floor if floor is not None and _LOWEST < floor < _HIGHEST else None
                    found, _ = search(big[0], big[1], ids, np.array([int(c) for c in one], object), own, k, sure)
                out[0] += [own] * len(found)
                out[1] += [w for _, w in found]
                out[2] += [min(max(s, _LOWEST), _HIGHEST) for s, _ in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])


# -- on Spark -----------------------------------------------------------------------

def _top(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K,
                 shard: int = SHARD, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest integer inner products of each row for which ``is_query``
    (a function of the id column) holds, among all other ids."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf"))))
    # floor in double precision: 1024 * x is exact, and a whole double holds its floor
    rows = rows.select("id", F.transform(v, lambda x: F.rint(x * SCALE - F.pmod(x * SCALE, F.lit(1.0)))).alias("v"), F.size("v").alias("dim")).distinct()
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"))
    shards = F.ceil(F.col("n") / shard)
    rows = checkpoint(rows.join(sizes, "dim").select("dim", "id", "v", F.pmod(F.xxhash64("id", "v"), shards).alias("shard"), shards.alias("shards")))
    members = rows.groupBy("dim", "shard").agg(F.collect_list(F.struct("id", "v")).alias("members"))
    trees = checkpoint(members.mapInArrow(functools.partial(_tree_task, leaf=leaf), _TREE))
    asked = rows.where(is_query(F.col("id")))

    def met(queries: DataFrame) -> DataFrame:
        """``queries`` (dim, shard, id, v, floor) searched in their shards, in blocks."""
        number = F.row_number().over(Window.partitionBy("dim", "shard", "part").orderBy("id"))
        dealt = queries.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(64)))
        dealt = dealt.withColumn("part", F.struct("part", F.floor((number - 1) / block)))
        blocks = dealt.groupBy("dim", "shard", "part").agg(F.collect_list(F.struct("id", "v", "floor")).alias("queries"))
        joined = blocks.join(trees.hint("merge"), ["dim", "shard"])
        return joined.select("dim", "shard", "queries", "ids", "v", "low", "high", "links").mapInArrow(functools.partial(_search_task, k=k), _FOUND)

    home = checkpoint(met(asked.select("dim", "shard", "id", "v", F.lit(None).cast("long").alias("floor"))))
    # at least k ids are known to score this much or more
    floors = _top(home, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    away = (asked.join(floors, "id", "left").withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
            .where(F.col("to") != F.col("shard")).select("dim", F.col("to").alias("shard"), "id", "v", "floor"))
    found = home.unionByName(met(away))
    return _top(found, k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.id % 100 = 0 AND c.id <> q.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
