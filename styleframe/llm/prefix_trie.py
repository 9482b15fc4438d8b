"""Prefix trie of rebuilt conversations by composable fingerprints (operator 12).

A conversation c is rebuilt from the first h turns of its base c - c % 20 and
its own turns after its first h, where h = crc32(c) % 4.  The fingerprint of
turns t_1..t_n is the sum of t_i * B^i (two sums modulo 2^64, from the SHA-256
of each turn).  Such sums compose: a rebuilt prefix is the base's head sum plus
the own sum between two places, shifted by a power of B, so no rebuilt text is
ever made.  Equal (depth, fingerprint) is one node of the trie.  Each row keeps
a reference to its last turn (its SHA-256) and its parent's fingerprint; a node
whose rows differ in either is a collision, and then all is done again with
another base.

Scale: turns are dealt by range of (conversation, turn), so a conversation that
holds a third of all rows is spread over many tasks; two short rows a task carry
sums across.  Counts, smallest members and children combine before the shuffle.
Sums over subtrees go up 1, 2, 4, ... levels at a time: the ancestor s levels
above a node is the node at (member, depth - s), an equi-join on unique keys, so
a trie of depth D takes log2(D) rounds over the nodes deeper than s, and a hot
parent is no hot key.  Conversations that end in a node are hashed in order as a
stream of chunks of ``CHUNK`` ids, never as one list (SHA-256 is sequential, so
one task reads the ids of one node).

Edge rows: turns are ordered by turn (null first), then by the SHA-256 of role
and text; rows repeated in full are separate turns; null role or text is empty;
rows without conv_id belong to no conversation and take no part; a base that is
absent gives no head; a conversation shorter than its h has no own turns left
and may be turnless (it is a member of the root); ids are cast to long, and c % 20 has the sign of c, as in SQL; an empty
table gives an empty table; very long texts are one hash and one word count;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleframe.session import checkpoint

GROUP, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: ids that one row of the ordered hash holds
CHUNK = 8192
#: odd bases; a later one is taken after a collision
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
MASK = (1 << 64) - 1

_LOCAL = "kind int, pid int, conv bigint, pos bigint, s1 bigint, s2 bigint, key binary, words bigint"
NODE = ("depth", "f1", "f2")


def _power(base: int, n: np.ndarray) -> np.ndarray:
    """base^n modulo 2^64, for n >= 0, from tables of 4096 powers a digit."""
    out = np.ones(len(n), np.uint64)
    left, unit = n.astype(np.int64), base
    while left.size and left.max() > 0:
        table = np.full(4096, unit, np.uint64)
        table[0] = 1
        out *= np.multiply.accumulate(table)[left & 4095]
        left, unit = left >> 12, pow(unit, 4096, 1 << 64)
    return out


def _digests(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of each 32-byte digest."""
    raw = np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, 4)
    return raw[:, 0], raw[:, 1]


def _batch(cols: list, schema: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)


def _local_task(batches, base: int):
    """Positions and sums of one task's run of turns, from where the task (or the conversation) starts.

    Ends with rows of kind 1 (first conversation) and 2 (last one): their turns and sums in this task."""
    from pyspark import TaskContext
    pid = TaskContext.get().partitionId()
    conv_now, pos_now, sums = None, 0, [0, 0]
    first = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        conv = b.column(0).to_numpy()
        new = np.r_[conv_now is None or conv[0] != conv_now, conv[1:] != conv[:-1]]
        begin = np.flatnonzero(new)
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))       # start of the row's conversation, -1: before
        pos = np.arange(n) - at + 1
        pos[at < 0] = np.arange(1, int((at < 0).sum()) + 1) + pos_now
        power = _power(base, pos)
        out = []
        for j, t in enumerate(_digests(b.column(1))):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t * power)])
            s = total[1:] - total[np.maximum(at, 0)]
            s[at < 0] += np.uint64(sums[j])
            out.append(s)
        if first is None and conv_now is not None and len(begin):
            i = begin[0]
            first = (conv_now, pos_now, *sums) if i == 0 else (int(conv[i - 1]), int(pos[i - 1]), int(out[0][i - 1]), int(out[1][i - 1]))
        elif first is None and len(begin) > 1:
            i = begin[1]
            first = (int(conv[i - 1]), int(pos[i - 1]), int(out[0][i - 1]), int(out[1][i - 1]))
        conv_now, pos_now, sums = int(conv[-1]), int(pos[-1]), [int(out[0][-1]), int(out[1][-1])]
        yield _batch([np.zeros(n, np.int32), np.full(n, pid, np.int32), conv, pos, out[0].view(np.int64), out[1].view(np.int64), b.column(1), b.column(2)], _LOCAL)
    if conv_now is not None:
        last = (conv_now, pos_now, *sums)
        ends = [first or last, last]
        signed = lambda i: np.array([e[i] for e in ends], np.uint64).view(np.int64)
        yield _batch([np.array([1, 2], np.int32), np.full(2, pid, np.int32), np.array([e[0] for e in ends], np.int64), np.array([e[1] for e in ends], np.int64),
                      signed(2), signed(3), pa.nulls(2, pa.binary()), pa.nulls(2, pa.int64())], _LOCAL)


def carried(ends: list, base: int) -> dict[int, tuple]:
    """pid -> (first conversation, its turns and sums before this task)."""
    by: dict[int, dict] = {}
    for r in ends:
        by.setdefault(r["pid"], {})[r["kind"]] = r
    out, before = {}, None
    for pid in sorted(by):
        first, last = by[pid][1], by[pid][2]
        n, s1, s2 = before[1:] if before is not None and before[0] == first["conv"] else (0, 0, 0)
        out[pid] = (first["conv"], n, s1, s2)
        if last["conv"] == first["conv"]:
            shift = pow(base, n, 1 << 64)
            before = (last["conv"], n + last["pos"], s1 + shift * last["s1"] & MASK, s2 + shift * last["s2"] & MASK)
        else:
            before = (last["conv"], last["pos"], last["s1"] & MASK, last["s2"] & MASK)
    return out


def _shift_task(batches, before: dict, base: int):
    for b in batches:
        pid, conv, pos, s1, s2 = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
        pos, s1, s2 = pos.copy(), s1.view(np.uint64).copy(), s2.view(np.uint64).copy()
        for p in np.unique(pid):
            c, n, a, x = before[int(p)]
            if n:
                at = (pid == p) & (conv == c)
                shift = np.uint64(pow(base, n, 1 << 64))
                pos[at] += n
                s1[at] = s1[at] * shift + np.uint64(a)
                s2[at] = s2[at] * shift + np.uint64(x)
        yield _batch([b.column(0), b.column(1), b.column(2), pos, s1.view(np.int64), s2.view(np.int64), b.column(6), b.column(7)], _LOCAL)


def turn_sums(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, base: int, partitions: int | None = None) -> DataFrame:
    """(conv, pos, s1, s2, key, words): every turn with the sums of its conversation up to it."""
    said = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")).cast("binary"), 256)
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(said(role), said(text)).cast("binary"), 256)).alias("key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("words"), F.monotonically_increasing_id().alias("i"))
    order = ["conv", F.col("turn").asc_nulls_first(), "key", "i"]
    n = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv", "key", "words")
    local = checkpoint(dealt.mapInArrow(functools.partial(_local_task, base=base), _LOCAL))
    before = carried(local.where("kind > 0").collect(), base)  # two rows a task
    return local.where("kind = 0").mapInArrow(functools.partial(_shift_task, before=before, base=base), _LOCAL).drop("kind", "pid")


_OWN = "conv bigint, depth bigint, f1 bigint, f2 bigint, p1 bigint, p2 bigint, key binary, words bigint"


def _join_task(batches, base: int, bits: int):
    """Base-head sum plus shifted own sum, for the prefix and for its parent (its last turn taken off)."""
    keep = np.uint64(MASK >> (64 - bits))
    for b in batches:
        g = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names) if n not in ("key",)}
        depth, back = g["depth"], g["at"] - g["depth"]         # a turn at ``at`` of its own conversation stands at ``depth``
        shift = np.where(back >= 0, _power(pow(base, -1, 1 << 64), np.maximum(back, 0)), _power(base, np.maximum(-back, 0)))
        power = _power(base, depth)
        out = []
        for j, t in enumerate(_digests(b.column(b.schema.get_field_index("key")))):
            u = lambda c: g[f"{c}{j + 1}"].astype(np.int64).view(np.uint64)  # noqa: B023, E731
            f = u("b") + (u("s") - u("o")) * shift
            out.append((f, f - t * power))
        yield _batch([g["conv"], depth, *((f & keep).view(np.int64) for f, _ in out), *((p & keep).view(np.int64) for _, p in out),
                      b.column(b.schema.get_field_index("key")), g["words"]], _OWN)


def rebuilt(sums: DataFrame, base: int, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, f1, f2, p1, p2, key, words): the prefixes of every rebuilt conversation, root left out;
    (conv, n_turns): the length of every rebuilt conversation."""
    place = F.struct("pos", "s1", "s2", "key", "words")
    convs = sums.groupBy("conv").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") < HEADS, place))).alias("head"))  # three turns at most
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    bases = convs.where(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), F.col("head").alias("base_head"))
    plan = convs.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % GROUP).join(bases, "base", "left")
    plan = plan.withColumn("lead", F.slice(F.coalesce("base_head", F.array().cast(plan.schema["base_head"].dataType)), F.lit(1), F.col("h")))
    sum_at = lambda a, n, s: F.when(n > 0, F.element_at(a, F.greatest(n, F.lit(1)))[s]).otherwise(F.lit(0).cast("long"))
    own_h = F.least("h", F.size("head"))
    plan = plan.select("conv", "n", "h", "lead", F.size("lead").cast("long").alias("led"),
                       *(sum_at(F.col("head"), own_h, f"s{j}").alias(f"o{j}") for j in (1, 2)),
                       *(sum_at(F.col("lead"), F.size("lead"), f"s{j}").alias(f"b{j}") for j in (1, 2)))
    plan = checkpoint(plan)
    zero = F.lit(0).cast("long")
    own = sums.join(plan.select("conv", "h", "led", "o1", "o2", "b1", "b2"), "conv").where("pos > h").select(
        "conv", F.col("pos").alias("at"), (F.col("pos") - F.col("h") + F.col("led")).alias("depth"), "s1", "s2", "o1", "o2", "b1", "b2", "key", "words")
    lead = plan.select("conv", F.explode("lead").alias("t")).select(
        "conv", F.col("t.pos").alias("at"), F.col("t.pos").alias("depth"), F.col("t.s1").alias("s1"), F.col("t.s2").alias("s2"),
        *(zero.alias(c) for c in ("o1", "o2", "b1", "b2")), F.col("t.key").alias("key"), F.col("t.words").alias("words"))
    rows = own.unionByName(lead).mapInArrow(functools.partial(_join_task, base=base, bits=bits), _OWN)
    return rows, plan.select("conv", (F.col("led") + F.greatest(F.col("n") - F.col("h"), zero)).alias("n_turns"))


# -- conversations that end in a node --------------------------------------------------

_CHUNKS = "depth bigint, f1 bigint, f2 bigint, first bigint, ids string"
_HASHES = "depth bigint, f1 bigint, f2 bigint, ends_sha256 string"


def _chunk_task(batches, size: int):
    node, ids, out = None, [], []

    def flush():
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for b in batches:
        for *key, conv in zip(*(b.column(i).to_pylist() for i in range(4))):
            if key != node or len(ids) == size:
                flush()
                node = key
            ids.append(conv)
        if len(out) >= 1000 or sum(len(o[4]) for o in out) > 1 << 22:
            yield _rows(out, _CHUNKS)
            out.clear()
    flush()
    yield _rows(out, _CHUNKS)


def _hash_task(batches):
    node, sha, out = None, None, []
    for b in batches:
        for *key, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if key != node:
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield _rows(out, _HASHES)
        out.clear()
    if node is not None:
        yield _rows([(*node, sha.hexdigest())], _HASHES)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[]] * len(kinds)
    return _batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], schema)


def ends_hashes(ends: DataFrame, size: int = CHUNK) -> DataFrame:
    """(depth, f1, f2, ends_sha256) of (depth, f1, f2, conv): ids ascending, comma-joined, as a stream."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*NODE, "conv"]
    chunks = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(functools.partial(_chunk_task, size=size), _CHUNKS)
    return chunks.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hash_task, _HASHES)


# -- trie ------------------------------------------------------------------------------

def subtree_sums(nodes: DataFrame, members: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """(depth, f1, f2, *values): each value summed over the node's subtree, its top included.

    ``members`` has (conv, depth, f1, f2) for every node's conv at every smaller depth."""
    add = [F.sum(v).alias(v) for v in values]
    live = nodes.select(*NODE, "conv", *values)
    parts, step = [nodes.select(*NODE, *values)], 1
    while step <= deepest:
        up = live.where(F.col("depth") >= step).withColumn("depth", F.col("depth") - step).drop("f1", "f2")
        met = checkpoint(up.join(members, ["conv", "depth"]).groupBy(*NODE).agg(F.min("conv").alias("conv"), *add))
        parts.append(met.select(*NODE, *values))
        step *= 2
        if step <= deepest:
            live = live.unionByName(met).where(F.col("depth") >= step).groupBy(*NODE).agg(F.min("conv").alias("conv"), *add)
            live = checkpoint(live)
    return functools.reduce(DataFrame.unionByName, parts).groupBy(*NODE).agg(*add)


def trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
         partitions: int | None = None, bits: int = 64, chunk: int = CHUNK) -> DataFrame:
    """One row a node; columns as in the module docstring's contract (``bits`` shortens the first fingerprints, for tests)."""
    for base in BASES:
        sums = checkpoint(turn_sums(turns, conv_id, turn, role, text, base, partitions))
        rows, lengths = rebuilt(sums, base, bits)
        rows = checkpoint(rows)
        found = rows.groupBy(*NODE).agg(
            F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.max("words").alias("words"),
            F.min(F.struct("key", "p1", "p2")).alias("least"), F.max(F.struct("key", "p1", "p2")).alias("most"))
        found = checkpoint(found)
        if not found.where("least <> most").limit(1).count():
            break
        bits = 64
    else:
        raise ValueError("prefix fingerprints collide under every base")
    root = lengths.groupBy().agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(*(zero.alias(c) for c in NODE), "n_convs", "conv", zero.alias("words"), zero.alias("p1"), zero.alias("p2"))
    nodes = found.select(*NODE, "n_convs", "conv", "words", F.col("least.p1").alias("p1"), F.col("least.p2").alias("p2")).unionByName(root)
    # the parent of a depth-1 node is the root, whose sums are zero
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children"))
    nodes = checkpoint(nodes.join(kids, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", zero)))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    members = rows.select("conv", *NODE).unionByName(lengths.select("conv", *(zero.alias(c) for c in NODE)))
    valued = nodes.select(*NODE, "conv", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    summed = subtree_sums(valued, members, ["n_leaves", "saved_tokens"], deepest)
    ends = members.join(lengths, (members["conv"] == lengths["conv"]) & (members["depth"] == lengths["n_turns"])).select(members["conv"], *NODE)
    names = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    out = (nodes.join(summed, list(NODE)).join(ends_hashes(ends, chunk), list(NODE), "left").join(names, ["depth", "p1", "p2"], "left"))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
                      "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id AS c, turn, sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, key, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) AS pos FROM t),
tab AS (SELECT i, list_reduce([i::UBIGINT] || [x::UBIGINT for x in range(8)], lambda v, x: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END) AS r FROM range(256) g(i)),
step(c, s, i, r) AS (
    SELECT DISTINCT c, c::VARCHAR, 0, 4294967295::UBIGINT FROM o
    UNION ALL
    SELECT c, s, step.i + 1, xor(step.r >> 8, tab.r) FROM step JOIN tab ON tab.i = (xor(step.r, ascii(s[step.i + 1])::UBIGINT) & 255) WHERE step.i < len(s)),
h AS (SELECT c, (xor(r, 4294967295::UBIGINT) % 4)::BIGINT AS h, c - c % 20 AS base FROM step WHERE i = len(s)),
re AS (SELECT h.c, 0 AS part, o.pos, o.key, o.w FROM h JOIN o ON o.c = h.base AND o.pos <= h.h
       UNION ALL SELECT h.c, 1, o.pos, o.key, o.w FROM h JOIN o ON o.c = h.c AND o.pos > h.h),
d AS (SELECT c, w, key, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM re),
p AS (SELECT c, depth, w, string_agg(key, ',') OVER (PARTITION BY c ORDER BY depth) AS path FROM d
      UNION ALL SELECT c, 0, 0, '' FROM h),
l AS (SELECT c, max(depth) AS n FROM p GROUP BY c),
n AS (SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w FROM p GROUP BY depth, path),
k AS (SELECT *, CASE WHEN depth = 0 THEN NULL WHEN depth = 1 THEN '' ELSE left(path, len(path) - 65) END AS up FROM n),
c AS (SELECT k.*, (SELECT count(*) FROM k x WHERE x.up = k.path) AS n_children FROM k),
a AS (SELECT top.depth, top.path, sum((x.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((x.n_convs - 1) * x.w)::BIGINT AS saved_tokens
      FROM p tp JOIN c x ON x.conv_id = tp.c AND x.depth >= tp.depth JOIN c top ON top.depth = tp.depth AND top.path = tp.path GROUP BY top.depth, top.path),
e AS (SELECT p.depth, p.path, sha256(string_agg(p.c::VARCHAR, ',' ORDER BY p.c)) AS s FROM p JOIN l ON l.c = p.c AND l.n = p.depth GROUP BY p.depth, p.path)
SELECT c.conv_id, c.depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, a.n_leaves, a.saved_tokens, coalesce(e.s, sha256('')) AS ends_sha256
FROM c JOIN a USING (depth, path) LEFT JOIN e USING (depth, path) LEFT JOIN k u ON u.path = c.up AND u.depth = c.depth - 1
"""
