"""Cumulative-snapshot collapse and chat rendering (operator 2).

A logged conversation is contained if its turns are the first turns of a longer
one.  Every turn gets the rolling hash of the turns up to it (two 60-bit sums of
turn hash times base^position, modulo 2^64).  A conversation whose last hash is
the hash of an inner turn of another one is contained and goes, by an anti-join
on (position, hash); of equal conversations the smallest id stays.  The others
are rendered.

Scale: turns are dealt by range of (conversation, turn), so a conversation that
holds a third of all rows is spread over many tasks.  Each task hashes its own
run of turns; what its first conversation had before is a number of turns and
two sums, so per task one short row reaches the driver and a list of that length
goes back.  Inner prefixes are made distinct (combined before the shuffle), so a
common first turn is one row.  Rendered text comes in segments of ``SEGMENT``
turns; a longer conversation has more rows, in order.

Edge rows: turns are ordered by turn (null first), then by the hash of role and
text; a row repeated in full counts once; a null role is rendered as
``unknown``, a null text as empty (both differ from an empty one when compared);
rows without conv_id are one conversation with null id; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleframe.session import checkpoint

SEGMENT = 256
BASE = 0x9E3779B97F4A7C15 | 1
TURN_MARK = ("<|", "|>\n", "\n<|end|>\n")

LOCAL = "kind int, pid int, conv bigint, no_conv boolean, turn bigint, key string, pos bigint, s1 bigint, s2 bigint, last boolean"


def turn_key(role: str, text: str):
    """MD5 of role and text; nulls differ from empty ones."""
    part = lambda c: F.coalesce(F.md5(F.col(c).cast("binary")), F.lit("-"))
    return F.md5(F.concat(part(role), F.lit(":"), part(text)).cast("binary"))


def _local_task(batches):
    """Hashes of one task's run of turns, with positions and sums from the task's start of each conversation.

    Ends with rows of kind 1: the first and the last conversation with their numbers of turns and sums."""
    from pyspark import TaskContext
    pid = TaskContext.get().partitionId()
    prev = None      # (conv, no_conv, turn, key) of the last row
    pos, s1, s2, power = 0, 0, 0, 1
    first, held = None, None  # held: the last row, whose ``last`` is not known yet
    mask = (1 << 64) - 1
    for b in batches:
        out = []
        for conv, no_conv, turn, key in zip(*(b.column(i).to_pylist() for i in range(4))):
            me = (conv, no_conv, turn, key)
            if me == prev:
                continue
            new = prev is None or prev[:2] != me[:2]
            if held is not None:
                out.append((*held, new))
            if new:
                if prev is not None and first is None:
                    first = (prev[0], prev[1], pos, s1, s2)
                pos, s1, s2, power = 0, 0, 0, 1
            pos += 1
            s1 = (s1 + int(key[:15], 16) * power) & mask
            s2 = (s2 + int(key[15:30], 16) * power) & mask
            power = power * BASE & mask
            held = (0, pid, conv, no_conv, turn, key, pos, s1, s2)
            prev = me
        yield _rows(out)
    if prev is None:
        return
    end = (prev[0], prev[1], pos, s1, s2)
    yield _rows([(*held, None)] + [(1, pid, c, z, None, which, n, a, x, None) for which, (c, z, n, a, x) in (("first", first or end), ("last", end))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    signed = lambda v: [x - (1 << 64) if x >> 63 else x for x in v]
    cols = list(zip(*rows)) if rows else [[]] * 10
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    names = ("kind", "pid", "conv", "no_conv", "turn", "key", "pos", "s1", "s2", "last")
    return pa.RecordBatch.from_arrays([pa.array(signed(c) if n in ("s1", "s2") else list(c), k) for c, k, n in zip(cols, kinds, names)], names=list(names))


def carried(ends: list) -> dict[int, tuple]:
    """pid -> (conversation, its turns and sums before this task, whether the task's last row ends its conversation)."""
    by: dict[int, dict] = {}
    for r in ends:
        by.setdefault(r["pid"], {})[r["key"]] = r
    out, before = {}, None  # before: (conversation, turns, s1, s2) at the end of the task before
    pids = sorted(by)
    for i, pid in enumerate(pids):
        first, last = by[pid]["first"], by[pid]["last"]
        me = (first["conv"], first["no_conv"])
        n, s1, s2 = before[1:] if before is not None and before[0] == me else (0, 0, 0)
        follows = by[pids[i + 1]]["first"] if i + 1 < len(pids) else None
        ends_here = follows is None or (follows["conv"], follows["no_conv"]) != (last["conv"], last["no_conv"])
        out[pid] = (me, n, s1, s2, ends_here)
        power = pow(BASE, n, 1 << 64)
        if (last["conv"], last["no_conv"]) == me:
            before = (me, n + last["pos"], s1 + power * last["s1"] & (1 << 64) - 1, s2 + power * last["s2"] & (1 << 64) - 1)
        else:
            before = ((last["conv"], last["no_conv"]), last["pos"], last["s1"] & (1 << 64) - 1, last["s2"] & (1 << 64) - 1)
    return out


def _shift_task(batches, before: dict):
    """Positions and sums from the start of each conversation."""
    for b in batches:
        pid, pos, s1, s2 = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pid", "pos", "s1", "s2"))
        conv, no_conv = b.column(b.schema.get_field_index("conv")), b.column(b.schema.get_field_index("no_conv")).to_numpy(zero_copy_only=False)
        conv = conv.fill_null(0).to_numpy(zero_copy_only=False)
        last = b.column(b.schema.get_field_index("last")).to_pylist()
        pos, s1, s2 = pos.copy(), s1.view(np.uint64).copy(), s2.view(np.uint64).copy()
        for p in np.unique(pid):
            (c, z), n, a, x, ends_here = before[int(p)]
            if n:
                at = (pid == p) & (conv == (c or 0)) & (no_conv == z)
                power = np.uint64(pow(BASE, n, 1 << 64))
                pos[at] += n
                s1[at] = s1[at] * power + np.uint64(a)
                s2[at] = s2[at] * power + np.uint64(x)
            last = [ends_here if v is None and q == p else v for v, q in zip(last, pid)]
        new = {"pos": pa.array(pos), "s1": pa.array(s1.view(np.int64)), "s2": pa.array(s2.view(np.int64)), "last": pa.array(last, pa.bool_())}
        yield pa.RecordBatch.from_arrays([new.get(n, b.column(i)) for i, n in enumerate(b.schema.names)], names=b.schema.names)


def prefixes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             partitions: int | None = None) -> DataFrame:
    """(conv, no_conv, turn, key, pos, s1, s2, last): each distinct turn with the hash of the turns up to it."""
    rows = turns.select(F.coalesce(F.col(conv_id).cast("long"), F.lit(0)).alias("conv"), F.col(conv_id).isNull().alias("no_conv"),
                        F.col(turn).cast("long").alias("turn"), turn_key(role, text).alias("key"))
    order = ["conv", "no_conv", "turn", "key"]
    n = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    local = checkpoint(dealt.mapInArrow(_local_task, LOCAL))
    before = carried(local.where("kind = 1").collect())  # two rows a task
    return (local.where("kind = 0").mapInArrow(functools.partial(_shift_task, before=before), LOCAL)
            .drop("kind", "pid"))


def maximal(turn_hashes: DataFrame) -> DataFrame:
    """(conv, no_conv, n_turns): the conversations that are no prefix of a longer one, once each."""
    place = ["pos", "s1", "s2"]
    whole = turn_hashes.where("last").groupBy(*place).agg(F.min(F.struct("no_conv", "conv")).alias("c"))
    inner = turn_hashes.where("not last").select(*place).distinct()
    return whole.join(inner, place, "left_anti").select("c.conv", "c.no_conv", F.col("pos").alias("n_turns"))


def render(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           segment: int = SEGMENT, partitions: int | None = None) -> DataFrame:
    """(conv_id, segment, n_turns, text): maximal conversations in rendered segments."""
    hashes = checkpoint(prefixes(turns, conv_id, turn, role, text, partitions))
    kept = maximal(hashes)
    where = hashes.join(kept, ["conv", "no_conv"]).select("conv", "no_conv", F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "key", "pos", "n_turns")
    a, mid, z = (F.lit(m) for m in TURN_MARK)
    piece = F.concat(a, F.coalesce(F.col(role), F.lit("unknown")), mid, F.coalesce(F.col(text), F.lit("")), z)
    said = turns.select(F.coalesce(F.col(conv_id).cast("long"), F.lit(0)).alias("conv"), F.col(conv_id).isNull().alias("no_conv"),
                        F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 62))).alias("turn"), turn_key(role, text).alias("key"), piece.alias("piece"))
    rows = said.join(where, ["conv", "no_conv", "turn", "key"])
    part = F.floor((F.col("pos") - 1) / segment).cast("int")
    out = rows.groupBy("conv", "no_conv", part.alias("segment"), "n_turns").agg(F.sort_array(F.collect_set(F.struct("pos", "piece"))).alias("p"))
    return out.select(F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"), "segment", "n_turns", F.array_join("p.piece", "").alias("text"))


SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text,
             md5(coalesce(md5(role), '-') || ':' || coalesce(md5(text), '-')) AS key FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos,
             count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
p AS (SELECT *, string_agg(key, ',') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM n),
whole AS (SELECT prefix, min(conv_id) AS conv_id FROM p WHERE pos = n_turns GROUP BY prefix),
kept AS (SELECT conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n_turns))
SELECT conv_id, ((pos - 1) // 256)::INT AS segment, n_turns,
       string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY pos) AS text
FROM n JOIN kept USING (conv_id) GROUP BY ALL
"""
