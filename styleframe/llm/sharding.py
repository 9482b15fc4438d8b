"""Sharding by best-fit-decreasing bin packing (operator 5).

Groups of equal texts are indivisible.  Sorted by falling size, each enters the
bin with the tightest remaining capacity that still holds it, found in a
balanced search tree over (remaining, bin).  For a fixed number of shards the
capacity is the smallest one at which the packing needs no more bins.

Scale: only items whose number is bounded reach the packing.  A group larger
than 1 / ``GRAIN`` of all bytes is an item (there are fewer than ``GRAIN``); the
others are summed into ``GRAIN`` bundles by text hash.  At most 2 * ``GRAIN``
items are packed on the driver and joined back as a broadcast of that many rows.

Edge rows: a null text has size 1 and groups with the empty text; a group larger
than an even share has a shard for itself, and the others share the rest;
repeated rows each have a slot; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from styleframe.session import checkpoint

SHARDS = 16
GRAIN = 4096
#: rows that one task numbers, about
SLOT_ROWS = 100_000


class Treap:
    """Search tree over keys, balanced by pseudo-random priorities: add, remove, least key >= x."""

    def __init__(self):
        self.root, self.seed = None, 1

    @classmethod
    def _merge(cls, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = cls._merge(a[3], b)
            return a
        b[2] = cls._merge(a, b[2])
        return b

    @classmethod
    def _split(cls, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = cls._split(node[3], key)
            return node, right
        left, node[2] = cls._split(node[2], key)
        return left, node

    def add(self, key) -> None:
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.seed >> 20, None, None]), right)

    def remove(self, key) -> None:
        parent, side, node = None, 0, self.root
        while node[0] != key:
            parent, side = node, 2 if key < node[0] else 3
            node = node[side]
        rest = self._merge(node[2], node[3])
        if parent is None:
            self.root = rest
        else:
            parent[side] = rest

    def ceiling(self, key):
        node, best = self.root, None
        while node is not None:
            if node[0] >= key:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best


def best_fit_decreasing(sizes: list[int], capacity: int, most_bins: int | None = None) -> list[int] | None:
    """Bin of each item (given by falling size).  None if that takes more than ``most_bins``."""
    tree, bins, out = Treap(), 0, []
    for s in sizes:
        fit = tree.ceiling((s, -1))
        if fit is None:
            if bins == most_bins or s > capacity:
                return None
            fit, bins = (capacity, bins), bins + 1
        else:
            tree.remove(fit)
        out.append(fit[1])
        tree.add((fit[0] - s, fit[1]))
    return out


def pack(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item (given by falling size), by the smallest capacity that needs no more than ``shards``."""
    out: list[int] = []
    left, n = sum(sizes), shards
    while n > 1 and len(out) < len(sizes) and sizes[len(out)] * n > left:  # larger than an even share: alone
        left -= sizes[len(out)]
        n -= 1
        out.append(n)
    rest = sizes[len(out):]
    if not rest:
        return out
    lo = max(-(-left // n), rest[0])
    hi, best = lo, best_fit_decreasing(rest, lo, n)
    step = max(1, left // (n * 10_000))
    while best is None:
        lo, hi = hi, hi + step
        step *= 2
        best = best_fit_decreasing(rest, hi, n)
    while hi - lo > max(1, left // (n * 10_000)):
        mid = (lo + hi) // 2
        found = best_fit_decreasing(rest, mid, n)
        lo, hi, best = (lo, mid, found) if found is not None else (mid, hi, best)
    return out + best


def size_of(text: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def group_of(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _item(gh: str, size: str, total: int, grain: int) -> Column:
    """Item of a group: its hash if it is large, else its bundle (a number below ``grain``, kept apart by the flag)."""
    large = F.col(size) * grain > total
    return F.struct(large.alias("large"), F.when(large, F.col(gh)).otherwise(F.pmod(F.col(gh), F.lit(grain))).alias("key"))


def assign(docs: DataFrame, text: str = "text", shards: int = SHARDS, grain: int = GRAIN) -> tuple[DataFrame, DataFrame, int]:
    """Shards of large groups (gh, shard), of bundles (bundle, shard), and the number of rows."""
    groups = checkpoint(docs.groupBy(group_of(text).alias("gh")).agg(F.sum(size_of(text)).alias("size"), F.count("*").alias("n")))
    total, rows = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    items = (groups.groupBy(_item("gh", "size", total, grain).alias("i")).agg(F.sum("size").alias("size"))
             .select("i.large", "i.key", "size").collect())  # at most 2 * grain rows
    items.sort(key=lambda r: (-r["size"], r["large"], r["key"]))
    where = pack([r["size"] for r in items], shards)
    spark = docs.sparkSession
    out = [spark.createDataFrame([(int(r["key"]), int(s)) for r, s in zip(items, where) if r["large"] == large],
                                 "key bigint, shard int") for large in (True, False)]
    return out[0], out[1], rows


def place(docs: DataFrame, text: str = "text", shards: int = SHARDS, grain: int = GRAIN, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` with _size, _gh, _crc, _shard and _slot (gapless from 0 in each shard, in the order of
    (hash of ``order``, ``order``, text hash))."""
    large, bundles, rows = assign(docs, text, shards, grain)
    rows_ = docs.withColumns({"_size": size_of(text), "_gh": group_of(text),
                              "_crc": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))})
    a, b = F.broadcast(large.toDF("_lk", "_ls")), F.broadcast(bundles.toDF("_bk", "_bs"))  # < 2 * grain rows
    rows_ = (rows_.join(a, F.col("_gh") == F.col("_lk"), "left")
             .join(b, F.pmod(F.col("_gh"), F.lit(grain)) == F.col("_bk"), "left")
             .withColumn("_shard", F.coalesce("_ls", "_bs")).drop("_lk", "_ls", "_bk", "_bs"))
    lots = max(16, math.ceil(rows / shards / SLOT_ROWS))
    rows_ = rows_.withColumn("_lot", F.pmod(F.xxhash64(*order, "_crc"), F.lit(lots)).cast("int"))
    # rows are numbered in lots of a shard; a lot begins where the ones before it end
    counts = rows_.groupBy("_shard", "_lot").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(counts.select(F.col("_shard").alias("_s2"), F.col("_lot").alias("_l2"),
                                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))  # shards * lots rows
    number = F.row_number().over(Window.partitionBy("_shard", "_lot").orderBy(*order, "_crc", "_gh"))
    return (rows_.withColumn("_slot", number)
            .join(starts, (F.col("_shard") == F.col("_s2")) & (F.col("_lot") == F.col("_l2")))
            .withColumn("_slot", (F.col("_start") + F.col("_slot") - 1).cast("long"))
            .drop("_s2", "_l2", "_start", "_lot"))


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return place(slim, shards=shards).select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``docs`` with columns shard and slot at the end (in place of columns of these names)."""
    # the row goes along as one struct, so that no name of a column of ours can meet one of its own
    slim = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return place(slim, shards=shards).select(*kept, F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
