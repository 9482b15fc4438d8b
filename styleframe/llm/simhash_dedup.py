"""SimHash near-duplicates by covering locality-sensitive hashing (operator 9).

Fingerprints: 64 bits, bit b set if it is set in over half of the XXH64 hashes
of a text's word shingles (repeats counted).  Two fingerprints link at
``radius`` differing bits or fewer.

Covering: give each bit position i a nonzero vector m(i) of radius + 1 bits.
For each nonzero v the mask of v keeps the positions with an odd <m(i), v>.
Any ``radius`` positions span at most ``radius`` dimensions, so some v is
orthogonal to all of them: its mask drops every differing bit, and the pair has
equal masked fingerprints in that table.  2^(radius+1) - 1 tables, no misses.

Scale: equal fingerprints collapse before any table is built.  A bucket of two
is one pair, found inside the first (partial) aggregate.  Larger buckets are
dealt to block pairs of bounded size, each of which returns one star per linked
set instead of its pairs.  Buckets beyond ``HEAVY`` members are covered again on
the bits that their mask left out, so a huge group of near copies splits by the
same guarantee.  Nothing is dropped at any size.

Edge rows: null or blank texts have fingerprint zero and link like any other;
texts shorter than the shingle are one shingle; repeated rows each return a row;
null ids never become a component id unless all ids of the component are null;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleframe.llm.components import components
from styleframe.session import checkpoint

BITS = 64
SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: members of one side of a block pair: a task compares at most about twice as many
BLOCK = 1024
#: members from which a bucket is covered once more instead of dealt to block pairs
HEAVY = 16 * BLOCK
PIECE = 1 << 20


# -- fingerprints ---------------------------------------------------------------

def _word_lists(text: bytes, k: int):
    """Lists of words of a text in order; each further one starts with the last k - 1 words before it."""
    if len(text) <= PIECE:
        yield text.split()
        return
    carry: list[bytes] = []
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        part = carry + text[at:end].split()
        at = end
        if len(part) < k and at < len(text):
            carry = part
            continue
        yield part
        carry = part[len(part) - k + 1:] if k > 1 else []


def simhash(text: bytes, k: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Fingerprint of one UTF-8 text as a signed 64-bit integer."""
    import xxhash
    digest = functools.partial(xxhash.xxh64_digest, seed=seed)
    ones, n = np.zeros(BITS, np.int64), 0
    for ws in _word_lists(text.lower(), k):
        if not ws or (n and len(ws) < k):
            continue
        joined = b" ".join(ws)
        if len(ws) <= k:
            found = [joined]
        else:
            ends, at = [], -1
            for w in ws:
                at += len(w) + 1
                ends.append(at)
            starts = [0] + [e + 1 for e in ends[:len(ws) - k]]
            found = [joined[s:e] for s, e in zip(starts, ends[k - 1:])]
        h = np.frombuffer(b"".join(map(digest, found)), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
        n += len(found)
    if not n:
        return 0
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def _fingerprint_texts(col: pa.Array, k: int, seed: int) -> list[pa.Array]:
    texts = col.cast(pa.binary())
    return [pa.array(np.fromiter((simhash(t.as_py() or b"", k, seed) for t in texts), np.int64, len(texts)))]


def _id_task(batches, k: int, seed: int):
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[1:], *_fingerprint_texts(b.column(0), k, seed)], names=["id", "th", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 k: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(id, th, fp) for each row of ``docs``: its id, a hash of its text, its fingerprint."""
    src = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("id"),
                      F.xxhash64(F.col(text)).alias("th"))
    return src.mapInArrow(functools.partial(_id_task, k=k, seed=seed), "id bigint, th bigint, fp bigint")


# -- covering masks ---------------------------------------------------------------

def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks over the given bit positions; any ``radius`` of them miss some mask."""
    order = np.random.RandomState(len(bits)).permutation(len(bits))
    vectors = (1 << (radius + 1)) - 1
    m = {bits[i]: 1 + n % vectors for n, i in enumerate(order)}
    return [sum(1 << b for b in bits if bin(m[b] & v).count("1") % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _refined(masks: list[int], radius: int) -> list[int]:
    """For each mask, in order, its covering on the bits that it leaves out, joined with it."""
    out = []
    for m in masks:
        out += [m | x for x in covering_masks([b for b in range(BITS) if not m >> b & 1], radius)]
    return out


# -- links inside buckets -----------------------------------------------------------

def stars(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(smallest member, other member) for each set of fingerprints linked within ``radius`` bits."""
    x = np.unique(fps)
    n = len(x)
    if n < 2:
        return []
    u = x.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    seen = np.zeros(n, dtype=bool)
    out = []
    for i in range(n):
        if seen[i]:
            continue
        seen[i] = True
        front = near[i] & ~seen
        while front.any():
            new = np.flatnonzero(front)
            seen[new] = True
            out += [(int(x[i]), int(x[j])) for j in new]
            front = near[new].any(axis=0) & ~seen
    return out


def _star_task(batches, radius: int):
    for b in batches:
        u, v = [], []
        for members in b.column(0):
            for a, c in stars(np.asarray(members.values.to_numpy(zero_copy_only=False), np.int64), radius):
                u.append(a)
                v.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())],
                                         names=["u", "v"])


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, heavy: int = HEAVY) -> DataFrame:
    """(u, v): edges that connect exactly the fingerprints linked through chains within ``radius``.

    ``fps``: distinct, non-null ``fp`` (checkpointed: it is read more than once)."""
    masks = covering_masks(list(range(BITS)), radius)
    tables = len(masks)
    level, found = 0, []
    members = fps.select("fp", F.lit(0).alias("t"))
    while True:
        level += 1
        choices = F.array(*[F.lit(_signed(m)) for m in masks])
        keyed = (members.select("fp", F.explode(F.sequence(F.col("t") * tables, F.col("t") * tables + (tables - 1))).alias("t"))
                 .select("fp", "t", F.col("fp").bitwiseAND(F.element_at(choices, F.col("t") + 1)).alias("k")))
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
        buckets = checkpoint(keyed.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("a"),
                                                         F.max("fp").alias("b"))
                             .where((F.col("n") > 2) | ((F.col("n") == 2) & near)))
        found.append(buckets.where("n = 2").select(F.col("a").alias("u"), F.col("b").alias("v")))
        top = buckets.agg(F.max("n")).first()[0] or 0
        if top <= 2:
            break
        last = level == 3 or top <= heavy
        large = buckets.where("n > 2") if last else buckets.where((F.col("n") > 2) & (F.col("n") <= heavy))
        parts = F.ceil(F.col("n") / block).cast("int")
        dealt = (keyed.join(large.select("t", "k", "n"), ["t", "k"])
                 .withColumn("p", parts).withColumn("x", F.pmod(F.xxhash64("fp"), F.col("p")).cast("int"))
                 .select("t", "k", "fp", "x", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("y"))
                 .groupBy("t", "k", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
                 .agg(F.collect_list("fp").alias("fps")).select("fps"))
        found.append(dealt.mapInArrow(functools.partial(_star_task, radius=radius), "u bigint, v bigint"))
        if last:
            break
        huge = buckets.where(F.col("n") > heavy).select("t", "k")
        members = checkpoint(keyed.join(huge, ["t", "k"]).select("fp", "t"))
        masks = _refined(masks, radius)
    return functools.reduce(DataFrame.unionByName, found)


def fingerprint_components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, id) distinct fingerprints with their smallest id -> (fp, root, component_id)."""
    roots = components(links(fps.select("fp"), radius))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    k: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    marked = checkpoint(fingerprints(docs, text, doc_id, k).select("id", "fp"))
    fps = checkpoint(marked.groupBy("fp").agg(F.min("id").alias("id")))
    comp = fingerprint_components(fps, radius)
    return (marked.join(comp, "fp")
            .select(F.col("id").alias("doc_id"),
                    F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
             k: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (nulls last), then the
    smallest text hash; of rows equal in both, one."""
    marked = checkpoint(fingerprints(docs, text, doc_id, k))
    fps = checkpoint(marked.groupBy("fp").agg(F.min("id").alias("id")))
    comp = fingerprint_components(fps, radius)
    rank = F.struct(F.col("id").isNull().alias("z"), "id", "th", "n")
    best = (marked.groupBy("fp", "id", "th").agg(F.count("*").alias("n"))
            .groupBy("fp").agg(F.min(rank).alias("w")).join(comp, "fp")
            .groupBy("root").agg(F.min("w").alias("w"))
            .select(F.col("w.id").alias("_id"), F.col("w.th").alias("_th"), F.col("w.n").alias("_n")))
    best = checkpoint(best)
    on = docs[doc_id].eqNullSafe(best["_id"]) & (F.xxhash64(docs[text]) == best["_th"])
    once = docs.join(best.where("_n = 1"), on, "left_semi")
    if not best.where("_n > 1").take(1):
        return once
    again = docs.join(best.where("_n > 1"), on, "left_semi").dropDuplicates([doc_id, text])
    return once.unionByName(again)
