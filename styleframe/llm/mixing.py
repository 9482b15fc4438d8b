"""Mixing sources to target weights by hash-threshold histograms (operator 8, DataFrame functions only).

Words are summed by (source, top hash bits).  In each source the bucket in which
the budget ends is the only one that is looked into further, by the next hash
bits, until it holds a single hash; documents below that threshold are taken.
Thresholds of growing budgets are nested: a larger budget takes the same
documents and more.  Nothing is sorted but the at most 4096 buckets of a source.

A source whose target exceeds its size takes every document once and spends the
rest of the budget on second copies; targets stop at twice the size.

Edge rows: a null text has size 0 and takes 0 words; a null source is a source
of its own, last in order; repeated rows share a hash and are taken or left
together; the document in which the budget ends is taken if that brings the
source nearer to its target; an empty table gives an empty table; further columns are
kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from styleframe.session import checkpoint

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: bits of a level of the histogram; a hash has LEVELS of them
BITS, LEVELS = 12, 5
#: source tables up to this many rows are broadcast (they hold a few numbers per row)
BROADCAST_SOURCES = 50_000


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def hash_of(doc_id: str, text: str) -> Column:
    """60 bits of the MD5 of id and text: the same on every run, and in any SQL engine."""
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"),
                   F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> the same and ``target``: weighted shares of ``share`` times all
    sizes, where no target exceeds ``most`` times its source (the excess goes to the others)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("w", pick)
    # by rising cap per weight: a source is capped if its share of what the sources before it
    # leave is not below its cap, and after the first that isn't capped none is
    fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(whole) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    rows = rows.withColumn("level", left / weight)
    rows = rows.withColumn("open", F.when(F.col("w") * F.col("level") < most * F.col("source_size"), F.col("level")))
    rows = rows.withColumn("final", F.first("open", ignorenulls=True).over(
        fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    cap = (most * F.col("source_size")).cast("double")
    return rows.select("source", "source_size", F.when(F.col("open").isNull(), cap).otherwise(F.col("w") * F.col("final")).alias("target"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def _same_source(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    b = b.withColumnRenamed("source", "_source")
    return a.join(b, a["source"].eqNullSafe(b["_source"]), how).drop("_source")


def plan(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, int]:
    """(source, h, size) rows -> per source: source_size, target, ``copies`` of every document
    and the hash ``threshold`` below which one more is taken; and the number of sources."""
    sizes = checkpoint(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    n = sizes.count()
    state = targets(sizes, weights, share, most).withColumn(
        "copies", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int"))
    state = state.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    state = checkpoint(state.withColumn("below", F.lit(0).cast("long")).withColumn("prefix", F.lit(0).cast("long"))
                       .withColumn("threshold", F.lit(None).cast("long")))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        open_ = state.where("threshold is null")
        inside = _same_source(slim, _small(open_.select("source", "prefix", "budget", "below"), n))
        inside = inside.where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        sums = (inside.groupBy("source", F.shiftright("h", shift).alias("bucket"))
                .agg(F.sum("size").alias("s"), F.min("h").alias("lo"), F.max("h").alias("hi"),
                     F.first("budget").alias("budget"), F.first("below").alias("start")))
        by = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        ends = (sums.withColumn("under", F.col("start") + F.coalesce(F.sum("s").over(by), F.lit(0)))
                .where(F.col("under") + F.col("s") > F.col("budget"))
                .groupBy("source").agg(F.min(F.struct("bucket", "under", "s", "lo", "hi")).alias("e")))
        # a bucket of one hash: take it if that comes nearer; no bucket: the budget covers all that is left
        single = F.col("e.lo") == F.col("e.hi")
        nearer = 2 * F.col("budget") >= 2 * F.col("e.under") + F.col("e.s")
        found = (F.when(F.col("e").isNull(), F.shiftleft(F.col("prefix") + 1, shift + BITS))
                 .when(single, F.col("e.lo") + nearer.cast("long")))
        state = checkpoint(_same_source(open_, _small(ends, n), "left").select(
            "source", "source_size", "target", "copies", "budget",
            F.coalesce("e.under", "below").alias("below"), F.coalesce("e.bucket", "prefix").alias("prefix"),
            found.alias("threshold")).unionByName(state.where("threshold is not null")))
        if not state.where("threshold is null").take(1):
            break
    return state.select("source", "source_size", "target", "copies", "threshold"), n


def _slim(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                       hash_of(doc_id, text).alias("h"), size_of(text).alias("size"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words)."""
    slim = checkpoint(_slim(docs, doc_id, text, source))
    state, n = plan(slim, weights, share, most)
    got = F.col("copies") + (F.col("h") < F.col("threshold")).cast("int")
    return _same_source(slim, _small(state, n)).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.least(got, F.lit(most))).cast("long").alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (columns unchanged; wordless rows go)."""
    state, n = plan(checkpoint(_slim(docs, doc_id, text, source)), weights, share, most)
    # the row goes along as one struct, so that no name of a column of ours can meet one of its own
    rows = docs.select(F.struct("*").alias("row"), F.col(source).cast("string").alias("source"), hash_of(doc_id, text).alias("h"),
                       F.col(text).rlike(r"[^\x20\x09-\x0D]").alias("worded")).where("worded")
    got = F.least(F.col("copies") + (F.col("h") < F.col("threshold")).cast("int"), F.lit(most))
    rows = _same_source(rows, _small(state, n)).select("row", F.explode(F.array_repeat(F.lit(1), got)))
    return rows.select("row.*")


#: The mix of ``documents`` in DuckDB: targets by the same filling, thresholds by a running sum.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS w FROM s),
f AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER
        (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(w) OVER () - coalesce(sum(w) OVER
        (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
      FROM w),
o AS (SELECT *, w * level < 2 * source_size AS open FROM f),
t AS (SELECT source, source_size, CASE WHEN NOT open THEN (2 * source_size)::DOUBLE ELSE w * first_value(level) OVER
        (ORDER BY open DESC, source_size::DOUBLE / w, source NULLS LAST) END AS target FROM o),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size))::INT ELSE 0 END AS copies FROM t),
g AS (SELECT source, h, sum(size) AS grp FROM d GROUP BY source, h),
r AS (SELECT source, h, grp, sum(grp) OVER (PARTITION BY source ORDER BY h) - grp AS below FROM g)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * least(2, b.copies + CASE WHEN 2 * (b.target - b.copies * b.source_size) >= 2 * r.below + r.grp
                                          THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
       JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.h = r.h
"""
