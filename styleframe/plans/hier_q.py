"""Hierarchy, keyed samplers, batching and capped sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from styleframe.operators import hierarchy, sampling
from styleframe.plans import sqlx
from styleframe.plans.corpus_q import comments
from styleframe.plans.registry import register
from styleframe.session import checkpoint
from styleframe.sources.tables import table

SEED = 42
SPAN_SQL = f"""
{sqlx.sentences_cte()},
cc AS (SELECT lang, source, doc_id, count(*) AS n FROM sent GROUP BY lang, source, doc_id),
cs AS (SELECT lang, source, doc_id, n,
              coalesce(sum(n) OVER (ORDER BY lang, source, doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS comment_start FROM cc),
us AS (SELECT lang, source, min(comment_start) AS user_start, max(comment_start + n) AS user_end
       FROM cs GROUP BY lang, source),
ds AS (SELECT lang, min(user_start) AS dialect_start, max(user_end) AS dialect_end
       FROM us GROUP BY lang),
spans AS (
  SELECT sent.lang, sent.source, sent.doc_id, sent.sent_idx,
         CAST(comment_start + sent_idx AS BIGINT) AS idx,
         CAST(comment_start AS BIGINT) AS comment_start, CAST(comment_start + n AS BIGINT) AS comment_end,
         CAST(user_start AS BIGINT) AS user_start, CAST(user_end AS BIGINT) AS user_end,
         CAST(dialect_start AS BIGINT) AS dialect_start, CAST(dialect_end AS BIGINT) AS dialect_end
  FROM sent JOIN cs USING (lang, source, doc_id) JOIN us USING (lang, source) JOIN ds USING (lang)
),
tot AS (SELECT max(dialect_end) AS total FROM spans)"""


def spans(spark, sf):
    sized = comments(spark, sf, materialize=False).withColumn("n", F.size("sentences")).drop("sentences")
    sized = checkpoint(sized)  # keys and a count: the text is read once, not once more for the range bounds
    return hierarchy.comment_spans(sized, n="n").withColumn("sent_idx", F.explode(F.sequence(F.lit(0), F.col("n") - 1))) \
        .withColumn("idx", F.col("comment_start") + F.col("sent_idx")).drop("n")


# -- O-21 ----------------------------------------------------------------------
@register("hierarchy_spans", ops=("O-21",), sql=f"""
WITH {SPAN_SQL}
SELECT doc_id, sent_idx, idx, comment_start, comment_end, user_start, user_end,
       dialect_start, dialect_end FROM spans
""")
def hierarchy_spans(spark, sf):
    return spans(spark, sf).select("doc_id", "sent_idx", "idx", *hierarchy.SPAN_COLS)


# -- O-88..O-91 + O-50 ----------------------------------------------------------
def _skip_sql(lo, hi, skip_from, skip_len, u):
    n = f"(({hi}) - ({skip_len}) - ({lo}))"
    new = f"(({lo}) + CAST(floor({u} * {n}) AS BIGINT))"
    return (f"CASE WHEN {n} > 0 THEN CASE WHEN {new} >= ({skip_from}) "
            f"THEN {new} + ({skip_len}) ELSE {new} END END")


def _pick_sql(rel: str, u: str) -> str:
    if rel == "comment":
        return _skip_sql("comment_start", "comment_end", "idx", "1", u)
    if rel == "author":
        return _skip_sql("user_start", "user_end", "comment_start", "comment_end - comment_start", u)
    if rel == "dialect":
        return _skip_sql("dialect_start", "dialect_end", "user_start", "user_end - user_start", u)
    return _skip_sql("0", "total", "dialect_start", "dialect_end - dialect_start", u)


def _u_sql(*keys):
    return sqlx_uniform(SEED, *keys)


def sqlx_uniform(seed, *keys):
    from styleframe.functions.keyed import sql_uniform
    return sql_uniform(seed, *keys)


_PICKS_SQL = "\nUNION ALL\n".join(
    f"SELECT idx, '{r}' AS relation, {_pick_sql(r, _u_sql(repr(r).replace(chr(34), chr(39)), 'idx', '0'))} AS picked "
    f"FROM spans, tot" for r in sampling.RELATIONS)


@register("keyed_picks", ops=("O-88", "O-89", "O-90", "O-91", "O-50"), sql=f"""
WITH {SPAN_SQL},
p AS ({_PICKS_SQL})
SELECT p.idx, p.relation, p.picked, s.doc_id AS picked_doc_id, s.source AS picked_source,
       s.lang AS picked_lang
FROM p LEFT JOIN spans s ON s.idx = p.picked
""")
def keyed_picks(spark, sf):
    sp = spans(spark, sf).select("idx", "doc_id", "source", "lang", *hierarchy.SPAN_COLS)
    return sampling.gather(sampling.picks(sp, seed=SEED), sp, "picked", ["doc_id", "source", "lang"])


# -- O-92 (+ O-78 grades) -----------------------------------------------------------
def _graded_sql(mini: bool) -> str:
    chain = sampling.CHAIN_4 if mini else sampling.CHAIN_16
    grades = sampling.GRADES_4 if mini else sampling.GRADES_16
    spancols = "comment_start, comment_end, user_start, user_end, dialect_start, dialect_end"
    ctes = [f"g0 AS (SELECT idx AS anchor, idx, {spancols}, total, idx AS i0 FROM spans, tot)"]
    cur = "g0"
    prev_items = ["i0"]
    for p, (rel, _src) in enumerate(chain):
        if p == 0:
            continue
        u = sqlx_uniform(SEED, "anchor", str(p))
        items = ", ".join(prev_items)
        if rel == "dialect_any":
            n = "(dialect_end - dialect_start)"
            expr = f"CASE WHEN {n} > 0 THEN dialect_start + CAST(floor({u} * {n}) AS BIGINT) END"
            ctes.append(f"g{p} AS (SELECT anchor, idx, {spancols}, total, {items}, {expr} AS i{p} FROM {cur})")
        elif rel == "comment":
            expr = _pick_sql("comment", u)
            ctes.append(f"g{p} AS (SELECT anchor, {expr} AS idx, {spancols}, total, {items}, "
                        f"{expr} AS i{p} FROM {cur})")
        else:
            expr = _pick_sql(rel, u)
            ctes.append(f"h{p} AS (SELECT anchor, total, {items}, {expr} AS i{p} FROM {cur})")
            sc = ", ".join(f"s.{c.strip()}" for c in spancols.split(","))
            ctes.append(f"g{p} AS (SELECT h.anchor, h.i{p} AS idx, {sc}, h.total, "
                        f"{', '.join('h.' + x for x in prev_items)}, h.i{p} "
                        f"FROM h{p} h LEFT JOIN spans s ON s.idx = h.i{p})")
        prev_items.append(f"i{p}")
        cur = f"g{p}"
    unions = "\nUNION ALL\n".join(
        f"SELECT anchor, {p} AS pos, i{p} AS item, {grades[p]} AS grade FROM {cur}"
        for p in range(len(chain)))
    return f"WITH {SPAN_SQL},\n" + ",\n".join(ctes) + f"\n{unions}"


@register("graded_groups", ops=("O-92", "O-78"), sql=_graded_sql(False))
def graded_groups(spark, sf):
    return sampling.graded_groups(spans(spark, sf), seed=SEED) \
        .select("anchor", "pos", "item", "grade")


@register("graded_groups_mini", ops=("O-92",), sql=_graded_sql(True))
def graded_groups_mini(spark, sf):
    return sampling.graded_groups(spans(spark, sf), seed=SEED, mini=True) \
        .select("anchor", "pos", "item", "grade")


# -- O-84 ----------------------------------------------------------------------------
@register("batches", ops=("O-84",), sql=f"""
WITH {SPAN_SQL}
SELECT idx AS anchor, CAST((row_number() OVER (ORDER BY idx) - 1) // 4 AS BIGINT) AS batch_id
FROM spans
""")
def batches(spark, sf):
    groups = spans(spark, sf).select(F.col("idx").alias("anchor"))
    return sampling.to_batches(groups, ["anchor"], batch_size=64, group_size=16)


# -- O-93 / O-94 / O-95 / O-43 / O-44 / O-57 on documents as corpus samples --------
TARGETS = ("en", "fr")
CAP = 500


def samples(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("dialect"),
                                             "source")
    return d.filter(~F.col("dialect").isin("", "unknown", "msa"))


@register("cap_per_source", ops=("O-93", "O-43"), sql=f"""
SELECT doc_id, dialect, source FROM (
  SELECT doc_id, lang AS dialect, source,
         row_number() OVER (PARTITION BY source ORDER BY (lang IN {TARGETS}) DESC,
                            {sqlx.digest(SEED, 'doc_id')}, doc_id) AS rn
  FROM documents WHERE lang NOT IN ('', 'unknown', 'msa')) WHERE rn <= {CAP}
""")
def cap_per_source(spark, sf):
    return sampling.cap_per_source(samples(spark, sf), cap=CAP, targets=TARGETS,
                                   key=("doc_id",), seed=SEED).select("doc_id", "dialect", "source")


@register("cap_rest", ops=("O-94", "O-44"), sql=f"""
WITH s AS (SELECT doc_id, lang AS dialect, source FROM documents
           WHERE lang NOT IN ('', 'unknown', 'msa')),
nt AS (SELECT count(*) FILTER (WHERE dialect IN {TARGETS}) AS n FROM s),
o AS (SELECT doc_id, dialect, source,
             row_number() OVER (ORDER BY {sqlx.digest(SEED, 'doc_id')}, doc_id) AS rk
      FROM s WHERE dialect NOT IN {TARGETS})
SELECT doc_id, dialect, source FROM s WHERE dialect IN {TARGETS}
UNION ALL
SELECT doc_id, dialect, source FROM o, nt WHERE rk <= greatest(floor(n * 0.2), 100)
""")
def cap_rest(spark, sf):
    return sampling.cap_rest(samples(spark, sf), TARGETS, key=("doc_id",), seed=SEED) \
        .select("doc_id", "dialect", "source")


@register("holdout", ops=("O-95",), sql=f"""
WITH s AS (SELECT doc_id FROM documents WHERE lang NOT IN ('', 'unknown', 'msa')),
n AS (SELECT count(*) AS n FROM s),
r AS (SELECT doc_id, row_number() OVER (ORDER BY {sqlx.digest(SEED, 'doc_id')}, doc_id) AS rk FROM s)
SELECT doc_id, CASE WHEN rk <= floor(n * {1.0 - 0.02!r}) THEN 'train' ELSE 'val' END AS split
FROM r, n
""")
def holdout(spark, sf):
    return sampling.holdout(samples(spark, sf).select("doc_id"), 0.02, key=("doc_id",),
                            seed=SEED).select("doc_id", "split")


@register("distribution", ops=("O-57", "O-43", "O-44"), sql=f"""
SELECT lang AS dialect, source, count(*) AS n,
       count(*) FILTER (WHERE lang IN {TARGETS}) AS n_target
FROM documents WHERE lang NOT IN ('', 'unknown', 'msa')
GROUP BY GROUPING SETS ((lang), (source))
""")
def distribution(spark, sf):
    from styleframe.operators import instruct
    return instruct.distribution(samples(spark, sf), TARGETS)
