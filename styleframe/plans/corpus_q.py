"""Corpus-build queries over ``documents`` (dialect = lang, user = source,
comment = doc_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from styleframe.operators import corpus
from styleframe.plans import sqlx
from styleframe.plans.registry import register
from styleframe.sources.tables import table

SPLIT_ARGS = dict(test=5, dev=5, train=200, seed=42)


def comments(spark, sf, min_comments: int | None = 2, materialize: bool = True):
    docs = table(spark, sf, "documents")
    # removed bodies and the deleted-user marker are skipped before any work
    docs = docs.filter(~F.col("text").isin("[deleted]", "[removed]") & (F.col("source") != "[deleted]"))
    return corpus.to_comments(docs, min_comments=min_comments, materialize=materialize)


def sentences(spark, sf):
    return corpus.explode_sentences(comments(spark, sf))


def user_split_counts(spark, sf):
    # per-user HAVING folded into the per-user aggregate: one pass over the text
    return corpus.split_counts(comments(spark, sf, min_comments=None), min_comments=2,
                               **SPLIT_ARGS)


register(
    "user_split_counts",
    ops=("O-22", "O-23", "O-25", "O-40", "O-41", "O-42", "O-87"),
    sql=f"""
WITH {sqlx.sentences_cte()},
{sqlx.user_splits_cte(**SPLIT_ARGS)},
per_user AS (
  SELECT lang, source, count(*) AS n_comments, sum(len(sents)) AS n_sentences
  FROM c GROUP BY lang, source
)
SELECT lang, split, count(*) AS n_users, CAST(sum(n_comments) AS BIGINT) AS n_comments,
       CAST(sum(n_sentences) AS BIGINT) AS n_sentences
FROM per_user JOIN splits USING (lang, source)
GROUP BY lang, split
""")(user_split_counts)
