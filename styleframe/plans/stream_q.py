"""Streaming queries: each drives a file-source stream to completion over the
driver's Parquet tables and returns what the sink holds (equal to batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from styleframe.functions.text import REMOVED_BODIES
from styleframe.operators import corpus
from styleframe.plans import sqlx
from styleframe.plans.registry import register
from styleframe.sources.tables import table
from styleframe.streaming import incremental as inc


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return inc.table_stream(spark, f"{sf.rstrip('/')}/{name}.parquet", schema)


def _sentences(df):
    d = df.filter(~F.col("text").isin(*REMOVED_BODIES))
    c = corpus.require_sentences(corpus.with_sentences(d.select("lang", "source", "doc_id", "text"))
                                 .drop("text"), 2)
    return corpus.explode_sentences(c).select("lang", "source", "doc_id", "sent_idx", "sentence")


# -- O-98 / O-99: stateless clean / split / filter on a stream ------------------
@register("stream_sentences", ops=("O-98", "O-99"), sql=f"""
WITH c0 AS (SELECT lang, source, doc_id, {sqlx.kept_sentences('text')} AS sents
            FROM documents WHERE text NOT IN ('[deleted]', '[removed]')),
c AS (SELECT * FROM c0 WHERE len(sents) >= 2)
SELECT lang, source, doc_id, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS sent_idx,
       unnest(sents) AS sentence FROM c
""")
def stream_sentences(spark, sf):
    out, ck = inc.scratch_pair(spark, "stream-sentences")
    inc.run_incremental(_stream(spark, sf, "documents"), _sentences, out, ck)
    inc.run_incremental(_stream(spark, sf, "documents"), _sentences, out, ck)  # no new files: no-op
    return spark.read.parquet(out)


# -- O-115: running mean vector ----------------------------------------------------------
@register("stream_centroid", ops=("O-115",), sql="""
SELECT CAST(dim AS INTEGER) AS dim, round(avg(x), 9) AS mean, count(*) AS n FROM
  (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim
   FROM embeddings) GROUP BY dim
""")
def stream_centroid(spark, sf):
    out, ck = inc.scratch_pair(spark, "stream-centroid")
    inc.run_stateful(_stream(spark, sf, "embeddings"), inc.running_centroid, out, ck)
    r = inc.latest(spark, out, ["dim"])
    return r.select("dim", F.round("mean", 9).alias("mean"), "n")


# -- O-116: running author / dialect counts ------------------------------------------------
@register("stream_counts", ops=("O-116",), sql="""
SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source
""")
def stream_counts(spark, sf):
    out, ck = inc.scratch_pair(spark, "stream-counts")
    inc.run_stateful(_stream(spark, sf, "documents"),
                     lambda s: inc.running_counts(s, ["lang", "source"]), out, ck)
    return inc.latest(spark, out, ["lang", "source"])


# -- O-117: keyed, idempotent progress output --------------------------------------------------
@register("stream_progress", ops=("O-117",), sql="""
SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations
""")
def stream_progress(spark, sf):
    out, ck = inc.scratch_pair(spark, "stream-progress")
    inc.run_keyed_progress(
        _stream(spark, sf, "conversations"),
        lambda b: b.select("conv_id", "turn", "role",
                           F.char_length("text").cast("bigint").alias("n_chars")), out, ck)
    return spark.read.parquet(out).drop("batch_id")
