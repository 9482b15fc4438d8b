"""Source / sink round trips: the driver tables are written in each foreign
format by our sinks, read back by our scanners, and summarised; the oracle
computes the same summary straight from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from styleframe.functions.text import WS, tsv_safe
from styleframe.operators import corpus, cues, hierarchy, instruct, sampling
from styleframe.plans import sqlx
from styleframe.plans.corpus_q import SPLIT_ARGS, comments
from styleframe.plans.registry import register
from styleframe.session import scratch_path, stored
from styleframe.sources import corpora, dumps, entries, sinks
from styleframe.sources.tables import table

C = F.col


# -- O-118 / O-03 / O-38 / O-36 ---------------------------------------------------
@register("author_map_roundtrip", ops=("O-118", "O-03", "O-38", "O-36"), sql="""
SELECT lang AS dialect, source AS author, count(*) AS n_comments,
       CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM documents
WHERE text NOT IN ('[deleted]', '[removed]') AND source NOT IN ('[deleted]', '[removed]', 'AutoModerator')
  AND length(text) >= 10
GROUP BY lang, source
""")
def author_map_roundtrip(spark, sf):
    d = table(spark, sf, "documents").select(
        C("lang").alias("dialect"), C("source").alias("author"), "text",
        C("doc_id").cast("string").alias("id"), F.lit("").alias("subreddit"))
    d = corpus.drop_removed(d, "text", "author", 10)
    path = scratch_path(spark, "author-map")
    sinks.write_author_map(d, path, chunk=7)
    back = dumps.read_author_map(spark, path)
    return back.groupBy("dialect", "author").agg(
        F.count(F.lit(1)).alias("n_comments"), F.sum(F.char_length("text")).cast("bigint").alias("n_chars"))


# -- O-119 / O-120 / O-04 ------------------------------------------------------------
@register("hierarchy_roundtrip", ops=("O-119", "O-120", "O-04"), sql=f"""
WITH {sqlx.sentences_cte()},
{sqlx.user_splits_cte(**SPLIT_ARGS)}
SELECT split, lang AS dialect, count(DISTINCT doc_id) AS n_comments, count(*) AS n_sentences,
       CAST(sum(('0x' || substr(md5(sentence), 1, 8))::BIGINT) AS BIGINT) AS text_sum,
       CAST(sum(CASE WHEN contains(sentence, '?') THEN 1 ELSE 0 END) AS DOUBLE) AS n_question,
       CAST(sum(CASE WHEN regexp_matches(sentence, '[!?؟.,]{{2,}}') THEN 1 ELSE 0 END) AS DOUBLE) AS n_repeated
FROM sent JOIN splits USING (lang, source) GROUP BY split, lang
""")
def hierarchy_roundtrip(spark, sf):
    c = comments(spark, sf)
    sent = corpus.explode_sentences(c)
    splits = stored(corpus.split_users(c.select("lang", "source").distinct(), **SPLIT_ARGS), "splits")
    feat = cues.surface_cues(sent.withColumnRenamed("words", "text"), "sentence")
    rows = feat.join(splits, ["lang", "source"])
    path = scratch_path(spark, "hierarchy")
    sinks.write_hierarchy(rows, path, split="split")
    back = entries.read_hierarchy(spark, path)
    names = [n for n, _ in cues.SURFACE_CUES]
    at = {k: names.index(n) for k, n in (("n_question", "contains_question_mark_?"), ("n_repeated", "contains_repeated_punctuation"))}
    digest = F.conv(F.substring(F.md5(F.array_join("text", " ")), 1, 8), 16, 10).cast("bigint")
    return back.groupBy("split", "dialect").agg(
        F.count_distinct("user", "comment").alias("n_comments"), F.count(F.lit(1)).alias("n_sentences"),
        F.sum(digest).alias("text_sum"), *[F.sum(C("feature")[i]).alias(k) for k, i in at.items()])


# -- O-121 / O-05 / O-06 / O-08 ---------------------------------------------------------
@register("entries_roundtrip", ops=("O-121", "O-05", "O-06", "O-08"), sql=f"""
WITH {sqlx.sentences_cte()}
, d AS (SELECT lang, ('0x' || substr(md5(sentence || '|' || source || '|line_' || sent_idx), 1, 8))::BIGINT AS j,
     ('0x' || substr(md5(sentence || '|' || source), 1, 8))::BIGINT AS t FROM sent)
SELECT lang AS first_tag, count(*) AS n_json, CAST(sum(j) AS BIGINT) AS json_sum, count(*) AS n_tsv,
       CAST(sum(t) AS BIGINT) AS tsv_sum, count(*) AS n_tsv_single
FROM d GROUP BY lang
""")
def entries_roundtrip(spark, sf):
    from styleframe.plans.corpus_q import sentences
    e = hierarchy.flatten_entries(sentences(spark, sf))
    p_json, p_tsv = scratch_path(spark, "entries-json"), scratch_path(spark, "entries-tsv")
    sinks.write_entries(e, p_json)
    e.select(F.concat(tsv_safe(C("sentence")), F.lit("\t"), F.array_join(F.slice("tags", 1, 2), ",")))\
        .write.mode("overwrite").text(p_tsv)
    def digest(*parts):
        return F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint"))

    tag = lambda i: F.element_at("tags", i)
    j = entries.read_entries(spark, p_json).groupBy(tag(1).alias("first_tag")) \
        .agg(F.count(F.lit(1)).alias("n_json"), digest(C("sentence"), tag(2), tag(3)).alias("json_sum"))
    t = entries.read_labelled_tsv(spark, p_tsv, multi=True).groupBy(tag(1).alias("first_tag")) \
        .agg(F.count(F.lit(1)).alias("n_tsv"), digest(C("sentence"), tag(2)).alias("tsv_sum"))
    s = entries.read_labelled_tsv(spark, p_tsv, multi=False) \
        .groupBy(F.element_at(F.split(F.element_at("tags", 1), ","), 1).alias("first_tag")) \
        .agg(F.count(F.lit(1)).alias("n_tsv_single"))
    return j.join(t, "first_tag", "full_outer").join(s, "first_tag", "full_outer")


# -- O-79 / O-19 / O-80 / O-33 / O-95 --------------------------------------------------------
@register("instructions_roundtrip", ops=("O-79", "O-19", "O-80", "O-33", "O-95"), sql=f"""
WITH c AS (SELECT conv_id, turn, role, text,
                  lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
                  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations),
p AS (SELECT conv_id, turn, text, nt FROM c WHERE role = 'user' AND nr = 'assistant'),
n AS (SELECT count(*) AS n FROM p),
r AS (SELECT conv_id, turn, text, nt, row_number() OVER (ORDER BY {sqlx.digest(42, 'conv_id', 'turn')}, conv_id, turn) AS rk
      FROM p)
SELECT CASE WHEN rk <= floor(n * {1.0 - 0.02!r}) THEN 'train' ELSE 'val' END AS split,
       count(*) AS n_rows, CAST(count(*) * 2 AS BIGINT) AS n_messages,
       CAST(sum(('0x' || substr(md5(text || '|' || nt), 1, 8))::BIGINT) AS BIGINT) AS text_sum,
       CASE WHEN any_value(rk <= floor(n * {1.0 - 0.02!r})) THEN count(*) ELSE 0 END AS n_two_column
FROM r, n GROUP BY ALL
""")
def instructions_roundtrip(spark, sf):
    pairs = instruct.pair_turns(table(spark, sf, "conversations"))
    pairs = pairs.withColumn("dialect", F.lit("unknown")).withColumn("source", F.lit("conversations")) \
        .withColumn("type", F.lit("dialogue"))
    # half the rows carry the prompt as plain text (the other accepted shape)
    pairs = pairs.withColumn("prompt", F.when(C("turn") % 4 == 0, C("prompt")[0]["content"])
                             .otherwise(F.to_json("prompt")))
    h = sampling.holdout(pairs, 0.02, key=("conv_id", "turn"), seed=42)
    path = scratch_path(spark, "instructions")
    cols = ["prompt", "ground_truth", "dialect", "source", "type"]
    sinks.write_instructions(h.filter("split = 'train'").select(*cols),
                             h.filter("split = 'val'").select(*cols), path)
    tr = entries.read_instructions(spark, f"{path}/train").withColumn("split", F.lit("train"))
    va = entries.read_instructions(spark, f"{path}/val").withColumn("split", F.lit("val"))
    m = instruct.to_messages(tr.unionByName(va))
    digest = F.md5(F.concat_ws("|", C("messages")[0]["content"], C("messages")[1]["content"]))
    out = m.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("messages")).cast("bigint").alias("n_messages"),
                                 F.sum(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")).alias("text_sum"))
    # the two-column projection holds the train rows again
    pairs = entries.read_instructions(spark, f"{path}/train_trl").select("prompt", "ground_truth") \
        .join(tr.select("prompt", "ground_truth").distinct(), ["prompt", "ground_truth"], "left_semi")
    return out.crossJoin(pairs.agg(F.count(F.lit(1)).alias("_n"))).withColumn(
        "n_two_column", F.when(C("split") == "train", C("_n")).otherwise(0)).drop("_n")


# -- O-20 / O-124 / O-31 -----------------------------------------------------------------------
@register("prompts_roundtrip", ops=("O-20", "O-124", "O-31"), sql="""
SELECT md5(replace(translate(text, chr(9) || chr(10), '  '), chr(13), '')) AS prompt_md5,
       md5(replace(translate('echo: ' || text, chr(9) || chr(10), '  '), chr(13), '')) AS prediction_md5
FROM benchmark
""")
def prompts_roundtrip(spark, sf):
    b = table(spark, sf, "benchmark")
    p_csv, p_tsv = scratch_path(spark, "prompts-csv"), scratch_path(spark, "predictions-tsv")
    b.select(C("item_id").alias("id"), C("text").alias("Prompt")).write.mode("overwrite") \
        .option("header", True).option("escape", '"').csv(p_csv)
    prompts = entries.read_prompts(spark, p_csv)
    sinks.write_predictions_tsv(prompts.withColumn("prediction", F.concat(F.lit("echo: "), "prompt")),
                                p_tsv)
    back = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(p_tsv)
    return back.select(F.md5("prompt").alias("prompt_md5"), F.md5("prediction").alias("prediction_md5"))


# -- O-10 / O-11 / O-17 / O-96 / O-37 ------------------------------------------------------------
@register("loaders_roundtrip", ops=("O-10", "O-11", "O-17", "O-96", "O-37"), sql=f"""
WITH s AS (
  SELECT 'habibi' AS source, lower(lang) AS dialect,
         regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS t FROM documents
  UNION ALL
  SELECT 'edc' AS source, 'egy' AS dialect, regexp_replace(l, '^{WS}+|{WS}+$', '', 'g') AS t
  FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)
  UNION ALL
  SELECT 'joda' AS source, 'jor' AS dialect, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS t
  FROM documents
)
SELECT source, dialect, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS n_chars
FROM s WHERE length(t) > 10 GROUP BY source, dialect
""")
def loaders_roundtrip(spark, sf):
    d = table(spark, sf, "documents")
    p1, p2, p3 = (scratch_path(spark, n) for n in ("habibi-csv", "edc-lines", "joda-csv"))
    opts = dict(header=True, escape='"')
    d.select(C("doc_id").alias("ID"), C("text").alias("Lyrics"), F.upper("lang").alias("SongDialect")) \
        .write.mode("overwrite").options(**opts).csv(p1)
    d.select("text").write.mode("overwrite").text(p2)
    d.select(C("text").alias("Raw Text"), C("text").alias("Corrected Text")) \
        .write.mode("overwrite").options(**opts).csv(p3)
    u = instruct.union_loaders([corpora.load_alias_csv(spark, p1), corpora.load_lines(spark, p2),
                                corpora.load_preferred_text_csv(spark, p3)])
    return u.groupBy("source", "dialect").agg(F.count(F.lit(1)).alias("n"),
                                              F.sum(F.char_length("text")).cast("bigint").alias("n_chars"))


# -- O-96: report and skip -----------------------------------------------------------------------
@register("loaders_report", ops=("O-96", "O-10", "O-11"), sql=f"""
WITH s AS (
  SELECT 'habibi' AS loader, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS t FROM documents
  UNION ALL
  SELECT 'edc', regexp_replace(l, '^{WS}+|{WS}+$', '', 'g') FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)
), k AS (SELECT * FROM s WHERE length(t) > 10)
SELECT l.loader, l.failed, count(k.t) AS n, CAST(coalesce(sum(length(k.t)), 0) AS BIGINT) AS n_chars,
       CAST(coalesce(sum(('0x' || substr(md5(k.t), 1, 8))::BIGINT), 0) AS BIGINT) AS text_sum
FROM (VALUES ('habibi', FALSE), ('edc', FALSE), ('missing', TRUE), ('unreadable', TRUE)) l(loader, failed)
LEFT JOIN k USING (loader) GROUP BY l.loader, l.failed
""")
def loaders_report(spark, sf):
    """Four loaders of the same documents; one has no input and one fails only in its tasks: both are
    reported, the rows of the others are kept."""
    d = table(spark, sf, "documents")
    csv, lines = scratch_path(spark, "report-csv"), scratch_path(spark, "report-lines")
    d.select(C("text").alias("Lyrics"), C("lang").alias("Country")).write.option("header", True).option("escape", '"').csv(csv)
    d.select("text").write.text(lines)
    rows, report = instruct.run_loaders(spark, {
        "habibi": lambda: corpora.load_alias_csv(spark, csv),
        "edc": lambda: corpora.load_lines(spark, lines),
        "missing": lambda: corpora.load_lines(spark, csv + "-missing"),
        "unreadable": lambda: spark.read.schema(instruct.SAMPLE_SCHEMA).parquet(lines),
    })
    told = spark.createDataFrame([(k, v != "") for k, v in report.items()], "loader string, failed boolean")
    digest = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("bigint")
    sums = rows.groupBy(C("source").alias("loader")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).cast("bigint").alias("n_chars"), F.sum(digest).alias("text_sum"))
    return told.join(sums, "loader", "left").select("loader", "failed", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_chars", "text_sum")])
