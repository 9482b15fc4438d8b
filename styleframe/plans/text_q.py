"""Text-level queries: cleaning, filters, cues, parsing, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from styleframe.functions import text as tx
from styleframe.operators import corpus, cues, tokens
from styleframe.plans import sqlx
from styleframe.plans.corpus_q import sentences
from styleframe.plans.registry import register
from styleframe.sources.tables import table


# -- O-22/23/25/40/41/42: the sentence table itself ---------------------------
@register("sentence_table", ops=("O-22", "O-23", "O-25", "O-40", "O-41", "O-42"), sql=f"""
WITH {sqlx.sentences_cte()}
SELECT lang, source, doc_id, sent_idx, sentence, len({sqlx.words('sentence')}) AS n_words
FROM sent
""")
def sentence_table(spark, sf):
    s = sentences(spark, sf)
    return s.select("lang", "source", "doc_id", "sent_idx", "sentence",
                    F.size("words").cast("bigint").alias("n_words"))


# -- O-22 on raw web pages (entities everywhere, URLs in url) ----------------
@register("clean_pages", ops=("O-22",), sql=f"""
SELECT page_id, {sqlx.clean('url')} AS url_clean,
       md5({sqlx.clean('html')}) AS html_md5, length({sqlx.clean('html')}) AS html_len
FROM pages
""")
def clean_pages(spark, sf):
    p = table(spark, sf, "pages")
    h = tx.clean_text(F.col("html"))
    return p.select("page_id", tx.clean_text(F.col("url")).alias("url_clean"),
                    F.md5(h).alias("html_md5"), F.char_length(h).cast("bigint").alias("html_len"))


# -- O-38 / O-39 / O-26 / O-55: removed filter, language predicate, ratio ----
KEEP_LANGS = ("en", "fr", "es")


@register("keep_ratio", ops=("O-38", "O-39", "O-26", "O-55"), sql=f"""
SELECT count(*) AS total,
       count(*) FILTER (WHERE text NOT IN ('[deleted]', '[removed]')
                        AND source NOT IN ('[deleted]', '[removed]', 'AutoModerator')
                        AND length(text) >= 10 AND lang IN {KEEP_LANGS}) AS kept,
       round(100.0 * count(*) FILTER (WHERE text NOT IN ('[deleted]', '[removed]')
                        AND source NOT IN ('[deleted]', '[removed]', 'AutoModerator')
                        AND length(text) >= 10 AND lang IN {KEEP_LANGS}) / greatest(count(*), 1), 6)
         AS kept_pct
FROM documents
""")
def keep_ratio(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("source", "author")
    return corpus.keep_ratio(d, corpus.usable("text", "author", 10) & F.col("lang").isin(*KEEP_LANGS))


# -- O-54: comments per author per input file --------------------------------
@register("author_counts", ops=("O-54",), sql="""
SELECT lang, source AS author, count(*) AS n_comments FROM documents GROUP BY lang, source
""")
def author_counts(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("source", "author")
    return corpus.author_counts(d, "author", by=("lang",))


# -- O-02: tolerant JSON parse, malformed rows skipped -----------------------
PROPS_SCHEMA = T.StructType([T.StructField("k", T.LongType())])


@register("json_props", ops=("O-02",), sql="""
SELECT event_type, count(*) AS n_valid, CAST(sum(k) AS BIGINT) AS sum_k
FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k
      FROM events WHERE json_valid(props))
WHERE k IS NOT NULL
GROUP BY event_type
""")
def json_props(spark, sf):
    e = table(spark, sf, "events")
    parsed = e.select("event_type", F.from_json("props", PROPS_SCHEMA,
                                                {"mode": "PERMISSIVE"}).alias("p"))
    ok = parsed.filter(F.col("p.k").isNotNull())
    return ok.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_valid"),
                                        F.sum("p.k").alias("sum_k"))


# -- O-34: surface cues, one projection ----------------------------------------
def _cue_sql(i: int, rx: str) -> str:
    if "\\1" in rx:  # back-reference: RE2 has none; spell the rule out
        return ("(len(list_filter(range(1, length(sentence) - 1), lambda i: "
                "substr(sentence, i, 1) = substr(sentence, i + 1, 1) AND "
                "substr(sentence, i, 1) = substr(sentence, i + 2, 1) AND "
                "regexp_matches(substr(sentence, i, 1), '\\p{L}'))) > 0)")
    return f"regexp_matches(sentence, '{rx}')"


_CUE_UNION = "\nUNION ALL\n".join(
    f"SELECT lang, '{name}' AS cue, CAST(sum(CASE WHEN {_cue_sql(i, rx)} THEN 1 ELSE 0 END) AS DOUBLE) AS n_hits "
    f"FROM sent GROUP BY lang"
    for i, (name, rx) in enumerate(cues.SURFACE_CUES))


@register("surface_cue_counts", ops=("O-34",), sql=f"""
WITH {sqlx.sentences_cte()}
{_CUE_UNION}
""")
def surface_cue_counts(spark, sf):
    s = cues.surface_cues(sentences(spark, sf).select("lang", "sentence"))
    names = [n for n, _ in cues.SURFACE_CUES]
    summed = s.groupBy("lang").agg(*[F.sum(F.col("feature")[i]).alias(f"c{i}")
                                     for i in range(len(names))])
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("cue"), F.col(f"c{i}").alias("n_hits"))
                                for i, n in enumerate(names)]))
    return summed.select("lang", stack.alias("s")).select("lang", "s.cue", "s.n_hits")


# -- O-30: annotator response -> vector ---------------------------------------
FEATURE_NAMES = ("k", "missing", "k")   # repeated name keeps two slots


def _response():
    return (F.when(F.col("event_type") == "error", F.col("props"))
            .when(F.col("event_type") == "click", F.lit('{"features": {"k": true}}'))
            .when(F.col("event_type") == "view", F.lit('{"features": {"k": "abc"}}'))
            .when(F.col("event_type") == "signup", F.lit("{not json"))
            .otherwise(F.concat(F.lit('{"features": '), F.col("props"), F.lit("}"))))


@register("annotator_parse", ops=("O-30",), sql="""
SELECT event_id,
       CASE WHEN event_type = 'click' THEN 1.0
            WHEN event_type = 'purchase' THEN CAST(json_extract(props, '$.k') AS DOUBLE)
            ELSE 0.0 END AS f0,
       CAST(0.0 AS DOUBLE) AS f1,
       CASE WHEN event_type = 'click' THEN 1.0
            WHEN event_type = 'purchase' THEN CAST(json_extract(props, '$.k') AS DOUBLE)
            ELSE 0.0 END AS f2
FROM events
""")
def annotator_parse(spark, sf):
    e = table(spark, sf, "events")
    v = cues.parse_features(_response(), FEATURE_NAMES)
    return e.select("event_id", *[v[i].alias(f"f{i}") for i in range(len(FEATURE_NAMES))])


# -- O-24: vocabulary + ids + truncation -------------------------------------
VOCAB_SIZE = 50_000
MAX_LEN = 512


@register("token_ids", ops=("O-24",), sql=f"""
WITH {sqlx.sentences_cte()},
w AS (SELECT doc_id, sent_idx, unnest({sqlx.words('sentence')}) AS token,
             generate_subscripts({sqlx.words('sentence')}, 1) AS pos FROM sent),
cnt AS (SELECT token, count(*) AS n FROM w GROUP BY token),
vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id
          FROM cnt QUALIFY row_number() OVER (ORDER BY n DESC, token) <= {VOCAB_SIZE}),
enc AS (SELECT doc_id, sent_idx, pos, coalesce(token_id, 1) AS id
        FROM w LEFT JOIN vocab USING (token) WHERE pos <= {MAX_LEN})
SELECT doc_id, sent_idx, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids,
       count(*) AS n_ids
FROM enc GROUP BY doc_id, sent_idx
""")
def token_ids(spark, sf):
    s = sentences(spark, sf)
    vocab = tokens.build_vocab(s, size=VOCAB_SIZE)
    e = tokens.encode(s.select("doc_id", "sent_idx", "words"), vocab, ["doc_id", "sent_idx"],
                      max_length=MAX_LEN)
    return e.select("doc_id", "sent_idx", F.array_join("input_ids", ",").alias("ids"),
                    F.size("input_ids").cast("bigint").alias("n_ids"))


# -- O-07: hierarchy -> flat entries -----------------------------------------
@register("flat_entries", ops=("O-07",), sql=f"""
WITH {sqlx.sentences_cte()}
SELECT sentence, lang || '|' || source || '|line_' || CAST(sent_idx AS VARCHAR) AS tags
FROM sent
""")
def flat_entries(spark, sf):
    from styleframe.operators import hierarchy
    e = hierarchy.flatten_entries(sentences(spark, sf))
    return e.select("sentence", F.array_join("tags", "|").alias("tags"))


# -- O-31 / O-26: TSV-safe text and newline flattening -----------------------
@register("tsv_safe_text", ops=("O-31", "O-26"), sql="""
SELECT conv_id, turn,
       md5(replace(translate(text, chr(9) || chr(10), '  '), chr(13), '')) AS tsv_md5,
       md5(translate(text, chr(13) || chr(10), '  ')) AS flat_md5
FROM conversations
""")
def tsv_safe_text(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.md5(tx.tsv_safe(F.col("text"))).alias("tsv_md5"),
                    F.md5(tx.flatten_newlines(F.col("text"))).alias("flat_md5"))


# -- O-27: script ratio --------------------------------------------------------
LATIN1 = "\\x{00C0}-\\x{00FF}"


@register("script_ratio", ops=("O-27",), sql=f"""
SELECT doc_id,
  round(length(regexp_replace(text, '[^{LATIN1}]', '', 'g'))
        / greatest(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')), 1), 6) AS latin1_ratio,
  length(regexp_replace(text, '[^{tx.ARABIC_RANGES}]', '', 'g'))
        / greatest(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')), 1) > 0.5 AS is_arabic
FROM documents
""")
def script_ratio(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.round(tx.script_ratio(F.col("text"), LATIN1), 6).alias("latin1_ratio"),
                    tx.is_script(F.col("text")).alias("is_arabic"))
