"""Remaining inventory items as queries: pluggable annotator with pending /
attach, nested rows, probes, encoder + vector export, zst dumps, authorship
folders, row loaders."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from styleframe.functions import keyed
from styleframe.functions import vectors as V
from styleframe.functions.text import WS
from styleframe.operators import corpus, cues, encode, instruct, linear, vectors
from styleframe.plans import sqlx
from styleframe.plans.corpus_q import sentences
from styleframe.plans.registry import register
from styleframe.session import checkpoint, scratch_path
from styleframe.sources import corpora, dumps, entries, sinks
from styleframe.sources.tables import table

C = F.col


def stub_annotator(texts):
    """Deterministic stand-in for a remote annotator: [long sentence, has comma]."""
    return [[float(len(t) > 80), float("," in t)] for t in texts]


# -- O-35 / O-46 / O-49 / O-53 -----------------------------------------------------
@register("annotate_pending", ops=("O-35", "O-46", "O-49", "O-53"), sql=f"""
WITH {sqlx.sentences_cte()}
SELECT lang, count(*) AS n, CAST(sum(CASE WHEN length(sentence) > 80 THEN 1 ELSE 0 END) AS DOUBLE) AS n_long,
       CAST(sum(CASE WHEN contains(sentence, ',') THEN 1 ELSE 0 END) AS DOUBLE) AS n_comma,
       count(*) AS n_ok
FROM sent GROUP BY lang
""")
def annotate_pending(spark, sf):
    s = sentences(spark, sf).select("lang", "doc_id", "sent_idx", "sentence")
    key = ["doc_id", "sent_idx"]
    first = cues.annotate(s.filter(C("lang") == "en"), stub_annotator, key, "sentence", width=2)
    done_path = scratch_path(spark, "annotated")
    first.write.mode("overwrite").parquet(done_path)          # a first run, persisted
    done = spark.read.parquet(done_path)
    rest = cues.annotate(cues.pending(s, done, key), stub_annotator, key, "sentence", width=2)
    feats = done.unionByName(rest)
    a = cues.attach(s, feats.select(*key, "feature", "ok"), key, width=2)
    return a.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(C("feature")[0]).alias("n_long"),
                                 F.sum(C("feature")[1]).alias("n_comma"),
                                 F.count_if("ok").alias("n_ok"))


# -- O-56 --------------------------------------------------------------------------------
@register("nested_comments", ops=("O-56",), sql=f"""
WITH {sqlx.sentences_cte()}
SELECT lang, source, doc_id, md5(string_agg(sentence, ' | ' ORDER BY sent_idx)) AS nested_md5,
       count(*) AS n_sentences
FROM sent GROUP BY lang, source, doc_id
""")
def nested_comments(spark, sf):
    from styleframe.operators.hierarchy import nest
    n = nest(sentences(spark, sf), fields=("sentence",))
    return n.select("lang", "source", "doc_id",
                    F.md5(F.array_join(F.transform("sentences", lambda x: x["sentence"]), " | "))
                    .alias("nested_md5"), F.size("sentences").cast("bigint").alias("n_sentences"))


# -- O-104 (MLlib form) / O-105 / O-68 ---------------------------------------------------------
def _emb_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return checkpoint(e.select("vec_id", "label", array_to_vector(V.as_double("embedding")).alias("features")))


@register("linear_probe", ops=("O-104",))
def linear_probe(spark, sf):
    d = _emb_vectors(spark, sf)
    m = LogisticRegression(featuresCol="features", labelCol="label", maxIter=100, regParam=1e-3,
                           standardization=False).fit(d.withColumn("label", C("label").cast("double")))
    p = m.transform(d)
    return p.select("vec_id", "label", C("prediction").cast("int").alias("pred"))


def _label_targets(e):
    """(rows with one-hot targets, number of features, labels): the classes are the labels that occur, in order,
    and the features those of the most frequent vector size; the labels are few, as each is a target of the model."""
    labels = [r[0] for r in e.where(C("label").isNotNull()).select("label").distinct().orderBy("label").limit(linear.MODEL_SIZE + 1).collect()]
    size = e.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    targets = F.array(*[(C("label") == y).cast("double") for y in labels]) if labels else F.array().cast("array<double>")
    rows = e.select("vec_id", "label", V.as_double("embedding").alias("features"), targets.alias("targets"))
    return checkpoint(rows), (size[0]["d"] if size else 0), labels


@register("feature_probe", ops=("O-105", "O-68"))
def feature_probe(spark, sf):
    """A binary probe for each feature (the label is y, for every y), all fitted in one run; logits -> BCE."""
    d, n, labels = _label_targets(table(spark, sf, "embeddings"))
    m = linear.fit_linear(d, n, len(labels), "ovr", reg=1e-3)
    return vectors.bce(d.withColumn("logits", linear.logits(m, C("features"))), "logits", "targets")


@register("multinomial_probe", ops=("O-103", "O-104", "O-106"))
def multinomial_probe(spark, sf):
    """All classes in one softmax model: (vec_id, label, pred, p), p the probability of the predicted class."""
    d, n, labels = _label_targets(table(spark, sf, "embeddings"))
    m = linear.fit_linear(d, n, len(labels), "multinomial", reg=1e-3)
    p = d.withColumn("p", linear.probabilities(m, linear.logits(m, C("features"))))
    names = F.array(*[F.lit(y) for y in labels]) if labels else F.array().cast("array<int>")
    return p.select("vec_id", "label", F.get(names, V.argmax(C("p"))).alias("pred"), F.round(F.array_max("p"), 6).alias("p"))


# -- O-113 / O-122 --------------------------------------------------------------------------
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@register("encoder_export", ops=("O-113", "O-122"), sql=f"""
WITH c AS (SELECT doc_id, list_transform(range(0, 26), lambda i:
             (length(lower(text)) - length(replace(lower(text), substr('{_LETTERS}', i + 1, 1), '')))::DOUBLE) AS n FROM documents),
u AS (SELECT doc_id, n, greatest(sqrt(list_reduce(list_transform(n, lambda x: x * x), lambda x, y: x + y)), 1e-12) AS s FROM c)
SELECT doc_id, 26 AS dim, round(n[1] / s, 9) AS first_value, round(n[5] / s, 9) AS e_value,
       round(list_reduce(list_transform(n, lambda x, i: x / s * i), lambda x, y: x + y), 6) AS weighted, md5(text) AS text_md5
FROM u JOIN documents USING (doc_id)
""")
def encoder_export(spark, sf):
    """Every document through a user encoder in batches, exported as vectors and read back."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    v = encode.encode_texts(d, encode.letter_encoder(_LETTERS), ["doc_id"], "text", batch=64)
    out = v.join(d, "doc_id").select(C("doc_id").alias("idx"), F.array("lang").alias("tags"), C("text").alias("sentence"),
                                     C("vec").alias("txt_out"), C("vec").alias("raw_out"))
    path = scratch_path(spark, "vectors")
    sinks.write_vectors(out, path)
    back = spark.read.parquet(path)
    weighted = V.vsum(F.transform("raw_out", lambda x, i: x * (i + 1)))
    return back.select(C("idx").alias("doc_id"), F.size("txt_out").alias("dim"), F.round(C("txt_out")[0], 9).alias("first_value"),
                       F.round(C("txt_out")[4], 9).alias("e_value"), F.round(weighted, 6).alias("weighted"), F.md5("sentence").alias("text_md5"))


# -- O-123: results, history, run config and label map ----------------------------------------
@register("run_report", ops=("O-123", "O-58"), sql="""
SELECT 'results' AS part, 'c' || label AS name, round(avg(vec_id), 6) AS value FROM embeddings GROUP BY label
UNION ALL SELECT 'history', event_type, round(avg(value), 6) FROM events GROUP BY event_type
UNION ALL SELECT 'config', n, v FROM (VALUES ('patience', 3.0), ('temperature', 10.0)) t(n, v)
UNION ALL SELECT 'label_map', 'c' || label, (dense_rank() OVER (ORDER BY 'c' || label) - 1)::DOUBLE
          FROM (SELECT DISTINCT label FROM embeddings)
""")
def run_report(spark, sf):
    from styleframe.operators import classify
    e = table(spark, sf, "embeddings").withColumn("name", F.concat(F.lit("c"), C("label").cast("string")))
    results = e.groupBy("name").agg(F.round(F.avg("vec_id"), 6).alias("value"))
    history = table(spark, sf, "events").groupBy(C("event_type").alias("name")).agg(F.round(F.avg("value"), 6).alias("value"))
    labels = classify.label_map(e.select(F.array("name").alias("tags")), "tags")
    path = scratch_path(spark, "run")
    sinks.write_run(path, results, history, {"patience": 3.0, "temperature": 10.0}, labels)
    shapes = {"results": "name string, value double", "history": "name string, value double",
              "config": "name string, value string", "label_map": "label string, idx int"}
    out = None
    for part, schema in shapes.items():
        back = spark.read.schema(schema).json(f"{path}/{part}").toDF("name", "value")
        back = back.select(F.lit(part).alias("part"), "name", C("value").cast("double").alias("value"))
        out = back if out is None else out.unionByName(back)
    return out


# -- O-01 / O-02 / O-36 (long-window zst dump written by Spark tasks, read back) -----------------
@register("dump_roundtrip", ops=("O-01", "O-02", "O-36"), sql="""
SELECT lang AS subreddit, source AS author, count(*) AS n_comments,
       CAST(sum(('0x' || substr(md5(text), 1, 8))::BIGINT) AS BIGINT) AS text_sum
FROM documents WHERE text NOT IN ('[deleted]', '[removed]') AND length(text) >= 10
GROUP BY lang, source
""")
def dump_roundtrip(spark, sf):
    d = table(spark, sf, "documents").select(C("source").alias("author"), C("text").alias("body"),
                                             C("doc_id").cast("string").alias("id"),
                                             F.concat(F.upper("lang"), F.lit("_comments")).alias("dump"))
    path = scratch_path(spark, "dump")
    sinks.write_zst_json_lines(d, path, dump="dump")
    lines = dumps.read_dump(spark, path, long_window=True)
    c = corpus.drop_removed(dumps.parse_comments(lines), "body", "author", 10)
    digest = F.conv(F.substring(F.md5("body"), 1, 8), 16, 10).cast("bigint")
    return c.groupBy(dumps.subreddit_of("file").alias("subreddit"), "author").agg(
        F.count(F.lit(1)).alias("n_comments"), F.sum(digest).alias("text_sum"))


# -- O-14: per-city files ------------------------------------------------------------------------
@register("city_files", ops=("O-14", "O-48"), sql=f"""
WITH t AS (SELECT lang, doc_id, regexp_replace(replace(replace(translate(text, chr(9) || chr(10), '  '), chr(13), ''), chr(11), ' '),
                                              '^{WS}+|{WS}+$', '', 'g') AS t FROM documents),
l AS (SELECT lang, t, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS n FROM t WHERE length(t) > 0),
s AS (SELECT * FROM l WHERE lang IN ('fr', 'es')),
j AS (SELECT s.lang, s.t, coalesce(nullif(e.t, ''), nullif(m.t, '')) AS side FROM s
      LEFT JOIN l e ON e.lang = 'en' AND e.n = s.n LEFT JOIN l m ON m.lang = 'de' AND m.n = s.n)
SELECT CASE lang WHEN 'fr' THEN 'CAI' ELSE 'AMM' END AS city, CASE lang WHEN 'fr' THEN 'egy' ELSE 'jor' END AS dialect,
       CASE WHEN side IS NULL THEN 'monolingual' ELSE 'bitext' END AS type, count(*) AS n,
       CAST(sum(('0x' || substr(md5(t || '|' || coalesce(side, '')), 1, 8))::BIGINT) AS BIGINT) AS text_sum
FROM j WHERE length(t) >= 5 GROUP BY ALL
""")
def city_files(spark, sf):
    """Documents of four languages as the English, MSA and two cities' folders, aligned by line number."""
    from styleframe.functions.text import strip, tsv_safe
    from styleframe.operators.hierarchy import line_numbers
    names = {"en": "English", "de": "MSA", "fr": "CAI", "es": "AMM"}
    d = table(spark, sf, "documents").filter(C("lang").isin(*names))
    t = strip(F.replace(tsv_safe(C("text")), F.lit("\x0b"), F.lit(" ")))
    d = line_numbers(d.select("lang", "doc_id", t.alias("t")).filter(F.char_length("t") > 0), ["lang"], ["doc_id"])
    root = scratch_path(spark, "cities")
    city = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[C("lang")]
    corpora.write_city_folders(d.select(city.alias("city"), "line_no", C("t").alias("text")), root)
    s = corpora.load_city_folders(spark, root)
    digest = F.md5(F.concat(C("text"), F.lit("|"), F.coalesce("english", F.lit(""))))
    return s.groupBy("city", "dialect", "type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")).alias("text_sum"))


# -- O-35 (text form) / O-28 / O-29: instructions for monolingual rows --------------------------------
def echo_annotator(texts):
    """Deterministic stand-in for a remote annotator: the last line of the request, none for a long one."""
    return [None if len(t) > 3000 else ("q: " + t.rsplit("\n", 1)[-1][:60] if t.startswith("Ask") else "an answer with " + t.rsplit(": ", 1)[-1][:40])
            for t in texts]


@register("monolingual_instructions", ops=("O-35", "O-29", "O-33"), sql="""
SELECT dialect, count(*) AS n FROM (
  SELECT doc_id, lang AS dialect, text FROM documents WHERE length(text) BETWEEN 20 AND 1000)
GROUP BY dialect
""")
def monolingual_instructions(spark, sf):
    d = table(spark, sf, "documents").filter(F.char_length("text").between(20, 1000)).select(
        "doc_id", "text", C("lang").alias("dialect"), "source", F.lit("monolingual").alias("type"))
    out = instruct.monolingual_instructions(d, echo_annotator, ["doc_id"])
    return out.filter(C("prompt")[0]["content"].startswith("q: ")).groupBy("dialect").agg(F.count(F.lit(1)).alias("n"))


def _case(col: str, table: dict[str, str], default: str) -> str:
    """A fixed dictionary as a SQL CASE."""
    q = lambda v: "'" + v.replace("'", "''") + "'"
    return f"CASE {col} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {default} END"


_TOPICS = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in instruct.QUESTION_TOPICS) + "]"
_ASKED = _case("lang", {k: ", ".join(v) for k, v in instruct.QUESTION_WORDS.items()}, "'" + ", ".join(instruct.DEFAULT_QUESTION_WORDS) + "'")
_NAME = _case("lang", instruct.COUNTRY_TO_DIALECT_NAME, "'Arabic dialect (' || lang || ')'")


@register("monolingual_instructions_all", ops=("O-35", "O-29", "O-33"), sql=f"""
WITH d AS (SELECT lang AS dialect, text, {_NAME} AS name, {_ASKED} AS asked,
                  {_TOPICS}[CAST(floor({keyed.sql_uniform(42, "'topic'", 'doc_id')} * {len(instruct.QUESTION_TOPICS)}) AS BIGINT) + 1] AS topic
           FROM documents),
q AS (SELECT dialect, text, name, 'q: ' || left(string_split(text, chr(10))[-1], 60) AS question FROM d
      WHERE length('Ask one short question in ' || name || ' (not Modern Standard Arabic) about ' || topic ||
                   ' to which the text below is a natural answer. Use question words like ' || asked ||
                   '. Give the question only and do not repeat the text.' || repeat(chr(10), 2) || 'Text:' || chr(10) || text) <= 3000),
a AS (SELECT dialect, text, regexp_replace(question, '^{WS}+|{WS}+$', '', 'g') AS prompt,
             regexp_replace('an answer with ' || left(string_split(text, ': ')[-1], 40), '^{WS}+|{WS}+$', '', 'g') AS answer FROM q
      WHERE length('Answer in ' || name || ' only, in three to six sentences, the question: ' || question ||
                   chr(10) || 'Use this phrase in the answer: ' || text) <= 3000),
g AS (SELECT dialect, prompt, CASE WHEN length(answer) < 20 THEN text ELSE answer END AS answer FROM a WHERE length(prompt) >= 5)
SELECT dialect, count(*) AS n, CAST(sum(('0x' || substr(md5(prompt), 1, 8))::BIGINT) AS BIGINT) AS prompt_sum,
       CAST(sum(('0x' || substr(md5(answer), 1, 8))::BIGINT) AS BIGINT) AS answer_sum
FROM g GROUP BY dialect
""")
def monolingual_instructions_all(spark, sf):
    """Every document through both requests; the annotator alone drops rows (requests of over 3000 characters)."""
    d = table(spark, sf, "documents").select("doc_id", "text", C("lang").alias("dialect"), "source", F.lit("monolingual").alias("type"))
    out = instruct.monolingual_instructions(d, echo_annotator, ["doc_id"])
    digest = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")
    return out.groupBy("dialect").agg(F.count(F.lit(1)).alias("n"), F.sum(digest(C("prompt")[0]["content"])).alias("prompt_sum"),
                                      F.sum(digest(C("ground_truth"))).alias("answer_sum"))


# -- O-19: closed-set JSONL and its labels ---------------------------------------------------------------
@register("closed_set_roundtrip", ops=("O-19", "O-59"), sql="""
SELECT quality AS label, count(*) AS n, CAST(sum(('0x' || substr(md5(text), 1, 8))::BIGINT) AS BIGINT) AS text_sum,
       quality AS y, CAST(sum(CASE WHEN lang = 'en' THEN 0 WHEN lang = 'fr' THEN 1 ELSE 2 END) AS BIGINT) AS lang_sum
FROM documents JOIN labels USING (doc_id) GROUP BY quality
""")
def closed_set_roundtrip(spark, sf):
    from styleframe.operators import classify
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    path = scratch_path(spark, "closed-set")
    d.select("text", C("quality").alias("label")).write.mode("overwrite").json(path)
    back = entries.read_closed_set(spark, path)
    labels = classify.label_map(back.select(F.array(C("label").cast("string")).alias("tags")), "tags")
    back = classify.encode_labels(back.withColumn("tags", F.array(C("label").cast("string"))), labels, "tags")
    # languages beyond the two known ones are unseen labels: class K
    known = spark.createDataFrame([("en", 0), ("fr", 1)], "label string, idx int")
    seen = classify.encode_labels(d.select("quality", F.array("lang").alias("tags")), known, "tags", out="ly")
    seen = seen.groupBy(C("quality").alias("label")).agg(F.sum("ly").alias("lang_sum"))
    digest = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("bigint")
    return back.groupBy("label", "y").agg(F.count(F.lit(1)).alias("n"), F.sum(digest).alias("text_sum")).join(seen, "label")


# -- O-09 -------------------------------------------------------------------------------------------------
@register("pan_roundtrip", ops=("O-09",), sql=f"""
WITH l AS (SELECT lang, source, unnest(string_split(regexp_replace(text, chr(13) || chr(10), chr(10), 'g'), chr(10))) AS line
           FROM documents),
k AS (SELECT lang, source FROM l WHERE regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') <> '')
SELECT lang AS problem, CASE WHEN source IN ('src0', 'src1') THEN 'eval' ELSE 'train' END AS part,
       CASE WHEN source = 'src0' THEN 'true of ' || lang WHEN source = 'src1' THEN 'unknown' ELSE source END AS author,
       count(*) AS n_lines
FROM k GROUP BY ALL
""")
def pan_roundtrip(spark, sf):
    d = table(spark, sf, "documents")
    folder = F.when(C("source").isin("src0", "src1"), F.concat(F.lit("unknown_"), C("source"))) \
        .otherwise(C("source"))
    root = scratch_path(spark, "pan")
    rows = d.select(C("lang").alias("problem"), folder.alias("folder"), "text")
    # two writes: truth names a text by its file name, and one write uses a name in several folders
    for part in (C("folder") != "unknown_src1", C("folder") == "unknown_src1"):
        rows.filter(part).write.mode("append").partitionBy("problem", "folder").text(root)
    # truth for the texts of one folder of each problem, an outdated entry first
    names = spark.read.option("recursiveFileLookup", "true").text(root).select(F.col("_metadata.file_path").alias("p")).distinct()
    names = names.filter(C("p").contains("unknown_src0")).select(
        F.regexp_extract("p", "problem=([^/]*)", 1).alias("problem"), F.element_at(F.split("p", "/"), -1).alias("file"))
    both = F.array(*[F.struct(C("file").alias("unknown-text"), a.alias("true-author"))
                     for a in (F.lit("outdated"), F.concat(F.lit("true of "), C("problem")))])
    truth = names.groupBy("problem").agg(F.flatten(F.collect_list(both)).alias("ground_truth"))
    for r in truth.select("problem", F.to_json(F.struct("ground_truth")).alias("value")).collect():  # one short row per problem
        corpora.write_single_file(spark.createDataFrame([(r["value"],)], "value string"), f"{root}/problem={r['problem']}/ground-truth.json")
    train, ev = entries.read_pan(spark, root)
    problem = F.regexp_replace(F.element_at("tags", 1), "^problem=", "").alias("problem")
    t = train.select(problem, F.lit("train").alias("part"), F.regexp_replace(F.element_at("tags", 2), "^folder=", "").alias("author"))
    e = ev.select(problem, F.lit("eval").alias("part"), F.element_at("tags", 2).alias("author"))
    return t.unionByName(e).groupBy("problem", "part", "author").agg(F.count(F.lit(1)).alias("n_lines"))


# -- O-12 / O-18 ------------------------------------------------------------------------------------------
@register("fallback_rows", ops=("O-12",), sql=f"""
WITH c AS (SELECT conv_id, turn, role, text,
                  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations),
r AS (SELECT CASE WHEN turn % 2 = 0 THEN '' ELSE text END AS t1, text AS t2,
             CASE WHEN role = 'user' THEN coalesce(nt, '') ELSE '' END AS en FROM c),
s AS (SELECT regexp_replace(coalesce(nullif(t1, ''), nullif(t2, ''), ''), '^{WS}+|{WS}+$', '', 'g') AS text,
             regexp_replace(en, '^{WS}+|{WS}+$', '', 'g') AS en FROM r)
SELECT CASE WHEN length(en) > 5 THEN 'bitext' ELSE 'monolingual' END AS type, count(*) AS n,
       CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM s WHERE length(text) > 10 GROUP BY ALL
""")
def fallback_rows(spark, sf):
    c = instruct.with_next(table(spark, sf, "conversations"), "conv_id", "turn", {"text": "nt"})
    rows = c.select(F.when(C("turn") % 2 == 0, F.lit("")).otherwise(C("text")).alias("text"),
                    C("text").alias("sentence"),
                    F.when(C("role") == "user", F.coalesce("nt", F.lit(""))).otherwise(F.lit("")).alias("english"))
    s = corpora.load_fallback(rows)
    return s.groupBy("type").agg(F.count(F.lit(1)).alias("n"),
                                 F.sum(F.char_length("text")).cast("bigint").alias("n_chars"))


@register("variety_rows", ops=("O-18",), sql=f"""
WITH r AS (SELECT CASE role WHEN 'system' THEN 'MSA' WHEN 'user' THEN 'Egyptian' ELSE NULL END AS v,
                  text AS output, CASE WHEN conv_id % 3 = 0 THEN 'Egypt' WHEN conv_id % 3 = 1 THEN 'jordan'
                                       ELSE 'Narnia' END AS country FROM conversations),
s AS (SELECT regexp_replace(output, '^{WS}+|{WS}+$', '', 'g') AS text,
             CASE country WHEN 'Egypt' THEN 'egy' WHEN 'jordan' THEN 'jor' ELSE 'unknown' END AS dialect
      FROM r WHERE coalesce(v, 'MSA') <> 'MSA')
SELECT dialect, count(*) AS n FROM s WHERE length(text) > 10 GROUP BY dialect
""")
def variety_rows(spark, sf):
    c = table(spark, sf, "conversations")
    rows = c.select(F.when(C("role") == "system", "MSA").when(C("role") == "user", "Egyptian")
                    .alias("language_variety"), C("text").alias("output"), C("text").alias("instruction"),
                    F.when(C("conv_id") % 3 == 0, "Egypt").when(C("conv_id") % 3 == 1, "jordan")
                    .otherwise("Narnia").alias("country"))
    return corpora.load_variety_rows(rows).groupBy("dialect").agg(F.count(F.lit(1)).alias("n"))


# -- O-15 / O-16 ---------------------------------------------------------------------------------------------
@register("tsv_csv_loaders", ops=("O-15", "O-16"), sql=f"""
WITH d AS (SELECT doc_id, lang, regexp_replace(replace(translate(text, chr(9) || chr(10), '  '), chr(13), ''),
                                      '^{WS}+|{WS}+$', '', 'g') AS t FROM documents)
SELECT 'masc' AS source, CASE WHEN lang = 'en' THEN 'egy' ELSE 'unknown' END AS dialect, count(*) AS n
FROM d WHERE length(t) > 10 GROUP BY ALL
UNION ALL
SELECT 'saudial' AS source, 'sau' AS dialect, count(*) AS n FROM d WHERE length(t) >= 5
""")
def tsv_csv_loaders(spark, sf):
    from styleframe.functions.text import tsv_safe
    d = table(spark, sf, "documents").select("doc_id", "lang", tsv_safe(C("text")).alias("t"))
    p_tsv, p_csv = scratch_path(spark, "masc"), scratch_path(spark, "saudial")
    lab = F.when(C("lang") == "en", F.lit("EGY")).otherwise(F.upper("lang"))
    d.select(F.concat(lab, F.lit("\t"), C("t"))).write.mode("overwrite").text(p_tsv)
    d.select(C("lang").alias("Dialect"), C("t").alias("English Text"), C("t").alias("Dialect Translation")) \
        .write.mode("overwrite").option("header", True).option("escape", '"').csv(p_csv)
    # the texts hold no line breaks, so large files split
    a = corpora.load_sniffed_tsv(spark, p_tsv, multi_line=False)
    b = corpora.load_parallel_csv(spark, p_csv, multi_line=False)
    return a.unionByName(b).groupBy("source", "dialect").agg(F.count(F.lit(1)).alias("n"))


# -- O-39 (model form) ----------------------------------------------------------------------
@register("language_model", ops=("O-39",))
def language_model(spark, sf):
    """Train the char n-gram language model on documents with a known language
    and apply the predicate to all of them (rows kept per predicted language)."""
    from styleframe.operators import language
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.fit_language_model(checkpoint(d))
    kept = language.keep_predicted(corpus.drop_removed(d, "text", None, 10), model, ("en", "fr", "es"))
    p = language.predict_language(kept, model)
    return p.groupBy("lang", "pred_lang").agg(F.count(F.lit(1)).alias("n"))
