"""Lexical model queries: char n-gram TF-IDF (SQL oracle) and the logistic
regression on top of it (rows-only: an iterative optimiser)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from styleframe.functions.text import WS
from styleframe.operators import lexical
from styleframe.plans.registry import register
from styleframe.session import checkpoint, scratch_path
from styleframe.sources.tables import table

C = F.col
MAX_FEATURES = 80000
LABELS = {"quality": ("pred", "p1"), "toxic": ("toxic_pred", "toxic_p1")}


def train_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id")


def tfidf_weights(spark, sf):
    docs = train_docs(spark, sf)
    vocab = checkpoint(lexical.fit_tfidf(docs, max_features=MAX_FEATURES, docs=docs.select("doc_id")))
    return lexical.tfidf(lexical.char_ngrams(docs, vocab=vocab), vocab), vocab


def summary(w):
    """Number, sum and greatest of each document's weights."""
    total = F.aggregate("w", F.lit(0.0), lambda t, x: t + x)
    return w.select("doc_id", F.size("w").cast("bigint").alias("n_terms"), F.round(total, 6).alias("sum_w"), F.round(F.array_max("w"), 9).alias("max_w"))


@register("char_ngram_tfidf", ops=("O-100", "O-101", "O-102"), sql=f"""
WITH tr AS (SELECT d.doc_id, lower(d.text) AS t FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id),
w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(t, '{WS}+'), lambda x: x <> '')) AS word
      FROM tr),
wc AS (SELECT doc_id, ' ' || word || ' ' AS pw, count(*) AS c FROM w GROUP BY doc_id, word),
g1 AS (SELECT doc_id, c, pw, unnest(range(2, least(6, length(pw)) + 1)) AS n FROM wc),
g2 AS (SELECT doc_id, c, pw, n, unnest(range(1, length(pw) - n + 2)) AS o FROM g1),
tf AS (SELECT doc_id, substr(pw, o, n) AS term, sum(c) AS tf FROM g2 GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n FROM tr),
st AS (SELECT term, sum(tf) AS tot, count(*) AS df FROM tf GROUP BY term),
voc AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM st, nd
        ORDER BY tot DESC, term LIMIT {MAX_FEATURES}),
x AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN voc USING (term)),
nr AS (SELECT doc_id, greatest(sqrt(sum(w * w)), 1e-12) AS nn FROM x GROUP BY doc_id)
SELECT doc_id, count(*) AS n_terms, round(sum(w / nn), 6) AS sum_w, round(max(w / nn), 9) AS max_w
FROM x JOIN nr USING (doc_id) GROUP BY doc_id
""")
def char_ngram_tfidf(spark, sf):
    w, _ = tfidf_weights(spark, sf)
    return summary(w)


@register("char_ngram_tfidf_all", ops=("O-100", "O-101", "O-102"), sql=f"""
WITH al AS (SELECT doc_id, lower(text) AS t, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents),
w AS (SELECT doc_id, known, unnest(list_filter(regexp_split_to_array(t, '{WS}+'), lambda x: x <> '')) AS word FROM al),
wc AS (SELECT doc_id, known, ' ' || word || ' ' AS pw, count(*) AS c FROM w GROUP BY doc_id, known, word),
g1 AS (SELECT doc_id, known, c, pw, unnest(range(2, least(6, length(pw)) + 1)) AS n FROM wc),
g2 AS (SELECT doc_id, known, c, pw, n, unnest(range(1, length(pw) - n + 2)) AS o FROM g1),
tf AS (SELECT doc_id, known, substr(pw, o, n) AS term, sum(c) AS tf FROM g2 GROUP BY doc_id, known, term),
nd AS (SELECT count(*) AS n FROM al WHERE known),
st AS (SELECT term, sum(tf) AS tot, count(*) AS df FROM tf WHERE known GROUP BY term),
voc AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM st, nd ORDER BY tot DESC, term LIMIT {MAX_FEATURES}),
x AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN voc USING (term)),
nr AS (SELECT doc_id, greatest(sqrt(sum(w * w)), 1e-12) AS nn FROM x GROUP BY doc_id)
SELECT doc_id, count(*) AS n_terms, round(sum(w / nn), 6) AS sum_w, round(max(w / nn), 9) AS max_w
FROM x JOIN nr USING (doc_id) GROUP BY doc_id
""")
def char_ngram_tfidf_all(spark, sf):
    """The vocabulary of the labelled documents, saved and applied to the whole documents table."""
    train = train_docs(spark, sf)
    vocab = lexical.fit_tfidf(train, max_features=MAX_FEATURES, docs=train.select("doc_id"))
    path = scratch_path(spark, "lexical-vocabulary")
    lexical.save_lexical(path, vocab, {})
    vocab, _ = lexical.load_lexical(spark, path, ())
    w = lexical.tfidf(lexical.char_ngrams(table(spark, sf, "documents").select("doc_id", "text"), vocab=vocab), vocab)
    return summary(w)


def lexical_scores(spark, sf):
    """Fit TF-IDF and a model for each label (quality, toxic) on the labelled documents, save them,
    and score all documents by what was saved; the probability table is cached as Parquet in the
    shared scratch folder and read back (compute once, reuse)."""
    train = train_docs(spark, sf)
    vocab = F.broadcast(checkpoint(lexical.fit_tfidf(train, max_features=MAX_FEATURES, docs=train.select("doc_id"))))  # MAX_FEATURES rows
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    blocks = lexical.training_ngrams(docs, lab, vocab)
    sizes = docs.select("doc_id").join(lab, "doc_id").agg(*[F.count(y).alias(y) for y in LABELS]).first()
    models = {y: lexical.fit_lexical(lexical.training_vectors(blocks, docs, lab, vocab, y), "label", c=3.0, n=sizes[y]) for y in LABELS}
    path = scratch_path(spark, "lexical-model")
    lexical.save_lexical(path, vocab, models)
    _, models = lexical.load_lexical(spark, path, LABELS)
    scored = lexical.document_vectors(docs, vocab)
    for y, (pred, p1) in LABELS.items():
        scored = models[y].transform(scored).withColumn(pred, C("prediction").cast("int")) \
            .withColumn(p1, F.round(vector_to_array("probability")[1], 6)).drop("prediction", "probability", "rawPrediction")
    columns = [c for pair in LABELS.values() for c in pair]
    scored = scored.drop("features").join(lab.withColumnsRenamed({"quality": "label", "toxic": "toxic_label"}), "doc_id", "left")
    scored = scored.select("doc_id", "label", "toxic_label", *columns)
    path = scratch_path(spark, "lexical-proba")
    scored.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@register("lexical_lr", ops=("O-103", "O-114"))
def lexical_lr(spark, sf):
    return lexical_scores(spark, sf)
