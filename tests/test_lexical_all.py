"""Models fitted on labelled documents score all documents, unknown terms included."""

from pyspark.sql import functions as F

from styleframe.operators import lexical


def test_saved_model_scores_unlabelled_documents(spark, tmp):
    rows = [(i, "good fine nice" if i % 2 else "bad ugly poor", float(i % 2)) for i in range(20)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label double")
    vocab = lexical.fit_tfidf(lexical.char_ngrams(train), docs=train.select("doc_id"))
    data = lexical.document_vectors(train, vocab).join(train.select("doc_id", "label"), "doc_id")
    models = {"a": lexical.fit_lexical(data, max_iter=20), "b": lexical.fit_lexical(data.withColumn("label", 1 - F.col("label")), max_iter=20)}
    lexical.save_lexical(tmp + "/m", vocab, models)
    vocab, models = lexical.load_lexical(spark, tmp + "/m", ("a", "b"))
    new = spark.createDataFrame([(100, "a nice good text"), (101, "poor and bad"), (102, "\u4e00\u4e01"), (103, "")], "doc_id long, text string")
    vec = lexical.document_vectors(new, vocab)
    got = {k: {r.doc_id: r.prediction for r in m.transform(vec).collect()} for k, m in models.items()}
    assert set(got["a"]) == {100, 101, 102, 103}
    assert (got["a"][100], got["a"][101], got["b"][100], got["b"][101]) == (1, 0, 0, 1)
    assert {r.doc_id: r.features.numNonzeros() for r in vec.collect() if r.doc_id > 101} == {102: 0, 103: 0}


def test_training_vectors_equal_document_vectors(spark):
    """Blocks of n-grams give each row of a document and of its labels the document's vector; a missing label drops out."""
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "a cat"), (2, "a dog"), (3, None), (4, "zzz"), (None, "cat")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (2, 1, 0), (3, None, 1), (4, 0, None), (9, 1, 1), (None, 1, 1)], "doc_id long, a int, b int")
    train = docs.where("doc_id < 4")
    vocab = lexical.fit_tfidf(train, docs=train.select("doc_id"))
    blocks = lexical.training_ngrams(docs, labels, vocab)
    vec = {r.doc_id: r.features for r in lexical.document_vectors(docs, vocab).collect()}
    assert vec[None].numNonzeros() == vec[3].numNonzeros() == 0 < vec[2].numNonzeros()
    for y, want in (("a", [(1, 0), (1, 1), (2, 1), (2, 1), (4, 0)]), ("b", [(1, 1), (2, 0), (2, 0), (3, 1)])):
        got = lexical.training_vectors(blocks, docs, labels, vocab, y).collect()
        assert sorted((r.doc_id, r.label) for r in got) == want
        assert all(r.features == vec[r.doc_id] for r in got)


def test_vectors_are_neither_shuffled_nor_written(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "a cat")], "doc_id long, text string")
    vocab = lexical.fit_tfidf(docs, docs=docs.select("doc_id"))
    from pyspark.sql.readwriter import DataFrameWriter
    monkeypatch.setattr(DataFrameWriter, "parquet", None)
    plan = lexical.document_vectors(docs, vocab)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Exchange" not in plan
