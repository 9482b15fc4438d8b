"""Known n-grams as arrays, one row a document, equal the rows of (document, n-gram)."""

from pyspark.sql import functions as F

from styleframe.operators import lexical


def test_arrays_equal_rows(spark):
    rows = [(1, "The cat\tsat  on the mat"), (1, "a cat"), (2, None), (3, ""), (4, "ÉTÉ été 😀x"), (None, "the the"), (None, "cat"), (5, "zzz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tf = lexical.char_ngrams(docs)
    for size in (12, 1000):
        old, new = (lexical.fit_tfidf(x, max_features=size, docs=docs.select("doc_id")) for x in (tf, docs))
        assert {r.term: (r.idx, round(r.idf, 12)) for r in old.collect()} == {r.term: (r.idx, round(r.idf, 12)) for r in new.collect()}
        want = {(r.doc_id, r.idx): round(r.w, 12) for r in lexical.tfidf(tf, old).collect()}
        packed = lexical.tfidf(lexical.char_ngrams(docs, vocab=new), new)
        got = packed.select("doc_id", F.explode(F.arrays_zip("idx", "w")).alias("p")).select("doc_id", "p.*").collect()
        assert {(r.doc_id, r.idx): round(r.w, 12) for r in got} == want and len(got) == len(want) > 12


def test_query_makes_no_row_of_a_document_and_an_ngram(spark):
    import __spark_entry__ as E
    for name in ("char_ngram_tfidf", "char_ngram_tfidf_all"):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "substring" not in plan.lower()
