"""The language model's n-gram counts are those of MLlib's tokenizer, NGram and HashingTF."""

from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer
from pyspark.sql import functions as F

from styleframe.operators import language

TEXTS = ["", "a", "ab", "abc", "the cat and the cat", "élève 中文字 ñandú", "smile \U0001f600\U0001f601 x", "aaaaaaaa", "\t tab  blanks ", "ß" * 40]


def test_counts_match_mllib(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    c = RegexTokenizer(inputCol="t", outputCol="c", pattern="", gaps=True, minTokenLength=1, toLowercase=False).transform(df)
    for n, size in ((3, 1 << 16), (2, 97)):
        g = NGram(n=n, inputCol="c", outputCol="g").transform(c)
        want = dict(HashingTF(inputCol="g", outputCol="f", numFeatures=size).transform(g).select("i", "f").collect())
        got = dict(language.CharGrams(inputCol="t", outputCol="f", numFeatures=size, n=n).transform(df).select("i", "f").collect())
        assert got == want
        for name in ("STRETCH", "TABLE"):              # texts cut into stretches; alphabets beyond the table
            monkeypatch.setattr(language, name, 5)
            o, index, count = language.count_grams(TEXTS, n, size)
            assert all(index[o[i]:o[i + 1]].tolist() == list(want[i].indices) and count[o[i]:o[i + 1]].tolist() == list(want[i].values) for i in want)
            monkeypatch.undo()


def test_predicate_counts_each_text_once(spark):
    rows = [(i, t * (1 + i % 3), lang) for i, (t, lang) in enumerate([("the cat and the dog ", "en"), ("le chat et le chien ", "fr"), ("der hund und die katze ", "de")] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language_model(df, features=1 << 10)
    kept = language.keep_predicted(df, model, ("en", "fr"))
    assert sorted(set(r["lang"] for r in kept.collect())) == ["en", "fr"] and kept.count() == 12
    plan = kept.groupBy("lang").agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
