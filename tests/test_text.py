"""Text functions against a brute-force Python statement of the same rules."""

import re

from pyspark.sql import functions as F

from styleframe.functions import text as tx
from styleframe.operators import corpus

CASES = [
    "Visit http://a.b/c?d=1 now.&amp; done",
    "tab\there nbsp em　ideo  spaces ",
    "&copy &nbsp; &lt;b&gt; café &été; & alone",
    "  leading and trailing  ",
    "line\x1cseparator\x1fchars",
    "",
    "ÜBER laut!!! ¿qué? ¡sí! ... …",
    "urlhttp and https://x.y/z tail",
]


def py_clean(t):
    t = re.sub(r"http\S+", "URL", t)
    t = re.sub(r"&\w+;?", "", t)
    return " ".join(t.split()).strip()


def test_clean_matches_python_rules(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, t string")
    got = dict(df.select("i", tx.clean_text(F.col("t")).alias("c")).collect())
    for i, c in enumerate(CASES):
        assert got[i] == py_clean(c), (c, got[i])


def test_words_and_sentences(spark):
    df = spark.createDataFrame([(1, "One two three four five. Six seven!\nEight nine ten eleven twelve?? x")],
                               "doc_id long, text string")
    s = corpus.with_sentences(df, min_words=5).select("sentences").first()[0]
    pieces = [py_clean(p) for p in re.split(r"[.!?\n]+", df.first()["text"])]
    assert s == [p for p in pieces if len(p.split()) >= 5]
    w = df.select(tx.words(F.lit(" a b  c ")).alias("w")).first()["w"]
    assert w == " a b  c ".split()


def test_script_ratio_and_quotes(spark):
    df = spark.createDataFrame([("مرحبا abc",), ("hello",), ('"quoted"',), ("'x'",), ('"',)], "t string")
    r = df.select(tx.is_script(F.col("t")).alias("a"),
                  tx.strip_wrapping_quotes(F.col("t")).alias("q")).collect()
    assert [x.a for x in r] == [True, False, False, False, False]
    assert [x.q for x in r][2:] == ["quoted", "x", ""]


def test_tsv_safe(spark):
    df = spark.createDataFrame([("a\tb\nc\r\nd",)], "t string")
    assert df.select(tx.tsv_safe(F.col("t"))).first()[0] == "a b c d"
