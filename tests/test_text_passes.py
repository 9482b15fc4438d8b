"""Texts are cut and stripped once, without a regex at every place, and short sides never have comments shuffled."""

import json

from pyspark.sql import functions as F

from styleframe.functions import text as tx
from styleframe.operators import corpus
from styleframe.plans.corpus_q import comments
from styleframe.sources import corpora, entries, sinks

SF = "/root/testdata/sf0.001"
EDGES = ["", " ", "　  a b \x85\xa0", "a\t", "\x1c\x1fé\x0b\r\n", "no edges", "​kept​", "\n\n", "a  b ", "x "]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strip_and_safe_text(spark, tmp):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*EDGES, None])], "i int, t string")
    got = df.select("i", tx.strip("t").alias("s"), tx.tsv_safe("t").alias("f"), tx.flatten_newlines("t").alias("n"),
                    F.translate(F.translate("t", "\t\n", "  "), "\r", "").alias("f0"), F.translate("t", "\r\n", "  ").alias("n0"),
                    F.regexp_replace("t", f"^{tx.WS}+|{tx.WS}+$", "").alias("s0")).orderBy("i").collect()
    assert [r["s"] for r in got[:-1]] == [t.strip() for t in EDGES]
    assert all((r["s"], r["f"], r["n"]) == (r["s0"], r["f0"], r["n0"]) for r in got)
    df.select(F.lit("a\tb")).write.text(tmp + "/tsv")
    df.select(F.lit("CAI").alias("city"), F.lit("1\tb").alias("value")).write.partitionBy("city").text(tmp + "/cities")
    for read in (entries.read_labelled_tsv(spark, tmp + "/tsv"), corpora.load_city_folders(spark, tmp + "/cities")):
        assert "regexp_replace" not in _plan(read)


def test_cleaned_texts_with_odd_whitespace(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(tx.clean_text(F.col("t"))).collect()]
    assert got == [" ".join(t.split()) for t in EDGES]


def test_each_text_is_cut_once(spark):
    df = spark.createDataFrame([(1, "one two three four five. six seven eight nine ten!", 1), (2, "one two three four five.", 2), (3, None, 3)],
                               "doc_id long, text string, z int")
    c = corpus.require_sentences(corpus.with_sentences(df).drop("text"), 2)
    assert c.columns == ["doc_id", "z", "sentences"] and [r["doc_id"] for r in c.collect()] == [1]
    assert _plan(c).count("split(") == 1


def test_comments_are_not_shuffled_by_user(spark):
    plan = comments(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_hierarchy_lines(spark, tmp):
    rows = [("d1", "u", 7, 1, ["b", '"q"'], [0.0, 1.0]), ("d1", "u", 7, 0, ["é\n"], None), ("d1", None, 8, 0, None, []), ("d2", "v", None, 0, ["x"], [2.5])]
    df = spark.createDataFrame(rows, "lang string, source string, doc_id long, sent_idx int, text array<string>, feature array<double>")
    sinks.write_hierarchy(df, tmp + "/h", split=None)
    got = [json.loads(r[0]) for r in spark.read.text(tmp + "/h").select("value").collect()]
    want = [{"user": "u", "comment_id": 7, "sentences": [{"text": ["é\n"]}, {"text": ["b", '"q"'], "feature": [0.0, 1.0]}]},
            {"comment_id": 8, "sentences": [{"feature": []}]}, {"user": "v", "sentences": [{"text": ["x"], "feature": [2.5]}]}]
    assert sorted(map(str, got)) == sorted(map(str, want))
    back = entries.read_hierarchy(spark, tmp + "/h").orderBy("dialect", "comment", "sent_idx").collect()
    assert [(r["user"], r["comment"], r["sent_idx"], r["text"], r["feature"]) for r in back] == [
        ("u", 7, 0, ["é\n"], None), ("u", 7, 1, ["b", '"q"'], [0.0, 1.0]), (None, 8, 0, None, None), ("v", None, 0, ["x"], [2.5])]
    nested = sinks._nest_with(df, [], "lang", "source", "doc_id", ["text", "feature"])
    assert nested.columns == ["lang", "value"] and dict(nested.dtypes)["value"] == "string"
