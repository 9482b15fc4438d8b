"""Instructions of monolingual rows: every document goes through both requests."""

import hashlib

import __spark_entry__ as E
from styleframe.operators import instruct
from styleframe.plans.extra_q import echo_annotator

SF = "/root/testdata/sf0.001"


def test_texts_of_any_length_are_asked(spark):
    texts = ["", "short", "x" * 1500 + "\nthe last line", "y" * 1001, "z" * 4000]
    rows = [(i, t, "egy", "s", "monolingual") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, dialect string, source string, type string")
    got = {r.doc_id: (r.prompt[0].content, r.ground_truth) for r in instruct.monolingual_instructions(df, echo_annotator, ["doc_id"]).collect()}
    # the empty text gives no question, and the annotator has no answer to the longest request
    assert got == {1: ("q: short", "an answer with short"), 2: ("q: the last line", "an answer with " + "x" * 40),
                   3: ("q: " + "y" * 60, "an answer with " + "y" * 40)}


def test_query_holds_long_documents_and_compares_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()
    got = {r.dialect: r for r in E.queries()["monolingual_instructions_all"](spark, SF).collect()}
    # requests add less than 500 characters: texts of up to 2500 are all answered
    surely = [d for d in docs if 20 <= len(d.text) <= 2500 and d.text.split("\n")[-1].strip()]
    assert any(len(d.text) > 1000 for d in surely)
    for lang, r in got.items():
        mine = [d.text for d in surely if d.lang == lang]
        assert r.n >= len(mine) > 0
        least = sum(int(hashlib.md5(("q: " + t.split("\n")[-1][:60]).strip().encode()).hexdigest()[:8], 16) for t in mine)
        assert r.prompt_sum >= least
