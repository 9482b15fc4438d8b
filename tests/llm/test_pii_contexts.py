import random
import re

from styleframe.llm import pii
from tests.llm.test_pii import HARD, brute, planted

WORD = "[A-Za-z\x80-\U0010FFFF]+"


def beside(text, a, z):
    """The nearest words on either side of a span in the whole text."""
    left, right = re.findall(WORD, text[:a]), re.findall(WORD, text[z:])
    return left[::-1][:pii.CONTEXT], right[:pii.CONTEXT]


def test_contexts_are_those_of_the_whole_text(spark):
    rnd = random.Random(3)
    parts = ["Zorblax", "a@b.co", "4111 1111 1111 1111", "+1 (555) 123-4567", "1.2.3.4", "room 12", "\u00e9", "x", "-", "7", " " * 300, ", ", ". "]
    texts = [t for t in HARD if t] + ["Zorblax, room 12, card 4111 1111 1111 1111", "Zorblax: a@b.co, c@d.co, e@f.co", "Zorblax " + "- " * 500 + "a@b.co"]
    texts += ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 14))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = 0
    for r in pii.find_base(df).collect():
        want = brute(texts[r["id"]])
        got = [(k, s["a"], s["z"], re.findall(WORD, s["l"])[::-1][:pii.CONTEXT], re.findall(WORD, s["r"])[:pii.CONTEXT]) for k in pii.KINDS for s in r[k]]
        assert got == [(k, a, z, *beside(texts[r["id"]], a, z)) for k, a, z in want], texts[r["id"]]
        n += len(got)
    assert n > 300


def test_a_number_between_does_not_hide_a_term(spark, make):
    docs = make([(1, "Zorblax, room 12, card 4111 1111 1111 1111", "en", "s"), (2, "Zorblax: a@b.co, " + "- " * 200 + "c@d.eu", "en", "s")])
    got = {(r["e"], r["t"]) for r in pii.co_occurrences(pii.find_base(docs)).collect()}
    assert {("card:4111111111111111", "zorblax"), ("email:a@b.co", "zorblax"), ("email:c@d.eu", "zorblax")} <= got


def test_repeated_rows_count_alike_everywhere(spark, make):
    rows = planted()[:12] * 3 + planted()[12:] * 3
    docs = make([(None, *r[1:]) for r in rows])
    assert {r["t"]: r["full"] for r in pii.disclosing_terms(docs, pii.find_base(docs)).collect()} == {"zorblax": True}
