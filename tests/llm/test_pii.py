import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from styleframe.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        line = ",".join(f"{k}:{a}:{z}" for k, a, z in want)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), (t, line, got[i]["spans"])
        assert got[i]["spans"].startswith(line)
        for k in PLAIN:
            assert got[i][f"n_{k}"] == sum(x[0] == k for x in want)


HARD = [
    None, "", " ", "a@b.c", "x a@b.co_y@z.org. é\U0001f600 q@w.e", "a@b@c.de@f.gh", "a@b", "1.2.3.4.5.6.7.8", "1.2.3.256",
    "0001.002.3.4", "9" * 40, "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "+1 (555) 123-4567 x +49",
    "+1 ((((((((", "++12345678901", "+1234567890123456", "a" * 5000 + "@", "1." * 3000, "é" * 50 + "k@l.mn" + "😀" * 3 + "1.1.1.1",
    "+1 2  3.4.5.6@x.y 1 2", "1-2-3 4.5.6.7", "a.b-c%d+e_f@g-h.i-j.k--.l", "@@a@b.c@d.e", "4111 1111  1111 1111",
]


def test_base_spans_match_brute_force_on_hard_texts(spark):
    check(spark, HARD)


def test_base_spans_match_brute_force_on_random_texts(spark):
    texts = []

    @settings(max_examples=400, database=None, deadline=None)
    @given(st.text(alphabet="a1b2@.+-_ ()0é9\n", max_size=60))
    def draw(t):
        texts.append(t)

    draw()
    check(spark, texts)


def test_base_spans_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    check(spark, [r["text"] for r in rows])


def planted(n=40):
    """One entity in many contexts with its own word beside it, among ordinary texts."""
    names = "oak elm ash fir yew bay fig haw box may sloe pine".split()
    rows = [(i, f"{names[i % 12]}note {names[(i * 5) % 12]}word then Zorblax mail q.z@corp.example.com about {names[(i * 7) % 12]}thing", "en", "s") for i in range(12)]
    rows += [(100 + i, f"plain {names[i % 12]}word about {names[(i * 7) % 12]}thing then mail", "en", "s") for i in range(n)]
    return rows


def test_disclosing_terms_are_found_and_ordinary_ones_left(spark, make):
    docs = make(planted())
    base = pii.find_base(docs)
    terms = {r["t"]: r["full"] for r in pii.disclosing_terms(docs, base).collect()}
    assert terms == {"zorblax": True}
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    text = planted()[0][1]
    assert f"term:{text.index('Zorblax')}:{text.index('Zorblax') + 7}" in got[0]
    assert got[100] == ""


def test_copies_are_no_evidence(spark, make):
    rows = [(i, "same words here Zorblax mail q.z@corp.example.com end", "en", "s") for i in range(30)] + planted()[20:]
    docs = make(rows)
    assert pii.disclosing_terms(docs, pii.find_base(docs)).count() == 0


def test_sanitised_text(spark, make):
    docs = make(planted() + [(500, "card 4111 1111 1111 1111 not 4111 1111 1111 1112 at 10.0.0.1 or +1 (555) 123-4567", "en", "s"), (501, None, None, None)])
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert out[500] == "card <CARD> not 4111 1111 1111 1112 at <IP> or <PHONE>"
    assert "<EMAIL>" in out[0] and "Zorblax" not in out[0]
    assert out[501] == ""


def test_empty_table_and_repeats(spark, make):
    assert pii.find(make([]).limit(0)).count() == 0
    rows = [(1, "a@b.cd", "en", "s")] * 3 + [(None, "1.2.3.4", None, None)]
    got = sorted((r["doc_id"] or 0, r["spans"]) for r in pii.find(make(rows)).collect())
    assert got == [(0, "ip:0:7")] + [(1, "email:0:6")] * 3


@pytest.mark.parametrize("n", [3000])
def test_many_matches_in_one_text(spark, n):
    check(spark, [" ".join(f"u{i}@h{i}.org" for i in range(n))])


def test_no_python_in_the_plan(spark, make):
    plan = pii.find(make(planted()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_shuffled_terms_give_the_same(spark, make, monkeypatch):
    docs = make(planted() + planted()[:2])
    want = sorted(map(str, pii.find(docs).collect()))
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert sorted(map(str, pii.find(docs).collect())) == want
