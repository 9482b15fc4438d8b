"""Disclosing terms at all levels of generality against a plain Python count."""

import math
import random
import re
from collections import defaultdict

from styleframe.llm import pii
from tests.llm.test_pii import brute
from tests.llm.test_pii_contexts import WORD, beside


def names(kind, value):
    """kind:value, kind/group, kind."""
    v = re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower()
    group = {"email": lambda: v.split("@")[-1], "ip": lambda: ".".join(v.split(".")[:2]), "card": lambda: v[:6], "phone": lambda: v[:4]}[kind]()
    return [f"{kind}:{v}", f"{kind}/{group}", kind]


def terms_of(texts):
    """term -> whether it discloses some entity fully, by plain counting."""
    held, with_term = defaultdict(set), defaultdict(set)
    both, contexts = defaultdict(set), defaultdict(set)
    for i, text in enumerate(texts):
        for w in re.findall(WORD, text.lower()):
            if len(w) >= pii.LETTERS:
                with_term[w].add(i)
        for kind, a, z in brute(text):
            left, right = beside(text, a, z)
            near = tuple(w.lower() for w in left + right)
            for e in names(kind, text[a:z]):
                if any(len(w) >= pii.LETTERS for w in near):
                    held[e].add(i)
                for w in near:
                    if len(w) >= pii.LETTERS:
                        both[e, w].add(i)
                        contexts[e, w].add(near)
    out = {}
    for (e, w), at in both.items():
        ic = math.log2(len(texts) / len(held[e]))
        given = len(at) / len(with_term[w])
        if len(contexts[e, w]) >= pii.SUPPORT and ic > 0 and math.log2(given) + ic >= ic / pii.ALPHA:
            out[w] = out.get(w, False) or given >= 1
    return out


def corpus(seed, n=400):
    rnd = random.Random(seed)
    plain = [f"{a}{b}" for a in ("oak", "elm", "ash", "fir", "yew") for b in ("word", "note", "leaf", "root", "bark")]
    rows = []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(12)]
        if i % 5 == 0:  # no value twice; the word beside it belongs to its domain, its network or its kind
            x = rnd.randint(0, 3)
            words[4:6] = [["Zorblax", f"u{i}@zorb.example"], ["Netward", f"10.9.{i % 200}.{i % 7}"],
                          ["Ringup", f"+1 (555) 12{i % 10}-4{i:03d}"], ["Postbox", f"v{i}@h{i}.example"]][x]
        elif i % 9 == 0:
            words[3] = rnd.choice(["ringup", "postbox"])  # not always beside one
        rows.append(" ".join(words))
    return rows


def test_terms_equal_a_plain_count(spark, make):
    found = set()
    for seed in (1, 2):
        texts = corpus(seed)
        docs = make([(i, t, "en", "s") for i, t in enumerate(texts)])
        got = {r["t"]: r["full"] for r in pii.disclosing_terms(docs, pii.find_base(docs)).collect()}
        want = terms_of(texts)
        assert got == want
        found |= set(want)
        spans = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
        for i, t in enumerate(texts):
            terms = [f"term:{m.start()}:{m.end()}" for m in re.finditer(WORD, t) if m.group().lower() in want]
            assert spans[i] == ",".join([f"{k}:{a}:{z}" for k, a, z in brute(t)] + terms)
    # no value stands twice, so these come from a domain and a network; ordinary words are left
    assert {"zorblax", "netward"} <= found
    assert not any(w.endswith(("word", "note", "leaf", "root", "bark")) for w in found)


def test_a_kind_in_every_document_discloses_nothing(spark, make):
    docs = make([(i, f"{w} plain Contact u{i}@h{i}.example", "en", "s") for i, w in enumerate("oak elm ash fir yew bay".split())])
    assert pii.disclosing_terms(docs, pii.find_base(docs)).count() == 0


def test_sanitise_by_shuffled_terms_equals_broadcast(spark, make, monkeypatch):
    docs = make([(i, t, "en", "s") for i, t in enumerate(corpus(3, 100))])
    want = sorted(map(str, pii.sanitise(docs).collect()))
    assert not any("Zorblax" in r for r in want)
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert sorted(map(str, pii.sanitise(docs).collect())) == want
