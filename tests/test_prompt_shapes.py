"""Prompts stored as JSON text: lists of turns, plain, malformed and nested ones."""

import json

from pyspark.sql import functions as F

from styleframe.operators.instruct import normalise_prompt

CASES = [
    ('[{"role": "system", "content": "a"}, {"role": "user", "content": "b"}]', [("system", "a"), ("user", "b")]),
    ("plain text", [("user", "plain text")]),
    ('[{"role": "user", "content"', [("user", '[{"role": "user", "content"')]),
    ("[1, 2]", [("user", "[1, 2]")]),
    ("[]", [("user", "[]")]),
    ("", [("user", "")]),
    ('[{"role": "user", "content": "a"}, "b"]', [("user", '[{"role": "user", "content": "a"}, "b"]')]),
    ('{"role": "user"}', [("user", '{"role": "user"}')]),
    ('[{"content": "a"}, {"role": "assistant"}]', [("user", "a"), ("assistant", "")]),
    ('[{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]', [("user", "a\nb")]),
    ('[{"role": "user", "content": null}]', [("user", "")]),
    (None, None),
]


def test_prompt_shapes(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(CASES)], "i int, p string")
    got = {r.i: r.t for r in rows.select("i", normalise_prompt(F.col("p")).alias("t")).collect()}
    for i, (_, want) in enumerate(CASES):
        assert (None if got[i] is None else [(t.role, t.content) for t in got[i]]) == want, CASES[i]


def test_nested_content_keeps_its_text(spark):
    p = json.dumps([{"role": "user", "content": {"x": 1}}])
    got = spark.createDataFrame([(p,)], "p string").select(normalise_prompt(F.col("p")).alias("t")).first().t
    assert json.loads(got[0].content) == {"x": 1}
