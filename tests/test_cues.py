"""Annotator response parsing and the batch annotator's failure path."""

from pyspark.sql import functions as F

from styleframe.operators import cues

NAMES = ["a", "b", "a"]


def test_parse_features_edge_rows(spark):
    rows = [
        (0, '{"features": {"a": 1, "b": 0}}'),
        (1, "{bad json"),
        (2, '{"other": {"a": 1}}'),
        (3, '{"features": {"b": 1}}'),             # missing key -> 0
        (4, '{"features": {"a": true, "b": false}}'),
        (5, '{"features": {"a": "1", "b": 0}}'),   # numeric string
        (6, '{"features": {"a": null, "b": 1}}'),  # null -> whole vector zero
        (7, '{"features": {"a": "yes", "b": 1}}'),  # non-numeric -> zero
    ]
    df = spark.createDataFrame(rows, "i int, r string")
    got = {r.i: r.v for r in df.select("i", cues.parse_features(F.col("r"), NAMES).alias("v")).collect()}
    assert got[0] == [1.0, 0.0, 1.0]
    assert got[1] == got[2] == [0.0, 0.0, 0.0]
    assert got[3] == [0.0, 1.0, 0.0]
    assert got[4] == [1.0, 0.0, 1.0]
    assert got[5] == [1.0, 0.0, 1.0]
    assert got[6] == [0.0, 0.0, 0.0]
    assert got[7] == [0.0, 0.0, 0.0]


def test_annotate_batches_and_failures(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 8)], "k int, sentence string")

    def flaky(texts):
        if any(len(t) == 3 for t in texts):
            raise RuntimeError("remote error")
        return [[float(len(t))] for t in texts]

    out = {r.k: (r.feature, r.ok) for r in
           cues.annotate(df.coalesce(1), flaky, ["k"], width=1, batch=2, tries=2, backoff=0.0).collect()}
    # batches of two in order: (1,2) ok, (3,4) fails -> zeros, (5,6) ok, (7) ok
    assert out[1] == ([1.0], True) and out[2] == ([2.0], True)
    assert out[3] == ([0.0], False) and out[4] == ([0.0], False)
    assert out[7] == ([7.0], True)


def test_surface_cues_literal_and_regex(spark):
    df = spark.createDataFrame([("¿Qué PASA aquí?!",), ("nooo... lol",)], "sentence string")
    names = [n for n, _ in cues.SURFACE_CUES]
    f = [r.feature for r in cues.surface_cues(df).collect()]
    d0, d1 = dict(zip(names, f[0])), dict(zip(names, f[1]))
    assert d0["contains_inverted_question_mark"] == 1.0 and d0["contains_all_caps_word"] == 1.0
    assert d0["contains_repeated_punctuation"] == 1.0 and d1["contains_ellipsis_..._or_…"] == 1.0
    assert d1["contains_letter_lengthening_هههه_يييي"] == 1.0 and d1["contains_laughter_token_هههه_هاها_lol"] == 1.0
    assert d1["contains_question_mark_?"] == 0.0
