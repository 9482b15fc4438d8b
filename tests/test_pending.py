"""Finished keys are dealt out over tasks, not held whole by each."""

from styleframe.operators import cues


def test_pending_does_not_broadcast_the_finished_keys(spark, tmp):
    spark.createDataFrame([(1, 0, "x"), (2, 1, "y")], "doc_id long, sent_idx int, other string").write.parquet(tmp + "/done")
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 1, "c"), (2, 1, "c"), (None, 1, "d"), (3, 0, None), (3, 0, None)], "doc_id long, sent_idx int, sentence string")
    rest = cues.pending(df, spark.read.parquet(tmp + "/done"), ["doc_id", "sent_idx"])
    rows = rest.collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, [r for r in df.collect() if (r[0], r[1]) not in {(1, 0), (2, 1)}]))
    assert "Broadcast" not in rest._jdf.queryExecution().executedPlan().toString()
