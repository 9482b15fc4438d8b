"""Plan shape and hot-key behaviour: one key holding a third of all rows."""

from pyspark.sql import functions as F

from styleframe.operators import corpus, hierarchy, sampling


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _hot_docs(spark, n=3000):
    # source 'hot' holds a third of the rows
    return spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), (F.col("id") % 50).cast("string")))
        .alias("source"),
        F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"),
        F.concat(F.lit("one two three four five six. seven eight nine ten eleven! doc "),
                 F.col("id").cast("string")).alias("text"))


def test_top_k_windows_are_partial_before_the_shuffle(spark):
    users = _hot_docs(spark).select("lang", "source").distinct()
    assert "WindowGroupLimit" in _plan(corpus.split_users(users, test=2, dev=2, train=3))
    s = _hot_docs(spark).withColumnRenamed("lang", "dialect")
    assert "WindowGroupLimit" in _plan(sampling.cap_per_source(s, cap=10, targets=("en",), key=("doc_id",)))


def test_hot_user_counts_match_brute_force(spark):
    docs = _hot_docs(spark)
    got = {(r.lang, r.split): (r.n_users, r.n_comments, r.n_sentences) for r in
           corpus.split_counts(corpus.to_comments(docs, min_comments=None), min_comments=2,
                               test=1, dev=1, train=3).collect()}
    pdf = docs.toPandas()
    per_user = pdf.groupby(["lang", "source"]).size()
    assert sum(v[0] for k, v in got.items() if k[1] == "pretrain") + \
        sum(v[0] for k, v in got.items() if k[1] in ("test", "dev")) == len(per_user)
    assert sum(v[2] for k, v in got.items() if k[1] != "train") == 2 * len(pdf)


def test_range_partitioning_spreads_a_hot_group(spark):
    df = _hot_docs(spark, 6000).select("source", "doc_id", F.lit(1).alias("w"))
    ranged = df.repartitionByRange(8, "source", "doc_id")
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 0.25 * sum(sizes)          # the hot third is split over tasks
    off = hierarchy.prefix_offsets(df, ["source", "doc_id"], "w", out="start", partitions=8)
    assert off.agg(F.max("start")).first()[0] == 5999
