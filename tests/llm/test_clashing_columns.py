"""Extra columns named like internal ones neither crash nor change a result, in any operator or stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from styleframe.llm import collocations, decontaminate, kdtree, langid, mixing, neighbours, pii, prefix_trie, sharding, simhash_dedup

NAMES = ("row", "h", "fp", "size", "taken", "copies", "threshold", "target", "source_size", "worded", "col", "hits", "_source",
         "_mix_source", "_mix_copies", "_mix_threshold", "_mix_size", "_mix_copy", "_size", "_gh", "_crc", "_shard", "_slot", "_lot",
         "_lk", "_ls", "_bk", "_bs", "_n", "_s2", "_l2", "_start", "slot", "shard", "score", "lang_pred", "held_out", "component_id",
         "fingerprint", "id", "th", "nr", "t", "e", "c", "_id", "_th", "word", "doc", "place", "gh", "key", "lo", "hi", "band")


@pytest.fixture(scope="module")
def tables(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(words[(i * j) % 10] for j in range(1, 12 + i % 7)) + f" mail{i}@example.org", ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], 5) for i in range(60)]
    rows += [(None, None, None, None, None), (61, "", "en", "a", 0), rows[3], rows[3]]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return plain, plain.select("*", *[F.lit(7).alias(n) for n in NAMES])


def key(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("op", [mixing.mix, sharding.shard, simhash_dedup.near_duplicates, pii.find,
                                lambda d: collocations.collocations(d, least=3)])
def test_operators(tables, op):
    plain, wide = tables
    assert key(op(wide)) == key(op(plain))


def test_mixed_and_sharded_keep_all_columns(tables):
    plain, wide = tables
    out = mixing.mixed(wide)
    assert out.columns == wide.columns
    assert key(out.select(plain.columns)) == key(mixing.mixed(plain))
    assert out.where("_mix_size <> 7 or row <> 7").count() == 0
    out = sharding.sharded(wide)
    assert out.columns == [c for c in wide.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert key(out.select(*plain.columns, "shard", "slot")) == key(sharding.sharded(plain))


def test_stages(spark, tables, tmp_path):
    _, wide = tables
    bench = spark.createDataFrame([(1, "some other words that stand in no text")], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, wide, str(tmp_path))
        assert set(out.columns) == set(wide.columns) and out.count() > 0


def test_clean(spark, tables):
    plain, wide = tables
    bench = spark.createDataFrame([(1, plain.where("doc_id = 7").first()["text"], 1)], "item_id long, text string, i int")
    out = decontaminate.clean(wide, bench)
    assert out.columns == wide.columns and key(out.select(plain.columns)) == key(decontaminate.clean(plain, bench))


def test_language_rows(tables):
    _, wide = tables
    out = langid.predict(wide, {"names": [], "net": None})
    assert out.select("row.*").columns == wide.columns


def test_vectors_and_turns(spark):
    names = [n for n in NAMES if n not in ("doc_id",)]
    extra = [F.lit(7).alias(n) for n in (*names, "vec", "query", "rank", "depth", "n", "ids")]
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(220)], "vec_id long, embedding array<double>")
    for op in (kdtree.top_products, neighbours.nearest):
        assert key(op(v.select("*", *extra), lambda i: i % 100 == 0)) == key(op(v, lambda i: i % 100 == 0))
    c = spark.createDataFrame([(i // 3, i % 3, "user", f"t {i % 4}") for i in range(90)], "conv_id long, turn int, role string, text string")
    assert key(prefix_trie.trie(c.select("*", *extra))) == key(prefix_trie.trie(c))
