import importlib
import os
import sys
from collections import Counter

import corpus_pipeline
from styleframe.llm import decontaminate, langid, mixing, queries, simhash_dedup

from test_decontaminate import brute as brute_hits
from test_mixing import brute_mix, size
from test_simhash_dedup import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_matches_brute_force(spark):
    docs = queries.read(spark, SF, "documents")
    named = langid.predict(docs, langid.fit(docs)).select("row.*", "lang_pred", "score").collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in named if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE]
    comps = brute_components([(i, brute_fingerprint(t)) for i, t, _, _ in rows])
    rows = [r for r, c in zip(rows, comps) if r[0] == c]
    items = [(r["item_id"], r["text"]) for r in queries.read(spark, SF, "benchmark").collect()]
    dirty = {i for i, _ in brute_hits([r[:2] for r in rows], items)}
    rows = [r for r in rows if r[0] not in dirty]
    taken = brute_mix(rows)[2]
    want = Counter({r[0]: n // size(r[1]) for r, n in zip(rows, taken) if n})
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*COLUMNS, "shard", "slot"]
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == want
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_clean_documents_survive_the_filters(spark):
    docs = queries.read(spark, "/root/testdata/sf0.01", "documents")
    kept = corpus_pipeline.language_id(spark, docs, None)
    assert kept.count() >= 0.99 * docs.count()


def test_stages_take_edge_rows(spark, make, tmp_path):
    os.makedirs(tmp_path / "sf")
    spark.createDataFrame([(1, "one benchmark item with several words")], "item_id long, text string").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    rows = [(i, f"ordinary text number {i} with words " * 5, "en", "s") for i in range(30)]
    rows += [(None, None, None, None), (50, "", None, "s"), (51, "12345", "en", None), (52, "long words " * 50000, "en", "s"), rows[0], rows[0],
             (53, "one benchmark item with several words", "en", "t")]
    docs = make(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path / "sf"))
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert set(docs.columns) >= {*COLUMNS, "row", "fp"}
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not ids & {None, 50, 51, 53}
    empty = make([]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path / "sf")).count() == 0


def test_queries_are_registered_with_the_entry():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(queries.SQL) <= set(entry.oracle_sql())


def test_rest_of_the_library_does_not_import_the_subpackage():
    code = "import sys, styleframe.plans.registry as r; r.queries(); assert not any('styleframe.llm' in m for m in sys.modules)"
    import subprocess
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(corpus_pipeline.__file__))
    assert importlib.import_module("styleframe.llm") and decontaminate and mixing and simhash_dedup
