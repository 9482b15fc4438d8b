"""Registered queries of the training-data operators, and their DuckDB SQL.

Each runs its operator with production parameters over its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from styleframe.llm import (chat, collocations, decontaminate, kdtree, langid, licenses, mixing, neighbours, pii, prefix_trie,
                            quality, sharding, simhash_dedup)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(doc_id: str, n: int):
    """crc32 of the id as text, modulo n (a null id counts as an empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = remainder("doc_id", 3) == 1
    model = langid.fit(docs.where(~held))
    out = langid.predict(docs.select("doc_id", "text", held.alias("held_out")), model)
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read(spark, sf_dir, "conversations"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    model = quality.fit(docs, read(spark, sf_dir, "labels").where(~held))
    out = quality.score(docs.select("doc_id", "text", held.alias("held_out")), model)
    return out.select("row.doc_id", "row.held_out", "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op11_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_products(read(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_chat, op3_neighbours, op4_decontamination, op5_sharding, op6_quality, op7_licenses, op8_mixing, op9_simhash_dedup, op10_pii,
    op11_kdtree, op12_prefix_trie, op13_collocations, pipeline)}
SQL = {"op2_chat": chat.SQL, "op8_mixing": mixing.SQL, "op11_kdtree": kdtree.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_collocations": collocations.SQL}
