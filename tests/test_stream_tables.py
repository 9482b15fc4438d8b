"""Streams read a table that is a folder of part files like one that is a single file."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLE = {"stream_sentences": "documents", "stream_counts": "documents", "stream_centroid": "embeddings", "stream_progress": "conversations"}


@pytest.mark.parametrize("name", sorted(TABLE))
def test_table_as_a_folder(spark, tmp, name):
    spark.read.parquet(f"{SF}/{TABLE[name]}.parquet").repartition(3).write.parquet(f"{tmp}/{TABLE[name]}.parquet")
    got, want = (sorted(map(repr, E.queries()[name](spark, sf).collect())) for sf in (tmp, SF))
    assert got == want and len(got) > 10
