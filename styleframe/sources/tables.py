"""The driver's Parquet tables: one file per table under an sf directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Small-input guard: a scan with fewer partitions than the session's
    parallelism (e.g. one Parquet row group read by one task) is spread
    round-robin so CPU-heavy text work uses every core.  Large inputs already
    have more splits than cores and are left alone (no shuffle)."""
    sc = df.sparkSession.sparkContext
    if df.rdd.getNumPartitions() < sc.defaultParallelism:
        return df.repartition(sc.defaultParallelism)
    return df


def table(spark: SparkSession, sf_dir: str, name: str, spread_small: bool = True) -> DataFrame:
    """Lazy Parquet scan; Catalyst prunes columns and pushes filters into it."""
    if name not in TABLES:
        raise KeyError(name)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if spread_small else df
