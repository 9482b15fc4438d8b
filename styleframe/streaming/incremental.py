"""Structured Streaming forms of the incremental behaviours.

* only-new-files processing = a file source + a checkpoint (``availableNow``);
* the batch transforms (clean / filter / explode) apply to a streaming frame
  unchanged;
* running centroid and running counts = stateful streaming aggregates, written
  with ``foreachBatch`` as the groups that an epoch changed (idempotent on
  replay);
* progress output = ``foreachBatch`` keyed by the batch id, so a retried epoch
  rewrites its own folder instead of appending twice.

Checkpoints and outputs live under the shared scratch root.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from styleframe.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Stream of new files under ``path`` (never inferred: schema is given)."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def table_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                 max_files: int | None = None) -> DataFrame:
    """Stream of one table, be it a single file or a folder of part files.

    A file source takes a plain path as the base folder of partitions, so a single file is refused
    there; a glob that only this name matches has no base folder and lists either."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return file_stream(spark, f"{folder}/[{name[0]}]{name[1:]}", schema, fmt, max_files=max_files)


def run_incremental(stream: DataFrame, fn: Callable[[DataFrame], DataFrame], out: str,
                    checkpoint: str, fmt: str = "parquet") -> None:
    """Apply a stateless transform to everything new and append it to ``out``;
    the checkpoint remembers which files were done (re-running is a no-op)."""
    q = (fn(stream).writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out))
    q.awaitTermination()


def run_stateful(stream: DataFrame, agg: Callable[[DataFrame], DataFrame], out: str,
                 checkpoint: str) -> None:
    """A running aggregate in update mode: each epoch writes the groups that it
    changed under ``out/batch_id=<epoch>`` (a replayed epoch rewrites its own
    folder).  ``latest`` reads the current value of every group."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={epoch}")

    q = (agg(stream).writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest(spark: SparkSession, out: str, keys) -> DataFrame:
    """The value of each group in the last epoch that changed it."""
    df = spark.read.parquet(out)
    values = [c for c in df.columns if c not in (*keys, "batch_id")]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
            .select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values]))


def run_keyed_progress(stream: DataFrame, fn: Callable[[DataFrame], DataFrame], out: str,
                       checkpoint: str) -> None:
    """Append per-epoch results under ``out/batch_id=<epoch>`` (overwrite of that
    one folder), so a replayed epoch cannot duplicate rows."""
    def write(batch: DataFrame, epoch: int) -> None:
        fn(batch).write.mode("overwrite").parquet(f"{out}/batch_id={epoch}")

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def running_centroid(stream: DataFrame, vec: str = "embedding") -> DataFrame:
    """Streaming mean per dimension (partial/final state per dim)."""
    return (stream.select(F.posexplode(vec).alias("dim", "_x"))
            .groupBy("dim").agg(F.avg(F.col("_x").cast("double")).alias("mean"),
                                F.count(F.lit(1)).alias("n")))


def running_counts(stream: DataFrame, keys) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def scratch_pair(spark: SparkSession, name: str) -> tuple[str, str]:
    return scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
