"""Sinks.  Every row written is bounded: nested output stops at a comment, and
an author's comments are spread over chunk lines of about ``chunk`` comments
(so an author holding a third of the corpus is many lines, not one)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleframe.functions import keyed
from styleframe.functions.text import tsv_safe

C = F.col


def write_author_map(df: DataFrame, path: str, dialect: str = "dialect", author: str = "author",
                     chunk: int = 1000, seed: int = 42) -> None:
    """``{author: [{text, id, subreddit}, ...]}`` JSON lines under
    ``path/dialect=<d>/``; plus ``path/_stats`` (dialect, author, n) per file.

    The chunk of a comment is a keyed draw in [0, ceil(n / chunk)), n being the
    author's comment count (a partial aggregate), so lines hold ~chunk comments."""
    counts = df.groupBy(dialect, author).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(C("_n") / F.lit(chunk))
    c = (df.join(counts, [dialect, author])
         .withColumn("_chunk", F.floor(keyed.uniform(seed, C("id"), C(author)) * parts)))
    items = F.collect_list(F.struct(C("text"), C("id"), C("subreddit")))
    lines = (c.groupBy(dialect, author, "_chunk").agg(items.alias("_cs"))
             .select(dialect, F.to_json(F.create_map(C(author), C("_cs"))).alias("value")))
    lines.write.mode("overwrite").partitionBy(dialect).text(path)
    (counts.withColumnRenamed("_n", "n_comments").orderBy(dialect, F.desc("n_comments"), author)
     .write.mode("overwrite").json(f"{path}/_stats"))


def write_hierarchy(sent: DataFrame, path: str, split: str | None = "split",
                    dialect: str = "lang", user: str = "source", comment: str = "doc_id",
                    fields=("text", "text_ids", "feature")) -> None:
    """Hierarchy as JSON lines, one per comment (user, comment, sentences[...]),
    under ``split=<s>/dialect=<d>/`` folders.

    A sentence becomes its JSON text before the shuffle: arrays of words and numbers are several times
    as large as rows that are sorted and spilled."""
    fields = [f for f in fields if f in sent.columns]
    keys = [split] if split else []
    rows = _nest_with(sent, keys, dialect, user, comment, fields)
    rows.withColumnRenamed(dialect, "dialect").write.mode("overwrite") \
        .partitionBy(*keys, "dialect").text(path)


def _nest_with(sent, keys, dialect, user, comment, fields):
    """(keys..., dialect, value): the JSON line of each comment, its sentences in order."""
    short = sent.select(*keys, dialect, user, comment, F.struct("sent_idx", F.to_json(F.struct(*fields)).alias("_j")).alias("_s"))
    sents = F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["_j"]), ",")
    head = F.to_json(F.struct(C(user).alias("user"), C(comment).alias("comment_id")))
    open_head = F.concat(F.substring(head, F.lit(1), F.char_length(head) - 1), F.when(F.char_length(head) > 2, ",").otherwise(""))
    return (short.groupBy(*keys, dialect, user, comment).agg(sents.alias("_l"))
            .select(*keys, dialect, F.concat(open_head, F.lit('"sentences":['), C("_l"), F.lit("]}")).alias("value")))


def write_entries(df: DataFrame, path: str) -> None:
    """Flat entries {sentence, tags, input_ids?, feature?} as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_instructions(train: DataFrame, val: DataFrame | None, path: str) -> None:
    """train.jsonl / val.jsonl folders plus the two-column (prompt,
    ground_truth) projection of train."""
    train.write.mode("overwrite").json(f"{path}/train")
    if val is not None:
        val.write.mode("overwrite").json(f"{path}/val")
    train.select("prompt", "ground_truth").write.mode("overwrite").json(f"{path}/train_trl")


def write_predictions_tsv(df: DataFrame, path: str, prompt: str = "prompt",
                          prediction: str = "prediction") -> None:
    """prompt<TAB>prediction with tabs/newlines made safe (header line)."""
    df.select(tsv_safe(C(prompt)).alias("prompt"), tsv_safe(C(prediction)).alias("prediction")) \
        .write.mode("overwrite").option("sep", "\t").option("header", True) \
        .option("quote", "").option("escape", "").csv(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Embedding export (idx, tags, sentence, txt_out, raw_out) as Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Result tables (metrics, history, run config, label map) as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_run(path: str, results: DataFrame, history: DataFrame, config: dict, labels: DataFrame) -> None:
    """A run's folder: ``results``, ``history``, ``config`` (name, JSON value) and ``label_map``."""
    import json

    spark = results.sparkSession
    rows = [(k, json.dumps(v)) for k, v in sorted(config.items())]
    for name, df in (("results", results), ("history", history), ("label_map", labels),
                     ("config", spark.createDataFrame(rows, "name string, value string"))):
        write_report(df, f"{path}/{name}")


# An empty skippable frame (magic number 0x184D2A50, size 0, little-endian).  All its bytes are ASCII.
ZST_SEPARATOR = "P*M\x18\x00\x00\x00\x00"


def write_zst_json_lines(df: DataFrame, path: str, dump: str | None = None, level: int = 3, long_window: bool = True) -> None:
    """JSON lines as zstd files under ``path`` (``path/dump=<d>/`` by the column ``dump``), written by
    Spark's own committer, so retries and any shared storage are safe.

    A task compresses each Arrow batch of lines into one frame.  Frames are rows of a text file whose
    line separator is an empty skippable frame, so every part file is a valid zstd stream."""
    import functools

    keep = [c for c in df.columns if c != dump]
    name = C(dump).cast("string") if dump else F.lit("all")
    lines = df.select(name.alias("dump"), F.to_json(F.struct(*keep), {"ignoreNullFields": "false"}).alias("line"))
    frames = lines.mapInArrow(functools.partial(_frames, level=level, window=27 if long_window else 0), "dump string, frame binary")
    rows = frames.select(C("frame").cast("string").alias("value"), *(["dump"] if dump else []))
    rows.write.mode("overwrite").partitionBy(*(["dump"] if dump else [])).text(path, lineSep=ZST_SEPARATOR)


def _frames(batches, level: int, window: int):
    import pyarrow as pa
    import pyarrow.compute as pc
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(level, window_log=window)
    for b in batches:
        for d in pc.unique(b.column(0)).to_pylist():
            mine = b.column(1).filter(pc.fill_null(pc.equal(b.column(0), d), d is None))
            data = "".join(x + "\n" for x in mine.to_pylist()).encode()
            frame = zstandard.ZstdCompressor(compression_params=params).compress(data)
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.string()), pa.array([frame], pa.binary())], names=["dump", "frame"])
