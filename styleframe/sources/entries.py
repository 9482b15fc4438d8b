"""Evaluation-entry sources: hierarchy JSON, flat entries, labelled TSV,
authorship folders, instruction / closed-set JSONL, prompt CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from styleframe.functions.text import strip as _strip
from styleframe.operators.instruct import MESSAGE, normalise_prompt
from styleframe.sources.json_arrays import read_elements

C = F.col

SENTENCE = T.StructType([
    T.StructField("text", T.ArrayType(T.StringType())),
    T.StructField("text_ids", T.ArrayType(T.IntegerType())),
    T.StructField("feature", T.ArrayType(T.DoubleType())),
    T.StructField("user", T.StringType()),
])
COMMENT_LINE = T.StructType([
    T.StructField("user", T.StringType()), T.StructField("comment_id", T.LongType()),
    T.StructField("sentences", T.ArrayType(SENTENCE)),
])
ENTRY = T.StructType([
    T.StructField("sentence", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("input_ids", T.ArrayType(T.IntegerType())),
    T.StructField("feature", T.ArrayType(T.DoubleType())),
])


def read_hierarchy(spark: SparkSession, path: str, nested_files: bool = False) -> DataFrame:
    """-> (dialect, user, comment, sent_idx, text, text_ids, feature[, split]).

    Our layout: JSON lines, one comment each, in dialect=/split= folders.
    ``nested_files``: the foreign layout, one JSON array users->comments->
    sentences per ``<dialect>.json`` file.  A file is read as a stream by one
    task, which holds one comment at a time (``json_arrays``)."""
    if not nested_files:
        df = spark.read.schema(COMMENT_LINE).json(path)
        extra = [c for c in ("split", "dialect") if c in df.columns]
        out = df.select(*extra, "user", C("comment_id").alias("comment"),
                        F.posexplode("sentences").alias("sent_idx", "_s"))
    else:
        cm = read_elements(spark, path, depth=2).select(
            F.regexp_replace("file", "\\.json$", "").alias("dialect"), C("at")[0].alias("_ui"), C("at")[1].cast("int").alias("comment"),
            F.from_json("value", T.ArrayType(SENTENCE)).alias("_ss"))
        out = cm.select("dialect", "comment", "_ui", F.posexplode("_ss").alias("sent_idx", "_s")) \
            .withColumn("user", F.coalesce(C("_s.user"), F.concat(F.lit("user_"), C("_ui").cast("string")))) \
            .drop("_ui")
    feat = F.when(F.size(C("_s.feature")) > 0, C("_s.feature"))
    return out.select(*[c for c in out.columns if c not in ("_s",)],
                      C("_s.text").alias("text"), C("_s.text_ids").alias("text_ids"),
                      feat.alias("feature"))


def read_entries(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """Flat entries; missing tags -> [] (ids stay null until encoded)."""
    if array_file:
        df = read_elements(spark, path).select(F.from_json("value", ENTRY).alias("_e")).filter("_e is not null").select("_e.*")
    else:
        df = spark.read.schema(ENTRY).json(path)
    return df.withColumn("tags", F.coalesce(C("tags"), F.array().cast("array<string>")))


def read_labelled_tsv(spark: SparkSession, path: str, multi: bool = True) -> DataFrame:
    """``text<TAB>label[,label...]`` lines: stripped before the tab split; lines
    with fewer than two fields dropped; tags = second field split on ','
    (or the whole field when ``multi`` is false)."""
    lines = spark.read.text(path).select(_strip(C("value")).alias("_l")).filter(C("_l") != "")
    parts = lines.select(F.split("_l", "\t", -1).alias("_p")).filter(F.size("_p") >= 2)
    tags = F.split(C("_p")[1], ",", -1) if multi else F.array(C("_p")[1])
    return parts.select(C("_p")[0].alias("sentence"), tags.alias("tags"))


def read_pan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Authorship folders ``problem/candidate/*.txt`` + ``problem/ground-truth.json``.

    Lines are stripped and numbered among non-blank lines of each file.
    Folders whose name contains 'unknown' (any case) are evaluation data,
    tagged [problem, true author or 'unknown', line_i]; others are training
    data tagged [problem, candidate, file, line_i]."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt") \
        .text(root, wholetext=True)
    p = F.col("_metadata.file_path")
    parts = F.split(p, "/")
    f = files.select(F.element_at(parts, -3).alias("problem"), F.element_at(parts, -2).alias("folder"),
                     F.element_at(parts, -1).alias("file"), "value")
    lines = F.filter(F.transform(F.split("value", "\r\n|\n|\r", -1), lambda x: _strip(x)),
                     lambda x: x != "")
    ex = f.select("problem", "folder", "file", F.posexplode(lines).alias("idx", "sentence"))
    tag_line = F.concat(F.lit("line_"), C("idx").cast("string"))
    is_unknown = F.lower(C("folder")).contains("unknown")
    gt_schema = T.StructType([T.StructField("ground_truth", T.ArrayType(T.StructType([
        T.StructField("unknown-text", T.StringType()), T.StructField("true-author", T.StringType())])))])
    # without truth files this scan is empty; a path that cannot be read fails like the one above
    gt_raw = spark.read.option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", "ground-truth.json").text(root, wholetext=True)
    gt = gt_raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("problem"),
                       F.posexplode(F.from_json("value", gt_schema)["ground_truth"]).alias("_at", "_g")) \
        .select("problem", "_at", C("_g")["unknown-text"].alias("file"), C("_g")["true-author"].alias("author"))
    # one row per (problem, file): the later entry of a duplicate wins, by its place in the file
    gt = gt.groupBy("problem", "file").agg(F.max_by("author", "_at").alias("author"))
    train = ex.filter(~is_unknown).select(
        "sentence", F.array("problem", "folder", "file", tag_line).alias("tags"))
    ev = (ex.filter(is_unknown).join(gt, ["problem", "file"], "left")
          .select("sentence", F.array("problem", F.coalesce("author", F.lit("unknown")), tag_line)
                  .alias("tags")))
    return train, ev


INSTRUCTION = T.StructType([
    T.StructField("prompt", T.StringType()), T.StructField("ground_truth", T.StringType()),
    T.StructField("dialect", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("type", T.StringType()),
])


def read_instructions(spark: SparkSession, path: str) -> DataFrame:
    """Instruction JSONL; ``prompt`` may be a list of turns or a plain string —
    read as raw JSON text and normalised to array<struct<role, content>>."""
    df = spark.read.schema(INSTRUCTION).json(path)
    return df.withColumn("prompt", normalise_prompt(C("prompt")))


def read_closed_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string, label int").json(path)


PROMPT_ALIASES = ("prompt", "Prompt", "text", "Text", "instruction", "input", "question")


def pick_column(columns: Sequence[str], explicit: str | None = None,
                aliases: Sequence[str] = PROMPT_ALIASES) -> str:
    """Explicit name, else the first alias present, else the first column
    (resolved once on the driver from the header: a static plan)."""
    if explicit and explicit in columns:
        return explicit
    for a in aliases:
        if a in columns:
            return a
    return columns[0]


def read_prompts(spark: SparkSession, path: str, column: str | None = None,
                 limit: int | None = None, order: str | None = None) -> DataFrame:
    """Prompts CSV (quoted newlines allowed) -> (prompt).  ``limit`` keeps the
    first n in the order of column ``order``, or as they stand in the files
    (files by path)."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    col = pick_column(df.columns, column)
    if limit is None:
        return df.select(C(col).alias("prompt"))
    # a file is one split here, and row numbers rise within it
    place = [C(order)] if order else [F.col("_metadata.file_path"), F.monotonically_increasing_id()]
    out = df.select(C(col).alias("prompt"), *[p.alias(f"_o{i}") for i, p in enumerate(place)])
    return out.orderBy(*[f"_o{i}" for i in range(len(place))]).limit(limit).select("prompt")


__all__ = ["read_hierarchy", "read_entries", "read_labelled_tsv", "read_pan", "read_instructions",
           "read_closed_set", "read_prompts", "pick_column", "MESSAGE"]
