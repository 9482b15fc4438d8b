"""Comment dumps: compressed JSON-lines scan, tolerant parse, author maps.

``read_dump`` uses Spark's own text scan (Hadoop zstd codec) by default.  Dumps
written with a long zstd window (up to 2^31) defeat that codec, so
``long_window=True`` lists the files with Spark and streams each in bounded
chunks from the shared storage through ``zstandard`` into Arrow batches of lines:
one task per file (a zstd frame is not splittable), rebalanced right after the
scan.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from styleframe.functions.text import WS

COMMENT_SCHEMA = T.StructType([
    T.StructField("author", T.StringType()), T.StructField("body", T.StringType()),
    T.StructField("id", T.StringType()), T.StructField("subreddit", T.StringType()),
])

AUTHOR_COMMENT = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("subreddit", T.StringType()),
])
AUTHOR_MAP = T.MapType(T.StringType(), T.ArrayType(AUTHOR_COMMENT))


def _trim_ws(c):
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


#: bytes of a file that its task reads at once
CHUNK = 1 << 20


def _file_system(path: str):
    """(file system, path in it) of a path as Spark lists it."""
    import urllib.parse

    import pyarrow.fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    scheme = "s3" if scheme in ("s3a", "s3n") else scheme
    return pyarrow.fs.FileSystem.from_uri(scheme + ":" + urllib.parse.quote(rest, safe="/:@"))


def _opens(path: str) -> bool:
    """Whether tasks can open files of this file system themselves."""
    import pyarrow

    try:
        fs, name = _file_system(path)
        fs.open_input_stream(name, compression=None).close()
        return True
    except (pyarrow.ArrowException, OSError, ValueError):
        return False


def opened(x, chunk: int = CHUNK):
    """Stream of an Arrow value of ``file_values``: a path, or the content of a file."""
    import io

    import pyarrow as pa

    if pa.types.is_binary(x.type) or pa.types.is_large_binary(x.type):
        return io.BytesIO(x.as_buffer())
    fs, path = _file_system(x.as_py())
    return fs.open_input_stream(path, compression=None, buffer_size=chunk)


def file_values(files: DataFrame) -> str:
    """The column of a binaryFile listing that tasks open: the path, or the content where they cannot open paths."""
    first = files.select("path").first()
    return "path" if first is None or _opens(first[0]) else "content"  # without the content it is a listing


def _zst_lines(batches, chunk: int):
    """(file, path or content) -> (file, value): the lines of zstd streams of any window size, in batches."""
    import io

    import pyarrow as pa
    import zstandard

    dctx = zstandard.ZstdDecompressor(max_window_size=2 ** 31)

    def out(name, lines):
        return pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(lines, pa.string())], names=["file", "value"])

    for b in batches:
        for name, x in zip(b.column(0).to_pylist(), b.column(1)):
            buf = []
            with opened(x, chunk) as f, dctx.stream_reader(f, read_size=chunk, read_across_frames=True) as r:
                for line in io.TextIOWrapper(r, encoding="utf-8", errors="replace", newline=""):
                    buf.append(line)
                    if len(buf) >= 8192:
                        yield out(name, buf)
                        buf = []
            if buf:
                yield out(name, buf)


def zst_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of compressed files under ``path``.  ``file`` is the ``dump`` folder if there is
    one (our sink's layout), else the file name.

    Spark lists the files (any scheme); a file is decompressed as a stream by one task, which opens it
    in the shared file system and holds ``CHUNK`` bytes of it and the zstd window, whatever its size.
    Only in stores that Python cannot open (viewfs, say) a file comes as one row of at most 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    name = F.col("dump").cast("string") if "dump" in files.columns else F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), file_values(files)).mapInArrow(functools.partial(_zst_lines, chunk=CHUNK), "file string, value string")


def read_dump(spark: SparkSession, path: str, long_window: bool = False,
              partitions: int | None = None) -> DataFrame:
    """Lines of compressed dumps, trimmed, blanks dropped (the last line is kept
    even without a final newline).  Adds ``file`` (the file name)."""
    if long_window:
        df = zst_lines(spark, path)
    else:
        df = spark.read.text(path).withColumn("file", F.col("_metadata.file_name"))
    df = df.select(_trim_ws(F.col("value")).alias("line"), "file").filter(F.col("line") != "")
    return df.repartition(partitions) if partitions else df.hint("rebalance")


def parse_comments(lines: DataFrame, schema: T.StructType = COMMENT_SCHEMA,
                   line: str = "line") -> DataFrame:
    """Tolerant JSON parse with a declared schema (never inferred).  Malformed
    lines (and JSON that is not an object) are dropped; missing fields -> ''."""
    s = T.StructType(schema.fields + [T.StructField("_bad", T.StringType())])
    p = lines.withColumn("_j", F.from_json(F.col(line), s, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = p.filter(F.col("_j").isNotNull() & F.col("_j._bad").isNull()
                  & F.trim(F.col(line)).startswith("{"))
    keep = [c for c in lines.columns if c != line]
    return ok.select(*keep, *[F.coalesce(F.col(f"_j.{f.name}"), F.lit("")).alias(f.name)
                              for f in schema.fields])


def subreddit_of(file_col="file") -> F.Column:
    """Prefix of the dump file name before the first '_', lower-cased."""
    c = F.col(file_col) if isinstance(file_col, str) else file_col
    return F.lower(F.split(c, "_").getItem(0))


def read_author_map(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Author-map JSON -> long (dialect, author, text, id, subreddit).

    Our sink writes one JSON object per line (a chunk of one author's
    comments), so lines are read in parallel.  ``whole_file=True`` reads a
    single pretty-printed object per file (the foreign format; one task per
    file).  Dialect = file name minus ``_data.json``, or the ``dialect``
    partition folder when present."""
    df = spark.read.text(path, wholetext=whole_file)
    has_part = "dialect" in df.columns
    fname = F.col("_metadata.file_name")
    dialect = F.col("dialect") if has_part else F.regexp_replace(fname, "(_data)?\\.json$", "")
    m = df.select(dialect.alias("dialect"), F.from_json("value", AUTHOR_MAP).alias("_m"))
    e = m.select("dialect", F.explode("_m").alias("author", "_cs"))
    return e.select("dialect", "author", F.explode("_cs").alias("_c")).select(
        "dialect", "author", F.col("_c.text").alias("text"), F.col("_c.id").alias("id"),
        F.col("_c.subreddit").alias("subreddit"))
