"""Large JSON array files, read as a stream in bounded memory.

A file that is one JSON array (of entries, or of users that are arrays of
comments) has no line to split at.  One task reads it in chunks and passes on
the text of one element after another; what it holds is a chunk and the element
that it is in.  The elements are parsed by Spark.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from styleframe.sources.dumps import CHUNK, file_values, opened

_QUOTED, _MARKS, _BRACKETS = (re.compile(p) for p in (rb'["\\\\]', rb'["\[\]{},]', rb'["\[\]{}]'))
#: rows, and bytes, of a batch that a task passes on
ROWS, BYTES = 4096, 4 << 20


def elements(chunks, depth: int = 1):
    """(positions, text) of the elements that lie inside ``depth`` nested arrays, from chunks of bytes.

    What lies less deep and is no array has no elements; an element that the file breaks off in is left out."""
    buf, at, start = bytearray(), 0, None
    opens: list[bytes] = []           # brackets around this place
    place = [0] * depth
    plain = 0                         # how many of them, from the outside, are arrays
    quoted = False
    for chunk in chunks:
        buf += chunk
        while True:
            find = _QUOTED if quoted else _BRACKETS if len(opens) > depth else _MARKS
            m = find.search(buf, at)
            if m is None:
                at = len(buf)
                break
            c, at = m.group(), m.end()
            if c == b"\\":            # and what it escapes
                if at == len(buf):
                    at -= 1
                    break
                at += 1
            elif c == b'"':
                quoted = not quoted
            elif c in b"[{":
                if c == b"[" and plain == len(opens):
                    plain += 1
                opens.append(c)
                if len(opens) == depth and plain == depth:
                    start, place[depth - 1] = at, 0
                elif len(opens) < depth and plain == len(opens):
                    place[len(opens) - 1] = 0
            else:
                level = len(opens)
                if level == depth and plain == depth:
                    text = bytes(buf[start:at - 1]).strip()
                    if text:
                        yield list(place), text
                    start = at if c == b"," else None
                if c == b",":
                    if 0 < level <= depth and plain == level:
                        place[level - 1] += 1
                elif opens:
                    opens.pop()
                    plain = min(plain, len(opens))
        cut = at if start is None else start
        del buf[:cut]
        at -= cut
        start = None if start is None else 0


def _element_rows(batches, depth: int, chunk: int):
    def out(name, rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.list_(pa.int64())),
             pa.array([r[1].decode("utf-8", "replace") for r in rows], pa.string())], names=["file", "at", "value"])

    for b in batches:
        for name, x in zip(b.column(0).to_pylist(), b.column(1)):
            rows, size = [], 0
            with opened(x, chunk) as f:
                for row in elements(iter(lambda: f.read(chunk), b""), depth):
                    rows.append(row)
                    size += len(row[1])
                    if len(rows) >= ROWS or size >= BYTES:
                        yield out(name, rows)
                        rows, size = [], 0
            if rows:
                yield out(name, rows)


def read_elements(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """(file, at, value): name of the file, positions in the nested arrays and JSON text of every element.

    A file is read by one task, whatever its size; its rows are dealt evenly after that."""
    files = spark.read.format("binaryFile").load(path)
    listed = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), file_values(files))
    rows = listed.mapInArrow(functools.partial(_element_rows, depth=depth, chunk=CHUNK), "file string, at array<bigint>, value string")
    return rows.hint("rebalance")
