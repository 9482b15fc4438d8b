"""Long-window dumps are streamed: a file of any size, never one row."""

import os
import random

import pytest
import zstandard

from styleframe.sources import dumps


def _frame(lines, level=3, **kw):
    params = zstandard.ZstdCompressionParameters.from_level(level, window_log=27, **kw)
    return zstandard.ZstdCompressor(compression_params=params).compress("".join(x + "\n" for x in lines).encode())


def _write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


@pytest.fixture()
def small(spark, monkeypatch):
    """The largest file that Spark takes as one row, and a chunk, small."""
    conf = {"spark.sql.sources.binaryFile.maxLength": "1000", "spark.sql.files.maxPartitionBytes": "20000"}
    monkeypatch.setattr(dumps, "CHUNK", 1000)
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_frames_larger_than_a_chunk(spark, tmp, small):
    rnd = random.Random(7)
    want = {}
    for name in ("a_RC.zst", "b_RC.zst"):
        lines = ["%064x" % rnd.getrandbits(256) for _ in range(6000)]
        want[name] = lines
        data = b"".join(_frame(lines[i:i + 2000]) for i in range(0, 6000, 2000))
        assert len(data) > 150_000        # a frame is over 50 kB, far more than a chunk or a row may hold
        _write(f"{tmp}/d/{name}", data)
    got = {}
    for r in dumps.read_dump(spark, f"{tmp}/d", long_window=True).collect():
        got.setdefault(r.file, []).append(r.line)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_skippable_frames_and_odd_names(spark, tmp, small):
    skip = lambda body: b"\x50\x2a\x4d\x18" + len(body).to_bytes(4, "little") + body
    files = {"a b%20c.zst": skip(b"\n\n\r\n") + _frame(["one", "two"]) + skip(b"\r\n\n"), "empty.zst": b"", "blank": _frame([""])}
    for k, v in files.items():
        _write(f"{tmp}/d/{k}", v)
    got = sorted((r.file, r.line) for r in dumps.read_dump(spark, f"{tmp}/d", long_window=True).collect())
    assert got == [("a b%20c.zst", "one"), ("a b%20c.zst", "two")]


def test_a_store_that_only_spark_reads(spark, tmp, monkeypatch):
    _write(f"{tmp}/d/a_RC.zst", _frame(["one", "two"]) + _frame(["three"]))
    monkeypatch.setattr(dumps, "_opens", lambda path: False)
    assert sorted(r.line for r in dumps.read_dump(spark, f"{tmp}/d", long_window=True).collect()) == ["one", "three", "two"]
