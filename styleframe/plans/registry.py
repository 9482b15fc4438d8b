"""Query registry shared by ``__spark_entry__``, ``bench.py`` and the tests."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: tuple[str, ...] = field(default_factory=tuple)


REGISTRY: dict[str, Query] = {}

_MODULES = ("corpus_q", "text_q", "hier_q", "vector_q", "classify_q", "lexical_q", "stream_q", "io_q", "instruct_q", "extra_q", "setjoin_q")


def register(name: str, sql: str | None = None, ops: tuple[str, ...] = ()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(ops))
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"styleframe.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: q.fn for k, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: q.sql for k, q in REGISTRY.items() if q.sql is not None}
