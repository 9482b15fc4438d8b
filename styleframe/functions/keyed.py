"""Keyed (partition-independent) randomness.

A row's random draw is a pure function of (seed, key columns): the md5 digest
of ``seed|k1|k2..``.  Results therefore do not depend on partitioning, task
retries or input order, and any SQL engine with md5 reproduces them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits = 52 bits, exact in a double
_HEX_DIGITS = 13
_SCALE = float(16 ** _HEX_DIGITS)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digest(seed, *keys) -> Column:
    """Hex md5 of ``seed|key1|key2...`` (keys cast to string)."""
    parts = [F.lit(str(seed))] + [_c(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def order_key(seed, *keys) -> Column:
    """A sort key that shuffles rows reproducibly."""
    return digest(seed, *keys)


def uniform(seed, *keys) -> Column:
    """A reproducible draw in [0, 1)."""
    h = F.substring(digest(seed, *keys), 1, _HEX_DIGITS)
    return F.conv(h, 16, 10).cast("bigint").cast("double") / F.lit(_SCALE)


def randint(seed, lo, hi, *keys) -> Column:
    """Reproducible integer in [lo, hi) (numpy randint semantics); null if empty."""
    lo_c, hi_c = _c(lo) if not isinstance(lo, int) else F.lit(lo), \
        _c(hi) if not isinstance(hi, int) else F.lit(hi)
    n = hi_c - lo_c
    return F.when(n > 0, lo_c + F.floor(uniform(seed, *keys) * n).cast("bigint"))


def sql_uniform(seed, *key_sql: str) -> str:
    """The same draw written as DuckDB SQL (used by the oracles)."""
    parts = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql])
    return (f"(CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, {_HEX_DIGITS})) AS BIGINT)"
            f" / {_SCALE!r})")


def sql_digest(seed, *key_sql: str) -> str:
    parts = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql])
    return f"md5(concat_ws('|', {parts}))"
