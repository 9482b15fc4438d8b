"""Array-column vector math, all higher-order SQL functions (JVM, codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def argmax_by(a: Column, value) -> Column:
    """0-based index of the largest ``value(element)``; the first one on ties."""
    return bind(F.transform(a, value), argmax)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def scale(a, s: Column) -> Column:
    return F.transform(_c(a), lambda x: x * s)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: an expression inside a lambda is evaluated for
    every element, a lambda variable is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(a, floor: float = NORM_FLOOR) -> Column:
    """x / max(||x||, floor) — never divides by zero (ANSI-safe)."""
    return bind(_c(a), lambda v: bind(F.greatest(norm(v), F.lit(floor)), lambda n: F.transform(v, lambda x: x / n)))


def cosine(a, b, floor: float = NORM_FLOOR) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def binarise(a, t: float = 0.5) -> Column:
    """1.0 where x > t else 0.0."""
    return F.transform(_c(a), lambda x: F.when(x > t, F.lit(1.0)).otherwise(F.lit(0.0)))


def as_double(a) -> Column:
    return F.transform(_c(a), lambda x: x.cast("double"))


def argmax(p) -> Column:
    """0-based index of the maximum; the first one on ties."""
    return (F.array_position(_c(p), F.array_max(_c(p))) - 1).cast("int")


def softmax(z) -> Column:
    """exp(x - max) / sum; max, exponentials and sum are each evaluated once."""
    def shares(e):
        return bind(vsum(e), lambda s: F.transform(e, lambda x: x / s))

    def exponentials(v):
        return bind(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))

    return bind(_c(z), lambda v: bind(exponentials(v), shares))


def sigmoid(z) -> Column:
    return F.transform(_c(z), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def vsum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x)
