"""Comparison and conversion."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as S

from quern.operators.expressions import Call, Expression, wrap


def Cast(x: Any, type: str, safe: bool = False) -> Expression:
    """A conversion; malformed input raises, or is null if ``safe``."""
    return Call("cast", lambda c: c.try_cast(type) if safe else c.cast(type), x)


def Coalesce(*xs: Any) -> Expression: return Call("coalesce", S.coalesce, *xs)
def Greatest(*xs: Any) -> Expression: return Call("greatest", S.greatest, *xs)
def Least(*xs: Any) -> Expression: return Call("least", S.least, *xs)
def NullIf(a: Any, b: Any) -> Expression: return Call("nullif", S.nullif, a, b)
def Collate(x: Any, name: str) -> Expression: return Call("collate", lambda c: S.collate(c, name), x)
def IsDistinctFrom(a: Any, b: Any) -> Expression: return Call("is_distinct_from", lambda x, y: ~x.eqNullSafe(y), a, wrap(b))
def IsNotTrue(x: Any) -> Expression: return Call("is_not_true", lambda c: ~S.coalesce(c, S.lit(False)), x)
