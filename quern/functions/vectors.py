"""Distances of float vectors; smaller is closer."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as S

from quern.operators.expressions import Call, Expression


def _fold(pairs: Column) -> Column:
    return S.aggregate(pairs, S.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(S.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column, b: Column) -> Column:
    return S.sqrt(_fold(S.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / S.sqrt(dot(a, a) * dot(b, b))


def _vector(v: Any) -> Any:
    if isinstance(v, Sequence) and not isinstance(v, str):
        return Call("vector", lambda: S.array(*[S.lit(float(x)) for x in v]))
    return v


def L2Distance(x: Any, v: Any) -> Expression: return Call("l2_distance", l2, x, _vector(v))
def CosineDistance(x: Any, v: Any) -> Expression: return Call("cosine_distance", cosine, x, _vector(v))
def InnerProduct(x: Any, v: Any) -> Expression: return Call("inner_product", lambda a, b: -dot(a, b), x, _vector(v))
