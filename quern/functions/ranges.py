"""Ranges as structs of lower, upper, lower_inc, upper_inc; null bounds are open ended."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as S

from quern.operators.expressions import Call, Expression


def make(lower: Any, upper: Any, bounds: str = "[)") -> Column:
    return S.struct(
        (lower if isinstance(lower, Column) else S.lit(lower)).alias("lower"), (upper if isinstance(upper, Column) else S.lit(upper)).alias("upper"),
        S.lit(bounds[0] == "[").alias("lower_inc"), S.lit(bounds[1] == "]").alias("upper_inc"),
    )


def Range(lower: Any, upper: Any, bounds: str = "[)") -> Expression:
    return Call("range", lambda a, b: make(a, b, bounds), lower, upper)


def _ends_before(a: Column, b: Column) -> Column:
    """Whether every point of a lies before every point of b."""
    both = a["upper_inc"] & b["lower_inc"]
    return S.coalesce((a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~both), S.lit(False))


def _starts_in(a: Column, b: Column) -> Column:
    """Whether a starts where b starts or later."""
    return b["lower"].isNull() | S.coalesce((a["lower"] > b["lower"]) | ((a["lower"] == b["lower"]) & (b["lower_inc"] | ~a["lower_inc"])), S.lit(False))


def _ends_in(a: Column, b: Column) -> Column:
    return b["upper"].isNull() | S.coalesce((a["upper"] < b["upper"]) | ((a["upper"] == b["upper"]) & (b["upper_inc"] | ~a["upper_inc"])), S.lit(False))


def _meets(a: Column, b: Column) -> Column:
    return S.coalesce((a["upper"] == b["lower"]) & (a["upper_inc"] != b["lower_inc"]), S.lit(False))


def compare(kind: str, c: Column, v: Any) -> Column:
    v = v if isinstance(v, Column) else make(*v)
    return {
        "fully_lt": lambda: _ends_before(c, v),
        "fully_gt": lambda: _ends_before(v, c),
        "not_lt": lambda: _starts_in(c, v),
        "not_gt": lambda: _ends_in(c, v),
        "adjacent_to": lambda: _meets(c, v) | _meets(v, c),
        "contains": lambda: _starts_in(v, c) & _ends_in(v, c),
        "contained_by": lambda: _starts_in(c, v) & _ends_in(c, v),
        "overlap": lambda: ~(_ends_before(c, v) | _ends_before(v, c)),
    }[kind]()
