"""IPv4 networks as ranges of longs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as S

RELATIONS = ("contained", "contained_or_equal", "contains", "contains_or_equal", "overlaps")


def bounds(c: Any) -> tuple[Column, Column]:
    """First and last address of ``a.b.c.d`` or ``a.b.c.d/n``; null if malformed."""
    c = c if isinstance(c, Column) else S.lit(c)
    ok = S.regexp_like(c, S.lit(r"^\d{1,3}(\.\d{1,3}){3}(/\d{1,2})?$"))
    c = S.when(ok, c)
    octets = S.split(S.split_part(c, S.lit("/"), S.lit(1)), r"\.")
    address = S.lit(0).cast("long")
    for i in range(4):
        address = address * 256 + octets[i].cast("long")
    bits = S.coalesce(S.nullif(S.split_part(c, S.lit("/"), S.lit(2)), S.lit("")).cast("int"), S.lit(32))
    size = S.pow(S.lit(2.0), 32 - bits).cast("long")
    first = address - S.pmod(address, size)
    return first, first + size - 1


def compare(kind: str, c: Column, v: Any) -> Column:
    (a, b), (x, y) = bounds(c), bounds(v)
    return {
        "contained": (a >= x) & (b <= y) & ((a != x) | (b != y)),
        "contained_or_equal": (a >= x) & (b <= y),
        "contains": (a <= x) & (b >= y) & ((a != x) | (b != y)),
        "contains_or_equal": (a <= x) & (b >= y),
        "overlaps": (a <= y) & (x <= b),
    }[kind]
