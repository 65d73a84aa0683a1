"""Arrays, maps and records."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as S

from quern.operators.expressions import Call, Expression


def item(c: Column, i: int) -> Column:
    """The element at a 0-based index; a negative one counts from the end; null outside."""
    return S.try_element_at(c, S.lit(i + 1 if i >= 0 else i))


def _array(v: Any) -> Column:
    return v if isinstance(v, Column) else S.array(*[S.lit(x) for x in v])


def compare(kind: str, c: Column, v: Any) -> Column:
    """Superset, subset or overlap of arrays."""
    v = _array(v)
    if kind == "contains":
        return S.when(c.isNotNull(), S.size(S.array_except(v, c)) == 0)
    if kind == "contained_by":
        return S.when(c.isNotNull(), S.size(S.array_except(c, v)) == 0)
    return S.arrays_overlap(c, v)


def has_keys(c: Column, keys: Any, fold: Any) -> Column:
    """Key tests on a JSON text: all or any of the keys are there."""
    have = S.json_object_keys(c)
    tests = [S.array_contains(have, k) for k in keys]
    out = S.lit(fold is all)
    for t in tests:
        out = (out & t) if fold is all else (out | t)
    return out


def ArrayItem(x: Any, i: int) -> Expression: return Call("array_item", lambda c: item(c, i), x)
def ArrayLength(x: Any) -> Expression: return Call("array_length", lambda c: S.size(c).cast("long"), x)


def ArraySlice(x: Any, start: int, end: int) -> Expression:
    """0-based and half-open."""
    return Call("array_slice", lambda c: S.slice(c, start + 1, max(0, end - start)), x)


def ArrayContains(x: Any, y: Any) -> Expression: return Call("array_contains", lambda a, b: compare("contains", a, b), x, y)
def ArrayContainedBy(x: Any, y: Any) -> Expression: return Call("array_contained_by", lambda a, b: compare("contained_by", a, b), x, y)
def ArrayOverlap(x: Any, y: Any) -> Expression: return Call("array_overlap", lambda a, b: compare("overlap", a, b), x, y)
def Array(*xs: Any) -> Expression: return Call("array", lambda *c: S.array(*c), *xs)
def Tuple(**xs: Any) -> Expression:
    names = list(xs)
    return Call("tuple", lambda *c: S.struct(*[x.alias(n) for x, n in zip(c, names, strict=True)]), *xs.values())
def TupleElement(x: Any, name: str) -> Expression: return Call("tuple_element", lambda c: c[name], x)
def Map(*pairs: Any) -> Expression: return Call("map", lambda *c: S.create_map(*c), *pairs)
def MapKeys(x: Any) -> Expression: return Call("map_keys", S.map_keys, x)
def MapValues(x: Any) -> Expression: return Call("map_values", S.map_values, x)
def MapContainsKey(x: Any, key: Any) -> Expression: return Call("map_contains_key", lambda c: S.map_contains_key(c, key), x)
def MapValue(x: Any, key: Any, default: Any = None) -> Expression:
    """The value of a key, or a default where it is missing."""
    return Call("map_value", lambda c: S.coalesce(S.try_element_at(c, S.lit(key)), S.lit(default)), x)
def Split(x: Any, pattern: str) -> Expression: return Call("split", lambda c: S.split(c, pattern), x)


def AnyOf(value: Any, array: Any) -> Expression:
    """Whether a value is among an array's, null where that is unknown."""
    return Call("any_of", lambda v, a: S.array_contains(a, v), value, array)
