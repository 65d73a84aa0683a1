"""JSON documents: building, reading by path and ordering."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as S

from quern.operators.expressions import Call, Expression

KEEP_NULLS = {"ignoreNullFields": "false"}


def JSONObject(**fields: Any) -> Expression:
    """A document with these keys; null fields stay."""
    names = list(fields)
    return Call("json_object", lambda *c: S.to_json(S.struct(*[x.alias(n) for x, n in zip(c, names, strict=True)]), KEEP_NULLS), *fields.values())


def JSONArray(*values: Any) -> Expression:
    return Call("json_array", lambda *c: S.to_json(S.array(*c), KEEP_NULLS), *values)


def JsonPath(x: Any, path: str, type: str = "string") -> Expression:
    """The value at a path such as ``$.a[0]``, null where it is missing or of another type."""
    return Call("json_path", lambda c: S.try_variant_get(S.try_parse_json(c), path, type), x)


def sort_key(c: Column, path: str = "$") -> Column:
    """A key that orders JSON values: by kind, then number, then text."""
    v = S.try_parse_json(c)
    number, text = S.try_variant_get(v, path, "double"), S.try_variant_get(v, path, "string")
    return S.struct(S.when(number.isNotNull(), 1).when(text.isNotNull(), 2).otherwise(0).alias("kind"), number.alias("number"), text.alias("text"))


def JsonSortKey(x: Any, path: str = "$") -> Expression: return Call("json_sort_key", lambda c: sort_key(c, path), x)


def JsonValue(x: Any) -> Expression:
    """A column as a JSON value: texts quoted, numbers and booleans plain, null as null."""
    def build(c: Column) -> Column:
        inner = S.regexp_extract(S.to_json(S.struct(c.alias("v")), KEEP_NULLS), r"(?s)^\{\"v\":(.*)\}$", 1)
        return inner

    return Call("json_value", build, x)


def JsonComparand(x: Any, path: str = "$") -> Expression:
    """The number at a path, or else the text, as a struct that compares like its kind."""
    return Call("json_comparand", lambda c: sort_key(c, path), x)
