"""Lookups: what ``path__name=value`` means for a column.

Negated lookups are two-valued: ``not`` and ``not_in`` keep rows whose column is
null, as ``exclude`` does.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as S

from quern.functions import containers, network, ranges, search, shapes, text
from quern.functions.datetime import PARTS
from quern.operators.expressions import QueryError

Lookup = Callable[[Column, Any], Column]

# POSIX classes and their Java names.
POSIX = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}",
    "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "blank": r"\p{Blank}",
}


def true_only(cond: Column) -> Column:
    """False where a condition is unknown."""
    return S.coalesce(cond, S.lit(False))


def posix(pattern: str) -> str:
    return re.sub(r"\[:(\w+):\]", lambda m: POSIX[m[1]], pattern)


def exact(c: Column, v: Any) -> Column:
    return c.isNull() if v is None else c == v


def not_exact(c: Column, v: Any) -> Column:
    if v is None:
        return c.isNotNull()
    return ~c.eqNullSafe(v) if isinstance(v, Column) else (c != v) | c.isNull()


def in_list(c: Column, values: Any) -> Column:
    known = [v for v in values if v is not None]
    cond = c.isin(known) if known else S.lit(False)
    return true_only(cond) | c.isNull() if len(known) < len(list(values)) else cond


def not_in_list(c: Column, values: Any) -> Column:
    known = [v for v in values if v is not None]
    cond = ~c.isin(known) if known else S.lit(True)
    return c.isNotNull() & cond if len(known) < len(list(values)) else cond | c.isNull()


def between(c: Column, bounds: Any) -> Column:
    low, high = bounds
    if low is None and high is None:
        return c.isNotNull()
    cond = S.lit(True)
    if low is not None:
        cond = cond & (c >= low)
    if high is not None:
        cond = cond & (c <= high)
    return cond


def _lower(v: Any) -> Any:
    return S.lower(v) if isinstance(v, Column) else str(v).lower()


def _set(kind: str) -> Lookup:
    return lambda c, v: containers.compare(kind, c, v)


LOOKUPS: dict[str, Lookup] = {
    "exact": exact,
    "not": not_exact,
    "in": in_list,
    "not_in": not_in_list,
    "global_in": in_list,
    "global_not_in": not_in_list,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "range": between,
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
    "not_isnull": lambda c, v: c.isNotNull() if v else c.isNull(),
    "iexact": lambda c, v: c.isNull() if v is None else S.lower(c) == _lower(v),
    "contains": lambda c, v: c.contains(v) if isinstance(v, (str, Column)) else containers.compare("contains", c, v),
    "icontains": lambda c, v: S.lower(c).contains(_lower(v)),
    "startswith": lambda c, v: c.startswith(v),
    "istartswith": lambda c, v: S.lower(c).startswith(_lower(v)),
    "endswith": lambda c, v: c.endswith(v),
    "iendswith": lambda c, v: S.lower(c).endswith(_lower(v)),
    "posix_regex": lambda c, v: c.rlike(posix(v)),
    "iposix_regex": lambda c, v: c.rlike("(?i)" + posix(v)),
    "search": lambda c, v: search.matches(search.tokens(c), search.SearchQuery(v)),
    "contained_by": _set("contained_by"),
    "overlap": _set("overlap"),
    "has_key": lambda c, v: containers.has_keys(c, [v], all),
    "has_keys": lambda c, v: containers.has_keys(c, v, all),
    "has_any_keys": lambda c, v: containers.has_keys(c, v, any),
    "map_has_key": lambda c, v: S.map_contains_key(c, v),
    "map_has_keys": lambda c, v: S.size(S.array_except(S.array(*map(S.lit, v)), S.map_keys(c))) == 0,
    "map_has_any_keys": lambda c, v: S.arrays_overlap(S.map_keys(c), S.array(*map(S.lit, v))),
    "multirange_contains": lambda c, v: S.exists(c, lambda r: ranges.compare("contains", r, v)),
    "multirange_overlap": lambda c, v: S.exists(c, lambda r: ranges.compare("overlap", r, v)),
    "trigram_similar": lambda c, v: text.trigram_similarity(c, S.lit(v)) >= 0.3,
    "trigram_word_similar": lambda c, v: text.trigram_word_similarity(S.lit(v), c) >= 0.6,
    "trigram_strict_word_similar": lambda c, v: text.trigram_strict_similarity(S.lit(v), c) >= 0.5,
    "ancestor_of": lambda c, v: text.is_ancestor(c, S.lit(v)),
    "descendant_of": lambda c, v: text.is_ancestor(S.lit(v), c),
    "matches": lambda c, v: c.rlike(text.lquery(v)),
    "matches_text": lambda c, v: search.matches(S.split(S.lower(c), r"\\."), search.SearchQuery(v)),
    "matches_any": lambda c, v: c.rlike("|".join(text.lquery(x) for x in v)),
    **{f"net_{k}": (lambda k: lambda c, v: network.compare(k, c, v))(k) for k in network.RELATIONS},
    **{k: (lambda k: lambda c, v: ranges.compare(k, c, v))(k) for k in ("fully_lt", "fully_gt", "not_lt", "not_gt", "adjacent_to")},
    "range_contains": lambda c, v: ranges.compare("contains", c, v),
    "range_contained_by": lambda c, v: ranges.compare("contained_by", c, v),
    "range_overlap": lambda c, v: ranges.compare("overlap", c, v),
    "nearby": lambda c, v: _nearby(c, *v),
}


def _nearby(c: Column, vector: Any, distance: float) -> Column:
    from quern.functions.vectors import l2

    return l2(c, S.array(*[S.lit(float(x)) for x in vector])) < distance


def json_filter(c: Column, wanted: dict[str, Any]) -> Column:
    """Conditions on paths of a JSON text: ``{"a__b__gte": 3}``.  A comparison holds only
    for a value of the literal's own kind; null asks for JSON null or a missing path."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    out = S.lit(True)
    doc = S.try_parse_json(c)
    for path, value in wanted.items():
        parts = path.split("__")
        name = parts.pop() if parts[-1] in LOOKUPS and len(parts) > 1 else "exact"
        at = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in parts)
        if name == "isnull" or value is None:
            found = S.try_variant_get(doc, at, "variant")
            missing = found.isNull() | S.is_variant_null(found)
            out = out & (missing if value is None or value else ~missing)
            continue
        sample = value[0] if isinstance(value, (list, tuple)) else value
        whole = S.schema_of_variant(S.try_variant_get(doc, at, "variant"))
        kind = kinds[type(sample)]
        fits = {"boolean": whole == "BOOLEAN", "string": whole == "STRING"}.get(kind, whole.rlike("^(BIGINT|DOUBLE|DECIMAL)"))
        typed = S.try_variant_get(doc, at, "double" if kind == "bigint" else kind)
        out = out & true_only(fits & LOOKUPS[name](typed, value))
    return out


def of_kind(c: Column, wanted: tuple[str, str, Any]) -> Column:
    """A variant column whose stored kind and value fit: ``(type, lookup, value)``."""
    kind, name, value = wanted
    return true_only((S.schema_of_variant(c) == kind.upper()) & LOOKUPS[name](S.try_variant_get(c, "$", kind), value))


LOOKUPS |= shapes.lookups()
LOOKUPS["filter"] = json_filter
LOOKUPS["of_kind"] = of_kind

#: Steps between a column and its lookup.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    **PARTS,
    "len": lambda c: S.size(c).cast("long"),
    "lower": S.lower,
    "upper": S.upper,
    "length": lambda c: S.length(c).cast("long"),
    "unaccent": text.unaccent,
}


def register_lookup(name: str, lookup: Lookup) -> None:
    """Add a lookup suffix for all columns."""
    LOOKUPS[name] = lookup


def register_transform(name: str, transform: Callable[[Column], Column]) -> None:
    TRANSFORMS[name] = transform


def transform(c: Column, step: str, json: bool) -> Column:
    """One step of a path beyond its column: a JSON key, an index, a part of a date."""
    if json:
        return S.get_json_object(c, f"$[{step}]" if step.isdigit() else f"$.{step}")
    if step in TRANSFORMS:
        return TRANSFORMS[step](c)
    if step.lstrip("-").isdigit():
        return containers.item(c, int(step))
    raise QueryError(f"unknown lookup or transform {step!r}")
