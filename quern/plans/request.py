"""Queries declared once and driven by request parameters: filters, search, ordering, pages."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from quern.operators.expressions import Q, QueryError
from quern.plans.queryset import QuerySet


@dataclass
class RequestQuery:
    """``filters`` maps a parameter to a lookup and a type, ``ordering`` lists the names
    one may sort by, ``search`` the text columns that ``q`` looks into."""

    filters: dict[str, tuple[str, type]] = field(default_factory=dict)
    ordering: tuple[str, ...] = ()
    default_order: tuple[str, ...] = ()
    search: tuple[str, ...] = ()
    page_size: int = 50
    most: int = 1000

    def apply(self, queryset: QuerySet, params: Mapping[str, Any]) -> QuerySet:
        for name, value in params.items():
            if name in ("q", "order", "page", "size", "after"):
                continue
            if name not in self.filters:
                raise QueryError(f"unknown parameter {name!r}")
            lookup, kind = self.filters[name]
            value = [kind(v) for v in str(value).split(",")] if lookup.endswith(("__in", "__not_in")) else kind(value)
            queryset = queryset.filter(**{lookup: value})
        if params.get("q"):
            found = Q(connector="OR")
            found.parts = [(f"{c}__icontains", str(params["q"])) for c in self.search]
            queryset = queryset.filter(found)
        order = [o for o in str(params.get("order", "")).split(",") if o] or list(self.default_order)
        if any(o.lstrip("-") not in self.ordering and o not in self.default_order for o in order):
            raise QueryError("unknown ordering")
        queryset = queryset.order_by(*order) if order else queryset
        size = min(int(params.get("size", self.page_size)), self.most)
        if "after" in params:
            return queryset.after_cursor(*params["after"])[:size]
        start = (int(params.get("page", 1)) - 1) * size
        return queryset[start : start + size]
