"""Joins beyond relations: filtered, as-of, lateral, array and JSON table."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as S
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quern.operators.expressions import F, Q, QueryError

_ids = itertools.count()


@dataclass
class FilteredRelation:
    """A relation joined under a name of its own with a condition in its ON clause."""

    relation: str
    condition: Q | None = None


def asof_join(
    left: DataFrame, right: DataFrame, by: list[tuple[str, str]], on: tuple[str, str], op: str = ">=", prefix: str = "right__",
    slices: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Each left row with the nearest right row: LEFT AS OF by one inequality.

    ``op`` compares left to right: ``>=`` and ``>`` take the latest row before,
    ``<=`` and ``<`` the first one after.  Both sides are put in one sorted
    window by key, so nothing is joined by range; ties take the right row that
    sorts last by all its columns.  The right side's columns get ``prefix``.

    ``slices`` maps the time to a value that never falls as time rises, such as its
    day.  Windows are then cut by key and slice, so one hot key is many tasks; what
    earlier slices hand on is folded to one row for each key and slice first.
    """
    if op not in (">=", ">", "<=", "<") or not by:
        raise QueryError("an as-of join needs equalities and one inequality")
    row = S.struct(*[S.col(f"`{c}`").alias(c) for c in right.columns])
    keys = [f"__k{i}" for i in range(len(by))]
    l = left.select(*[S.col(f"`{a}`").alias(k) for (a, _), k in zip(by, keys, strict=True)], S.col(f"`{on[0]}`").alias("__t"), S.struct(*[S.col(f"`{c}`").alias(c) for c in left.columns]).alias("__l"), S.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("__r"))
    r = right.where(S.col(f"`{on[1]}`").isNotNull()).select(*[S.col(f"`{b}`").alias(k) for (_, b), k in zip(by, keys, strict=True)], S.col(f"`{on[1]}`").alias("__t"), S.lit(None).cast(l.schema["__l"].dataType).alias("__l"), row.alias("__r"))
    both = l.unionByName(r).withColumn("__mine", S.col("__l").isNotNull())
    ahead = op in ("<=", "<")
    strict = op in (">", "<")
    first = S.col("__mine").desc() if strict else S.col("__mine").asc()
    time = S.col("__t").desc() if ahead else S.col("__t").asc()
    if slices is not None:
        both = both.withColumn("__s", slices(S.col("__t")))
    cut = [*keys, "__s"] if slices is not None else keys
    w = W.partitionBy(*cut).orderBy(time, first, S.col("__r").asc()).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("__m", S.last("__r", ignorenulls=True).over(w)).where("__mine")
    if slices is not None:
        near = S.struct("__t", "__r")
        last = (S.min if ahead else S.max)(S.when(~S.col("__mine"), S.struct("__t")))
        ends = both.groupBy(*cut).agg(last.alias("__end"))
        ties = both.where("NOT __mine").join(ends.select(*[S.col(k).alias(f"__e{k}") for k in cut], "__end"), [S.col(k).eqNullSafe(S.col(f"__e{k}")) for k in cut] + [S.col("__t") == S.col("__end.__t")])
        tops = ties.groupBy(*cut).agg(S.max(near).alias("__top"))
        order = S.col("__s").desc() if ahead else S.col("__s").asc()
        before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        handed = ends.join(tops.select(*[S.col(k).alias(f"__e{k}") for k in cut], "__top"), [S.col(k).eqNullSafe(S.col(f"__e{k}")) for k in cut], "left")
        handed = handed.select(*[S.col(k).alias(f"__h{k}") for k in cut], S.last("__top", ignorenulls=True).over(before).alias("__carry"))
        found = found.join(handed, [S.col(k).eqNullSafe(S.col(f"__h{k}")) for k in cut], "left").withColumn("__m", S.coalesce("__m", S.col("__carry.__r")))
    null_key = S.lit(False)
    for k in [*keys, "__t"]:
        null_key = null_key | S.col(k).isNull()
    return found.select("__l.*", *[S.when(~null_key, S.col("__m")[c]).alias(f"{prefix}{c}") for c in right.columns])


@dataclass
class AsofJoin:
    """LEFT AS OF join to another query, named in ``annotate``: its columns are
    ``name__column``.  ``by`` pairs columns that are equal; ``on`` is (left, op, right)."""

    queryset: Any
    by: dict[str, str]
    on: tuple[str, str, str]
    slices: Callable[[Column], Column] | None = None

    def apply(self, ctx: Any, name: str) -> None:
        right = self.queryset.df
        for path in [*self.by, self.on[0]]:
            if path not in ctx.df.columns:
                ctx.df = ctx.df.withColumn(path, ctx.resolve(path))
        ctx.df = asof_join(ctx.df, right, list(self.by.items()), (self.on[0], self.on[2]), self.on[1], f"{name}__", self.slices)


@dataclass
class ArrayJoin:
    """A row for each element of an array.  ``left`` keeps rows without any, with the
    type's default; the rows are repeated also if nothing reads the element."""

    array: Any
    left: bool = False

    def apply(self, ctx: Any, name: str) -> None:
        array = (self.array if not isinstance(self.array, str) else F(self.array)).column(ctx)
        explode = S.explode_outer if self.left else S.explode
        df = ctx.df.select("*", explode(array).alias(name))
        if self.left:
            kind = df.schema[name].dataType
            default = "" if isinstance(kind, T.StringType) else 0 if isinstance(kind, T.NumericType) else None
            if default is not None:
                df = df.withColumn(name, S.coalesce(S.col(name), S.lit(default).cast(kind)))
        ctx.df = df
        ctx.names.add(name)
        if ctx.values is not None:
            ctx.values.append(name)


@dataclass
class JsonTable:
    """Rows of a JSON array with typed columns, left-joined to their document.

    ``columns`` are DDL, as ``"a int, b string"``; ``ordinality`` names a column
    that counts items from 1."""

    document: Any
    columns: str
    path: str = "$"
    ordinality: str | None = None

    def apply(self, ctx: Any, name: str) -> None:
        doc = (F(self.document) if isinstance(self.document, str) else self.document).column(ctx)
        text = doc if self.path == "$" else S.get_json_object(doc, self.path)
        items = S.from_json(text, f"array<struct<{', '.join(': '.join(c.split()) for c in self.columns.split(','))}>>")
        df = ctx.df.select("*", S.posexplode_outer(items).alias("__pos", "__item"))
        fields = [c.split()[0] for c in self.columns.split(",")]
        df = df.withColumns({f"{name}__{f}": S.col("__item")[f] for f in fields})
        if self.ordinality:
            df = df.withColumn(f"{name}__{self.ordinality}", (S.col("__pos") + 1).cast("long"))
        ctx.df = df.drop("__pos", "__item")


@dataclass
class Lateral:
    """LEFT JOIN LATERAL of a correlated query: its rows, in its order and within its
    slice, for each outer row, as ``name__column``."""

    queryset: Any

    def apply(self, ctx: Any, name: str) -> None:
        queryset, cut = self.queryset, None
        if queryset.steps and queryset.steps[-1][0] == "slice":
            cut = queryset.steps[-1][1]
            queryset = type(queryset)(queryset.db, queryset.model, queryset.steps[:-1], queryset.source, queryset.options)
        inner = queryset.compiled(correlated=True)
        if not inner.outer:
            raise QueryError("a lateral query refers to the outer one")
        names, cond = ctx._correlation(inner)
        df, keys = inner.df, [o[0] for o in inner.outer]
        if cut:
            start, length = cut
            w = W.partitionBy(*keys).orderBy(*([o.column(inner) for o in inner.order] or [S.lit(1)]))
            df = df.withColumn("__n", S.row_number().over(w)).where((S.col("__n") > start) & (S.lit(True) if length is None else S.col("__n") <= start + length))
        shown = [c for c in inner.shown() if c not in keys]
        right = df.select(*[S.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[S.col(f"`{c}`").alias(f"{name}__{c}") for c in shown])
        ctx.df = ctx.df.join(right, cond, "left")
        ctx.hidden |= set(names)
