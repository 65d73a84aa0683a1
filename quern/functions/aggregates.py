"""Aggregates.  Nulls are skipped unless a docstring says otherwise."""

from __future__ import annotations

import itertools
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as S

from quern.operators.expressions import Aggregate, QueryError, Value, wrap

_names = itertools.count()


def _fold(name: str, build: Any, distinct: Any = None) -> Any:
    once = distinct

    def make(x: Any, *args: Any, **kw: Any) -> Aggregate:
        def run(*c: Column, distinct: bool = False) -> Column:
            if distinct and once is None:
                raise QueryError(f"{name} has no DISTINCT form")
            return once(c) if distinct else build(*c)

        return Aggregate(name, run, x, *args, **kw)

    return make


def Count(x: Any = "*", **kw: Any) -> Aggregate:
    """Values that are not null; ``Count()`` counts rows."""
    kw.setdefault("empty", 0)
    if x == "*":
        return Aggregate("count", lambda c, distinct=False: S.count(c), Value(1), **kw)
    xs = x if isinstance(x, (list, tuple)) else [x]
    return Aggregate("count", lambda *c, distinct=False: S.count_distinct(*c) if distinct else S.count(c[0]), *xs, **kw)


Sum = _fold("sum", S.sum, lambda c: S.sum_distinct(c[0]))
Avg = _fold("avg", S.avg, lambda c: S.sum_distinct(c[0].cast("double")) / S.count_distinct(c[0]))
Max, Min = _fold("max", S.max, lambda c: S.max(c[0])), _fold("min", S.min, lambda c: S.min(c[0]))
BoolAnd, BoolOr = _fold("bool_and", S.bool_and), _fold("bool_or", S.bool_or)
BitAnd, BitOr, BitXor = _fold("bit_and", S.bit_and), _fold("bit_or", S.bit_or), _fold("bit_xor", S.bit_xor)
Corr, CovarSamp = _fold("corr", S.corr), _fold("covar_samp", S.covar_samp)
RegrAvgX, RegrAvgY, RegrCount = _fold("regr_avgx", S.regr_avgx), _fold("regr_avgy", S.regr_avgy), _fold("regr_count", S.regr_count)
RegrIntercept, RegrR2, RegrSlope = _fold("regr_intercept", S.regr_intercept), _fold("regr_r2", S.regr_r2), _fold("regr_slope", S.regr_slope)
RegrSXX, RegrSXY, RegrSYY = _fold("regr_sxx", S.regr_sxx), _fold("regr_sxy", S.regr_sxy), _fold("regr_syy", S.regr_syy)
Uniq, UniqCombined = _fold("uniq", S.approx_count_distinct), _fold("uniq_combined", S.approx_count_distinct)
AnyValue, AnyLast = _fold("any_value", S.any_value), _fold("any_last", lambda c: S.last(c, ignorenulls=True))
Median = _fold("median", S.median)


def StdDev(x: Any, sample: bool = False, **kw: Any) -> Aggregate: return Aggregate("stddev", S.stddev_samp if sample else S.stddev_pop, x, **kw)
def Variance(x: Any, sample: bool = False, **kw: Any) -> Aggregate: return Aggregate("variance", S.var_samp if sample else S.var_pop, x, **kw)
def CovarPop(x: Any, y: Any, sample: bool = False, **kw: Any) -> Aggregate: return Aggregate("covar", S.covar_samp if sample else S.covar_pop, x, y, **kw)
def UniqExact(*xs: Any, **kw: Any) -> Aggregate: return Aggregate("uniq_exact", lambda *c: S.count_distinct(*c), *xs, empty=0, **kw)


class Element(Aggregate):
    """The element of a group at a level, exact however many values there are."""

    def __init__(self, x: Any, level: float, **kw: Any):
        super().__init__("element", lambda c: c, x, **kw)
        self.level = float(level)

    def column(self, ctx: Any) -> Column:
        name = f"__element{next(_names)}"  # only SQL has this aggregate, and it reads a column by name
        c = super().column(ctx)
        ctx.df = ctx.df.withColumn(name, c)
        ctx.hidden.add(name)
        return S.expr(f"percentile_disc({self.level}) WITHIN GROUP (ORDER BY {name})")


def Quantile(x: Any, level: float = 0.5, exact: bool = False, **kw: Any) -> Aggregate:
    """Interpolated, or with ``exact`` the element at the level."""
    return Element(x, level, **kw) if exact else Aggregate("quantile", lambda c: S.percentile(c, level), x, **kw)


def Quantiles(x: Any, *levels: float, **kw: Any) -> Aggregate: return Aggregate("quantiles", lambda c: S.percentile(c, list(levels)), x, **kw)


def ArgMax(x: Any, by: Any, **kw: Any) -> Aggregate:
    """The value where ``by`` is largest; rows whose value is null don't compete."""
    return Aggregate("arg_max", lambda c, b: S.max_by(c, S.when(c.isNotNull(), b)), x, by, **kw)


def ArgMin(x: Any, by: Any, **kw: Any) -> Aggregate: return Aggregate("arg_min", lambda c, b: S.min_by(c, S.when(c.isNotNull(), b)), x, by, **kw)


def _ordered(c: Column, order: Any, distinct: bool) -> Column:
    """Values with their nulls, by the order asked for; ties by value."""
    keys = [x for i, (k, o) in enumerate(order) for x in ((k.isNull() != S.lit(o.nulls_first)).alias(f"n{i}"), k.alias(f"k{i}"))]
    got = (S.collect_set if distinct else S.collect_list)(S.struct(*keys, c.alias("v")))
    if not any(o.descending for _, o in order):
        return S.transform(S.sort_array(got), lambda r: r["v"])

    def compare(a: Column, b: Column) -> Column:
        out = S.lit(0)
        steps = [(f, d) for i, (_, o) in enumerate(order) for f, d in ((f"n{i}", False), (f"k{i}", o.descending))]
        for name, falls in [*steps, ("v", False)][::-1]:
            less, more = (S.lit(1), S.lit(-1)) if falls else (S.lit(-1), S.lit(1))
            out = S.when(a[name] < b[name], less).when(a[name] > b[name], more).otherwise(out)
        return out

    return S.transform(S.array_sort(got, compare), lambda r: r["v"])


def ArrayAgg(x: Any, order_by: Any = (), distinct: bool = False, **kw: Any) -> Aggregate:
    """All values as an array, nulls included."""
    return Aggregate("array_agg", lambda c, order=(), distinct=False: _ordered(c, order, distinct), x, order_by=order_by or [wrap(x)], distinct=distinct, **kw)


def StringAgg(x: Any, delimiter: str = ",", order_by: Any = (), distinct: bool = False, **kw: Any) -> Aggregate:
    return Aggregate("string_agg", lambda c, order=(), distinct=False: S.array_join(_ordered(c.cast("string"), order, distinct), delimiter), x, order_by=order_by or [wrap(x)], distinct=distinct, **kw)


def JSONAgg(x: Any, order_by: Any = (), **kw: Any) -> Aggregate:
    return Aggregate("json_agg", lambda c, order=(), distinct=False: S.to_json(_ordered(c, order, distinct), {"ignoreNullFields": "false"}), x, order_by=order_by or [wrap(x)], **kw)


def GroupArray(x: Any, size: int | None = None, **kw: Any) -> Aggregate:
    return Aggregate("group_array", lambda c: S.collect_list(c) if size is None else S.slice(S.collect_list(c), 1, size), x, **kw)


def GroupUniqArray(x: Any, size: int | None = None, **kw: Any) -> Aggregate:
    return Aggregate("group_uniq_array", lambda c: S.sort_array(S.collect_set(c)) if size is None else S.slice(S.sort_array(S.collect_set(c)), 1, size), x, **kw)


def TopK(x: Any, k: int, **kw: Any) -> Aggregate:
    """The approximately most frequent values, by falling count."""
    return Aggregate("top_k", lambda c: S.transform(S.call_function("approx_top_k", c, S.lit(k)), lambda r: r["item"]), x, **kw)


def sum_map(df: Any, keys: list[str], column: str, name: str) -> Any:
    """Maps summed key by key, by group: entries are added before they meet."""
    parts = df.select(*keys, S.explode(column).alias("__k", "__v")).groupBy(*keys, "__k").agg(S.sum("__v").alias("__v"))
    return parts.groupBy(*keys).agg(S.map_from_entries(S.sort_array(S.collect_list(S.struct("__k", "__v")))).alias(name))


def range_agg(df: Any, keys: list[str], low: str, high: str) -> Any:
    """The union of half-open ranges of each group, as disjoint rows; a range of nulls comes last and starts a row only where none came before."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy(*keys).orderBy(S.col(low).asc_nulls_last(), S.col(high).asc_nulls_last())
    met = df.withColumn("__m", S.max(high).over(w.rowsBetween(W.unboundedPreceding, -1)))
    starts = S.col("__m").isNull() | S.coalesce(S.col(low) > S.col("__m"), S.lit(False))
    island = met.withColumn("__i", S.sum(starts.cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return island.groupBy(*keys, "__i").agg(S.min(low).alias(low), S.max(high).alias(high)).drop("__i")
