"""Expressions: columns of a query before it is known how their paths are joined.

An expression knows its children and how to become a Spark ``Column`` once a
compiler resolves the paths.  A plain string argument is a path; anything else
that is no expression is a literal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as S
from pyspark.sql.window import Window as W


class QueryError(ValueError):
    """A query that has no meaning."""


class UnsupportedError(NotImplementedError):
    """A request of a transactional database that an analytics engine can't meet."""


class Ordering:
    """An expression to sort by; nulls come last ascending and first descending unless told."""

    def __init__(self, by: Any, descending: bool = False, nulls_first: bool | None = None):
        self.by, self.descending = wrap(by), descending
        self.nulls_first = descending if nulls_first is None else nulls_first

    def flipped(self) -> Ordering:
        return Ordering(self.by, not self.descending, not self.nulls_first)

    def column(self, ctx: Any) -> Column:
        c = self.by.column(ctx)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


def ordering(spec: Any) -> Ordering:
    """``"-name"``, ``"?"``, an expression or an Ordering, as an Ordering."""
    if isinstance(spec, Ordering):
        return spec
    if spec == "?":
        return Ordering(Call("rand", lambda: S.rand()))
    if isinstance(spec, str) and spec.startswith("-"):
        return Ordering(F(spec[1:]), True)
    return Ordering(spec)


class Expression:
    children: Sequence[Expression] = ()

    def column(self, ctx: Any) -> Column:
        raise NotImplementedError

    def walk(self) -> Iterator[Expression]:
        yield self
        for child in self.children:
            yield from child.walk()

    @property
    def aggregates(self) -> bool:
        """Whether the expression folds rows (a window does not)."""
        return any(c.aggregates for c in self.children)

    def asc(self, nulls_first: bool | None = None, nulls_last: bool | None = None) -> Ordering:
        return Ordering(self, False, (not nulls_last) if nulls_last is not None else nulls_first)

    def desc(self, nulls_first: bool | None = None, nulls_last: bool | None = None) -> Ordering:
        return Ordering(self, True, (not nulls_last) if nulls_last is not None else nulls_first)

    def _with(self, op: str, other: Any, flip: bool = False) -> Expression:
        other = other if isinstance(other, Expression) else Value(other)
        return Combined(op, *((other, self) if flip else (self, other)))

    def __add__(self, o: Any) -> Expression: return self._with("+", o)
    def __radd__(self, o: Any) -> Expression: return self._with("+", o, True)
    def __sub__(self, o: Any) -> Expression: return self._with("-", o)
    def __rsub__(self, o: Any) -> Expression: return self._with("-", o, True)
    def __mul__(self, o: Any) -> Expression: return self._with("*", o)
    def __rmul__(self, o: Any) -> Expression: return self._with("*", o, True)
    def __truediv__(self, o: Any) -> Expression: return self._with("/", o)
    def __rtruediv__(self, o: Any) -> Expression: return self._with("/", o, True)
    def __mod__(self, o: Any) -> Expression: return self._with("%", o)
    def __pow__(self, o: Any) -> Expression: return self._with("**", o)
    def __neg__(self) -> Expression: return Value(0) - self


def wrap(x: Any) -> Expression:
    return x if isinstance(x, Expression) else F(x) if isinstance(x, str) else Value(x)


class F(Expression):
    """A column, a path over relations, a JSON path, a date part or an annotation."""

    def __init__(self, path: str):
        self.path = path

    def column(self, ctx: Any) -> Column:
        return ctx.resolve(self.path)


class Value(Expression):
    """A literal, cast to a Spark type if one is named."""

    def __init__(self, value: Any, type: str | None = None):
        self.value, self.type = value, type

    def column(self, ctx: Any) -> Column:
        c = S.lit(self.value)
        return c.cast(self.type) if self.type else c


class RawSQL(Expression):
    """A fragment of Spark SQL; each ``%s`` is bound to a parameter as a literal."""

    def __init__(self, sql: str, params: Sequence[Any] = ()):
        self.sql, self.params = sql, list(params)
        if sql.count("%s") != len(self.params):
            raise QueryError("every %s needs one parameter")

    def column(self, ctx: Any) -> Column:
        names = [f"__raw{i}" for i in range(len(self.params))]
        sql = self.sql
        for name in names:
            sql = sql.replace("%s", name, 1)
        # Parameters become columns, so a value is never spliced into SQL.
        for name, value in zip(names, self.params, strict=True):
            ctx.df = ctx.df.withColumn(name, S.lit(value))
        return S.expr(sql)


class Combined(Expression):
    """Arithmetic.  ``/`` is exact, also of integers; ``%`` has the dividend's sign."""

    def __init__(self, op: str, left: Expression, right: Expression):
        self.op, self.children = op, (left, right)

    def column(self, ctx: Any) -> Column:
        a, b = (c.column(ctx) for c in self.children)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b, "**": lambda: S.pow(a, b)}[self.op]()


class Call(Expression):
    """A scalar function of columns."""

    def __init__(self, name: str, build: Callable[..., Column], *args: Any, **options: Any):
        self.name, self.build, self.options = name, build, options
        self.children = tuple(wrap(a) for a in args)

    def column(self, ctx: Any) -> Column:
        return self.build(*(c.column(ctx) for c in self.children), **self.options)


class CustomFunction:
    """An ad-hoc function of the session by name."""

    def __init__(self, name: str):
        self.name = name

    def __call__(self, *args: Any) -> Expression:
        return Call(self.name, lambda *c: S.call_function(self.name, *c), *args)


class PandasFunction:
    """A vectorised Python function of columns, for what built-ins can't express."""

    def __init__(self, fn: Callable[..., Any], returns: str):
        self.udf, self.name = S.pandas_udf(fn, returns), fn.__name__

    def __call__(self, *args: Any) -> Expression:
        return Call(self.name, self.udf, *args)


class PandasAggregate(PandasFunction):
    """A Python fold of a group's values; a group is held in memory whole."""

    def __call__(self, *args: Any, **kw: Any) -> Expression:
        return Aggregate(self.name, self.udf, *args, **kw)


class GenericKey:
    """An exclusive arc: of several key columns the one that is not null names the
    target's kind.  ``kind`` and ``key`` are expressions; ``is_(kind, key)`` a condition."""

    def __init__(self, **arcs: str):
        self.arcs = arcs
        self.kind = Case(*[When(**{f"{c}__isnull": False, "then": k}) for k, c in arcs.items()])
        self.key = Call("generic_key", lambda *c: S.coalesce(*[x.cast("string") for x in c]), *arcs.values())

    def is_(self, kind: str, key: Any = None) -> Q:
        return Q(**({f"{self.arcs[kind]}__isnull": False} if key is None else {self.arcs[kind]: key}))


class When:
    def __init__(self, *conditions: Any, then: Any = None, **lookups: Any):
        self.condition, self.then = Q(*conditions, **lookups), then if isinstance(then, Expression) else Value(then)


class Case(Expression):
    """The value of the first condition that holds, else the default."""

    def __init__(self, *whens: When, default: Any = None):
        self.whens = whens
        self.default = default if isinstance(default, Expression) else Value(default)
        self.children = (*[w.then for w in whens], self.default)

    def column(self, ctx: Any) -> Column:
        out = None
        for w in self.whens:
            cond, then = ctx.condition(w.condition), w.then.column(ctx)
            out = S.when(cond, then) if out is None else out.when(cond, then)
        return self.default.column(ctx) if out is None else out.otherwise(self.default.column(ctx))


class Q(Expression):
    """A tree of conditions: lookups, expressions and other trees under one connector."""

    def __init__(self, *parts: Any, connector: str = "AND", negated: bool = False, **lookups: Any):
        self.parts: list[Any] = [*parts, *lookups.items()]
        self.connector, self.negated = connector, negated
        self.children = tuple(p for p in self.parts if isinstance(p, Expression))

    def __and__(self, other: Any) -> Q:
        return Q(self, other)

    def __or__(self, other: Any) -> Q:
        return Q(self, other, connector="OR")

    def __invert__(self) -> Q:
        return Q(self, negated=True)

    @classmethod
    def with_connector(cls, connector: str, *parts: Any, **lookups: Any) -> Q:
        return cls(*parts, connector=connector, **lookups)

    @classmethod
    def from_expression(cls, expression: Expression) -> Q:
        """A condition that is a boolean expression."""
        return cls(expression)

    def paths(self) -> Iterator[str]:
        """Every lookup path of the tree."""
        for p in self.parts:
            if isinstance(p, tuple):
                yield p[0]
            elif isinstance(p, Q):
                yield from p.paths()

    def column(self, ctx: Any) -> Column:
        """As a value the condition keeps its unknowns."""
        return ctx.condition(self)


ConditionValue = Q


class Aggregate(Expression):
    """A fold of a group's rows, with DISTINCT, FILTER and an order where they matter."""

    aggregates = True

    def __init__(self, name: str, build: Callable[..., Column], *args: Any, distinct: bool = False, filter: Q | None = None, order_by: Sequence[Any] = (), empty: Any = None, **options: Any):
        self.name, self.build, self.distinct, self.filter, self.options, self.empty = name, build, distinct, filter, options, empty
        self.order_by = [ordering(o) for o in order_by]
        self.children = tuple(wrap(a) for a in args)

    def column(self, ctx: Any) -> Column:
        columns = [c.column(ctx) for c in self.children]
        if self.filter is not None:
            cond = ctx.condition(self.filter)
            columns = [S.when(cond, c) for c in columns] or [S.when(cond, S.lit(1))]
        if self.order_by:
            return self.build(*columns, order=[(o.by.column(ctx), o) for o in self.order_by], distinct=self.distinct, **self.options)
        if self.distinct:
            return self.build(*columns, distinct=True, **self.options)
        return self.build(*columns, **self.options)

    def over(self, ctx: Any) -> Column:
        """The column inside a window: conditions stay inside the argument."""
        if self.distinct:
            raise QueryError(f"{self.name}: DISTINCT has no window form")
        return self.column(ctx)


class WindowFunction(Expression):
    """A function that only has a meaning over a window."""

    whole = False

    def __init__(self, name: str, build: Callable[..., Column], *args: Any, whole: bool = False, condition: Q | None = None, **options: Any):
        self.name, self.build, self.options, self.whole, self.condition = name, build, options, whole, condition
        self.children = tuple(wrap(a) for a in args)

    def over(self, ctx: Any) -> Column:
        columns = [c.column(ctx) for c in self.children]
        if self.condition is not None:
            columns = [S.when(ctx.condition(self.condition), columns[0]), *columns[1:]]
        return self.build(*columns, **self.options)


class Frame:
    def __init__(self, start: int | None = None, end: int | None = 0, kind: str = "rows"):
        if start is not None and end is not None and start > end:
            raise QueryError("a frame must not start after its end")
        self.start, self.end, self.kind = start, end, kind

    def apply(self, spec: Any) -> Any:
        lo = W.unboundedPreceding if self.start is None else self.start
        hi = W.unboundedFollowing if self.end is None else self.end
        return spec.rowsBetween(lo, hi) if self.kind == "rows" else spec.rangeBetween(lo, hi)


def RowRange(start: int | None = None, end: int | None = None) -> Frame:  # noqa: N802
    """ROWS BETWEEN, relative to the row; None is unbounded."""
    return Frame(start, end, "rows")


def ValueRange(start: int | None = None, end: int | None = None) -> Frame:  # noqa: N802
    """RANGE BETWEEN, by value of the one ordering; None is unbounded."""
    return Frame(start, end, "range")


class Window(Expression):
    aggregates = False

    def __init__(self, expression: Expression, partition_by: Sequence[Any] = (), order_by: Sequence[Any] = (), frame: Frame | None = None):
        if not isinstance(expression, (WindowFunction, Aggregate)):
            raise QueryError("a window needs a window function or an aggregate")
        self.expression, self.frame = expression, frame
        self.partition_by = [wrap(p) for p in partition_by]
        self.order_by = [ordering(o) for o in order_by]

    def walk(self) -> Iterator[Expression]:
        yield self

    def column(self, ctx: Any) -> Column:
        spec = W.partitionBy(*[p.column(ctx) for p in self.partition_by])
        if self.order_by:
            spec = spec.orderBy(*[o.column(ctx) for o in self.order_by])
        if self.frame:
            spec = self.frame.apply(spec)
        elif getattr(self.expression, "whole", False):
            spec = spec.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return self.expression.over(ctx).over(spec)


class OuterReference:
    """A column of the query that encloses a subquery."""

    def __init__(self, path: str):
        self.path = path


class Subquery(Expression):
    """One value of a correlated or plain subquery, or null."""

    def __init__(self, queryset: Any):
        self.queryset = queryset

    def column(self, ctx: Any) -> Column:
        return ctx.scalar(self.queryset)


class ArraySubquery(Subquery):
    """All values of a correlated subquery as an array, empty if there are none."""

    def column(self, ctx: Any) -> Column:
        return ctx.scalar(self.queryset, array=True)


class Exists(Expression):
    def __init__(self, queryset: Any, negated: bool = False):
        self.queryset, self.negated = queryset, negated

    def __invert__(self) -> Exists:
        return Exists(self.queryset, not self.negated)

    def __and__(self, other: Any) -> Q:
        return Q(self, other)

    def __or__(self, other: Any) -> Q:
        return Q(self, other, connector="OR")

    def column(self, ctx: Any) -> Column:
        c = ctx.exists(self.queryset)
        return ~c if self.negated else c


# What groups rows several ways.
class Rollup:
    def __init__(self, *fields: str):
        if not fields:
            raise QueryError("a rollup needs fields")
        self.sets = [list(fields[:i]) for i in range(len(fields), -1, -1)]


class Cube:
    def __init__(self, *fields: str):
        if not fields:
            raise QueryError("a cube needs fields")
        self.sets = [[f for i, f in enumerate(fields) if not mask >> i & 1] for mask in range(1 << len(fields))]


class GroupingSets:
    def __init__(self, *sets: Any):
        self.sets = [[s] if isinstance(s, str) else list(s) for s in sets]
        if not any(self.sets):
            raise QueryError("grouping sets need a field")


class Grouping(Expression):
    """A bit for each field, the last one lowest: 1 where the row's grouping leaves it out."""

    aggregates = True

    def __init__(self, *fields: str):
        if not fields:
            raise QueryError("grouping needs fields")
        self.fields = fields

    def column(self, ctx: Any) -> Column:
        return ctx.grouping(self.fields)
