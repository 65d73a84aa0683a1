"""The lazy query algebra and its compiler to DataFrames.

A ``QuerySet`` is immutable: each method returns a new one with one more step.
``df`` replays the steps on a fresh compiler, which keeps one DataFrame whose
columns are the model's own, those of joined relations under their path
(``customer__nation__n_name``) and annotations.  Joins are added when a path is
first read, so unread relations cost nothing and Catalyst prunes the rest.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as S
from pyspark.sql.window import Window as W

from quern.operators import lookups
from quern.operators.expressions import (
    Aggregate, Cube, Exists, Expression, F, Grouping, GroupingSets, Ordering, OuterReference, Q, QueryError, Rollup, UnsupportedError, Value, ordering,
)
from quern.operators.joins import ArrayJoin, AsofJoin, FilteredRelation, JsonTable, Lateral
from quern.sources.lineage import checkpoint
from quern.sources.models import Database, Model

SEP = "__"
#: Values from which an ``__in`` list becomes a semi join.
LARGE_LIST = 500
_ids = itertools.count()


class FanOutError(QueryError):
    """Aggregates over two to-many relations, which would multiply each other's rows."""


#: Lookups that are never true of a null column, if their value is no null.
REJECT_NULL = {
    "exact", "gt", "gte", "lt", "lte", "in", "range", "iexact", "contains", "icontains", "startswith", "istartswith", "endswith", "iendswith", "posix_regex", "iposix_regex",
}


def rejects_null(path: str, value: Any) -> bool:
    """Whether a lookup drops every row whose column is null."""
    name = path.rpartition(SEP)[2]
    if name in lookups.LOOKUPS and name not in REJECT_NULL:
        return False
    if isinstance(value, QuerySet):
        return False
    values = value if isinstance(value, (list, tuple, set)) else [value]
    return bool(values) and all(v is not None for v in values)


class Compiler:
    def __init__(self, db: Database, model: Model | None, df: DataFrame, options: dict[str, Any]):
        self.db, self.model, self.df, self.options = db, model, df, options
        self.base = list(df.columns)
        self.paths: dict[str, Model] = {}  # relation path -> its model
        self.alias: dict[str, str] = {}  # relation path -> prefix of its columns now
        self.many: set[str] = set()  # joined paths that multiply rows
        self.names: set[str] = set()  # annotations
        self.hidden: set[str] = set()
        self.values: list[str] | None = None
        self.pending: dict[str, Expression] = {}  # aggregates that wait for their grouping
        self.groups: list[Any] | None = None
        self.order: list[Ordering] = []
        self.grouped = False
        self.frozen = False  # sliced, combined or distinct: nothing may be joined below
        self.outer: list[tuple[str, str, str]] = []  # (inner column, operator, outer path)
        self.named: dict[str, FilteredRelation] = {}
        self.inner = False  # a condition being read rejects nulls, so its joins may be inner

    # -- paths -----------------------------------------------------------------

    def resolve(self, path: str) -> Column:
        if path in self.pending:
            self.flush()
        if path in self.df.columns:
            return S.col(f"`{path}`")
        if path == "pk" and self.model:
            keys = self.model.key
            return S.col(keys[0]) if len(keys) == 1 else S.struct(*keys)
        column, rest, json = self._walk(path.split(SEP))
        for step in rest:
            column = lookups.transform(column, step, json)
        return column

    def _walk(self, parts: list[str]) -> tuple[Column, list[str], bool]:
        """The column a path reaches, what is left of the path, and whether it is JSON."""
        for n in range(len(parts), 0, -1):  # the longest name that is a column already
            name = SEP.join(parts[:n])
            if name in self.df.columns:
                model, field = self.model, name
                for p, m in self.paths.items():
                    if name.startswith(p + SEP):
                        model, field = m, name[len(p) + 2 :]
                return S.col(f"`{name}`"), parts[n:], bool(model and field in model.json)
        model, done = self.model, []
        for i, part in enumerate(parts):
            if part == "pk" and model:
                part = parts[i] = model.key[0]
            known = self.named.get(part) if not done else None
            relation = known.relation if known else part
            if model and relation in model.relations:
                done.append(part)
                if SEP.join(done) in self.named:
                    model = self.join(SEP.join(done), model, relation, SEP.join(done[:-1]), known)
                    continue
                nxt = model.relations[relation]
                rest = parts[i + 1 :]
                if not nxt.many and rest in (["pk"], [self.db.registry.models[nxt.target].key[0]]) and len(nxt.here) == 1:
                    prefix = SEP.join(done[:-1])  # the key is already here: no join
                    return S.col(f"`{prefix + SEP if prefix else ''}{nxt.here[0]}`"), [], False
                if not rest:
                    prefix = SEP.join(done[:-1])
                    if not nxt.many:
                        return S.col(f"`{prefix + SEP if prefix else ''}{nxt.here[0]}`"), [], False
                    model = self.join(SEP.join(done), model, relation, prefix)
                    return S.col(f"`{self.alias[SEP.join(done)]}{SEP}{model.key[0]}`"), [], False
                model = self.join(SEP.join(done), model, relation, SEP.join(done[:-1]))
                continue
            prefix = self.alias.get(SEP.join(done), SEP.join(done)) if done else ""
            name = f"{prefix}{SEP}{part}" if prefix else part
            if name in self.df.columns:
                return S.col(f"`{name}`"), parts[i + 1 :], bool(model and part in model.json)
            break
        raise QueryError(f"{SEP.join(parts)!r} is no path of {self.model.name if self.model else 'this query'}")

    def join(self, path: str, model: Model, name: str, parent: str, filtered: FilteredRelation | None = None) -> Model:
        """LEFT JOIN of one relation, once for each path and filter generation; INNER where
        a condition drops the unmatched rows anyway, which frees the join order and lets
        Spark filter the other side at run time."""
        if path in self.paths:
            return self.paths[path]
        if self.frozen:
            raise QueryError(f"{path!r} can't be joined after a slice, a distinct or a combination")
        relation = model.relations[name]
        target = self.db.registry.models[relation.target]
        here = self.alias.get(parent, parent)
        prefix = f"{path}_{next(_ids)}" if path in self.many else path
        right = self.db.rows(target, self.options.get("deleted", "hide"), self.options.get("all_tenants", False))
        if relation.through:
            link = self.db.frame(relation.through).select(*[S.col(c).alias(f"__h{i}") for i, c in enumerate(relation.through_here)], *[S.col(c).alias(f"__t{i}") for i, c in enumerate(relation.through_there)])
            on = [S.col(f"__t{i}") == S.col(c) for i, c in enumerate(relation.there)]
            right = link.join(right, on, "inner").drop(*[f"__t{i}" for i in range(len(on))])
            there = [f"__h{i}" for i in range(len(relation.through_here))]
        else:
            there = list(relation.there)
        if filtered is not None and filtered.condition is not None:
            inner = Compiler(self.db, target, right, self.options)
            right = right.where(inner.condition(filtered.condition))
        right = right.select(*[S.col(c).alias(f"{prefix}{SEP}{c}") for c in right.columns])
        on = [S.col(f"`{here + SEP if here else ''}{a}`") == S.col(f"`{prefix}{SEP}{b}`") for a, b in zip(relation.here, there, strict=True)]
        self.df = self.df.join(right, on, "inner" if self.inner else "left")
        self.paths[path], self.alias[path] = target, prefix
        if relation.many:
            self.many.add(path)
        return target

    # -- conditions ------------------------------------------------------------

    def to_many(self, q: Q) -> bool:
        """Whether a condition reads a to-many relation of the model."""
        for path in q.paths():
            model = self.model
            for part in path.split(SEP):
                if not model or part not in model.relations:
                    break
                relation = model.relations[part]
                if relation.many:
                    return True
                model = self.db.registry.models[relation.target]
        return False

    def condition(self, q: Any) -> Column:
        if not isinstance(q, Q):
            return q.column(self)
        terms = [self.lookup(*p) if isinstance(p, tuple) else self.condition(p) for p in q.parts]
        if not terms:
            return S.lit(True)
        out = terms[0]
        for t in terms[1:]:
            out = out & t if q.connector == "AND" else out | t
        return ~lookups.true_only(out) if q.negated else out

    def lookup(self, path: str, value: Any) -> Column:
        parts = path.split(SEP)
        name = "exact"
        if parts[-1] in lookups.LOOKUPS and (len(parts) > 1) and path not in self.df.columns and path not in self.pending:
            name, parts = parts[-1], parts[:-1]
        if parts == ["pk"] and self.model and len(self.model.key) > 1:
            return self.composite(name, value)
        column = self.resolve(SEP.join(parts))
        self.inner = False  # a value may keep rows whose own paths are null
        if isinstance(value, OuterReference):
            self.outer.append((f"__o{len(self.outer)}", name, value.path))
            self.df = self.df.withColumn(self.outer[-1][0], column)
            return S.lit(True)
        if isinstance(value, QuerySet):
            found = self.flag(column, value)
            return ~found if name in ("not_in", "global_not_in") else found
        if isinstance(value, Expression):
            value = value.column(self)
            if name == "in":
                return S.array_contains(value, column)
        elif isinstance(value, (list, tuple)) and name == "range":
            value = tuple(v.column(self) if isinstance(v, Expression) else v for v in value)
        return lookups.LOOKUPS[name](column, value)

    def composite(self, name: str, value: Any) -> Column:
        """A list of keys is joined as one local relation: neither deep trees nor long plans."""
        key = self.model.key
        rows = [tuple(value)] if name in ("exact", "not") else [tuple(row) for row in value]
        if not rows:
            return S.lit(name == "not_in")
        mark = f"__pk{next(_ids)}"
        right = self.db.spark.createDataFrame(pd.DataFrame(rows, columns=[f"{mark}{i}" for i in range(len(key))])).distinct().withColumn(mark, S.lit(True))
        kinds = [self.df.schema[k].dataType for k in key]
        self.df = self.df.join(right, [S.col(k) == S.col(f"{mark}{i}").cast(t) for i, (k, t) in enumerate(zip(key, kinds, strict=True))], "left")
        self.hidden |= {mark, *(f"{mark}{i}" for i in range(len(key)))}
        found = S.col(mark).isNotNull()
        return ~found if name in ("not", "not_in") else found

    def flag(self, column: Column, queryset: QuerySet) -> Column:
        """Whether a value is among a subquery's, nulls equal to nulls."""
        inner = queryset.df
        mark = f"__in{next(_ids)}"
        right = inner.select(S.col(f"`{inner.columns[0]}`").alias(f"{mark}v")).distinct().withColumn(mark, S.lit(True))
        self.df = self.df.withColumn(f"{mark}l", column).join(right, S.col(f"{mark}l").eqNullSafe(S.col(f"{mark}v")), "left")
        self.hidden |= {mark, f"{mark}l", f"{mark}v"}
        return S.col(mark).isNotNull()

    def _correlation(self, inner: Compiler) -> tuple[list[str], Column]:
        """Columns that carry the correlation, and the condition on them."""
        cond = S.lit(True)
        names = []
        for name, op, path in inner.outer:
            mine = f"{name}_{next(_ids)}"
            names.append(mine)
            cond = cond & lookups.LOOKUPS[op](S.col(mine), self.resolve(path))
        return names, cond

    def exists(self, queryset: QuerySet) -> Column:
        inner = queryset.compiled()
        mark = f"__ex{next(_ids)}"
        if not inner.outer:
            right = inner.df.limit(1).select(S.lit(True).alias(mark))
            self.df = self.df.join(right, S.lit(True), "left")
        else:
            names, cond = self._correlation(inner)
            right = inner.df.select(*[S.col(o[0]).alias(n) for o, n in zip(inner.outer, names, strict=True)]).distinct().withColumn(mark, S.lit(True))
            if any(op != "exact" for _, op, _ in inner.outer):
                # The rows are read twice, so their numbers are written down first.
                key = f"{mark}k"
                self.df = checkpoint(self.df.withColumn(key, S.monotonically_increasing_id()))
                hit = self.df.join(right, cond).select(S.col(key).alias(f"{mark}r")).distinct().withColumn(mark, S.lit(True))
                self.df = self.df.join(hit, S.col(key) == S.col(f"{mark}r"), "left")
                self.hidden |= {key, f"{mark}r"}
            else:
                self.df = self.df.join(right, cond, "left")
                self.hidden |= set(names)
        self.hidden.add(mark)
        return S.col(mark).isNotNull()

    def semi(self, queryset: QuerySet, negated: bool) -> None:
        """Keep or drop the rows for which a subquery has one: a semi or anti join."""
        inner = queryset.compiled()
        names, cond = self._correlation(inner)
        right = inner.df.select(*[S.col(o[0]).alias(n) for o, n in zip(inner.outer, names, strict=True)]) if names else inner.df.limit(1).select(S.lit(1).alias("__one"))
        self.df = self.df.join(right, cond, "left_anti" if negated else "left_semi")

    def scalar(self, queryset: QuerySet, array: bool = False) -> Column:
        inner = queryset.compiled(correlated=True)
        out = f"__sq{next(_ids)}"
        names, cond = self._correlation(inner)
        shown = [c for c in inner.shown() if not c.startswith("__o")]
        if len(shown) != 1:
            raise QueryError("a scalar subquery selects one column")
        keys = [o[0] for o in inner.outer]
        if any(op != "exact" for _, op, _ in inner.outer):
            raise UnsupportedError("a scalar subquery is correlated by equality")
        df = inner.df
        if array:
            row = S.sort_array(S.collect_list(S.struct(S.col(f"`{shown[0]}`").alias("v"))))
            df = df.groupBy(*keys).agg(S.transform(row, lambda r: r["v"]).alias(out))
        else:
            if keys and not inner.grouped:
                by = [o.column(inner) for o in inner.order] or [S.lit(1)]
                df = df.withColumn("__rn", S.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("__rn = 1")
            elif not keys:
                df = (df.orderBy(*[o.column(inner) for o in inner.order]) if inner.order else df).limit(1)
            df = df.withColumn(out, S.col(f"`{shown[0]}`"))
        right = df.select(*[S.col(k).alias(n) for k, n in zip(keys, names, strict=True)], out)
        self.df = self.df.join(right, cond, "left")
        self.hidden |= {out, *names}
        got = S.col(out)
        if array:
            return S.coalesce(got, S.array().cast(df.schema[out].dataType))
        empty = queryset.empty_value()
        return S.coalesce(got, S.lit(empty)) if empty is not None else got

    # -- grouping --------------------------------------------------------------

    def grouping(self, fields: Sequence[str]) -> Column:
        bits = S.lit(0).cast("long")
        for f in fields:
            bits = bits * 2 + S.col(f"__bit_{f}")
        return bits

    def branch(self, e: Expression) -> str | None:
        """The to-many relation an aggregate reads first, if any."""
        found = set()
        for x in e.walk():
            paths = [x.path] if isinstance(x, F) else list(x.filter.paths()) if isinstance(x, Aggregate) and x.filter else []
            for path in paths:
                model = self.model
                for part in path.split(SEP):
                    if not model or part not in model.relations:
                        break
                    if model.relations[part].many:
                        found.add(path.split(SEP)[0])
                        break
                    model = self.db.registry.models[model.relations[part].target]
        if len(found) > 1:
            raise FanOutError("one aggregate reads several to-many relations")
        return found.pop() if found else None

    def flush(self) -> None:
        """Fold the pending aggregates by the grouping that holds for them."""
        if not self.pending and self.groups is None:
            return
        pending, self.pending = self.pending, {}
        groups, self.groups = self.groups, None
        if groups is None and self.values is None and self.model and not self.grouped:
            return self._per_row(pending)
        branches = {b for b in (self.branch(e) for e in pending.values()) if b}
        if len(branches) > 1:
            raise FanOutError(f"aggregates over {sorted(branches)} would multiply each other's rows")
        keys = list(groups if groups is not None else self.values or [])
        sets = [k for k in keys if isinstance(k, (Rollup, Cube, GroupingSets))]
        plain = [k for k in keys if isinstance(k, str)]
        if len(sets) > 1:
            raise QueryError("a query has one grouping set")
        if sets:
            return self._sets(plain, sets[0].sets, pending)
        columns = [self.resolve(k).alias(k) for k in plain]
        folded = [e.column(self).alias(n) for n, e in pending.items()]
        self._folded(self.df.groupBy(*columns).agg(*folded) if folded else self.df.select(*columns).distinct(), [*plain, *pending])

    def _folded(self, df: DataFrame, names: list[str]) -> None:
        keep = [o[0] for o in self.outer if o[0] in df.columns]
        self.df, self.grouped = df, True
        self.values = [n for n in names if n not in keep]
        self.paths, self.alias, self.many = {}, {}, set()

    def _sets(self, plain: list[str], sets: list[list[str]], pending: dict[str, Expression]) -> None:
        every = list(dict.fromkeys([*plain, *(f for s in sets for f in s)]))
        df = self.df.withColumns({f"__g{i}": self.resolve(k) for i, k in enumerate(every)})
        place = {k: f"__g{i}" for i, k in enumerate(every)}
        chosen = [[S.col(place[k]) for k in [*plain, *s]] for s in sets]
        folded = [S.grouping(place[k]).cast("long").alias(f"__bit_{k}") for k in every]
        self.df = df
        plain_pending = {n: e for n, e in pending.items() if not any(isinstance(x, Grouping) for x in e.walk())}
        folded += [e.column(self).alias(n) for n, e in plain_pending.items()]
        out = df.groupingSets(chosen, *[S.col(place[k]) for k in every]).agg(*folded)
        self.df = out.withColumnsRenamed({place[k]: k for k in every})
        for n, e in pending.items():
            if n not in plain_pending:
                self.df = self.df.withColumn(n, e.column(self))
        self._folded(self.df.drop(*[f"__bit_{k}" for k in every]), [*every, *pending])

    def _per_row(self, pending: dict[str, Expression]) -> None:
        """Aggregates beside model rows: each to-many branch is folded on its own key
        first and then joined, so branches can't multiply each other."""
        by: dict[str | None, dict[str, Expression]] = {}
        for n, e in pending.items():
            by.setdefault(self.branch(e), {})[n] = e
        shared = [b for b in by if b and any(p == b or p.startswith(b + SEP) for p in self.paths)]
        # An aggregate that reads columns of the row itself too needs the joined rows.
        shared += [b for b, parts in by.items() if b and any(isinstance(x, F) and x.path != b and not x.path.startswith(b + SEP) for e in parts.values() for x in e.walk())]
        if None in by or shared:
            if len([b for b in by if b]) > 1:
                raise FanOutError(f"aggregates over {sorted(b for b in by if b)} would multiply each other's rows")
            rows = [e.column(self).alias(n) for n, e in pending.items()]
            keep = [c for c in [*self.base, *sorted(self.names - set(pending)), *(o[0] for o in self.outer)] if c in self.df.columns]
            joined = [c for c in self.df.columns if c not in keep and any(c.startswith(self.alias[p] + SEP) for p in self.paths if p not in self.many and not any(p.startswith(m + SEP) for m in self.many))]
            self.df = self.df.groupBy(*[S.col(f"`{c}`") for c in [*keep, *joined]]).agg(*rows)
            self.paths = {p: m for p, m in self.paths.items() if any(c.startswith(self.alias[p] + SEP) for c in joined)}
            self.many = set()
            return
        for b, parts in by.items():
            relation = self.model.relations[b]
            inner = Compiler(self.db, self.model, self._branch_rows(relation, b), self.options)
            inner.paths[b], inner.alias[b] = self.db.registry.models[relation.target], b
            folded = [e.column(inner).alias(n) for n, e in parts.items()]
            keys = [S.col(c).alias(f"__k{i}") for i, c in enumerate(relation.here)]
            right = inner.df.groupBy(*keys).agg(*folded)
            self.df = self.df.join(right, [S.col(f"`{c}`") == S.col(f"__k{i}") for i, c in enumerate(relation.here)], "left").drop(*[f"__k{i}" for i in range(len(keys))])
            for n, e in parts.items():
                if isinstance(e, Aggregate) and e.empty is not None:
                    self.df = self.df.withColumn(n, S.coalesce(S.col(n), S.lit(e.empty)))

    def _branch_rows(self, relation: Any, prefix: str) -> DataFrame:
        """The related rows under their path's names, with the owner's key."""
        right = self.db.rows(self.db.registry.models[relation.target], self.options.get("deleted", "hide"), self.options.get("all_tenants", False))
        columns = [S.col(c).alias(f"{prefix}{SEP}{c}") for c in right.columns]
        if not relation.through:
            return right.select(*[S.col(t).alias(h) for h, t in zip(relation.here, relation.there, strict=True)], *columns)
        link = self.db.frame(relation.through).select(*[S.col(c).alias(f"__o{i}") for i, c in enumerate(relation.through_here)], *[S.col(c).alias(f"__t{i}") for i, c in enumerate(relation.through_there)])
        met = link.join(right, [S.col(f"__t{i}") == S.col(c) for i, c in enumerate(relation.there)])
        return met.select(*[S.col(f"__o{i}").alias(h) for i, h in enumerate(relation.here)], *columns)

    # -- output ----------------------------------------------------------------

    def shown(self) -> list[str]:
        if self.values is not None:
            return [v for v in self.values if v not in self.hidden]
        return [c for c in [*self.base, *[n for n in self.df.columns if n in self.names and n not in self.base]] if c not in self.hidden]

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*[o.column(self) for o in self.order]) if self.order else self.df

    def selected(self, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*[S.col(f"`{v}`") if v in have else self.resolve(v).alias(v) for v in self.shown()])


class QuerySet:
    """A lazy query over one model, or over the result of another query."""

    def __init__(self, db: Database, model: Model | None, steps: tuple = (), source: DataFrame | None = None, options: dict[str, Any] | None = None):
        self.db, self.model, self.steps, self.source, self.options = db, model, steps, source, options or {}

    def _then(self, name: str, *args: Any, **kw: Any) -> QuerySet:
        return QuerySet(self.db, self.model, (*self.steps, (name, args, kw)), self.source, self.options)

    def _option(self, **kw: Any) -> QuerySet:
        return QuerySet(self.db, self.model, self.steps, self.source, self.options | kw)

    # -- building --------------------------------------------------------------

    def all(self) -> QuerySet: return self
    def none(self) -> QuerySet: return self._then("none")
    def filter(self, *q: Any, **kw: Any) -> QuerySet: return self._then("filter", Q(*q, **kw))
    def prewhere(self, *q: Any, **kw: Any) -> QuerySet: return self.filter(*q, **kw)
    def exclude(self, *q: Any, **kw: Any) -> QuerySet: return self._then("exclude", Q(*q, **kw))
    def annotate(self, **kw: Any) -> QuerySet: return self._then("annotate", kw)
    def alias(self, **kw: Any) -> QuerySet: return self._then("annotate", kw, True)
    def values(self, *names: str, **kw: Any) -> QuerySet: return self._then("values", *names, **kw)
    def values_list(self, *names: str, flat: bool = False, **kw: Any) -> QuerySet:
        if flat and len(names) + len(kw) != 1:
            raise QueryError("a flat list has one column")
        return self._then("values", *names, **kw)
    def only(self, *names: str) -> QuerySet: return self._then("only", *names)
    def defer(self, *names: str) -> QuerySet: return self._then("defer", *names)
    def order_by(self, *by: Any) -> QuerySet: return self._then("order_by", *by)
    def reverse(self) -> QuerySet: return self._then("reverse")
    def distinct(self, *names: str) -> QuerySet: return self._then("distinct", *names)
    def group_by(self, *keys: Any) -> QuerySet: return self._then("group_by", *keys)
    def limit(self, n: int) -> QuerySet: return self._then("slice", 0, n)
    def offset(self, n: int) -> QuerySet: return self._then("slice", n, None)
    def limit_by(self, n: int, *by: str, offset: int = 0) -> QuerySet: return self._then("limit_by", n, *by, offset=offset)
    def with_totals(self) -> QuerySet: return self._then("with_totals")
    def join(self, other: QuerySet, name: str, on: dict[str, str] | None = None, condition: str | None = None, how: str = "inner") -> QuerySet:
        """Join another query: ``on`` pairs equal columns, ``condition`` is SQL over this
        query's columns and ``name__column``; neither makes a cross join.  The other's
        columns come as ``name__column``."""
        return self._then("join", other, name, on or {}, condition, how)
    def select_related(self, *paths: str) -> QuerySet: return self._then("select_related", *paths)
    def defer_related(self, *paths: str) -> QuerySet: return self._then("defer_related", *paths)
    def prefetch_related(self, *paths: Any) -> QuerySet: return self._then("prefetch", *paths)
    def after_cursor(self, *values: Any) -> QuerySet: return self._then("cursor", values, True)
    def before_cursor(self, *values: Any) -> QuerySet: return self._then("cursor", values, False)
    def sample(self, percent: float, seed: int = 0) -> QuerySet: return self._option(sample=(percent, seed))
    def sample_offset(self, offset: float) -> QuerySet:
        if "sample_rows" not in self.options:
            raise QueryError("an offset needs a sample")
        return self._option(sample_rows=(self.options["sample_rows"][0], offset))
    def sample_rows(self, part: float, offset: float = 0.0) -> QuerySet: return self._option(sample_rows=(part, offset))
    def final(self) -> QuerySet: return self._option(final=True)
    def include_deleted(self) -> QuerySet: return self._option(deleted="show")
    def only_deleted(self) -> QuerySet: return self._option(deleted="only")
    def all_tenants(self) -> QuerySet: return self._option(all_tenants=True)
    def settings(self, **conf: str) -> QuerySet: return self._option(settings=conf)
    def with_cte(self, name: str, queryset: QuerySet) -> QuerySet:
        return self._option(ctes={**self.options.get("ctes", {}), name: queryset})
    def with_recursive(self, relation: str, max_depth: int | None = None) -> QuerySet: return self._then("recursive", relation, max_depth)
    def using(self, root: str) -> QuerySet:
        return QuerySet(self.db.using(root), self.model, self.steps, self.source, self.options)
    def transform(self, fn: Any) -> QuerySet:
        """Apply a function from DataFrame to DataFrame to the rows so far."""
        return QuerySet(self.db, None, (), fn(self.df))
    def related(self, relation: str, *key: Any) -> QuerySet:
        """The rows that one owner, given by key, reaches over a relation."""
        r = self.model.relations[relation]
        target = self.db.registry.models[r.target]
        if r.through:
            link = self.db.frame(r.through)
            for c, v in zip(r.through_here, key, strict=True):
                link = link.where(S.col(c) == v)
            keys = link.select(*[S.col(a).alias(b) for a, b in zip(r.through_there, r.there, strict=True)]).distinct()
            return QuerySet(self.db, target, (), self.db.rows(target).join(keys, list(r.there), "left_semi"))
        return QuerySet(self.db, target).filter(**dict(zip(r.there, key, strict=True)))

    def latest_versions(self) -> QuerySet: return self.final()
    def select_for_update(self, **_: Any) -> QuerySet:
        raise UnsupportedError("rows can't be locked")

    def __getitem__(self, at: Any) -> QuerySet:
        if isinstance(at, slice):
            start = at.start or 0
            return self._then("slice", start, None if at.stop is None else at.stop - start)
        return self._then("slice", at, 1)

    # -- combining -------------------------------------------------------------

    def _combine(self, others: Sequence[QuerySet], fold: Any) -> QuerySet:
        df = self.df
        for o in others:
            df = fold(df, o.df.toDF(*df.columns))
        return QuerySet(self.db, None, (), df)

    def union(self, *others: QuerySet, all: bool = False) -> QuerySet:
        out = self._combine(others, lambda a, b: a.union(b))
        return out if all else out.distinct()

    def intersection(self, *others: QuerySet) -> QuerySet: return self._combine(others, lambda a, b: a.intersect(b))
    def difference(self, *others: QuerySet) -> QuerySet: return self._combine(others, lambda a, b: a.subtract(b))

    # -- compiling -------------------------------------------------------------

    def compiled(self, correlated: bool = False) -> Compiler:
        if self.source is not None or self.model is None:
            base = self.source
        else:
            base = self.db.rows(self.model, self.options.get("deleted", "hide"), self.options.get("all_tenants", False))
        if "sample" in self.options:
            percent, seed = self.options["sample"]
            base = base.sample(percent / 100, seed)
        if "sample_rows" in self.options:
            part, start = self.options["sample_rows"]
            at = S.pmod(S.xxhash64(*self.model.key), S.lit(1_000_000)) / 1_000_000
            base = base.where((at >= start) & (at < start + part))
        if self.options.get("final"):
            if not self.model.version:
                raise QueryError(f"{self.model.name} has no version column")
            w = W.partitionBy(*self.model.key).orderBy(S.col(self.model.version).desc())
            base = base.withColumn("__v", S.row_number().over(w)).where("__v = 1").drop("__v")
        ctx = Compiler(self.db, self.model, base, self.options)
        for name, queryset in self.options.get("ctes", {}).items():
            queryset.df.createOrReplaceTempView(name)
        for name, args, kw in self.steps:
            getattr(self, f"_do_{name}")(ctx, *args, **kw)
        if ctx.pending:
            if ctx.outer:  # a correlated fold has a group for each outer key
                ctx.values = list(dict.fromkeys([*(ctx.values or ()), *(o[0] for o in ctx.outer)]))
        ctx.flush()
        return ctx

    @property
    def df(self) -> DataFrame:
        """The DataFrame of the query, with the selected columns."""
        if conf := self.options.get("settings"):  # a session of the query's own, so they end with it
            if self.model is None or self.source is not None:
                raise UnsupportedError("settings hold for queries of a model's table")
            options = {k: v for k, v in self.options.items() if k != "settings"}
            return QuerySet(self.db.with_settings(conf), self.model, self.steps, None, options).df
        ctx = self.compiled()
        missing = [v for v in ctx.shown() if v not in ctx.df.columns]
        for v in missing:
            column = ctx.resolve(v)
            ctx.df = ctx.df.withColumn(v, column)
        return ctx.selected(ctx.sorted())

    def empty_value(self) -> Any:
        """What an aggregate of this query gives for no rows."""
        for name, args, _ in reversed(self.steps):
            if name == "annotate":
                for e in args[0].values():
                    if isinstance(e, Aggregate):
                        return e.empty
        return None

    def _do_none(self, ctx: Compiler) -> None:
        ctx.df = ctx.df.limit(0)

    def _do_filter(self, ctx: Compiler, q: Q) -> None:
        roots = {p.split(SEP)[0] for p in ctx.many if p in ctx.paths} if ctx.to_many(q) and not ctx.pending else set()
        first = None
        if roots:  # a new filter() reads a related row of its own; aggregates keep the first
            mine = [p for p in ctx.paths if p.split(SEP)[0] in roots]
            first = ({p: ctx.paths.pop(p) for p in mine}, {p: ctx.alias.pop(p) for p in mine}, {c: f"__first_{c}" for c in ctx.df.columns if c.split(SEP)[0] in roots})
            ctx.df = ctx.df.withColumnsRenamed(first[2])
        self._filtered(ctx, q)
        if first:
            ctx.df = ctx.df.drop(*[c for c in ctx.df.columns if any(c.startswith(f"{a}{SEP}") for p, a in ctx.alias.items() if p.split(SEP)[0] in roots)])
            ctx.df = ctx.df.withColumnsRenamed({v: k for k, v in first[2].items()})
            ctx.paths |= first[0]
            ctx.alias |= first[1]

    def _filtered(self, ctx: Compiler, q: Q) -> None:
        if q.connector == "AND" and not q.negated:
            rest = Q()
            for p in q.parts:
                if isinstance(p, Exists):
                    ctx.semi(p.queryset, p.negated)
                elif isinstance(p, tuple) and isinstance(p[1], QuerySet) and p[0].endswith(("__in", "__not_in")) and not ctx.to_many(Q(p)):
                    self._semi_in(ctx, *p)
                elif isinstance(p, tuple) and p[0].endswith("__in") and isinstance(p[1], (list, tuple, set)) and len(p[1]) > LARGE_LIST and None not in p[1]:
                    self._semi_list(ctx, *p)
                else:
                    rest.parts.append(p)
            q = rest
            conds = []
            for p in q.parts:
                ctx.inner = isinstance(p, tuple) and rejects_null(*p)
                conds.append(ctx.lookup(*p) if isinstance(p, tuple) else ctx.condition(p))  # may join first
                ctx.inner = False
            for cond in conds:
                ctx.df = ctx.df.where(cond)
        elif q.parts:
            cond = ctx.condition(q)
            ctx.df = ctx.df.where(cond)

    def _semi_list(self, ctx: Compiler, path: str, values: Any) -> None:
        """A long list as one local relation: a plan of thousands of literals is slow to build."""
        path, mark = path.rpartition(SEP)[0], f"__s{next(_ids)}"
        composite = path == "pk" and ctx.model and len(ctx.model.key) > 1
        columns = [S.col(k) for k in ctx.model.key] if composite else [ctx.resolve(path)]
        kinds = [ctx.df.select(c).schema[0].dataType for c in columns]
        rows = list(values) if composite else [(v,) for v in values]
        right = self.db.spark.createDataFrame(pd.DataFrame(rows, columns=[f"{mark}{i}" for i in range(len(columns))]))
        cond = [c == S.col(f"{mark}{i}").cast(k) for i, (c, k) in enumerate(zip(columns, kinds, strict=True))]
        ctx.df = ctx.df.join(right, cond, "left_semi")  # Spark knows its size

    def _semi_in(self, ctx: Compiler, path: str, queryset: QuerySet) -> None:
        path, _, name = path.rpartition(SEP)
        right = queryset.df
        mark = f"__s{next(_ids)}"
        right = right.select(S.col(f"`{right.columns[0]}`").alias(mark))
        column = ctx.resolve(path)
        ctx.df = ctx.df.join(right, column.eqNullSafe(S.col(mark)), "left_semi" if name == "in" else "left_anti")

    def _do_exclude(self, ctx: Compiler, q: Q) -> None:
        if ctx.model and ctx.to_many(q) and not ctx.grouped:
            inner = Compiler(ctx.db, ctx.model, ctx.db.rows(ctx.model, self.options.get("deleted", "hide"), self.options.get("all_tenants", False)), self.options)
            cond = inner.condition(q)
            mark = [f"__x{next(_ids)}" for _ in ctx.model.key]
            right = inner.df.where(cond).select(*[S.col(k).alias(m) for k, m in zip(ctx.model.key, mark, strict=True)])
            ctx.df = ctx.df.join(right, [S.col(f"`{k}`") == S.col(m) for k, m in zip(ctx.model.key, mark, strict=True)], "left_anti")
            return
        cond = ctx.condition(~q)
        ctx.df = ctx.df.where(cond)

    def _do_annotate(self, ctx: Compiler, given: dict[str, Any], hide: bool = False) -> None:
        for name, e in given.items():
            if isinstance(e, FilteredRelation):
                ctx.named[name] = e
                continue
            if isinstance(e, (AsofJoin, ArrayJoin, JsonTable, Lateral)):
                e.apply(ctx, name)
                continue
            e = e if isinstance(e, Expression) else Value(e)
            ctx.names.add(name)
            if hide:
                ctx.hidden.add(name)
            if e.aggregates:
                if any(isinstance(x, F) and x.path in ctx.pending for x in e.walk()):
                    ctx.flush()
                ctx.pending[name] = e
            else:
                column = e.column(ctx)  # may flush or join first
                ctx.df = ctx.df.withColumn(name, column)
            if ctx.values is not None and not hide and name not in ctx.values and name not in ctx.pending:
                ctx.values.append(name)

    def _do_values(self, ctx: Compiler, *names: str, **kw: Any) -> None:
        self._do_annotate(ctx, kw)
        if ctx.pending:
            ctx.flush()
        for n in names:
            if n not in ctx.df.columns and n != "pk":
                column = ctx.resolve(n)
                ctx.df = ctx.df.withColumn(n, column)
        ctx.values = [x for n in names for x in (ctx.model.key if n == "pk" else (n,))] + list(kw)
        if not names and not kw:
            ctx.values = None

    def _do_only(self, ctx: Compiler, *names: str) -> None:
        ctx.values = list(dict.fromkeys([*(ctx.model.key if ctx.model else ()), *names]))

    def _do_defer(self, ctx: Compiler, *names: str) -> None:
        ctx.values = [c for c in ctx.shown() if c not in names]

    def _do_order_by(self, ctx: Compiler, *by: Any) -> None:
        ctx.order = [ordering(b) for b in by]
        for o in ctx.order:
            for x in o.by.walk():
                if isinstance(x, F):
                    ctx.resolve(x.path)

    def _do_reverse(self, ctx: Compiler) -> None:
        order = ctx.order or [ordering(k) for k in (ctx.model.ordering or ctx.model.key)]
        ctx.order = [o.flipped() for o in order]

    def _do_distinct(self, ctx: Compiler, *names: str) -> None:
        ctx.flush()
        if names:
            order = [o.column(ctx) for o in ctx.order] or [S.lit(1)]
            w = W.partitionBy(*[ctx.resolve(n) for n in names]).orderBy(*order)
            ctx.df = ctx.df.withColumn("__d", S.row_number().over(w)).where("__d = 1").drop("__d")
            return
        shown = ctx.shown()
        for v in shown:
            if v not in ctx.df.columns:
                column = ctx.resolve(v)
                ctx.df = ctx.df.withColumn(v, column)
        ctx.df = ctx.df.select(*[S.col(f"`{c}`") for c in shown]).distinct()
        ctx.values, ctx.frozen = shown, True

    def _do_group_by(self, ctx: Compiler, *keys: Any) -> None:
        ctx.groups = list(keys)

    def _do_slice(self, ctx: Compiler, start: int, length: int | None) -> None:
        ctx.flush()
        df = ctx.sorted()
        df = df.offset(start) if start else df
        ctx.df = df if length is None else df.limit(length)
        ctx.frozen = True

    def _do_limit_by(self, ctx: Compiler, n: int, *by: str, offset: int = 0) -> None:
        ctx.flush()
        w = W.partitionBy(*[ctx.resolve(b) for b in by]).orderBy(*([o.column(ctx) for o in ctx.order] or [S.lit(1)]))
        ctx.df = ctx.df.withColumn("__l", S.row_number().over(w)).where((S.col("__l") > offset) & (S.col("__l") <= offset + n)).drop("__l")

    def _do_with_totals(self, ctx: Compiler) -> None:
        """The groups and one row of totals, by two grouping sets in one pass."""
        keys = [k for k in (ctx.groups if ctx.groups is not None else ctx.values or [])]
        ctx.groups = [GroupingSets(keys, ())]

    def _do_join(self, ctx: Compiler, other: QuerySet, name: str, on: dict[str, str], condition: str | None, how: str) -> None:
        right = other.df
        right = right.select(*[S.col(f"`{c}`").alias(f"{name}{SEP}{c}") for c in right.columns])
        columns = {path: ctx.resolve(path) for path in on}  # may join first
        cond = S.expr(condition) if condition else S.lit(True)
        for path, there in on.items():
            cond = cond & (columns[path] == S.col(f"`{name}{SEP}{there}`"))
        ctx.df = ctx.df.join(right, cond, how) if on or condition else ctx.df.crossJoin(right)

    def _do_select_related(self, ctx: Compiler, *paths: Any) -> None:
        for path in paths:
            if isinstance(path, Select):
                if path.extra_condition is not None and path.path not in ctx.paths:
                    parent, _, name = path.path.rpartition(SEP)
                    if parent:
                        ctx.resolve(f"{parent}{SEP}{self._reached(ctx, parent).key[0]}")
                    model = self._reached(ctx, parent) if parent else ctx.model
                    ctx.join(path.path, model, name, parent, FilteredRelation(name, path.extra_condition))
                path = path.path
            ctx.resolve(f"{path}{SEP}{self._reached(ctx, path).key[0]}")
            if path not in ctx.paths:
                parent, model = "", ctx.model
                done: list[str] = []
                for part in path.split(SEP):
                    done.append(part)
                    model = ctx.join(SEP.join(done), model, part, SEP.join(done[:-1]))
            prefix, model = ctx.alias[path] + SEP, ctx.paths[path]
            fields = [c for c in ctx.df.columns if c.startswith(prefix) and SEP not in c[len(prefix) :]]
            met = S.col(f"`{prefix}{model.key[0]}`").isNotNull()
            ctx.df = ctx.df.withColumn(path, S.when(met, S.struct(*[S.col(f"`{f}`").alias(f[len(prefix) :]) for f in fields])))
            ctx.names.add(path)

    def _do_defer_related(self, ctx: Compiler, *paths: str) -> None:
        """Related rows are no longer among the columns."""
        ctx.names -= set(paths)
        ctx.hidden |= set(paths)

    def _reached(self, ctx: Compiler, path: str) -> Model:
        model = ctx.model
        for part in path.split(SEP):
            model = ctx.db.registry.models[model.relations[part].target]
        return model

    def _do_prefetch(self, ctx: Compiler, *paths: Any) -> None:
        """Related rows as an array of structs, sorted by key; a slice of the related
        query keeps so many for each parent."""
        for p in paths:
            p = p if isinstance(p, Prefetch) else Prefetch(p)
            relation = ctx.model.relations[p.path]
            target = ctx.db.registry.models[relation.target]
            queryset, cut = p.queryset or QuerySet(ctx.db, target), None
            if queryset.steps and queryset.steps[-1][0] == "slice":
                cut = queryset.steps[-1][1]
                queryset = QuerySet(ctx.db, target, queryset.steps[:-1], queryset.source, queryset.options)
            inner = queryset.compiled()
            right, keys = inner.selected(inner.df), list(relation.there)
            if relation.through:
                link = ctx.db.frame(relation.through).select(*[S.col(c).alias(f"__l{i}") for i, c in enumerate(relation.through_here)], *[S.col(c).alias(f"__r{i}") for i, c in enumerate(relation.through_there)])
                right = link.join(right, [S.col(f"__r{i}") == S.col(c) for i, c in enumerate(relation.there)])
                keys = [f"__l{i}" for i in range(len(relation.through_here))]
            order = inner.order or [ordering(k) for k in target.key]
            inner.df = right
            w = W.partitionBy(*keys).orderBy(*[o.column(inner) for o in order])
            right = right.withColumn("__n", S.row_number().over(w))
            if cut:
                start, length = cut
                right = right.where((S.col("__n") > start) & (S.lit(True) if length is None else S.col("__n") <= start + length))
            shown = [c for c in inner.shown()]
            rows = S.transform(S.sort_array(S.collect_list(S.struct("__n", S.struct(*shown).alias("row")))), lambda r: r["row"])
            name = p.to or p.path
            right = right.groupBy(*[S.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(rows.alias(name))
            df = ctx.df.join(right, [S.col(f"`{a}`") == S.col(f"__k{i}") for i, a in enumerate(relation.here)], "left").drop(*[f"__k{i}" for i in range(len(keys))])
            ctx.df = df.withColumn(name, S.coalesce(name, S.array().cast(df.schema[name].dataType)))
            ctx.names.add(name)

    def _do_cursor(self, ctx: Compiler, values: Sequence[Any], after: bool) -> None:
        """Rows past a keyset position: an OR of ANDs over the ordering, null-aware."""
        order = ctx.order if after else [o.flipped() for o in ctx.order]
        if len(values) != len(order):
            raise QueryError("a cursor has one value for each ordering")
        cond, equal = S.lit(False), S.lit(True)
        for o, v in zip(order, values, strict=True):
            c = o.by.column(ctx)
            if v is None:
                past = c.isNotNull() if o.nulls_first else S.lit(False)
                same = c.isNull()
            else:
                past = (c < v) if o.descending else (c > v)
                past = lookups.true_only(past) if o.nulls_first else lookups.true_only(past) | c.isNull()
                same = lookups.true_only(c == v)
            cond, equal = cond | (equal & past), equal & same
        ctx.df = ctx.df.where(cond)
        if not after:
            ctx.order = order

    def _do_recursive(self, ctx: Compiler, relation: str, max_depth: int | None) -> None:
        """The rows so far and all they reach over a self-relation, each once."""
        from quern.operators.recursion import closure

        r = ctx.model.relations[relation]
        if r.target != ctx.model.name:
            raise QueryError(f"{relation} is no self-relation")
        ctx.df = closure(ctx.db.rows(ctx.model), ctx.df.select(*ctx.base), list(ctx.model.key), list(r.here), list(r.there), max_depth)

    # -- results ---------------------------------------------------------------

    def raw(self, sql: str, **params: Any) -> QuerySet:
        """A hand-written SELECT as a query that further steps build on."""
        return QuerySet(self.db, None, (), self.db.raw(sql, **params))

    def aggregate(self, **kw: Expression) -> DataFrame:
        """One row that folds the query's rows."""
        sliced = any(s[0] in ("slice", "distinct", "group_by", "limit_by") for s in self.steps)
        if sliced:
            return QuerySet(self.db, None, (), self.df).aggregate(**kw)
        ctx = self.compiled()
        branches = {b for b in (ctx.branch(e) for e in kw.values()) if b} if ctx.model else set()
        if len(branches) > 1:
            raise FanOutError(f"aggregates over {sorted(branches)} would multiply each other's rows")
        folded = [e.column(ctx).alias(n) for n, e in kw.items()]
        return ctx.df.agg(*folded)

    def count_df(self, name: str = "n") -> DataFrame:
        return self.df.agg(S.count("*").alias(name))

    def count(self) -> int: return self.df.count()
    def exists(self) -> bool: return not self.df.isEmpty()

    def contains(self, **key: Any) -> bool:
        return self.filter(**key).exists()

    def first(self) -> Any:
        rows = (self if any(s[0] == "order_by" for s in self.steps) else self.order_by(*self.model.key))[:1].df.collect()
        return rows[0] if rows else None

    def last(self) -> Any: return self.reverse().first() if any(s[0] == "order_by" for s in self.steps) else self.order_by(*[f"-{k}" for k in self.model.key]).first()
    def earliest(self, *by: str) -> Any: return self.order_by(*by).first()
    def latest(self, *by: str) -> Any: return self.order_by(*by).reverse().first()

    def get(self, *q: Any, **kw: Any) -> Any:
        rows = self.filter(*q, **kw).limit(2).df.collect()
        if len(rows) != 1:
            raise QueryError("no row" if not rows else "more than one row")
        return rows[0]

    def in_bulk(self, ids: Sequence[Any], field: str | None = None) -> dict[Any, Any]:
        field = field or self.model.key[0]
        return {r[field]: r for r in self.filter(**{f"{field}__in": list(ids)}).df.collect()}

    def dates(self, field: str, kind: str, order: str = "ASC") -> QuerySet:
        from quern.functions.datetime import trunc

        df = self.df.select(trunc(S.col(field), kind).cast("date").alias(field)).where(S.col(field).isNotNull()).distinct()
        return QuerySet(self.db, None, (("order_by", (field if order == "ASC" else f"-{field}",), {}),), df)

    def datetimes(self, field: str, kind: str, order: str = "ASC") -> QuerySet:
        df = self.df.select(S.date_trunc(kind, field).alias(field)).where(S.col(field).isNotNull()).distinct()
        return QuerySet(self.db, None, (("order_by", (field if order == "ASC" else f"-{field}",), {}),), df)

    def iterator(self) -> Iterator[Any]: return self.df.toLocalIterator()
    def stream(self) -> Iterator[Any]: return self.df.toLocalIterator(prefetchPartitions=True)
    def cursor_values(self, row: Any) -> tuple:
        return tuple(row[o.by.path] for o in self.compiled().order)
    def explain(self, mode: str = "formatted") -> None: self.df.explain(mode)
    def sql(self) -> str:
        return self.df._jdf.queryExecution().toString()

    def create_view(self, name: str) -> None: self.df.createOrReplaceTempView(name)

    def materialize(self, name: str) -> DataFrame:
        """Store the rows as a table, replacing what was there; ``refresh_materialized_view``
        of the database stores them anew."""
        self.db.materialized[name] = self
        self.df.write.mode("overwrite").saveAsTable(name)
        return self.db.spark.table(name)


def register_extension(name: str, step: Any) -> None:
    """Add a chain method: ``step(df, *args)`` gets and returns a DataFrame."""

    def method(self: QuerySet, *args: Any, **kw: Any) -> QuerySet:
        return self.transform(lambda df: step(df, *args, **kw))

    setattr(QuerySet, name, method)


class Select:
    """A relation for ``select_related`` whose rows must meet a condition too."""

    def __init__(self, path: str, extra_condition: Q | None = None):
        self.path, self.extra_condition = path, extra_condition


def prefetch_related_objects(db: Database, model: str, rows: Sequence[Any], *paths: Any) -> list[Any]:
    """The same rows with related ones as arrays, read for their keys in one query a path."""
    key = db.registry.models[model].key
    found = {tuple(r[k] for k in key): r for r in db(model).filter(pk__in=[tuple(r[k] for k in key) if len(key) > 1 else r[key[0]] for r in rows]).prefetch_related(*paths).df.collect()}
    return [found[tuple(r[k] for k in key)] for r in rows]


class Prefetch:
    def __init__(self, path: str, queryset: QuerySet | None = None, to: str | None = None):
        self.path, self.queryset, self.to = path, queryset, to


__all__ = ["Compiler", "FanOutError", "Prefetch", "QuerySet", "Select", "prefetch_related_objects", "register_extension"]
