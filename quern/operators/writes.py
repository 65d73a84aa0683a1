"""Writes as copy-on-write plans: what a table holds after them, and what changed."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as S

from quern.operators.expressions import QueryError
from quern.sources.models import Database, Relation


def updated(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """The rows with columns set where a condition is true."""
    cond = S.coalesce(where, S.lit(False))
    return df.select(*[S.when(cond, values[c]).otherwise(S.col(c)).cast(df.schema[c].dataType).alias(c) if c in values else S.col(c) for c in df.columns])


def deleted(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~S.coalesce(where, S.lit(False)))


def upserted(table: DataFrame, rows: DataFrame, key: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Insert rows; where the key is there, set the ``update`` columns (none: keep the old row).

    A key may be given once: rows are deduplicated by the caller."""
    new = rows.select(*[S.col(c).alias(f"__new_{c}") for c in rows.columns], S.lit(True).alias("__given"))
    both = table.withColumn("__there", S.lit(True)).join(new, [S.col(k) == S.col(f"__new_{k}") for k in key], "full_outer")
    change = set(update or ())
    out = []
    for c in table.columns:
        fresh = S.col(f"__new_{c}") if c in rows.columns else S.lit(None)
        take = S.col("__there").isNull() | (S.col("__given").isNotNull() & S.lit(c in change))
        out.append(S.when(take, fresh).otherwise(S.col(c)).cast(table.schema[c].dataType).alias(c))
    return both.select(*out)


def bulk_updated(table: DataFrame, rows: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Set fields of the rows that are given by key; keys that aren't there change nothing."""
    new = rows.select(*key, *[S.col(f).alias(f"__{f}") for f in fields], S.lit(True).alias("__hit"))
    both = table.join(new, list(key), "left")
    return both.select(*[S.when(S.col("__hit"), S.col(f"__{c}")).otherwise(S.col(c)).cast(table.schema[c].dataType).alias(c) if c in fields else S.col(c) for c in table.columns])


def returning(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """The rows that an update would change, as they were and are (``old``, ``new``)."""
    kinds = {f.name: f.dataType for f in table.schema}
    new = [values[c].cast(kinds[c]).alias(c) if c in values else S.col(c) for c in table.columns]
    return table.where(where).select(S.struct(*table.columns).alias("old"), S.struct(*new).alias("new"))


def inserted_from(table: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT ... SELECT by name."""
    return table.unionByName(rows.select(*table.columns))


class Merge:
    """An ordered MERGE: the first branch that fits a row decides.

    Conditions and values read the target's columns by name and the source's as
    ``src.name``.  A target row that two source rows match is an error."""

    def __init__(self, target: DataFrame, source: DataFrame, on: dict[str, str]):
        self.target, self.source, self.on = target, source, on
        self.branches: list[tuple[str, str, Any, dict[str, Column]]] = []

    def _branch(self, kind: str, action: str, condition: Any, values: dict[str, Column]) -> Merge:
        out = Merge(self.target, self.source, self.on)
        out.branches = [*self.branches, (kind, action, condition, values)]
        return out

    def when_matched(self, action: str, condition: Any = None, **values: Column) -> Merge:
        return self._branch("matched", action, condition, values)

    def when_not_matched(self, condition: Any = None, **values: Column) -> Merge:
        return self._branch("new", "insert", condition, values)

    def when_not_matched_by_source(self, action: str, condition: Any = None, **values: Column) -> Merge:
        return self._branch("alone", action, condition, values)

    def tagged(self) -> DataFrame:
        """Every row after the merge with ``__action``: keep, update, insert or delete."""
        source = self.source.select(S.struct(*self.source.columns).alias("src"), *[S.col(s).alias(f"__on{i}") for i, s in enumerate(self.on.values())])
        source = source.withColumn("__copies", S.lit(1))
        on = [S.col(t) == S.col(f"__on{i}") for i, t in enumerate(self.on)]
        both = self.target.withColumn("__there", S.lit(True)).join(source, on, "full_outer")
        state = S.when(S.col("__there").isNull(), "new").when(S.col("__copies").isNull(), "alone").otherwise("matched")
        which = None
        for i, (kind, _, condition, _) in enumerate(self.branches):
            cond = S.lit(True) if condition is None else S.expr(condition) if isinstance(condition, str) else condition
            fits = (state == kind) & S.coalesce(cond, S.lit(False))
            which = S.when(fits, i) if which is None else which.when(fits, i)
        both = both.withColumn("__state", state).withColumn("__which", which if which is not None else S.lit(None).cast("int"))
        action = S.when(S.col("__which").isNull(), S.when(S.col("__state") == "new", "skip").otherwise("keep"))
        for i, (_, name, _, _) in enumerate(self.branches):
            action = action.when(S.col("__which") == i, "keep" if name == "do_nothing" else name)
        columns = []
        for c in self.target.columns:
            value = None
            for i, (_, name, _, values) in enumerate(self.branches):
                if c in values and name in ("update", "insert"):
                    value = S.when(S.col("__which") == i, values[c]) if value is None else value.when(S.col("__which") == i, values[c])
            columns.append((S.col(c) if value is None else value.otherwise(S.col(c))).cast(self.target.schema[c].dataType).alias(c))
        return both.select(*columns, action.alias("__action")).where("__action != 'skip'")

    def result(self) -> DataFrame:
        return self.tagged().where("__action != 'delete'").drop("__action")

    def returning(self) -> DataFrame:
        """The rows that were written or deleted, with ``action``."""
        return self.tagged().where("__action != 'keep'").withColumnRenamed("__action", "action")

    def checked(self) -> Merge:
        """Raise if two source rows match one target row."""
        keys = list(self.on.values())
        if self.source.join(self.target.select(*[S.col(t).alias(s) for t, s in self.on.items()]), keys, "left_semi").groupBy(*keys).count().where("count > 1").limit(1).count():
            raise QueryError("a target row matches several source rows")
        return self


class Deletion:
    """What deleting rows reaches along to-many relations.

    Policies by relation name: ``cascade`` (default) deletes related rows,
    ``set_null`` clears their key, ``protect`` raises if there are any, ``keep``
    leaves them."""

    def __init__(self, db: Database, policies: dict[str, str] | None = None):
        self.db, self.policies = db, policies or {}
        self.gone: dict[str, DataFrame] = {}
        self.cleared: dict[str, list[tuple[tuple[str, ...], DataFrame]]] = {}

    def collect(self, model: str, rows: DataFrame, _path: tuple[str, ...] = ()) -> Deletion:
        key = self.db.registry.models[model].key
        mine = rows.select(*key).distinct()
        self.gone[model] = self.gone[model].union(mine).distinct() if model in self.gone else mine
        for name, r in self.db.registry.models[model].relations.items():
            if not r.many or r.through or (model, name) in _path:
                continue
            policy = self.policies.get(name, "cascade")
            if policy == "keep":
                continue
            reached = self._reached(r, rows)
            if policy == "protect":
                if not reached.isEmpty():
                    raise QueryError(f"rows of {r.target} are protected")
            elif policy == "set_null":
                self.cleared.setdefault(r.target, []).append((r.there, rows.select(*[S.col(h).alias(t) for h, t in zip(r.here, r.there, strict=True)]).distinct()))
            else:
                self.collect(r.target, reached, (*_path, (model, name)))
        return self

    def _reached(self, r: Relation, rows: DataFrame) -> DataFrame:
        keys = rows.select(*[S.col(h).alias(f"__{t}") for h, t in zip(r.here, r.there, strict=True)]).distinct()
        table = self.db.frame(self.db.registry.models[r.target].table)
        return table.join(keys, [S.col(t) == S.col(f"__{t}") for t in r.there], "left_semi")

    def remaining(self, model: str) -> DataFrame:
        """The table after the deletion."""
        m = self.db.registry.models[model]
        df = self.db.frame(m.table)
        if model in self.gone:
            df = df.join(self.gone[model], list(m.key), "left_anti")
        for columns, keys in self.cleared.get(model, ()):
            marked = df.join(keys.withColumn("__hit", S.lit(True)), list(columns), "left")
            df = marked.select(*[S.when(S.col("__hit").isNull(), S.col(c)).alias(c) if c in columns else S.col(c) for c in df.columns])
        return df

    def preview(self) -> dict[str, int]:
        """How many rows of each model would go."""
        return {m: df.count() for m, df in self.gone.items()}


def link_changes(links: DataFrame, owner: str, member: str, owner_key: Any, members: Sequence[Any], mode: str) -> DataFrame:
    """A link table after ``add``, ``remove``, ``set`` or ``clear`` of an owner's members."""
    mine = S.col(owner) == owner_key
    spark = links.sparkSession
    wanted = spark.createDataFrame([(owner_key, m) for m in members], links.select(owner, member).schema)
    if mode == "clear":
        return deleted(links, mine)
    if mode == "remove":
        return links.join(wanted, [owner, member], "left_anti").select(*links.columns)
    base = links if mode == "add" else links.where(~mine | S.col(member).isin(list(members)))
    fresh = wanted.distinct().join(links, [owner, member], "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)
