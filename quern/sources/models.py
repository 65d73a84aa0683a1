"""Models: declared tables, their keys, types, relations and row scopes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as S
from pyspark.sql import types as T


@dataclass(frozen=True)
class Relation:
    """An edge: rows of ``source`` and ``target`` whose key columns are equal."""

    name: str
    target: str
    here: tuple[str, ...]
    there: tuple[str, ...]
    many: bool = False
    through: str | None = None
    through_here: tuple[str, ...] = ()
    through_there: tuple[str, ...] = ()


@dataclass
class Model:
    """A table with its key, relations by name, column types and scopes.

    ``soft_delete`` names a nullable column whose value marks a row as deleted,
    ``tenant`` the column that says whose row it is, ``version`` the column that
    orders the versions of a key.  ``ordering`` is the default order of model rows.
    """

    name: str
    table: str
    key: tuple[str, ...]
    columns: dict[str, str] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)
    soft_delete: str | None = None
    tenant: str | None = None
    version: str | None = None
    ordering: tuple[str, ...] = ()
    scope: Callable[[DataFrame], Column] | None = None
    json: tuple[str, ...] = ()

    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in self.columns.items()))

    def drift(self, df: DataFrame) -> list[str]:
        """How a stored table differs from the declaration."""
        there = {f.name: f.dataType.simpleString() for f in df.schema}
        wanted = {f.name: f.dataType.simpleString() for f in self.schema()}
        out = [f"missing {c}" for c in wanted if c not in there] + [f"extra {c}" for c in there if c not in wanted]
        return out + [f"{c}: {there[c]} instead of {t}" for c, t in wanted.items() if c in there and there[c] != t]


class Registry:
    """Models by name, with reverse relations filled in."""

    def __init__(self) -> None:
        self.models: dict[str, Model] = {}

    def add(self, model: Model) -> Model:
        self.models[model.name] = model
        return model

    def foreign_key(self, source: str, name: str, target: str, here: str | tuple[str, ...], reverse: str, unique: bool = False) -> None:
        here = (here,) if isinstance(here, str) else here
        there = self.models[target].key
        self.models[source].relations[name] = Relation(name, target, here, there)
        self.models[target].relations[reverse] = Relation(reverse, source, there, here, many=not unique)

    def many_to_many(self, source: str, name: str, target: str, through: str, through_source: str, through_target: str, reverse: str) -> None:
        a, b = self.models[source].key, self.models[target].key
        self.models[source].relations[name] = Relation(name, target, a, b, True, through, (through_source,), (through_target,))
        self.models[target].relations[reverse] = Relation(reverse, source, b, a, True, through, (through_target,), (through_source,))


class Database:
    """Where the models' tables are: a folder of Parquet, views, or given DataFrames."""

    def __init__(self, spark: SparkSession, registry: Registry, root: str | None = None, frames: dict[str, DataFrame] | None = None):
        self.spark, self.registry, self.root = spark, registry, root.rstrip("/") if root else None
        self.frames = dict(frames or {})
        self.tenants: Any = ()
        self.materialized: dict[str, Any] = {}
        self.dictionaries: dict[str, Any] = {}
        self.loaders: dict[str, Any] = {}

    def frame(self, table: str) -> DataFrame:
        """A scan of a table; Spark prunes its columns and pushes filters down."""
        if table not in self.frames:
            if self.root is None:
                return self.spark.table(table)
            self.frames[table] = self.spark.read.parquet(f"{self.root}/{table}.parquet")
        return self.frames[table]

    def path(self, table: str) -> str:
        return f"{self.root}/{table}.parquet"

    def rows(self, model: Model, deleted: str = "hide", all_tenants: bool = False) -> DataFrame:
        """A scan with the model's scopes."""
        df = self.frame(model.table)
        if model.soft_delete and deleted != "show":
            gone = S.col(model.soft_delete).isNotNull()
            df = df.where(gone if deleted == "only" else ~gone)
        if model.tenant and not all_tenants:
            allowed = self.tenants if isinstance(self.tenants, (list, tuple, set)) else (self.tenants,)
            df = df.where(S.col(model.tenant).isin(list(allowed)))
        if model.scope is not None:
            df = df.where(model.scope(df))
        return df

    def using(self, root: str) -> Database:
        """The same models over another folder."""
        return Database(self.spark, self.registry, root)

    def with_settings(self, conf: dict[str, str]) -> Database:
        """The same tables read by a session of their own, with settings that no other query sees."""
        if self.root is None:
            raise ValueError("settings need a folder of tables")
        session = self.spark.newSession()
        for k, v in {**{k: v for k, v in self.spark.conf.getAll.items() if self.spark.conf.isModifiable(k)}, **conf}.items():
            session.conf.set(k, v)
        out = Database(session, self.registry, self.root)
        out.tenants = self.tenants
        return out

    def refresh_materialized_view(self, name: str) -> DataFrame:
        """Store a materialised query's rows anew."""
        return self.materialized[name].materialize(name)

    def add_dictionary(self, name: str, load: Callable[[], DataFrame], key: str) -> Any:
        """A key to attributes table under a name; ``reload_dictionary`` reads it anew."""
        from quern.sources.tables import Dictionary

        self.loaders[name] = (load, key)
        self.dictionaries[name] = Dictionary(load(), key)
        return self.dictionaries[name]

    def reload_dictionary(self, name: str) -> Any:
        return self.add_dictionary(name, *self.loaders[name])

    def scoped(self, *tenants: Any) -> Database:
        """The same database seen by some tenants only."""
        out = Database(self.spark, self.registry, self.root, self.frames)
        out.tenants = tenants
        return out

    def __call__(self, name: str) -> Any:
        from quern.plans.queryset import QuerySet

        return QuerySet(self, self.registry.models[name])

    def view(self, name: str) -> Any:
        """The rows of a view or of a query named by ``with_cte``."""
        from quern.plans.queryset import QuerySet

        return QuerySet(self, None, (), self.spark.table(name))

    def create_function(self, name: str, arguments: str, returns: str, body: str) -> None:
        """A SQL function of the session, from declared text."""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")

    def described(self, sql: str, **params: Any) -> tuple[list[tuple[str, str]], DataFrame]:
        """The names and types of a hand-written SELECT's columns, and its rows."""
        df = self.raw(sql, **params)
        return [(f.name, f.dataType.simpleString()) for f in df.schema], df

    def execute_sql(self, sql: str, schema: str | None = None, **params: Any) -> DataFrame:
        """A hand-written SELECT, its columns read as the types of a DDL ``schema``, by name."""
        df = self.raw(sql, **params)
        return df if schema is None else df.select(*[S.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])

    def raw(self, sql: str, **params: Any) -> DataFrame:
        """A hand-written SELECT over the models' tables, with named parameters bound by Spark."""
        for model in self.registry.models.values():
            self.frame(model.table).createOrReplaceTempView(model.table)
        return self.spark.sql(sql, args=params or None)
