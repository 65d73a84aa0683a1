"""Writes to stored tables: each rewrites a table's Parquet folder in one replacement."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as S

from quern.operators import writes
from quern.operators.expressions import Expression, QueryError
from quern.sources.models import Database, Model
from quern.sources.tables import replace_table, staged, swap, write_table


class Table:
    """A model's stored table."""

    def __init__(self, db: Database, model: str):
        self.db, self.model = db, db.registry.models[model]

    @property
    def path(self) -> str:
        return self.db.path(self.model.table)

    def read(self) -> DataFrame:
        return self.db.spark.read.parquet(self.path)

    def _replace(self, df: DataFrame) -> None:
        replace_table(df.select(*self.read().columns), self.path)
        self.db.frames.pop(self.model.table, None)

    def _append(self, df: DataFrame) -> None:
        there = self.read().schema
        write_table(df.select(*[S.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else S.lit(None).cast(f.dataType).alias(f.name) for f in there]), self.path)
        self.db.frames.pop(self.model.table, None)

    def frame(self, rows: Sequence[dict[str, Any]]) -> DataFrame:
        there = self.read().schema
        return self.db.spark.createDataFrame([tuple(r.get(f.name) for f in there) for r in rows], there)

    def create(self, **row: Any) -> None:
        self._append(self.frame([row]))

    def save(self, row: dict[str, Any]) -> None:
        """Insert one row, or set its other columns where its key is there."""
        self.bulk_create([row], update=[c for c in row if c not in self.model.key])

    def bulk_create(self, rows: Sequence[dict[str, Any]] | DataFrame, ignore_conflicts: bool = False, update: Sequence[str] | None = None) -> None:
        """Insert rows; on a known key do nothing, or set the ``update`` columns."""
        df = rows if isinstance(rows, DataFrame) else self.frame(rows)
        if not ignore_conflicts and update is None:
            self._append(df)
        else:
            self._replace(writes.upserted(self.read(), df, self.model.key, update))

    def insert_from(self, rows: DataFrame) -> None:
        self._append(rows)

    def bulk_update(self, rows: Sequence[dict[str, Any]], fields: Sequence[str]) -> None:
        self._replace(writes.bulk_updated(self.read(), self.frame(rows), self.model.key, fields))

    def update(self, where: Column, returning: str | None = None, **values: Any) -> DataFrame | None:
        """Set columns of the rows where a condition holds.  ``returning`` names a folder
        for the changed rows as they were and are (``old``, ``new``)."""
        given = {c: v if isinstance(v, Column) else S.lit(v) for c, v in values.items() if not isinstance(v, Expression)}
        if len(given) < len(values):
            raise QueryError("values of a stored table's update are columns or literals")
        before = self.read()
        if returning:
            writes.returning(before, where, **given).write.parquet(returning)
        self._replace(writes.updated(before, where, **given))
        return self.db.spark.read.parquet(returning) if returning else None

    def delete(self, where: Column) -> None:
        """Remove rows, or mark them where the model deletes softly."""
        if self.model.soft_delete:
            self.update(where & S.col(self.model.soft_delete).isNull(), **{self.model.soft_delete: S.current_timestamp()})
        else:
            self.hard_delete(where)

    def hard_delete(self, where: Column) -> None:
        self._replace(writes.deleted(self.read(), where))

    def restore(self, where: Column) -> None:
        if not self.model.soft_delete:
            raise QueryError(f"{self.model.name} has no soft delete")
        self.update(where, **{self.model.soft_delete: S.lit(None)})

    def merge(self, merge: writes.Merge) -> None:
        self._replace(merge.checked().result())

    def get_or_create(self, defaults: dict[str, Any] | None = None, **key: Any) -> tuple[Any, bool]:
        found = self._matching(key)
        if found:
            return found[0], False
        self.create(**key, **(defaults or {}))
        return self._matching(key)[0], True

    def update_or_create(self, defaults: dict[str, Any], **key: Any) -> tuple[Any, bool]:
        if self._matching(key):
            where = S.lit(True)
            for k, v in key.items():
                where = where & (S.col(k) == v)
            self.update(where, **defaults)
            return self._matching(key)[0], False
        self.create(**key, **defaults)
        return self._matching(key)[0], True

    def _matching(self, key: dict[str, Any]) -> list[Any]:
        df = self.read()
        for k, v in key.items():
            df = df.where(S.col(k) == v)
        rows = df.limit(2).collect()
        if len(rows) > 1:
            raise QueryError("more than one row")
        return rows


def delete_everywhere(db: Database, model: str, rows: DataFrame, policies: dict[str, str] | None = None) -> dict[str, int]:
    """Delete rows and what their relations' policies reach; counts by model."""
    d = writes.Deletion(db, policies).collect(model, rows)
    counts = d.preview()
    after = {m: d.remaining(m) for m in {*d.gone, *d.cleared}}
    tables = {m: Table(db, m) for m in after}
    new = {m: staged(df.select(*tables[m].read().columns), tables[m].path) for m, df in after.items()}
    for m, table in tables.items():  # only when all of them are complete
        swap(db.spark, table.path, new[m])
        db.frames.pop(table.model.table, None)
    return counts


def summed_model(df: DataFrame, model: Model, columns: Sequence[str]) -> DataFrame:
    """Rows of a table whose merges add up: one row for each key."""
    return df.groupBy(*model.key).agg(*[S.sum(c).alias(c) for c in columns])


def collapsed(df: DataFrame, model: Model, sign: str) -> DataFrame:
    """Rows of a table whose versions cancel: those whose signs add up to more than zero."""
    rest = [c for c in df.columns if c not in model.key and c != sign]
    return df.groupBy(*model.key, *rest).agg(S.sum(sign).alias(sign)).where(S.col(sign) > 0)
