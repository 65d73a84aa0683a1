"""Stored tables: writes through the model, field checks, request queries, extensions."""

import pytest
from pyspark.sql import functions as S

from quern.operators.dml import Table, delete_everywhere
from quern.operators.expressions import QueryError
from quern.plans.queryset import QuerySet, register_extension
from quern.plans.request import RequestQuery
from quern.sources import fields
from quern.sources.models import Database, Model, Registry


@pytest.fixture
def db(spark, tmp_path):
    r = Registry()
    r.add(Model("author", "author", ("id",), soft_delete="gone"))
    r.add(Model("book", "book", ("id",)))
    r.foreign_key("book", "author", "author", "author_id", "books")
    root = f"file://{tmp_path}"
    spark.createDataFrame([(1, "ann", None), (2, "bob", None)], "id int, name string, gone timestamp").write.parquet(f"{root}/author.parquet")
    spark.createDataFrame([(1, 1, 5), (2, 2, 6)], "id int, author_id int, pages int").write.parquet(f"{root}/book.parquet")
    return Database(spark, r, root)


def rows(db, model, *columns):
    return sorted(map(tuple, db(model).values(*columns).df.collect()))


def test_instances_and_bulk(db):
    books = Table(db, "book")
    books.create(id=3, author_id=1, pages=7)
    books.bulk_create([{"id": 3, "author_id": 2, "pages": 9}, {"id": 4, "author_id": 2, "pages": 9}], ignore_conflicts=True)
    assert rows(db, "book", "id", "pages") == [(1, 5), (2, 6), (3, 7), (4, 9)]
    books.bulk_create([{"id": 4, "author_id": 1, "pages": 1}], update=["pages"])
    books.bulk_update([{"id": 1, "pages": 50}], ["pages"])
    assert rows(db, "book", "id", "author_id", "pages") == [(1, 1, 50), (2, 2, 6), (3, 1, 7), (4, 2, 1)]
    returned = books.update(S.col("id") == 2, returning=f"{db.root}/returned", pages=60).first()
    assert (returned["old"]["pages"], returned["new"]["pages"]) == (6, 60)
    books.insert_from(books.read().where("id = 1").withColumn("id", S.lit(9)))
    books.delete(S.col("id") < 4)
    assert rows(db, "book", "id") == [(4,), (9,)]


def test_get_and_update_or_create(db):
    books = Table(db, "book")
    assert books.get_or_create({"pages": 1}, id=1)[1] is False
    assert books.get_or_create({"pages": 1}, id=7)[1] is True
    assert books.update_or_create({"pages": 70}, id=7)[0]["pages"] == 70
    assert books.update_or_create({"pages": 80}, id=8)[1] is True


def test_soft_delete_and_restore(db):
    authors = Table(db, "author")
    authors.delete(S.col("id") == 1)
    assert rows(db, "author", "id") == [(2,)]
    assert [r["id"] for r in db("author").only_deleted().df.collect()] == [1]
    authors.restore(S.col("id") == 1)
    assert rows(db, "author", "id") == [(1,), (2,)]
    with pytest.raises(QueryError):
        Table(db, "book").restore(S.lit(True))


def test_delete_cascades_on_disk(db):
    assert delete_everywhere(db, "author", db("author").filter(id=1).df) == {"author": 1, "book": 1}
    assert rows(db, "book", "id") == [(2,)] and rows(db, "author", "id") == [(2,)]


def test_fields(spark):
    schema = fields.Schema({
        "id": fields.integer("Int", positive=True), "mail": fields.formatted("email", null=True), "kind": fields.enum("a", "b"),
        "size": fields.integer("UInt8"), "twice": fields.generated("int", "size * 2"),
    })
    df = spark.createDataFrame([(1, "a@b.co", "a", 5), (2, None, "b", 255), (3, "nope", "a", 1), (-1, None, "a", 1), (4, None, "c", 1), (5, None, None, 1), (6, None, "a", 256)], "id int, mail string, kind string, size int")
    full = schema.completed(df)
    assert full.columns == ["id", "mail", "kind", "size", "twice"] and full.first()["twice"] == 10
    assert sorted((r["id"], r["fault"]) for r in schema.rejected(full).collect()) == [(-1, "id"), (3, "mail"), (4, "kind"), (5, "kind"), (6, "size")]
    assert schema.checked(full.where("id IN (1, 2)")).count() == 2
    with pytest.raises(Exception, match="mail is not valid"):
        schema.checked(full.where("id = 3")).collect()


def test_drift(db):
    m = Model("book", "book", ("id",), {"id": "bigint", "author_id": "int", "title": "string"})
    assert m.drift(db.frame("book")) == ["missing title", "extra pages", "id: int instead of bigint"]


def test_request_refusals(db):
    r = RequestQuery({"least": ("pages__gte", int)}, ordering=("id",))
    assert [x["id"] for x in r.apply(db("book"), {"least": "6", "order": "-id"}).df.collect()] == [2]
    for bad in ({"most": 1}, {"order": "pages"}):
        with pytest.raises(QueryError):
            r.apply(db("book"), bad)


def test_extension(db):
    register_extension("doubled", lambda df, column: df.withColumn(column, S.col(column) * 2))
    assert sorted(r["pages"] for r in QuerySet(db, db.registry.models["book"]).doubled("pages").df.collect()) == [10, 12]


def test_json_filter_is_typed(spark):
    r = Registry()
    r.add(Model("t", "t", ("id",)))
    d = Database(spark, r, frames={"t": spark.createDataFrame([(1, '{"a": {"b": 3}}'), (2, '{"a": {"b": "3"}}'), (3, '{"a": null}'), (4, "broken"), (5, None)], "id int, doc string")})

    def ids(**f):
        return sorted(x["id"] for x in d("t").filter(doc__filter=f).values("id").df.collect())

    assert ids(a__b=3) == [1] and ids(a__b="3") == [2] and ids(a__b__gte=2) == [1]
    assert ids(a__isnull=True) == [3, 4, 5] and ids(a__b__in=[3, 4]) == [1]


def test_tenants(spark):
    r = Registry()
    r.add(Model("t", "t", ("id",), tenant="owner"))
    d = Database(spark, r, frames={"t": spark.createDataFrame([(1, "x"), (2, "y")], "id int, owner string")})
    assert [x["id"] for x in d.scoped("x")("t").df.collect()] == [1]
    assert d("t").df.count() == 0 and d("t").all_tenants().df.count() == 2


def test_sqlite_tables_are_read_in_parts_and_written(spark, tmp_path):
    import sqlite3

    from quern.sources.sqlite import read_sqlite, write_sqlite

    path = str(tmp_path / "shop.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "the items" (id INTEGER, name VARCHAR(20), price REAL, sold BOOLEAN, raw BLOB)')
        db.execute("CREATE TABLE none (id INTEGER)")
        db.executemany('INSERT INTO "the items" VALUES (?, ?, ?, ?, ?)', [(i, f"n{i}", i / 2, i % 2, bytes([i])) for i in range(100)] + [(None,) * 5])
    df = read_sqlite(spark, path, "the items", parts=4)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("price", "double"), ("sold", "boolean"), ("raw", "binary")]
    assert df.rdd.getNumPartitions() == 4 and df.count() == 101 and df.where("sold").count() == 50 and df.where("id IS NULL").count() == 1
    assert read_sqlite(spark, path, "none").count() == 0
    write_sqlite(df.where("id < 10").withColumn("id", df.id + 1000), path, "the items")
    assert read_sqlite(spark, path, "the items").where("id >= 1000").count() == 10


def test_save_inserts_or_sets(spark, tmp_path):
    from quern.operators.dml import Table
    from quern.sources.models import Database, Model, Registry

    r = Registry()
    r.add(Model("Thing", "thing", ("id",)))
    spark.createDataFrame([(1, "a")], "id int, name string").write.parquet(f"file://{tmp_path}/thing.parquet")
    table = Table(Database(spark, r, f"file://{tmp_path}"), "Thing")
    table.save({"id": 1, "name": "b"})
    table.save({"id": 2, "name": "c"})
    assert sorted(map(tuple, table.read().collect())) == [(1, "b"), (2, "c")]
