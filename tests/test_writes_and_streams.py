"""Copy-on-write writes, stored tables, change capture and the outbox."""

import pytest
from pyspark.sql import functions as S

from quern.operators import writes
from quern.operators.expressions import QueryError
from quern.sources import tables
from quern.sources.models import Database, Model, Registry
from quern.streaming import capture


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def t(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, None, 30)], "id int, s string, v int")


def test_update_and_delete_treat_unknown_as_false(t):
    assert rows(writes.updated(t, S.col("v") > 5, s=S.lit("z"))) == [(1, "z", 10), (2, "b", None), (3, "z", 30)]
    assert rows(writes.deleted(t, S.col("v") > 5)) == [(2, "b", None)]


def test_upsert(spark, t):
    new = spark.createDataFrame([(2, "B", 20), (4, "d", 40)], "id int, s string, v int")
    assert rows(writes.upserted(t, new, ["id"])) == [(1, "a", 10), (2, "b", None), (3, None, 30), (4, "d", 40)]
    assert rows(writes.upserted(t, new, ["id"], ["v"])) == [(1, "a", 10), (2, "b", 20), (3, None, 30), (4, "d", 40)]


def test_merge_branches_in_order(spark, t):
    src = spark.createDataFrame([(1, 100), (2, 200), (9, 900)], "id int, v int")
    m = writes.Merge(t, src, {"id": "id"}).when_matched("do_nothing", "id = 1").when_matched("update", v=S.col("src.v"))
    m = m.when_not_matched(id=S.col("src.id"), v=S.col("src.v")).when_not_matched_by_source("delete")
    assert rows(m.checked().result()) == [(1, "a", 10), (2, "b", 200), (9, None, 900)]
    assert rows(m.returning().select("id", "action")) == [(2, "update"), (3, "delete"), (9, "insert")]
    with pytest.raises(QueryError):
        writes.Merge(t, src.union(src), {"id": "id"}).checked()


def test_cascade(spark):
    r = Registry()
    for name in ("a", "b", "c"):
        r.add(Model(name, name, ("id",)))
    r.foreign_key("b", "a", "a", "a_id", "bs")
    r.foreign_key("c", "b", "b", "b_id", "cs")
    frames = {
        "a": spark.createDataFrame([(1,), (2,)], "id int"),
        "b": spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "id int, a_id int"),
        "c": spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, b_id int"),
    }
    db = Database(spark, r, frames=frames)
    one = frames["a"].where("id = 1")
    d = writes.Deletion(db).collect("a", one)
    assert d.preview() == {"a": 1, "b": 2, "c": 1}
    assert rows(d.remaining("c")) == [(2, 2), (3, None)]
    d = writes.Deletion(db, {"cs": "set_null"}).collect("a", one)
    assert rows(d.remaining("c")) == [(1, None), (2, 2), (3, None)]
    with pytest.raises(QueryError):
        writes.Deletion(db, {"cs": "protect"}).collect("a", one)


def test_links(spark):
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "o int, m int")
    assert rows(writes.link_changes(links, "o", "m", 1, [11, 12], "add")) == [(1, 10), (1, 11), (1, 12), (2, 10)]
    assert rows(writes.link_changes(links, "o", "m", 1, [11], "remove")) == [(1, 10), (2, 10)]
    assert rows(writes.link_changes(links, "o", "m", 1, [11, 12], "set")) == [(1, 11), (1, 12), (2, 10)]
    assert rows(writes.link_changes(links, "o", "m", 1, [], "clear")) == [(2, 10)]


def test_replace_table_reads_itself(spark, t, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.write_table(t, path, partition_by=("id",), bloom=("s",))
    tables.replace_table(writes.deleted(spark.read.parquet(path), S.col("id") == 1), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 3]


def test_encrypted(spark, t):
    e = tables.Encrypted(b"0123456789abcdef")
    got = t.select("s", e.decrypt(e.encrypt(S.col("s"))).alias("back"), e.blind_index(S.col("s")).alias("h"))
    assert all(r["s"] == r["back"] for r in got.collect())
    assert got.select("h").distinct().count() == 3


def test_dictionary_beyond_its_bound_still_joins(spark, t):
    side = spark.createDataFrame([("a", 1)], "k string, x int")
    for most in (0, 1 << 20):
        assert rows(tables.Dictionary(side, "k", most).get(t, "s", x="x").select("id", "x")) == [(1, 1), (2, None), (3, None)]


def test_changes_and_outbox(spark, t, tmp_path):
    after = writes.deleted(writes.updated(t, S.col("id") == 2, v=S.lit(5)), S.col("id") == 1)
    changed = capture.changes(t, after, ["id"])
    assert rows(changed.select("id", "op")) == [(1, "delete"), (2, "update")]
    box = f"file://{tmp_path}/box"
    entries = capture.outbox_rows(changed, "t", ["id"])
    capture.enqueue(entries, box)
    capture.enqueue(entries, box)  # the same changes once more
    got = []
    schema = spark.read.parquet(box).schema
    q = capture.relay(spark, box, schema, lambda batch, _: got.extend(r["key"] for r in batch.collect()), f"file://{tmp_path}/ck")
    q.awaitTermination(120)
    assert sorted(got) == ['{"id":1}', '{"id":2}']


def test_maintained_aggregate(spark, t, tmp_path):
    path = f"file://{tmp_path}/in"
    t.write.parquet(path)
    stream = spark.readStream.schema(t.schema).parquet(path)
    q = capture.maintained(stream, [], [S.sum("v").alias("total")], "total_now")
    q.awaitTermination(120)
    assert spark.table("total_now").first()["total"] == 40
    stored = f"file://{tmp_path}/stored"
    for _ in range(2):  # what arrives later is added to what is stored
        capture.maintained(stream, [], [S.sum("v").alias("total")], "total_stored", f"file://{tmp_path}/at", path=stored).awaitTermination(120)
        t.write.mode("append").parquet(path)
    assert spark.read.parquet(stored).first()["total"] == 80
    with pytest.raises(ValueError):
        capture.maintained(stream, [], [S.sum("v")], "x", mode="update", path=stored)


def test_soft_delete_reaches_joined_models(spark):
    r = Registry()
    r.add(Model("author", "author", ("id",), soft_delete="gone"))
    r.add(Model("book", "book", ("id",)))
    r.foreign_key("book", "author", "author", "author_id", "books")
    db = Database(spark, r, frames={
        "author": spark.createDataFrame([(1, "x", None), (2, "y", "2020")], "id int, name string, gone string"),
        "book": spark.createDataFrame([(1, 1), (2, 2)], "id int, author_id int"),
    })
    assert rows(db("book").values("id", "author__name").df) == [(1, "x"), (2, None)]
    assert rows(db("book").include_deleted().values("id", "author__name").df) == [(1, "x"), (2, "y")]
