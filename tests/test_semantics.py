"""Semantics that differ from plain SQL: nulls, negation, slices, frames, as-of, arrays, refusals."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as S

from quern.functions import aggregates as A
from quern.functions import text as T
from quern.functions import window as WF
from quern.operators.expressions import (
    Cube, Exists, F, Grouping, OuterReference, Q, QueryError, Rollup, RowRange, UnsupportedError, Value, ValueRange, Window,
)
from quern.operators import joins
from quern.operators.joins import ArrayJoin, AsofJoin
from quern.operators.recursion import closure
from quern.plans.queryset import FanOutError
from quern.sources.models import Database, Model, Registry


def base(spark, **tables):
    r = Registry()
    frames = {}
    for name, (key, ddl, rows) in tables.items():
        r.add(Model(name, name, key))
        frames[name] = spark.createDataFrame(rows, ddl)
    return Database(spark, r, frames=frames)


def ids(qs, column="id"):
    return sorted(r[0] for r in qs.values(column).df.collect())


@pytest.fixture
def db(spark):
    return base(spark, t=(("id",), "id int, a int, s string, w array<string>", [(1, 1, "x", ["p"]), (2, None, "y", []), (3, 3, None, ["p", "q"]), (4, 1, "Xy", None)]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.one_of(st.none(), st.integers(0, 3)), min_size=0, max_size=8), listed=st.lists(st.one_of(st.none(), st.integers(0, 3)), max_size=3), v=st.integers(0, 3))
def test_negation_is_two_valued(spark, rows, listed, v):
    d = base(spark, t=(("id",), "id int, a int", list(enumerate(rows))))("t")
    assert ids(d.filter(a__not=v)) == [i for i, a in enumerate(rows) if a != v]
    assert ids(d.filter(a__in=listed)) == [i for i, a in enumerate(rows) if a in listed]
    assert ids(d.filter(a__not_in=listed)) == [i for i, a in enumerate(rows) if a not in listed]
    assert ids(d.exclude(a__gt=v)) == [i for i, a in enumerate(rows) if not (a is not None and a > v)]
    assert ids(d.filter(~Q(a=v) | Q(a__isnull=True))) == [i for i, a in enumerate(rows) if a != v]


def test_subquery_membership_matches_null(db):
    inner = db("t").values("a")
    assert ids(db("t").filter(a__in=inner)) == [1, 2, 3, 4]
    assert ids(db("t").filter(a__not_in=db("t").filter(a=1).values("a"))) == [2, 3]


def test_long_lists(db):
    assert ids(db("t").filter(a__in=list(range(3, 2000)))) == [3]
    assert ids(db("t").filter(s__in=[f"v{i}" for i in range(1000)] + ["x"])) == [1]
    assert ids(db("t").exclude(a__in=list(range(3, 2000)))) == [1, 2, 4]
    assert ids(db("t").filter(a__in=[None, *range(3, 2000)])) == [2, 3]


def test_ranges_with_open_bounds(db):
    assert ids(db("t").filter(a__range=(2, None))) == [3]
    assert ids(db("t").filter(a__range=(None, 1))) == [1, 4]
    assert ids(db("t").filter(a__range=(None, None))) == [1, 3, 4]


def test_slices(db):
    assert db("t").order_by("id").limit(0).df.count() == 0
    assert [r["id"] for r in db("t").order_by("id")[1:3].df.collect()] == [2, 3]
    assert db("t").order_by("id").first()["id"] == 1 and db("t").order_by("id").last()["id"] == 4
    assert db("t").none().count() == 0 and not db("t").none().exists()
    assert db("t").get(id=3)["a"] == 3
    with pytest.raises(QueryError):
        db("t").get(a=1)
    with pytest.raises(UnsupportedError):
        db("t").select_for_update()


def test_null_order(db):
    assert [r["id"] for r in db("t").order_by("a", "id").df.collect()] == [1, 4, 3, 2]
    assert [r["id"] for r in db("t").order_by("-a", "id").df.collect()] == [2, 3, 1, 4]
    assert [r["id"] for r in db("t").order_by("-a", "id").reverse().df.collect()] == [4, 1, 3, 2]


def test_keyset_pages_cover_every_row(db):
    q = db("t").order_by("a", "id")
    seen, page = [], q[:1].df.collect()
    while page:
        seen.append(page[0]["id"])
        page = q.after_cursor(*q.cursor_values(page[0]))[:1].df.collect()
    assert seen == [1, 4, 3, 2]


@pytest.mark.parametrize("frame, expected", [
    (RowRange(1, 2), [50, 70, 90, 50, None]), (RowRange(), [150] * 5), (RowRange(-1, 0), [10, 30, 50, 70, 90]), (RowRange(None, 0), [10, 30, 60, 100, 150]),
])
def test_row_frames(spark, frame, expected):
    d = base(spark, t=(("id",), "id int, v int", [(i, 10 * i) for i in range(1, 6)]))
    rows = d("t").annotate(s=Window(A.Sum("v"), order_by=["id"], frame=frame)).order_by("id").df.collect()
    assert [r["s"] for r in rows] == expected


@pytest.mark.parametrize("frame, expected", [(ValueRange(None, 0), [10, 50, 50, 90]), (ValueRange(-10, 10), [50, 50, 50, 40])])
def test_value_frames(spark, frame, expected):
    d = base(spark, t=(("id",), "id int, v int", [(1, 10), (2, 20), (3, 20), (4, 40)]))
    rows = d("t").annotate(s=Window(A.Sum("v"), order_by=["v"], frame=frame)).order_by("id").df.collect()
    assert [r["s"] for r in rows] == expected


def test_grouping_bits(spark):
    d = base(spark, t=(("id",), "id int, a string, b string", [(1, "x", None), (2, "x", "q"), (3, "y", "q")]))
    rows = d("t").values("a", "b").annotate(n=A.Count(), g=Grouping("a", "b")).group_by(Rollup("a", "b")).df.collect()
    assert sorted((r["a"] or "", r["b"] or "", r["n"], r["g"]) for r in rows) == [("", "", 3, 3), ("x", "", 1, 0), ("x", "", 2, 1), ("x", "q", 1, 0), ("y", "", 1, 1), ("y", "q", 1, 0)]
    assert len(d("t").filter(a="x").values("a", "b").annotate(n=A.Count()).group_by(Cube("a", "b")).df.collect()) == 6
    with pytest.raises(QueryError):
        Rollup()


def test_asof(spark):
    d = base(
        spark,
        trade=(("id",), "id int, symbol string, at int", [(1, "A", 15), (2, "A", 25), (3, "A", 20), (4, "B", 20), (5, "A", None)]),
        quote=(("id",), "id int, symbol string, at int, price int", [(1, "A", 10, 100), (2, "A", 20, 200), (3, "A", 30, 300)]),
    )

    def prices(op):
        q = d("trade").annotate(q=AsofJoin(d("quote"), {"symbol": "symbol"}, ("at", op, "at"))).values("id", "q__price")
        return [r[1] for r in q.order_by("id").df.collect()]

    assert prices(">=") == [100, 200, 200, None, None]
    assert prices(">") == [100, 200, 100, None, None]
    assert prices("<=") == [200, 300, 200, None, None]
    assert prices("<") == [200, 300, 300, None, None]
    with pytest.raises(QueryError):
        prices("=")


@pytest.mark.parametrize("op", [">=", ">", "<=", "<"])
def test_asof_in_slices_is_the_same(spark, op):
    import random

    rng = random.Random(op)
    left = spark.createDataFrame([(i, rng.choice("aab"), rng.randint(0, 60)) for i in range(150)], "id int, k string, t int")
    right = spark.createDataFrame([(i, rng.choice("aac"), rng.randint(0, 60)) for i in range(40)], "q int, k string, t int")
    whole = joins.asof_join(left, right, [("k", "k")], ("t", "t"), op)
    cut = joins.asof_join(left, right, [("k", "k")], ("t", "t"), op, slices=lambda t: S.floor(t / 10))
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, cut.collect()), key=repr)


def test_array_join(db):
    rows = db("t").annotate(x=ArrayJoin("w")).values("id", "x").df.collect()
    assert sorted(tuple(r) for r in rows) == [(1, "p"), (3, "p"), (3, "q")]
    rows = db("t").annotate(x=ArrayJoin("w", left=True)).values("id", "x").df.collect()
    assert sorted(tuple(r) for r in rows) == [(1, "p"), (2, ""), (3, "p"), (3, "q"), (4, "")]
    assert db("t").annotate(x=ArrayJoin("w")).values("id").df.count() == 3


def star(spark):
    d = base(
        spark,
        product=(("id",), "id int, name string", [(1, "a"), (2, "b"), (3, "c")]),
        review=(("rid",), "rid int, product int, stars int", [(1, 1, 5), (2, 1, 3), (3, 2, 4)]),
        sale=(("sid",), "sid int, product int, total int", [(1, 1, 10), (2, 1, 20), (3, 1, 30), (4, 3, 7)]),
    )
    d.registry.foreign_key("review", "of", "product", "product", "reviews")
    d.registry.foreign_key("sale", "of", "product", "product", "sales")
    return d


def test_branches_do_not_multiply(spark):
    d = star(spark)
    rows = d("product").annotate(n=A.Count("reviews__rid"), total=A.Sum("sales__total"), best=A.Max("reviews__stars")).values("id", "n", "total", "best").order_by("id").df.collect()
    assert [tuple(r) for r in rows] == [(1, 2, 60, 5), (2, 1, None, 4), (3, 0, 7, None)]
    with pytest.raises(FanOutError):
        d("product").values("name").annotate(n=A.Count("reviews__rid"), total=A.Sum("sales__total")).df
    with pytest.raises(FanOutError):
        d("product").aggregate(n=A.Count("reviews__rid"), total=A.Sum("sales__total"))


def test_aggregate_over_row_and_branch(spark):
    d = star(spark)
    rows = d("product").annotate(x=A.Sum(F("sales__total") * F("id"))).values("id", "x").order_by("id").df.collect()
    assert [tuple(r) for r in rows] == [(1, 60), (2, None), (3, 21)]


def test_null_rejecting_filters_join_inner(spark):
    d = star(spark)

    def kinds(q):
        return "LeftOuter" in q.df._jdf.queryExecution().analyzed().toString()

    assert not kinds(d("sale").filter(of__name="a").values("sid"))
    assert kinds(d("sale").filter(of__name__not="a").values("sid")) and kinds(d("sale").filter(of__name__isnull=True).values("sid"))
    assert kinds(d("sale").filter(Q(of__name="a") | Q(total=7)).values("sid"))
    assert ids(d("sale").filter(of__name="a"), "sid") == [1, 2, 3]


def test_to_many_conditions(spark):
    d = star(spark)
    assert ids(d("product").filter(reviews__stars=5, reviews__rid=1)) == [1]
    assert ids(d("product").filter(reviews__stars=5, reviews__rid=2)) == []
    assert ids(d("product").filter(reviews__stars=5).filter(reviews__rid=2)) == [1]
    assert ids(d("product").exclude(reviews__stars=5)) == [2, 3]
    assert ids(d("product").filter(reviews__isnull=True)) == [3]


def test_correlated_subqueries(spark):
    d = star(spark)
    big = d("sale").filter(product=OuterReference("id"), total__gt=15)
    assert ids(d("product").filter(Exists(big))) == [1]
    assert ids(d("product").filter(~Exists(big))) == [2, 3]
    assert ids(d("product").filter(Q(Exists(big)) | Q(id=2))) == [1, 2]
    later = d("review").filter(product__gt=OuterReference("id"))
    assert ids(d("product").filter(Exists(later))) == [1]


def test_recursion_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, None)], "id int, parent int")
    assert sorted(r["id"] for r in closure(edges, edges.where("id = 4"), ["id"], ["parent"], ["id"]).collect()) == [1, 2, 3, 4]
    assert sorted(r["id"] for r in closure(edges, edges.where("id = 5"), ["id"], ["parent"], ["id"]).collect()) == [5]


def test_text_edges(spark):
    d = base(spark, t=(("id",), "id int, s string", [(1, "hello"), (2, None), (3, "")]))
    row = d("t").filter(id=1).values(a=T.Left("s", -1), b=T.Left("s", -9), c=T.Right("s", -1), d=T.Substr("s", 0, 2), e=T.Substr("s", 9), f=T.Concat("s", Value(None, "string"), Value("!")), g=T.Chr(Value(8364)), h=T.Left("s", 99)).df.first()
    assert tuple(row) == ("hell", "", "ello", "h", "", "hello!", "€", "hello")


def test_window_refusals():
    with pytest.raises(QueryError):
        Window(F("a"))
    with pytest.raises(QueryError):
        WF.NTile(0).over(None)
    with pytest.raises(QueryError):
        RowRange(2, 1)


def test_unknown_path(db):
    with pytest.raises(QueryError):
        db("t").filter(nothing=1).df
    with pytest.raises(QueryError):
        db("t").filter(a__nothing=1).df


def test_empty_tables(spark):
    d = base(spark, t=(("id",), "id int, a int", []))("t")
    assert d.aggregate(s=A.Sum("a"), n=A.Count("a")).first().asDict() == {"s": None, "n": 0}
    assert d.values("a").annotate(n=A.Count()).df.count() == 0
    assert d.annotate(r=Window(WF.RowNumber(), order_by=["id"])).df.count() == 0


def test_aggregate_over_slice(db):
    assert db("t").order_by("id")[:2].aggregate(n=A.Count(), s=A.Sum("id")).first().asDict() == {"n": 2, "s": 3}


def test_array_agg_keeps_nulls(db):
    got = db("t").aggregate(xs=A.ArrayAgg("a", order_by=["id"])).first()["xs"]
    assert got == [1, None, 3, 1]


def test_registered_lookup(db):
    from quern.operators import lookups

    lookups.register_lookup("even", lambda c, v: (c % 2 == 0) == S.lit(v))
    assert ids(db("t").filter(id__even=True)) == [2, 4]
