"""Registered queries over the test tables, each beside the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as S

from quern.functions import aggregates as A
from quern.functions import comparison as C
from quern.functions import containers as K
from quern.functions import datetime as D
from quern.functions import geo as G
from quern.functions import json as J
from quern.functions import math as M
from quern.functions import network, ranges, search
from quern.functions import text as T
from quern.functions import vectors as V
from quern.functions import window as WF
from quern.operators.expressions import (
    ArraySubquery, Case, Cube, Exists, F, Grouping, GroupingSets, OuterReference, Q, RawSQL, Rollup, RowRange, Subquery, Value, ValueRange, When, Window,
)
from quern.operators.joins import ArrayJoin, AsofJoin, FilteredRelation, JsonTable, Lateral
from quern.operators.recursion import closure
from quern.plans.queryset import Prefetch, QuerySet
from quern.sources.models import Database, Model
from quern.sources.warehouse import database

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Callable[[Database], Any]], Callable[[Database], Any]]:
    """Register a function from database to queryset or DataFrame under its name."""

    def register(fn: Callable[[Database], Any]) -> Callable[[Database], Any]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(database(spark, sf_dir))
            return out.df if isinstance(out, QuerySet) else out

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["revenue_by_nation"](spark, sf_dir)


def money(e: Any) -> Any:
    """Rounded, as sums of doubles differ in their last bits."""
    return M.Round(e, 2)


# -- benchmark shapes ------------------------------------------------------------


@query("""SELECT n_name AS order__customer__nation__n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND year(l_shipdate) = 1997 GROUP BY n_name""")
def revenue_by_nation(db: Database) -> Any:
    return (
        db("Lineitem").filter(order__customer__nation__region__r_name="ASIA", l_shipdate__year=1997)
        .values("order__customer__nation__n_name")
        .annotate(revenue=money(A.Sum(F("l_extendedprice") * (1 - F("l_discount")))))
        .order_by("-revenue")
    )


@query("SELECT count(*) AS n FROM events WHERE event_type = 'click' AND value > 50")
def count_filter(db: Database) -> Any:
    return db("Event").filter(event_type="click", value__gt=50).aggregate(n=A.Count())


@query("SELECT event_type, round(sum(value), 2) AS total, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def group_sum(db: Database) -> Any:
    return db("Event").values("event_type").annotate(total=money(A.Sum("value")), mean=M.Round(A.Avg("value"), 6))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 10")
def top_n(db: Database) -> Any:
    return db("Order").values("o_custkey").annotate(total=money(A.Sum("o_totalprice"))).order_by("-total", "o_custkey")[:10]


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY 1")
def by_day(db: Database) -> Any:
    return db("Event").annotate(day=D.Trunc("ts", "day")).values("day").annotate(n=A.Count())


@query("SELECT count(DISTINCT user_id) AS users FROM events")
def distinct_count(db: Database) -> Any:
    return db("Event").aggregate(users=A.Count("user_id", distinct=True))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def page_values(db: Database) -> Any:
    return db("Order").values("o_orderkey", "o_totalprice").order_by("o_orderkey")[40:60]


@query("SELECT round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, max(l_extendedprice) AS hi, min(l_extendedprice) AS lo, count(*) AS n FROM lineitem")
def aggregate_all(db: Database) -> Any:
    return db("Lineitem").aggregate(s=money(A.Sum("l_quantity")), a=M.Round(A.Avg("l_quantity"), 6), hi=A.Max("l_extendedprice"), lo=A.Min("l_extendedprice"), n=A.Count())


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 100")
def having(db: Database) -> Any:
    return db("Order").values("o_orderpriority").annotate(n=A.Count("o_orderkey")).filter(n__gt=100)


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def annotate_count(db: Database) -> Any:
    return db("Customer").annotate(n=A.Count("orders__o_orderkey")).only("c_custkey").values("c_custkey", "n")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS big FROM customer")
def exists_annotation(db: Database) -> Any:
    big = db("Order").filter(o_custkey=OuterReference("c_custkey"), o_totalprice__gt=400000)
    return db("Customer").annotate(big=Exists(big)).values("c_custkey", "big")


@query("""SELECT CASE WHEN l_extendedprice < 10000 THEN 'low' WHEN l_extendedprice < 50000 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM lineitem GROUP BY 1""")
def case_when(db: Database) -> Any:
    band = Case(When(l_extendedprice__lt=10000, then="low"), When(l_extendedprice__lt=50000, then="mid"), default="high")
    return db("Lineitem").annotate(band=band).values("band").annotate(n=A.Count())


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC)::INTEGER AS rk FROM part")
def window_rank(db: Database) -> Any:
    return db("Part").annotate(rk=Window(WF.Rank(), partition_by=["p_brand"], order_by=["-p_retailprice"])).values("p_partkey", "rk")


@query("""SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_size > 45 OR l_quantity >= 49""")
def complex_filter(db: Database) -> Any:
    return db("Lineitem").filter(Q(part__p_size__gt=45) | Q(l_quantity__gte=49)).values("l_orderkey").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_ten(db: Database) -> Any:
    return db("Order").order_by("-o_totalprice", "o_orderkey").values("o_orderkey", "o_totalprice")[:10]


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%' || lower('RED') || '%'")
def filter_icontains(db: Database) -> Any:
    return db("Part").filter(p_name__icontains="RED").values("p_partkey")


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey IN (SELECT range * 3 FROM range(2000))")
def large_in(db: Database) -> Any:
    return db("Order").filter(o_orderkey__in=[3 * i for i in range(2000)]).aggregate(n=A.Count())


# -- filters ---------------------------------------------------------------------


def _nullable(db: Database) -> QuerySet:
    return db("Order").annotate(st=C.NullIf("o_orderstatus", Value("P")))


_NULLABLE = "(SELECT *, nullif(o_orderstatus, 'P') AS st FROM orders)"


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def filter_range(db: Database) -> Any:
    return db("Order").filter(o_totalprice__range=(1000, 50000)).values("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 300000")
def filter_range_open(db: Database) -> Any:
    return db("Order").filter(o_totalprice__range=(300000, None)).values("o_orderkey")


@query(f"SELECT o_orderkey, st FROM {_NULLABLE} WHERE st IS DISTINCT FROM 'F'")
def filter_not_null_safe(db: Database) -> Any:
    return _nullable(db).filter(st__not="F").values("o_orderkey", "st")


@query(f"SELECT o_orderkey FROM {_NULLABLE} WHERE st = 'F' OR st IS NULL")
def filter_in_with_null(db: Database) -> Any:
    return _nullable(db).filter(st__in=["F", None]).values("o_orderkey")


@query(f"SELECT o_orderkey FROM {_NULLABLE} WHERE st <> 'F' OR st IS NULL")
def filter_not_in(db: Database) -> Any:
    return _nullable(db).filter(st__not_in=["F"]).values("o_orderkey")


@query(f"SELECT o_orderkey FROM {_NULLABLE} WHERE st NOT IN ('F')")
def filter_not_in_with_null(db: Database) -> Any:
    return _nullable(db).filter(st__not_in=["F", None]).values("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE false")
def filter_empty_in(db: Database) -> Any:
    return db("Order").filter(o_orderkey__in=[]).values("o_orderkey")


@query(f"SELECT o_orderkey FROM {_NULLABLE} WHERE NOT coalesce(st = 'F' AND o_totalprice > 1000, false)")
def exclude_keeps_null(db: Database) -> Any:
    return _nullable(db).exclude(st="F", o_totalprice__gt=1000).values("o_orderkey")


@query(f"SELECT o_orderkey FROM {_NULLABLE} WHERE st IS NULL")
def filter_isnull(db: Database) -> Any:
    return _nullable(db).filter(st__isnull=True).values("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000 AND o_orderstatus = 'F')")
def exclude_to_many(db: Database) -> Any:
    return db("Customer").exclude(orders__o_totalprice__gt=200000, orders__o_orderstatus="F").values("c_custkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-z]+ b[a-z]+$')")
def filter_regex(db: Database) -> Any:
    return db("Part").filter(p_name__posix_regex="^[[:lower:]]+ b[[:lower:]]+$").values("p_partkey")


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building' AND starts_with(c_name, 'Customer') AND suffix(c_name, '7')")
def filter_text(db: Database) -> Any:
    return db("Customer").filter(c_mktsegment__iexact="Building", c_name__startswith="Customer", c_name__endswith="7").values("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def filter_in_subquery(db: Database) -> Any:
    rich = db("Customer").filter(c_acctbal__gt=5000).values("c_custkey")
    return db("Order").filter(o_custkey__in=rich).values("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def filter_not_in_subquery(db: Database) -> Any:
    rich = db("Customer").filter(c_acctbal__gt=5000).values("c_custkey")
    return db("Order").filter(o_custkey__not_in=rich).values("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def filter_or_subquery(db: Database) -> Any:
    rich = db("Customer").filter(c_acctbal__gt=9000).values("c_custkey")
    return db("Order").filter(Q(o_totalprice__gt=400000) | Q(o_custkey__in=rich)).values("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 1997 AND month(o_orderdate) IN (1, 2) AND dayofweek(o_orderdate) + 1 = 2")
def date_part_lookup(db: Database) -> Any:
    return db("Order").filter(o_orderdate__year__gte=1997, o_orderdate__month__in=[1, 2], o_orderdate__week_day=2).values("o_orderkey")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def json_path_lookup(db: Database) -> Any:
    return db("Event").annotate(k=J.JsonPath("props", "$.k", "bigint")).filter(k__gte=50).values("event_id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def json_key_path(db: Database) -> Any:
    return db("Event").filter(props__k="7").values("event_id")


@query("SELECT event_id FROM events WHERE json_exists(props, '$.k')")
def json_has_key(db: Database) -> Any:
    return db("Event").filter(props__has_key="k").values("event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey = 1 AND l_linenumber = 1) OR (l_orderkey = 5 AND l_linenumber = 2)")
def composite_key_in(db: Database) -> Any:
    return db("Lineitem").filter(pk__in=[(1, 1), (5, 2)]).values("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 * o_custkey")
def filter_expression(db: Database) -> Any:
    return db("Order").filter(o_totalprice__gt=F("o_custkey") * 1000).values("o_orderkey")


@query("SELECT p_partkey, list_has_all(string_split(p_name, ' '), ['bolt']) AS sup, len(string_split(p_name, ' ')) AS n FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'bolt', 'none'])")
def array_lookups(db: Database) -> Any:
    words = K.Split("p_name", " ")
    return db("Part").alias(w=words).filter(w__overlap=["red", "bolt", "none"]).annotate(sup=K.ArrayContains("w", K.Array(Value("bolt"))), n=K.ArrayLength("w")).values("p_partkey", "sup", "n")


# -- joins -----------------------------------------------------------------------


@query("SELECT o_orderkey, n_name AS customer__nation__n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000")
def join_fk_path(db: Database) -> Any:
    return db("Order").filter(o_totalprice__gt=300000).values("o_orderkey", "customer__nation__n_name")


@query("SELECT n_nationkey, r_regionkey AS rk, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey")
def select_related(db: Database) -> Any:
    return db("Nation").select_related("region").df.select("n_nationkey", S.col("region.r_regionkey").alias("rk"), S.col("region.r_name").alias("rn"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY c_custkey")
def filtered_relation(db: Database) -> Any:
    return db("Customer").annotate(big=FilteredRelation("orders", Q(o_totalprice__gt=200000))).values("c_custkey").annotate(n=A.Count("big__o_orderkey"))


@query("""SELECT event_id, o_orderkey AS last__o_orderkey FROM events ASOF LEFT JOIN
(SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON user_id = o.o_custkey AND ts >= o.o_orderdate""")
def asof_join(db: Database) -> Any:
    orders = db("Order").values("o_custkey", "o_orderdate").annotate(o_orderkey=A.Max("o_orderkey"))
    return db("Event").annotate(last=AsofJoin(orders, {"user_id": "o_custkey"}, ("ts", ">=", "o_orderdate"))).values("event_id", "last__o_orderkey")


@query("""SELECT event_id, o_orderkey AS last__o_orderkey FROM events ASOF LEFT JOIN
(SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON user_id = o.o_custkey AND ts > o.o_orderdate""")
def asof_join_in_slices(db: Database) -> Any:
    """The windows are cut by year too, as a hot key would need."""
    orders = db("Order").values("o_custkey", "o_orderdate").annotate(o_orderkey=A.Max("o_orderkey"))
    join = AsofJoin(orders, {"user_id": "o_custkey"}, ("ts", ">", "o_orderdate"), S.year)
    return db("Event").annotate(last=join).values("event_id", "last__o_orderkey")


@query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def array_join(db: Database) -> Any:
    return db("Part").annotate(word=ArrayJoin(K.Split("p_type", " "))).values("p_partkey", "word")


@query("SELECT p_partkey, coalesce(w, '') AS word FROM part LEFT JOIN LATERAL unnest(list_filter(string_split(p_type, ' '), lambda x: x = 'SMALL')) u(w) ON true")
def array_join_left(db: Database) -> Any:
    steel = RawSQL("filter(split(p_type, ' '), x -> x = 'SMALL')")
    return db("Part").annotate(word=ArrayJoin(steel, left=True)).values("p_partkey", "word")


@query("""SELECT c_custkey, t.o_orderkey AS top__o_orderkey FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders
WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t ON true""")
def lateral_top2(db: Database) -> Any:
    top = db("Order").filter(o_custkey=OuterReference("c_custkey")).order_by("-o_totalprice", "o_orderkey").values("o_orderkey")[:2]
    return db("Customer").annotate(top=Lateral(top)).values("c_custkey", "top__o_orderkey")


@query("""SELECT event_id, 1::BIGINT AS item__n, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item__k FROM events""")
def json_table(db: Database) -> Any:
    array = RawSQL("concat('[', props, ']')")
    return db("Event").annotate(item=JsonTable(array, "k int", ordinality="n")).values("event_id", "item__n", "item__k")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(db: Database) -> Any:
    return db("Customer").filter(Exists(db("Order").filter(o_custkey=OuterReference("pk"), o_totalprice__gt=300000))).values("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti_join(db: Database) -> Any:
    return db("Customer").filter(~Exists(db("Order").filter(o_custkey=OuterReference("pk"), o_totalprice__gt=200000))).values("c_custkey")


@query("SELECT s_suppkey, count(DISTINCT l_partkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def many_to_many_count(db: Database) -> Any:
    return db("Supplier").values("s_suppkey").annotate(n=A.Count("parts__p_partkey", distinct=True))


@query("""SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers_n,
(SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers_n FROM nation""")
def two_branches(db: Database) -> Any:
    """Aggregates over two to-many relations, each folded before it is joined."""
    return db("Nation").annotate(customers_n=A.Count("customers__c_custkey"), suppliers_n=A.Count("suppliers__s_suppkey")).values("n_nationkey", "customers_n", "suppliers_n")


@query("SELECT c_custkey, count(*) AS n FROM customer JOIN orders a ON a.o_custkey = c_custkey AND a.o_totalprice > 300000 JOIN orders b ON b.o_custkey = c_custkey AND b.o_totalprice < 50000 GROUP BY 1")
def filter_generations(db: Database) -> Any:
    """Two filter() calls each read a related row of their own."""
    return db("Customer").filter(orders__o_totalprice__gt=300000).filter(orders__o_totalprice__lt=50000).values("c_custkey").annotate(n=A.Count())


# -- aggregates ------------------------------------------------------------------


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent FROM orders GROUP BY 1")
def agg_filter(db: Database) -> Any:
    return db("Order").values("o_orderstatus").annotate(big=A.Count("o_orderkey", filter=Q(o_totalprice__gt=100000)), urgent=money(A.Sum("o_totalprice", filter=Q(o_orderpriority="1-URGENT"))))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1")
def agg_distinct(db: Database) -> Any:
    return db("Lineitem").values("l_returnflag").annotate(suppliers=A.Count("l_suppkey", distinct=True), lines=A.Sum("l_linenumber", distinct=True))


@query("SELECT round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_tax), 8) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp FROM lineitem")
def stats(db: Database) -> Any:
    return db("Lineitem").aggregate(sp=M.Round(A.StdDev("l_quantity"), 6), ss=M.Round(A.StdDev("l_quantity", sample=True), 6), vp=M.Round(A.Variance("l_tax"), 8), c=M.Round(A.Corr("l_quantity", "l_extendedprice"), 6), cp=M.Round(A.CovarPop("l_quantity", "l_discount"), 6))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS b, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax FROM lineitem")
def regr(db: Database) -> Any:
    xy = ("l_extendedprice", "l_quantity")
    return db("Lineitem").aggregate(slope=M.Round(A.RegrSlope(*xy), 4), b=M.Round(A.RegrIntercept(*xy), 2), r2=M.Round(A.RegrR2(*xy), 6), n=A.RegrCount(*xy), ax=M.Round(A.RegrAvgX(*xy), 4))


@query("SELECT p_brand, bool_and(p_size > 1) AS every, bool_or(p_size > 49) AS some, bit_and(p_size) AS ba, bit_or(p_size) AS bo, bit_xor(p_size) AS bx FROM part GROUP BY 1")
def bit_bool(db: Database) -> Any:
    return db("Part").alias(one=Q(p_size__gt=1), big=Q(p_size__gt=49)).values("p_brand").annotate(every=A.BoolAnd("one"), some=A.BoolOr("big"), ba=A.BitAnd("p_size"), bo=A.BitOr("p_size"), bx=A.BitXor("p_size"))


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS best, arg_min(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS worst FROM orders GROUP BY 1")
def arg_extremes(db: Database) -> Any:
    by = K.Tuple(a="o_totalprice", b="o_orderkey")
    return db("Order").values("o_custkey").annotate(best=A.ArgMax("o_orderkey", by), worst=A.ArgMin("o_orderkey", by))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(median(l_extendedprice), 4) AS md FROM lineitem GROUP BY 1")
def quantile(db: Database) -> Any:
    return db("Lineitem").values("l_returnflag").annotate(q1=M.Round(A.Quantile("l_extendedprice", 0.25), 4), md=M.Round(A.Median("l_extendedprice"), 4))


@query("SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names, array_agg(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY 1")
def string_and_array_agg(db: Database) -> Any:
    return db("Nation").values("n_regionkey").annotate(names=A.StringAgg("n_name", "; "), keys=A.ArrayAgg("n_nationkey"))


@query("SELECT o_custkey, array_agg(nullif(o_orderstatus, 'P') ORDER BY o_orderkey) AS sts FROM orders GROUP BY 1")
def array_agg_nulls(db: Database) -> Any:
    return _nullable(db).values("o_custkey").annotate(sts=A.ArrayAgg("st", order_by=["o_orderkey"]))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(db: Database) -> Any:
    return db("Order").values("o_orderstatus", "o_orderpriority").annotate(n=A.Count()).group_by(Rollup("o_orderstatus", "o_orderpriority"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority)::BIGINT AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(db: Database) -> Any:
    return db("Order").values("o_orderstatus", "o_orderpriority").annotate(n=A.Count(), g=Grouping("o_orderstatus", "o_orderpriority")).group_by(Cube("o_orderstatus", "o_orderpriority"))


@query("SELECT year(o_orderdate) AS y, o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((y, o_orderstatus), (y, o_orderpriority), (y))")
def grouping_sets(db: Database) -> Any:
    return db("Order").annotate(y=D.ExtractYear("o_orderdate")).values("y", "o_orderstatus", "o_orderpriority").annotate(total=money(A.Sum("o_totalprice"))).group_by("y", GroupingSets("o_orderstatus", "o_orderpriority", ()))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())")
def with_totals(db: Database) -> Any:
    return db("Order").values("o_orderstatus").annotate(n=A.Count()).with_totals()


@query(None)
def approximate_distinct(db: Database) -> Any:
    return db("Event").values("event_type").annotate(users=A.Uniq("user_id"))


@query("SELECT event_type, map_from_entries(list_sort(list(struct_pack(k := k, v := v)))) AS m FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def sum_map(db: Database) -> Any:
    one = db("Event").annotate(k=J.JsonPath("props", "$.k", "bigint")).df.select("event_type", S.create_map("k", S.lit(1).cast("long")).alias("m"))
    return A.sum_map(one, ["event_type"], "m", "m")


@query("""SELECT user_id, count(*) AS n FROM (SELECT user_id, lo, max(hi) OVER w AS m FROM (SELECT user_id, epoch(ts)::BIGINT AS lo, epoch(ts)::BIGINT + 3600 AS hi, event_id FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY lo, hi, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE m IS NULL OR lo > m GROUP BY 1""")
def range_agg(db: Database) -> Any:
    lo = S.rint(S.unix_micros(S.col("ts").cast("timestamp")) / 1_000_000).cast("long")  # the nearest second, the even one of two, as SQL casts
    spans = db("Event").df.select("user_id", lo.alias("lo"), (lo + 3600).alias("hi"))
    return A.range_agg(spans, ["user_id"], "lo", "hi").groupBy("user_id").agg(S.count("*").alias("n"))


# -- windows ---------------------------------------------------------------------


@query("""SELECT o_orderkey, row_number() OVER w::INTEGER AS rn, lag(o_orderkey) OVER w AS prev, lead(o_orderkey, 2, -1) OVER w AS nxt, dense_rank() OVER w::INTEGER AS dr,
ntile(3) OVER w::INTEGER AS nt, round(cume_dist() OVER w, 9) AS cd, round(percent_rank() OVER w, 9) AS pr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def ranking_and_offsets(db: Database) -> Any:
    w = {"partition_by": ["o_custkey"], "order_by": ["o_orderdate", "o_orderkey"]}
    return db("Order").annotate(
        rn=Window(WF.RowNumber(), **w), prev=Window(WF.Lag("o_orderkey"), **w), nxt=Window(WF.Lead("o_orderkey", 2, -1), **w), dr=Window(WF.DenseRank(), **w),
        nt=Window(WF.NTile(3), **w), cd=M.Round(Window(WF.CumeDist(), **w), 9), pr=M.Round(Window(WF.PercentRank(), **w), 9),
    ).values("o_orderkey", "rn", "prev", "nxt", "dr", "nt", "cd", "pr")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS n FROM orders")
def rows_frame(db: Database) -> Any:
    w = {"partition_by": ["o_custkey"], "order_by": ["o_orderkey"]}
    return db("Order").annotate(s=money(Window(A.Sum("o_totalprice"), frame=RowRange(-2, 0), **w)), n=Window(A.Count(), frame=RowRange(1, 2), **w)).values("o_orderkey", "s", "n")


@query("SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING)::BIGINT AS s FROM part")
def range_frame(db: Database) -> Any:
    return db("Part").annotate(s=Window(A.Sum("p_size"), partition_by=["p_brand"], order_by=["p_size"], frame=ValueRange(-10, 10))).values("p_partkey", "s")


@query("SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def nth_last(db: Database) -> Any:
    w = {"partition_by": ["o_custkey"], "order_by": ["o_orderkey"]}
    return db("Order").annotate(f=Window(WF.FirstValue("o_orderkey"), **w), l=Window(WF.LastValue("o_orderkey"), **w), n=Window(WF.NthValue("o_orderkey", 2), **w)).values("o_orderkey", "f", "l", "n")


@query("SELECT event_id, count(*) FILTER (WHERE value > 50) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events")
def window_condition(db: Database) -> Any:
    return db("Event").annotate(n=Window(A.Count("event_id", filter=Q(value__gt=50)), partition_by=["user_id"], order_by=["event_id"])).values("event_id", "n")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def window_filter(db: Database) -> Any:
    rn = Window(WF.RowNumber(), partition_by=["o_custkey"], order_by=["-o_totalprice", "o_orderkey"])
    return db("Order").annotate(rn=rn).filter(rn__lte=2).values("o_orderkey")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn BETWEEN 2 AND 4")
def limit_by(db: Database) -> Any:
    return db("Event").order_by("-ts", "event_id").limit_by(3, "user_id", offset=1).values("event_id")


@query("SELECT o_orderkey, o_orderkey - lag(o_orderkey, 1, 0) OVER (ORDER BY o_orderkey) AS gap FROM orders WHERE o_custkey = 10")
def window_arithmetic(db: Database) -> Any:
    return db("Order").filter(o_custkey=10).annotate(gap=F("o_orderkey") - Window(WF.Lag("o_orderkey", 1, 0), order_by=["o_orderkey"])).values("o_orderkey", "gap")


# -- sorting, paging, sets -------------------------------------------------------


@query(f"SELECT o_orderkey, st, row_number() OVER (PARTITION BY o_custkey ORDER BY st DESC NULLS FIRST, o_orderkey)::INTEGER AS place FROM {_NULLABLE}")
def order_nulls(db: Database) -> Any:
    place = Window(WF.RowNumber(), partition_by=["o_custkey"], order_by=[F("st").desc(nulls_first=True), "o_orderkey"])
    return _nullable(db).values("o_orderkey", "st", place=place)


@query(f"SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, st FROM {_NULLABLE} ORDER BY o_custkey, st ASC NULLS LAST, o_orderkey DESC")
def order_reverse(db: Database) -> Any:
    return _nullable(db).order_by("-st", "o_orderkey").reverse().distinct("o_custkey").values("o_custkey", "o_orderkey", "st")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 300000 OR (o_totalprice = 300000 AND o_orderkey > 5) ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def keyset(db: Database) -> Any:
    return db("Order").order_by("-o_totalprice", "o_orderkey").after_cursor(300000, 5).values("o_orderkey", "o_totalprice")[:10]


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 ORDER BY o_totalprice, o_orderkey DESC LIMIT 10")
def keyset_before(db: Database) -> Any:
    return db("Order").order_by("-o_totalprice", "o_orderkey").before_cursor(300000, 0).values("o_orderkey", "o_totalprice")[:10]


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def distinct_on(db: Database) -> Any:
    return db("Order").order_by("-o_orderdate", "o_orderkey").distinct("o_custkey").values("o_custkey", "o_orderkey")


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(db: Database) -> Any:
    return db("Customer").values("c_nationkey", "c_mktsegment").distinct()


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(db: Database) -> Any:
    return db("Customer").values(k=F("c_nationkey")).union(db("Supplier").values("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(db: Database) -> Any:
    return db("Customer").values(k=F("c_nationkey")).union(db("Supplier").values("s_nationkey"), all=True)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersection(db: Database) -> Any:
    return db("Customer").values(k=F("c_nationkey")).intersection(db("Supplier").values("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def difference(db: Database) -> Any:
    return db("Nation").values(k=F("n_nationkey")).difference(db("Supplier").filter(s_acctbal__gt=5000).values("s_nationkey"))


@query("SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS o_orderdate FROM orders")
def dates(db: Database) -> Any:
    return db("Order").dates("o_orderdate", "month")


@query(None)
def table_sample(db: Database) -> Any:
    return db("Order").sample(10, seed=7).values("o_orderkey")


@query(None)
def hash_sample(db: Database) -> Any:
    return db("Order").sample_rows(0.1, 0.5).values("o_orderkey")


# -- subqueries, recursion -------------------------------------------------------


@query("SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) AS latest FROM customer")
def scalar_subquery(db: Database) -> Any:
    latest = db("Order").filter(o_custkey=OuterReference("c_custkey")).order_by("-o_orderdate", "o_orderkey").values("o_orderkey")
    return db("Customer").annotate(latest=Subquery(latest)).values("c_custkey", "latest")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AS n FROM customer")
def count_subquery(db: Database) -> Any:
    n = db("Order").filter(o_custkey=OuterReference("c_custkey"), o_totalprice__gt=100000).values().annotate(n=A.Count())
    return db("Customer").annotate(n=Subquery(n)).values("c_custkey", "n")


@query("SELECT n_nationkey, list_sort(coalesce((SELECT list(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), [])) AS sups FROM nation")
def array_subquery(db: Database) -> Any:
    sups = db("Supplier").filter(s_nationkey=OuterReference("n_nationkey")).values("s_suppkey")
    return db("Nation").annotate(sups=ArraySubquery(sups)).values("n_nationkey", "sups")


@query("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12) SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM big)")
def cte(db: Database) -> Any:
    big = db("Order").values("o_custkey").annotate(n=A.Count()).filter(n__gt=12).values("o_custkey")
    return db("Customer").with_cte("big", big).filter(c_custkey__in=big).values("c_custkey", "c_name")


@query("WITH RECURSIVE t(id) AS (SELECT c_custkey FROM customer WHERE c_custkey = 77 UNION SELECT c.c_custkey // 2 FROM customer c JOIN t ON c.c_custkey = t.id WHERE c.c_custkey > 0) SELECT id FROM t WHERE id IN (SELECT c_custkey FROM customer)")
def recursive_closure(db: Database) -> Any:
    tree = db("Customer").df.select(S.col("c_custkey").alias("id"), S.expr("c_custkey div 2").alias("parent"))
    return closure(tree, tree.where("id = 77"), ["id"], ["parent"], ["id"]).select("id")


# -- scalar functions ------------------------------------------------------------


@query("""SELECT p_partkey, lower(p_name) AS lo, upper(p_type) AS up, length(p_name) AS n, left(p_name, 3) AS l3, left(p_name, -2) AS lm, right(p_name, 2) AS r2, right(p_name, -2) AS rm,
substr(p_name, 2, 3) AS sub, strpos(p_name, 'a') AS pos, replace(p_name, 'a', 'o') AS rep, reverse(p_name) AS rev, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 4, '*') AS rp, repeat(p_brand, 2) AS rr,
md5(p_name) AS md, sha256(p_name) AS sh, ascii(p_name) AS o, concat(p_brand, NULL, '/', p_type) AS cc FROM part""")
def text_functions(db: Database) -> Any:
    return db("Part").values(
        "p_partkey", lo=T.Lower("p_name"), up=T.Upper("p_type"), n=T.Length("p_name"), l3=T.Left("p_name", 3), lm=T.Left("p_name", -2), r2=T.Right("p_name", 2), rm=T.Right("p_name", -2),
        sub=T.Substr("p_name", 2, 3), pos=T.StrIndex("p_name", "a"), rep=T.Replace("p_name", "a", "o"), rev=T.Reverse("p_name"), lp=T.LPad("p_brand", 12, "*"), rp=T.RPad("p_brand", 4, "*"), rr=T.Repeat("p_brand", 2),
        md=T.MD5("p_name"), sh=T.SHA256("p_name"), o=T.Ord("p_name"), cc=T.Concat("p_brand", Value(None, "string"), Value("/"), "p_type"),
    )


@query("""SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, isoyear(o_orderdate)::BIGINT AS iy, quarter(o_orderdate)::BIGINT AS q, month(o_orderdate)::BIGINT AS m, week(o_orderdate)::BIGINT AS w, (dayofweek(o_orderdate) + 1)::BIGINT AS wd, isodow(o_orderdate)::BIGINT AS iwd,
day(o_orderdate)::BIGINT AS d, hour(o_orderdate)::BIGINT AS h, minute(o_orderdate)::BIGINT AS mi, second(o_orderdate)::BIGINT AS s FROM orders""")
def extract_parts(db: Database) -> Any:
    x = "o_orderdate"
    return db("Order").values("o_orderkey", y=D.ExtractYear(x), iy=D.ExtractIsoYear(x), q=D.ExtractQuarter(x), m=D.ExtractMonth(x), w=D.ExtractWeek(x), wd=D.ExtractWeekDay(x), iwd=D.ExtractIsoWeekDay(x), d=D.ExtractDay(x), h=D.ExtractHour(x), mi=D.ExtractMinute(x), s=D.ExtractSecond(x))


@query("""SELECT event_id, date_trunc('year', ts)::TIMESTAMP AS y, date_trunc('quarter', ts)::TIMESTAMP AS q, date_trunc('month', ts)::TIMESTAMP AS m, date_trunc('week', ts)::TIMESTAMP AS w, date_trunc('hour', ts)::TIMESTAMP AS h,
date_trunc('minute', ts)::TIMESTAMP AS mi, ts::DATE AS d, ts + INTERVAL 36 HOUR AS later, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS secs FROM events""")
def trunc_and_shift(db: Database) -> Any:
    return db("Event").values(
        "event_id", y=D.TruncYear("ts"), q=D.TruncQuarter("ts"), m=D.TruncMonth("ts"), w=D.TruncWeek("ts"), h=D.TruncHour("ts"), mi=D.TruncMinute("ts"), d=D.TruncDate("ts"),
        later=D.Shift("ts", hours=36), secs=D.Difference(D.TruncSecond("ts"), Value("2024-01-01", "timestamp")),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sum(abs(l_discount - 0.05)), 6) AS a, round(sum(sqrt(l_quantity)), 6) AS sq, round(sum(exp(l_tax)), 6) AS ex, round(sum(ln(l_quantity)), 6) AS l, round(sum(log(2, l_quantity)), 6) AS l2,
round(sum(power(l_quantity, 2)), 4) AS p, sum(l_orderkey % 7)::BIGINT AS md, round(sum(sin(l_quantity) + cos(l_quantity) + atan(l_tax) + radians(l_quantity)), 6) AS tr, sum(floor(l_extendedprice)) AS fl, sum(ceil(l_extendedprice)) AS ce, round(sum(l_quantity / 7), 6) AS dv, sum(l_orderkey // 7)::BIGINT AS di FROM lineitem GROUP BY 1, 2, 3, 4""")
def math_functions(db: Database) -> Any:
    q = "l_quantity"
    return db("Lineitem").values("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").annotate(
        a=M.Round(A.Sum(M.Abs(F("l_discount") - 0.05)), 6), sq=M.Round(A.Sum(M.Sqrt(q)), 6), ex=M.Round(A.Sum(M.Exp("l_tax")), 6), l=M.Round(A.Sum(M.Ln(q)), 6), l2=M.Round(A.Sum(M.Log(2, q)), 6),
        p=M.Round(A.Sum(M.Power(q, 2)), 4), md=A.Sum(F("l_orderkey") % 7), tr=M.Round(A.Sum(M.Sin(q) + M.Cos(q) + M.ATan("l_tax") + M.Radians(q)), 6), fl=A.Sum(M.Floor("l_extendedprice")), ce=A.Sum(M.Ceil("l_extendedprice")),
        dv=M.Round(A.Sum(F(q) / 7), 6), di=A.Sum(M.IntDiv("l_orderkey", 7)),
    )


@query(f"""SELECT o_orderkey, coalesce(st, '-') AS c, greatest(o_custkey, 500) AS g, least(o_custkey, 500) AS l, CAST(o_totalprice AS BIGINT) - CAST(o_totalprice AS BIGINT) AS z, TRY_CAST(o_orderpriority AS INTEGER) AS t, st IS DISTINCT FROM 'O' AS df FROM {_NULLABLE}""")
def comparison_functions(db: Database) -> Any:
    return _nullable(db).values("o_orderkey", c=C.Coalesce("st", Value("-")), g=C.Greatest("o_custkey", 500), l=C.Least("o_custkey", 500), z=C.Cast("o_totalprice", "bigint") - C.Cast("o_totalprice", "bigint"), t=C.Cast("o_orderpriority", "int", safe=True), df=C.IsDistinctFrom("st", Value("O")))


@query("SELECT n_nationkey, '{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"none\":null}' AS obj, '[' || n_nationkey || ',' || n_regionkey || ']' AS arr FROM nation")
def json_build(db: Database) -> Any:
    return db("Nation").values("n_nationkey", obj=J.JSONObject(id="n_nationkey", name="n_name", none=Value(None, "string")), arr=J.JSONArray("n_nationkey", "n_regionkey"))


@query("""SELECT p_partkey, string_split(p_type, ' ')[1] AS a, string_split(p_type, ' ')[-1] AS z, list_slice(string_split(p_type, ' '), 2, 3) AS s, len(string_split(p_type, ' ')) AS n,
map {'size': p_size}['size'] AS v, coalesce(map {'size': p_size}['none'], 0) AS w FROM part""")
def container_functions(db: Database) -> Any:
    words = K.Split("p_type", " ")
    sizes = K.Map(Value("size"), "p_size")
    return db("Part").values("p_partkey", a=K.ArrayItem(words, 0), z=K.ArrayItem(words, -1), s=K.ArraySlice(words, 1, 3), n=K.ArrayLength(words), v=K.MapValue(sizes, "size"), w=K.MapValue(sizes, "none", 0))


# -- search, vectors, other types ------------------------------------------------


@query("SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'the') AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'this')")
def search_plain(db: Database) -> Any:
    return db("Document").filter(text__search="the this").values("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_replace(' ' || lower(text) || ' ', '[^\\p{L}\\p{N}]+', ' ', 'g') LIKE '% of the %' AND NOT list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'was')")
def search_web(db: Database) -> Any:
    q = search.SearchQuery('"of the" -was', "websearch")
    return db("Document").annotate(v=search.SearchVector("text")).annotate(hit=search.SearchMatch("v", q)).filter(hit=True).values("doc_id")


@query("""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, round(len(list_filter(w, lambda x: x IN ('the', 'that'))) / greatest(len(w), 1), 9) AS r FROM t""")
def search_density(db: Database) -> Any:
    q = search.SearchQuery("the that")
    return db("Document").values("doc_id", r=M.Round(search.SearchDensity(search.SearchVector("text"), q), 9))


@query("""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents),
f AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'that')) AS f FROM t), s AS (SELECT count(*) AS d, avg(n) AS m, sum((f > 0)::INT) AS h FROM f)
SELECT doc_id AS id, round(ln(1 + (d - h + 0.5) / (h + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / m)), 6) AS score FROM f, s WHERE f > 0""")
def search_bm25(db: Database) -> Any:
    return search.bm25(db("Document").df, "doc_id", "text", search.SearchQuery("that")).select("id", S.round("score", 6).alias("score"))


def _probe(i: int) -> list[float]:
    return [((i * 7 + k) % 5 - 2) / 4 for k in range(64)]


_V = "[" + ", ".join(str(x) for x in _probe(1)) + "]::DOUBLE[]"


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_V}), 6) AS d FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_V}), vec_id LIMIT 10")
def knn_l2(db: Database) -> Any:
    return db("Embedding").annotate(x=V.L2Distance("embedding", _probe(1))).order_by("x", "vec_id")[:10].values("vec_id", d=M.Round("x", 6))


@query(f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_V}), 6) AS d FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_V}), vec_id LIMIT 10")
def knn_cosine(db: Database) -> Any:
    return db("Embedding").annotate(x=V.CosineDistance("embedding", _probe(1))).order_by("x", "vec_id")[:10].values("vec_id", d=M.Round("x", 6))


@query(f"SELECT vec_id, round(-list_inner_product(embedding::DOUBLE[], {_V}), 5) AS d FROM embeddings")
def inner_product(db: Database) -> Any:
    return db("Embedding").values("vec_id", d=M.Round(V.InnerProduct("embedding", _probe(1)), 5))


@query("""WITH g AS (SELECT n_nationkey, list_distinct(flatten([[substr('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)] for w in string_split_regex(lower(n_name), '[^a-z0-9]+')])) AS t FROM nation),
q AS (SELECT list_distinct([substr('  nation ', i, 3) for i in range(1, 8)]) AS t)
SELECT n_nationkey, round(len(list_intersect(g.t, q.t)) / len(list_distinct(list_concat(g.t, q.t))), 6) AS s FROM g, q WHERE regexp_full_match((SELECT n_name FROM nation x WHERE x.n_nationkey = g.n_nationkey), '[A-Za-z0-9_ ]+')""")
def trigram(db: Database) -> Any:
    return db("Nation").filter(n_name__posix_regex="^[A-Za-z0-9_ ]+$").values("n_nationkey", s=M.Round(T.TrigramSimilarity("n_name", "nation"), 6))


@query("SELECT c_custkey FROM customer WHERE c_custkey // 65536 = 0 AND (c_custkey // 64) % 4 = 1 AND c_custkey < 256")
def network_contained(db: Database) -> Any:
    ip = RawSQL("concat('10.0.', c_custkey div 256, '.', c_custkey % 256)")
    return db("Customer").alias(ip=ip).filter(ip__net_contained="10.0.0.64/26").values("c_custkey")


@query("SELECT p_partkey, p_size >= 10 AND p_size + 5 <= 30 AS inside, p_size + 5 <= 20 AS before, p_size < 30 AND 20 < p_size + 5 AS meets, p_size + 5 = 20 OR p_size = 30 AS adj FROM part")
def range_relations(db: Database) -> Any:
    span = ranges.Range("p_size", F("p_size") + 5)
    df = db("Part").annotate(r=span).df
    return df.select("p_partkey", ranges.compare("contained_by", S.col("r"), (10, 30)).alias("inside"), ranges.compare("fully_lt", S.col("r"), (20, 30)).alias("before"), ranges.compare("overlap", S.col("r"), (20, 30)).alias("meets"), ranges.compare("adjacent_to", S.col("r"), (20, 30)).alias("adj"))


@query("SELECT n_nationkey, 'top.r' || n_regionkey AS sub FROM nation WHERE n_regionkey = 2")
def label_paths(db: Database) -> Any:
    path = T.Concat(Value("top.r"), "n_regionkey", Value(".n"), "n_nationkey")
    return db("Nation").annotate(p=path).filter(p__descendant_of="top.r2").values("n_nationkey", sub=T.Subpath("p", 0, 2))


@query("SELECT p_partkey, p_size * 2.0 AS area, 2.0 * (p_size + 2) AS around, p_size > 10 AS inside FROM part")
def geometry(db: Database) -> Any:
    box = T.Concat(Value("POLYGON((0 0, "), "p_size", Value(" 0, "), "p_size", Value(" 2, 0 2, 0 0))"))
    return db("Part").annotate(g=box).values("p_partkey", area=G.Area("g"), around=G.Perimeter("g"), inside=G.GeoContains("g", Value("POINT(10 1)")))


# -- scopes, versions, prefetch, sources -----------------------------------------


def _scoped(db: Database, **kw: Any) -> Database:
    base = db.frame("orders").select("*", S.when(S.col("o_orderstatus") == "F", S.col("o_orderdate")).alias("deleted_at"), (S.col("o_custkey") % 3).alias("tenant"))
    from quern.sources.models import Registry

    r = Registry()
    r.add(Model("Order", "orders", ("o_custkey",), soft_delete="deleted_at", version="o_orderkey", **kw))
    return Database(db.spark, r, frames={"orders": base})


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def soft_delete(db: Database) -> Any:
    return _scoped(db)("Order").values("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def only_deleted(db: Database) -> Any:
    return _scoped(db)("Order").only_deleted().values("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 3 IN (0, 2)")
def tenants(db: Database) -> Any:
    return _scoped(db, tenant="tenant").scoped(0, 2)("Order").include_deleted().values("o_orderkey")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def latest_versions(db: Database) -> Any:
    return _scoped(db)("Order").include_deleted().final().values("o_custkey", "o_orderkey")


@query("SELECT n_nationkey, list_sort(coalesce((SELECT list(c_custkey) FROM (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_custkey LIMIT 3)), [])) AS ids FROM nation")
def prefetch_sliced(db: Database) -> Any:
    first = db("Customer").order_by("c_custkey").only("c_custkey", "c_nationkey")[:3]
    return db("Nation").prefetch_related(Prefetch("customers", first)).df.select("n_nationkey", S.transform("customers", lambda r: r["c_custkey"]).alias("ids"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def raw_sql(db: Database) -> Any:
    return db.raw("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > :least GROUP BY 1", least=1000)


@query("SELECT n_nationkey, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey")
def dictionary_lookup(db: Database) -> Any:
    from quern.sources.tables import Dictionary

    regions = Dictionary(db.frame("region"), "r_regionkey")
    return regions.get(db("Nation").df, "n_regionkey", rn="r_name").select("n_nationkey", "rn")


# -- writes ----------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 4 OR c_custkey % 2 = 0
UNION ALL SELECT 1000000 + n_nationkey, 1.0 FROM nation""")
def merge_rows(db: Database) -> Any:
    from quern.operators.writes import Merge

    target = db.frame("customer").select("c_custkey", "c_acctbal")
    source = target.where("c_custkey % 2 = 0 OR c_custkey % 5 = 4").unionByName(db.frame("nation").select((S.col("n_nationkey") + 1_000_000).cast("long").alias("c_custkey"), S.lit(1.0).alias("c_acctbal")))
    merge = Merge(target, source, {"c_custkey": "c_custkey"})
    merge = merge.when_matched("update", condition="c_custkey % 2 = 0", c_acctbal=S.lit(0.0)).when_matched("delete").when_not_matched(c_custkey=S.col("src.c_custkey"), c_acctbal=S.col("src.c_acctbal"))
    return merge.result()


@query("SELECT c_custkey, CASE WHEN c_custkey < 10 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_rows(db: Database) -> Any:
    from quern.operators.writes import updated

    return updated(db.frame("customer"), S.col("c_custkey") < 10, c_acctbal=S.col("c_acctbal") + 1).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey <> 3")
def delete_cascade(db: Database) -> Any:
    from quern.operators.writes import Deletion

    d = Deletion(db, {"orders": "cascade", "customers": "cascade", "suppliers": "set_null", "lines": "cascade", "events": "cascade", "parts": "keep"})
    return d.collect("Nation", db("Nation").filter(n_nationkey=3).df).remaining("Customer").select("c_custkey", "c_name")


@query("SELECT o_orderkey, 'update' AS op FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'delete' FROM orders WHERE o_orderkey % 100 = 0 AND o_orderstatus <> 'P'")
def change_rows(db: Database) -> Any:
    from quern.streaming.capture import changes

    before = db.frame("orders")
    after = before.where("NOT (o_orderkey % 100 = 0 AND o_orderstatus <> 'P')").withColumn("o_orderstatus", S.when(S.col("o_orderstatus") == "P", "Q").otherwise(S.col("o_orderstatus")))
    return changes(before, after, ["o_orderkey"]).select("o_orderkey", "op")


@query("""SELECT p_partkey, trim('  ' || p_name || ' ') AS t, ltrim('  ' || p_name || ' ') AS l, rtrim('  ' || p_name || ' ') AS r, sha1(p_name) AS s1, chr(p_size + 300) AS ch, unicode('x') AS o,
split_part(p_name, ' ', 1) AS w FROM part""")
def more_text(db: Database) -> Any:
    padded = T.Concat(Value("  "), "p_name", Value(" "))
    return db("Part").values("p_partkey", t=T.Trim(padded), l=T.LTrim(padded), r=T.RTrim(padded), s1=T.SHA1("p_name"), ch=T.Chr(F("p_size") + 300), o=T.Ord(Value("x")), w=K.ArrayItem(K.Split("p_name", " "), 0))


@query("""SELECT p_partkey, round(tan(p_size), 6) AS t, round(cot(p_size), 6) AS ct, round(asin(1.0 / p_size), 9) AS a, round(acos(1.0 / p_size), 9) AS ac, round(atan2(p_size, 2), 9) AS a2, round(degrees(p_size), 6) AS d,
sign(p_size - 20)::DOUBLE AS s, round(pi() * p_size, 6) AS p, round(p_retailprice, 1) AS r FROM part""")
def more_math(db: Database) -> Any:
    x = "p_size"
    one = Value(1.0) / F(x)
    return db("Part").values(
        "p_partkey", t=M.Round(M.Tan(x), 6), ct=M.Round(M.Cot(x), 6), a=M.Round(M.ASin(one), 9), ac=M.Round(M.ACos(one), 9), a2=M.Round(M.ATan2(x, Value(2)), 9), d=M.Round(M.Degrees(x), 6),
        s=M.Sign(F(x) - 20), p=M.Round(M.Pi() * F(x), 6), r=M.Round("p_retailprice", 1),
    )


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'machinery' ORDER BY c_custkey")
def collation(db: Database) -> Any:
    return db("Customer").annotate(seg=C.Collate("c_mktsegment", "UTF8_LCASE")).filter(seg="machinery").values("c_custkey")


@query("SELECT p_partkey, map_keys(map {p_brand: p_size}) AS k, map_values(map {p_brand: p_size}) AS v, p_brand = 'Brand#2' AS has, p_size AS e, list_has_all(['red', 'blue', 'bolt'], string_split(p_name, ' ')) AS sub, list_has_any(string_split(p_name, ' '), ['red']) AS ov FROM part")
def more_containers(db: Database) -> Any:
    m, words = K.Map("p_brand", "p_size"), K.Split("p_name", " ")
    return db("Part").values(
        "p_partkey", k=K.MapKeys(m), v=K.MapValues(m), has=K.MapContainsKey(m, "Brand#2"), e=K.TupleElement(K.Tuple(a="p_size"), "a"),
        sub=K.ArrayContainedBy(words, K.Array(Value("red"), Value("blue"), Value("bolt"))), ov=K.ArrayOverlap(words, K.Array(Value("red"))),
    )


@query("SELECT l_returnflag, [round(x, 4) for x in quantile_cont(l_extendedprice, [0.1, 0.5, 0.9])] AS q, quantile_disc(l_linenumber, 0.5) AS e, count(DISTINCT l_partkey) AS u, list_sort(list(DISTINCT l_linenumber)) AS g FROM lineitem GROUP BY 1")
def more_aggregates(db: Database) -> Any:
    rows = db("Lineitem").values("l_returnflag").annotate(q=A.Quantiles("l_extendedprice", 0.1, 0.5, 0.9), e=A.Quantile("l_linenumber", 0.5, exact=True), u=A.UniqExact("l_partkey"), g=A.GroupUniqArray("l_linenumber"))
    return rows.df.withColumn("q", S.transform("q", lambda x: S.round(x, 4)))


@query("SELECT l_returnflag, round(regr_sxx(l_tax, l_quantity), 4) AS xx, round(regr_syy(l_tax, l_quantity), 6) AS yy, round(regr_sxy(l_tax, l_quantity), 4) AS xy, round(regr_avgy(l_tax, l_quantity), 8) AS ay, round(covar_samp(l_tax, l_quantity), 8) AS cs, round(var_samp(l_tax), 10) AS vs, round(avg(DISTINCT l_linenumber), 6) AS ad FROM lineitem GROUP BY 1")
def more_statistics(db: Database) -> Any:
    yx = ("l_tax", "l_quantity")
    return db("Lineitem").values("l_returnflag").annotate(
        xx=M.Round(A.RegrSXX(*yx), 4), yy=M.Round(A.RegrSYY(*yx), 6), xy=M.Round(A.RegrSXY(*yx), 4), ay=M.Round(A.RegrAvgY(*yx), 8), cs=M.Round(A.CovarSamp(*yx), 8), vs=M.Round(A.Variance("l_tax", sample=True), 10), ad=M.Round(A.Avg("l_linenumber", distinct=True), 6),
    )


@query("SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']' AS names FROM nation GROUP BY 1")
def json_agg(db: Database) -> Any:
    return db("Nation").values("n_regionkey").annotate(names=A.JSONAgg("n_name"))


@query("SELECT list(event_type ORDER BY n DESC)[:3] AS top FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def top_k(db: Database) -> Any:
    return db("Event").aggregate(top=A.TopK("event_type", 3))


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 20")
def json_filter(db: Database) -> Any:
    return db("Event").filter(props__filter={"k__gte": 10, "k__lte": 20}).values("event_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(json_extract_string(props, '$.k') AS DOUBLE), event_id)::INTEGER AS place FROM events")
def json_order(db: Database) -> Any:
    place = Window(WF.RowNumber(), partition_by=["user_id"], order_by=[J.JsonSortKey("props", "$.k"), "event_id"])
    return db("Event").values("event_id", place=place)


@query("SELECT p_partkey, sqrt((p_size - 3.0) ^ 2 + 16) AS d, sqrt((p_size - 3.0) ^ 2 + 16) <= 10 AS near, p_size <= 20 AS meet, 'POINT' AS kind, 1::BIGINT AS n FROM part")
def more_geometry(db: Database) -> Any:
    point = T.Concat(Value("POINT("), "p_size", Value(" 4)"))
    return db("Part").annotate(g=point).values(
        "p_partkey", d=G.Distance("g", Value("POINT(3 0)")), near=G.DWithin("g", Value("POINT(3 0)"), 10), meet=G.BoxesMeet("g", Value("LINESTRING(0 0, 20 9)")), kind=G.GeometryTypeName("g"), n=G.NumPoints("g"))


@query("SELECT p_brand, min(p_size)::DOUBLE AS x0, min(p_partkey)::DOUBLE AS y0, max(p_size)::DOUBLE AS x1, max(p_partkey)::DOUBLE AS y1 FROM part GROUP BY 1")
def geometry_extent(db: Database) -> Any:
    return G.extent(db("Part").annotate(g=T.Concat(Value("POINT("), "p_size", Value(" "), "p_partkey", Value(")"))).df, ["p_brand"], "g")


@query("SELECT p_partkey, regexp_replace(p_name, '\\b(red|bolt)\\b', '<b>\\1</b>', 'gi') AS h FROM part")
def search_headline(db: Database) -> Any:
    return db("Part").values("p_partkey", h=search.SearchHeadline("p_name", search.SearchQuery("red bolt")))


@query("SELECT p_partkey, p_name FROM part WHERE p_size >= 10 AND p_brand IN ('Brand#2', 'Brand#4') AND lower(p_name) LIKE '%bolt%' ORDER BY p_size DESC, p_partkey LIMIT 5 OFFSET 5")
def request_query(db: Database) -> Any:
    from quern.plans.request import RequestQuery

    r = RequestQuery({"least": ("p_size__gte", int), "brands": ("p_brand__in", str)}, ordering=("p_size", "p_partkey"), search=("p_name",), page_size=5)
    return r.apply(db("Part").values("p_partkey", "p_name"), {"least": "10", "brands": "Brand#2,Brand#4", "q": "BOLT", "order": "-p_size,p_partkey", "page": 2})


@query("SELECT DISTINCT s_suppkey, s_name FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_partkey = 7")
def related_rows(db: Database) -> Any:
    return db("Part").related("suppliers", 7).values("s_suppkey", "s_name")


@query("SELECT o_custkey, sum(o_totalprice > 100000)::BIGINT AS o_totalprice FROM orders GROUP BY 1")
def summing_final(db: Database) -> Any:
    from quern.operators.dml import summed_model

    ones = db.frame("orders").select("o_custkey", (S.col("o_totalprice") > 100000).cast("long").alias("o_totalprice"))
    return summed_model(ones, Model("x", "x", ("o_custkey",)), ["o_totalprice"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0")
def collapsing_final(db: Database) -> Any:
    from quern.operators.dml import collapsed

    rows = db.frame("orders").select("o_orderkey", S.lit(1).alias("sign"))
    return collapsed(rows.union(rows.where("o_orderkey % 10 = 0").withColumn("sign", S.lit(-1))), Model("x", "x", ("o_orderkey",)), "sign").select("o_orderkey")


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, 'new' FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT n_nationkey + 100, 'new' FROM nation WHERE n_nationkey < 5""")
def upsert_rows(db: Database) -> Any:
    from quern.operators.writes import upserted

    table = db.frame("nation").select("n_nationkey", "n_name")
    new = table.where("n_nationkey >= 20").unionByName(table.where("n_nationkey < 5").withColumn("n_nationkey", S.col("n_nationkey") + 100)).withColumn("n_name", S.lit("new"))
    return upserted(table, new, ["n_nationkey"], ["n_name"])


@query("SELECT c_custkey, twice FROM (SELECT c_custkey, c_acctbal * 2 AS twice FROM customer) WHERE twice > 15000")
def stored_function(db: Database) -> Any:
    from quern.operators.expressions import CustomFunction

    db.create_function("quern_twice", "x DOUBLE", "DOUBLE", "x * 2")
    return db("Customer").annotate(twice=CustomFunction("quern_twice")("c_acctbal")).filter(twice__gt=15000).values("c_custkey", "twice")


@query("SELECT n_nationkey, CASE WHEN n_nationkey > 10 THEN 'late' END AS w, n_nationkey > 10 AS late FROM nation")
def condition_values(db: Database) -> Any:
    return db("Nation").annotate(late=Q(n_nationkey__gt=10)).values("n_nationkey", "late", w=Case(When(n_nationkey__gt=10, then="late")))


@query("SELECT c_custkey FROM customer WHERE (c_custkey // 64) % 4 = 1 AND c_custkey < 256 OR c_custkey = 300")
def network_overlap(db: Database) -> Any:
    ip = T.Concat(Value("10.0."), M.IntDiv("c_custkey", 256), Value("."), F("c_custkey") % 256)
    return db("Customer").alias(ip=ip).filter(Q(ip__net_overlaps="10.0.0.64/26") | Q(ip__net_contained_or_equal="10.0.1.44/32")).values("c_custkey")


@query("SELECT n_nationkey, r_regionkey AS r__r_regionkey FROM nation CROSS JOIN region")
def cross_join(db: Database) -> Any:
    return db("Nation").join(db("Region"), "r").values("n_nationkey", "r__r_regionkey")


@query("SELECT a.n_nationkey, b.n_nationkey AS other__n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def theta_join(db: Database) -> Any:
    return db("Nation").join(db("Nation"), "other", {"n_regionkey": "n_regionkey"}, "n_nationkey < other__n_nationkey").values("n_nationkey", "other__n_nationkey")


@query("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM big WHERE n > 12)")
def cte_rows(db: Database) -> Any:
    db("Customer").with_cte("quern_big", db("Order").values("o_custkey").annotate(n=A.Count())).df
    return db("Customer").filter(c_custkey__in=db.view("quern_big").filter(n__gt=12).values("o_custkey")).values("c_custkey")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'part' ELSE 'supplier' END AS kind, CASE WHEN l_quantity > 25 THEN l_partkey ELSE l_suppkey END::VARCHAR AS k FROM lineitem")
def generic_key(db: Database) -> Any:
    from quern.operators.expressions import GenericKey

    arcs = db("Lineitem").annotate(p=Case(When(l_quantity__gt=25, then=F("l_partkey"))), s=Case(When(l_quantity__lte=25, then=F("l_suppkey"))))
    target = GenericKey(part="p", supplier="s")
    return arcs.values("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", kind=target.kind, k=target.key)


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' OR p_brand = 'Brand#4'")
def map_keys_lookup(db: Database) -> Any:
    return db("Part").alias(m=K.Map("p_brand", "p_size")).filter(m__map_has_any_keys=["Brand#2", "Brand#4"]).values("p_partkey")


@query("SELECT p_brand, round(avg(p_size) + 1, 6) AS a FROM part GROUP BY 1")
def python_aggregate(db: Database) -> Any:
    from quern.operators.expressions import PandasAggregate

    def plus_one(v: pd.Series) -> float:
        return float(v.mean()) + 1

    return db("Part").values("p_brand").annotate(a=PandasAggregate(plus_one, "double")("p_size")).df.withColumn("a", S.round("a", 6))


@query(None)
def random_keys(db: Database) -> Any:
    return db("Region").values("r_regionkey", u=T.RandomUUID(), v=T.UuidV7(), h=T.RandomHex(8))


@query("SELECT n_regionkey, 'LINESTRING(' || string_agg(n_nationkey || '.0 ' || n_regionkey || '.0', ', ' ORDER BY n_nationkey) || ')' AS line FROM nation GROUP BY 1")
def make_line(db: Database) -> Any:
    points = db("Nation").annotate(g=T.Concat(Value("POINT("), "n_nationkey", Value(" "), "n_regionkey", Value(")"))).df
    return G.make_line(points, ["n_regionkey"], "g", "n_nationkey")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quern.plans import rows  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from quern.plans import rows  # noqa: F401

    return dict(ORACLES)


__all__ = ["flagship", "network", "oracle_sql", "queries"]
