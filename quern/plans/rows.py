"""Registered queries of row access, terminal methods, writes, scopes and sources, each beside its SQL."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as S

from quern.functions import aggregates as A
from quern.functions import datetime as D
from quern.functions import text as T
from quern.operators import lookups, writes
from quern.operators.expressions import Case, Exists, F, OuterReference, Q, Value, When
from quern.operators.recursion import closure
from quern.plans.catalogue import query
from quern.plans.queryset import QuerySet, Select, prefetch_related_objects, register_extension
from quern.sources.models import Database, Model, Registry
from quern.streaming import capture


def told(db: Database, schema: str, *rows: Any) -> DataFrame:
    """What a terminal method returned, as rows."""
    return db.spark.createDataFrame([tuple(r) if isinstance(r, (tuple, list)) else (r,) for r in rows], schema)


# -- terminal methods --------------------------------------------------------------


@query("""SELECT 'first' AS how, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1)
UNION ALL SELECT 'last', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1)
UNION ALL SELECT 'earliest', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1)
UNION ALL SELECT 'latest', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)
UNION ALL SELECT 'first by key', min(o_orderkey) FROM orders UNION ALL SELECT 'last by key', max(o_orderkey) FROM orders""")
def first_and_last(db: Database) -> Any:
    by_price = db("Order").order_by("o_totalprice", "o_orderkey")
    found = [
        ("first", by_price.first()), ("last", by_price.last()), ("earliest", db("Order").earliest("o_orderdate", "o_orderkey")),
        ("latest", db("Order").latest("o_orderdate", "o_orderkey")), ("first by key", db("Order").first()), ("last by key", db("Order").last()),
    ]
    return told(db, "how string, o_orderkey long", *[(how, r["o_orderkey"]) for how, r in found])


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def get_row(db: Database) -> Any:
    r = db("Nation").get(n_nationkey=7)
    return told(db, "n_nationkey long, n_name string", (r["n_nationkey"], r["n_name"]))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 5, 8)")
def in_bulk_rows(db: Database) -> Any:
    return told(db, "c_custkey long, c_name string", *[(k, r["c_name"]) for k, r in sorted(db("Customer").in_bulk([3, 5, 8, -1]).items())])


@query("""SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100) AS some, EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS none,
EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 4) AS has, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n""")
def exists_contains_count(db: Database) -> Any:
    return told(db, "some boolean, none boolean, has boolean, n long", (
        db("Order").filter(o_totalprice__gt=100).exists(), db("Order").filter(o_totalprice__lt=0).exists(),
        db("Nation").contains(n_nationkey=4), db("Order").filter(o_orderstatus="F").count()))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def iterated_rows(db: Database) -> Any:
    rows = db("Nation").filter(n_regionkey=2).values("n_nationkey", "n_name")
    found = list(rows.iterator())
    if sorted(map(tuple, found)) != sorted(map(tuple, rows.stream())):
        raise AssertionError("a streamed read differs from an iterated one")
    return told(db, "n_nationkey int, n_name string", *found)


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 300000")
def values_list_rows(db: Database) -> Any:
    return db("Order").filter(o_totalprice__gt=300000).values_list("o_custkey", "o_orderkey")


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def defer_columns(db: Database) -> Any:
    return db("Customer").defer("c_name", "c_acctbal")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def defer_related_rows(db: Database) -> Any:
    return db("Nation").select_related("region").defer_related("region")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 11")
def limit_offset(db: Database) -> Any:
    return db("Customer").order_by("c_custkey").offset(11).limit(7).values("c_custkey")


@query("SELECT DISTINCT date_trunc('hour', ts)::TIMESTAMP AS ts FROM events")
def datetimes_hours(db: Database) -> Any:
    return db("Event").datetimes("ts", "hour")


@query("SELECT o_totalprice, o_orderkey FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def cursor_of_a_row(db: Database) -> Any:
    by = db("Order").order_by("-o_totalprice", "o_orderkey")
    return told(db, "o_totalprice double, o_orderkey long", by.cursor_values(db("Order").first()))


@query("SELECT c_custkey FROM customer WHERE false")
def nothing(db: Database) -> Any:
    return db("Customer").none().values("c_custkey")


@query("SELECT r_regionkey, r_name FROM region")
def all_rows(db: Database) -> Any:
    return db("Region").all()


# -- sources and scopes ------------------------------------------------------------


@query("SELECT o_orderkey FROM orders")
def sampled_parts(db: Database) -> Any:
    """Samples of a part of the rows at two offsets make up the table, each row once."""
    keys = db("Order").values("o_orderkey")
    half = keys.sample_rows(0.5)
    return half.union(half.sample_offset(0.5), all=True)


@query("SELECT n_nationkey, n_name FROM nation")
def using_another_root(db: Database) -> Any:
    return db("Nation").using(db.root).values("n_nationkey", "n_name")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def query_settings(db: Database) -> Any:
    before = db.spark.conf.get("spark.sql.shuffle.partitions")
    out = db("Order").settings(**{"spark.sql.shuffle.partitions": "3"}).values("o_orderstatus").annotate(n=A.Count()).df
    if db.spark.conf.get("spark.sql.shuffle.partitions") != before:
        raise AssertionError("a query's settings must not outlive it")
    return out


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def prewhere_count(db: Database) -> Any:
    return db("Order").prewhere(o_orderstatus="F").count_df()


@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def view_rows(db: Database) -> Any:
    db("Nation").filter(n_regionkey=1).values("n_name").create_view("quern_some_nations")
    return db.view("quern_some_nations")


@query("SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey > 2")
def raw_with_steps(db: Database) -> Any:
    return db("Nation").raw("SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey >= :least", least=0).filter(n_regionkey__gt=2)


def _marked(db: Database) -> Database:
    """Orders of status F as softly deleted rows of tenants 0 to 2."""
    orders = db.frame("orders").select(
        "o_orderkey", "o_custkey", S.when(S.col("o_orderstatus") == "F", S.col("o_orderdate")).alias("deleted_at"), (S.col("o_custkey") % 3).alias("tenant"))
    r = Registry()
    r.add(Model("Order", "orders", ("o_orderkey",), soft_delete="deleted_at", tenant="tenant"))
    return Database(db.spark, r, frames={"orders": orders})


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def all_tenants_rows(db: Database) -> Any:
    return _marked(db).scoped(1)("Order").all_tenants().values("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 1")
def include_deleted_rows(db: Database) -> Any:
    return _marked(db).scoped(1)("Order").include_deleted().values("o_orderkey")


@query("SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 2 = 1 AS deleted FROM orders")
def restored_rows(db: Database) -> Any:
    table = _marked(db).frame("orders")
    after = writes.updated(table, S.col("deleted_at").isNotNull() & (S.col("o_orderkey") % 2 == 0), deleted_at=S.lit(None))
    return after.select("o_orderkey", S.col("deleted_at").isNotNull().alias("deleted"))


# -- laws of what is approximate or random -----------------------------------------


@query("SELECT event_type, true AS near FROM events GROUP BY 1")
def approximate_distinct_is_near(db: Database) -> Any:
    """Approximate counts lie within a tenth of the exact ones."""
    both = db("Event").values("event_type").annotate(near=A.Uniq("user_id"), exact=A.UniqExact("user_id")).df
    return both.select("event_type", (S.abs(S.col("near") / S.col("exact") - 1) < 0.1).alias("near"))


@query("SELECT true AS known, true AS again, true AS part")
def samples_keep_their_laws(db: Database) -> Any:
    """Samples hold rows of the table, the same for the same seed, and about as many as asked for."""
    keys = db("Order").values("o_orderkey")
    one, two, three = keys.sample(10, seed=7).df, keys.sample(10, seed=7).df, keys.sample_rows(0.1, 0.5).df
    all_ = keys.df
    counts = all_.agg(S.count("*").alias("n")).crossJoin(one.agg(S.count("*").alias("a"))).crossJoin(three.agg(S.count("*").alias("b")))
    strange = one.join(all_, "o_orderkey", "left_anti").agg(S.count("*").alias("s")).crossJoin(one.exceptAll(two).agg(S.count("*").alias("d")))
    off = S.greatest(S.abs(S.col("a") - S.col("n") / 10), S.abs(S.col("b") - S.col("n") / 10))
    return counts.crossJoin(strange).select((S.col("s") == 0).alias("known"), (S.col("d") == 0).alias("again"), (off < 6 * S.sqrt(S.col("n") * 0.09)).alias("part"))


@query("SELECT count(*) AS n, true AS apart, true AS formed FROM customer")
def random_keys_keep_their_laws(db: Database) -> Any:
    """Random keys differ from row to row and have their form."""
    keys = db("Customer").values("c_custkey", u=T.RandomUUID(), v=T.UuidV7(), h=T.RandomHex(16)).df
    formed = S.col("u").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$") & S.col("v").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$") & S.col("h").rlike("^[0-9a-f]{32}$")
    counts = keys.agg(S.count("*").alias("n"), S.least(S.count_distinct("u"), S.count_distinct("v"), S.count_distinct("h")).alias("d"), S.bool_and(formed).alias("formed"))
    return counts.select("n", (S.col("d") == S.col("n")).alias("apart"), "formed")


# -- keys, correlation, recursion --------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 1 AND 700 AND l_linenumber = 1 + l_orderkey % 3")
def composite_key_list(db: Database) -> Any:
    return db("Lineitem").filter(pk__in=[(k, 1 + k % 3) for k in range(1, 701)]).values("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey BETWEEN 1 AND 450 AND l_linenumber = 1 + l_orderkey % 3)")
def composite_key_excluded(db: Database) -> Any:
    return db("Lineitem").exclude(pk__in=[(k, 1 + k % 3) for k in range(1, 451)]).values("l_orderkey", "l_linenumber")


@query("SELECT c.l_orderkey, c.l_linenumber, l.l_quantity AS line__l_quantity FROM lineitem c LEFT JOIN lineitem l ON l.l_orderkey = c.l_orderkey AND l.l_linenumber = c.l_linenumber WHERE c.l_quantity > 45")
def composite_key_join(db: Database) -> Any:
    r = Registry()
    r.add(Model("Lineitem", "lineitem", ("l_orderkey", "l_linenumber")))
    r.add(Model("Claim", "claims", ("l_orderkey", "l_linenumber")))
    r.foreign_key("Claim", "line", "Lineitem", ("l_orderkey", "l_linenumber"), "claims")
    claims = db.frame("lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber")
    return Database(db.spark, r, frames={"lineitem": db.frame("lineitem"), "claims": claims})("Claim").values("l_orderkey", "l_linenumber", "line__l_quantity")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 40 * c_acctbal) AS big FROM customer")
def exists_by_inequality(db: Database) -> Any:
    inner = db("Order").alias(part=F("o_totalprice") / 40).filter(o_custkey=OuterReference("c_custkey"), part__gt=OuterReference("c_acctbal"))
    return db("Customer").annotate(big=Exists(inner)).values("c_custkey", "big")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey <= 6")
def recursion_without_limit(db: Database) -> Any:
    chain = db("Customer").filter(c_custkey__lte=6).df.select(S.col("c_custkey").alias("id"), (S.col("c_custkey") - 1).alias("parent"))
    return closure(chain, chain.where("id = 6"), ["id"], ["parent"], ["id"]).select("id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey BETWEEN 3 AND 6")
def recursion_to_a_depth(db: Database) -> Any:
    chain = db("Customer").filter(c_custkey__lte=6).df.select(S.col("c_custkey").alias("id"), (S.col("c_custkey") - 1).alias("parent"))
    return closure(chain, chain.where("id = 6"), ["id"], ["parent"], ["id"], max_depth=3).select("id")


# -- aggregates --------------------------------------------------------------------


@query("""SELECT o_custkey, array_agg(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS falling, string_agg(o_orderstatus, '/' ORDER BY o_orderdate DESC, o_orderkey DESC) AS told,
array_agg(DISTINCT o_orderstatus ORDER BY o_orderstatus DESC) AS kinds FROM orders GROUP BY 1""")
def falling_aggregates(db: Database) -> Any:
    return db("Order").values("o_custkey").annotate(
        falling=A.ArrayAgg("o_orderkey", order_by=["-o_totalprice", "o_orderkey"]), told=A.StringAgg("o_orderstatus", "/", order_by=["-o_orderdate", "-o_orderkey"]),
        kinds=A.ArrayAgg("o_orderstatus", order_by=["-o_orderstatus"], distinct=True))


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.37) AS q, quantile_disc(l_extendedprice, 0.5) FILTER (l_quantity > 10) AS m FROM lineitem GROUP BY 1")
def exact_quantiles(db: Database) -> Any:
    return db("Lineitem").values("l_returnflag").annotate(q=A.Quantile("l_extendedprice", 0.37, exact=True), m=A.Quantile("l_extendedprice", 0.5, exact=True, filter=Q(l_quantity__gt=10)))


@query("SELECT l_returnflag, count(DISTINCT l_linenumber) AS few, count(DISTINCT l_linenumber) AS fewer, 'x' AS some, 'x' AS last FROM lineitem GROUP BY 1")
def approximate_and_any(db: Database) -> Any:
    """Approximate counts are exact while values are few."""
    return db("Lineitem").values("l_returnflag").annotate(few=A.Uniq("l_linenumber"), fewer=A.UniqCombined("l_linenumber"), some=A.AnyValue(Value("x")), last=A.AnyLast(Value("x")))


# -- lookups and functions ---------------------------------------------------------


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 4 = 0 AND (n_nationkey // 2) = 2 * (n_nationkey // 4)")
def registered_lookup(db: Database) -> Any:
    lookups.register_lookup("multiple_of", lambda c, v: c % v == 0)
    lookups.register_transform("halved", lambda c: S.floor(c / 2).cast("int"))
    return db("Nation").filter(n_nationkey__multiple_of=4, n_nationkey__halved__multiple_of=2).values("n_nationkey")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') AND n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
def global_lookups(db: Database) -> Any:
    letters = [r["r_regionkey"] for r in db("Region").filter(r_name__startswith="A").df.collect()]
    asia = [r["r_regionkey"] for r in db("Region").filter(r_name="ASIA").df.collect()]
    return db("Nation").filter(n_regionkey__global_in=letters, n_regionkey__global_not_in=asia).values("n_nationkey")


@query("SELECT doc_id, md5(strip_accents(coalesce(text, ''))) AS plain FROM documents")
def unaccented(db: Database) -> Any:
    return db("Document").df.select("doc_id", S.md5(T.unaccent(S.coalesce("text", S.lit("")))).alias("plain"))


@query("SELECT n_nationkey, n_regionkey = 1 OR n_regionkey = 2 AS a, n_name = 'CHINA' AS b FROM nation")
def built_conditions(db: Database) -> Any:
    return db("Nation").values("n_nationkey", a=Q.with_connector("OR", n_regionkey=1).__or__(Q(n_regionkey=2)), b=Q.from_expression(Q(n_name="CHINA")))


@query("SELECT count(*) AS n FROM orders")
def moments(db: Database) -> Any:
    """Both moments are the query's own: one instant for all rows, not in the past."""
    same = db("Order").annotate(a=D.Now(), b=D.TransactionNow()).df
    return same.where((S.col("a") == S.col("b")) & (S.col("a") > S.col("o_orderdate"))).agg(S.count("*").alias("n"))


@query("SELECT n_nationkey, '\"' || n_name || '\"' AS t, n_regionkey::VARCHAR AS v FROM nation")
def json_values(db: Database) -> Any:
    from quern.functions import json as J

    return db("Nation").values("n_nationkey", t=J.JsonValue("n_name"), v=J.JsonValue("n_regionkey"))


register_extension("only_even", lambda df, column: df.where(S.col(column) % 2 == 0))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey % 2 = 0")
def extended_query(db: Database) -> Any:
    return db("Nation").only_even("n_nationkey")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN p_brand END AS band FROM part")
def case_without_default(db: Database) -> Any:
    return db("Part").values("p_partkey", band=Case(When(p_size__lt=10, then="small"), When(p_size__lt=30, then=F("p_brand"))))


# -- weighted search ---------------------------------------------------------------


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(f"""WITH v AS (SELECT p_partkey, {_WORDS.format("p_name")} AS a, {_WORDS.format("p_type")} AS d FROM part),
f AS (SELECT p_partkey, list_transform(['red', 'bolt', 'steel'], lambda w: struct_pack(a := len(list_filter(a, lambda x: x = w)), d := len(list_filter(d, lambda x: x = w)))) AS n FROM v)
SELECT p_partkey, round(list_sum(list_transform(n, lambda c: CASE WHEN c.a + c.d = 0 THEN 0 ELSE
  coalesce(list_sum(list_transform(range(1, c.a + c.d + 1), lambda j: CASE WHEN j <= c.a THEN 1.0 ELSE 0.1 END / (j * j))), 0) END)) / (pi() * pi() / 6) / 3, 9) AS r FROM f""")
def search_rank(db: Database) -> Any:
    """Words of the name weigh 1, those of the type 0.1; the name comes first."""
    from quern.functions import math as M
    from quern.functions import search

    vector = search.SearchVector("p_name", weight="A") + search.SearchVector("p_type")
    return db("Part").values("p_partkey", r=M.Round(search.SearchRank(vector, search.SearchQuery("red | bolt | steel", "raw")), 9))


@query(f"""WITH v AS (SELECT p_partkey, {_WORDS.format("p_name")} AS a FROM part),
p AS (SELECT p_partkey, list_filter(range(1, len(a) + 1), lambda i: a[i] = 'red') AS x, list_filter(range(1, len(a) + 1), lambda i: a[i] = 'bolt') AS y FROM v),
d AS (SELECT p_partkey, unnest(x) AS i, y FROM p), e AS (SELECT p_partkey, i, unnest(y) AS j FROM d),
r AS (SELECT p_partkey, 1 - exp(sum(ln(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(i - j) / 1.5 - 2)))))) AS r FROM e GROUP BY 1)
SELECT p_partkey, round(coalesce(r, 0), 9) AS r FROM part LEFT JOIN r USING (p_partkey)""")
def search_rank_of_all(db: Database) -> Any:
    """Two words that are both wanted rank by their nearness."""
    from quern.functions import math as M
    from quern.functions import search

    rank = search.SearchRank(search.SearchVector("p_name"), search.SearchQuery("red bolt"))
    return db("Part").values("p_partkey", r=M.Round(rank, 9))


@query("SELECT p_partkey, lower(p_name) LIKE 'b%' AND NOT regexp_matches(lower(p_name), '\\bred\\b') OR regexp_matches(lower(p_type), '\\bsteel') AS hit FROM part WHERE regexp_matches(lower(p_name), '^[a-z]+ [a-z]+$') AND (NOT regexp_matches(lower(p_name), '\\bb') OR lower(p_name) LIKE 'b%')")
def search_raw(db: Database) -> Any:
    """A prefix of the name but not a word of it, or a prefix of the type."""
    from quern.functions import search

    vector = search.SearchVector("p_name", weight="A") + search.SearchVector("p_type", weight="B")
    lexemes = (search.Lexeme("b", prefix=True, weight="A") & ~search.Lexeme("red")) | search.Lexeme("steel", prefix=True, weight="B")
    rows = db("Part").filter(p_name__iposix_regex="^[a-z]+ [a-z]+$").filter(Q(p_name__istartswith="b") | ~Q(p_name__iposix_regex=r"\bb"))
    one = rows.values("p_partkey", hit=search.SearchMatch(vector, lexemes))
    two = rows.values("p_partkey", hit=search.SearchMatch(vector, search.SearchQuery("'b':*A & !red | steel:*B", "raw")))
    return one.intersection(two)


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')) AS w FROM documents) WHERE w IN ('house', 'houses', 'city', 'cities', 'thing', 'things') GROUP BY 1")
def search_english(db: Database) -> Any:
    """Words in the plural are found by their singular."""
    from quern.functions import search

    found = db("Document").annotate(v=search.SearchVector("text", config="english")).df.select("doc_id", S.size(S.filter("v", lambda x: x["word"].isin([search.stem(w) for w in ("house", "cities", "things")]))).cast("long").alias("n"))
    return found.where("n > 0")


# -- geometry ----------------------------------------------------------------------


def _boxes(db: Database) -> QuerySet:
    """Suppliers as boxes from the origin, as wide as their nation's key and one more, two high."""
    w = F("s_nationkey") + 1
    return db("Supplier").annotate(g=T.Concat(Value("POLYGON((0 0, "), w, Value(" 0, "), w, Value(" 2, 0 2, 0 0))")))


_BOX = "POLYGON((10 1, 20 1, 20 5, 10 5, 10 1))"


@query("""WITH b AS (SELECT s_suppkey, s_nationkey + 1 AS w FROM supplier), i AS (SELECT *, greatest(least(w, 20) - 10, 0) AS i FROM b)
SELECT s_suppkey, i::DOUBLE AS both, (2 * w + 40 - i)::DOUBLE AS any, (2 * w - i)::DOUBLE AS own, (2 * w + 40 - 2 * i)::DOUBLE AS one FROM i""")
def geometry_overlays(db: Database) -> Any:
    from quern.functions import shapes as G

    other = Value(_BOX)
    return _boxes(db).values(
        "s_suppkey", both=G.AreaOf(G.Intersection("g", other)), any=G.AreaOf(G.Union("g", other)), own=G.AreaOf(G.Difference("g", other)), one=G.AreaOf(G.SymmetricDifference("g", other)))


@query("""SELECT s_suppkey, w >= 10 AS meets, w = 10 AS touches, w > 10 AS overlaps, w < 10 AS apart, w > 4 AS holds, w > 4 AS properly, w = 5 AS same, w < 5 AS inside, w >= 10 AS boxes, w > 10 AS fits
FROM (SELECT s_suppkey, s_nationkey + 1 AS w FROM supplier)""")
def geometry_relations(db: Database) -> Any:
    from quern.functions import shapes as G

    other, point, five = Value(_BOX), Value("POINT(4 1)"), Value("POLYGON((5 2, 5 0, 0 0, 0 2, 5 2))")
    return _boxes(db).values(
        "s_suppkey", meets=G.Related("intersects", "g", other), touches=G.Related("touches", "g", other), overlaps=G.Related("overlaps", "g", other), apart=G.Related("disjoint", "g", other),
        holds=G.Related("contains", "g", point), properly=G.Related("contains_properly", "g", point), same=G.Related("equals", "g", five),
        inside=Q.from_expression(G.Related("within", "g", five)) & ~Q.from_expression(G.Related("equals", "g", five)), boxes=G.Related("bbox_overlaps", "g", other), fits=G.Related("2*2***2**", "g", other))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey + 1 > 10 AND s_nationkey + 1 < 20 AND s_nationkey + 1 > 3")
def geometry_lookups(db: Database) -> Any:
    return _boxes(db).filter(g__overlaps=_BOX, g__geo_contains="POINT(3 1)", g__dwithin=("POINT(30 1)", 30), g__relate=(_BOX, "T*T***T**")).exclude(g__covers="POINT(20 2)").values("s_suppkey")


@query("""SELECT s_suppkey, 'POLYGON ((0 0, ' || w || ' 0, ' || w || ' 2, 0 2, 0 0))' AS hull, 'POINT (' || CASE WHEN w % 2 = 0 THEN (w // 2)::VARCHAR ELSE (w / 2)::VARCHAR END || ' 1)' AS middle,
'LINESTRING (0 0, ' || w || ' 0, ' || w || ' 2, 0 2, 0 0)' AS edge, 2.0 * w AS size, 2.0 * w + 4 AS around, 2.0 * w AS sized, 1::BIGINT AS n, true AS valid, greatest(30 - w, 0)::DOUBLE AS far
FROM (SELECT s_suppkey, s_nationkey + 1 AS w FROM supplier)""")
def geometry_constructions(db: Database) -> Any:
    from quern.functions import shapes as G

    return _boxes(db).values(
        "s_suppkey", hull=G.ConvexHull("g"), middle=G.CenterOfMass("g"), edge=G.Boundary("g"), size=G.AreaOf(G.MakeValid("g")), around=G.PerimeterOf(G.Simplify("g", 0.1)), sized=G.AreaOf(G.Box("g")),
        n=G.NumGeometries("g"), valid=G.Valid("g"), far=G.DistanceOf("g", Value("POINT(30 1)")))


# -- writes ------------------------------------------------------------------------


def _nations(db: Database) -> DataFrame:
    return db.frame("nation").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_nationkey, CASE WHEN n_nationkey IN (1, 3) THEN 'renamed' ELSE n_name END AS n_name, CASE WHEN n_nationkey IN (1, 3) THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation")
def bulk_update_rows(db: Database) -> Any:
    rows = told(db, "n_nationkey int, n_name string, n_regionkey int", (1, "renamed", 9), (3, "renamed", 9), (99, "none", 9))
    return writes.bulk_updated(_nations(db), rows, ["n_nationkey"], ["n_name", "n_regionkey"])


@query("SELECT n_nationkey, n_name AS old_name, lower(n_name) AS new_name FROM nation WHERE n_regionkey = 3")
def update_returning(db: Database) -> Any:
    got = writes.returning(_nations(db), S.col("n_regionkey") == 3, n_name=S.lower("n_name"))
    return got.select("new.n_nationkey", S.col("old.n_name").alias("old_name"), S.col("new.n_name").alias("new_name"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 0")
def insert_from_rows(db: Database) -> Any:
    more = db("Nation").filter(n_regionkey=0).df.withColumn("n_nationkey", S.col("n_nationkey") + 100)
    return writes.inserted_from(_nations(db), more)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 4 OR n_regionkey IS NULL")
def hard_delete_rows(db: Database) -> Any:
    return writes.deleted(_nations(db), S.col("n_regionkey") == 4)


@query("""SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT * FROM (VALUES (500, 'new', 1)) v""")
def insert_ignoring_conflicts(db: Database) -> Any:
    rows = told(db, "n_nationkey int, n_name string, n_regionkey int", (2, "known", 0), (500, "new", 1))
    return writes.upserted(_nations(db), rows, ["n_nationkey"])


@query("""SELECT n_nationkey, CASE WHEN n_nationkey >= 20 THEN 'left over' ELSE n_name END AS n_name FROM nation WHERE n_nationkey NOT BETWEEN 10 AND 19""")
def merge_by_source(db: Database) -> Any:
    target = _nations(db).select("n_nationkey", "n_name")
    merge = writes.Merge(target, target.where("n_nationkey < 10"), {"n_nationkey": "n_nationkey"}).when_matched("do_nothing")
    merge = merge.when_not_matched_by_source("delete", condition="n_nationkey < 20").when_not_matched_by_source("update", n_name=S.lit("left over"))
    return merge.checked().result()


@query("""SELECT n_nationkey, 'update' AS action FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey + 50, 'insert' FROM nation WHERE n_nationkey < 2 UNION ALL SELECT n_nationkey, 'delete' FROM nation WHERE n_nationkey BETWEEN 5 AND 6""")
def merge_returning(db: Database) -> Any:
    target = _nations(db).select("n_nationkey", "n_name")
    source = target.where("n_nationkey < 7").union(target.where("n_nationkey < 2").withColumn("n_nationkey", S.col("n_nationkey") + 50))
    merge = writes.Merge(target, source, {"n_nationkey": "n_nationkey"}).when_matched("update", condition="n_nationkey < 5", n_name=S.lit("x")).when_matched("delete")
    return merge.when_not_matched(n_nationkey=S.col("src.n_nationkey"), n_name=S.col("src.n_name")).returning().select("n_nationkey", "action")


@query("""SELECT 'Nation' AS model, count(*) AS n FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'Customer', count(*) FROM customer WHERE c_nationkey = 3
UNION ALL SELECT 'Order', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3""")
def delete_preview_counts(db: Database) -> Any:
    d = writes.Deletion(db, {"lines": "keep", "events": "keep", "suppliers": "keep"}).collect("Nation", db("Nation").filter(n_nationkey=3).df)
    return told(db, "model string, n long", *sorted(d.preview().items()))


@query("SELECT s_suppkey, nullif(s_nationkey, 3) AS s_nationkey FROM supplier")
def delete_set_null(db: Database) -> Any:
    d = writes.Deletion(db, {"customers": "keep", "suppliers": "set_null"}).collect("Nation", db("Nation").filter(n_nationkey=3).df)
    return d.remaining("Supplier").select("s_suppkey", "s_nationkey")


def _links(db: Database) -> DataFrame:
    return db.frame("lineitem").select("l_partkey", "l_suppkey").distinct()


_LINKS = "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"


@query(f"SELECT * FROM {_LINKS} UNION SELECT 7, 9001 UNION SELECT 7, 9002")
def links_added(db: Database) -> Any:
    return writes.link_changes(_links(db), "l_partkey", "l_suppkey", 7, [9001, 9002], "add")


@query(f"SELECT * FROM {_LINKS} WHERE NOT (l_partkey = 7 AND l_suppkey IN (1, 2, 3))")
def links_removed(db: Database) -> Any:
    return writes.link_changes(_links(db), "l_partkey", "l_suppkey", 7, [1, 2, 3], "remove")


@query(f"SELECT * FROM {_LINKS} WHERE l_partkey <> 7 UNION ALL SELECT 7, 1 UNION ALL SELECT 7, 9001")
def links_set(db: Database) -> Any:
    return writes.link_changes(_links(db), "l_partkey", "l_suppkey", 7, [1, 9001], "set")


@query(f"SELECT * FROM {_LINKS} WHERE l_partkey <> 7")
def links_cleared(db: Database) -> Any:
    return writes.link_changes(_links(db), "l_partkey", "l_suppkey", 7, [], "clear")


@query("SELECT n_nationkey, CASE WHEN r_name LIKE 'A%' THEN r_name END AS region_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def select_with_condition(db: Database) -> Any:
    rows = db("Nation").select_related(Select("region", extra_condition=Q(r_name__startswith="A"))).df
    return rows.select("n_nationkey", S.col("region.r_name").alias("region_name"))


@query("SELECT r_regionkey, array_agg(n_nationkey ORDER BY n_nationkey) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey IN (1, 3) GROUP BY 1")
def prefetched_objects(db: Database) -> Any:
    rows = db("Region").filter(r_regionkey__in=[3, 1]).df.collect()
    found = prefetch_related_objects(db, "Region", rows, "nations")
    return told(db, "r_regionkey int, nations array<int>", *[(r["r_regionkey"], [n["n_nationkey"] for n in r["nations"]]) for r in found])


@query("SELECT n_regionkey::BIGINT AS n_regionkey, count(*)::DOUBLE AS n FROM nation GROUP BY 1")
def typed_sql(db: Database) -> Any:
    names, _ = db.described("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
    if [n for n, _ in names] != ["n_regionkey", "n"]:
        raise AssertionError("a described query names its columns")
    return db.execute_sql("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1", schema="n_regionkey bigint, n double")


@query("SELECT n_nationkey, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey")
def reloaded_dictionary(db: Database) -> Any:
    db.add_dictionary("regions", lambda: db.frame("region"), "r_regionkey")
    return db.reload_dictionary("regions").get(db("Nation").df, "n_regionkey", rn="r_name").select("n_nationkey", "rn")


@query("SELECT p_partkey, contains(p_name, ' ') AND string_split(p_name, ' ')[1] = 'red' OR list_contains(string_split(p_name, ' ')[2:], 'red') AS red FROM part")
def any_of_words(db: Database) -> Any:
    from quern.functions import containers as K

    return db("Part").values("p_partkey", red=K.AnyOf(Value("red"), K.Split("p_name", " ")))


@query("SELECT n_nationkey, n_name, x FROM nation JOIN (VALUES (1, 'a'), (2, 'b')) v(k, x) ON n_nationkey = k")
def given_rows(db: Database) -> Any:
    from quern.sources.tables import json_row_values, row_values

    one = row_values(db.spark, "k int, x string", [(1, "a")])
    two = json_row_values(row_values(db.spark, "j string", [('[{"k": 2, "x": "b"}]',)]), "j", "k int, x string")
    both = one.union(two)
    return db("Nation").df.join(both, S.col("n_nationkey") == S.col("k")).select("n_nationkey", "n_name", "x")


# -- change capture ----------------------------------------------------------------


@query("""SELECT 'orders' AS topic, '{"o_orderkey":' || o_orderkey || '}' AS key, 'insert' AS op, o_orderkey FROM orders WHERE o_orderkey % 50 = 0""")
def outbox_entries(db: Database) -> Any:
    """Entries of the same change have the same id, so enqueueing twice adds nothing."""
    after = db.frame("orders").select("o_orderkey", "o_orderstatus")
    changed = capture.changes(after.where("o_orderkey % 50 <> 0"), after, ["o_orderkey"])
    entries = capture.outbox_rows(changed, "orders", ["o_orderkey"])
    once = entries.union(entries).dropDuplicates(["id"])
    return once.select("topic", "key", S.get_json_object("payload", "$.op").alias("op"), S.get_json_object("key", "$.o_orderkey").cast("long").alias("o_orderkey"))


__all__ = ["QuerySet"]
