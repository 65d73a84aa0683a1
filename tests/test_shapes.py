"""Planar shapes: overlays and relations against samples, identities and known cases."""

import math
import random
import time

import pytest

from quern.functions import shapes as G
from quern.operators.expressions import Value


def star(rng, x, y, n):
    turns = sorted(rng.random() * 2 * math.pi for _ in range(n))
    ring = [(x + (r := rng.uniform(1, 5)) * math.cos(t), y + r * math.sin(t)) for t in turns]
    return G.Shape(areas=[[[*ring, ring[0]]]])


def ringed(x0, y0, x1, y1, *holes):
    def ring(a, b, c, d):
        return [(a, b), (c, b), (c, d), (a, d), (a, b)]

    return G.Shape(areas=[[ring(x0, y0, x1, y1), *(ring(*h) for h in holes)]])


def test_overlays_hold_the_points_they_should():
    rng = random.Random(3)
    for _ in range(25):
        a, b = star(rng, 0, 0, rng.randint(3, 7)), star(rng, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.randint(3, 7))
        a, b = G.make_valid(a), G.make_valid(b)
        made = {o: G.overlaid(a, b, o) for o in G.OPERATIONS}
        size = {o: G.area(s) for o, s in made.items()}
        assert size["union"] == pytest.approx(G.area(a) + G.area(b) - size["intersection"])
        assert size["symmetric_difference"] == pytest.approx(size["union"] - size["intersection"], abs=1e-9)
        assert size["difference"] == pytest.approx(G.area(a) - size["intersection"], abs=1e-9)
        for _ in range(60):
            p = (G.Fraction(rng.uniform(-7, 7)), G.Fraction(rng.uniform(-7, 7)))
            for o, keep in G.OPERATIONS.items():
                assert (G.in_areas(made[o], p) == G.INSIDE) == keep(G.in_areas(a.exact(), p) == G.INSIDE, G.in_areas(b.exact(), p) == G.INSIDE)


@pytest.mark.parametrize("one, two, relations", [
    ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))", {"contains", "contains_properly", "covers", "intersects"}),
    ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", {"contains", "covers", "intersects"}),
    ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((4 0, 8 0, 8 4, 4 4, 4 0))", {"touches", "intersects"}),
    ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((2 2, 6 2, 6 6, 2 6, 2 2))", {"overlaps", "intersects"}),
    ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((9 9, 10 9, 10 10, 9 9))", {"disjoint"}),
    ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((4 4, 0 4, 0 0, 4 0, 4 4))", {"equals", "within", "contains", "covers", "covered_by", "intersects"}),
    ("LINESTRING(-1 2, 5 2)", "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", {"crosses", "intersects"}),
    ("LINESTRING(0 0, 4 0)", "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", {"touches", "covered_by", "intersects"}),
    ("LINESTRING(0 0, 4 4)", "LINESTRING(0 4, 4 0)", {"crosses", "intersects"}),
    ("LINESTRING(0 0, 4 0)", "LINESTRING(2 0, 6 0)", {"overlaps", "intersects"}),
    ("LINESTRING(0 0, 4 0)", "LINESTRING(4 0, 6 1)", {"touches", "intersects"}),
    ("POINT(1 1)", "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", {"within", "covered_by", "intersects"}),
    ("POINT(0 1)", "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", {"touches", "covered_by", "intersects"}),
    ("MULTIPOINT(1 1, 9 9)", "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", {"crosses", "intersects"}),
    ("MULTIPOINT(1 1, 9 9)", "MULTIPOINT((1 1), (2 2))", {"overlaps", "intersects"}),
])
def test_relations(one, two, relations):
    a, b = G.read(one), G.read(two)
    found = {r for r in G.RELATIONS if not r.startswith("bbox") and G.related(r, a, b)}
    assert found == relations
    swapped = {"contains": "within", "covers": "covered_by", "within": "contains", "covered_by": "covers"}
    for r in relations - {"contains_properly"}:
        assert G.related(swapped.get(r, r), b, a), r


def test_overlays_of_mixed_kinds():
    square = G.read("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))")
    assert G.write(G.overlaid(G.read("LINESTRING(-1 2, 5 2)"), square, "intersection")) == "LINESTRING (0 2, 4 2)"
    assert G.write(G.overlaid(G.read("LINESTRING(-1 2, 5 2)"), square, "difference")) == "MULTILINESTRING ((-1 2, 0 2), (4 2, 5 2))"
    assert G.write(G.overlaid(square, G.read("POLYGON((4 0, 8 0, 8 4, 4 4, 4 0))"), "intersection")) == "LINESTRING (4 0, 4 4)"
    assert G.write(G.overlaid(square, G.read("POLYGON((4 4, 8 4, 8 8, 4 8, 4 4))"), "intersection")) == "POINT (4 4)"
    assert G.area(G.overlaid(square, G.read("POLYGON((4 0, 8 0, 8 4, 4 4, 4 0))"), "union")) == 32
    frame = G.overlaid(square, G.read("POLYGON((1 1, 3 1, 3 3, 1 3, 1 1))"), "difference")
    assert len(frame.areas) == 1 and len(frame.areas[0]) == 2 and G.area(frame) == 12
    assert G.write(G.overlaid(G.read("POINT(1 1)"), G.read("POINT(2 2)"), "intersection")) == "GEOMETRYCOLLECTION EMPTY"
    assert G.area(G.overlaid(ringed(0, 0, 9, 9, (2, 2, 7, 7)), ringed(3, 3, 6, 6), "union")) == 81 - 25 + 9


def test_readers_and_writers_agree():
    texts = [
        "POINT (1 2.5)", "LINESTRING (0 0, 1 1, 2 0)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 0.5, 2 1, 1 0.5))", "MULTIPOINT (1 1, 2 2)",
        "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "GEOMETRYCOLLECTION (POINT (1 1), LINESTRING (0 0, 1 1))",
    ]
    for t in texts:
        s = G.read(t)
        assert G.write(s) == t and G.write(G.read(G.to_geojson(s))) == t
    assert G.read("SRID=4326;POINT(3 4)").srid == 4326
    point = "01010000000000000000000840" + "0000000000001040"
    assert G.read(point).points == [(3.0, 4.0)] and G.read(bytes.fromhex("0101000020E6100000" + point[10:])).srid == 4326
    for bad in ("POINT(1)", "CIRCLE(1 1)", "POLYGON((0 0, 1 1", ""):
        with pytest.raises((ValueError, IndexError)):
            G.read(bad)


def test_constructions():
    assert G.write(G.convex_hull(G.read("MULTIPOINT(0 0, 4 0, 4 4, 0 4, 2 2, 2 0)"))) == "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"
    assert G.write(G.convex_hull(G.read("MULTIPOINT(0 0, 1 1, 2 2)"))) == "LINESTRING (0 0, 2 2)"
    assert G.write(G.simplify(G.read("LINESTRING(0 0, 1 0.1, 2 0, 3 5)"), 0.5)) == "LINESTRING (0 0, 2 0, 3 5)"
    assert G.write(G.boundary(G.read("LINESTRING(0 0, 1 1, 2 0)"))) == "MULTIPOINT (0 0, 2 0)"
    assert G.write(G.centroid(ringed(0, 0, 4, 2))) == "POINT (2 1)" and G.write(G.envelope(G.read("LINESTRING(0 0, 2 3)"))) == "POLYGON ((0 0, 2 0, 2 3, 0 3, 0 0))"
    bow = G.read("POLYGON((0 0, 4 4, 4 0, 0 4, 0 0))")
    assert not G.is_valid(bow) and G.is_valid(ringed(0, 0, 9, 9, (2, 2, 3, 3))) and not G.is_valid(ringed(0, 0, 4, 4, (5, 5, 6, 6)))
    assert len(G.make_valid(bow).areas) == 2 and G.area(G.make_valid(bow)) == 8
    assert G.area(G.buffer(G.read("POINT(1 1)"), 2, 16)) == pytest.approx(4 * math.pi, rel=0.01)
    assert G.area(G.buffer(G.read("LINESTRING(0 0, 10 0)"), 1, 16)) == pytest.approx(20 + math.pi, rel=0.01)
    assert G.area(G.buffer(ringed(0, 0, 10, 10), -1)) == pytest.approx(64) and G.area(G.buffer(ringed(0, 0, 10, 10), 1, 16)) == pytest.approx(100 + 40 + math.pi, rel=0.01)
    for s in (ringed(0, 0, 9, 9, (1, 1, 8, 8)), ringed(0, 0, 1, 9)):
        assert G.in_areas(s.exact(), G.point_on_surface(s).points[0]) == G.INSIDE
    assert G.distance(ringed(0, 0, 1, 1), ringed(4, 5, 6, 6)) == 5 and G.distance(G.read("POINT(0.5 0.5)"), ringed(0, 0, 1, 1)) == 0
    there = G.transform(G.read("SRID=4326;POINT(13.4 52.5)"), 3857)
    assert there.points[0] == pytest.approx((1491681.18, 6891041.72), abs=0.1) and G.transform(there, 4326).points[0] == pytest.approx((13.4, 52.5))


def test_functions_of_columns(spark):
    from quern.plans.queryset import QuerySet
    from quern.sources.models import Database, Model, Registry

    r = Registry()
    r.add(Model("Shape", "shapes", ("id",)))
    rows = [(1, "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"), (2, "LINESTRING(1 1, 9 9)"), (3, None)]
    db = Database(spark, r, frames={"shapes": spark.createDataFrame(rows, "id int, g string")})
    square = Value("POLYGON((2 2, 6 2, 6 6, 2 6, 2 2))")
    got = QuerySet(db, r.models["Shape"]).values("id", m=G.Intersection("g", square), hit=G.Related("intersects", "g", square), own=G.Related("T*T***T**", "g", square), n=G.NumGeometries("g"), a=G.AreaOf("g"))
    found = {x["id"]: tuple(x)[1:] for x in got.df.collect()}
    assert found[1] == ("POLYGON ((2 2, 4 2, 4 4, 2 4, 2 2))", True, True, 1, 16.0)
    assert found[2][0] == "LINESTRING (2 2, 6 6)" and found[3] == (None,) * 5


def boxes(spark, n):
    """A queryset of ``n`` boxes two high from the origin, 1 to 25 wide."""
    from quern.plans.queryset import QuerySet
    from quern.sources.models import Database, Model, Registry

    r = Registry()
    r.add(Model("Box", "boxes", ("id",)))
    rows = spark.range(n, numPartitions=4).selectExpr("id", "id % 25 + 1 AS w").selectExpr("id", "w", "concat('POLYGON((0 0, ', w, ' 0, ', w, ' 2, 0 2, 0 0))') AS g")
    return QuerySet(Database(spark, r, frames={"boxes": rows}), r.models["Box"])


def test_lookups_of_many_rows_take_seconds(spark):
    other, began = "POLYGON((10 1, 20 1, 20 5, 10 5, 10 1))", time.perf_counter()
    found = boxes(spark, 40_000).filter(g__overlaps=other, g__geo_contains="POINT(3 1)", g__dwithin=("POINT(30 1)", 30), g__relate=(other, "T*T***T**")).exclude(g__covers="POINT(20 2)")
    assert found.df.selectExpr("min(w)", "max(w)", "count(*)").collect() == [(11, 19, 9 * 1600)]
    assert time.perf_counter() - began < 30


def test_matrices_of_stars_of_many_corners_take_little():
    rng, began = random.Random(5), time.perf_counter()
    for _ in range(4):
        a, b = star(rng, 0, 0, 48), star(rng, 1, 1, 48)
        assert G.matrix(a, b) == "212101212" and G.matrix(a, a) == "2FFF1FFF2"
    assert time.perf_counter() - began < 6


def test_overlays_of_many_rows_and_corners_take_seconds(spark):
    other, began = Value("POLYGON((10 1, 20 1, 20 5, 10 5, 10 1))"), time.perf_counter()
    got = boxes(spark, 20_000).values("w", both=G.AreaOf(G.Intersection("g", other)), any=G.AreaOf(G.Union("g", other)), own=G.AreaOf(G.Difference("g", other)), one=G.AreaOf(G.SymmetricDifference("g", other)))
    for w, both, any_, own, one, n in got.df.groupBy("w", "both", "any", "own", "one").count().collect():
        shared = max(min(w, 20) - 10, 0)
        assert (both, any_, own, one, n) == (shared, 2 * w + 40 - shared, 2 * w - shared, 2 * w + 40 - 2 * shared, 800)
    rng = random.Random(7)
    for _ in range(2):
        a, b = star(rng, 0, 0, 48), star(rng, 1, 1, 48)
        size = {o: G.area(G.overlaid(a, b, o)) for o in G.OPERATIONS}
        assert size["union"] == pytest.approx(G.area(a) + G.area(b) - size["intersection"]) and size["symmetric_difference"] == pytest.approx(size["union"] - size["intersection"])
    assert time.perf_counter() - began < 30


def test_overlays_of_numbers_far_apart_are_exact():
    tiny = G.read("POLYGON((0 0, 1e-300 0, 1e-300 1e-300, 0 1e-300, 0 0))")
    vast = G.read("POLYGON((0 0, 1e300 0, 1e300 1e300, 0 1e300, 0 0))")
    assert G.write(G.overlaid(tiny, vast, "intersection")) == G.write(G.make_valid(tiny)) and G.write(G.overlaid(tiny, vast, "union")) == G.write(G.make_valid(vast))
    thirds = G.Shape(areas=[[[(G.Fraction(x, 3 ** k), G.Fraction(y, 7 ** k)) for k, (x, y) in enumerate([(0, 0), (9, 0), (9, 90), (0, 90), (0, 0)], 900)]]])
    assert G.area(G.overlaid(thirds, thirds, "symmetric_difference")) == 0


def test_relations_of_many_rows_take_seconds(spark):
    other, point, five, began = Value("POLYGON((10 1, 20 1, 20 5, 10 5, 10 1))"), Value("POINT(4 1)"), Value("POLYGON((5 2, 5 0, 0 0, 0 2, 5 2))"), time.perf_counter()
    got = boxes(spark, 20_000).values(
        "w", meets=G.Related("intersects", "g", other), touches=G.Related("touches", "g", other), overlaps=G.Related("overlaps", "g", other), apart=G.Related("disjoint", "g", other), holds=G.Related("contains", "g", point),
        same=G.Related("equals", "g", five), inside=G.Related("within", "g", five), boxes=G.Related("bbox_overlaps", "g", other), fits=G.Related("2*2***2**", "g", other))
    rows = got.df.groupBy(*got.df.columns).count().collect()
    assert {tuple(r) for r in rows} == {(w, w >= 10, w == 10, w > 10, w < 10, w > 4, w == 5, w <= 5, w >= 10, w > 10, 800) for w in range(1, 26)}
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize("one, two, found", [
    ("POLYGON((2 2, 4 2, 4 4, 2 4, 2 2))", "POINT(3 1)", "FF2FF10F2"),
    ("MULTIPOINT(1 0, 0 0, 1 4)", "MULTIPOLYGON(((0 2, 4 4, 2 0, 0 2)), ((0 2, 3 2, 3 4, 0 4, 0 2)))", "F00FFF212"),
])
def test_loose_points_have_no_area(one, two, found):
    assert G.matrix(G.read(one), G.read(two)) == found
