"""Planar geometry on WKT text: points, lines and polygons without holes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as S

from quern.operators.expressions import Call, Expression


def points(c: Column) -> Column:
    """The coordinates of a WKT text as an array of (x, y)."""
    inner = S.regexp_extract(c, r"\(+([^()]*)\)+", 1)
    return S.transform(S.split(S.trim(inner), r"\s*,\s*"), lambda p: S.struct(
        S.split(S.trim(p), r"\s+")[0].cast("double").alias("x"), S.split(S.trim(p), r"\s+")[1].cast("double").alias("y")))


def _sides(p: Column, fold: Any) -> Column:
    """A sum over consecutive pairs of points."""
    pairs = S.zip_with(S.slice(p, S.lit(1), S.greatest(S.size(p) - 1, S.lit(0))), S.slice(p, S.lit(2), S.greatest(S.size(p) - 1, S.lit(0))), fold)
    return S.aggregate(pairs, S.lit(0.0), lambda a, x: a + x)


def length(c: Column) -> Column:
    return _sides(points(c), lambda a, b: S.hypot(a["x"] - b["x"], a["y"] - b["y"]))


def area(c: Column) -> Column:
    return S.abs(_sides(points(c), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def distance(a: Column, b: Column) -> Column:
    p, q = points(a)[0], points(b)[0]
    return S.hypot(p["x"] - q["x"], p["y"] - q["y"])


def envelope(c: Column) -> Column:
    p = points(c)
    xs, ys = S.transform(p, lambda q: q["x"]), S.transform(p, lambda q: q["y"])
    return S.struct(S.array_min(xs).alias("x0"), S.array_min(ys).alias("y0"), S.array_max(xs).alias("x1"), S.array_max(ys).alias("y1"))


def contains(polygon: Column, point: Column) -> Column:
    """Whether a point lies inside a polygon, by crossings of a ray."""
    q = points(point)[0]
    crossings = _sides(points(polygon), lambda a, b: S.when(
        ((a["y"] > q["y"]) != (b["y"] > q["y"])) & (q["x"] < (b["x"] - a["x"]) * (q["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1.0).otherwise(0.0))
    return crossings % 2 == 1


def Area(x: Any) -> Expression: return Call("area", area, x)
def GeoLength(x: Any) -> Expression: return Call("geo_length", length, x)
def Perimeter(x: Any) -> Expression: return Call("perimeter", length, x)
def Distance(x: Any, y: Any) -> Expression: return Call("distance", distance, x, y)
def DWithin(x: Any, y: Any, d: float) -> Expression: return Call("dwithin", lambda a, b: distance(a, b) <= d, x, y)
def NumPoints(x: Any) -> Expression: return Call("num_points", lambda c: S.size(points(c)).cast("long"), x)
def Envelope(x: Any) -> Expression: return Call("envelope", envelope, x)
def GeoContains(x: Any, y: Any) -> Expression: return Call("geo_contains", contains, x, y)
def GeometryTypeName(x: Any) -> Expression: return Call("geometry_type", lambda c: S.upper(S.regexp_extract(c, r"^\s*(\w+)", 1)), x)


def centroid(c: Column) -> Column:
    """The mean of the distinct corners, as WKT."""
    p = S.array_distinct(points(c))
    n = S.size(p)
    x = S.aggregate(p, S.lit(0.0), lambda a, q: a + q["x"]) / n
    y = S.aggregate(p, S.lit(0.0), lambda a, q: a + q["y"]) / n
    return S.concat(S.lit("POINT("), x.cast("string"), S.lit(" "), y.cast("string"), S.lit(")"))


def boxes_meet(a: Column, b: Column) -> Column:
    p, q = envelope(a), envelope(b)
    return (p["x0"] <= q["x1"]) & (q["x0"] <= p["x1"]) & (p["y0"] <= q["y1"]) & (q["y0"] <= p["y1"])


def geojson(c: Column) -> Column:
    """Points and lines as GeoJSON."""
    p = S.transform(points(c), lambda q: S.array(q["x"], q["y"]))
    point = S.upper(S.regexp_extract(c, r"^\s*(\w+)", 1)) == "POINT"
    one, many = S.to_json(S.struct(S.lit("Point").alias("type"), p[0].alias("coordinates"))), S.to_json(S.struct(S.lit("LineString").alias("type"), p.alias("coordinates")))
    return S.when(point, one).otherwise(many)


def Centroid(x: Any) -> Expression: return Call("centroid", centroid, x)
def BoxesMeet(x: Any, y: Any) -> Expression: return Call("boxes_meet", boxes_meet, x, y)
def AsGeoJSON(x: Any) -> Expression: return Call("as_geojson", geojson, x)
def Within(x: Any, y: Any) -> Expression: return Call("within", lambda a, b: contains(b, a), x, y)
def IsValid(x: Any) -> Expression: return Call("is_valid", lambda c: S.coalesce(S.forall(points(c), lambda p: p["x"].isNotNull() & p["y"].isNotNull()), S.lit(False)), x)


def extent(df: Any, keys: list[str], column: str) -> Any:
    """The bounding box of each group's geometries, folded before it is shuffled."""
    e = df.withColumn("__e", envelope(S.col(column)))
    return e.groupBy(*keys).agg(S.min("__e.x0").alias("x0"), S.min("__e.y0").alias("y0"), S.max("__e.x1").alias("x1"), S.max("__e.y1").alias("y1"))


def make_line(df: Any, keys: list[str], column: str, order: str, name: str = "line") -> Any:
    """Each group's points as one line, in an order."""
    p = S.struct(S.col(order).alias("o"), points(S.col(column))[0].alias("p"))
    text = S.array_join(S.transform(S.sort_array(S.collect_list(p)), lambda r: S.concat(r["p"]["x"].cast("string"), S.lit(" "), r["p"]["y"].cast("string"))), ", ")
    return df.groupBy(*keys).agg(S.concat(S.lit("LINESTRING("), text, S.lit(")")).alias(name))
