"""Planar geometry of any type: readers and writers, relations, overlays and constructions.

A shape is a set of points, lines and areas.  Relations and overlays cut all segments
of two shapes at each other; each piece, each node and each side of a piece then lies
wholly inside, on the edge of or outside either shape, which one ray decides.
Coordinates are multiplied to whole numbers while that is decided, and crossings are
exact fractions of them, so no tolerance is needed.
Functions on columns take WKT or EWKT texts and run as vectorised Python functions,
once for each different row of a batch; measures of plain points, lines and rings in
``geo`` stay in the JVM.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from typing import Any

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as S

from quern.functions.text import literal
from quern.operators.expressions import Expression, PandasFunction, wrap

Point = tuple[Any, Any]
KINDS = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")


@dataclass
class Shape:
    """Points, lines and areas (each an outer ring and its holes, rings closed)."""

    points: list[Point] = field(default_factory=list)
    lines: list[list[Point]] = field(default_factory=list)
    areas: list[list[list[Point]]] = field(default_factory=list)
    kind: str = ""
    srid: int = 0

    def mapped(self, f: Callable[[Point], Point]) -> Shape:
        return Shape([f(p) for p in self.points], [[f(p) for p in x] for x in self.lines], [[[f(p) for p in r] for r in a] for a in self.areas], self.kind, self.srid)

    def exact(self) -> Shape:
        return self.mapped(lambda p: (Fraction(p[0]), Fraction(p[1])))

    def chains(self) -> Iterator[list[Point]]:
        yield from self.lines
        for a in self.areas:
            yield from a

    def corners(self) -> list[Point]:
        return [*self.points, *(p for x in self.chains() for p in x)]

    def segments(self) -> list[tuple[Point, Point]]:
        return [(a, b) for x in self.chains() for a, b in zip(x, x[1:]) if a != b]  # noqa: B905

    @property
    def dimension(self) -> int:
        return 2 if self.areas else 1 if self.lines else 0 if self.points else -1


# -- reading and writing -----------------------------------------------------------


def read(text: Any) -> Shape:
    """A shape from WKT, EWKT, (E)WKB as bytes or hexadecimal, or GeoJSON."""
    if isinstance(text, (bytes, bytearray)):
        return _from_wkb(bytes(text))
    text = text.strip()
    if text.startswith("{"):
        return _from_geojson(json.loads(text))
    if re.fullmatch(r"(?:[0-9A-Fa-f]{2})+", text):
        return _from_wkb(bytes.fromhex(text))
    m = re.match(r"SRID=(\d+);", text, re.I)
    out, rest = _from_wkt(text[m.end() :] if m else text)
    if rest.strip():
        raise ValueError(f"no geometry: {text!r}")
    out.srid = int(m[1]) if m else 0
    return out


def _nested(text: str) -> tuple[Any, str]:
    """Brackets of numbers as nested lists."""
    text = text.lstrip()
    if not text.startswith("("):
        m = re.match(r"[^(),]+", text)
        if not m:
            raise ValueError(f"no coordinates: {text!r}")
        x = [float(v) for v in m[0].split()]
        return (x[0], x[1]), text[m.end() :]
    out, text = [], text[1:]
    while True:
        one, text = _nested(text)
        out.append(one)
        text = text.lstrip()
        if text.startswith(","):
            text = text[1:]
        elif text.startswith(")"):
            return out, text[1:]
        else:
            raise ValueError(f"an open bracket: {text!r}")


def _from_wkt(text: str) -> tuple[Shape, str]:
    m = re.match(r"\s*([A-Za-z]+)\s*(?:Z|M|ZM)?\s*(EMPTY\b)?", text)
    if not m or m[1].upper() not in KINDS:
        raise ValueError(f"no geometry: {text!r}")
    kind, rest = m[1].upper(), text[m.end() :]
    if m[2]:
        return Shape(kind=kind), rest
    if kind == "GEOMETRYCOLLECTION":
        parts, rest = [], rest.lstrip()[1:]
        while True:
            one, rest = _from_wkt(rest)
            parts.append(one)
            rest = rest.lstrip()
            if rest[:1] not in (",", ")"):
                raise ValueError(f"an open bracket: {text!r}")
            end, rest = rest[0] == ")", rest[1:]
            if end:
                return _collected(parts), rest
    data, rest = _nested(rest)
    return _of(kind, data), rest


def _of(kind: str, data: Any) -> Shape:
    out = Shape(kind=kind)
    if kind == "POINT":
        out.points = [tuple(data[0])] if isinstance(data, list) else [data]
    elif kind == "LINESTRING":
        out.lines = [data]
    elif kind == "POLYGON":
        out.areas = [data]
    elif kind == "MULTIPOINT":
        out.points = [p[0] if isinstance(p, list) else p for p in data]
    elif kind == "MULTILINESTRING":
        out.lines = data
    else:
        out.areas = data
    return out


def _collected(parts: list[Shape]) -> Shape:
    return Shape([p for x in parts for p in x.points], [p for x in parts for p in x.lines], [p for x in parts for p in x.areas], "GEOMETRYCOLLECTION")


def _from_wkb(data: bytes) -> Shape:
    at, srid = 0, 0

    def take(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(order + form, data, at)
        at += struct.calcsize(order + form)
        return out

    def one() -> Shape:
        nonlocal at, order, srid
        order = "<" if data[at] else ">"
        at += 1
        (code,) = take("I")
        if code & 0x20000000:
            (srid,) = take("I")
        extra = bool(code & 0x80000000) + bool(code & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}[(code & 0xFFFF) // 1000]
        kind = KINDS[(code & 0xFFFF) % 1000 - 1]

        def point() -> Point:
            return take("d" * (2 + extra))[:2]

        def row() -> list[Point]:
            return [point() for _ in range(take("I")[0])]

        if kind == "POINT":
            p = point()
            return Shape(kind=kind) if math.isnan(p[0]) else _of(kind, [p])
        if kind == "LINESTRING":
            return _of(kind, row())
        if kind == "POLYGON":
            return _of(kind, [row() for _ in range(take("I")[0])])
        out = _collected([one() for _ in range(take("I")[0])])
        out.kind = kind
        return out

    order = "<"
    out = one()
    out.srid = srid
    return out


def _from_geojson(doc: dict) -> Shape:
    def tuples(x: Any) -> Any:
        return tuple(x[:2]) if x and isinstance(x[0], (int, float)) else [tuples(y) for y in x]

    if doc["type"] == "GeometryCollection":
        return _collected([_from_geojson(g) for g in doc["geometries"]])
    data = tuples(doc["coordinates"])
    return _of(doc["type"].upper(), [data] if doc["type"] == "Point" else data)


def _kinds(s: Shape) -> list[tuple[str, Any]]:
    """The shape as (kind, coordinates) of one geometry, or of a collection's members."""
    out: list[tuple[str, Any]] = []
    for one, many, found in (("POINT", "MULTIPOINT", s.points), ("LINESTRING", "MULTILINESTRING", s.lines), ("POLYGON", "MULTIPOLYGON", s.areas)):
        if found:
            out.append((one, found[0]) if len(found) == 1 and not s.kind == many else (many, found))
    return out


def _number(x: Any) -> str:
    x = float(x)
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def write(s: Shape) -> str:
    """WKT of a shape, the simplest kind that holds it."""
    def told(x: Any) -> str:
        return f"{_number(x[0])} {_number(x[1])}" if isinstance(x, tuple) else "(" + ", ".join(told(y) for y in x) + ")"

    parts = [f"{kind} " + (f"({told(x)})" if kind == "POINT" else told(x)) for kind, x in _kinds(s)]
    head = f"SRID={s.srid};" if s.srid else ""
    return head + (parts[0] if len(parts) == 1 else f"GEOMETRYCOLLECTION ({', '.join(parts)})" if parts else "GEOMETRYCOLLECTION EMPTY")


def to_geojson(s: Shape) -> str:
    names = {k: n for k, n in zip(KINDS, ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon"))}  # noqa: B905
    parts = [{"type": names[kind], "coordinates": json.loads(json.dumps(x, default=float))} for kind, x in _kinds(s)]
    return json.dumps(parts[0] if len(parts) == 1 else {"type": "GeometryCollection", "geometries": parts})


# -- where a point lies ------------------------------------------------------------

INSIDE, EDGE, OUTSIDE = 0, 1, 2
HALF = Fraction(1, 2)

#: The ends of a segment, and a point as two numerators and their denominator.
Segment = tuple[Any, Any, Any, Any]
Lifted = tuple[Any, Any, Any]


def _cross(o: Point, a: Point, b: Point) -> Any:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _on(p: Point, a: Point, b: Point) -> bool:
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]) and _cross(a, b, p) == 0


def _lifted(p: Point) -> Lifted:
    (x, m), (y, n) = p[0].as_integer_ratio(), p[1].as_integer_ratio()
    if m == n:
        return x, y, m
    w = math.lcm(m, n)
    return x * (w // m), y * (w // n), w


def _sides(segments: list[Segment], p: Lifted) -> tuple[int, bool, bool]:
    """Where a point lies by the parity of crossings of a ray to greater x, and whether points just before and just after it on the ray's line lie inside."""
    x, y, w = p
    on = before = after = False
    for ax, ay, bx, by in segments:
        u, v = ay * w - y, by * w - y
        if (u > 0 and v > 0) or (u < 0 and v < 0):
            continue
        across, turn = (u > 0) != (v > 0), (by - ay) * (ax * w - x) - (bx - ax) * u
        if turn == 0:
            on = on or across or min(ax, bx) * w <= x <= max(ax, bx) * w
            before ^= across
        elif across and (turn > 0) == (by > ay):
            before, after = not before, not after
    return EDGE if on else INSIDE if after else OUTSIDE, before, after


def _flat(rings: list[list[Point]]) -> list[Segment]:
    return [(*a, *b) for r in rings for a, b in zip(r, r[1:])]  # noqa: B905


def in_rings(rings: list[list[Point]], p: Point) -> int:
    """By the parity of crossings of a ray over all rings."""
    return _sides(_flat(rings), _lifted(p))[0]


def in_areas(s: Shape, p: Point) -> int:
    return min((in_rings(a, p) for a in s.areas), default=OUTSIDE)


def ends(s: Shape) -> set[Point]:
    """The ends of lines that an odd number of lines share."""
    met = Counter(p for x in s.lines if x[0] != x[-1] for p in (x[0], x[-1]))
    return {p for p, n in met.items() if n % 2}


class Laid:
    """A shape's segments, laid out to tell where points and the sides of pieces lie."""

    def __init__(self, s: Shape):
        self.areas, self.lines, self.ends, self.points = [_flat(a) for a in s.areas], _flat(s.lines), ends(s), set(s.points)
        self.turned = [[(ay, ax, by, bx) for ax, ay, bx, by in a] for a in self.areas]

    def _on_line(self, p: Lifted) -> bool:
        return _sides(self.lines, p)[0] == EDGE

    def within(self, p: Point) -> int:
        """Where a point lies by the areas alone."""
        return min((_sides(a, _lifted(p))[0] for a in self.areas), default=OUTSIDE)

    def at(self, p: Point) -> int:
        found = self.within(p)
        if found != INSIDE and self.lines and self._on_line(_lifted(p)):
            found = min(found, EDGE if p in self.ends else INSIDE)
        return INSIDE if found != INSIDE and p in self.points else found

    def beside(self, piece: tuple[Point, Point]) -> tuple[int, bool, bool]:
        """Where a piece lies, and whether the faces to its left and to its right lie in areas.

        No segment crosses or ends at the piece's middle, so those that pass there run along the
        piece, and a ray across it meets them from one side only.
        """
        (ax, ay, m), (bx, by, n) = map(_lifted, piece)
        x, y, w = ax * n + bx * m, ay * n + by * m, 2 * m * n
        rise = by * m - ay * n
        found, before, after = OUTSIDE, False, False
        for a in self.areas if rise else self.turned:
            place, one, two = _sides(a, (x, y, w) if rise else (y, x, w))
            found, before, after = min(found, place), before or one, after or two
        if found != INSIDE and self.lines and self._on_line((x, y, w)):
            found = INSIDE
        return (found, before, after) if rise > 0 else (found, after, before)


# -- pieces of two shapes ----------------------------------------------------------


def _whole(*shapes: Shape) -> tuple[int, list[Shape]]:
    """The shapes with whole numbers as coordinates, and the factor they were multiplied by.

    Fractions with too many different denominators stay fractions, by a factor of one.
    """
    factor = math.lcm(*{v.as_integer_ratio()[1] for s in shapes for p in s.corners() for v in p})
    if factor.bit_length() > 4096:
        return 1, [s.exact() for s in shapes]

    def whole(v: Any) -> int:
        n, d = v.as_integer_ratio()
        return n * (factor // d)

    return factor, [s.mapped(lambda p: (whole(p[0]), whole(p[1]))) for s in shapes]


def _parted(s: Shape, factor: int) -> Shape:
    """The shape that was multiplied."""
    return s.mapped(lambda p: (Fraction(p[0], factor), Fraction(p[1], factor)))


def _ratio(n: Any, d: Any) -> Any:
    q, r = divmod(n, d)
    return Fraction(n, d) if r else q


def pieces(*shapes: Shape) -> set[tuple[Point, Point]]:
    """All segments of the shapes, cut at each other and at all points; the lesser end first."""
    segments = sorted((min(x), max(x)) for s in shapes for x in s.segments())
    spans = [(min(a[1], b[1]), max(a[1], b[1])) for a, b in segments]
    cuts = [set(x) for x in segments]
    for i, (a, b) in enumerate(segments):
        low, high = spans[i]
        for j in range(i + 1, len(segments)):
            c, d = segments[j]
            if c[0] > b[0]:
                break
            if spans[j][0] > high or spans[j][1] < low:
                continue
            one, two, three, four = _cross(c, d, a), _cross(c, d, b), _cross(a, b, c), _cross(a, b, d)
            if (one < 0 < two or two < 0 < one) and (three < 0 < four or four < 0 < three):
                w = one - two
                p = (_ratio(a[0] * w + one * (b[0] - a[0]), w), _ratio(a[1] * w + one * (b[1] - a[1]), w))
                cuts[i].add(p)
                cuts[j].add(p)
                continue
            cuts[i].update(p for p, turn in ((c, three), (d, four)) if turn == 0 and _on(p, a, b))
            cuts[j].update(p for p, turn in ((a, one), (b, two)) if turn == 0 and _on(p, c, d))
    for p in {p for s in shapes for p in s.points}:
        for i, (a, b) in enumerate(segments):
            if a[0] > p[0]:
                break
            if _on(p, a, b):
                cuts[i].add(p)
    out = set()
    for row in map(sorted, cuts):
        out.update(zip(row, row[1:]))  # noqa: B905
    return out


def _middle(a: Point, b: Point) -> Point:
    return ((a[0] + b[0]) * HALF, (a[1] + b[1]) * HALF)


def matrix(a: Shape, b: Shape) -> str:
    """The nine dimensions in which inside, edge and outside of two shapes meet, F for none."""
    _, (a, b) = _whole(a, b)
    every, one, two = pieces(a, b), Laid(a), Laid(b)
    found = [[-1] * 3 for _ in range(3)]
    found[OUTSIDE][OUTSIDE] = 2

    def note(i: int, j: int, dimension: int) -> None:
        found[i][j] = max(found[i][j], dimension)

    for p in {q for piece in every for q in piece} | one.points | two.points:
        note(one.at(p), two.at(p), 0)
    for piece in every:
        (i, *mine), (j, *other) = one.beside(piece), two.beside(piece)
        note(i, j, 1)
        if a.areas or b.areas:
            for m, n in zip(mine, other, strict=True):
                note(INSIDE if m else OUTSIDE, INSIDE if n else OUTSIDE, 2)
    return "".join("F" if d < 0 else str(d) for row in found for d in row)


def fits(found: str, pattern: str) -> bool:
    return all(p == "*" or (p == "T" and f != "F") or p == f for f, p in zip(found, pattern.upper(), strict=True))


#: What the matrix must look like, by relation.
PATTERNS = {
    "disjoint": ("FF*FF****",), "touches": ("FT*******", "F**T*****", "F***T****"), "within": ("T*F**F***",), "contains": ("T*****FF*",),
    "contains_properly": ("T**FF*FF*",), "covers": ("T*****FF*", "*T****FF*", "***T**FF*", "****T*FF*"),
    "covered_by": ("T*F**F***", "*TF**F***", "**FT*F***", "**F*TF***"), "equals": ("T*F**FFF*",),
}


def related(relation: str, a: Shape, b: Shape, found: str = "") -> bool:
    """Whether a relation holds, by the shapes' matrix where it is at hand."""
    if relation.startswith("bbox"):
        if a.dimension < 0 or b.dimension < 0:
            return False
        p, q = box(a), box(b)
        if relation == "bbox_overlaps":
            return p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]
        outer, inner = (p, q) if relation == "bbox_contains" else (q, p)
        return outer[0] <= inner[0] and outer[1] <= inner[1] and inner[2] <= outer[2] and inner[3] <= outer[3]
    found = found or matrix(a, b)
    if relation == "intersects":
        return not fits(found, PATTERNS["disjoint"][0])
    if relation in ("crosses", "overlaps"):
        m, n = a.dimension, b.dimension
        if relation == "overlaps":
            return m == n and fits(found, "1*T***T**" if m == 1 else "T*T***T**")
        return fits(found, "0********") if m == n == 1 else m != n and fits(found, "T*T******" if m < n else "T*****T**")
    return any(fits(found, p) for p in PATTERNS[relation])


RELATIONS = (*PATTERNS, "intersects", "crosses", "overlaps", "bbox_overlaps", "bbox_contains", "bbox_contained")

# -- overlay -----------------------------------------------------------------------

OPERATIONS: dict[str, Callable[[bool, bool], bool]] = {
    "intersection": lambda a, b: a and b, "union": lambda a, b: a or b, "difference": lambda a, b: a and not b, "symmetric_difference": lambda a, b: a != b,
}


def _turned(a: Point, b: Point) -> float:
    x, y = b[0] - a[0], b[1] - a[1]
    far = max(abs(x), abs(y))  # whole numbers may be beyond a double
    return math.atan2(y / far, x / far)


def rings(edges: set[tuple[Point, Point]]) -> list[list[Point]]:
    """Directed edges, the area on their left, as closed rings that turn as far left as they can't cross."""
    out_of: dict[Point, list[Point]] = {}
    for a, b in edges:
        out_of.setdefault(a, []).append(b)
    left, found = set(edges), []
    while left:
        a, b = start = min(left)
        ring = [a]
        while True:
            left.discard((a, b))
            ring.append(b)
            ways = [c for c in out_of.get(b, ()) if (b, c) in left]
            if b == start[0] or not ways:
                break
            back = _turned(b, a)
            a, b = b, ways[0] if len(ways) == 1 else max(ways, key=lambda c: (_turned(b, c) - back) % (2 * math.pi) or 2 * math.pi)  # noqa: B023
        found.append(_straight(ring))
    return [r for r in found if len(r) > 3]


def _straight(ring: list[Point]) -> list[Point]:
    """A closed ring without corners on a straight side."""
    body = ring[:-1] if ring[0] == ring[-1] else ring
    kept = [p for i, p in enumerate(body) if _cross(body[i - 1], p, body[(i + 1) % len(body)]) != 0]
    return [*kept, kept[0]] if kept else []


def signed(ring: list[Point]) -> Any:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) * HALF  # noqa: B905


def assembled(loops: list[list[Point]]) -> list[list[list[Point]]]:
    """Outer rings with the holes that lie in them."""
    outer = sorted((r for r in loops if signed(r) > 0), key=signed)
    areas = [[r] for r in outer]
    for hole in (r for r in loops if signed(r) < 0):
        p = _middle(hole[0], hole[1])
        for area in areas:
            if in_rings([area[0]], p) != OUTSIDE and all(in_rings([area[0]], q) != OUTSIDE for q in hole):
                area.append(hole)
                break
    return areas


def merged(parts: set[tuple[Point, Point]]) -> list[list[Point]]:
    """Pieces joined to lines where just two of them meet."""
    at: dict[Point, list[Point]] = {}
    for a, b in parts:
        at.setdefault(a, []).append(b)
        at.setdefault(b, []).append(a)
    left, lines = set(parts), []

    def follow(a: Point, b: Point) -> list[Point]:
        line = [a, b]
        left.discard((min(a, b), max(a, b)))
        while len(at[b]) == 2:
            c = next((x for x in at[b] if (min(b, x), max(b, x)) in left), None)
            if c is None:
                break
            left.discard((min(b, c), max(b, c)))
            line.append(c)
            b = c
        return line

    for a in sorted(p for p in at if len(at[p]) != 2):
        for b in sorted(at[a]):
            if (min(a, b), max(a, b)) in left:
                lines.append(follow(a, b))
    while left:
        lines.append(follow(*min(left)))
    return [[p for i, p in enumerate(x) if i in (0, len(x) - 1) or _cross(x[i - 1], p, x[i + 1]) != 0] for x in lines]


def overlaid(a: Shape, b: Shape, operation: str) -> Shape:
    srid, keep = a.srid or b.srid, OPERATIONS[operation]
    factor, (a, b) = _whole(a, b)
    every, one, two = pieces(a, b), Laid(a), Laid(b)
    edges, thin, filled = set(), set(), set()
    for piece in every:
        (i, *mine), (j, *other) = one.beside(piece), two.beside(piece)
        left, right = map(keep, mine, other)
        if left != right:
            edges.add(piece if left else piece[::-1])
        if left or right:
            filled.update(piece)
        elif keep(i != OUTSIDE, j != OUTSIDE):
            thin.add(piece)
    met, covered = {q for piece in every for q in piece}, {q for piece in thin for q in piece}

    def bare(p: Point) -> bool:
        """Whether the areas and lines made leave a point out."""
        return p not in covered and p not in filled and (p in met or not keep(one.within(p) == INSIDE, two.within(p) == INSIDE))

    spots = (met if operation == "intersection" else set()) | one.points | two.points
    points = sorted(p for p in spots if bare(p) and keep(one.at(p) != OUTSIDE, two.at(p) != OUTSIDE))
    return _parted(Shape(points, merged(thin), assembled(rings(edges)), srid=srid), factor)


# -- constructions and measures ----------------------------------------------------


def box(s: Shape) -> tuple[Any, Any, Any, Any]:
    xs, ys = zip(*s.corners())  # noqa: B905
    return min(xs), min(ys), max(xs), max(ys)


def envelope(s: Shape) -> Shape:
    if s.dimension < 0:
        return Shape(srid=s.srid)
    x0, y0, x1, y1 = box(s)
    if (x0, y0) == (x1, y1):
        return Shape(points=[(x0, y0)], srid=s.srid)
    if x0 == x1 or y0 == y1:
        return Shape(lines=[[(x0, y0), (x1, y1)]], srid=s.srid)
    return Shape(areas=[[[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]], srid=s.srid)


def convex_hull(s: Shape) -> Shape:
    points = sorted(set(s.exact().corners()))

    def half(row: list[Point]) -> list[Point]:
        out: list[Point] = []
        for p in row:
            while len(out) > 1 and _cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(points) + half(points[::-1])
    if len(points) < 3 or len(ring) < 3:
        return Shape(points=points[:1], srid=s.srid) if len(points) < 2 else Shape(lines=[[points[0], points[-1]]], srid=s.srid)
    return Shape(areas=[[[*ring, ring[0]]]], srid=s.srid)


def area(s: Shape) -> float:
    return float(sum(abs(signed(a[0])) - sum(abs(signed(h)) for h in a[1:]) for a in s.areas))


def _long(x: list[Point]) -> float:
    return sum(math.dist(a, b) for a, b in zip(x, x[1:]))  # noqa: B905


def length(s: Shape) -> float: return sum(map(_long, s.lines), 0.0)
def perimeter(s: Shape) -> float: return sum((_long(r) for a in s.areas for r in a), 0.0)


def centroid(s: Shape) -> Shape:
    """By area, or else by length, or else by number."""
    total = x = y = 0.0
    for a in s.areas:
        for i, r in enumerate(a):
            sign = (1 if signed(r) > 0 else -1) * (-1 if i else 1)
            for p, q in zip(r, r[1:]):  # noqa: B905
                w = sign * (p[0] * q[1] - q[0] * p[1])
                total, x, y = total + w, x + w * (p[0] + q[0]) / 3, y + w * (p[1] + q[1]) / 3
    if not total:
        for p, q in s.segments():
            w = math.dist(p, q)
            total, x, y = total + w, x + w * (p[0] + q[0]) / 2, y + w * (p[1] + q[1]) / 2
    if not total:
        for p in s.corners():
            total, x, y = total + 1, x + p[0], y + p[1]
    return Shape(points=[(x / total, y / total)] if total else [], srid=s.srid)


def boundary(s: Shape) -> Shape:
    return Shape(points=sorted(ends(s)), lines=[r for a in s.areas for r in a], srid=s.srid)


def point_on_surface(s: Shape) -> Shape:
    """A point that surely lies in the shape: the middle of the longest run of a level line
    through an area, the middle corner of a line, or a point."""
    if s.areas:
        e = Shape(areas=[max(s.exact().areas, key=lambda a: abs(signed(a[0])))])
        ys = sorted({p[1] for p in e.corners()})
        y = max(((b - a, (a + b) / 2) for a, b in zip(ys, ys[1:])), default=(0, ys[0]))[1]  # noqa: B905
        xs = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in e.segments() if (a[1] > y) != (b[1] > y))
        runs = [(b - a, (a + b) / 2) for a, b in zip(xs[::2], xs[1::2])]  # noqa: B905
        return Shape(points=[(max(runs)[1], y)], srid=s.srid)
    if s.lines:
        line = max(s.lines, key=len)
        return Shape(points=[line[len(line) // 2] if len(line) > 2 else _middle(*line)], srid=s.srid)
    return Shape(points=s.points[:1], srid=s.srid)


def _apart(p: Point, a: Point, b: Point) -> float:
    n = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / n)) if n else 0.0
    return math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))


def _thinned(x: list[Point], tolerance: float) -> list[Point]:
    """Corners farther than the tolerance from the chord of those kept."""
    keep, todo = {0, len(x) - 1}, [(0, len(x) - 1)]
    while todo:
        s, e = todo.pop()
        far, at = max(((_apart(x[i], x[s], x[e]), i) for i in range(s + 1, e)), default=(0.0, 0))
        if far > tolerance:
            keep.add(at)
            todo += [(s, at), (at, e)]
    return [p for i, p in enumerate(x) if i in keep]


def simplify(s: Shape, tolerance: float) -> Shape:
    areas = [[r for r in (_thinned(r, tolerance) for r in a) if len(r) > 3] for a in s.areas]
    return Shape(s.points, [_thinned(x, tolerance) for x in s.lines], [a for a in areas if a], srid=s.srid)


def make_valid(s: Shape) -> Shape:
    """Areas by the parity of their rings: loops that cross themselves fall apart."""
    factor, (e,) = _whole(s)
    whole = Shape(areas=e.areas)
    laid, edges = Laid(whole), set()
    for piece in pieces(whole):
        _, left, right = laid.beside(piece)
        if left != right:
            edges.add(piece if left else piece[::-1])
    return _parted(Shape(e.points, [x for x in e.lines if len(set(x)) > 1], assembled(rings(edges)), srid=s.srid), factor)


def is_valid(s: Shape) -> bool:
    """Rings that close, don't meet themselves or each other but in points, holes inside."""
    for a in _whole(s)[1][0].areas:
        if any(len(r) < 4 or r[0] != r[-1] or signed(r) == 0 for r in a):
            return False
        whole = Shape(areas=[a])
        met = Counter(tuple(sorted(x)) for x in whole.segments())
        if max(met.values()) > 1 or len(pieces(whole)) != len(met):
            return False
        if any(in_rings([a[0]], p) == OUTSIDE for h in a[1:] for p in h):
            return False
    return all(len(set(x)) > 1 for x in s.lines)


def buffer(s: Shape, distance: float, quarter: int = 8) -> Shape:
    """All that lies within a distance, round corners as ``quarter`` sides each quarter turn;
    a negative distance takes as much from areas."""
    d = abs(distance)
    circle = [(d * math.cos(math.pi * k / (2 * quarter)), d * math.sin(math.pi * k / (2 * quarter))) for k in range(4 * quarter)]
    spots = [[(p, p)] for p in s.points] + [list(zip(x, x[1:])) for x in s.chains()]  # noqa: B905
    out = Shape(areas=s.areas, srid=s.srid)
    if d == 0 or (distance < 0 and not s.areas):
        return out
    for a, b in (x for row in spots for x in row):
        hull = convex_hull(Shape(points=[(q[0] + c[0], q[1] + c[1]) for q in (a, b) for c in circle]))
        out = overlaid(out, hull, "union" if distance > 0 else "difference").mapped(lambda p: (float(p[0]), float(p[1])))
    return Shape(areas=out.areas, srid=s.srid)


def distance(a: Shape, b: Shape) -> float:
    if a.dimension < 0 or b.dimension < 0:
        return math.nan
    if related("intersects", a, b):
        return 0.0
    one, two = a.segments() + [(p, p) for p in a.points], b.segments() + [(p, p) for p in b.points]
    return min(min(_apart(p, *y), _apart(q, *y), _apart(y[0], p, q), _apart(y[1], p, q)) for p, q in one for y in two)


#: The radius of the sphere of the web's projection.
RADIUS = 6378137.0


def transform(s: Shape, srid: int) -> Shape:
    """Between degrees (4326) and the web's projection (3857)."""
    if s.srid == srid:
        return s
    if (s.srid, srid) == (4326, 3857):
        out = s.mapped(lambda p: (RADIUS * math.radians(p[0]), RADIUS * math.log(math.tan(math.pi / 4 + math.radians(p[1]) / 2))))
    elif (s.srid, srid) == (3857, 4326):
        out = s.mapped(lambda p: (math.degrees(p[0] / RADIUS), math.degrees(2 * math.atan(math.exp(p[1] / RADIUS)) - math.pi / 2)))
    else:
        raise ValueError(f"no way from {s.srid} to {srid}")
    out.srid = srid
    return out


# -- functions of columns ----------------------------------------------------------


#: Matrices by the two texts, and how much they hold; forgotten beyond 16 MB.
_matrices: dict[tuple[Any, Any], str] = {}
_held = [0]


def matrix_of(x: Any, y: Any) -> str:
    """The matrix of two texts, kept as several relations of a row ask for it."""
    found = _matrices.get((x, y))
    if found is None:
        found = matrix(read(x), read(y))
        _held[0] += len(x) + len(y) + 256
        if _held[0] > 1 << 24:
            _matrices.clear()
            _held[0] = len(x) + len(y) + 256
        _matrices[x, y] = found
    return found


def related_texts(relation: str, x: Any, y: Any) -> bool:
    """One of RELATIONS, or nine letters that the matrix must fit."""
    if relation not in RELATIONS:
        return fits(matrix_of(x, y), relation)
    return related(relation, read(x), read(y), "" if relation.startswith("bbox") else matrix_of(x, y))


def _each(f: Callable[..., Any], *columns: pd.Series) -> pd.Series:
    """A function of the rows' texts, null where one is; a row met again in the batch is not worked out again."""
    kept: dict[tuple[Any, ...], Any] = {}
    out = []
    for row in zip(*columns, strict=True):
        if row not in kept:
            kept[row] = None if any(v is None for v in row) else f(*row)
        out.append(kept[row])
    return pd.Series(out, dtype=object)


def condition(f: Callable[[Any, Any], bool]) -> Callable[[Column, Any], Column]:
    """A lookup that compares a column of geometries with one geometry or another column, as texts."""
    def run(a: pd.Series, b: pd.Series) -> pd.Series: return _each(f, a, b)

    udf = S.pandas_udf(run, "boolean")
    return lambda c, v: udf(c, v if isinstance(v, Column) else S.lit(v))


def _related(relation: str) -> Callable[[Any, Any], bool]: return lambda x, y: related_texts(relation, x, y)
def _relate(c: Column, v: tuple[Any, str]) -> Column: return condition(lambda x, y: fits(matrix_of(x, y), v[1]))(c, v[0])
def _dwithin(c: Column, v: tuple[Any, float]) -> Column: return condition(lambda x, y: distance(read(x), read(y)) <= v[1])(c, v[0])


def lookups() -> dict[str, Callable[[Column, Any], Column]]:
    """By suffix; ``contains`` is that of texts, so a geometry's is ``geo_contains``."""
    names = {("geo_contains" if r == "contains" else r): r for r in RELATIONS}
    return {name: (lambda r: lambda c, v: condition(_related(r))(c, v))(r) for name, r in names.items()} | {"relate": _relate, "dwithin": _dwithin}


def _column(name: str, kind: str, f: Callable[..., Any], *xs: Any, texts: bool = False) -> Expression:
    """A function of shapes, or of their texts."""
    def run(*columns: pd.Series) -> pd.Series:
        return _each(f if texts else lambda *row: f(*map(read, row)), *columns)

    hints = [pd.Series] * len(xs)
    if len(hints) == 1:
        def call(a: pd.Series) -> pd.Series: return run(a)
    else:
        def call(a: pd.Series, b: pd.Series) -> pd.Series: return run(a, b)
    call.__name__ = name
    return PandasFunction(call, kind)(wrap(xs[0]), *map(literal, xs[1:]))


def _made(name: str, f: Callable[..., Shape], *xs: Any) -> Expression:
    return _column(name, "string", lambda *s: write(f(*s)), *xs)


def ConvexHull(x: Any) -> Expression: return _made("convex_hull", convex_hull, x)
def Boundary(x: Any) -> Expression: return _made("boundary", boundary, x)
def PointOnSurface(x: Any) -> Expression: return _made("point_on_surface", point_on_surface, x)
def CenterOfMass(x: Any) -> Expression: return _made("center_of_mass", centroid, x)
def Box(x: Any) -> Expression: return _made("box", envelope, x)
def MakeValid(x: Any) -> Expression: return _made("make_valid", make_valid, x)
def Buffer(x: Any, by: float, quarter: int = 8) -> Expression: return _made("buffer", lambda s: buffer(s, by, quarter), x)
def Simplify(x: Any, tolerance: float) -> Expression: return _made("simplify", lambda s: simplify(s, tolerance), x)
def Transform(x: Any, srid: int) -> Expression: return _made("transform", lambda s: transform(s, srid), x)
def Intersection(x: Any, y: Any) -> Expression: return _made("intersection", lambda a, b: overlaid(a, b, "intersection"), x, y)
def Difference(x: Any, y: Any) -> Expression: return _made("difference", lambda a, b: overlaid(a, b, "difference"), x, y)
def SymmetricDifference(x: Any, y: Any) -> Expression: return _made("symmetric_difference", lambda a, b: overlaid(a, b, "symmetric_difference"), x, y)
def Union(x: Any, y: Any) -> Expression: return _made("union", lambda a, b: overlaid(a, b, "union"), x, y)
def AsText(x: Any) -> Expression: return _made("as_text", lambda s: Shape(s.points, s.lines, s.areas, s.kind), x)
def AsJson(x: Any) -> Expression: return _column("as_json", "string", to_geojson, x)
def NumGeometries(x: Any) -> Expression: return _column("num_geometries", "bigint", lambda s: len(s.points) + len(s.lines) + len(s.areas), x)
def AreaOf(x: Any) -> Expression: return _column("area_of", "double", area, x)
def LengthOf(x: Any) -> Expression: return _column("length_of", "double", length, x)
def PerimeterOf(x: Any) -> Expression: return _column("perimeter_of", "double", perimeter, x)
def DistanceOf(x: Any, y: Any) -> Expression: return _column("distance_of", "double", distance, x, y)
def Valid(x: Any) -> Expression: return _column("valid", "boolean", is_valid, x)
def Matrix(x: Any, y: Any) -> Expression: return _column("matrix", "string", matrix_of, x, y, texts=True)
def Related(relation: str, x: Any, y: Any) -> Expression:
    """One of RELATIONS, or nine letters that the matrix must fit."""
    if relation not in RELATIONS and not re.fullmatch(r"[TF012*]{9}", relation.upper()):
        raise ValueError(f"unknown relation {relation!r}")
    return _column("related", "boolean", _related(relation), x, y, texts=True)
