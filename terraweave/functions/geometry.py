"""Geometry of well-known text as Columns.

A parsed geometry is ``struct<kind, parts array<array<array<struct<x, y>>>>, members array<struct<kind, n>>, highest, top array<boolean>>``: its parts
(polygons, lines or points), their rings and the rings' points. Of a GEOMETRYCOLLECTION ``members`` tells the kind of each member and the number of its
parts, ``highest`` the kind of the highest dimension and ``top`` the parts that have it; elsewhere they are null, and the kind itself. Collections
within collections are laid flat. All functions are native expressions.
"""

from __future__ import annotations

import json
import re
from functools import reduce, wraps
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def let(value: Column, use) -> Column:
    """``use(value)``, which may name the value many times, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _once(f):
    """The function with its first argument bound once, so that nested calls stay small."""

    @wraps(f)
    def bound(g: Column, *rest) -> Column:
        return let(g, lambda v: f(v, *rest)).alias(f.__name__)  # a name of its own: Spark cannot make one from such an expression

    return bound


def kind(wkt: Column) -> Column:
    return F.trim(F.regexp_extract(wkt, r"^([^(]*)", 1))


def point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def _points(ring: Column) -> Column:
    pairs = F.transform(F.split(F.trim(F.regexp_replace(ring, r"[()]", "")), r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    return F.transform(pairs, lambda p: F.struct(p[0].cast("double").alias("x"), F.get(p, F.lit(1)).cast("double").alias("y")))


#: Fixed by the struct: what only collections have.
_MEMBERS, _TOP = "array<struct<kind:string,n:int>>", "array<boolean>"


def _plain(kind: Column, parts: Column) -> Column:
    return F.struct(kind.alias("kind"), parts.alias("parts"), F.lit(None).cast(_MEMBERS).alias("members"), kind.alias("highest"), F.lit(None).cast(_TOP).alias("top"))


@_once
def parse(wkt: Column) -> Column:
    """Members of a collection begin with a letter; inner collections lose their names, and the brackets left over are passed over."""
    collection = F.rlike(wkt, F.lit(r"(?i)^\s*GEOMETRYCOLLECTION"))
    texts = F.when(collection, F.split(F.regexp_replace(wkt, r"(?i)GEOMETRYCOLLECTION\s*\(", ""), r",\s*(?=[A-Za-z])")).otherwise(F.array(wkt))

    def member(t: Column) -> Column:
        both = F.struct(F.upper(kind(t)).alias("name"), F.regexp_replace(F.regexp_extract(t, r"(?s)^[^(]*\((.*)\)\s*$", 1), r"\s+", " ").alias("body"))
        return let(both, lambda b: F.struct(b["name"].alias("kind"), _parts(b["name"], b["body"]).alias("parts")))

    def laid(ms: Column) -> Column:
        rank = lambda m: F.when(is_areal(m), 2).when(is_linear(m), 1).otherwise(0)
        most = F.array_max(F.transform(ms, rank))
        many = F.struct(
            F.lit("GEOMETRYCOLLECTION").alias("kind"),
            F.flatten(F.transform(ms, lambda m: m["parts"])).alias("parts"),
            F.transform(ms, lambda m: F.struct(m["kind"].alias("kind"), F.size(m["parts"]).alias("n"))).alias("members"),
            F.element_at(F.array(F.lit("MULTIPOINT"), F.lit("MULTILINESTRING"), F.lit("MULTIPOLYGON")), most + 1).alias("highest"),
            F.flatten(F.transform(ms, lambda m: F.array_repeat(rank(m) == most, F.size(m["parts"])))).alias("top"),
        )
        return F.when(F.size(ms) == 0, None).when(collection, many).otherwise(_plain(ms[0]["kind"], ms[0]["parts"]))

    return let(F.filter(F.transform(texts, member), lambda m: m["parts"].isNotNull()), laid)


def _parts(name: Column, body: Column) -> Column:
    rings = lambda text: F.transform(F.split(text, r"\)\s*,\s*\("), _points)
    members = lambda text: F.split(text, r"\)\s*\)\s*,\s*\(\s*\(")
    return (
        F.when(name.isin("POINT", "LINESTRING", "LINEARRING"), F.array(F.array(_points(body))))
        .when(name == "MULTIPOINT", F.transform(_points(body), lambda p: F.array(F.array(p))))
        .when(name == "MULTILINESTRING", F.transform(F.split(body, r"\)\s*,\s*\("), lambda r: F.array(_points(r))))
        .when(name == "POLYGON", F.array(rings(body)))
        .when(name == "MULTIPOLYGON", F.transform(members(body), rings))
    )


def is_collection(g: Column) -> Column:
    return g["members"].isNotNull()


def each(g: Column) -> Column:
    """The members of a collection as geometries; any other geometry alone."""
    before = lambda i: F.aggregate(F.slice(g["members"], F.lit(1), i), F.lit(0), lambda s, m: s + m["n"])
    return F.when(is_collection(g), F.transform(g["members"], lambda m, i: _plain(m["kind"], F.slice(g["parts"], before(i) + 1, m["n"])))).otherwise(F.array(g))


def _high(g: Column) -> Column:
    """The parts, of a collection those of the highest dimension."""
    return F.when(g["top"].isNull(), g["parts"]).otherwise(F.filter(g["parts"], lambda _, i: F.get(g["top"], i)))


def _over_edges(ring: Column, value, start: Column | None = None) -> Column:
    """The sum of ``value(a, b)`` over neighbouring points of a ring."""
    edges = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: value(a, b))
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + e)


def _sum(items: Column, value) -> Column:
    return F.aggregate(F.transform(items, value), F.lit(0.0), lambda s, e: s + e)


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def _signed(ring: Column) -> Column:
    return _over_edges(ring, _cross) / 2


def _is_areal(kind: Column) -> Column:
    return kind.endswith("POLYGON")


def _is_linear(kind: Column) -> Column:
    return kind.isin("LINESTRING", "LINEARRING", "MULTILINESTRING")


def is_areal(g: Column) -> Column:
    return _is_areal(g["kind"])


def is_linear(g: Column) -> Column:
    return _is_linear(g["kind"])


@_once
def area(g: Column) -> Column:
    """Planar area, holes taken off; zero for points and lines."""
    of = lambda rings: _sum(F.transform(rings, lambda r, i: F.when(i == 0, F.abs(_signed(r))).otherwise(-F.abs(_signed(r)))), lambda v: v)
    return F.when(_is_areal(g["highest"]), _sum(_high(g), of)).otherwise(F.lit(0.0))


@_once
def length(g: Column) -> Column:
    """Planar length or perimeter, holes included."""
    step = lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
    return F.when(g.isNotNull(), _sum(F.flatten(g["parts"]), lambda r: _over_edges(r, step)))


@_once
def centroid(g: Column) -> Column:
    """Of the highest dimension present: weighted by area, by length, or the mean of points."""
    parts = _high(g)
    rings, points = F.flatten(parts), F.flatten(F.flatten(parts))
    step = lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))

    def along(axis: str, total: Column) -> Column:
        return _sum(rings, lambda r: _over_edges(r, lambda a, b: (a[axis] + b[axis]) / 2 * step(a, b))) / total

    def within(axis: str, total: Column) -> Column:
        sign = lambda r, i: F.when(i == 0, F.signum(_signed(r))).otherwise(-F.signum(_signed(r)))
        moment = lambda rs: _sum(F.transform(rs, lambda r, i: sign(r, i) * _over_edges(r, lambda a, b: (a[axis] + b[axis]) * _cross(a, b)) / 6), lambda v: v)
        return _sum(parts, moment) / total

    pair = lambda f, *v: F.struct(f("x", *v).alias("x"), f("y", *v).alias("y"))
    mean = pair(lambda axis: _sum(points, lambda p: p[axis]) / F.size(points))
    return (
        F.when(g["kind"] == "POINT", points[0])
        .when(_is_areal(g["highest"]), let(area(g), lambda t: F.when(t > 0, pair(within, t)).otherwise(mean)))
        .when(_is_linear(g["highest"]), let(_sum(rings, lambda r: _over_edges(r, step)), lambda t: F.when(t > 0, pair(along, t)).otherwise(mean)))
        .when(g.isNotNull(), mean)
    )


@_once
def bounds(g: Column) -> Column:
    points = F.flatten(F.flatten(g["parts"]))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def translate(g: Column, dx: Column, dy: Column) -> Column:
    move = lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))
    return moved(g, move)


@_once
def moved(g: Column, to) -> Column:
    """``g`` with ``to`` applied to every point."""
    parts = F.transform(g["parts"], lambda rs: F.transform(rs, lambda r: F.transform(r, to)))
    return F.when(g.isNotNull(), F.struct(g["kind"].alias("kind"), parts.alias("parts"), *[g[c].alias(c) for c in ("members", "highest", "top")]))


@_once
def to_wkt(g: Column) -> Column:
    return let(F.transform(each(g), _to_wkt), lambda t: F.when(is_collection(g), F.concat(F.lit("GEOMETRYCOLLECTION ("), F.array_join(t, ", "), F.lit(")"))).otherwise(t[0]))


def _to_wkt(g: Column) -> Column:
    pair = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, pair), ", "), F.lit(")"))
    rings = lambda rs: F.concat(F.lit("("), F.array_join(F.transform(rs, ring), ", "), F.lit(")"))
    flat = g["kind"].isin("POINT", "LINESTRING", "LINEARRING")
    body = (
        F.when(flat, ring(g["parts"][0][0]))
        .when(g["kind"] == "POLYGON", rings(g["parts"][0]))
        .when(g["kind"] == "MULTIPOLYGON", F.concat(F.lit("("), F.array_join(F.transform(g["parts"], rings), ", "), F.lit(")")))
        .otherwise(F.concat(F.lit("("), F.array_join(F.transform(g["parts"], lambda rs: ring(rs[0])), ", "), F.lit(")")))
    )
    return F.concat(g["kind"], F.lit(" "), body)


def parse_literal(wkt: str) -> list[list[list[tuple[float, float]]]]:
    """Members, rings and points of a polygon or multipolygon, on the driver."""
    name, body = re.match(r"\s*(\w+)\s*(\(.*\))\s*$", wkt, re.S).groups()
    if name.upper() not in ("POLYGON", "MULTIPOLYGON"):
        raise ValueError(f"an extent is a polygon: {wkt[:40]}")
    if name.upper() == "POLYGON":
        body = f"({body})"
    nested = re.sub(r"([-+.\deE]+)\s+([-+.\deE]+)", r"[\1,\2]", body).replace("(", "[").replace(")", "]")
    return [[[tuple(p) for p in ring] for ring in member] for member in json.loads(nested)]


def _inside(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting over the literal edges of a ring."""
    hits = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if y1 != y2:
            spans = (F.lit(y1) > y) != (F.lit(y2) > y)
            hits = hits + F.when(spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return hits % 2 == 1


def contains_point(extent: str, x: Column, y: Column) -> Column:
    """Whether the literal polygon holds a point: a box on the coordinates, which a scan can be asked
    for, then the exact test. An axis-aligned box needs the first only."""
    found = F.lit(False)
    for member in parse_literal(extent):
        xs, ys = [p[0] for p in member[0]], [p[1] for p in member[0]]
        box = (x > min(xs)) & (x < max(xs)) & (y > min(ys)) & (y < max(ys))
        is_box = len(member) == 1 and len(member[0]) == 5 and all(px in (min(xs), max(xs)) and py in (min(ys), max(ys)) for px, py in member[0])
        if not is_box:
            box = box & _inside(x, y, member[0])
            for hole in member[1:]:
                box = box & ~_inside(x, y, hole)
        found = found | box
    return found


def _edges(ring: list[tuple[float, float]]) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    return [(a, b) for a, b in zip(ring, ring[1:]) if a != b]


def _convex(ring: list[tuple[float, float]]) -> bool:
    turns = [(b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0]) for (a, b), (c, d) in zip(_edges(ring), _edges(ring)[1:] + _edges(ring)[:1])]
    return all(t >= 0 for t in turns) or all(t <= 0 for t in turns)


def _turn(a: Column, b: Column, p: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def _any_edge(g: Column, test) -> Column:
    """Whether ``test(a, b)`` holds for an edge of the geometry."""
    pairs = lambda r: F.zip_with(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.exists(F.flatten(g["parts"]), lambda r: F.exists(pairs(r), lambda e: test(e["a"], e["b"])))


def _crosses(g: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Whether an edge of the geometry crosses one of the literal lines in the inside of both."""
    xy = lambda p: F.struct(F.lit(float(p[0])).alias("x"), F.lit(float(p[1])).alias("y"))
    lines = [F.struct(xy(a).alias("a"), xy(b).alias("b")) for r in rings for a, b in _edges(r)]
    if not lines:
        return F.lit(False)
    apart = lambda a, b, p, q: _turn(a, b, p) * _turn(a, b, q) < 0
    return _any_edge(g, lambda a, b: F.exists(F.array(*lines), lambda s: apart(a, b, s["a"], s["b"]) & apart(s["a"], s["b"], a, b)))


def holds_point(g: Column, x: float, y: float) -> Column:
    """Whether the polygons of a geometry hold a literal point: ray casting over all their rings."""
    px, py = F.lit(float(x)), F.lit(float(y))
    hit = lambda a, b: F.when(((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1.0).otherwise(0.0)
    odd = lambda part: _sum(part, lambda r: _over_edges(r, hit)) % 2 == 1
    return _is_areal(g["highest"]) & F.exists(_high(g), odd)


def contains(extent: str, g: Column) -> Column:
    """Whether the literal polygon holds a geometry: all its points, and but for convex extents none of its edges leaves through the outline
    or a hole, nor does it go around a hole."""
    points = F.flatten(F.flatten(g["parts"]))
    found = g.isNotNull() & F.forall(points, lambda p: contains_point(extent, p["x"], p["y"]))
    members = parse_literal(extent)
    if len(members) == 1 and len(members[0]) == 1 and _convex(members[0][0]):
        return found.alias("contains")
    found = found & ~_crosses(g, [r for m in members for r in m])
    for hole in (h for m in members for h in m[1:]):
        found = found & ~reduce(or_, [holds_point(g, x, y) for x, y in hole[:-1]])
    return found.alias("contains")


def literal_parts(wkt: str) -> tuple[str, list[list[list[tuple[float, float]]]]]:
    """Kind, and parts as in ``parse_literal``, of any literal but a collection."""
    name, _, body = wkt.strip().partition("(")
    kind, body = name.strip().upper(), f"({body}"
    if kind.endswith("POLYGON"):
        return kind, parse_literal(wkt)
    lines = [[tuple(map(float, p.strip("() ").split()[:2])) for p in part.split(",")] for part in re.split(r"\)\s*,\s*\(", body)]
    return kind, [[line] for line in lines]


def intersects(g: Column, wkt: str) -> Column:
    """Whether a geometry shares a point with the literal one."""
    kind, parts = literal_parts(wkt)
    points = F.flatten(F.flatten(g["parts"]))
    corners = [p for part in parts for p in part[0]]
    found = reduce(or_, [holds_point(g, x, y) for x, y in corners]) | (distance(g, corners) == 0)
    if not kind.endswith("POINT"):
        found = found | _crosses(g, [r for part in parts for r in part])
    if kind.endswith("POLYGON"):
        found = found | F.exists(points, lambda p: contains_point(wkt, p["x"], p["y"]))
    return g.isNotNull() & found


def distance(g: Column, points: list[tuple[float, float]]) -> Column:
    """The least planar distance of a geometry to literal points; zero inside a polygon."""

    def to_edge(a: Column, b: Column, x: float, y: float) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / square))).otherwise(F.lit(0.0))
        ex, ey = a["x"] + t * dx - x, a["y"] + t * dy - y
        return F.sqrt(ex * ex + ey * ey)

    def of(x: float, y: float) -> Column:
        alone = F.array_min(F.transform(F.flatten(F.flatten(g["parts"])), lambda p: F.sqrt((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y))))
        n = lambda r: F.greatest(F.size(r) - 1, F.lit(0))
        edges = F.flatten(F.transform(F.flatten(g["parts"]), lambda r: F.zip_with(F.slice(r, F.lit(1), n(r)), F.slice(r, F.lit(2), n(r)), lambda a, b: to_edge(a, b, x, y))))
        along = F.when(~g["highest"].isin("POINT", "MULTIPOINT"), F.array_min(edges))
        return F.when(holds_point(g, x, y), F.lit(0.0)).otherwise(F.least(alone, along))

    return reduce(F.least, [of(float(x), float(y)) for x, y in points])


def geohash(lon: Column, lat: Column, precision: int = 8) -> Column:
    """Cells are found by arithmetic: the bits of both axes, interleaved, five a character."""
    precision = precision if 1 <= precision <= 12 else 8
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    cell = lambda v, low, span, n: F.least(F.floor((v - low) / span * float(1 << n)).cast("long"), F.lit((1 << n) - 1))
    x, y = cell(lon, -180.0, 360.0, n_lon), cell(lat, -90.0, 180.0, n_lat)
    out = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for b in range(5 * c, 5 * c + 5):
            axis, left = (x, n_lon - 1 - b // 2) if b % 2 == 0 else (y, n_lat - 1 - b // 2)
            value = value * 2 + F.shiftright(axis, left) % 2
        out.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.concat(*out))
