"""Features from JSON, GeoJSON, GPX and other XML."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraweave.functions import geometry
from terraweave.sources import parts

FEATURES = "fid string, wkt string, attrs map<string,string>"


def flatten(value: dict, prefix: str = "") -> dict[str, str]:
    """Nested names joined by dots; objects in arrays get their place: ``key.0.child``. Plain values in arrays
    yield no fields."""
    out: dict[str, str] = {}
    for k, v in value.items():
        name = f"{prefix}{k}"
        if isinstance(v, dict):
            out |= flatten(v, f"{name}.")
        elif isinstance(v, list):
            for i, e in enumerate(v):
                if isinstance(e, dict):
                    out |= flatten(e, f"{k}.{i}.")
        elif v is not None:
            out[name] = str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else json.dumps(v)
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def flattened(text: pd.Series) -> pd.Series:
    """Any JSON object to a map of its leaves."""

    def one(t: str | None) -> dict[str, str] | None:
        try:
            value = json.loads(t) if t is not None else None
        except ValueError:
            return None
        return flatten(value) if isinstance(value, dict) else None

    return text.map(one)


def row_id(path: str | list[str], file: Column, number: Column) -> Column:
    """A record's number; with the name of its file in front where several files, or a folder or pattern of them, are read."""
    one = isinstance(path, str) or len(path) == 1
    name = path if isinstance(path, str) else path[0]
    plain = F.lit(one and "*" not in name) & file.endswith(name.rstrip("/").rpartition("/")[2])
    return F.when(plain, number.cast("string")).otherwise(F.concat(F.regexp_extract(file, r"([^/]+)$", 1), F.lit("#"), number.cast("string")))


def json_file(spark: SparkSession, path: str | list[str], x: str | None = None, y: str | None = None) -> DataFrame:
    """Records are the objects among the children of each file's root, or the elements of its arrays; a root that has none is one itself."""

    def records(file: BinaryIO) -> Iterator[tuple[int, str]]:
        n, plain = 0, {}
        for key, _, value, _ in parts.json_items(file):
            for e in value if isinstance(value, list) else [value]:
                if isinstance(e, dict):
                    yield n, json.dumps(e)
                    n += 1
            if not n and key is not None:
                plain.setdefault(key, value)
        if not n and plain:
            yield 0, json.dumps(plain)

    rows = parts.split(spark, path, records, "n long, record string").withColumn("attrs", flattened("record"))
    wkt = F.lit(None).cast("string")
    if x and y:
        a, b = F.try_element_at("attrs", F.lit(x)), F.try_element_at("attrs", F.lit(y))
        wkt = F.when(a.isNotNull() & b.isNotNull(), geometry.point(a, b))
    return rows.filter(F.size("attrs") > 0).select(row_id(path, F.col("file"), F.col("n")).alias("fid"), wkt.alias("wkt"), "attrs")


def lines(df: DataFrame, column: str) -> DataFrame:
    """``attrs`` from a column with one JSON object a row: one level natively where it has scalars only."""
    return df.withColumn("attrs", F.from_json(column, "map<string,string>"))


def _plain_wkt(g: Column) -> Column:
    c = F.regexp_replace(g["coordinates"], r"\s+", "")
    pairs = F.regexp_replace(c, r"\[(-?[\d.eE+-]+),(-?[\d.eE+-]+)(?:,-?[\d.eE+-]+)?\]", "$1 $2")
    body = F.regexp_replace(F.replace(F.replace(pairs, F.lit("["), F.lit("(")), F.lit("]"), F.lit(")")), ",", ", ")
    kind = F.upper(g["type"])
    return F.when(kind == "POINT", F.concat(F.lit("POINT ("), body, F.lit(")"))).otherwise(F.concat(kind, F.lit(" "), body))


def geojson_wkt(g: Column, members: Column | None = None) -> Column:
    """From ``struct<type, coordinates string>``, the coordinates as JSON text; ``members`` are the same of a collection."""
    if members is None:
        return _plain_wkt(g)
    many = F.concat(F.lit("GEOMETRYCOLLECTION ("), F.array_join(F.transform(members, _plain_wkt), ", "), F.lit(")"))
    return F.when(g["type"] == "GeometryCollection", many).otherwise(_plain_wkt(g))


def geojson(spark: SparkSession, path: str | list[str]) -> DataFrame:
    own = "type: string, coordinates: string"
    schema = f"id string, properties string, geometry struct<{own}, geometries: array<struct<{own}>>>"

    def features(file: BinaryIO) -> Iterator[tuple[str]]:
        for key, listed, value, text in parts.json_items(file):
            if key == "features" and listed:
                yield (text,)
            elif key is None and isinstance(value, dict) and isinstance(value.get("features"), list):
                yield from ((json.dumps(e),) for e in value["features"])

    df = parts.split(spark, path, features, "feature string").select(F.from_json("feature", schema).alias("f")).filter("f is not null").select("f.*")
    return df.select(F.col("id").alias("fid"), geojson_wkt(F.col("geometry"), F.col("geometry.geometries")).alias("wkt"), flattened("properties").alias("attrs"))


def _xml(spark: SparkSession, path: str | list[str], tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


_POINT = "_lat: string, _lon: string"


_TRACK = ["name", "cmt", "desc", "src", "number", "type"]
_WAYPOINT = ["ele", "time", "magvar", "geoidheight", "name", "cmt", "desc", "src", "sym", "type", "fix", "sat", "hdop", "vdop", "pdop", "ageofdgpsdata", "dgpsid"]


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def extension_values(texts: pd.Series) -> pd.Series:
    """Children of each extension by their local name, with all the text below them. The texts are inner XML, whose
    prefixes are bound elsewhere and so cut."""

    def one(t: str | None) -> dict[str, str]:
        try:
            root = ET.fromstring("<x>" + re.sub(r"(</?)[\w.-]+:", r"\1", re.sub(r"\s[\w.-]+:[\w.-]+=", " a=", t or "")) + "</x>")
        except ET.ParseError:
            return {}
        return {c.tag: "".join(c.itertext()).strip() for e in root for c in e}

    return texts.map(one)


def gpx(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tracks and waypoints, with the fields of their extensions; routes are passed over."""

    def features(tag: str, schema: str, fields: list[str], kind: str, wkt) -> DataFrame:
        df = _xml(spark, path, tag, ", ".join(f"`{f}` string" for f in fields) + f", extensions string, {schema}")
        own = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.trim(f) for f in fields])), lambda _, v: v.isNotNull())
        more = F.map_filter(extension_values("extensions"), lambda k, _: ~k.isin(fields))
        out = df.select(F.concat(F.lit(f"{kind}/"), F.coalesce("name", F.lit(""))).alias("fid"), wkt().alias("wkt"), F.map_concat(own, more).alias("attrs"))
        return out.filter(F.size("attrs") > 0)

    def line() -> Column:
        points = lambda s: F.array_join(F.transform(s["trkpt"], lambda p: F.concat_ws(" ", p["_lon"], p["_lat"])), ", ")
        segs = F.transform("trkseg", lambda s: F.concat(F.lit("("), points(s), F.lit(")")))
        return F.when(F.size("trkseg") == 1, F.concat(F.lit("LINESTRING "), segs[0])).otherwise(F.concat(F.lit("MULTILINESTRING ("), F.array_join(segs, ", "), F.lit(")")))

    points = features("wpt", "_lat string, _lon string", _WAYPOINT, "wpt", lambda: geometry.point(F.col("_lon"), F.col("_lat")))
    return features("trk", f"trkseg array<struct<trkpt: array<struct<{_POINT}>>>>", _TRACK, "trk", line).unionByName(points)


def osm_xml(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes``, ``ways`` and ``relations``. For each of them one task cuts a file into its elements as a stream, and all tasks read these."""
    kinds = ("node", "way", "relation")
    text = lambda v: v.strip() if v is not None else None

    def of(kind: str, columns: str, values: Callable[[ET.Element], tuple]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for xml in pdf["xml"]:
                    e = ET.fromstring(xml)[0]
                    tags = {text(t.get("k")): text(t.get("v")) for t in e.iter("tag") if t.get("k") is not None}
                    rows.append((text(e.get("id")), *values(e), tags))
                yield pd.DataFrame(rows, columns=names)

        schema = f"id string, {columns}, tags map<string,string>"
        names = ["id", *(c.split()[0] for c in re.split(r", (?=\w+ )", columns)), "tags"]
        return parts.split(spark, path, lambda f: parts.xml_elements(f, lambda local, above, depth: local in kinds, only=kind), "n long, xml string").mapInPandas(run, schema)

    member = lambda m: {k: text(m.get(k)) for k in ("ref", "type", "role")}
    nodes = of("node", "lon string, lat string", lambda e: (text(e.get("lon")), text(e.get("lat"))))
    ways = of("way", "refs array<string>", lambda e: ([text(c.get("ref")) for c in e.iter("nd")] or None,))
    return nodes, ways, of("relation", "members array<struct<ref:string,type:string,role:string>>", lambda e: ([member(m) for m in e.iter("member")] or None,))


# GML and KML geometries, element by element.


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _numbers(text: str | None) -> list[str]:
    return (text or "").replace(",", " ").split()


def _coords(e: ET.Element) -> list[str]:
    """``x y`` pairs below an element, from coordinates, pos, posList or lists of corners."""
    out: list[str] = []
    for c in e.iter():
        name = _local(c)
        if name == "coordinates":
            out += [" ".join(t.split(",")[:2]) for t in (c.text or "").split()]
        elif name in ("pos", "lowerCorner", "upperCorner"):
            out.append(" ".join(_numbers(c.text)[:2]))
        elif name == "posList":
            size = int(c.get("srsDimension") or 2)
            n = _numbers(c.text)
            out += [" ".join(n[i : i + 2]) for i in range(0, len(n) - size + 1, size)]
        elif name == "coord":
            by_name = {_local(v): (v.text or "").strip() for v in c}
            out.append(f"{by_name.get('X', '')} {by_name.get('Y', '')}")
    return out


def _ring(e: ET.Element) -> str:
    return "(" + ", ".join(_coords(e)) + ")"


def _rings(e: ET.Element) -> str:
    found = [c for c in e.iter() if _local(c) == "LinearRing"]
    return "(" + ", ".join(map(_ring, found)) + ")"


def xml_wkt(e: ET.Element) -> str | None:
    """WKT of a GML (2 or 3) or KML geometry element."""
    name = _local(e)
    if name in ("Envelope", "Box"):
        c = _coords(e)
        (x0, y0), (x1, y1) = c[0].split(), c[-1].split()
        return f"POLYGON (({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"
    if name == "Point":
        return f"POINT ({_coords(e)[0]})"
    if name in ("LineString", "LinearRing", "Curve"):
        return f"LINESTRING {_ring(e)}"
    if name in ("Polygon", "Surface"):
        return f"POLYGON {_rings(e)}"
    parts = {k: [c for c in e.iter() if _local(c) == k] for k in ("Point", "LineString", "Curve", "Polygon", "PolygonPatch", "Surface")}
    if name == "MultiPoint":
        return "MULTIPOINT (" + ", ".join(f"({_coords(p)[0]})" for p in parts["Point"]) + ")"
    if name in ("MultiLineString", "MultiCurve"):
        return "MULTILINESTRING (" + ", ".join(map(_ring, parts["LineString"] or parts["Curve"])) + ")"
    if name in ("MultiPolygon", "MultiSurface"):
        return "MULTIPOLYGON (" + ", ".join(map(_rings, parts["Polygon"] or parts["PolygonPatch"] or parts["Surface"])) + ")"
    if name == "MultiGeometry":
        inner = [w for c in e if (w := xml_wkt(c))]
        return "GEOMETRYCOLLECTION (" + ", ".join(inner) + ")"
    return None


GEOMETRIES = {
    "Point", "LineString", "LinearRing", "Curve", "Polygon", "Surface", "MultiPoint", "MultiLineString", "MultiCurve", "MultiPolygon", "MultiSurface", "MultiGeometry", "Envelope", "Box",
}


def xml_feature(e: ET.Element | str) -> tuple[str | None, str | None, dict[str, str]]:
    """Id, first geometry and leaves of a feature element. Names of nested leaves are joined by dots; the
    first value of a name stands, attributes of references count as ``name.href``."""
    e = ET.fromstring(e) if isinstance(e, str) else e
    wkt, attrs = None, {}

    def walk(node: ET.Element, prefix: str) -> None:
        nonlocal wkt
        for c in node:
            if _local(c) in GEOMETRIES:
                wkt = wkt or xml_wkt(c)
                continue
            name = prefix + _local(c)
            href = next((v for k, v in c.attrib.items() if k.rpartition("}")[2] == "href"), None)
            if href:
                attrs.setdefault(f"{name}.href", href)
            if len(c):
                walk(c, f"{name}.")
            elif c.text and c.text.strip():
                attrs.setdefault(name, c.text.strip())

    walk(e, "")
    fid = next((v for k, v in e.attrib.items() if k.rpartition("}")[2] in ("id", "fid")), None)
    return fid, wkt, attrs


def xml_features(spark: SparkSession, path: str | list[str], tag: str) -> DataFrame:
    """``features`` of every element named ``tag`` (without its prefix), whatever its schema: GML feature members, KML
    placemarks, INSPIRE themes, metadata records. One task cuts a file into them as a stream, all tasks read them."""
    paths = [path] if isinstance(path, str) else path
    one = len(paths) == 1 and "." in paths[0].rpartition("/")[2] and "*" not in paths[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, n, xml in zip(pdf["file"], pdf["n"], pdf["xml"]):
                own = "" if one else file.rpartition("/")[2] + "#"
                for i, e in enumerate((e for e in ET.fromstring(xml).iter() if _local(e) == tag), n):
                    fid, wkt, attrs = xml_feature(e)
                    rows.append((fid or f"{own}{tag}{i}", wkt, attrs))
            yield pd.DataFrame(rows, columns=["fid", "wkt", "attrs"])

    found = parts.split(spark, paths, lambda f: parts.xml_elements(f, lambda local, above, depth: local == tag), "n long, xml string")
    return found.mapInPandas(run, FEATURES)
