"""Query results to CSV, GeoJSON and shapefiles; statistics to JSON."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweave.functions import crs, geometry
from terraweave.operators.filters import is_valid
from terraweave.sinks import single
from terraweave.sources import scratch

_CRS = r"^<[^>]*/EPSG/0/(\d+)>\s*(.*)$"


class CrsError(ValueError):
    pass


def split_crs(literal: Column) -> tuple[Column, Column]:
    """SRID and WKT of a literal with a reference system in front; 4326 where there is none."""
    has = F.rlike(literal, F.lit(_CRS))
    return F.when(has, F.regexp_extract(literal, _CRS, 1).cast("int")).otherwise(F.lit(4326)), F.when(has, F.regexp_extract(literal, _CRS, 2)).otherwise(literal)


def checked_wkt(literal: Column, source: int) -> Column:
    """The WKT, or an error where the literal has another system than the run was told."""
    srid, wkt = split_crs(literal)
    return F.when(srid == source, wkt).when(literal.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("a geometry has EPSG:"), srid.cast("string"))).cast("string"))


def ewkt(literal: Column) -> Column:
    srid, wkt = split_crs(literal)
    return F.concat(F.lit("SRID="), srid.cast("string"), F.lit(";"), wkt)


def csv_rows(rows: DataFrame, delimiter: str, quote: str | None, geometry_column: str | None = None) -> DataFrame:
    """Values that hold the quote (or, unquoted, the delimiter) become empty; geometries become EWKT."""
    bad = quote or delimiter
    out = []
    for c in rows.columns:
        v = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        if c == geometry_column:
            v = F.when(v != "", ewkt(v)).otherwise(v)
        out.append(F.when(v.contains(bad), F.lit("")).otherwise(v).alias(c))
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str, delimiter: str = ",", quote: str | None = '"', geometry_column: str | None = None) -> None:
    ready = csv_rows(rows, delimiter, quote, geometry_column)
    ready.write.mode("overwrite").option("header", True).option("sep", delimiter).option("quote", quote or "\0").option("quoteAll", bool(quote)).option("emptyValue", "").csv(path)


def geojson_geometry(g: Column) -> Column:
    """JSON text of a parsed geometry."""
    wrapped = lambda t: F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(t, ","), F.lit("]}"))
    return geometry.let(F.transform(geometry.each(g), _geojson), lambda t: F.when(geometry.is_collection(g), wrapped(t)).otherwise(t[0]))


def _geojson(g: Column) -> Column:
    pair = lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))
    many = lambda xs, f: F.concat(F.lit("["), F.array_join(F.transform(xs, f), ","), F.lit("]"))
    ring = lambda r: many(r, pair)
    rings = lambda rs: many(rs, ring)
    k, parts = g["kind"], g["parts"]
    names = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
    kind = F.lit(None).cast("string")
    for wkt, name in names.items():
        kind = F.when(k == wkt, name).otherwise(kind)
    coords = (
        F.when(k == "POINT", pair(parts[0][0][0]))
        .when(k == "LINESTRING", ring(parts[0][0]))
        .when(k == "POLYGON", rings(parts[0]))
        .when(k == "MULTIPOINT", many(parts, lambda rs: pair(rs[0][0])))
        .when(k == "MULTILINESTRING", many(parts, lambda rs: ring(rs[0])))
        .otherwise(many(parts, rings))
    )
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coords, F.lit("}"))


def geojson_features(rows: DataFrame, geometry_column: str, source: int = 4326, target: int | None = None) -> DataFrame:
    """A feature a line (``value``); rows without a valid geometry are left out."""
    g = crs.transform(geometry.parse(checked_wkt(F.nullif(F.col(geometry_column), F.lit("")), source)), source, target or source)
    others = [c for c in rows.columns if c != geometry_column]
    found = rows.withColumn("__g", g).filter(is_valid(F.col("__g"), split_crs(F.col(geometry_column))[1]))
    props = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in others])) if others else F.lit("{}")
    return found.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), geojson_geometry(F.col("__g")), F.lit("}")).alias("value"))


def write_geojson(rows: DataFrame, path: str, geometry_column: str, source: int = 4326, target: int | None = None) -> None:
    """One valid document in one file: commas stand before all features but the first."""
    head = '{"type":"FeatureCollection",'
    if target and target != source:
        head += f'"crs":{{"type":"name","properties":{{"name":"urn:ogc:def:crs:EPSG::{target}"}}}},'
    lines = geojson_features(rows, geometry_column, source, target).select(F.concat(F.lit(","), "value").alias("value"))
    single.write(lines, path, head + '"features":[', "]}", skip=1)


def promoted(wkt: Column) -> Column:
    """Polygons and lines as their multiple kinds, so that a file has one kind."""
    kind, body = F.upper(geometry.kind(wkt)), F.regexp_extract(wkt, r"(?s)^[^(]*(\(.*\))\s*$", 1)
    multi = kind.isin("POLYGON", "LINESTRING")
    return F.when(multi, F.concat(F.lit("MULTI"), kind, F.lit(" ("), body, F.lit(")"))).otherwise(wkt)


def schema_of(triples_types: dict[str, str | None]) -> dict[str, str]:
    """Column kinds by the datatype of the first value that has one."""
    kinds = {"integer": "int", "long": "int", "float": "double", "double": "double", "decimal": "double", "date": "date", "wktLiteral": "geometry"}
    return {k: kinds.get((dt or "").rpartition("#")[2], "string") for k, dt in triples_types.items()}


def encode_shp(wkts: list[str]) -> tuple[bytes, bytes]:
    """Contents of .shp and .shx for geometries of one kind (point, multilinestring or multipolygon), with their box in the headers."""
    records: list[bytes] = []
    kind, box = 1, [0.0, 0.0, 0.0, 0.0]
    for w in wkts:
        name = w.partition("(")[0].strip().upper()
        nested = json.loads(re.sub(r"([-+.\deE]+) ([-+.\deE]+)", r"[\1,\2]", w[w.index("(") :]).replace("(", "[").replace(")", "]"))
        kind = {"MULTIPOLYGON": 5, "MULTILINESTRING": 3}.get(name, 1)
        rings = [nested] if kind == 1 else nested if kind == 3 else [_turned(r, i == 0) for member in nested for i, r in enumerate(member)]
        flat = [p for r in rings for p in r]
        xs, ys = [p[0] for p in flat], [p[1] for p in flat]
        own = [min(xs), min(ys), max(xs), max(ys)]
        box = [f(a, b) for f, a, b in zip((min, min, max, max), box, own)] if records else own
        if kind == 1:
            records.append(struct.pack("<i2d", 1, *flat[0]))
            continue
        starts = list(accumulate(map(len, rings[:-1]), initial=0))
        body = struct.pack("<i4d2i", kind, *own, len(rings), len(flat)) + struct.pack(f"<{len(starts)}i", *starts)
        records.append(body + struct.pack(f"<{2 * len(flat)}d", *(v for p in flat for v in p)))
    shp, shx, at = bytearray(), bytearray(), 50
    for i, r in enumerate(records, 1):
        shp += struct.pack(">2i", i, len(r) // 2) + r
        shx += struct.pack(">2i", at, len(r) // 2)
        at += 4 + len(r) // 2
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, kind, *box, 0, 0, 0, 0)
    return head(50 + len(shp) // 2) + bytes(shp), head(50 + len(shx) // 2) + bytes(shx)


def _turned(ring: list, shell: bool) -> list:
    """Shells run clockwise, holes against it."""
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
    return ring[::-1] if (area > 0) == shell else ring


def projection(srid: int) -> str:
    """The contents of a .prj file."""
    degrees = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'
    tm = crs._tm(srid)
    if srid == 4326:
        return degrees
    if srid == 3857:
        return f'PROJCS["EPSG:3857",{degrees},PROJECTION["Mercator_Auxiliary_Sphere"],UNIT["metre",1]]'
    meridian, scale, east, north = tm if tm else (0.0, 1.0, 0.0, 0.0)
    parameters = ",".join(f'PARAMETER["{k}",{v}]' for k, v in (("latitude_of_origin", 0), ("central_meridian", meridian), ("scale_factor", scale), ("false_easting", east), ("false_northing", north)))
    return f'PROJCS["EPSG:{srid}",{degrees},PROJECTION["Transverse_Mercator"],{parameters},UNIT["metre",1]]'


def encode_dbf(rows: list[dict[str, str]], names: list[str], kinds: dict[str, str] | None = None) -> bytes:
    """``kinds``: int and double columns become numeric fields, if all their values are numbers."""

    def numeric(n: str) -> bool:
        try:
            return (kinds or {}).get(n) in ("int", "double") and all(float(r.get(n) or 0) is not None for r in rows)
        except ValueError:
            return False

    widths = [min(254, max([1, *(len((r.get(n) or "").encode()) for r in rows)])) for n in names]
    numbers = {n for n in names if numeric(n)}
    decimals = [max([0, *(len((r.get(n) or "").partition(".")[2]) for r in rows)]) if n in numbers and kinds[n] == "double" else 0 for n in names]
    fields = b"".join(n.encode()[:10].ljust(11, b"\0") + (b"N" if n in numbers else b"C") + b"\0" * 4 + bytes([w, min(d, 15)]) + b"\0" * 14 for n, w, d in zip(names, widths, decimals))
    head = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + len(fields), 1 + sum(widths))
    cell = lambda r, n, w: (r.get(n) or "").encode()[:w]
    body = b"".join(b" " + b"".join(cell(r, n, w).rjust(w) if n in numbers else cell(r, n, w).ljust(w) for n, w in zip(names, widths)) for r in rows)
    return head + fields + b"\r" + body + b"\x1a"


def shapefile_parts(rows: DataFrame, geometry_column: str, kind: str, source: int = 4326, target: int | None = None, kinds: dict[str, str] | None = None) -> DataFrame:
    """``(part, shp, shx, dbf)``: the files of one shapefile for each partition, or for every PART_ROWS rows or PART_CHARS characters of it, so that
    a task holds no more. Other kinds of geometry and invalid ones are left out. ``kinds`` as ``schema_of`` gives them."""
    return _encoded(_ready(rows, geometry_column, kind, source, target), kinds)


#: What one shapefile takes at most, as text; the format's own bound is 2 GB.
PART_ROWS, PART_CHARS = 50_000, 1 << 24


def _ready(rows: DataFrame, geometry_column: str, kind: str, source: int, target: int | None) -> DataFrame:
    wkt = checked_wkt(F.nullif(F.col(geometry_column), F.lit("")), source)
    g = crs.transform(geometry.parse(wkt), source, target or source)
    return rows.withColumn("__wkt", promoted(geometry.to_wkt(g))).filter(is_valid(g, split_crs(F.col(geometry_column))[1]) & (geometry.kind(F.col("__wkt")) == kind.upper())).drop(geometry_column)


def _encoded(ready: DataFrame, kinds: dict[str, str] | None) -> DataFrame:
    names = [c for c in ready.columns if c != "__wkt"]

    def encoded(held: list[pd.DataFrame], n: int) -> pd.DataFrame:
        pdf = pd.concat(held)
        shp, shx = encode_shp(list(pdf["__wkt"]))
        dbf = encode_dbf(pdf[names].astype(object).where(pdf[names].notna(), "").astype(str).to_dict("records"), names, kinds)
        return pd.DataFrame([(n, shp, shx, dbf)], columns=["n", "shp", "shx", "dbf"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, chars, n = [], 0, 0, 0
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                piece = pdf.iloc[at : at + 1000]
                size = int(piece["__wkt"].str.len().sum())
                if held and (rows + len(piece) > PART_ROWS or chars + size > PART_CHARS):
                    yield encoded(held, n)
                    held, rows, chars, n = [], 0, 0, n + 1
                held.append(piece)
                rows, chars = rows + len(piece), chars + size
        if held:
            yield encoded(held, n)

    made = ready.mapInPandas(run, "n int, shp binary, shx binary, dbf binary")
    part = F.concat(F.spark_partition_id().cast("string"), F.when(F.col("n") > 0, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(F.lit("")))
    return made.select("shp", "shx", "dbf", part.alias("part"))


def write_shapefile(rows: DataFrame, path: str, geometry_column: str, kind: str, source: int = 4326, target: int | None = None, parts: int = 1, kinds: dict[str, str] | None = None) -> None:
    """``path-<part>.shp`` and its siblings, ``parts`` of them or more where one would be too large (``path-<part>_<n>.shp``). Geometries are made
    ready by all tasks and encoded by ``parts``; the driver writes one file set at a time through Hadoop's file system."""
    spark = rows.sparkSession
    jvm = spark._jvm
    made = _encoded(_ready(rows, geometry_column, kind, source, target).repartition(parts), kinds)
    saved = f"{scratch.folder(spark)}/parts"
    made.write.option("maxRecordsPerFile", 1).parquet(saved)
    for name in sorted(spark.read.parquet(saved).inputFiles()):  # a file holds one set
        for r in spark.read.parquet(name).collect():
            content = {k: bytes(r[k]) for k in ("shp", "shx", "dbf")} | {"prj": projection(target or source).encode()}
            for suffix, data in content.items():
                p = jvm.org.apache.hadoop.fs.Path(f"{path}-{r['part']}.{suffix}")
                stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
                stream.write(bytearray(data))
                stream.close()


def metadata(counts: DataFrame, box: DataFrame, attributes: DataFrame) -> DataFrame:
    """One JSON document (``value``) of a run's statistics; attributes in order of their name."""
    pairs = attributes.agg(F.sort_array(F.collect_list(F.struct("attribute", "n"))).alias("a")).select(F.map_from_entries("a").alias("a"))
    one = counts.join(box).join(pairs)
    return one.select(F.to_json(F.struct(F.struct(*counts.columns).alias("records"), F.struct(*box.columns).alias("mbr"), F.col("a").alias("attributes"))).alias("value"))


def write_registry(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").option("sep", "|").option("header", True).csv(path)


