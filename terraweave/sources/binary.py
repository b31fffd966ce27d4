"""Decoders of binary formats: shapefiles, OSM PBF and geodatabase shapes. Files are rows of ``binaryFile``."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraweave.sources.nested import FEATURES
from terraweave.sources.parts import can_open, opened

#: Stored shape types (plain, Z, ZM, M, general) by the plain type whose layout they begin with.
SHAPES = {
    1: 1, 9: 1, 11: 1, 21: 1, 52: 1,
    3: 3, 10: 3, 13: 3, 23: 3, 50: 3,
    5: 5, 19: 5, 15: 5, 25: 5, 51: 5,
    8: 8, 20: 8, 18: 8, 28: 8, 53: 8,
}


def _num(v: float) -> str:
    return repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def _pairs(points: list[tuple[float, float]]) -> str:
    return "(" + ", ".join(f"{_num(x)} {_num(y)}" for x, y in points) + ")"


def _area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def shape_wkt(data: bytes, at: int = 0) -> str | None:
    """WKT of one shape record; Z and M variants lose these values. Clockwise rings are shells."""
    (kind,) = struct.unpack_from("<i", data, at)
    base = SHAPES.get(kind & 0xFF)  # general types keep flags in the upper bits
    if base is None:
        return None
    if base == 1:
        return "POINT " + _pairs([struct.unpack_from("<2d", data, at + 4)])
    if base == 8:
        (n,) = struct.unpack_from("<i", data, at + 36)
        flat = struct.unpack_from(f"<{2 * n}d", data, at + 40)
        return "MULTIPOINT (" + ", ".join(_pairs([p]) for p in zip(flat[::2], flat[1::2])) + ")"
    n_parts, n = struct.unpack_from("<2i", data, at + 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", data, at + 44), n]
    flat = struct.unpack_from(f"<{2 * n}d", data, at + 44 + 4 * n_parts)
    points = list(zip(flat[::2], flat[1::2]))
    parts = [points[a:b] for a, b in zip(starts, starts[1:])]
    if base == 3:
        return "LINESTRING " + _pairs(parts[0]) if n_parts == 1 else "MULTILINESTRING (" + ", ".join(map(_pairs, parts)) + ")"
    shells: list[list] = []
    for ring in parts:
        if _area(ring) <= 0 or not shells:
            shells.append([ring])
        else:
            shells[-1].append(ring)
    texts = ["(" + ", ".join(map(_pairs, s)) + ")" for s in shells]
    return f"POLYGON {texts[0]}" if len(texts) == 1 else "MULTIPOLYGON (" + ", ".join(texts) + ")"


def read_shp(data: bytes) -> list[str | None]:
    out, at = [], 100
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        out.append(shape_wkt(data, at + 8))
        at += 8 + 2 * words
    return out


def read_dbf(data: bytes, encoding: str = "utf-8") -> list[dict[str, str]]:
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32
    out = []
    for i in range(n):
        at, row = head + i * size + 1, {}
        for name, width in fields:
            value = data[at : at + width].decode(encoding, "replace").strip(" \0")
            if value:
                row[name] = value
            at += width
        out.append(row)
    return out


def shapefile(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """``features`` of all shapefiles below ``path``, their ids the file's name and the record's number; .shp and .dbf meet by their name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{shp,dbf,SHP,DBF}").load(path)
    files = files.select(F.regexp_replace("path", r"\.\w+$", "").alias("stem"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind"), "content")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = dict(zip(pdf["kind"], pdf["content"]))
        if len(parts) < 2:
            raise ValueError(f"{pdf['stem'].iloc[0]} lacks its .shp or .dbf")
        shapes, rows = read_shp(bytes(parts["shp"])), read_dbf(bytes(parts["dbf"]), encoding)
        name = pdf["stem"].iloc[0].rpartition("/")[2]
        return pd.DataFrame([(f"{name}#{i}", w, r) for i, (w, r) in enumerate(zip(shapes, rows))], columns=["fid", "wkt", "attrs"])

    return files.groupBy("stem").applyInPandas(run, FEATURES)


# OSM PBF


def _varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[at]
        at += 1
        out |= (c & 0x7F) << shift
        if c < 0x80:
            return out, at
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        kind = tag & 7
        if kind == 0:
            v, at = _varint(b, at)
            yield tag >> 3, v
        elif kind == 2:
            n, at = _varint(b, at)
            yield tag >> 3, b[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, b[at : at + n]
            at += n


def _packed(b: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(b):
        v, at = _varint(b, at)
        out.append((v >> 1) ^ -(v & 1) if signed else v)
    return out


def _sums(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += v
        out.append(total)
    return out


def _degrees(v: int) -> str:
    return repr(round(v * 1e-9, 7))


def read_block(block: bytes) -> Iterator[tuple[str, str, str | None, str | None, list[str], list[dict], dict[str, str]]]:
    """``(kind, id, lon, lat, refs, members, tags)`` of a primitive block."""
    strings, groups, step, lat0, lon0 = [], [], 100, 0, 0
    for f, v in _fields(block):
        if f == 1:
            strings = [s.decode() for n, s in _fields(v) if n == 1]  # type: ignore[arg-type,union-attr]
        elif f == 2:
            groups.append(v)
        elif f == 17:
            step = v
        elif f == 19:
            lat0 = v
        elif f == 20:
            lon0 = v

    def place(lon: int, lat: int) -> tuple[str, str]:
        return _degrees(lon0 + step * lon), _degrees(lat0 + step * lat)

    def tags(d: dict) -> dict[str, str]:
        return {strings[k]: strings[v] for k, v in zip(_packed(d.get(2, b"")), _packed(d.get(3, b"")))}

    for g in groups:
        for f, v in _fields(g):  # type: ignore[arg-type]
            d = dict(_fields(v))  # type: ignore[arg-type]
            if f == 1:
                zig = lambda n: (n >> 1) ^ -(n & 1)
                yield "node", str(zig(d[1])), *place(zig(d[9]), zig(d[8])), [], [], tags(d)
            elif f == 2:
                ids, lats, lons = (_sums(_packed(d[i], True)) for i in (1, 8, 9))
                pairs, at = _packed(d.get(10, b"")), 0
                for i, lat, lon in zip(ids, lats, lons):
                    own = {}
                    while at < len(pairs) and pairs[at]:
                        own[strings[pairs[at]]] = strings[pairs[at + 1]]
                        at += 2
                    at += 1
                    yield "node", str(i), *place(lon, lat), [], [], own
            elif f == 3:
                yield "way", str(d[1]), None, None, [str(r) for r in _sums(_packed(d.get(8, b""), True))], [], tags(d)
            elif f == 4:
                kinds = ("node", "way", "relation")
                roles, refs, types = _packed(d.get(8, b"")), _sums(_packed(d.get(9, b""), True)), _packed(d.get(10, b""))
                yield "relation", str(d[1]), None, None, [], [{"ref": str(r), "type": kinds[t], "role": strings[o]} for r, t, o in zip(refs, types, roles)], tags(d)


def read_blob(data: bytes) -> Iterator[tuple]:
    blob = dict(_fields(data))
    return read_block(blob[1] if 1 in blob else zlib.decompress(blob[3]))  # type: ignore[arg-type]


def blobs(file: BinaryIO) -> Iterator[tuple[int, int]]:
    """Offset and size of each blob of elements: only the short headers between them are read."""
    at = 0
    while len(size := file.read(4)) == 4:
        (n,) = struct.unpack(">I", size)
        head = dict(_fields(file.read(n)))
        at += 4 + n
        if head[1] == b"OSMData":
            yield at, head[3]  # type: ignore[misc]
        at += head[3]  # type: ignore[operator]
        file.seek(at)


ELEMENTS = "kind string, id string, lon string, lat string, refs array<string>, members array<struct<ref:string,type:string,role:string>>, tags map<string,string>"


def osm_pbf(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes``, ``ways`` and ``relations``. One task lists the blobs of a file, and all tasks share them, where Arrow's file systems can open the
    path; elsewhere Spark hands a file to one task as a whole, which then cannot exceed 2 GB."""
    paths = [path] if isinstance(path, str) else path
    names = ["kind", "id", "lon", "lat", "refs", "members", "tags"]

    def decoded(parts: Iterator[bytes]) -> Iterator[pd.DataFrame]:
        held = []
        for data in parts:
            held += read_blob(data)
            if len(held) >= 5000:
                yield pd.DataFrame(held, columns=names)
                held = []
        yield pd.DataFrame(held, columns=names)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["path"]:
                with opened(p) as f:
                    yield pd.DataFrame([(p, at, n) for at, n in blobs(f)], columns=["path", "at", "n"])

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts() -> Iterator[bytes]:
            for pdf in batches:
                for p, own in pdf.groupby("path"):
                    with opened(p) as f:
                        for at, n in zip(own["at"], own["n"]):
                            f.seek(int(at))
                            yield f.read(int(n))

        return decoded(parts())

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts() -> Iterator[bytes]:
            for pdf in batches:
                for content in pdf["content"]:
                    f = io.BytesIO(content)
                    for at, n in list(blobs(f)):
                        yield content[at : at + n]

        return decoded(parts())

    files = spark.read.format("binaryFile").load(paths)
    if can_open(files):
        found = files.select("path").mapInPandas(listed, "path string, at long, n long")
        all_ = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "at").mapInPandas(ranges, ELEMENTS)
    else:
        all_ = files.select("content").mapInPandas(whole, ELEMENTS)
    pick = lambda kind, *cols: all_.filter(F.col("kind") == kind).select(*cols)
    return pick("node", "id", "lon", "lat", "tags"), pick("way", "id", "refs", "tags"), pick("relation", "id", "members", "tags")


@F.pandas_udf(T.StringType())
def geodatabase_wkt(blobs: pd.Series) -> pd.Series:
    """WKT of shape blobs as personal geodatabases keep them; what cannot be read is null."""

    def one(b: bytes | None) -> str | None:
        try:
            return shape_wkt(bytes(b)) if b else None
        except struct.error:
            return None

    return blobs.map(one)
