"""Triples from files."""

from __future__ import annotations

import codecs
import io
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweave.plans import turtle
from terraweave.plans.sparql import RDF_TYPE
from terraweave.sources import parts

SCHEMA = "s string, p string, o string, o_kind string, dt string, lang string"
_NODE = r"(?:<([^>]*)>|(_:[^\s<]+?))"
_LINE = rf"^\s*{_NODE}\s*<([^>]*)>\s*(?:{_NODE}|\"((?:[^\"\\]|\\.)*)\"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$"
RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
XML_LANG = "{http://www.w3.org/XML/1998/namespace}lang"


def _unescaped(c):
    """All escapes of the format, ``\\u`` and ``\\U`` by their code units."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.replace(_decoded(out), F.lit("\x00"), F.lit("\\"))


def _decoded(c):
    def piece(x):
        code = lambda n, charset: F.concat(F.decode(F.unhex(F.substring(x, 3, n)), charset), F.substr(x, F.lit(3 + n)))
        return F.when(F.rlike(x, F.lit(r"^\\u[0-9A-Fa-f]{4}")), code(4, "UTF-16BE")).when(F.rlike(x, F.lit(r"^\\U[0-9A-Fa-f]{8}")), code(8, "UTF-32")).otherwise(x)

    coded = F.array_join(F.transform(F.split(c, r"(?=\\[uU])"), piece), "")
    return F.when(c.contains("\\u") | c.contains("\\U"), coded).otherwise(c)


def ntriples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines, split natively. Comments and blank lines are passed over; any other line that is no triple is an error."""
    lines = spark.read.text(path).filter(~F.rlike("value", F.lit(r"^\s*(#.*)?$")))
    g = lambda i: F.nullif(F.regexp_extract("value", _LINE, i), F.lit(""))
    bad = F.raise_error(F.concat(F.lit("not a triple: "), F.col("value"))).cast("string")
    parsed = lines.select(F.when(F.rlike("value", F.lit(_LINE)), F.col("value")).otherwise(bad).alias("value"))
    uri = F.coalesce(g(4), g(5))
    return parsed.select(
        _decoded(F.coalesce(g(1), g(2))).alias("s"),
        _decoded(g(3)).alias("p"),
        F.coalesce(_decoded(uri), _unescaped(F.regexp_extract("value", _LINE, 6))).alias("o"),
        F.when(uri.isNotNull(), "uri").otherwise("literal").alias("o_kind"),
        g(7).alias("dt"),
        g(8).alias("lang"),
    )


def read_rdf_xml(content: str, scope: str = "") -> list[turtle.Triple]:
    """Node and property elements, typed nodes, resources, literals, nested nodes. ``scope`` tells the nameless nodes of files apart."""
    out: list[turtle.Triple] = []
    blank = 0

    def name(tag: str) -> str:
        return tag.replace("{", "", 1).replace("}", "", 1)

    def node(e: ET.Element) -> str:
        nonlocal blank
        s = e.get(f"{RDF}about") or e.get(f"{RDF}ID") and "#" + e.get(f"{RDF}ID", "") or e.get(f"{RDF}nodeID") and "_:" + e.get(f"{RDF}nodeID", "")
        if not s:
            blank += 1
            s = f"_:x{scope}x{blank}"
        if e.tag != f"{RDF}Description":
            out.append((s, RDF_TYPE, name(e.tag), "uri", None, None))
        for p in e:
            target = p.get(f"{RDF}resource")
            if target is not None:
                out.append((s, name(p.tag), target, "uri", None, None))
            elif len(p):
                out.append((s, name(p.tag), node(p[0]), "uri", None, None))
            else:
                out.append((s, name(p.tag), p.text or "", "literal", p.get(f"{RDF}datatype"), p.get(XML_LANG)))
        return s

    root = ET.fromstring(content)
    for e in root if root.tag in (f"{RDF}RDF", "part") else [root]:
        node(e)
    return out


def rdf_xml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """RDF/XML: one task cuts a file into the nodes below its root as a stream, all tasks read them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [t for file, n, xml in zip(pdf["file"], pdf["n"], pdf["xml"]) for t in read_rdf_xml(xml, f"{zlib.crc32(file.encode()):08x}x{n}")]
            yield pd.DataFrame(found, columns=["s", "p", "o", "o_kind", "dt", "lang"])

    cut = lambda f: parts.xml_elements(f, lambda local, above, depth: depth == 1 if depth else local != "RDF")
    return parts.split(spark, path, cut, "n long, xml string").mapInPandas(run, SCHEMA)


def whole_files(spark: SparkSession, path: str | list[str], serialization: str) -> DataFrame:
    """Turtle, N3: a file is one task's work, which reads it as a stream, statement by statement, and holds little of it. RDF/XML is taken apart before."""
    if "XML" in serialization.upper():
        return rdf_xml(spark, path)
    files = spark.read.format("binaryFile").load([path] if isinstance(path, str) else path)
    streams = parts.can_open(files)

    def pieces(f: BinaryIO) -> Iterator[str]:
        decoder = codecs.getincrementaldecoder("utf-8-sig")()
        while chunk := f.read(parts.CHUNK):
            yield decoder.decode(chunk)
        yield decoder.decode(b"", True)

    def triples(name: str, content: bytes | None) -> Iterator[turtle.Triple]:
        scope, labels, end = f"{zlib.crc32(name.encode()):08x}", set(), ""
        with opened_or_held(name, content) as f:
            for piece in pieces(f):
                labels |= turtle.own_labels(end + piece, scope)
                end = (end + piece)[-64:]
        with opened_or_held(name, content) as f:
            for out in turtle.Reader(pieces(f), scope, labels).statements():
                yield from out

    def opened_or_held(name: str, content: bytes | None) -> BinaryIO:
        return parts.opened(name) if content is None else io.BytesIO(content)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, name in enumerate(pdf["path"]):
                found = triples(name, None if streams else bytes(pdf["content"].iloc[i]))
                while held := list(islice(found, 5000)):
                    yield pd.DataFrame(held, columns=["s", "p", "o", "o_kind", "dt", "lang"])

    return files.select("path", *([] if streams else ["content"])).mapInPandas(run, SCHEMA)


def read(spark: SparkSession, path: str | list[str], serialization: str = "N-TRIPLES") -> DataFrame:
    """Triples of one dataset, or of several: labels of blank nodes hold within a dataset, so those of each path of a list get its number."""
    kind = serialization.upper()
    if isinstance(path, list) and len(path) > 1:
        own = lambda c, i: F.when(F.col(c).startswith("_:"), F.concat(F.lit(f"_:d{i}x"), F.substr(F.col(c), F.lit(3)))).otherwise(F.col(c)).alias(c)
        of = lambda i, p: read(spark, p, kind).select(own("s", i), "p", F.when(F.col("o_kind") == "uri", own("o", i)).otherwise(F.col("o")).alias("o"), "o_kind", "dt", "lang")
        return reduce(DataFrame.unionByName, [of(i, p) for i, p in enumerate(path)])
    return ntriples(spark, path) if kind in ("N-TRIPLES", "NT", "N-TRIPLE") else whole_files(spark, path, kind)
