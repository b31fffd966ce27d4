"""Triples to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweave.sinks import single

STRING = "http://www.w3.org/2001/XMLSchema#string"


def _quoted(v: Column) -> Column:
    out = F.replace(v, F.lit("\\"), F.lit("\\\\"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _node(v: Column) -> Column:
    return F.when(v.startswith("_:"), v).otherwise(F.concat(F.lit("<"), v, F.lit(">")))


def object_text() -> Column:
    literal = F.concat(
        _quoted(F.col("o")),
        F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang")))
        .when(F.col("dt").isNotNull() & (F.col("dt") != STRING), F.concat(F.lit("^^<"), F.col("dt"), F.lit(">")))
        .otherwise(F.lit("")),
    )
    return F.when(F.col("o_kind") == "uri", _node(F.col("o"))).otherwise(literal)


def ntriples(triples: DataFrame) -> DataFrame:
    """A line per triple, in column ``value``."""
    return triples.select(F.concat(_node(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), object_text(), F.lit(" .")).alias("value"))


def turtle(triples: DataFrame) -> DataFrame:
    """A statement per subject; predicates and objects in order."""
    by_p = triples.select("s", "p", object_text().alias("t")).distinct().groupBy("s", "p").agg(F.array_join(F.sort_array(F.collect_list("t")), ", ").alias("objects"))
    line = F.concat(F.lit("<"), F.col("p"), F.lit("> "), F.col("objects"))
    body = F.array_join(F.sort_array(F.collect_list(line)), " ;\n    ")
    return by_p.groupBy("s").agg(body.alias("b")).select(F.concat(_node(F.col("s")), F.lit("\n    "), F.col("b"), F.lit(" .")).alias("value"))


def _xml(v: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def rdf_xml(triples: DataFrame) -> DataFrame:
    """A complete ``rdf:Description`` per subject. The writer adds the root element."""
    ns, local = F.regexp_extract("p", r"^(.*[#/:])([^#/:]+)$", 1), F.regexp_extract("p", r"^(.*[#/:])([^#/:]+)$", 2)
    head = F.concat(F.lit("<p:"), local, F.lit(' xmlns:p="'), _xml(ns), F.lit('"'))
    tail = F.concat(F.lit("</p:"), local, F.lit(">"))
    attr = F.when(F.col("lang").isNotNull(), F.concat(F.lit(' xml:lang="'), F.col("lang"), F.lit('"'))).when(F.col("dt").isNotNull(), F.concat(F.lit(' rdf:datatype="'), _xml(F.col("dt")), F.lit('"'))).otherwise(F.lit(""))
    element = F.when(F.col("o_kind") == "uri", F.concat(head, F.lit(' rdf:resource="'), _xml(F.col("o")), F.lit('"/>'))).otherwise(F.concat(head, attr, F.lit(">"), _xml(F.col("o")), tail))
    subject = F.when(F.col("s").startswith("_:"), F.concat(F.lit('rdf:nodeID="'), F.substr(F.col("s"), F.lit(3)), F.lit('"'))).otherwise(F.concat(F.lit('rdf:about="'), _xml(F.col("s")), F.lit('"')))
    made = triples.select(subject.alias("s"), element.alias("e")).distinct().groupBy("s").agg(F.array_join(F.sort_array(F.collect_list("e")), "\n  ").alias("b"))
    return made.select(F.concat(F.lit("<rdf:Description "), F.col("s"), F.lit(">\n  "), F.col("b"), F.lit("\n</rdf:Description>")).alias("value"))


RDF_OPEN, RDF_CLOSE = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">', "</rdf:RDF>"


def merge(spark: SparkSession, paths: list[str], target: str, files: int = 1) -> None:
    """The lines of N-Triples outputs as one file, or as many as asked for. Only forms whose lines stand alone can be merged."""
    spark.read.text(paths).coalesce(files).write.mode("overwrite").text(target)


def write(triples: DataFrame, path: str, serialization: str = "N-TRIPLES") -> None:
    """Part files below ``path``. RDF/XML is one document and so one file; every other form has as many
    files as there are partitions."""
    kind = serialization.upper()
    if kind in ("N-TRIPLES", "NT", "N-TRIPLE"):
        ntriples(triples).write.mode("overwrite").text(path)
    elif kind in ("TURTLE", "TTL", "N3"):
        turtle(triples).write.mode("overwrite").text(path)
    else:
        single.write(rdf_xml(triples), path, RDF_OPEN, RDF_CLOSE)
