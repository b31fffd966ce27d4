"""Large documents: cut as streams, read by all tasks, written as one file by many."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from terraweave.plans import turtle
from terraweave.sinks import features as sinks
from terraweave.sinks import rdf as rdf_sinks
from terraweave.sources import nested, parts, rdf, xml_graph

N = 300
KML = '<kml xmlns="http://www.opengis.net/kml/2.2"><Document>' + "".join(f'<Placemark id="{i}"><name>p{i}</name><Point><coordinates>{i},1</coordinates></Point></Placemark>' for i in range(N)) + "</Document></kml>"
RDF = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:o="http://o#">' + "".join(f'<rdf:Description rdf:about="http://s/{i}"><o:p><rdf:Description><o:q>{i}</o:q></rdf:Description></o:p></rdf:Description>' for i in range(N)) + "</rdf:RDF>"
GEOJSON = json.dumps({"type": "FeatureCollection", "other": [{"features": [{"id": "no"}]}], "features": [{"type": "Feature", "id": str(i), "properties": {"t": '"}],[{'}, "geometry": {"type": "Point", "coordinates": [i, 1]}} for i in range(N)]})
OSM = "<osm>" + "".join(f'<node id="{i}" lat="1" lon="2"><tag k="name" v="&lt;node&gt;{i}"/></node>' for i in range(N)) + "</osm>"
READERS = {
    "kml": (KML, lambda s, p: nested.xml_features(s, p, "Placemark"), N),
    "kml_triples": (KML, lambda s, p: xml_graph.read(s, p, xml_graph.KML), 3 * N),
    "rdf": (RDF, lambda s, p: rdf.read(s, p, "RDF/XML"), 2 * N),
    "geojson": (GEOJSON, nested.geojson, N),
    "json": (json.dumps({"items": [{"k": i} for i in range(N)]}), nested.json_file, N),
    "osm": (OSM, lambda s, p: nested.osm_xml(s, p)[0], N),
}


@pytest.mark.parametrize("kind", READERS)
def test_one_document_is_read_by_all_tasks(spark, tmp_path, kind):
    text, read, n = READERS[kind]
    (tmp_path / "a.x").write_text(text)
    rows = read(spark, str(tmp_path / "a.x")).withColumn("task", F.spark_partition_id()).select("task", F.struct("*").cast("string").alias("row")).collect()
    assert len(rows) == len({r.row for r in rows}) == n and len({r.task for r in rows}) > 1


def test_nameless_nodes_of_one_file_stay_apart(spark, tmp_path):
    (tmp_path / "a.rdf").write_text(RDF)
    assert rdf.read(spark, str(tmp_path / "a.rdf"), "RDF/XML").filter("s like '_:%'").select("s").distinct().count() == N


XML = '<?xml version="1.0"?><!DOCTYPE c [<!ENTITY foo "bar">]><c xmlns:g="g" id="7"><!-- <f/> --><a xmlns:y="u"><f q="a>b"/><y:f>&foo;<f>é</f></y:f></a><![CDATA[<f/>]]><f/></c>'


@pytest.mark.parametrize("chunk", [3, 1 << 20])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-16"])
def test_elements_of_a_stream(monkeypatch, chunk, encoding):
    monkeypatch.setattr(parts, "CHUNK", chunk)
    found = list(parts.xml_elements(io.BytesIO(XML.encode(encoding)), lambda local, above, depth: local == "f"))
    head = '<!DOCTYPE c [<!ENTITY foo "bar">]><part id="7" xmlns:g="g"'
    assert found == [(0, head + ' xmlns:y="u"><f q="a>b"/></part>'), (1, head + ' xmlns:y="u"><y:f>&foo;<f>é</f></y:f></part>'), (3, head + "><f/></part>")]


@pytest.mark.parametrize("chunk", [4, 1 << 20])
def test_items_of_a_stream(monkeypatch, chunk):
    monkeypatch.setattr(parts, "CHUNK", chunk)
    items = lambda text: [(k, listed, t) for k, listed, _, t in parts.json_items(io.BytesIO(text.encode()))]
    assert items('﻿{"a": 12.5, "b" : [ {"x":"}]"} , 3 ], "c": []}\n') == [("a", False, "12.5"), ("b", True, '{"x":"}]"}'), ("b", True, "3")]
    assert items("[1, [2]]") == [(None, False, "1"), (None, False, "[2]")]
    with pytest.raises(ValueError):
        items('{"a": [1, 2')


def test_one_file_of_many_parts(spark, tmp_path):
    rows = spark.range(20, numPartitions=4).select(F.col("id").cast("string").alias("k"), F.concat(F.lit("POINT ("), F.col("id").cast("string"), F.lit(" 1)")).alias("shape"))
    sinks.write_geojson(rows, str(tmp_path / "g"), "shape")
    (name,) = [f for f in os.listdir(tmp_path / "g") if not f.startswith((".", "_"))]
    assert [f["properties"]["k"] for f in json.loads((tmp_path / "g" / name).read_text())["features"]] == [str(i) for i in range(20)]
    sinks.write_geojson(rows.filter("false"), str(tmp_path / "e"), "shape")
    assert nested.geojson(spark, str(tmp_path / "e")).count() == 0
    none = F.lit(None).cast("string")
    rdf_sinks.write(rows.select(F.concat(F.lit("http://s/"), "k").alias("s"), F.lit("http://p/x").alias("p"), F.col("k").alias("o"), F.lit("literal").alias("o_kind"), none.alias("dt"), none.alias("lang")), str(tmp_path / "r"), "RDF/XML")
    assert len([f for f in os.listdir(tmp_path / "r") if f.startswith("part")]) == 1
    assert rdf.read(spark, str(tmp_path / "r"), "RDF/XML").count() == 20


TURTLE = '@prefix e: <http://e/> . # c\ne:x e:of ( 1 2.5 "three" """lo"ng\n"" x""" ) ; e:n [ e:v "_" ] . _:gx1 e:v "own"@en , "d"^^e:t , 1e+5 , true . e:c e:a.b e:d .'


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_turtle_in_pieces(size):
    pieces = iter([TURTLE[i : i + size] for i in range(0, len(TURTLE), size)])
    found = [t for out in turtle.Reader(pieces, "", turtle.own_labels(TURTLE, "")).statements() for t in out]
    assert found == turtle.read(TURTLE) and len(found) == 16


def test_a_statement_of_turtle_does_not_wait_for_the_last():
    taken = []
    pieces = (taken.append(i) or f'<http://s/{i}> <http://p> "long enough {i}" .\n' for i in range(1000))
    assert next(turtle.Reader(pieces).statements()) == [("http://s/0", "http://p", "long enough 0", "literal", None, None)] and len(taken) < 4
