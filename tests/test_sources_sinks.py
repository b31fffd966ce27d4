import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from terraweave.operators import osm
from terraweave.plans import mapping, turtle
from terraweave.plans.config import Config
from terraweave.plans.pipeline import Forward, reverse, scan, write_reverse
from terraweave.plans.rml import RmlBuilder, RmlMapping, augmented
from terraweave.sinks import features as sinks
from terraweave.sinks import rdf as rdf_sinks
from terraweave.sources import binary, nested, rdf, tabular
from terraweave.streaming import forward

CSV = 'osm_id|type|lon|lat|name\nN1|BUS|10.5|59.5|"Ole ""B"" | x"\nN2|BUS|200|5|Far\nN3|CAFE|10.6|59.6|Kaffe\nN4|BUS||59|None\n'
CONF = "inputFormat = CSV\ndelimiter = |\nattrKey = osm_id\nattrName = name\nattrX = lon\nattrY = lat\nfeatureSource = src\nprefixes = own\nnamespaces = http://example.org/def#\nregisterFeatures = true\nattrCategory = type\n"


def write(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_forward_and_back(spark, tmp_path):
    pois, spec = write(tmp_path / "a.csv", "﻿" + CSV), write(tmp_path / "m.yml", "URI:\n  entity: uri\n  generateWith: getUUID(DATA_SOURCE,osm_id)\nname:\n  entity: n\n  predicate: own:name\nosm_id:\n  entity: i\n  predicate: own:ref\n")
    scheme = write(tmp_path / "c.csv", "a,b\n1,BUS\n2,CAFE\n")
    c = __import__("terraweave.plans.config", fromlist=["load"]).load(
        CONF + f"inputFiles = {pois}\nmappingSpec = {spec}\nclassificationSpec = {scheme}\noutputDir = {tmp_path}/out\nmode = GRAPH\nserialization = TURTLE\nspatialExtent = POLYGON((0 0, 20 0, 20 70, 0 70, 0 0))\nfilterSQLCondition = type = 'BUS' OR type = 'CAFE'\n"
    )
    run = Forward(spark, c)
    assert sorted(r.osm_id for r in run.features.collect()) == ["N1", "N3"]
    run.write()
    meta = json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/out/metadata").collect()))
    assert meta["records"]["input"] == 2 and meta["mbr"] == {"xmin": 10.5, "ymin": 59.5, "xmax": 10.6, "ymax": 59.6} and meta["attributes"]["name"] == 2
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out/registry").collect()]
    assert any(line.endswith("|N3|Kaffe|CAFE|10.6|59.6") for line in lines)
    query = write(tmp_path / "q.rq", "PREFIX own: <http://example.org/def#> PREFIX geo: <http://www.opengis.net/ont/geosparql#> SELECT ?ref ?name ?shape { ?u own:ref ?ref ; own:name ?name ; geo:hasGeometry ?g . ?g geo:asWKT ?shape }")
    for kind in ("CSV", "GEOJSON", "SHAPEFILE"):
        back = Config(format=kind, inputs=[f"{tmp_path}/out/triples"], serialization="TURTLE", sparql=query, output=f"{tmp_path}/back-{kind}")
        assert sorted(r.ref for r in reverse(spark, back).collect()) == ["N1", "N3"]
        write_reverse(spark, back)
    doc = json.loads("\n".join(r.value for r in spark.read.text(f"{tmp_path}/back-GEOJSON").collect()))
    assert sorted(f["geometry"]["coordinates"] for f in doc["features"]) == [[10.5, 59.5], [10.6, 59.6]]
    shp = scan(spark, Config(format="SHAPEFILE", inputs=[f"{tmp_path}/back-SHAPEFILE*"]))
    assert sorted((r.wkt, r.attrs["ref"]) for r in shp.collect()) == [("POINT (10.5 59.5)", "N1"), ("POINT (10.6 59.6)", "N3")]
    csv = spark.read.option("header", True).csv(f"{tmp_path}/back-CSV").collect()
    assert {r.shape for r in csv} == {"SRID=4326;POINT (10.5 59.5)", "SRID=4326;POINT (10.6 59.6)"}


def test_csv_of_other_encodings(spark, tmp_path):
    p = write(tmp_path / "u.csv", b"\xff\xfe" + "id;name\n1;é\n".encode("utf-16-le"))
    assert tabular.csv(spark, [p], Config(delimiter=";")).first().asDict() == {"id": "1", "name": "é"}


def test_database_statements():
    c = Config(table="t1", condition="a > 1", geometry_attr="geom", source_crs="EPSG:2100", target_crs="EPSG:4326", jdbc={"type": "PostGIS", "host": "h", "port": "5", "name": "d"})
    assert tabular.query_text(c) == "SELECT t.*, ST_AsText(ST_Transform(t.geom, 4326)) AS wkt FROM t1 t WHERE (a > 1)"
    assert tabular.jdbc_options(c)["url"] == "jdbc:postgresql://h:5/d"
    for kind in tabular.DIALECTS:
        assert "FROM t1" in tabular.query_text(Config(table="t1", geometry_attr="g", jdbc={"type": kind}))


def test_json_and_geojson(spark, tmp_path):
    p = write(tmp_path / "a.json", json.dumps({"items": [{"id": 1, "a": {"b": "x", "c": None}, "tags": ["p"], "media": [{"u": "1"}, {"u": "2"}], "ok": True}, {}]}))
    rows = nested.json_file(spark, p).collect()
    assert [r.attrs for r in rows] == [{"id": "1", "a.b": "x", "media.0.u": "1", "media.1.u": "2", "ok": "true"}]
    feature = lambda g, **p: {"type": "Feature", "id": "f", "properties": p, "geometry": g}
    shapes = {"Point": [1, 2.5], "LineString": [[1, 2], [3, 4]], "Polygon": [[[0, 0], [1, 0], [1, 1], [0, 0]]], "MultiPolygon": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}
    p = write(tmp_path / "a.geojson", json.dumps({"type": "FeatureCollection", "features": [feature({"type": k, "coordinates": c}, n=k) for k, c in shapes.items()]}))
    got = {r.attrs["n"]: r.wkt for r in nested.geojson(spark, p).collect()}
    assert got == {"Point": "POINT (1 2.5)", "LineString": "LINESTRING (1 2, 3 4)", "Polygon": "POLYGON ((0 0, 1 0, 1 1, 0 0))", "MultiPolygon": "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))"}


def test_gpx(spark, tmp_path):
    p = write(
        tmp_path / "a.gpx",
        '<gpx><wpt lat="1.50" lon="2"><name>W</name><extensions><d>x</d></extensions></wpt><wpt lat="3" lon="4"><name>V</name></wpt>'
        '<trk><name>T</name><trkseg><trkpt lat="1" lon="2"/><trkpt lat="3" lon="4"/></trkseg><trkseg><trkpt lat="5" lon="6"/><trkpt lat="7" lon="8"/></trkseg></trk></gpx>',
    )
    got = {r.attrs["name"]: r.wkt for r in nested.gpx(spark, p).collect()}
    assert got == {"W": "POINT (2 1.50)", "V": "POINT (4 3)", "T": "MULTILINESTRING ((2 1, 4 3), (6 5, 8 7))"}


OSM = """<osm><node id="1" lat="0" lon="0"><tag k="name" v="A"/><tag k="amenity" v="cafe"/></node><node id="2" lat="0" lon="4"/><node id="3" lat="4" lon="4"/><node id="4" lat="4" lon="0"/>
<node id="5" lat="1" lon="1"/><node id="6" lat="1" lon="2"/><node id="7" lat="2" lon="2"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="name" v="half"/></way><way id="11"><nd ref="1"/><nd ref="4"/><nd ref="3"/></way><way id="12"><nd ref="5"/><nd ref="6"/><nd ref="7"/><nd ref="99"/><nd ref="5"/></way>
<relation id="20"><member type="way" ref="10" role="outer"/><member type="way" ref="11" role="outer"/><member type="way" ref="12" role="inner"/><tag k="type" v="multipolygon"/><tag k="name" v="R"/></relation>
<relation id="21"><member type="relation" ref="20" role=""/><tag k="name" v="outer"/></relation></osm>"""


def test_osm(spark, tmp_path):
    p = write(tmp_path / "a.osm", OSM)
    nodes, ways, relations = nested.osm_xml(spark, p)
    lines = osm.way_lines(ways, nodes)
    assert {r.id: r.wkt for r in lines.collect()}["10"] == "LINESTRING (0 0, 4 0, 4 4)"
    shapes = {r.id: r.wkt for r in osm.relation_geometries(relations, osm.node_points(nodes), lines).collect()}
    want = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))"
    assert shapes == {"20": want, "21": want}
    assert {r.fid for r in scan(spark, Config(format="OSM_XML", inputs=[p])).collect()} >= {"node/1", "node/2", "way/11", "relation/20"}
    got = scan(spark, Config(format="OSM_XML", inputs=[p], named_only=True)).collect()
    assert sorted(r.fid for r in got) == ["node/1", "relation/20", "relation/21", "way/10"] and got[0].attrs["osm_id"] == got[0].fid
    rules = osm.parse_rules("amenity=\n  =cafe EAT_CAFE\n")
    assert [r.attrs["OSM_Category"] for r in scan(spark, Config(format="OSM_XML", inputs=[p]), rules).collect()] == ["EAT_CAFE"]
    assert osm.scheme_rows(osm.rule_categories(rules)) == [("EAT", "EAT", "EAT_CAFE", "CAFE")]
    for bad in ("amenity\n", "=x Y\n", "a=b\n"):
        with pytest.raises(osm.RuleError):
            osm.parse_rules(bad)


def _varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 0x7F
        out += bytes([low | (0x80 if n else 0)])
        if not n:
            return out


def _field(n, v):
    return _varint(n << 3) + _varint(v) if isinstance(v, int) else _varint(n << 3 | 2) + _varint(len(v)) + v


def _zig(n):
    return _varint(n << 1 if n >= 0 else (-n << 1) - 1)


def test_pbf(spark, tmp_path):
    strings = b"".join(_field(1, s) for s in (b"", b"name", b"A", b"outer"))
    dense = _field(1, _zig(5) + _zig(1)) + _field(8, _zig(15_000_000) + _zig(-1)) + _field(9, _zig(20_000_000) + _zig(10)) + _field(10, bytes([1, 2, 0, 0]))
    way = _field(1, 9) + _field(2, bytes([1])) + _field(3, bytes([2])) + _field(8, _zig(5) + _zig(1))
    rel = _field(1, 3) + _field(8, bytes([3])) + _field(9, _zig(9)) + _field(10, bytes([1]))
    block = _field(1, strings) + _field(2, _field(2, dense)) + _field(2, _field(3, way)) + _field(2, _field(4, rel))
    blob = _field(2, len(block)) + _field(3, zlib.compress(block))
    head = _field(1, b"OSMData") + _field(3, len(blob))
    p = write(tmp_path / "a.osm.pbf", struct.pack(">I", len(head)) + head + blob)
    nodes, ways, relations = binary.osm_pbf(spark, p)
    assert [(r.id, r.lon, r.lat, r.tags) for r in nodes.collect()] == [("5", "2.0", "1.5", {"name": "A"}), ("6", "2.000001", "1.4999999", {})]
    assert ways.first().refs == ["5", "6"] and relations.first().members[0].asDict() == {"ref": "9", "type": "way", "role": "outer"}


@pytest.mark.parametrize("kind", ["MULTIPOLYGON", "MULTILINESTRING"])
def test_shapefiles(spark, tmp_path, kind):
    shapes = ["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))", "LINESTRING (0 0, 1 1)", "POINT (1 1)", None]
    df = spark.createDataFrame([(str(i), w) for i, w in enumerate(shapes)], "id string, g string")
    sinks.write_shapefile(df, str(tmp_path / "out"), "g", kind)
    got = binary.shapefile(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].attrs["id"] == ("0" if kind == "MULTIPOLYGON" else "1")
    assert got[0].wkt.startswith("POLYGON ((" if kind == "MULTIPOLYGON" else "LINESTRING (0 0, 1 1)")
    blob = spark.createDataFrame([(bytearray(struct.pack("<i2d", 1, 3, 4)),), (bytearray(b"x"),), (None,)], "b binary")
    assert [r[0] for r in blob.select(binary.geodatabase_wkt("b")).collect()] == ["POINT (3 4)", None, None]


def test_xml_features(spark, tmp_path):
    kml = write(
        tmp_path / "a.kml",
        '<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark id="p1"><name>A</name><Point><coordinates>1,2,0</coordinates></Point></Placemark><Placemark><name>B</name><MultiGeometry><Point><coordinates>1,2</coordinates></Point>'
        "<Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></MultiGeometry></Placemark></Document></kml>",
    )
    got = {r.attrs["name"]: (r.fid, r.wkt) for r in nested.xml_features(spark, kml, "Placemark").collect()}
    assert got == {"A": ("p1", "POINT (1 2)"), "B": ("Placemark1", "GEOMETRYCOLLECTION (POINT (1 2), POLYGON ((0 0, 1 0, 1 1, 0 0)))")}
    gml = write(
        tmp_path / "a.gml",
        '<c xmlns:gml="http://www.opengis.net/gml" xmlns:x="http://x"><gml:featureMember><x:road fid="r1"><x:n>N</x:n><x:g><gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 1 0 1 1 0 0</gml:posList>'
        "</gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></x:g></x:road></gml:featureMember></c>",
    )
    r = nested.xml_features(spark, gml, "road").first()
    assert (r.fid, r.wkt, r.attrs) == ("r1", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", {"n": "N"})


TRIPLES = [
    ("http://e/a", "http://e/p#name", 'a "q" \\ \n\t<&> é', "literal", None, "en"),
    ("http://e/a", "http://e/p#n", "5", "literal", "http://www.w3.org/2001/XMLSchema#integer", None),
    ("http://e/a", "http://e/p#link", "http://e/b?x=1&y=2", "uri", None, None),
    ("_:b0", "http://e/p#n", "plain", "literal", None, None),
]


@pytest.mark.parametrize("kind", ["N-TRIPLES", "TURTLE", "RDF/XML"])
def test_graph_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame(TRIPLES, rdf.SCHEMA)
    rdf_sinks.write(df, str(tmp_path / "g"), kind)
    assert sorted(map(tuple, rdf.read(spark, str(tmp_path / "g"), kind).collect()), key=str) == sorted(TRIPLES, key=str)


def test_rml(spark):
    text = """@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix o: <http://o/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
    <#M> rr:subjectMap [ rr:template "http://i/{UUID}" ; rr:class o:A ; rr:class o:B ] ; rr:predicateObjectMap [ rr:predicate o:n ; rr:objectMap [ rml:reference "NAME" ; rr:datatype xsd:string ] ] ;
      rr:predicateObjectMap [ rr:predicate o:c ; rr:objectMap [ rr:constant <http://c> ] ; rr:objectMap [ rr:constant "lit" ; rr:language "en" ] ] ; rr:predicateObjectMap [ rr:predicate o:p ; rr:objectMap [ rr:template "http://t/{GONE}" ; rr:class o:T ] ] ."""
    df = spark.createDataFrame([("1", "x")], "id string, name string")
    got = RmlBuilder(RmlMapping(text)).triples(augmented(df, "s", "id")).collect()
    assert sorted((r.p.rpartition("/")[2], r.o) for r in got) == [("22-rdf-syntax-ns#type", "http://o/A"), ("22-rdf-syntax-ns#type", "http://o/B"), ("c", "http://c"), ("c", "lit"), ("n", "x")]
    assert len(turtle.read('<a> <b> "x\\u00e9" .')) == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "1.csv", "1,BUS,POINT (1 1)\n2,CAFE,POINT (2 2)\n")
    stream = spark.readStream.schema("osm_id string, type string, wkt string").csv(str(tmp_path / "in"))
    c = Config(source="s", key_attr="osm_id", condition="type = 'BUS'", output=str(tmp_path / "out"))
    spec = mapping.load("URI:\n  entity: uri\n  generateWith: keepOriginalID(osm_id)\n")
    for n in (7, 14):
        forward.start(stream, c, spec, str(tmp_path / "cp")).awaitTermination(60)
        assert spark.read.text(str(tmp_path / "out")).count() == n
        write(tmp_path / "in" / "2.csv", "3,BUS,POINT (1 1)\n")


def test_another_reference_system_is_an_error(spark):
    df = spark.createDataFrame([("<http://www.opengis.net/def/crs/EPSG/0/2100> POINT (1 1)",)], "g string")
    with pytest.raises(Exception, match="2100"):
        df.select(sinks.checked_wkt(F.col("g"), 4326)).collect()


def test_large_shapefiles_are_several(spark, tmp_path, monkeypatch):
    """No task and not the driver holds more than a part takes."""
    monkeypatch.setattr(sinks, "PART_ROWS", 2000)
    rows = spark.range(7000, numPartitions=2).select(F.col("id").cast("string").alias("k"), F.concat(F.lit("POINT ("), F.col("id").cast("string"), F.lit(" 1)")).alias("shape"))
    sinks.write_shapefile(rows, f"{tmp_path}/p", "shape", "POINT")
    found = list(tmp_path.glob("*.shp"))
    assert len(found) == 4 and (tmp_path / "p-0.shp").exists() and (tmp_path / "p-0_3.prj").exists()
    back = binary.shapefile(spark, str(tmp_path)).select(F.col("attrs")["k"].alias("k"), "wkt").collect()
    assert sorted((int(r.k), r.wkt) for r in back) == [(i, f"POINT ({i} 1)") for i in range(7000)]
