from terraweave.__main__ import main
from terraweave.plans.config import Config
from terraweave.plans.pipeline import xml_triples
from terraweave.sources import nested, xml_graph

GML = b"""<c xmlns:gml="http://www.opengis.net/gml" gml:id="d"><gml:boundedBy><gml:Box><gml:coord><gml:X>0</gml:X><gml:Y>1</gml:Y></gml:coord><gml:coord><gml:X>2</gml:X><gml:Y>3</gml:Y></gml:coord></gml:Box></gml:boundedBy>
<gml:featureMember><place fid="7"><NAME>P</NAME><HEIGHT> 5 </HEIGHT><shape><gml:Point><gml:coordinates>4,5</gml:coordinates></gml:Point></shape></place></gml:featureMember></c>"""
KML = b"""<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark id="k"><name>N</name><description>d</description><MultiGeometry><Point><coordinates>1,2,0</coordinates></Point>
<LineString><coordinates>1,2 3,4</coordinates></LineString></MultiGeometry></Placemark></Document></kml>"""
UNIT = b"""<r xmlns:au="urn:x-inspire:specification:gmlas:AdministrativeUnits:3.0" xmlns:gn="urn:x-inspire:specification:gmlas:GeographicalNames:3.0" xmlns:base="urn:x-inspire:specification:gmlas:BaseTypes:3.2" xmlns:gml="http://www.opengis.net/gml/3.2">
<au:AdministrativeUnit gml:id="g"><au:inspireId><base:Identifier><base:localId>L1</base:localId></base:Identifier></au:inspireId><au:geometry><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 1 0 1 1 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></au:geometry>
<au:name><gn:GeographicalName><gn:language>ita</gn:language><gn:spelling><gn:SpellingOfName><gn:text>Roma</gn:text></gn:SpellingOfName></gn:spelling></gn:GeographicalName></au:name></au:AdministrativeUnit></r>"""
RECORD = """<gmd:MD_Metadata xmlns:gmd="http://www.isotc211.org/2005/gmd" xmlns:gco="http://www.isotc211.org/2005/gco"><gmd:fileIdentifier><gco:CharacterString>f1</gco:CharacterString></gmd:fileIdentifier>
<gmd:identificationInfo><gmd:citation><gmd:title><gco:CharacterString>T</gco:CharacterString></gmd:title></gmd:citation><gmd:language>en</gmd:language><gmd:geographicElement><gmd:westBoundLongitude>%s</gmd:westBoundLongitude>
<gmd:eastBoundLongitude>2</gmd:eastBoundLongitude><gmd:southBoundLatitude>3</gmd:southBoundLatitude><gmd:northBoundLatitude>4</gmd:northBoundLatitude></gmd:geographicElement></gmd:identificationInfo></gmd:MD_Metadata>"""
B = "http://example.org/id/"
WKT = "http://www.opengis.net/ont/geosparql#asWKT"


def of(found, s, p):
    return [t[2] for t in found if t[0] == s and t[1] == p]


def test_features():
    found = xml_graph.document_triples(GML, xml_graph.GML)
    assert of(found, B + "boundary/d", WKT) == ["POLYGON ((0 1, 2 1, 2 3, 0 3, 0 1))"]
    assert of(found, B + "7", xml_graph.LABEL) == ["P"] and of(found, B + "7", "HEIGHT") == ["5"] and of(found, B + "geometry/7", WKT) == ["POINT (4 5)"]
    found = xml_graph.document_triples(KML, xml_graph.KML)
    assert of(found, B + "k", xml_graph.LABEL) == ["N"] and of(found, B + "geometry/k", WKT) == ["GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (1 2, 3 4))"] and len(found) == 3


def test_inspire():
    found = xml_graph.document_triples(UNIT, xml_graph.inspire("units"))
    me, au = B + "AdministrativeUnit/units/", xml_graph.INSPIRE + "au/3.0/"
    assert of(found, me + "L1", au + "inspireId") == [me + "inspireId/L1"] and of(found, me + "inspireId/L1", xml_graph.INSPIRE + "base/3.2/localId") == ["L1"]
    assert of(found, me + "L1", au + "geometry") == [me + "geometry/L1"] and of(found, me + "geometry/L1", WKT) == ["POLYGON ((0 0, 1 0, 1 1, 0 0))"]
    assert [t for t in found if t[2] == "Roma"] == [(me + "SpellingOfName/L1", xml_graph.INSPIRE + "gn/3.0/text", "Roma", "literal", None, "it")]


def test_metadata():
    found = xml_graph.metadata_triples(RECORD % "1")
    assert of(found, "urn:uuid:f1#dataset", xml_graph.DCT + "title") == ["T"]
    assert [t[2] for t in found if t[1].endswith("locn#geometry")] == ["POLYGON ((1 3, 2 3, 2 4, 1 4, 1 3))"]
    assert xml_graph.metadata_triples(RECORD % "-180") == []


def test_files_and_command(spark, tmp_path):
    (tmp_path / "a.gml").write_bytes(GML)
    got = xml_triples(spark, Config(format="GML", inputs=[f"{tmp_path}/a.gml"], feature_ns=B))
    assert {tuple(r) for r in got.collect()} == set(xml_graph.document_triples(GML, xml_graph.GML))
    assert main(["nothing"]) == 2


def test_gpx_extensions(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(
        '<gpx xmlns:e="urn:e"><wpt lat="1" lon="2"><name>W</name><ele>7</ele><extensions><e:Point e:kind="x"><e:Mode>M</e:Mode><e:Names><e:Name>a</e:Name></e:Names></e:Point></extensions></wpt>'
        '<trk><name>T</name><extensions><e:T><e:Color>Red</e:Color></e:T></extensions><trkseg><trkpt lat="1" lon="2"/><trkpt lat="3" lon="4"/></trkseg></trk></gpx>'
    )
    got = {r.fid: r.attrs for r in nested.gpx(spark, f"{tmp_path}/a.gpx").collect()}
    assert got == {"wpt/W": {"name": "W", "ele": "7", "Mode": "M", "Names": "a"}, "trk/T": {"name": "T", "Color": "Red"}}
