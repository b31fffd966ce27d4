import pytest
from pyspark.sql import functions as F

from terraweave.functions import registry
from terraweave.operators import classification
from terraweave.operators.triples import TripleBuilder, as_graph
from terraweave.plans import config, expression, mapping, sparql, turtle
from terraweave.plans.pipeline import sanity

MAPPING = """﻿URI:   ## a comment
  entity: uri
  generateWith: getUUID(DATA_SOURCE,osm_id)
osm_id:
  partOf: sourceInfo
  entity: source
  predicate: own:ref
DATA_SOURCE:
  partOf: sourceInfo
  entity: source
  predicate: own:sourceRef
  generateWith: getDataSource
CATEGORY_URI:
  entity: category
  predicate: own:category
  datatype: uri
name:
  instanceOf: name
  entity: name
  predicate: own:name
  type: official
  language: en
GEOHASH:
  entity: geohash
  predicate: own:geoHash
  datatype: string
  generateWith: geometry.getGeoHash(10)
TRANSLIT:
  instanceOf: name
  entity: translit
  predicate: own:name
  type: NONE
  language: zz
  generateWith: getTransliteration(name)
"""
CONF = config.Config(source="OSM", prefixes=["own"], namespaces=["http://example.org/def#"], key_attr="osm_id")


def test_config():
    c = config.load("# x\nmode = GRAPH\ninputFiles = a.csv; b.csv\nsourceCRS=EPSG:2100\nbatchSize=99999\nprefixes = a, b\nnamespaces = http://a#, http://b#\ndbHost = h\nregisterFeatures = true\nattrCategory = t, c\n")
    assert (c.mode, c.inputs, c.source_srid, c.target_srid, c.batch_size) == ("GRAPH", ["a.csv", "b.csv"], 2100, 2100, 1000)
    assert c.prefix_map() == {"a": "http://a#", "b": "http://b#"} and c.jdbc == {"host": "h"} and c.register and c.category_attrs == ["t", "c"]
    with pytest.raises(config.ConfigError):
        config.load("mode = NONE")


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        ("type='BUS' AND name LIKE 'Maj?r%n'", ["a", "b"]),
        ("type='BUS' OR (n > '5' AND type <> 'X')", ["a", "b", "c"]),
        ("missing <> 'x'", ["a", "b", "c"]),
        ("missing = 'x'", []),
        ("n <= '10' AND n >= '2'", ["a", "c"]),
        ("n < 'abc'", []),
        ("'BUS' = type", ["a", "b"]),
        ("ORIGIN = '1'", ["c"]),
        ("name LIKE 'a.%'", ["c"]),
    ],
)
def test_expression(spark, condition, want):
    rows = [("a", "BUS", "Majorstuen", "2", None), ("b", "BUS", "Majorsgatan", "x", None), ("c", "T", "a.b", "10", "1")]
    df = spark.createDataFrame(rows, "id string, type string, name string, n string, ORIGIN string")
    find = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    assert [r.id for r in df.filter(expression.compile_filter(condition, find)).orderBy("id").collect()] == want


@pytest.mark.parametrize("bad", ["a =", "a = 'x' AND", "(a = 'x'", "a ~ 'x'", "a = 'x' b"])
def test_bad_expressions(spark, bad):
    with pytest.raises(expression.ExpressionError):
        expression.compile_filter(bad, F.col)


def test_worked_example(spark):
    """A bus stop's triples, written out by hand."""
    df = spark.createDataFrame([("N755", "Majorstuen", "POINT (10.7160479 59.9296625)", "http://example.org/id/term/t1")], "osm_id string, name string, wkt string, CATEGORY_URI string")
    got = {tuple(r) for r in TripleBuilder(CONF, mapping.load(MAPPING)).triples(df).collect()}
    u = next(s for s, p, o, *_ in got if o.endswith("#Feature"))
    own, rdf_type = "http://example.org/def#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    geo = "http://www.opengis.net/ont/geosparql#"
    want = {
        (u, geo + "hasGeometry", u + "/geom", "uri", None, None),
        (u + "/geom", rdf_type, "http://www.opengis.net/ont/sf#POINT", "uri", None, None),
        (u + "/geom", geo + "asWKT", "<http://www.opengis.net/def/crs/EPSG/0/4326> POINT (10.7160479 59.9296625)", "literal", geo + "wktLiteral", None),
        (u, rdf_type, geo + "Feature", "uri", None, None),
        (u, own + "source", u + "/sourceInfo", "uri", None, None),
        (u + "/sourceInfo", rdf_type, own + "sourceInfo", "uri", None, None),
        (u + "/sourceInfo", own + "ref", "N755", "literal", None, None),
        (u + "/sourceInfo", own + "sourceRef", "OSM", "literal", None, None),
        (u, own + "category", "http://example.org/id/term/t1", "uri", None, None),
        (u, own + "name", u + "/name", "uri", None, None),
        (u + "/name", own + "nameValue", "Majorstuen", "literal", None, "en"),
        (u + "/name", own + "language", "en", "literal", None, None),
        (u + "/name", own + "nameType", "official", "literal", None, None),
        (u + "/name", rdf_type, own + "name", "uri", None, None),
        (u, own + "geoHash", "u4xsgvg5w4", "literal", "http://www.w3.org/2001/XMLSchema#string", None),
        (u, own + "name", u + "/translit", "uri", None, None),
        (u + "/translit", own + "nameValue", "Majorstuen", "literal", None, None),
        (u + "/translit", rdf_type, own + "name", "uri", None, None),
    }
    assert got == want


def test_null_geometry_and_values(spark):
    df = spark.createDataFrame([("1", None, None, None)], "osm_id string, name string, wkt string, CATEGORY_URI string")
    got = TripleBuilder(CONF, mapping.load(MAPPING)).triples(df).collect()
    assert {r.p.rpartition("#")[2] for r in got} == {"source", "type", "ref", "sourceRef"}


def test_profiles_and_unknown_functions():
    rules = mapping.load(MAPPING).rules
    assert [rules[k].profile for k in ("osm_id", "CATEGORY_URI", "name", "GEOHASH", "URI")] == ["PART", "URL", "INSTANCE_LANG", "TYPED", "URI"]
    with pytest.raises(KeyError):
        registry.call("nothing", [], lambda n: None, CONF)


def test_registered_function(spark):
    registry.register("shout", lambda v: F.upper(v))
    df = spark.createDataFrame([("1", "x", None)], "osm_id string, name string, wkt string")
    rules = mapping.load("URI:\n  entity: uri\n  generateWith: keepOriginalID(osm_id)\nLOUD:\n  entity: l\n  predicate: own:l\n  generateWith: shout(name)\n")
    got = TripleBuilder(CONF, rules).triples(df).collect()
    assert [(r.s, r.o) for r in got] == [("http://example.org/id/feature/1", "X")]


def test_schemes(spark):
    rows = classification.parse_csv('"a","b","c","d"\n"A","ACC",1,"HOTEL"\n"A","ACC",2,"INN"\n"B","BUS","",""\n')
    again = classification.parse_indented("ACC #A\n  HOTEL #1\n  INN #2\nBUS #B\n")
    key = lambda cs: sorted((c.id, c.name, c.parent_id or "", c.level) for c in cs)
    assert key(rows) == key(again)
    with pytest.raises(classification.SchemeError):
        classification.parse_indented("A #1\n      B #2\n")
    dictionary = classification.parse_dictionary("STAY\n  HOTEL\n  INN\nSHOP\n  BAKERY\n")
    got = {r.name: (r.embed_category, round(r.embed_score, 3)) for r in classification.embed(classification.frame(spark, rows), dictionary).collect()}
    assert got["HOTEL"] == ("STAY", 1.0) and got["INN"] == ("STAY", 1.0)
    lines = [r.line for r in classification.listing(classification.frame(spark, rows)).orderBy("path").collect()]
    assert lines == ["ACC #A", "  HOTEL #1", "  INN #2", "BUS #B"]


GRAPH = """@prefix e: <http://e/> . @base <http://base/> .
e:a e:name "A"@en , "Ah" ; e:age 5 ; e:knows e:b , [ e:name "blank" ] .
e:b a e:Person ; e:name "B \\"q\\"" . <c> e:age "7"^^e:int ."""


@pytest.fixture
def graph(spark):
    return spark.createDataFrame(turtle.read(GRAPH), "s string, p string, o string, o_kind string, dt string, lang string")


P = "PREFIX e: <http://e/> "


@pytest.mark.parametrize(
    ("query", "want"),
    [
        (P + "SELECT ?n WHERE { ?x a e:Person ; e:name ?n }", [('B "q"',)]),
        (P + "SELECT ?n { ?x e:name ?n FILTER(LANG(?n) = 'en') }", [("A",)]),
        (P + "SELECT ?x ?n { ?x e:age ?g OPTIONAL { ?x e:name ?n } } ORDER BY ?x ?n", [("http://base/c", ""), ("http://e/a", "A"), ("http://e/a", "Ah")]),
        (P + "SELECT ?m { e:a e:knows ?k . ?k e:name ?m } ORDER BY DESC(?m)", [("blank",), ('B "q"',)]),
        (P + "SELECT (SUM(?g) AS ?t) (COUNT(*) AS ?n) { ?x e:age ?g }", [("12.0", "2")]),
        (P + "SELECT ?x { ?x e:name ?n FILTER(!BOUND(?z) || ?n = 'x') } LIMIT 1 OFFSET 9", None),
        (P + "SELECT DISTINCT ?x { { ?x e:age ?g } UNION { ?x e:name ?n } } ORDER BY ?x", [("_:gx1",), ("http://base/c",), ("http://e/a",), ("http://e/b",)]),
        (P + "SELECT ?x { ?x e:age ?g FILTER(?g >= 6 && isIRI(?x)) }", [("http://base/c",)]),
        (P + "SELECT ?d { ?x e:age ?g FILTER(DATATYPE(?g) = 'http://e/int') OPTIONAL { ?x e:none ?d } }", [("",)]),
        (P + "SELECT ?n ?g { OPTIONAL { ?x e:age ?g } OPTIONAL { ?x e:name ?n } } ORDER BY ?n", [("", "7"), ("A", "5"), ("Ah", "5")]),
    ],
)
def test_sparql(spark, graph, query, want):
    if want is None:
        with pytest.raises(Exception):  # noqa: B017
            sparql.select(graph, query).collect()
    else:
        assert [tuple(r) for r in sparql.select(graph, query).collect()] == want


def test_bad_sparql():
    for bad in ("SELECT", "ASK { }", "SELECT ?x { ?x }", "SELECT ?x { ?x ?y ?z } NONSENSE"):
        with pytest.raises((sparql.SparqlError, IndexError)):
            sparql.parse(bad)


def test_bag_and_set(spark, graph):
    twice = graph.unionByName(graph)
    assert as_graph(twice).count() == graph.count()
    assert sanity(graph).first().triples == graph.count()
