import math
import uuid

import pytest
from pyspark.sql import functions as F

from terraweave.functions import crs, geometry, text
from terraweave.operators.filters import crosses_itself, is_valid


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def g(wkt):
    return geometry.parse(F.lit(wkt))


def test_uuid_is_that_of_the_name(spark):
    for key in ("", "sourceN755", "é漢"):
        h = bytearray(__import__("hashlib").md5(key.encode()).digest())
        h[6], h[8] = h[6] & 0x0F | 0x30, h[8] & 0x3F | 0x80
        assert one(spark, text.uuid_v3(F.lit(key)))[0] == str(uuid.UUID(bytes=bytes(h)))


@pytest.mark.parametrize(("number", "want"), [("0211 / 12-34", "+302111234"), ("00302109999", "+302109999"), ("+49 30", "+4930"), ("0", None), ("abc", None), (None, None), ("1234", "1234")])
def test_phone(spark, number, want):
    assert one(spark, text.phone(F.lit(number).cast("string"), F.lit("30")))[0] == want


def test_text_functions(spark):
    assert one(spark, text.without_illegal(F.lit('a"b\\c|d\te')), text.without_delimiter(F.lit("a|b")), text.without_delimiter(F.lit(None).cast("string"))) == ("a'b c d e", "a;b", "")
    assert one(spark, text.clean_url(F.lit("www.x.org\\a<b>")), text.clean_url(F.lit("https://x.org/é"))) == ("http://www.x.org/ab", "https://x.org/")
    assert one(spark, text.standard_date(F.lit("20200131"), "yyyyMMdd"), text.standard_date(F.lit("junk"), "yyyyMMdd")) == ("2020-01-31 00:00:00.000", None)
    assert one(spark, text.has_value(F.lit("Nullarbor")), text.has_value(F.lit("null"))) == (False, True)
    assert one(spark, text.transliterate(F.lit("Çöl Десяточка Αθήνα")))[0] == "Col Desatocka Athina"
    assert one(spark, F.round(text.similarity(F.lit("MARTHA"), F.lit("MARHTA")), 4))[0] == 0.9611


def test_geohash_of_a_known_place(spark):
    assert one(spark, geometry.geohash(F.lit(-5.6), F.lit(42.6), 5), geometry.geohash(F.lit(10.7160479), F.lit(59.9296625), 10)) == ("ezs42", "u4xsgvg5w4")


SQUARE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))"
MANY = "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((10 0, 12 0, 12 2, 10 2, 10 0)))"


def test_measures(spark):
    assert one(spark, geometry.area(g(SQUARE)), geometry.length(g(SQUARE)), geometry.area(g(MANY))) == (15.0, 20.0, 8.0)
    c = one(spark, geometry.centroid(g(MANY)), geometry.centroid(g("LINESTRING (0 0, 2 0, 2 6)")), geometry.centroid(g("MULTIPOINT ((0 0), (4 2))")), geometry.centroid(g("POINT(3 4)")))
    assert [(round(p.x, 6), round(p.y, 6)) for p in c] == [(6, 1), (1.75, 2.25), (2, 1), (3, 4)]
    assert one(spark, geometry.bounds(g(MANY)))[0].asDict() == {"xmin": 0, "ymin": 0, "xmax": 12, "ymax": 2}
    assert one(spark, geometry.area(g("nonsense")), geometry.to_wkt(g("EMPTY")))[1] is None


@pytest.mark.parametrize("wkt", ["POINT (1.5 2.0)", "LINESTRING (0.0 0.0, 1.0 1.0)", SQUARE, MANY, "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOINT ((1 2), (3 4))"])
def test_text_round_trip(spark, wkt):
    again = one(spark, geometry.to_wkt(g(wkt)))[0]
    assert one(spark, geometry.parse(F.lit(again)) == g(wkt))[0]


def test_contains_and_validity(spark):
    hole = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
    assert one(spark, *[geometry.contains(hole, g(w)) for w in ("POINT (1 1)", "POINT (5 5)", "POINT (11 1)", "LINESTRING (1 1, 2 2)", "LINESTRING (1 1, 12 2)")]) == (True, False, False, True, False)
    assert one(spark, *[is_valid(g(w)) for w in (SQUARE, "POLYGON ((0 0, 1 1, 0 0))", "LINESTRING (1 1, 1 1)", "POINT (1 1)")]) == (True, False, False, True)


def test_extents_with_notches_and_holes(spark):
    notch = "POLYGON ((0 0, 10 0, 10 10, 6 10, 6 4, 4 4, 4 10, 0 10, 0 0))"
    hole = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
    got = [geometry.contains(e, g(w)) for e, w in ((notch, "LINESTRING (1 9, 9 9)"), (notch, "LINESTRING (1 1, 9 1)"), (hole, "POLYGON ((1 1, 9 1, 9 9, 1 9, 1 1))"), (hole, "POLYGON ((1 1, 3 1, 3 3, 1 1))"))]
    assert one(spark, *got) == (False, True, False, True)


def test_collections(spark):
    wkt = "GEOMETRYCOLLECTION (POINT (1.0 2.0), MULTIPOLYGON (((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 4.0, 0.0 0.0)), ((9.0 9.0, 10.0 9.0, 10.0 10.0, 9.0 9.0))), LINESTRING (0.0 0.0, 3.0 4.0))"
    c = g(wkt)
    assert one(spark, geometry.to_wkt(c), geometry.area(c), geometry.length(c)) == (wkt, 16.5, pytest.approx(16 + 2 + 2**0.5 + 5))
    assert one(spark, geometry.to_wkt(g("GEOMETRYCOLLECTION (GEOMETRYCOLLECTION (POINT (1 2)), POINT (3 4))")))[0] == "GEOMETRYCOLLECTION (POINT (1.0 2.0), POINT (3.0 4.0))"
    assert one(spark, geometry.bounds(c))[0].asDict() == {"xmin": 0, "ymin": 0, "xmax": 10, "ymax": 10}
    x = one(spark, geometry.centroid(c))[0].x
    assert x == pytest.approx((16 * 2 + 0.5 * (9 + 10 + 10) / 3) / 16.5)
    assert one(spark, is_valid(c), is_valid(g("GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (1 1, 1 1))"))) == (True, False)


def test_self_crossing(spark):
    texts = ["POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", "POINT (1 1)", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 7 7, 7 5, 5 8, 5 5)))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 6 1, 6 2, 1 2, 1 1))", None]
    df = spark.createDataFrame([(t,) for t in texts], "w string")
    assert [r[0] for r in df.select(crosses_itself("w")).collect()] == [True, False, False, True, True, False]


def test_intersections_and_distances(spark):
    box = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"
    cases = [("POINT (1 1)", True), ("POINT (5 5)", False), ("LINESTRING (-1 2, 9 2)", True), ("POLYGON ((-9 -9, 9 -9, 9 9, -9 9, -9 -9))", True), ("LINESTRING (5 0, 5 9)", False)]
    assert one(spark, *[geometry.intersects(g(w), box) for w, _ in cases]) == tuple(v for _, v in cases)
    assert one(spark, geometry.distance(g("LINESTRING (0 0, 0 9)"), [(3, 4)]), geometry.distance(g(box), [(1, 1)]), geometry.distance(g("POINT (3 4)"), [(0, 0)])) == (3.0, 0.0, 5.0)


def test_reference_systems(spark):
    def at(x, y, source, target):
        p = one(spark, crs.transform_point(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")), source, target))[0]
        return p.x, p.y

    assert at(9.0, 0.0, 4326, 32632) == pytest.approx((500000, 0), abs=1e-6)
    assert at(-79.387139, 43.642567, 4326, 32617) == pytest.approx((630084, 4833439), abs=1)
    assert at(180.0, 0.0, 4326, 3857)[0] == pytest.approx(math.pi * 6378137)
    for srid in (3857, 32634, 32734, 2100):
        x, y = at(*at(23.7, 37.9 if srid != 32734 else -37.9, 4326, srid), srid, 4326)
        assert (x, abs(y)) == pytest.approx((23.7, 37.9), abs=1e-6)
    assert at(23.7275, 37.9838, 4326, 2100) == pytest.approx((475_860, 4_203_700), rel=1e-3)
    with pytest.raises(ValueError):
        at(1.0, 1.0, 4326, 9999)
    metres = one(spark, geometry.area(crs.flat(g("POLYGON ((23 38, 23.01 38, 23.01 38.01, 23 38.01, 23 38))"))))[0]
    assert metres == pytest.approx(878 * 1110, rel=0.01)


def test_equal_runs_of_letters_are_put_in_latin_once(monkeypatch):
    seen = []
    monkeypatch.setattr(text.unicodedata, "category", lambda c, real=text.unicodedata.category: seen.append(c) or real(c))
    assert text.to_latin("Größe, déjà vu. Αθήνα! " * 1000) == "Große, deja vu. Athina! " * 1000
    assert len(seen) < 100
