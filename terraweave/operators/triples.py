"""Features to triples: one array of triples per record, exploded once.

A feature table has the attributes as string columns, or in a map column ``attrs`` where their names vary, and ``wkt``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweave.functions import crs, geometry, registry, text
from terraweave.plans.config import Config
from terraweave.plans.mapping import Mapping, Rule

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
GEO = "http://www.opengis.net/ont/geosparql#"
SF = "http://www.opengis.net/ont/sf#"
POS = "http://www.w3.org/2003/01/geo/wgs84_pos#"
VIRTUOSO = "http://www.openlinksw.com/schemas/virtrdf#"
XSD = "http://www.w3.org/2001/XMLSchema#"
DATATYPES = {
    "int": "integer", "integer": "integer", "long": "long", "float": "float", "double": "double", "date": "date",
    "datetime": "dateTime", "timestamp": "dateTimeStamp", "boolean": "boolean", "uri": "anyURI",
}
TYPE = "struct<s:string,p:string,o:string,o_kind:string,dt:string,lang:string>"
NONE = F.lit


def datatype(name: str) -> str:
    return XSD + DATATYPES.get(name.lower(), "string")


def _text(v: Column | str | None) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("string")


def triple(s: Column | str, p: Column | str, o: Column | str, kind: str = "literal", dt: str | None = None, lang: Column | str | None = None) -> Column:
    return F.struct(_text(s).alias("s"), _text(p).alias("p"), _text(o).alias("o"), F.lit(kind).alias("o_kind"), _text(dt).alias("dt"), _text(lang).alias("lang"))


def resource(s: Column | str, p: Column | str, o: Column | str) -> Column:
    return triple(s, p, o, "uri")


def _empty() -> Column:
    return F.array().cast(f"array<{TYPE}>")


def _when(test: Column, *triples: Column) -> Column:
    return F.when(test, F.array(*triples)).otherwise(_empty())


class Attributes:
    """Attributes of a feature table as Columns of string."""

    def __init__(self, df: DataFrame, hidden: tuple[str, ...] = ()):
        taken = {"wkt", "attrs", *hidden}
        self.columns = {c: F.col(f"`{c}`").cast("string") for c in df.columns if c not in taken}
        self.dynamic = "attrs" in df.columns
        self.extra: dict[str, Column] = {}

    def __call__(self, name: str) -> Column | None:
        if name in self.extra:
            return self.extra[name]
        if name in self.columns:
            return self.columns[name]
        return F.try_element_at("attrs", F.lit(name)) if self.dynamic else None

    def entries(self) -> list[tuple[str, Column]]:
        return [*self.columns.items(), *((k, v) for k, v in self.extra.items() if k not in self.columns)]


class TripleBuilder:
    def __init__(self, config: Config, mapping: Mapping | None):
        self.config, self.mapping = config, mapping
        self.prefixes = config.prefix_map()

    def expand(self, name: str | None) -> str:
        """``prefix:local`` with its namespace; other names stay."""
        prefix, sep, local = (name or "").partition(":")
        return self.prefixes[prefix] + local if sep and prefix in self.prefixes else name or ""

    def feature_uri(self, attrs: Attributes) -> Column:
        rule = self.mapping.uri if self.mapping else None
        if rule and rule.function:
            return F.concat(F.lit(self.config.feature_ns), registry.call(rule.function, rule.args, attrs, self.config))
        if self.mapping:
            return F.concat(F.lit(self.config.feature_ns), F.uuid(self.config.uuid_seed))
        key = attrs(self.config.key_attr)
        return F.concat(F.lit(self.config.feature_ns), text.uuid_v3(F.concat(F.lit(self.config.source), F.coalesce(key, F.lit("")))))

    def geometry_triples(self, uri: Column, wkt: Column, srid: int) -> Column:
        feature = resource(uri, RDF_TYPE, self.config.geometry_ns + "Feature")
        kind = self.config.ontology.lower()
        if kind == "wgs84_pos":
            c = geometry.centroid(crs.transform(geometry.parse(wkt), srid, 4326))
            found = [triple(uri, POS + "long", c["x"].cast("string"), dt=XSD + "float"), triple(uri, POS + "lat", c["y"].cast("string"), dt=XSD + "float")]
        elif kind == "virtuoso":
            found = [triple(uri, POS + "geometry", wkt, dt=VIRTUOSO + "Geometry")]
        else:
            own = F.concat(uri, F.lit("/geom"))
            literal = F.concat(F.lit(f"<http://www.opengis.net/def/crs/EPSG/0/{srid}> "), wkt)
            found = [resource(uri, GEO + "hasGeometry", own), resource(own, RDF_TYPE, F.concat(F.lit(SF), geometry.kind(wkt))), triple(own, GEO + "asWKT", literal, dt=GEO + "wktLiteral")]
        return _when(wkt.isNotNull(), *found, feature)

    def flat_triples(self, uri: Column, attrs: Attributes) -> Column:
        ns = self.config.ontology_ns
        name = lambda k: F.concat(F.lit(ns), F.url_encode(k))
        groups = [_when(text.has_value(v), triple(uri, name(F.lit(k)), v)) for k, v in (dict(attrs.entries()) | {"DATA_SOURCE": F.lit(self.config.source)}).items()]
        if attrs.dynamic:
            kept = F.filter(F.map_entries("attrs"), lambda e: text.has_value(e["value"]))
            groups.append(F.transform(kept, lambda e: triple(uri, name(e["key"]), e["value"])))
        return F.flatten(F.array(*groups))

    def rule_triples(self, rule: Rule, uri: Column, value: Column, entity: Column | str, lang: Column | str | None, attrs: Attributes) -> list[Column]:
        ns, p = self.config.ontology_ns, self.expand(rule.predicate)
        own = F.concat(uri, F.lit("/"), _text(entity))
        if rule.profile.startswith("INSTANCE"):
            kind = registry.call(rule.type_function, rule.type_args, attrs, self.config) if rule.type_function else F.lit(rule.resource_type)
            link, cls = resource(uri, p, own), resource(own, RDF_TYPE, ns + str(rule.instance))
            typed = triple(own, f"{ns}{rule.instance}Type", kind)
            if rule.profile == "INSTANCE":
                return [link, triple(own, f"{ns}{rule.instance}Value", value), typed, cls]
            iso = text.is_language(_text(lang))
            shown = F.upper(F.trim(kind)) != "NONE"
            none = F.lit(None).cast(TYPE)
            return [
                link,
                triple(own, f"{ns}{rule.instance}Value", value, lang=F.when(iso, _text(lang))),
                F.when(iso, triple(own, ns + "language", _text(lang))).otherwise(none),
                F.when(shown, typed).otherwise(none),
                cls,
            ]
        if rule.profile.startswith("PART"):
            return [triple(F.concat(uri, F.lit(f"/{rule.part}")), p, value, lang=lang if rule.profile == "PART_LANG" else None)]
        if rule.profile == "URL":
            return [resource(uri, p, text.clean_url(value))]
        if rule.profile == "TYPED":
            return [triple(uri, p, value, dt=datatype(rule.datatype or ""))]
        if rule.profile.startswith("LITERAL"):
            return [triple(uri, p, value, lang=lang if rule.profile == "LITERAL_LANG" else None)]
        return []

    def thematic_triples(self, uri: Column, attrs: Attributes) -> Column:
        mapping = self.mapping
        if mapping is None or mapping.flat:
            return self.flat_triples(uri, attrs)
        groups: list[Column] = []
        headers: dict[str, list[tuple[Column, str]]] = {}
        for key, rule in mapping.exact().items():
            raw = attrs(key)
            if raw is None:
                continue
            value = text.without_illegal(raw)
            groups.append(_when(text.has_value(raw), *self.rule_triples(rule, uri, value, rule.entity or key, rule.language, attrs)))
            if rule.part:
                headers.setdefault(rule.part, []).append((text.has_value(raw), rule.entity or key))
        for part, members in headers.items():
            # The first part that is present names the link; both header triples come once a record.
            first = F.coalesce(*[F.when(test, F.lit(entity)) for test, entity in members])
            own = F.concat(uri, F.lit(f"/{part}"))
            groups.append(_when(first.isNotNull(), resource(uri, F.concat(F.lit(self.config.ontology_ns), first), own), resource(own, RDF_TYPE, self.config.ontology_ns + part)))
        groups += self._pattern_triples(uri, attrs)
        return F.filter(F.flatten(F.array(*groups)), lambda t: t.isNotNull()) if groups else _empty()

    def _pattern_triples(self, uri: Column, attrs: Attributes) -> list[Column]:
        mapping = self.mapping
        assert mapping
        groups: list[Column] = []
        exact, many, wild = mapping.exact(), mapping.multilingual(), mapping.wildcards()

        def of(key: Column, value: Column, name: str | None) -> list[tuple[Column, list[Column]]]:
            """Tests and triples of an attribute with no rule of its own; ``name`` if it is known now."""
            out = []
            for (head, tail), rule in wild.items():
                out.append((key.startswith(head) & key.endswith(tail), self.rule_triples(rule, uri, value, key, rule.language, attrs)))
            for base, rule in many.items():
                lang = text.language_suffix(key, len(base))
                entity = F.concat(F.lit(f"{rule.entity}_"), lang)
                out.append((key.startswith(base) & lang.isNotNull(), self.rule_triples(rule, uri, value, entity, lang, attrs)))
            if mapping.passthrough:
                own, ns = F.concat(uri, F.lit("/"), key), self.config.ontology_ns
                out.append((F.lit(True), [resource(uri, self.expand(mapping.passthrough.predicate), own), triple(own, ns + "key", key), triple(own, ns + "value", value)]))
            return out

        def first(found: list[tuple[Column, list[Column]]]) -> Column:
            out = _empty()
            for test, triples in reversed(found):
                out = F.when(test, F.array(*triples)).otherwise(out)
            return out

        if not (wild or many or mapping.passthrough):
            return []
        for key, raw in attrs.entries():
            if key not in exact:
                found = first(of(F.lit(key), text.without_illegal(raw), key))
                groups.append(F.when(text.has_value(raw), found).otherwise(_empty()))
        if attrs.dynamic:
            kept = F.filter(F.map_entries("attrs"), lambda e: text.has_value(e["value"]) & ~e["key"].isin(*exact, ""))
            groups.append(F.flatten(F.transform(kept, lambda e: first(of(e["key"], text.without_illegal(e["value"]), None)))))
        return groups

    def derive(self, features: DataFrame, attrs: Attributes, srid: int) -> DataFrame:
        """``features`` with a column for each value that the mapping generates; the attributes name them."""
        if self.mapping is None:
            return features
        attrs.extra.setdefault("DATA_SOURCE", F.lit(self.config.source))
        rules = {k: r for k, r in self.mapping.exact().items() if r.function and r.function != "getEmbeddedCategory"}
        spatial = [r for r in rules.values() if r.function.startswith("geometry.")]
        if spatial:
            features = features.withColumn("__wgs84", crs.transform(geometry.parse(F.col("wkt")), srid, 4326))
        if any(r.function in ("geometry.getArea", "geometry.getLength") for r in spatial):
            features = features.withColumn("__flat", crs.flat(F.col("__wgs84")))
        for i, (key, rule) in enumerate(rules.items()):
            if rule.function.startswith("geometry."):
                value = registry.call_geometry(rule.function.removeprefix("geometry."), rule.args, F.col("__wgs84"), F.col("__flat"))
            else:
                value = registry.call(rule.function, rule.args, attrs, self.config)
            features = features.withColumn(f"__derived{i}", value)
            attrs.extra[key] = F.col(f"__derived{i}")
        return features

    def triples(self, features: DataFrame, srid: int = 4326, hidden: tuple[str, ...] = ()) -> DataFrame:
        """``(s, p, o, o_kind, dt, lang)`` of every feature: a bag, in one scan."""
        attrs = Attributes(features, hidden)
        features = self.derive(features, attrs, srid)
        uri = self.feature_uri(attrs)
        tagged = features.withColumn("__uri", uri)
        u = F.col("__uri")
        both = F.concat(self.geometry_triples(u, F.col("wkt"), srid), self.thematic_triples(u, attrs))
        return tagged.select(F.inline(both))


def as_graph(triples: DataFrame) -> DataFrame:
    """The set of triples."""
    return triples.dropDuplicates(["s", "p", "o", "o_kind", "dt", "lang"])
