"""XML documents straight to triples: GML and KML features, INSPIRE themes, ISO 19139 metadata.

Names decide: a child with text becomes a literal, a child with children a resource of its own, a child with a
geometry the feature's geometry. A ``Profile`` says which elements are features, which of their
children to pass over and how namespaces translate. One task cuts a file into its features as a stream, all tasks read them.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from terraweave.operators.triples import GEO, RDF_TYPE, XSD
from terraweave.sources import parts
from terraweave.sources.nested import GEOMETRIES, xml_wkt

SCHEMA = "s string, p string, o string, o_kind string, dt string, lang string"
Triple = tuple[str, str, str, str, str | None, str | None]
LABEL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#label"
GML_ID = ("{http://www.opengis.net/gml/3.2}id", "{http://www.opengis.net/gml}id", "id", "fid")
INSPIRE = "http://inspire.jrc.ec.europa.eu/schemas/"
#: Application schemas of INSPIRE and the short names in their namespaces.
INSPIRE_THEMES = {
    "Addresses": "ad", "AdministrativeUnits": "au", "BaseTypes": "base", "CadastralParcels": "cp", "CommonTransportElements": "tn", "GeographicalNames": "gn",
    "HydroBase": "hy", "HydroNetwork": "hy-n", "Network": "net", "ProtectedSites": "ps", "RoadTransportNetwork": "tn-ro",
}
#: The features of the themes.
INSPIRE_FEATURES = {
    "AddressAreaName", "PostalDescriptor", "ThoroughfareName", "Address", "AdministrativeUnit", "CadastralParcel", "NamedPlace", "WatercourseLink", "ProtectedSite", "RoadLink",
}


def _split(tag: str) -> tuple[str, str]:
    ns, _, local = tag.rpartition("}")
    return ns.removeprefix("{"), local


def inspire_namespace(ns: str) -> str:
    """``urn:x-inspire:specification:gmlas:<Schema>:<version>`` as the namespace of its vocabulary."""
    head, _, version = ns.rpartition(":")
    theme = INSPIRE_THEMES.get(head.rpartition(":")[2])
    return f"{INSPIRE}{theme}/{version}/" if theme else ns + ("" if ns.endswith(("/", "#")) else "/")


def plain_namespace(ns: str) -> str:
    return ns + ("" if not ns or ns.endswith(("/", "#")) else "#")


@dataclass(frozen=True)
class Profile:
    """``features``: names of feature elements, or with ``members`` whatever stands below elements of that name."""

    base: str = "http://example.org/id/"
    features: frozenset[str] = frozenset()
    members: str | None = None
    label: str | None = None
    skip: frozenset[str] = frozenset()
    namespace: Callable[[str], str] = plain_namespace
    #: Feature type and topic in the URIs, as in ``base + type/topic/id``.
    topic: str | None = None
    id_path: str | None = None
    copy: bool = True
    wrappers: frozenset[str] = field(default_factory=lambda: frozenset({"Identifier"}))


GML = Profile(members="featureMember", label="NAME")
KML = Profile(features=frozenset({"Placemark"}), label="name", copy=False)


def inspire(topic: str, base: str = "http://example.org/id/") -> Profile:
    return Profile(base=base, features=frozenset(INSPIRE_FEATURES), namespace=inspire_namespace, topic=topic, id_path="localId")


def _geometry(e: ET.Element) -> str | None:
    found = next((c for c in e.iter() if c is not e and _split(c.tag)[1] in GEOMETRIES), None)
    return xml_wkt(found) if found is not None else None


def _children(e: ET.Element, wrappers: frozenset[str]) -> Iterator[ET.Element]:
    for c in e:
        if _split(c.tag)[1] in wrappers:
            yield from c
        else:
            yield c


def feature_triples(e: ET.Element, profile: Profile, number: int) -> list[Triple]:
    out: list[Triple] = []
    kind = _split(e.tag)[1]
    own = next((e.get(k) for k in GML_ID if e.get(k)), None)
    if profile.id_path:
        own = next((c.text.strip() for c in e.iter() if _split(c.tag)[1] == profile.id_path and (c.text or "").strip()), own)
    own = own or f"{kind}{number}"
    root = f"{profile.base}{kind}/{profile.topic}/" if profile.topic else profile.base
    subject, shape = root + own, f"{root}geometry/{own}"

    def name(tag: str) -> str:
        ns, local = _split(tag)
        return profile.namespace(ns) + local

    def walk(node: ET.Element, s: str, above: str | None = None) -> None:
        lang = next(((c.text or "").strip()[:2] for c in node if _split(c.tag)[1] == "language"), "") or above
        for c in _children(node, profile.wrappers):
            local = _split(c.tag)[1]
            if local in profile.skip or local == "boundedBy":
                continue
            if local == profile.label and s == subject:
                out.append((s, LABEL, (c.text or "").strip(), "literal", None, None))
                continue
            wkt = xml_wkt(c) if local in GEOMETRIES else None if any(_split(g.tag)[1] == local for g in c) else _geometry(c)
            if wkt:
                out.append((s, GEO + "hasGeometry", shape, "uri", None, None))
                if profile.topic:
                    out.append((s, name(c.tag), shape, "uri", None, None))
                out.append((shape, GEO + "asWKT", wkt, "literal", GEO + "wktLiteral", None))
            elif not profile.copy:
                continue
            elif len(c):
                other = f"{root}{local}/{own}"
                out.append((s, name(c.tag), other, "uri", None, None))
                walk(c, other, lang)
            elif (c.text or "").strip():
                out.append((s, name(c.tag), (c.text or "").strip(), "literal", None, lang if local == "text" else None))

    walk(e, subject)
    return out


def document_triples(content: bytes | str, profile: Profile, first: int = 0) -> list[Triple]:
    """``first``: the number of the first feature, by which those without an id are named."""
    root = ET.fromstring(content)
    out: list[Triple] = []
    box = next((c for c in root if _split(c.tag)[1] == "boundedBy"), None)
    if box is not None and (wkt := _geometry(box)):
        own = next((root.get(k) for k in GML_ID if root.get(k)), "")
        out.append((f"{profile.base}boundary/{own}", GEO + "asWKT", wkt, "literal", GEO + "wktLiteral", None))
    if profile.members:
        features = [f for m in root.iter() if _split(m.tag)[1] == profile.members for f in m]
    else:
        features = [f for f in root.iter() if _split(f.tag)[1] in profile.features]
    for n, f in enumerate(features, first):
        out += feature_triples(f, profile, n)
    return out


DCT, DCAT, FOAF = "http://purl.org/dc/terms/", "http://www.w3.org/ns/dcat#", "http://xmlns.com/foaf/0.1/"
RDFS, SKOS, VCARD = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2004/02/skos/core#", "http://www.w3.org/2006/vcard/ns#"
LANGUAGE = DCT + "ISO639-2"


def metadata_triples(content: bytes | str, first: int = 0) -> list[Triple]:
    """A catalogue record for each ISO 19139 metadata record whose western bound lies east of -179 degrees. ``first``: the number of the first record,
    which tells the nameless nodes of records with equal identifiers apart."""
    out: list[Triple] = []
    blank = 0
    for record in [e for e in ET.fromstring(content).iter() if _split(e.tag)[1] == "MD_Metadata"]:

        def find(*path: str, within: ET.Element = record) -> list[ET.Element]:
            """Elements below ``within`` by a path of names, any others between them."""
            at = [within]
            for step in path:
                at = [d for a in at for d in a.iter() if d is not a and _split(d.tag)[1] == step]
            return list({id(a): a for a in at}.values())

        def text(*path: str, within: ET.Element = record) -> str:
            found = find(*path, within=within)
            return " ".join("".join(found[0].itertext()).split()) if found else ""

        bounds = [text("identificationInfo", "geographicElement", f) for f in ("westBoundLongitude", "southBoundLatitude", "eastBoundLongitude", "northBoundLatitude")]
        try:
            w, s, e, n = map(float, bounds)
        except ValueError:
            continue
        if w <= -179:
            continue
        own = "urn:uuid:" + text("fileIdentifier")
        dataset = text("distributionInfo", "linkage") or own + "#dataset"
        lang = text("identificationInfo", "language") or None

        def literal(s: str, p: str, o: str, dt: str | None = None, lang: str | None = None) -> None:
            if o:
                out.append((s, p, o, "literal", dt, lang))

        def link(s: str, p: str, o: str) -> None:
            out.append((s, p, o, "uri", None, None))

        def node(s: str, p: str, kind: str) -> str:
            nonlocal blank
            blank += 1
            made = f"_:m{zlib.crc32(own.encode()):08x}x{f'{first}x' if first else ''}{blank}"
            link(s, p, made)
            link(made, RDF_TYPE, kind)
            return made

        def organisation(s: str, p: str, kind: str, called: str, mail: str, name: str, address: str) -> None:
            if name:
                o = node(s, p, kind)
                literal(o, called, name, lang=lang)
                if address:
                    link(o, mail, "mailto:" + address)

        link(own, FOAF + "primaryTopic", dataset)
        literal(own, DCT + "language", text("language"), LANGUAGE)
        literal(own, DCT + "modified", text("dateStamp"), XSD + "date")
        organisation(own, DCT + "creator", FOAF + "Organisation", FOAF + "name", FOAF + "mbox", text("contact", "organisationName"), text("contact", "electronicMailAddress"))
        link(dataset, FOAF + "primaryTopicOf", own)
        link(dataset, RDF_TYPE, DCAT + "Dataset")
        link(dataset, DCAT + "landingPage", dataset)
        literal(dataset, DCT + "language", lang or "", LANGUAGE)
        literal(dataset, DCT + "title", text("identificationInfo", "citation", "title"), lang=lang)
        literal(dataset, DCT + "description", text("abstract"), lang=lang)
        literal(dataset, DCT + "identifier", text("identificationInfo", "codeSpace"), XSD + "string")
        literal(dataset, DCT + "subject", text("MD_TopicCategoryCode"))
        for k in find("identificationInfo", "keyword"):
            literal(dataset, DCAT + "keyword", " ".join("".join(k.itertext()).split()), lang=lang)
        if find("thesaurusName"):
            scheme = node(node(dataset, DCAT + "theme", SKOS + "Concept"), SKOS + "inScheme", SKOS + "ConceptScheme")
            literal(scheme, RDFS + "label", text("thesaurusName", "title"))
            literal(scheme, DCT + "issued", text("thesaurusName", "Date"), XSD + "date")
        place = node(dataset, DCT + "spatial", DCT + "Location")
        x0, y0, x1, y1 = bounds
        literal(place, "http://www.w3.org/ns/locn#geometry", f"POLYGON (({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))", GEO + "wktLiteral")
        for d in find("identificationInfo", "citation", "CI_Date"):
            code = next((c.get("codeListValue") for c in d.iter() if _split(c.tag)[1] == "CI_DateTypeCode"), None)
            event = {"publication": "issued", "revision": "modified", "creation": "created"}.get(code or "")
            if event:
                literal(dataset, DCT + event, text("DateTime", within=d) or text("Date", within=d), XSD + "date")
        for path, p, kind, inner in (
            (("LI_Lineage", "statement"), DCT + "provenance", DCT + "ProvenanceStatement", RDFS + "label"),
            (("useLimitation",), DCT + "rights", DCT + "RightsStatement", RDFS + "label"),
            (("otherConstraints",), DCT + "accessRights", DCT + "RightsStatement", RDFS + "label"),
            (("report", "title"), DCT + "conformsTo", DCT + "Standard", DCT + "title"),
        ):
            if text(*path):
                literal(node(dataset, p, kind), inner, text(*path))
        owner, mail = text("organisationName"), text("identificationInfo", "pointOfContact", "electronicMailAddress")
        organisation(dataset, DCT + "rightsHolder", FOAF + "Organisation", FOAF + "name", FOAF + "mbox", owner, mail)
        organisation(dataset, DCAT + "contactPoint", VCARD + "Kind", VCARD + "organization-name", VCARD + "hasEmail", owner, mail)
    return out


def read(spark: SparkSession, path: str | list[str], profile: Profile | None) -> DataFrame:
    """Triples of XML files; without a profile they are metadata records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [t for n, xml in zip(pdf["n"], pdf["xml"]) for t in (document_triples(xml, profile, n) if profile else metadata_triples(xml, n))]
            yield pd.DataFrame(found, columns=["s", "p", "o", "o_kind", "dt", "lang"])

    def cut(file: BinaryIO) -> Iterator[tuple[int, str]]:
        boxes = 0

        def feature(local: str, above: str, depth: int) -> bool:
            return local == "MD_Metadata" if profile is None else above == profile.members if profile.members else local in profile.features

        def wanted(local: str, above: str, depth: int) -> bool:
            nonlocal boxes
            box = profile is not None and depth == 1 and local == "boundedBy"
            boxes += box
            return box and boxes == 1 or (local == profile.members if profile and profile.members else feature(local, above, depth))

        return parts.xml_elements(file, wanted, feature)

    return parts.split(spark, path, cut, "n long, xml string").mapInPandas(run, SCHEMA)
