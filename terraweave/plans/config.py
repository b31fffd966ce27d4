"""Run settings, read from ``key = value`` files or given as keywords."""

from __future__ import annotations

import secrets
from dataclasses import dataclass, field, fields

#: Names in files that differ from the names here; the first is our own.
ALIASES = {
    "geometry_ns": ("nsGeometry", "geometryNS"),
    "ontology_ns": ("nsOntology",),
    "feature_ns": ("nsFeatureURI",),
    "class_ns": ("nsClassURI",),
    "classification_ns": ("nsClassificationURI",),
    "source_ns": ("nsDataSourceURI",),
    "extent": ("spatialExtent",),
    "condition": ("filterSQLCondition",),
    "source_crs": ("sourceCRS",),
    "target_crs": ("targetCRS",),
    "name_attr": ("attrName",),
    "key_attr": ("attrKey",),
    "geometry_attr": ("attrGeometry",),
    "category_attrs": ("attrCategory",),
    "x_attr": ("attrX",),
    "y_attr": ("attrY",),
    "ontology": ("targetGeoOntology",),
    "language": ("defaultLang",),
    "format": ("inputFormat", "outputFormat"),
    "inputs": ("inputFiles",),
    "output": ("outputDir", "outputFile"),
    "mapping": ("mappingSpec",),
    "classification": ("classificationSpec",),
    "by_name": ("classifyByName",),
    "source": ("featureSource",),
    "register": ("registerFeatures",),
    "sparql": ("sparqlFile",),
    "table": ("tableName",),
}
_LISTS = {"inputs": ";", "category_attrs": ",", "prefixes": ",", "namespaces": ","}
_NUMBERS = {"batch_size": (1, 10_000), "partitions": (1, 1_000_000)}


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    mode: str = "STREAM"
    runtime: str = "SPARK"
    format: str = "CSV"
    inputs: list[str] = field(default_factory=list)
    output: str = ""
    mapping: str | None = None
    classification: str | None = None
    by_name: bool = True
    serialization: str = "N-TRIPLES"
    ontology: str = "GeoSPARQL"
    ontology_ns: str = "http://example.org/def#"
    geometry_ns: str = "http://www.opengis.net/ont/geosparql#"
    feature_ns: str = "http://example.org/id/feature/"
    class_ns: str = "http://example.org/id/term/"
    classification_ns: str = "http://example.org/id/classification/"
    source_ns: str = "http://example.org/id/source/"
    prefixes: list[str] = field(default_factory=list)
    namespaces: list[str] = field(default_factory=list)
    source: str = "source"
    table: str = ""
    condition: str | None = None
    extent: str | None = None
    key_attr: str = "id"
    geometry_attr: str | None = None
    name_attr: str | None = None
    category_attrs: list[str] = field(default_factory=list)
    x_attr: str | None = None
    y_attr: str | None = None
    register: bool = False
    delimiter: str = ","
    quote: str = '"'
    encoding: str = "UTF-8"
    #: Whether quoted values of delimited files may hold line breaks. Such a file is one task's work; without them large files are split among tasks.
    multi_line: bool = False
    #: OSM elements without a name are left out.
    named_only: bool = False
    source_crs: str | None = None
    target_crs: str | None = None
    language: str = "en"
    batch_size: int = 1000
    partitions: int = 1
    sparql: str | None = None
    jdbc: dict[str, str] = field(default_factory=dict)
    #: Random identifiers are drawn from it, so that all outputs of a run, and tasks that are run again, have the same.
    uuid_seed: int = field(default_factory=lambda: secrets.randbits(62))

    @property
    def source_srid(self) -> int:
        return _srid(self.source_crs)

    @property
    def target_srid(self) -> int:
        return _srid(self.target_crs or self.source_crs)

    def prefix_map(self) -> dict[str, str]:
        return dict(zip(self.prefixes, self.namespaces))


def _srid(crs: str | None) -> int:
    if not crs:
        return 4326
    code = crs.rpartition(":")[2]
    if not code.isdigit():
        raise ConfigError(f"not a reference system: {crs}")
    return int(code)


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def load(text: str) -> Config:
    """Settings from the text of a properties file; unknown keys are left out, bad values raise."""
    back = {a: own for own, names in ALIASES.items() for a in names}
    kinds = {f.name: f for f in fields(Config)}
    out: dict[str, object] = {}
    jdbc: dict[str, str] = {}
    for line in text.lstrip("﻿").splitlines():
        line = line.strip()
        if not line or line[0] in "#!" or "=" not in line:
            continue
        key, _, value = (x.strip() for x in line.partition("="))
        name = back.get(key, _snake(key))
        if key.startswith("db"):
            jdbc[key[2:].lower()] = value
        elif name in _LISTS:
            out[name] = [v.strip() for v in value.split(_LISTS[name]) if v.strip()]
        elif name in _NUMBERS:
            low, high = _NUMBERS[name]
            if value.isdigit() and low <= int(value) <= high:
                out[name] = int(value)
        elif name in kinds and value:
            out[name] = value.lower() in ("true", "y", "yes") if isinstance(kinds[name].default, bool) else value
    if str(out.get("mode", "STREAM")).upper() not in ("GRAPH", "STREAM", "RML", "XSLT"):
        raise ConfigError(f"no such mode: {out['mode']}")
    return Config(**out, jdbc=jdbc)  # type: ignore[arg-type]
