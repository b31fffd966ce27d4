"""The two directions, end to end: features to triples and triples to features."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweave.functions import crs, geometry, text
from terraweave.operators import classification, filters, osm, stats
from terraweave.operators.triples import Attributes, TripleBuilder, as_graph
from terraweave.plans import mapping, sparql
from terraweave.plans.config import Config
from terraweave.plans.rml import RmlBuilder, RmlMapping, augmented
from terraweave.sinks import features as feature_sinks
from terraweave.sinks import rdf as rdf_sinks
from terraweave.sources import binary, nested, rdf, tabular, xml_graph


def text_of(spark: SparkSession, path: str) -> str:
    """A small settings file, read by Spark so that any store will do."""
    return spark.read.text(path, wholetext=True).first()[0]


def scan(spark: SparkSession, config: Config, rules: list[osm.TagRule] | None = None) -> DataFrame:
    """Features of the configured inputs: columns or ``attrs``, and ``wkt``."""
    kind, paths = config.format.upper().replace("-", "_"), config.inputs
    if kind == "CSV":
        return tabular.with_wkt(tabular.csv(spark, paths, config), config)
    if kind == "GEOJSON":
        return nested.geojson(spark, paths)
    if kind == "JSON":
        return nested.json_file(spark, paths, config.x_attr, config.y_attr)
    if kind == "GPX":
        return nested.gpx(spark, paths)
    if kind in ("SHAPEFILE", "SHP"):
        out = binary.shapefile(spark, paths[0], config.encoding)
        for p in paths[1:]:
            out = out.unionByName(binary.shapefile(spark, p, config.encoding))
        return out
    if kind in ("OSM_XML", "OSM", "OSM_PBF"):
        nodes, ways, relations = (binary.osm_pbf if kind == "OSM_PBF" else nested.osm_xml)(spark, paths)
        points, lines = osm.node_points(nodes), osm.way_lines(ways, nodes)
        shapes = osm.relation_geometries(relations, points.select("id", "wkt"), lines.select("id", "wkt"))
        found = filters.with_category(osm.records(points, lines, shapes, rules, config.named_only))
        return osm.augmented(found, config.category_attrs[0] if config.category_attrs else "OSM_Category")
    if kind in ("DBMS", "JDBC"):
        return tabular.jdbc(spark, config)
    if kind in ("GML", "KML", "XML", "INSPIRE"):
        return nested.xml_features(spark, paths, config.table or {"KML": "Placemark"}.get(kind, "featureMember"))
    raise ValueError(f"no such input format: {config.format}")


def prepared(features: DataFrame, config: Config) -> DataFrame:
    """Filters in the order of their cost, then reprojection."""
    kind = config.format.upper()
    out = features
    if kind == "CSV":
        out = filters.with_geometry(out)
    if kind not in ("DBMS", "JDBC"):
        out = filters.cql(out, config.condition) if kind in ("SHAPEFILE", "SHP", "GEOJSON") and "attrs" not in out.columns else filters.thematic(out, config.condition)
        if config.extent and kind == "CSV" and not config.geometry_attr:
            out = filters.spatial(out, config.extent, config.x_attr or "lon", config.y_attr or "lat")
        else:
            out = filters.spatial(out, config.extent)
        if config.source_srid != config.target_srid:
            moved = geometry.to_wkt(crs.transform(geometry.parse(F.col("wkt")), config.source_srid, config.target_srid))
            out = out.withColumn("wkt", moved)
    return out


def xml_triples(spark: SparkSession, config: Config) -> DataFrame:
    """Triples of XML documents by the profile of their format; no mapping, filter or statistics apply."""
    kind, base = config.format.upper(), config.feature_ns
    if kind in ("METADATA", "ISO"):
        return xml_graph.read(spark, config.inputs, None)
    profile = xml_graph.inspire(config.source, base) if kind == "INSPIRE" else replace(xml_graph.KML if kind == "KML" else xml_graph.GML, base=base)
    if kind != "INSPIRE" and config.name_attr:
        profile = replace(profile, label=config.name_attr)
    return xml_graph.read(spark, config.inputs, profile)


class Forward:
    """Features to triples. ``rules`` are OSM tag rules, ``dictionary`` embeds categories."""

    def __init__(self, spark: SparkSession, config: Config, rules: list[osm.TagRule] | None = None, dictionary: dict[str, list[str]] | None = None):
        self.spark, self.config = spark, config
        spec = text_of(spark, config.mapping) if config.mapping else None
        self.rml = RmlMapping(spec) if spec and config.mode.upper() == "RML" else None
        self.mapping = mapping.load(spec) if spec and self.rml is None else None
        self.features = prepared(scan(spark, config, rules), config)
        if config.partitions > 1:
            self.features = self.features.repartition(config.partitions)
        self.categories: DataFrame | None = None
        if config.classification:
            content = text_of(spark, config.classification)
            parse = classification.parse_csv if config.classification.lower().endswith(".csv") else classification.parse_indented
            found = classification.frame(spark, parse(content, config.by_name))
            self.categories = classification.embed(found, dictionary) if dictionary else found
            self.features = classification.assign(self.features, self.categories, config.category_attrs, config)

    def triples(self) -> DataFrame:
        if self.rml is not None:
            out = RmlBuilder(self.rml).triples(augmented(self.features, self.config.source, self.config.key_attr))
        else:
            out = TripleBuilder(self.config, self.mapping).triples(self.features, self.config.target_srid)
        return as_graph(out) if self.config.mode.upper() == "GRAPH" else out

    def classification_triples(self) -> DataFrame | None:
        return None if self.categories is None else classification.term_triples(classification.with_parent(self.categories), self.config)

    def registry(self) -> DataFrame:
        builder, c = TripleBuilder(self.config, self.mapping), self.config
        at = geometry.centroid(crs.transform(geometry.parse(F.col("wkt")), c.target_srid, 4326))
        category = "ASSIGNED_CATEGORY" if self.categories is not None and "embed_category" in self.categories.columns else (c.category_attrs or [None])[0]
        return stats.registry(self.features, builder.feature_uri(Attributes(self.features)), c.source, c.key_attr, c.name_attr, category, at["x"], at["y"])

    def write(self) -> None:
        out = self.config.output.rstrip("/")
        serialization = self.config.serialization if self.config.mode.upper() == "GRAPH" else "N-TRIPLES"
        rdf_sinks.write(self.triples(), f"{out}/triples", serialization)
        if self.categories is not None:
            rdf_sinks.write(self.classification_triples(), f"{out}/classification")
        if self.config.register:
            feature_sinks.write_registry(self.registry(), f"{out}/registry")
        counts = stats.record_counts(self.features, F.col("wkt").isNotNull())
        feature_sinks.metadata(counts, stats.mbr(self.features), stats.attribute_counts(self.features)).coalesce(1).write.mode("overwrite").text(f"{out}/metadata")


def reverse(spark: SparkSession, config: Config) -> DataFrame:
    """The solutions of the configured query over the configured triples."""
    triples = as_graph(rdf.read(spark, config.inputs, config.serialization))
    return sparql.select(triples, text_of(spark, config.sparql or ""))


def solution_types(spark: SparkSession, config: Config) -> dict[str, str | None]:
    """The first datatype that each variable of the configured query has."""
    triples = as_graph(rdf.read(spark, config.inputs, config.serialization))
    return sparql.datatypes(triples, text_of(spark, config.sparql or ""))


def write_reverse(spark: SparkSession, config: Config, geometry_column: str = "shape") -> None:
    rows, kind = reverse(spark, config), config.format.upper()
    if kind == "CSV":
        feature_sinks.write_csv(rows, config.output, config.delimiter, config.quote, geometry_column)
    elif kind == "GEOJSON":
        feature_sinks.write_geojson(rows, config.output, geometry_column, config.source_srid, config.target_srid)
    else:
        first = rows.filter(F.col(geometry_column) != "").select(feature_sinks.promoted(feature_sinks.split_crs(F.col(geometry_column))[1]).alias("w")).first()
        shape = first["w"].partition("(")[0].strip() if first else "POINT"
        feature_sinks.write_shapefile(rows, config.output, geometry_column, shape, config.source_srid, config.target_srid, kinds=feature_sinks.schema_of(solution_types(spark, config)))


def sanity(triples: DataFrame, query: str | None = None) -> DataFrame:
    """Counts of a graph, or a query's rows."""
    return sparql.select(triples, query) if query else triples.agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("predicates"))


def synthetic(features: DataFrame, copies: int, dx: float, dy: float, key: str = "fid", seed: int = 1, names: str | None = None, erase: dict[str, float] | None = None) -> DataFrame:
    """Shifted copies of features, suffixed ids; values are decided by hashes, so reruns agree. Copies outside the
    world are left out. ``names``: a column of which values are put in Latin letters and longer ones lose a letter. ``erase``: columns and the share of
    their values that become null."""
    many = features.withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    plain = F.col(key)

    def part(salt: int) -> Column:
        """A thousandth from 0 to 0.999, by hash."""
        h = F.md5(F.concat(F.lit(f"{seed}/{salt}/"), plain, F.lit("/"), F.col("__n").cast("string")))
        return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 1000) / 1000.0

    moved = geometry.translate(geometry.parse(F.col("wkt")), F.lit(dx) * part(1), F.lit(dy) * part(2))
    out = many.withColumn("__g", moved).withColumn("__c", geometry.centroid(F.col("__g"))).filter((F.abs("__c.x") <= 179) & (F.abs("__c.y") <= 89))
    out = out.withColumn("wkt", geometry.to_wkt(F.col("__g")))
    for i, (name, share) in enumerate((erase or {}).items()):
        out = out.withColumn(name, F.when(part(10 + i) >= share, F.col(name)))
    if names:
        out = out.withColumn(names, text.transliterate(F.col(names)))
        at = (F.floor(part(3) * F.length(names)) + 1).cast("int")
        cut = F.concat(F.substring(F.col(names), F.lit(1), at - 1), F.substring(F.col(names), at + 1, F.length(names)))
        out = out.withColumn(names, F.when(F.length(names) > 5, cut).otherwise(F.col(names)))
    return out.withColumn(key, F.concat(key, F.lit("_part"), F.col("__n").cast("string"))).drop("__n", "__g", "__c")
