"""Category schemes: parsing, embedding in a dictionary, joins and triples."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraweave.functions import text
from terraweave.operators.triples import RDF_TYPE, Attributes, resource, triple
from terraweave.plans.config import Config

MAX_LEVELS = 10
SCHEMA = "id string, name string, parent_id string, level int, position int"


@dataclass(frozen=True)
class Category:
    id: str
    name: str
    parent_id: str | None
    level: int
    position: int


class SchemeError(ValueError):
    pass


def parse_csv(content: str, by_name: bool = True) -> list[Category]:
    """Pairs of id and name from left to right, each the child of the pair before it."""
    out: dict[tuple[str, str], Category] = {}
    rows = csv.reader(io.StringIO(content.lstrip("﻿")))
    next(rows, None)
    for row in rows:
        parent = None
        for level, at in enumerate(range(0, len(row) - 1, 2)):
            key, name = row[at].strip(), row[at + 1].strip()
            if not name:
                continue
            if not by_name:
                key, name = name, key
            out.setdefault((name, key), Category(key, name, parent, level, len(out)))
            parent = key
    return list(out.values())


def parse_indented(content: str, by_name: bool = True) -> list[Category]:
    """``name #id`` per line, two spaces a level."""
    out: list[Category] = []
    path: list[str] = []
    for n, line in enumerate(content.lstrip("﻿").splitlines(), 1):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip(" "))
        level = indent // 2
        name, sep, key = line.strip().rpartition("#")
        if indent % 2 or level > len(path) or level >= MAX_LEVELS or not sep:
            raise SchemeError(f"line {n}: {line!r}")
        key, name = (key.strip(), name.strip()) if by_name else (name.strip(), key.strip())
        out.append(Category(key, name, path[level - 1] if level else None, level, len(out)))
        path[level:] = [key]
    return out


def parse_dictionary(content: str) -> dict[str, list[str]]:
    """Categories at the margin, their tags indented."""
    out: dict[str, list[str]] = {}
    for line in content.lstrip("﻿").splitlines():
        if line.strip():
            if line[0] != " ":
                out[line.strip()] = []
            else:
                out[next(reversed(out))].append(line.strip())
    return out


def frame(spark: SparkSession, categories: list[Category]) -> DataFrame:
    rows = [(c.id, c.name, c.parent_id, c.level, c.position) for c in categories]
    return with_uuid(spark.createDataFrame(rows, SCHEMA))


def with_uuid(categories: DataFrame) -> DataFrame:
    return categories.withColumn("uuid", text.uuid_v3(F.concat("id", "name")))


def last_by_name(categories: DataFrame) -> DataFrame:
    """Of categories with one name the last in the file stands."""
    cols = [F.max_by(F.col(c), "position").alias(c) for c in categories.columns if c != "name"]
    return categories.groupBy("name").agg(*cols)


def with_parent(categories: DataFrame) -> DataFrame:
    """``parent_uuid`` by a left join of the scheme with itself."""
    parents = categories.groupBy("id").agg(F.max_by("uuid", "position").alias("parent_uuid")).withColumnRenamed("id", "__parent")
    return categories.join(parents, F.col("parent_id") == F.col("__parent"), "left").drop("__parent")


def by_id(df: DataFrame, key: str, categories: DataFrame) -> DataFrame:
    """``df`` with the ``name`` of the first category, in the file's order, whose id is in column ``key``."""
    first = categories.groupBy(F.col("id").alias("__found")).agg(F.min_by("name", "position").alias("name"))
    return df.join(first, F.col(key) == F.col("__found"), "left").drop("__found")


def best_tag(name: Column, dictionary: dict[str, list[str]], digits: int | None = None) -> Column:
    """``struct<category, score>``: the dictionary's category with the tag most like a name. Ties go to
    the first in alphabetical order. The dictionary is a file of a few hundred lines and goes along
    with the function, so nothing is joined."""
    flat = sorted((c, t) for c, tags in dictionary.items() for t in [*tags, c])

    @F.pandas_udf("category string, score double")
    def match(names: pd.Series) -> pd.DataFrame:
        known: dict[str, tuple[str | None, float | None]] = {}
        for n in names.unique():
            if n is None:
                known[n] = (None, None)
                continue
            scored = [(text.jaro_winkler(n.upper(), t), c) for c, t in flat]
            top = max(s for s, _ in scored)
            known[n] = (min(c for s, c in scored if s == top), round(top, digits) if digits else top)
        return pd.DataFrame([known[n] for n in names], columns=["category", "score"])

    return match(name)


def embed(categories: DataFrame, dictionary: dict[str, list[str]], digits: int | None = None) -> DataFrame:
    """``embed_category`` and ``embed_score``, of which a child takes its parent's if that scores higher."""
    found = best_tag(F.col("name"), dictionary, digits)
    own = categories.withColumn("__best", found).withColumn("embed_category", F.col("__best.category")).withColumn("embed_score", F.col("__best.score")).drop("__best")
    return inherit(own)


def inherit(scored: DataFrame, levels: int = MAX_LEVELS) -> DataFrame:
    """Level by level, so a score reaches all descendants."""
    out = scored.filter("level = 0")
    deepest = scored.agg(F.max("level")).first()[0] or 0
    done = out
    for level in range(1, min(levels, deepest + 1)):
        up = done.select(F.col("id").alias("__pid"), F.col("embed_category").alias("__c"), F.col("embed_score").alias("__s"), F.col("position").alias("__p"))
        up = up.groupBy("__pid").agg(F.max_by("__c", "__p").alias("__c"), F.max_by("__s", "__p").alias("__s"))
        here = scored.filter(F.col("level") == level).join(up, F.col("parent_id") == F.col("__pid"), "left")
        take = F.col("__s") > F.col("embed_score")
        here = here.withColumn("embed_category", F.when(take, F.col("__c")).otherwise(F.col("embed_category"))).withColumn("embed_score", F.greatest("embed_score", "__s"))
        done = here.select(*scored.columns)
        out = out.unionByName(done)
    return out


def assign(features: DataFrame, categories: DataFrame, attributes: list[str], config: Config) -> DataFrame:
    """``CATEGORY_URI`` and ``ASSIGNED_CATEGORY`` by the first attribute, finest first, whose value names a category.

    The scheme comes from one file and is left to Spark's size rule for broadcasting."""
    attrs = Attributes(features)
    known = last_by_name(categories)
    embedded = F.col("embed_category") if "embed_category" in known.columns else F.lit(None).cast("string")
    lookup = known.select(F.col("name").alias("__name"), F.col("uuid").alias("__uuid"), embedded.alias("__embedded"))
    out = features
    for i, a in enumerate(attributes):
        value = attrs(a)
        side = lookup.select(*[F.col(c).alias(f"{c}{i}") for c in lookup.columns])
        out = out.join(side, (F.lit(None).cast("string") if value is None else value) == F.col(f"__name{i}"), "left")
    n = range(len(attributes))
    uuid = F.coalesce(*[F.col(f"__uuid{i}") for i in n], F.lit(None).cast("string"))
    cat = F.coalesce(*[F.when(F.col(f"__uuid{i}").isNotNull(), F.struct(F.col(f"__embedded{i}").alias("e"))) for i in n], F.lit(None).cast("struct<e:string>"))
    out = out.withColumn("CATEGORY_URI", F.concat(F.lit(config.class_ns), uuid)).withColumn("ASSIGNED_CATEGORY", cat["e"])
    return out.drop(*[f"{c}{i}" for i in n for c in lookup.columns])


def term_triples(categories: DataFrame, config: Config) -> DataFrame:
    """Three triples a category, and one for its parent."""
    uri = lambda c: F.concat(F.lit(config.class_ns), F.url_encode(F.col(c)))
    s = uri("uuid")
    ns = config.ontology_ns
    made = [
        resource(s, ns + "termClassification", config.classification_ns + config.source),
        resource(s, RDF_TYPE, ns + "Term"),
        triple(s, ns + "value", F.col("name")),
        F.when(F.col("parent_uuid").isNotNull(), resource(s, ns + "parent", uri("parent_uuid"))),
    ]
    return categories.select(F.inline(F.filter(F.array(*made), lambda t: t.isNotNull())))


def paths(categories: DataFrame) -> DataFrame:
    """``path``, the positions from the root down: sorting by it lists the tree in pre-order."""
    key = lambda: F.lpad(F.col("position").cast("string"), 9, "0")
    done = categories.filter("parent_id is null").withColumn("path", key())
    out = done
    deepest = categories.agg(F.max("level")).first()[0] or 0
    for level in range(1, deepest + 1):
        up = done.select(F.col("id").alias("__pid"), F.col("path").alias("__path"))
        done = categories.filter(F.col("level") == level).join(up, F.col("parent_id") == F.col("__pid")).withColumn("path", F.concat("__path", F.lit("/"), key())).select(*out.columns)
        out = out.unionByName(done)
    return out


def listing(categories: DataFrame) -> DataFrame:
    """Lines of the indented form, in order of ``path``."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level")), "name", F.lit(" #"), "id")
    return paths(categories).select("path", line.alias("line"))


def statistics(categories: DataFrame) -> DataFrame:
    return categories.agg(F.count("*").alias("categories"), (F.max("level") + 1).alias("tiers"))


def best_by_similarity(names: DataFrame, tags: DataFrame) -> DataFrame:
    """``(name, category, score)`` of distinct ``names(name)`` against a table ``tags(tag, category)``: the tags are one
    row of arrays, so no pairs are made."""
    row = tags.agg(F.sort_array(F.collect_list(F.struct("tag", "category"))).alias("all"))

    @F.pandas_udf("category string, score double")
    def match(n: pd.Series, all_tags: pd.Series) -> pd.DataFrame:
        out = []
        for name, found in zip(n, all_tags):
            scored = [(text.jaro_winkler(name.upper(), t["tag"]), t["category"]) for t in found]
            top = max(s for s, _ in scored)
            out.append((min(c for s, c in scored if s == top), top))
        return pd.DataFrame(out, columns=["category", "score"])

    best = names.select("name").distinct().join(row).withColumn("b", match("name", "all"))
    return best.select("name", "b.category", "b.score")


def argmax(scores: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(score), F.col(tie))
    return scores.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
