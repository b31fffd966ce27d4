"""Run statistics and the registry of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweave.functions import geometry, text
from terraweave.operators.triples import Attributes

COUNTS = {"input": "Input records", "accepted": "Transformed records", "rejected": "Excluded records"}


def record_counts(df: DataFrame, accepted: Column) -> DataFrame:
    return df.agg(F.count("*").alias("input"), F.count_if(accepted).alias("accepted"), F.count_if(~F.coalesce(accepted, F.lit(False))).alias("rejected"))


def triple_counts(triples: DataFrame) -> DataFrame:
    """Of the bag and of the set."""
    key = F.struct("s", "p", "o", "o_kind", "dt", "lang")
    return triples.groupBy(key.alias("k")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bag"), F.count("*").alias("graph"))


def attribute_counts(df: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """``(attribute, n)``: values that became triples, by attribute. One pass: counts of columns, then an
    unpivot of one row; map entries are exploded."""
    attrs = Attributes(df, hidden)
    if attrs.dynamic:
        kept = F.filter(F.map_entries("attrs"), lambda e: text.has_value(e["value"]))
        return df.select(F.explode(F.transform(kept, lambda e: e["key"])).alias("attribute")).groupBy("attribute").agg(F.count("*").alias("n"))
    counts = [F.count_if(text.has_value(v)).alias(k) for k, v in attrs.columns.items()]
    one = df.agg(*counts)
    pairs = F.array(*[F.struct(F.lit(k).alias("attribute"), F.col(f"`{k}`").alias("n")) for k in attrs.columns])
    return one.select(F.inline(pairs)).filter("n > 0")


def mbr(df: DataFrame) -> DataFrame:
    b = geometry.bounds(geometry.parse(F.col("wkt")))
    return df.select(b.alias("b")).agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))


def registry(df: DataFrame, uri: Column, source: str, key: str, name: str | None, category: str | None, lon: Column, lat: Column) -> DataFrame:
    """One line per feature, delimiters in values replaced."""
    attrs = Attributes(df)
    value = lambda a: text.without_delimiter(attrs(a)) if a and attrs(a) is not None else F.lit("")
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return df.select(uri.alias("uri"), F.lit(source).alias("source"), value(key).alias("key"), value(name).alias("name"), value(category).alias("category"), shown(lon).alias("lon"), shown(lat).alias("lat"))


def reverse_counts(rows: DataFrame) -> DataFrame:
    """Records, and values that are not empty."""
    filled = sum((F.when(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "", 1).otherwise(0) for c in rows.columns), F.lit(0))
    return rows.agg(F.count("*").alias("records"), F.coalesce(F.sum(filled), F.lit(0)).alias("vals"))
