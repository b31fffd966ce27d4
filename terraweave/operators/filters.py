"""Record filters of the forward direction."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraweave.functions import geometry
from terraweave.operators.triples import Attributes
from terraweave.plans.expression import ExpressionError, compile_cql, compile_filter


def thematic(df: DataFrame, condition: str | None) -> DataFrame:
    if not condition:
        return df
    attrs = Attributes(df)
    return df.filter(compile_filter(condition, lambda n: attrs(n) if attrs(n) is not None else F.lit(None).cast("string")))


def cql(df: DataFrame, condition: str | None) -> DataFrame:
    if not condition:
        return df
    text, calls = compile_cql(condition)
    if not calls:
        return df.filter(text)
    out = df.withColumn("__g", geometry.parse(F.col("wkt")))
    for name, (operator, args) in calls.items():
        out = out.withColumn(name, _spatial(operator, F.col("__g"), args))
    return out.filter(text).drop("__g", *calls)


def _spatial(operator: str, g: Column, args: list[str]) -> Column:
    """A spatial word of CQL. BBOX compares the geometry's own box; distances are in units of the coordinates."""
    if operator == "BBOX":
        x0, y0, x1, y1 = (float(a) for a in args[:4])
        b = geometry.bounds(g)
        found = (b["xmin"] <= x1) & (b["xmax"] >= x0) & (b["ymin"] <= y1) & (b["ymax"] >= y0)
    elif operator in ("DWITHIN", "BEYOND"):
        kind, parts = geometry.literal_parts(args[0])
        if not kind.endswith("POINT"):
            raise ExpressionError(f"{operator} takes a point: {args[0]}")
        near = geometry.distance(g, [p for part in parts for p in part[0]]) <= float(args[1])
        found = near if operator == "DWITHIN" else ~near
    elif operator == "WITHIN":
        found = geometry.contains(args[0], g)
    elif operator == "CONTAINS":
        kind, parts = geometry.literal_parts(args[0])
        if not kind.endswith("POINT"):
            raise ExpressionError(f"CONTAINS takes a point: {args[0]}")
        found = reduce(and_, [geometry.holds_point(g, x, y) for part in parts for x, y in part[0]])
    else:
        found = geometry.intersects(g, args[0])
        found = ~found if operator == "DISJOINT" else found
    return F.coalesce(found, F.lit(False))


def spatial(df: DataFrame, extent: str | None, x: str | None = None, y: str | None = None) -> DataFrame:
    """Features inside the extent. With coordinate columns the box reaches the scan."""
    if not extent:
        return df
    if x and y:
        return df.filter(geometry.contains_point(extent, F.col(x).cast("double"), F.col(y).cast("double")))
    return df.filter(geometry.contains(extent, geometry.parse(F.col("wkt"))))


def with_geometry(df: DataFrame) -> DataFrame:
    return df.filter(F.col("wkt").isNotNull())


def with_attributes(df: DataFrame) -> DataFrame:
    return df.filter(F.size("attrs") > 0)


def with_category(df: DataFrame, category: str = "category") -> DataFrame:
    return df.filter(F.col(category).isNotNull())


def tagged(df: DataFrame, tags: list[str], column: str = "tags") -> DataFrame:
    """Elements with any of the tag keys that a rule tree names."""
    return df.filter(F.arrays_overlap(F.map_keys(column), F.array(*[F.lit(t) for t in sorted(tags)])))


def named(df: DataFrame, column: str = "tags") -> DataFrame:
    return df.filter(F.map_contains_key(column, "name"))


_POLYGON = re.compile(r"\(\s*\([^()]*\)(?:\s*,\s*\([^()]*\))*\s*\)")


@F.pandas_udf(T.BooleanType())
def crosses_itself(wkt: pd.Series) -> pd.Series:
    """Whether two edges of one polygon of a geometry's text cross in the inside of both."""

    def rings(text: str) -> list[np.ndarray]:
        return [np.array([p.split()[:2] for p in r.split(",")], float) for r in re.findall(r"\(([^()]+)\)", text)]

    def one(text: str | None) -> bool:
        try:
            return text is not None and "POLYGON" in text.upper() and any(_self_crossing(rings(m[0])) for m in _POLYGON.finditer(text))
        except ValueError:  # no numbers, which the other tests see
            return False

    return wkt.map(one)


def _self_crossing(rings: list[np.ndarray]) -> bool:
    """Edges in order of their least x meet only those that begin before they end."""
    a, b = (np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])) if rings else (np.zeros((0, 2)),) * 2
    by = np.argsort(np.minimum(a[:, 0], b[:, 0]), kind="stable")
    a, b = a[by], b[by]
    low, high = np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 0], b[:, 0])
    turn = lambda p, q, r: np.sign((q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0]))
    ends = np.searchsorted(low, high, side="right")
    for at in range(0, len(a), 512):
        own = np.arange(at, min(at + 512, len(a)))
        counts = np.maximum(ends[own] - own - 1, 0)
        i = np.repeat(own, counts)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
        if ((turn(a[i], b[i], a[j]) * turn(a[i], b[i], b[j]) < 0) & (turn(a[j], b[j], a[i]) * turn(a[j], b[j], b[i]) < 0)).any():
            return True
    return False


def is_valid(g: Column, wkt: Column | None = None) -> Column:
    """Closed rings of four points or more with an area, lines of two points or more; a collection is valid if its members are. With the
    geometry's text ``wkt`` also no edge of a polygon may cross another one."""
    sound = F.coalesce(g.isNotNull() & F.forall(geometry.each(g), lambda m: F.coalesce(_sound(m), F.lit(False))), F.lit(False))
    return (sound if wkt is None else sound & ~crosses_itself(wkt)).alias("is_valid")


def _sound(g: Column) -> Column:
    ring = lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1))
    areal = F.forall(F.flatten(g["parts"]), ring) & (geometry.area(g) > 0)
    linear = F.forall(F.flatten(g["parts"]), lambda r: F.size(r) >= 2) & (geometry.length(g) > 0)
    finite = F.forall(F.flatten(F.flatten(g["parts"])), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.coalesce(finite & F.when(geometry.is_areal(g), areal).when(geometry.is_linear(g), linear).otherwise(F.lit(True)), F.lit(False))


def valid_of_kind(df: DataFrame, kind: str, column: str = "wkt") -> DataFrame:
    g = geometry.parse(F.col(column))
    return df.filter((F.upper(geometry.kind(F.col(column))) == kind.upper()) & is_valid(g, F.col(column)))


def in_world(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter((F.abs(x) <= 179) & (F.abs(y) <= 89))
