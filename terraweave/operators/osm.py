"""OpenStreetMap elements to features: rule trees, ways, relations.

``nodes(id, lon, lat, tags)``, ``ways(id, refs, tags)``, ``relations(id, members array<struct<ref, type, role>>, tags)``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraweave.functions import geometry


@dataclass
class TagRule:
    key: str | None
    value: str | None
    category: str | None
    children: list[TagRule] = field(default_factory=list)


class RuleError(ValueError):
    pass


def parse_rules(content: str) -> list[TagRule]:
    """``key=value CATEGORY`` per line, children indented; a rule without a key has its parent's."""
    roots: list[TagRule] = []
    stack: list[tuple[int, TagRule]] = []
    for n, raw in enumerate(content.lstrip("﻿").splitlines(), 1):
        line = raw.partition("#")[0].rstrip()
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        head, _, category = line.strip().partition(" ")
        key, sep, value = head.partition("=")
        if not sep:
            raise RuleError(f"line {n}: {raw!r}")
        while stack and stack[-1][0] >= indent:
            stack.pop()
        if not key and not stack:
            raise RuleError(f"line {n} has no key")
        rule = TagRule(key or None, value or None, category.strip() or None)
        (stack[-1][1].children if stack else roots).append(rule)
        stack.append((indent, rule))

    def check(rule: TagRule) -> None:
        if not rule.children and not rule.category:
            raise RuleError(f"{rule.key or ''}={rule.value or ''} has neither a category nor rules below it")
        for c in rule.children:
            check(c)

    for r in roots:
        check(r)
    return roots


def rule_tags(rules: list[TagRule]) -> list[str]:
    out: set[str] = set()
    for r in rules:
        out |= {x for x in (r.key, r.value) if x} | set(rule_tags(r.children))
    return sorted(out)


def rule_categories(rules: list[TagRule]) -> list[str]:
    return sorted({r.category for r in rules if r.category} | {c for r in rules for c in rule_categories(r.children)})


def category(rules: list[TagRule], tags: Column) -> Column:
    """The first rule that matches, children before their parent, as one nested CASE."""

    def of(rule: TagRule, key: str | None) -> Column:
        key = rule.key or key
        here = F.try_element_at(tags, F.lit(key))
        test = here == rule.value if rule.value else here.isNotNull()
        inner = [of(c, key) for c in rule.children] + [F.lit(rule.category).cast("string")]
        return F.when(test, F.coalesce(*inner))

    return F.coalesce(*[of(r, None) for r in rules], F.lit(None).cast("string"))


def scheme_rows(categories: list[str]) -> list[tuple[str, str, str, str]]:
    """``A_B`` as two tiers: id and name of ``A``, then of ``B`` with the whole name as its id."""
    out = []
    for c in categories:
        parts = c.split("_")
        out.append((parts[0], parts[0], c, parts[1]) if len(parts) > 1 else (c, c, "", ""))
    return out


def referenced(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """The nodes that some way refers to."""
    return nodes.join(ways.select(F.explode("refs").alias("__ref")), F.col("id") == F.col("__ref"), "left_semi")


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, tags, wkt)``: the nodes of each way in order; nodes that are missing are passed over.

    Only nodes that some way refers to are kept for the join. References are grouped by way."""
    refs = ways.select("id", F.posexplode("refs").alias("pos", "ref"))
    used = referenced(nodes, ways).select(F.col("id").alias("ref"), "lon", "lat")
    placed = refs.join(used, "ref").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"))
    pairs = F.transform("p", lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))
    wkt = F.when(F.size("p") > 1, F.concat(F.lit("LINESTRING ("), F.array_join(pairs, ", "), F.lit(")"))).otherwise(geometry.point(F.col("p")[0]["lon"], F.col("p")[0]["lat"]))
    return ways.join(placed.select("id", wkt.alias("wkt")), "id").select("id", "tags", "wkt")


def node_points(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "tags", geometry.point(F.col("lon"), F.col("lat")).alias("wkt"))


Point = tuple[str, str]


def _coordinates(wkt: str) -> list[list[Point]]:
    body = wkt.partition("(")[2]
    return [[tuple(p.split()[:2]) for p in part.strip("() ").split(",")] for part in body.split("),")]  # type: ignore[misc]


def stitch(lines: list[list[Point]]) -> list[list[Point]]:
    """Closed rings from lines that meet at their ends; what does not close is left out."""
    rings, open_lines = [], []
    for line in lines:
        (rings if len(line) > 3 and line[0] == line[-1] else open_lines).append(list(line))
    while open_lines:
        ring = open_lines.pop(0)
        grown = True
        while grown and ring[0] != ring[-1]:
            grown = False
            for i, other in enumerate(open_lines):
                if other[0] == ring[-1]:
                    ring += other[1:]
                elif other[-1] == ring[-1]:
                    ring += other[-2::-1]
                elif other[-1] == ring[0]:
                    ring = other[:-1] + ring
                elif other[0] == ring[0]:
                    ring = other[:0:-1] + ring
                else:
                    continue
                open_lines.pop(i)
                grown = True
                break
        if len(ring) > 3 and ring[0] == ring[-1]:
            rings.append(ring)
    return rings


def _holds(ring: list[Point], p: Point) -> bool:
    x, y, inside = float(p[0]), float(p[1]), False
    for a, b in zip(ring, ring[1:]):
        (ax, ay), (bx, by) = (float(a[0]), float(a[1])), (float(b[0]), float(b[1]))
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def _ring_text(ring: list[Point]) -> str:
    return "(" + ", ".join(" ".join(p) for p in ring) + ")"


def assemble(kind: str | None, members: list[tuple[str, str]]) -> str | None:
    """The geometry of a relation from ``(role, wkt)`` of its members."""
    if not members:
        return None
    lines = [(role, part) for role, wkt in members if "LINESTRING" in wkt for part in _coordinates(wkt)]
    if kind == "multilinestring" and lines:
        return "MULTILINESTRING (" + ", ".join(_ring_text(line) for _, line in lines) + ")"
    if kind in ("multipolygon", "boundary"):
        outer = stitch([line for role, line in lines if role != "inner"])
        inner = stitch([line for role, line in lines if role == "inner"])
        if len(outer) == 1:
            return "POLYGON (" + ", ".join(map(_ring_text, [outer[0], *inner])) + ")"
        if outer:
            shells = [[o] for o in outer]
            for hole in inner:
                owner = next((s for s in shells if all(_holds(s[0], p) for p in hole[:-1])), None)
                if owner:
                    owner.append(hole)
            return "MULTIPOLYGON (" + ", ".join("(" + ", ".join(map(_ring_text, s)) + ")" for s in shells) + ")"
    if len(members) == 1:
        return members[0][1]
    return "GEOMETRYCOLLECTION (" + ", ".join(w for _, w in members) + ")"


@F.arrow_udf(T.StringType())
def _assembled(kinds: pa.Array, roles: pa.Array, wkts: pa.Array) -> pa.Array:
    """Roles and geometries are lists of equal lengths, whose values are taken from Arrow at once."""
    pairs = list(zip(roles.flatten().to_pylist(), wkts.flatten().to_pylist()))
    ends = [0, *accumulate(wkts.value_lengths().to_pylist())]
    return pa.array([assemble(k, [(role or "", wkt) for role, wkt in pairs[i:j]]) for k, i, j in zip(kinds.to_pylist(), ends, ends[1:])], pa.string())


def relation_geometries(relations: DataFrame, nodes: DataFrame, ways: DataFrame, rounds: int = 2) -> DataFrame:
    """``(id, tags, wkt)``. ``nodes`` and ``ways`` are ``(id, wkt)``. Members that are relations are looked up in the round
    before, so nesting is followed ``rounds`` deep; members keep the document's order. Rounds after the first are
    for relations that have such members only, and are planned only if there is one, which is looked up at once."""
    nested = F.coalesce(F.exists("members", lambda m: m["type"] == "relation"), F.lit(False))
    own = relations.select("id", F.try_element_at("tags", F.lit("type")).alias("kind"), nested.alias("nested"), "members")
    members = own.select("id", "kind", "nested", F.posexplode("members").alias("pos", "m")).select("id", "kind", "nested", "pos", "m.ref", "m.type", "m.role")
    known = nodes.select(F.lit("node").alias("type"), F.col("id").alias("ref"), "wkt").unionByName(ways.select(F.lit("way").alias("type"), F.col("id").alias("ref"), "wkt"))
    known = known.filter("wkt is not null")  # here, as a condition on the result would have it assembled twice

    def placed(members: DataFrame) -> DataFrame:
        return members.join(known, ["type", "ref"]).select("id", "kind", "nested", "pos", "role", "wkt")

    def assembled(placed: DataFrame) -> DataFrame:
        held = placed.groupBy("id", "kind", "nested").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "wkt"))).alias("m"))
        return held.select("id", "nested", _assembled("kind", F.transform("m", lambda m: m["role"]), F.transform("m", lambda m: m["wkt"])).alias("wkt"))

    found = assembled(placed(members))
    if rounds > 1 and not own.filter("nested").isEmpty():
        inner = members.filter("nested and type = 'relation'")
        again = found
        for _ in range(rounds - 1):
            below = again.select(F.col("id").alias("ref"), "wkt")
            inside = inner.join(below, "ref").select("id", "kind", "nested", "pos", "role", "wkt")
            again = assembled(placed(members.filter("not nested")).unionByName(placed(members.filter("nested")).unionByName(inside)))
        found = again
    return relations.join(found.select("id", "wkt"), "id").select("id", "tags", "wkt")


def records(nodes: DataFrame, ways: DataFrame, relations: DataFrame | None, rules: list[TagRule] | None, named_only: bool = False) -> DataFrame:
    """``(fid, name, type, category, wkt, tags)`` of the elements of all three kinds, ``named_only`` of those with a name. Without rules the category
    is the kind of element; with rules those that match none have no category."""
    parts = [("node", nodes), ("way", ways)] + ([("relation", relations)] if relations is not None else [])
    out = None
    for name, df in parts:
        if named_only:
            df = df.filter(F.map_contains_key("tags", "name"))
        found = category(rules, F.col("tags")) if rules else F.lit(name)
        own = df.select(
            F.concat(F.lit(f"{name}/"), "id").alias("fid"), F.try_element_at("tags", F.lit("name")).alias("name"), F.lit(name).alias("type"), found.alias("category"), "wkt", "tags"
        )
        out = own if out is None else out.unionByName(own)
    assert out is not None
    return out


def augmented(found: DataFrame, category_attr: str = "OSM_Category") -> DataFrame:
    """Records as features: the element's own columns join the tags in ``attrs``."""
    own = F.create_map(F.lit("osm_id"), "fid", F.lit("name"), "name", F.lit("type"), "type", F.lit(category_attr), "category")
    plain = F.map_filter("tags", lambda k, _: ~k.isin("osm_id", "name", "type", category_attr))
    return found.select("fid", "wkt", F.map_concat(plain, own).alias("attrs"))
