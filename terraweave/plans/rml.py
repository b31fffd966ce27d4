"""Mappings in the R2RML / RML vocabulary, compiled to arrays of triples.

A triples map has a subject (template, reference or constant; classes) and predicate-object maps whose objects are templates,
references, constants or the subject of another map of the same row. Attribute names are upper case.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweave.functions import text
from terraweave.operators.triples import RDF_TYPE, Attributes, _empty, resource, triple
from terraweave.plans import turtle

RR = "http://www.w3.org/ns/r2rml#"
RML = "http://semweb.mmlab.be/ns/rml#"


class RmlMapping:
    def __init__(self, content: str):
        self.of: dict[str, dict[str, list[turtle.Triple]]] = defaultdict(lambda: defaultdict(list))
        for t in turtle.read(content):
            self.of[t[0]][t[1]].append(t)
        self.maps = [s for s, p in self.of.items() if RR + "subjectMap" in p or RR + "subject" in p]

    def one(self, node: str, predicate: str) -> turtle.Triple | None:
        found = self.of[node].get(predicate)
        return found[0] if found else None

    def many(self, node: str, predicate: str) -> list[str]:
        return [t[2] for t in self.of[node].get(predicate, [])]


def _template(template: str, attrs: Attributes, encode: bool) -> Column:
    """The template with its references filled in; null if one is missing."""
    parts = []
    for piece in re.split(r"(\{[^}]*\})", template):
        if piece.startswith("{"):
            v = attrs(piece[1:-1])
            v = F.lit(None).cast("string") if v is None else v
            parts.append(F.url_encode(v) if encode else v)
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def augmented(df: DataFrame, source: str, key: str) -> DataFrame:
    """Columns in upper case, with ``WKT`` and a ``UUID`` of the key."""
    upper = df.select(*[F.col(f"`{c}`").alias(c.upper()) for c in df.columns])
    return upper.withColumn("UUID", text.uuid_v3(F.col(key.upper()).cast("string")))


class RmlBuilder:
    def __init__(self, mapping: RmlMapping):
        self.mapping = mapping

    def subject(self, triples_map: str, attrs: Attributes) -> Column:
        m = self.mapping
        direct = m.one(triples_map, RR + "subject")
        if direct:
            return F.lit(direct[2])
        return self.term(m.one(triples_map, RR + "subjectMap")[2], attrs)[0]  # type: ignore[index]

    def term(self, node: str, attrs: Attributes) -> tuple[Column, bool]:
        """The value of a term map, and whether it is a resource."""
        m = self.mapping
        kind = m.one(node, RR + "termType")
        if (c := m.one(node, RR + "constant")) is not None:
            return F.lit(c[2]), c[3] == "uri"
        if (t := m.one(node, RR + "template")) is not None:
            literal = kind is not None and kind[2].endswith("Literal")
            return _template(t[2], attrs, not literal), not literal
        reference = m.one(node, RML + "reference") or m.one(node, RR + "column")
        if reference is not None:
            v = attrs(reference[2])
            v = F.lit(None).cast("string") if v is None else v
            return F.when(text.has_value(v), v), kind is not None and kind[2].endswith("IRI")
        raise ValueError(f"no value in {node}")

    def arrays(self, attrs: Attributes) -> list[Column]:
        m, groups = self.mapping, []
        for tm in m.maps:
            s = self.subject(tm, attrs)
            subject_node = m.one(tm, RR + "subjectMap")
            classes = m.many(subject_node[2], RR + "class") if subject_node else []
            groups += [F.when(s.isNotNull(), F.array(resource(s, RDF_TYPE, c))).otherwise(_empty()) for c in classes]
            for po in m.many(tm, RR + "predicateObjectMap"):
                predicates = m.many(po, RR + "predicate") + [m.one(x, RR + "constant")[2] for x in m.many(po, RR + "predicateMap")]  # type: ignore[index]
                for p in predicates:
                    for o in m.of[po].get(RR + "object", []):
                        made = resource(s, p, o[2]) if o[3] == "uri" else triple(s, p, o[2], dt=o[4], lang=o[5])
                        groups.append(F.when(s.isNotNull(), F.array(made)).otherwise(_empty()))
                    for om in m.many(po, RR + "objectMap"):
                        parent = m.one(om, RR + "parentTriplesMap")
                        value, is_resource = (self.subject(parent[2], attrs), True) if parent else self.term(om, attrs)
                        lang, dt = m.one(om, RR + "language"), m.one(om, RR + "datatype")
                        if is_resource:
                            made = [resource(s, p, value)] + [resource(value, RDF_TYPE, c) for c in m.many(om, RR + "class")]
                        else:
                            made = [triple(s, p, value, dt=dt[2] if dt and not lang else None, lang=lang[2] if lang else None)]
                        groups.append(F.when(s.isNotNull() & value.isNotNull(), F.array(*made)).otherwise(_empty()))
        return groups

    def triples(self, df: DataFrame) -> DataFrame:
        attrs = Attributes(df)
        attrs.columns.setdefault("WKT", F.col("WKT")) if "WKT" in df.columns else None
        return df.select(F.inline(F.flatten(F.array(*self.arrays(attrs)))))
