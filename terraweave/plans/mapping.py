"""Declarative mappings of attributes to an ontology: the two-level YAML form."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

CALL = re.compile(r"^([\w.]+?)(?:\((.*)\))?$")


@dataclass
class Rule:
    """How one attribute becomes triples. ``profile`` names the shape of its triples."""

    entity: str | None = None
    predicate: str | None = None
    type: str | None = None
    language: str | None = None
    instance: str | None = None
    part: str | None = None
    datatype: str | None = None
    function: str | None = None
    args: list[str] = field(default_factory=list)
    type_function: str | None = None
    type_args: list[str] = field(default_factory=list)
    profile: str = "NONE"

    def __post_init__(self) -> None:
        tagged = "_LANG" if self.language else ""
        if self.instance and self.type and not self.part:
            self.profile = f"INSTANCE{tagged}"
        elif self.part:
            self.profile = f"PART{tagged}"
        elif self.datatype:
            self.profile = "URL" if self.datatype.lower() == "uri" else "TYPED"
        elif self.predicate:
            self.profile = f"LITERAL{tagged}"
        elif self.entity == "uri":
            self.profile = "URI"

    @property
    def resource_type(self) -> str | None:
        """The type, or where none is given what follows the prefix of the predicate."""
        return self.type if self.type is not None else self.predicate and self.predicate.partition(":")[2] or self.predicate


def parse_call(text: str) -> tuple[str, list[str]]:
    m = CALL.match(text.strip())
    if not m:
        raise ValueError(f"not a call: {text}")
    args = [a.strip() for a in m[2].split(",")] if m[2] and m[2].strip() else []
    return m[1], args


def _plain(line: str) -> str:
    """A line without its comment; a ``#`` counts only after white space."""
    return re.sub(r"(^|\s)#.*$", "", line).rstrip()


@dataclass
class Mapping:
    rules: dict[str, Rule]

    @property
    def uri(self) -> Rule | None:
        return self.rules.get("URI")

    @property
    def flat(self) -> bool:
        """Only the URI is mapped: each attribute becomes a plain literal under its own name."""
        return all(r.profile == "URI" or k == "URI" for k, r in self.rules.items())

    @property
    def passthrough(self) -> Rule | None:
        return self.rules.get("_")

    def exact(self) -> dict[str, Rule]:
        return {k: r for k, r in self.rules.items() if k not in ("URI", "_") and not k.endswith("%LANG") and "*" not in k}

    def multilingual(self) -> dict[str, Rule]:
        return {k.removesuffix("%LANG"): r for k, r in self.rules.items() if k.endswith("%LANG")}

    def wildcards(self) -> dict[tuple[str, str], Rule]:
        return {(k.partition("*")[0], k.rpartition("*")[2]): r for k, r in self.rules.items() if "*" in k}


def load(text: str) -> Mapping:
    rules: dict[str, Rule] = {}
    key, values = "", {}

    def close() -> None:
        if key:
            function, args = parse_call(values["generateWith"]) if "generateWith" in values else (None, [])
            kind = values.get("type")
            type_function, type_args = None, []
            if kind and kind.startswith("generateWith."):
                type_function, type_args = parse_call(kind.removeprefix("generateWith."))
            rules[key] = Rule(
                values.get("entity"), values.get("predicate"), kind, values.get("language"), values.get("instanceOf"), values.get("partOf"), values.get("datatype"), function, args, type_function, type_args
            )

    for raw in text.lstrip("﻿").splitlines():
        line = _plain(raw)
        if not line.strip():
            continue
        if line[0].isspace():
            name, _, value = line.strip().partition(":")
            values[name.strip()] = value.strip().strip("'\"")
        else:
            close()
            key, values = line.strip().removesuffix(":").strip().strip("'\""), {}
    close()
    return Mapping(rules)
