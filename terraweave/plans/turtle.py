"""A reader of Turtle and N-Triples for files that fit a task: mappings, schemes, exported graphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

from terraweave.plans.sparql import RDF_TYPE

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\")|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<dir>@prefix|@base|(?i:PREFIX|BASE)\b)|(?P<lang>@[A-Za-z0-9-]+)"""
    r"""|(?P<blank>_:[\w.-]*\w)|(?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<op>\^\^|[\[\](),;.])|(?P<name>[\w-]*:(?:[\w%-]|\.(?=[\w%-]))*|[A-Za-z_]\w*)"""
)
Triple = tuple[str, str, str, str, str | None, str | None]


def unescape(s: str) -> str:
    plain = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\", "b": "\b", "f": "\f"}
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: plain.get(m[3], m[3]) if m[3] else chr(int(m[1] or m[2], 16)), s)


#: No token depends on more characters behind it.
_AHEAD = 16


def _tokens(pieces: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Tokens of a text that comes in pieces; only what no token has ended yet is held."""
    held, at, more = "", 0, True
    while True:
        m = _TOKEN.match(held, at)
        open_ = m and m.lastgroup == "text" and held.startswith('"""', at)  # a long text that goes on
        if more and (not m or open_ or m.end() + _AHEAD > len(held)):
            piece = next(pieces, None)
            more, held, at = piece is not None, held[at:] + (piece or ""), 0
        elif at == len(held):
            return
        elif not m:
            raise ValueError(f"cannot read: {held[at:at + 25]!r}")
        else:
            if m.lastgroup:
                yield m.lastgroup, m[0]
            at = m.end()


class Reader:
    def __init__(self, text: str | Iterator[str], scope: str = "", labels: set[str] | None = None):
        """A text, or its pieces with those ``labels`` in it that ``own_labels`` finds."""
        self.scope = scope
        self.labels = own_labels(text, scope) if isinstance(text, str) else labels or set()
        self.source = _tokens(iter([text]) if isinstance(text, str) else text)
        self.tokens: list[tuple[str, str]] = []
        self.at, self.base, self.blank = 0, "", 0
        self.prefixes: dict[str, str] = {}
        self.out: list[Triple] = []

    def there(self) -> bool:
        while self.at >= len(self.tokens) and (token := next(self.source, None)):
            self.tokens.append(token)
        return self.at < len(self.tokens)

    def next(self) -> tuple[str, str]:
        if not self.there():
            raise ValueError("the text ends within a statement")
        self.at += 1
        return self.tokens[self.at - 1]

    def is_next(self, value: str) -> bool:
        return self.there() and self.tokens[self.at][1] == value

    def term(self) -> tuple[str, str, str | None, str | None]:
        """Kind, value, datatype, language."""
        kind, v = self.next()
        if kind == "iri":
            iri = unescape(v[1:-1])
            return "uri", iri if re.match(r"\w[\w+.-]*:", iri) else self.base + iri, None, None
        if kind == "blank":
            return "uri", v, None, None
        if kind in ("text", "long"):
            value = unescape(v[3:-3] if kind == "long" else v[1:-1])
            if self.there() and self.tokens[self.at][0] == "lang":
                return "literal", value, None, self.next()[1][1:]
            if self.is_next("^^"):
                self.next()
                return "literal", value, self.term()[1], None
            return "literal", value, None, None
        if kind == "num":
            return "literal", v, XSD + ("double" if "e" in v.lower() else "decimal" if "." in v else "integer"), None
        if v == "[":
            own = self.fresh()
            self.properties(own, "]")
            self.next()
            return "uri", own, None, None
        if v == "(":
            return "uri", self.items(), None, None
        if v == "a":
            return "uri", RDF_TYPE, None, None
        if v in ("true", "false"):
            return "literal", v, XSD + "boolean", None
        prefix, sep, local = v.partition(":")
        if sep and prefix in self.prefixes:
            return "uri", self.prefixes[prefix] + local, None, None
        raise ValueError(f"no term: {v!r}")

    def fresh(self) -> str:
        """A label that no label of the text equals."""
        self.blank += 1
        while (own := f"_:g{self.scope}x{self.blank}") in self.labels:
            self.blank += 1
        return own

    def items(self) -> str:
        """A collection, its bracket taken: a chain of first and rest."""
        head = last = None
        while not self.is_next(")"):
            kind, value, dt, lang = self.term()
            own = self.fresh()
            if last is None:
                head = own
            else:
                self.out.append((last, RDF + "rest", own, "uri", None, None))
            self.out.append((own, RDF + "first", value, kind, dt, lang))
            last = own
        self.next()
        if last is None:
            return RDF + "nil"
        self.out.append((last, RDF + "rest", RDF + "nil", "uri", None, None))
        return head

    def properties(self, subject: str, end: str) -> None:
        while not self.is_next(end):
            predicate = self.term()[1]
            while True:
                kind, value, dt, lang = self.term()
                self.out.append((subject, predicate, value, kind, dt, lang))
                if not self.is_next(","):
                    break
                self.next()
            while self.is_next(";"):
                self.next()

    def statements(self) -> Iterator[list[Triple]]:
        """The triples of each statement."""
        while self.there():
            kind, v = self.tokens[self.at]
            if kind == "dir":
                self.next()
                if v.lower().endswith("prefix"):
                    name = self.next()[1].removesuffix(":")
                    self.prefixes[name] = self.next()[1][1:-1]
                else:
                    self.base = self.next()[1][1:-1]
                if self.is_next("."):
                    self.next()
            else:
                subject = self.term()[1]
                self.properties(subject, ".")
                if self.there():
                    self.next()
                yield self.out
                self.out = []
            del self.tokens[: self.at]
            self.at = 0

    def read(self) -> list[Triple]:
        return [t for out in self.statements() for t in out]


def own_labels(text: str, scope: str) -> set[str]:
    """Labels in a text that are formed like those which a reader gives to nameless nodes."""
    return set(re.findall(rf"_:g{re.escape(scope)}x\d+", text))


def read(text: str, scope: str = "") -> list[Triple]:
    """``scope`` goes into the labels of nameless nodes, so that those of several files stay apart."""
    return Reader(text.lstrip("﻿"), scope).read()
