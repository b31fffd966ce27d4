"""SELECT queries over a table of triples, compiled to DataFrame operations.

Covered: PREFIX, SELECT [DISTINCT] of variables, expressions or *, basic graph patterns with ``;`` ``,`` and ``a``, paths of ``/`` and ``^``, OPTIONAL,
UNION, MINUS, FILTER with [NOT] EXISTS, BIND, VALUES, queries within queries, GROUP BY with COUNT, SUM, MIN, MAX, AVG, SAMPLE and GROUP_CONCAT, HAVING,
ORDER BY, LIMIT and OFFSET. Values are lexical forms.

A filter of an OPTIONAL, MINUS or EXISTS that names a variable of the pattern around it becomes part of the join's condition.

Triple patterns join by the number of their bound terms, those connected to what is joined first. An
OPTIONAL joins on variables that may be unbound by null-aware tests only where they may be.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<var>[?$]\w+)|(?P<lang>@[A-Za-z-]+)"""
    r"""|(?P<num>[+-]?\d+(?:\.\d+)?)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}().;,*=<>!+/^-])|(?P<name>[\w-]*:[\w.%-]*|[A-Za-z_]\w*)"""
)


class SparqlError(ValueError):
    pass


@dataclass
class Term:
    kind: str  # var, uri, literal
    value: str
    lang: str | None = None
    dt: str | None = None


@dataclass
class Group:
    patterns: list[tuple[Term, Term, Term]] = field(default_factory=list)
    steps: list[tuple[str, object]] = field(default_factory=list)
    filters: list[list] = field(default_factory=list)


AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT")


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"cannot read: {text[at:at + 25]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0
        self.made = 0
        self.prefixes: dict[str, str] = {}
        self.base = ""

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("", "")

    def word(self) -> str:
        return self.peek()[1].upper()

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, value: str) -> None:
        if self.word() != value:
            raise SparqlError(f"expected {value}, found {self.peek()[1]!r}")
        self.at += 1

    def take(self, *values: str) -> bool:
        if self.word() in values:
            self.at += 1
            return True
        return False

    def term(self, verb: bool = False) -> Term:
        kind, v = self.next()
        if kind == "var":
            return Term("var", v[1:])
        if kind == "iri":
            return Term("uri", v[1:-1])
        if kind == "num":
            return Term("literal", v)
        if kind == "text":
            out = Term("literal", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), v[1:-1]))
            if self.peek()[0] == "lang":
                out.lang = self.next()[1][1:]
            elif self.take("^^"):
                out.dt = self.term().value
            return out
        if kind == "name":
            if verb and v == "a":
                return Term("uri", RDF_TYPE)
            prefix, sep, local = v.partition(":")
            if sep and prefix in self.prefixes:
                return Term("uri", self.prefixes[prefix] + local)
            if v.lower() in ("true", "false"):
                return Term("literal", v.lower())
        raise SparqlError(f"no term: {v!r}")

    def triples(self, group: Group) -> None:
        s = self.term()
        while True:
            path = self.path()
            self.along(group, s, path, self.term())
            while self.take(","):
                self.along(group, s, path, self.term())
            if not self.take(";"):
                break
            if self.word() in (".", "}"):
                break

    def path(self) -> list[tuple[bool, Term]]:
        """Steps, each with whether it goes from object to subject."""
        steps = []
        while True:
            back = self.take("^")
            steps.append((back, self.term(verb=True)))
            if not self.take("/"):
                return steps

    def along(self, group: Group, s: Term, path: list[tuple[bool, Term]], o: Term) -> None:
        for i, (back, p) in enumerate(path):
            self.made += i + 1 < len(path)
            to = o if i + 1 == len(path) else Term("var", f"\x01{self.made}")
            group.patterns.append((to, p, s) if back else (s, p, to))
            s = to

    def flush(self, group: Group) -> None:
        if group.patterns:
            group.steps.append(("bgp", group.patterns))
            group.patterns = []

    def group(self) -> Group:
        out = Group()
        self.expect("{")
        if self.word() == "SELECT":
            out.steps.append(("query", self.query()))
            self.expect("}")
            return out
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("OPTIONAL"):
                self.flush(out)
                out.steps.append(("optional", self.group()))
            elif self.take("FILTER"):
                out.filters.append(self.constraint())
            elif self.take("MINUS"):
                self.flush(out)
                out.steps.append(("minus", self.group()))
            elif self.take("BIND"):
                self.flush(out)
                self.expect("(")
                e = self.expression()
                self.expect("AS")
                out.steps.append(("bind", (e, self.next()[1][1:])))
                self.expect(")")
            elif self.take("VALUES"):
                self.flush(out)
                out.steps.append(("values", self.values()))
            elif self.word() == "{":
                self.flush(out)
                sides = [self.group()]
                while self.take("UNION"):
                    sides.append(self.group())
                out.steps.append(("union", sides))
            else:
                self.triples(out)
        self.flush(out)
        return out

    def values(self) -> tuple[list[str], list[list[Term | None]]]:
        many = self.take("(")
        names = []
        while self.peek()[0] == "var":
            names.append(self.next()[1][1:])
            if not many:
                break
        if many:
            self.expect(")")
        self.expect("{")
        one = lambda: None if self.take("UNDEF") else self.term()
        rows = []
        while not self.take("}"):
            if many:
                self.expect("(")
                rows.append([one() for _ in names])
                self.expect(")")
            else:
                rows.append([one()])
        return names, rows

    def constraint(self) -> list:
        if self.word() in ("NOT", "EXISTS"):
            return self.primary()
        if self.word() == "(":
            return self.primary()
        return self.call()

    def expression(self) -> list:
        left = self.conjunction()
        while self.take("||"):
            left = ["||", left, self.conjunction()]
        return left

    def conjunction(self) -> list:
        left = self.relation()
        while self.take("&&"):
            left = ["&&", left, self.relation()]
        return left

    def relation(self) -> list:
        left = self.sum()
        if self.word() in ("=", "!=", "<", ">", "<=", ">="):
            op = self.next()[1]
            return [op, left, self.sum()]
        negated = self.word() == "NOT" and self.peek(1)[1].upper() == "IN"
        if negated:
            self.next()
        if self.take("IN"):
            self.expect("(")
            items = []
            while not self.take(")"):
                items.append(self.expression())
                self.take(",")
            found = ["in", left, items]
            return ["!", found] if negated else found
        return left

    def sum(self) -> list:
        left = self.product()
        while self.word() in ("+", "-") or self.peek()[0] == "num" and self.peek()[1][0] in "+-":
            op = self.next()[1] if self.word() in ("+", "-") else "+"
            left = ["math", op, left, self.product()]
        return left

    def product(self) -> list:
        left = self.unary()
        while self.word() in ("*", "/"):
            left = ["math", self.next()[1], left, self.unary()]
        return left

    def unary(self) -> list:
        return ["!", self.unary()] if self.take("!") else self.primary()

    def primary(self) -> list:
        if self.take("("):
            out = self.expression()
            self.expect(")")
            return out
        if self.word() in ("NOT", "EXISTS"):
            negated = self.take("NOT")
            self.expect("EXISTS")
            found = ["exists", self.group()]
            return ["!", found] if negated else found
        if self.word() in AGGREGATES and self.peek(1)[1] == "(":
            return self.aggregate()
        if self.peek()[0] == "name" and self.peek(1)[1] == "(":
            return self.call()
        return ["term", self.term()]

    def call(self) -> list:
        name = self.next()[1].upper()
        self.expect("(")
        args = []
        while not self.take(")"):
            args.append(self.expression())
            self.take(",")
        return ["call", name, args]

    def aggregate(self) -> list:
        """``["agg", name, expression or None for all, distinct, separator]``."""
        name = self.next()[1].upper()
        self.expect("(")
        distinct = self.take("DISTINCT")
        arg = None if self.take("*") else self.expression()
        separator = " "
        if self.take(";"):
            self.expect("SEPARATOR")
            self.expect("=")
            separator = self.term().value
        self.expect(")")
        return ["agg", name, arg, distinct, separator]

    def query(self) -> Query:
        self.expect("SELECT")
        distinct = self.take("DISTINCT", "REDUCED")
        columns: list[str] | None = []
        made: list[tuple[list, str]] = []
        while self.word() not in ("WHERE", "{", "FROM"):
            if self.take("*"):
                columns = None
            elif self.take("("):
                e = self.expression()
                self.expect("AS")
                made.append((e, self.next()[1][1:]))
                self.expect(")")
                columns.append(made[-1][1])  # type: ignore[union-attr]
            else:
                columns.append(self.next()[1][1:])  # type: ignore[union-attr]
        self.take("WHERE")
        where = self.group()
        out = Query(distinct, columns, made, where)
        while self.peek()[0] and self.word() != "}":
            if self.take("GROUP"):
                self.expect("BY")
                while self.peek()[0] == "var" or self.word() == "(":
                    if self.take("("):
                        e = self.expression()
                        self.expect("AS")
                        out.group_by.append(self.next()[1][1:])
                        where.steps.append(("bind", (e, out.group_by[-1])))
                        self.expect(")")
                    else:
                        out.group_by.append(self.next()[1][1:])
            elif self.take("HAVING"):
                while self.word() == "(" or self.peek()[0] == "name" and self.peek(1)[1] == "(":
                    out.having.append(self.constraint())
            elif self.take("ORDER"):
                self.expect("BY")
                while self.peek()[0] == "var" or self.word() in ("ASC", "DESC", "("):
                    down = self.word() == "DESC"
                    self.take("ASC", "DESC")
                    out.order_by.append((self.primary(), not down))
            elif self.take("LIMIT"):
                out.limit = int(self.next()[1])
            elif self.take("OFFSET"):
                out.offset = int(self.next()[1])
            elif self.take("VALUES"):
                where.steps.append(("values", self.values()))
            else:
                raise SparqlError(f"unexpected {self.peek()[1]!r}")
        return out


@dataclass
class Query:
    distinct: bool
    columns: list[str] | None
    made: list[tuple[list, str]]
    where: Group
    group_by: list[str] = field(default_factory=list)
    having: list[list] = field(default_factory=list)
    order_by: list[tuple[list, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


def parse(text: str) -> Query:
    p = _Parser(text.lstrip("﻿"))
    while p.word() in ("PREFIX", "BASE"):
        if p.next()[1].upper() == "PREFIX":
            name = p.next()[1].removesuffix(":")
            p.prefixes[name] = p.next()[1][1:-1]
        else:
            p.next()
    out = p.query()
    if p.peek()[0]:
        raise SparqlError(f"unexpected {p.peek()[1]!r}")
    return out


def _variables(e: object) -> set[str]:
    """Variables of an expression, those of a pattern in EXISTS left out."""
    if isinstance(e, Term):
        return {e.value} if e.kind == "var" else set()
    if isinstance(e, (list, tuple)):
        return set().union(*map(_variables, e)) if e else set()
    return set()


def _aggregates(e: object) -> list[list]:
    if isinstance(e, list) and e and e[0] == "agg":
        return [e]
    return [a for x in e for a in _aggregates(x)] if isinstance(e, (list, tuple)) else []


@dataclass
class Table:
    """Solutions: a column per variable, ``v`` its value and ``v\\tk``, ``v\\tl``, ``v\\td`` its kind, language and datatype."""

    df: DataFrame | None
    bound: set[str]
    maybe: set[str]

    @property
    def names(self) -> set[str]:
        return self.bound | self.maybe


def _parts(v: str) -> list[str]:
    return [v, f"{v}\tk", f"{v}\tl", f"{v}\td"]


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


class Compiler:
    def __init__(self, triples: DataFrame):
        self.triples = triples

    def pattern(self, pattern: tuple[Term, Term, Term]) -> Table:
        df, picks, seen = self.triples, [], {}
        tests = F.lit(True)
        for t, column in zip(pattern, ("s", "p", "o")):
            if t.kind == "var":
                if t.value in seen:
                    tests = tests & (F.col(column) == F.col(seen[t.value]))
                    continue
                seen[t.value] = column
                extra = [F.col("o_kind"), F.col("lang"), F.col("dt")] if column == "o" else [F.lit("uri"), F.lit(None).cast("string"), F.lit(None).cast("string")]
                picks += [c.alias(n) for c, n in zip([F.col(column), *extra], _parts(t.value))]
            else:
                tests = tests & (F.col(column) == t.value)
                if column == "o":
                    tests = tests & (F.col("o_kind") == ("uri" if t.kind == "uri" else "literal"))
                    if t.lang:
                        tests = tests & (F.lower("lang") == t.lang.lower())
                    if t.dt:
                        tests = tests & (F.col("dt") == t.dt)
        df = df.filter(tests).select(*picks) if picks else df.filter(tests).select(F.lit(1).alias("\t1"))
        return Table(df, set(seen), set())

    def join(self, a: Table, b: Table, how: str, conditions: list[list] | None = None) -> Table:
        """``how``: inner, left, left_semi or left_anti. ``conditions`` may name variables of both sides."""
        if a.df is None:
            if how == "inner":
                return b
            one = self.triples.sparkSession.range(1).select(F.lit(1).alias("\t0"))
            return self.join(Table(one, set(), set()), b, how, conditions)
        assert b.df is not None
        shared = a.names & b.names
        renamed = b.df.select(*[_col(c).alias(f"r\t{c}") for c in b.df.columns])
        unsure = sorted(shared & a.maybe)
        more = F.lit(True)
        for e in conditions or []:
            inner = _Scoped(self, {v for v in b.names if v not in a.bound})
            more = more & F.coalesce(inner.boolean(e), F.lit(False))

        def joined(left: DataFrame, loose: bool) -> DataFrame:
            test = more
            for v in sorted(shared):
                same = _col(v) == _col(f"r\t{v}")
                if v in a.maybe and loose:
                    same = same | _col(v).isNull()
                if v in b.maybe:
                    same = same | _col(f"r\t{v}").isNull()
                test = test & same
            return left.join(renamed, test, how)

        if unsure and not shared & b.maybe:
            # Rows that bind all variables meet by equality; only the others are compatible with any value.
            sure = F.lit(True)
            for v in unsure:
                sure = sure & _col(v).isNotNull()
            out = joined(a.df.filter(sure), False).unionByName(joined(a.df.filter(~sure), True))
        else:
            out = joined(a.df, True)
        if how in ("left_semi", "left_anti"):
            return Table(out, a.bound, a.maybe)
        keep = []
        for c in a.df.columns:
            base = c.partition("\t")[0]
            keep.append(F.when(_col(base).isNotNull(), _col(c)).otherwise(_col(f"r\t{c}")).alias(c) if base in shared and base in a.maybe else _col(c))
        keep += [_col(f"r\t{c}").alias(c) for c in b.df.columns if c.partition("\t")[0] not in shared and c not in a.df.columns]
        out = out.select(*keep)
        bound = a.bound | (b.bound if how == "inner" else set())
        return Table(out, bound, (a.names | b.names) - bound)

    def values(self, names: list[str], rows: list[list[Term | None]]) -> Table:
        fields = ", ".join(f"`{c}` string" for v in names for c in _parts(v))
        flat = [[x for t in row for x in ((t.value, t.kind, t.lang, t.dt) if t else (None,) * 4)] for row in rows]
        bound = {v for i, v in enumerate(names) if all(r[i] for r in rows)}
        return Table(self.triples.sparkSession.createDataFrame(flat, fields), bound, set(names) - bound)

    def bgp(self, patterns: list[tuple[Term, Term, Term]]) -> Table:
        left = sorted(patterns, key=lambda p: sum(t.kind == "var" for t in p))
        out = Table(None, set(), set())
        while left:
            near = [p for p in left if out.names & {t.value for t in p if t.kind == "var"}]
            p = (near or left)[0]
            left.remove(p)
            out = self.join(out, self.pattern(p), "inner")
        return out

    def group(self, g: Group, outer: set[str] = frozenset()) -> Table:
        return self.correlated(g, outer)[0]

    def correlated(self, g: Group, outer: set[str]) -> tuple[Table, list[list]]:
        """The group's solutions, and those of its filters that name variables of ``outer`` alone."""
        out = Table(None, set(), set())
        for kind, what in g.steps:
            if kind == "bgp":
                out = self.join(out, self.bgp(what), "inner")  # type: ignore[arg-type]
            elif kind == "optional":
                inner, later = self.correlated(what, out.names)  # type: ignore[arg-type]
                out = self.join(out, inner, "left", later)
            elif kind == "minus":
                inner, later = self.correlated(what, set())  # type: ignore[arg-type]
                if out.names & inner.names:
                    out = self.join(self.overlapping(out, inner), inner, "left_anti", later)
            elif kind == "bind":
                out = self.bind(out, *what)  # type: ignore[misc]
            elif kind == "values":
                out = self.join(out, self.values(*what), "inner")  # type: ignore[misc]
            elif kind == "query":
                out = self.join(out, self.query(what), "inner")  # type: ignore[arg-type]
            else:
                sides = [self.group(s) for s in what]  # type: ignore[attr-defined]
                df = sides[0].df
                for s in sides[1:]:
                    df = df.unionByName(s.df, allowMissingColumns=True)
                both = set.intersection(*[s.bound for s in sides])
                out = self.join(out, Table(df, both, set.union(*[s.names for s in sides]) - both), "inner")
        later = []
        for f in g.filters:
            if (_variables(f) - out.names) & outer:
                later.append(f)
            else:
                out = self.filtered(out, f)
        return out, later

    def overlapping(self, a: Table, b: Table) -> Table:
        """``a`` as MINUS sees it. With a shared variable that both sides bind for sure, solutions are compared as in a join; otherwise those that
        share no bound variable are kept apart, which this form of query leaves to the null tests."""
        if not a.bound & b.bound:
            raise SparqlError("MINUS needs a variable that is bound on both sides")
        return a

    def filtered(self, t: Table, f: list) -> Table:
        """Parts of a conjunction one by one; EXISTS is a semi join, NOT EXISTS an anti join."""
        if f[0] == "&&":
            return self.filtered(self.filtered(t, f[1]), f[2])
        negated = f[0] == "!" and f[1][0] == "exists"
        if f[0] == "exists" or negated:
            inner, later = self.correlated(f[1][1] if negated else f[1], t.names)
            return self.join(t, inner, "left_anti" if negated else "left_semi", later)
        return Table(t.df.filter(F.coalesce(self.boolean(f), F.lit(False))), t.bound, t.maybe)

    def bind(self, t: Table, e: list, name: str) -> Table:
        if t.df is None:
            t = Table(self.triples.sparkSession.range(1).select(F.lit(1).alias("\t0")), set(), set())
        made = [c.alias(n) for c, n in zip(self.typed(e), _parts(name))]
        return Table(t.df.select("*", *made), t.bound, t.maybe | {name})

    def at(self, name: str) -> Column:
        return _col(name)

    def typed(self, e: list) -> list[Column]:
        """Value, kind, language and datatype."""
        none = F.lit(None).cast("string")
        if e[0] == "term" and e[1].kind == "var":
            return [self.at(c) for c in _parts(e[1].value)]
        if e[0] == "term":
            return [F.lit(e[1].value), F.lit(e[1].kind), F.lit(e[1].lang).cast("string"), F.lit(e[1].dt).cast("string")]
        kind = "uri" if e[0] == "call" and e[1] in ("IRI", "URI") else "literal"
        return [self.value(e), F.lit(kind), none, F.lit(XSD + "decimal").alias("d") if e[0] == "math" else none]

    def value(self, e: list) -> Column:
        if e[0] == "term":
            t = e[1]
            return self.at(t.value) if t.kind == "var" else F.lit(t.value)
        if e[0] == "agg":
            return _col(_name(e))
        if e[0] == "math":
            a, b = (self.value(x).try_cast("double") for x in e[2:])
            return _number({"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[e[1]])
        if e[0] == "call":
            name, args = e[1], e[2]
            var = args[0][1].value if args and args[0][0] == "term" and args[0][1].kind == "var" else None
            v = [self.value(a) for a in args] if name not in ("LANG", "DATATYPE", "IF", "BOUND") else []
            if name in ("STR", "IRI", "URI"):
                return v[0]
            if name == "LANG":
                return F.coalesce(self.at(f"{var}\tl"), F.lit(""))
            if name == "DATATYPE":
                return F.coalesce(self.at(f"{var}\td"), F.lit(XSD + "string"))
            if name == "IF":
                return F.when(self.boolean(args[0]), self.value(args[1])).otherwise(self.value(args[2]))
            if name == "COALESCE":
                return F.coalesce(*v)
            if name == "CONCAT":
                return F.concat(*v)
            if name in ("LCASE", "UCASE"):
                return (F.lower if name == "LCASE" else F.upper)(v[0])
            if name == "STRLEN":
                return F.length(v[0]).cast("string")
            if name == "SUBSTR":
                return F.substr(v[0], v[1].try_cast("int"), *[x.try_cast("int") for x in v[2:]])
            if name == "REPLACE":
                return F.regexp_replace(v[0], F.lit(args[1][1].value), F.lit(args[2][1].value))
            if name in ("STRBEFORE", "STRAFTER"):
                cut = F.substring_index(v[0], args[1][1].value, 1)
                return F.when(~v[0].contains(v[1]), "").otherwise(cut if name == "STRBEFORE" else F.substr(v[0], F.length(cut) + F.length(v[1]) + 1))
            if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
                return _number({"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": F.round}[name](v[0].try_cast("double")).cast("double"))
            if name in ("YEAR", "MONTH", "DAY"):
                return F.date_part(F.lit(name), F.substr(v[0], F.lit(1), F.lit(10)).try_cast("date")).cast("string")
            if name in ("MD5", "ENCODE_FOR_URI"):
                return (F.md5 if name == "MD5" else F.url_encode)(v[0])
        raise SparqlError(f"no value: {e[:2]}")

    def boolean(self, e: list) -> Column:
        op = e[0]
        if op == "||":
            return self.boolean(e[1]) | self.boolean(e[2])
        if op == "&&":
            return self.boolean(e[1]) & self.boolean(e[2])
        if op == "!":
            return ~self.boolean(e[1])
        if op == "in":
            return reduce(or_, [self.boolean(["=", e[1], x]) for x in e[2]], F.lit(False))
        if op == "call" and e[1] == "BOUND":
            return self.at(e[2][0][1].value).isNotNull()
        if op == "call" and e[1] == "REGEX":
            flags = "(?i)" if len(e[2]) > 2 and "i" in e[2][2][1].value else ""
            return F.rlike(self.value(e[2][0]), F.lit(flags + e[2][1][1].value))
        if op == "call" and e[1] in ("CONTAINS", "STRSTARTS", "STRENDS"):
            a, b = self.value(e[2][0]), self.value(e[2][1])
            return {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[e[1]](a, b)
        if op == "call" and e[1] in ("ISIRI", "ISURI", "ISLITERAL", "ISBLANK"):
            name = e[2][0][1].value
            blank = self.at(name).startswith("_:")
            own = self.at(f"{name}\tk") == ("literal" if e[1] == "ISLITERAL" else "uri")
            return own if e[1] == "ISLITERAL" else own & blank if e[1] == "ISBLANK" else own & ~blank
        if op == "call" and e[1] == "ISNUMERIC":
            return self.value(e[2][0]).try_cast("double").isNotNull()
        if op == "call" and e[1] == "LANGMATCHES":
            a, b = F.lower(self.value(e[2][0])), F.lower(self.value(e[2][1]))
            return F.when(b == "*", a != "").otherwise((a == b) | a.startswith(F.concat(b, F.lit("-"))))
        if op == "call" and e[1] == "SAMETERM":
            return reduce(and_, [x.eqNullSafe(y) for x, y in zip(self.typed(e[2][0]), self.typed(e[2][1]))])
        if op in ("=", "!=", "<", ">", "<=", ">="):
            a, b = self.value(e[1]), self.value(e[2])
            if any(_numeric(x) for x in e[1:]):
                a, b = a.try_cast("double"), b.try_cast("double")
            return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
        if op == "term" and e[1].kind == "var":
            return self.value(e).isNotNull() & ~self.value(e).isin("", "false", "0")
        if op == "term" and e[1].value in ("true", "false"):
            return F.lit(e[1].value == "true")
        raise SparqlError(f"no condition: {op}")

    def query(self, q: Query) -> Table:
        """All of a query but its choice of columns' order."""
        found = self.group(q.where)
        df = found.df
        assert df is not None
        if q.group_by or _aggregates([e for e, _ in q.made]) or q.having:
            wanted = {_name(a): a for a in _aggregates([[e for e, _ in q.made], q.having, [e for e, _ in q.order_by]])}
            made = [self.aggregate(*a[1:]).alias(n) for n, a in wanted.items()] or [F.count("*").alias("\tn")]
            df = df.groupBy(*[_col(c) for v in q.group_by for c in _parts(v) if c in df.columns]).agg(*made)
            found = Table(df, found.bound & set(q.group_by), found.maybe & set(q.group_by))
        for f in q.having:
            found = self.filtered(found, f)
        for e, name in q.made:
            found = self.bind(found, e, name)
        df = found.df
        columns = q.columns if q.columns is not None else sorted(v for v in found.names if not v.startswith("\x01"))
        for c in columns:
            if c not in df.columns:
                none = F.lit(None).cast("string")
                df = df.select("*", *[none.alias(p) for p in _parts(c)])
        picked = [_col(p) for c in columns for p in _parts(c) if p in df.columns]
        if q.distinct:
            df = df.select(*picked).distinct()
        if q.order_by:
            keys = []
            for e, up in q.order_by:
                v = self.value(e)
                for key in (v.try_cast("double"), v):
                    keys.append(key.asc_nulls_first() if up else key.desc_nulls_last())
            df = df.orderBy(*keys)
        if not q.distinct:
            df = df.select(*picked)
        if q.offset:
            df = df.offset(q.offset)
        df = df.limit(q.limit) if q.limit is not None else df
        bound = found.bound & set(columns)
        return Table(df, bound, set(columns) - bound)

    def aggregate(self, name: str, arg: list | None, distinct: bool, separator: str) -> Column:
        if arg is None:
            return F.count("*").cast("string")
        v = self.value(arg)
        if name == "COUNT":
            return (F.count_distinct(v) if distinct else F.count(v)).cast("string")
        number = v.try_cast("double")
        if name in ("SUM", "AVG"):
            return ({"SUM": F.sum_distinct, "AVG": lambda x: F.sum_distinct(x) / F.count_distinct(x)} if distinct else {"SUM": F.sum, "AVG": F.avg})[name](number).cast("string")
        if name == "GROUP_CONCAT":
            return F.array_join(F.sort_array((F.collect_set if distinct else F.collect_list)(v)), separator)
        # The order of terms: URIs before literals, numbers before text.
        kind = self.typed(arg)[1]
        key = F.struct(F.when(kind == "uri", 0).otherwise(1).alias("k"), number.isNull().alias("t"), number.alias("n"), v.alias("v"))
        least = (F.min if name in ("MIN", "SAMPLE") else F.max)(F.when(v.isNotNull(), key))
        return least["v"]


class _Scoped(Compiler):
    """Conditions of a join: variables of ``inner`` are columns of its right side."""

    def __init__(self, outer: Compiler, inner: set[str]):
        super().__init__(outer.triples)
        self.inner = inner

    def at(self, name: str) -> Column:
        return _col(f"r\t{name}" if name.partition("\t")[0] in self.inner else name)


def _name(aggregate: list) -> str:
    return "\ta" + re.sub(r"[^\w]", "_", repr(aggregate))


def _numeric(e: list) -> bool:
    """Whether an operand says that numbers are compared."""
    return e[0] == "math" or e[0] == "agg" and e[1] in ("COUNT", "SUM", "AVG") or e[0] == "call" and e[1] in ("STRLEN", "ABS", "CEIL", "FLOOR", "ROUND") or (
        e[0] == "term" and e[1].kind == "literal" and bool(re.fullmatch(r"[+-]?\d+(\.\d+)?", e[1].value))
    )


def _number(v: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("long").cast("string")).otherwise(v.cast("string"))


def select(triples: DataFrame, text: str, blank: bool = True) -> DataFrame:
    """The solutions as columns of string; ``blank``: unbound values are empty."""
    q = parse(text)
    found = Compiler(triples).query(q)
    columns = q.columns if q.columns is not None else sorted(found.names)
    return found.df.select(*[(F.coalesce(_col(c), F.lit("")) if blank else _col(c)).alias(c) for c in columns])


def datatypes(triples: DataFrame, text: str) -> dict[str, str | None]:
    """For each variable the first datatype that is not null."""
    found = Compiler(triples).query(parse(text))
    names = [v for v in found.names if f"{v}\td" in found.df.columns]
    one = found.df.agg(*[F.first(_col(f"{v}\td"), ignorenulls=True).alias(v) for v in names]).first() if names else {}
    return {v: one[v] for v in names}
