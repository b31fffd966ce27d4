"""The thematic filter language, compiled to a Column.

``or := and (OR and)*``, ``and := sub (AND sub)*``, ``sub := '(' or ')' | name op 'literal' | 'literal' = name``. Missing
values: ``<>`` holds, all else fails. Ordering operators compare numbers and fail for anything else.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<text>'[^']+')|(?P<op><>|<=|>=|=|<|>)|(?P<open>\()|(?P<close>\))|(?P<word>[\w\[.\]\\:]+))", re.ASCII)


class ExpressionError(ValueError):
    pass


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"cannot read: {text[at:at + 20]!r}")
        kind, value = m.lastgroup or "", m.group(m.lastgroup or 0)
        if kind == "word" and value in ("AND", "OR", "LIKE"):
            kind = value
        out.append((kind, value[1:-1] if kind == "text" else value))
        at = m.end()
    return out


def like_pattern(pattern: str) -> str:
    return "(?is)^(?:" + "".join({"%": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + ")$"


def _compare(value: Column, op: str, literal: str) -> Column:
    if op == "=":
        return F.coalesce(value == literal, F.lit(False))
    if op == "<>":
        return F.coalesce(value != literal, F.lit(True))
    if op == "LIKE":
        return F.coalesce(F.rlike(value, F.lit(like_pattern(literal))), F.lit(False))
    try:
        number = float(literal)
    except ValueError:
        return F.lit(False)
    left = value.try_cast("double")
    test = {"<": left < number, "<=": left <= number, ">": left > number, ">=": left >= number}[op]
    return F.coalesce(test, F.lit(False))


def compile_filter(text: str, attribute: Callable[[str], Column]) -> Column:
    tokens, at = _tokens(text), 0

    def peek() -> str:
        return tokens[at][0] if at < len(tokens) else ""

    def take(*kinds: str) -> str:
        nonlocal at
        if peek() not in kinds:
            raise ExpressionError(f"expected {' or '.join(kinds)} at token {at + 1} of: {text}")
        at += 1
        return tokens[at - 1][1]

    def chain(part: Callable[[], Column], word: str) -> Column:
        out = part()
        while peek() == word:
            take(word)
            other = part()
            out = out | other if word == "OR" else out & other
        return out

    def either() -> Column:
        return chain(lambda: chain(single, "AND"), "OR")

    def single() -> Column:
        if peek() == "open":
            take("open")
            inner = either()
            take("close")
            return inner
        if peek() == "text":
            literal = take("text")
            if take("op") != "=":
                raise ExpressionError("a literal on the left takes =")
            return _compare(attribute(take("word")), "=", literal)
        name = take("word")
        op = take("op", "LIKE")
        return _compare(attribute(name), op, take("text"))

    out = either()
    if at < len(tokens):
        raise ExpressionError(f"unexpected {tokens[at][1]!r} in: {text}")
    return out


_SPATIAL = re.compile(r"(?i)\b(BBOX|INTERSECTS|WITHIN|CONTAINS|DISJOINT|DWITHIN|BEYOND)\s*\(")


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of a call, its bracket taken, and the place behind it."""
    out, depth, begin = [], 1, at
    while depth:
        if at >= len(text):
            raise ExpressionError(f"a bracket is open: {text}")
        c = text[at]
        depth += (c == "(") - (c == ")")
        if depth == 0 or depth == 1 and c == ",":
            out.append(text[begin:at].strip())
            begin = at + 1
        at += 1
    return out, at


def compile_cql(text: str) -> tuple[str, dict[str, tuple[str, list[str]]]]:
    """A CQL condition as SQL, where columns ``__s0``, ``__s1``, .. stand for its spatial words: each with its operator and the
    arguments behind the geometry's name."""
    out, at, calls = "", 0, {}
    while m := _SPATIAL.search(text, at):
        args, end = _arguments(text, m.end())
        name = f"__s{len(calls)}"
        calls[name] = (m[1].upper(), args[1:])
        out += text[at : m.start()] + name
        at = end
    out += text[at:]
    out = re.sub(r"(?i)\bDURING\s+(\S+?)/(\S+)", r"BETWEEN '\1' AND '\2'", out)
    return re.sub(r"(?i)\b(\w+)\s+EXISTS\b", r"\1 IS NOT NULL", out), calls
