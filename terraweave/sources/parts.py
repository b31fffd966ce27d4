"""Large documents as many rows: one task reads a file as a stream and cuts out its elements, which all tasks then work on."""

from __future__ import annotations

import codecs
import io
import json
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO
from xml.parsers import expat
from xml.sax.saxutils import quoteattr

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
_START_TAG = re.compile(rb"<[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>")
_BOMS = [(codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
#: ``local name, local name of the parent, depth`` of an element (the root's is 0).
Rule = Callable[[str, str, int], bool]


def opened(path: str) -> BinaryIO:
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def can_open(files: DataFrame) -> bool:
    first = files.select("path").first()
    try:
        if first:
            opened(first[0]).close()
        return True
    except (pyarrow.ArrowException, OSError):
        return False


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as the session shuffles to. However many rows a small compressed file holds, few tasks read it, which then do
    all the work on them; so this stands before work that costs more than to move a row. The
    condition, which holds for every row, depends on the task; so Spark cannot move the filters behind it to before the exchange."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).filter(F.spark_partition_id() >= 0)


def _xml_bytes(file: BinaryIO) -> Iterator[bytes]:
    """A document's bytes in UTF-8, whatever its mark or declaration says."""
    first = file.read(CHUNK)
    named = re.match(rb"\s*<\?xml[^>]*?encoding\s*=\s*[\"']([\w.-]+)", first)
    encoding = next((name for bom, name in _BOMS if first.startswith(bom)), None) or (named and named[1].decode()) or ("utf-16" if b"\0" in first[:4] else "utf-8")
    decoder = codecs.getincrementaldecoder(encoding)()
    plain = codecs.lookup(encoding).name == "utf-8"
    while first:
        yield first if plain else decoder.decode(first).encode()
        first = file.read(CHUNK)
    if not plain:
        yield decoder.decode(b"", True).encode()


def xml_elements(file: BinaryIO, wanted: Rule, counted: Rule | None = None, only: str | None = None) -> Iterator[tuple[int, str]]:
    """The outermost elements that are wanted, each with the number of counted elements before it (those of ``wanted`` by default), as documents of their
    own: below an element ``part`` that declares the namespaces in scope and has the root's other attributes. Only one element is held at a time. ``only``: of wanted elements that never hold one of their own name, those of this name."""
    counted = counted or wanted
    parser = expat.ParserCreate("utf-8")
    parser.ordered_attributes = True
    held, base = bytearray(), 0  # the bytes from offset ``base`` on
    names: list[str] = []
    scopes: list[dict[str, str]] = []
    root: dict[str, str] = {}
    doctype, n, first, start, seen, inside = "", 0, 0, 0, 0, None
    done: list[tuple[int, str]] = []

    def head() -> str:
        merged = {**root, **{k: v for s in scopes for k, v in s.items()}}
        return f"{doctype}<part" + "".join(f" {k}={quoteattr(v)}" for k, v in merged.items()) + ">"

    def open_(name: str, attributes: list[str]) -> None:
        nonlocal n, first, start, inside, root, seen
        local, above, depth = name.rpartition(":")[2], names[-1] if names else "", len(names)
        if not depth:
            root = {k: v for k, v in zip(attributes[::2], attributes[1::2]) if not k.startswith("xmlns")}
        if inside is None:
            if wanted(local, above, depth):
                inside, start, first = depth, parser.CurrentByteIndex, n
                if only:
                    parser.StartElementHandler, parser.EndElementHandler = None, lambda ended: ended == name and close(ended)
            else:
                scopes.append({k: v for k, v in zip(attributes[::2], attributes[1::2]) if k.startswith("xmlns")})
        if counted(local, above, depth):
            n += 1
        names.append(local)
        seen = parser.CurrentByteIndex

    def close(name: str) -> None:
        nonlocal inside, seen
        names.pop()
        if inside is None:
            scopes.pop()
        elif inside == len(names):
            tag = _START_TAG.match(held, start - base)
            end = (tag.end() if tag[0].endswith(b"/>") else held.index(b">", parser.CurrentByteIndex - base) + 1) + base
            if only:
                parser.StartElementHandler, parser.EndElementHandler = open_, close
            if only in (None, name.rpartition(":")[2]):
                done.append((first, head() + held[start - base : end - base].decode() + "</part>"))
            inside = None
        seen = parser.CurrentByteIndex

    def doctype_end() -> None:
        nonlocal doctype
        at = parser.CurrentByteIndex - base
        doctype = held[held.rindex(b"<!DOCTYPE", 0, at + 9) : held.index(b">", at) + 1].decode()

    parser.StartElementHandler, parser.EndElementHandler = open_, close
    parser.EndDoctypeDeclHandler = doctype_end
    for chunk in _xml_bytes(file):
        held += chunk
        parser.Parse(chunk, False)
        yield from done
        done.clear()
        keep = start if inside is not None else seen
        if keep > base:
            del held[: keep - base]
            base = keep
    parser.Parse(b"", True)
    yield from done


_JSON = json.JSONDecoder()


class _Text:
    """A JSON text of which only what is being read is held."""

    def __init__(self, file: BinaryIO):
        self.file, self.held, self.at, self.end = file, "", 0, False
        first = file.read(CHUNK)
        self.decoder = codecs.getincrementaldecoder(json.detect_encoding(first[:4]))()
        self.held = self.decoder.decode(first)

    def more(self) -> bool:
        chunk = b"" if self.end else self.file.read(max(CHUNK, len(self.held) - self.at))
        self.end = not chunk
        self.held, self.at = self.held[self.at :] + self.decoder.decode(chunk, self.end), 0
        return not self.end

    def peek(self) -> str:
        """The next character that is no space; empty at the end."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in " \t\r\n﻿":
                self.at += 1
            if self.at < len(self.held) or not self.more():
                return self.held[self.at : self.at + 1]

    def take(self, c: str) -> None:
        if self.peek() != c:
            raise ValueError(f"{c!r} is missing in a JSON document before {self.held[self.at:self.at + 25]!r}")
        self.at += 1

    def value(self) -> tuple[object, str]:
        """The next value and its text."""
        self.peek()
        while True:
            try:
                found, end = _JSON.raw_decode(self.held, self.at)
            except ValueError:
                if not self.more():
                    raise
                continue
            if self.end or self.held[end : end + 1] in list(" \t\r\n,]}:"):  # else a number may go on
                text, self.at = self.held[self.at : end], end
                return found, text
            self.more()

    def items(self, close: str) -> Iterator[None]:
        """Stops before each item of an array or object, its bracket taken, until the closing one is taken."""
        if self.peek() != close:
            yield
            while self.peek() == ",":
                self.at += 1
                yield
        self.take(close)


def json_items(file: BinaryIO) -> Iterator[tuple[str | None, bool, object, str]]:
    """What stands below the root: its key (none below an array), whether it is an element of an array with that key, the value and its text."""
    t = _Text(file)
    if t.peek() == "[":
        t.take("[")
        for _ in t.items("]"):
            yield None, False, *t.value()
    elif t.peek() == "{":
        t.take("{")
        for _ in t.items("}"):
            key = t.value()[0]
            t.take(":")
            if t.peek() == "[":
                t.take("[")
                for _ in t.items("]"):
                    yield str(key), True, *t.value()
            else:
                yield str(key), False, *t.value()
    if t.peek():
        raise ValueError(f"a JSON document goes on behind its end: {t.held[t.at:t.at + 25]!r}")


def split(spark: SparkSession, path: str | list[str], cut: Callable[[BinaryIO], Iterator[tuple]], columns: str) -> DataFrame:
    """``file`` and what ``cut`` yields of each file, dealt among all tasks. Files are read as streams where Arrow's file systems can open their paths;
    elsewhere Spark hands each over whole, and then none can exceed 2 GB."""
    files = spark.read.format("binaryFile").load([path] if isinstance(path, str) else path)
    streams = can_open(files)
    names = ["file", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, name in enumerate(pdf["path"]):
                with opened(name) if streams else io.BytesIO(pdf["content"].iloc[i]) as f:
                    held, size = [], 0
                    for row in cut(f):
                        held.append((name, *row))
                        size += len(row[-1])
                        if len(held) >= 2000 or size > 4 * CHUNK:
                            yield pd.DataFrame(held, columns=names)
                            held, size = [], 0
                    yield pd.DataFrame(held, columns=names)

    return spread(files.select("path", *([] if streams else ["content"])).mapInPandas(run, f"file string, {columns}"))
