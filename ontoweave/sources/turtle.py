"""Turtle files as quads: a parser, a reader over many files, and a Spark data source.

A file is one unit of work (its prefixes and blank nodes hold throughout it); files are parsed in parallel.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ontoweave.errors import ParseError
from ontoweave.functions.text import RDF, XSD

QUAD = "graph_id string, s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string"

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n\r]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>"{}|^`\\\x00-\x20]*)*>)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix\b|@base\b|(?i:PREFIX|BASE)(?=\s))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<double>[+-]?(?:[0-9]+\.[0-9]*|\.?[0-9]+)[eE][+-]?[0-9]+)
    |(?P<decimal>[+-]?[0-9]*\.[0-9]+)
    |(?P<integer>[+-]?[0-9]+)
    |(?P<bnode>_:[\w](?:[\w.\-·]*[\w\-·])?)
    |(?P<name>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[^\w\s])(?:(?:[\w\-.:]|%[0-9A-Fa-f]{2}|\\[^\w\s])*(?:[\w\-:]|%[0-9A-Fa-f]{2}|\\[^\w\s]))?)?)
    |(?P<word>a(?![\w:])|true\b|false\b)
    |(?P<mark>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _plain(text: str) -> str:
    def one(m):
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "uU" else _ESCAPES.get(x, x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


@dataclass(frozen=True)
class Term:
    kind: str
    value: str
    datatype: str | None = None
    lang: str | None = None


class _Parser:
    def __init__(self, text: str, base: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                line = text.count("\n", 0, at) + 1
                raise ParseError(f"line {line}: unexpected {text[at:at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.text, self.base, self.prefixes, self.at, self.fresh, self.out = text, base, {}, 0, 0, []

    def fail(self, wanted: str):
        where = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "end of file", len(self.text))
        raise ParseError(f"line {self.text.count(chr(10), 0, where[2]) + 1}: {wanted} expected, not {where[1]!r}")

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at][:2] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        k, v = self.peek()
        if (kind and k != kind) or (value and v != value) or k == "end":
            self.fail(value or kind or "more")
        self.at += 1
        return v

    def blank(self) -> Term:
        self.fresh += 1
        return Term("bnode", f"b{self.fresh - 1}_")

    def iri(self) -> Term:
        kind, v = self.peek()
        if kind == "iri":
            self.at += 1
            x = _plain(v[1:-1])
            return Term("iri", x if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", x) else urljoin(self.base, x) if self.base else x)
        if kind == "name":
            self.at += 1
            prefix, _, local = v.partition(":")
            if prefix not in self.prefixes:
                self.at -= 1
                self.fail(f"a known prefix (not {prefix}:)")
            return Term("iri", self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        self.fail("an IRI")

    def document(self):
        while self.peek()[0] != "end":
            kind, v = self.peek()
            if kind == "directive":
                self.at += 1
                if v.lower().endswith("prefix"):
                    name = self.take("name")
                    if not name.endswith(":"):
                        self.fail("a prefix")
                    self.prefixes[name[:-1]] = self.iri().value
                else:
                    self.base = self.iri().value
                if v.startswith("@"):
                    self.take("mark", ".")
                continue
            if self.peek() == ("mark", "["):
                s = self.node()
                if self.peek() != ("mark", "."):
                    self.predicates(s)
            else:
                s = self.node()
                if s.kind == "literal":
                    self.at -= 1
                    self.fail("a subject")
                self.predicates(s)
            self.take("mark", ".")
        return self.out

    def predicates(self, s: Term):
        while True:
            p = Term("iri", RDF + "type") if self.peek() == ("word", "a") and self.take() else self.iri()
            while True:
                self.out.append((s, p.value, self.node()))
                if self.peek() != ("mark", ","):
                    break
                self.at += 1
            if self.peek() != ("mark", ";"):
                return
            while self.peek() == ("mark", ";"):
                self.at += 1
            if self.peek() in (("mark", "."), ("mark", "]"), ("end", "")):
                return

    def node(self) -> Term:
        kind, v = self.peek()
        if kind == "bnode":
            self.at += 1
            return Term("bnode", v[2:])
        if (kind, v) == ("mark", "["):
            self.at += 1
            s = self.blank()
            if self.peek() != ("mark", "]"):
                self.predicates(s)
            self.take("mark", "]")
            return s
        if (kind, v) == ("mark", "("):
            self.at += 1
            items = []
            while self.peek() != ("mark", ")"):
                items.append(self.node())
            self.at += 1
            rest = Term("iri", RDF + "nil")
            for item in reversed(items):
                cell = self.blank()
                self.out += [(cell, RDF + "first", item), (cell, RDF + "rest", rest)]
                rest = cell
            return rest
        if kind in ("string", "long"):
            self.at += 1
            text = _plain(v[3:-3] if kind == "long" else v[1:-1])
            if self.peek()[0] == "lang":
                return Term("literal", text, RDF + "langString", self.take()[1:])
            if self.peek()[0] == "type":
                self.at += 1
                return Term("literal", text, self.iri().value)
            return Term("literal", text, XSD + "string")
        if kind in ("double", "decimal", "integer"):
            self.at += 1
            return Term("literal", v, XSD + kind)
        if kind == "word" and v != "a":
            self.at += 1
            return Term("literal", v, XSD + "boolean")
        return self.iri()


def parse_turtle(text: str, base: str = "") -> list[tuple]:
    """(s, s_kind, p, o, o_kind, o_datatype, o_lang) of every statement, in order and once each."""
    rows = _Parser(text, base).document()
    return list(dict.fromkeys((s.value, s.kind, p, o.value, o.kind, o.datatype, o.lang) for s, p, o in rows))


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Quads of all files of a path, folder or glob that Spark can read; graph_id is the file's path."""
    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in QUAD.split(", ")]
        for batch in batches:
            for name, text in zip(batch["path"], batch["value"], strict=True):
                yield pd.DataFrame([(name, *row) for row in parse_turtle(text)], columns=names)

    files = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as path", "value")
    return files.mapInPandas(run, QUAD)


def turtle_quads(spark: SparkSession, text: str, graph_id: str = "0") -> DataFrame:
    """Quads of one text."""
    return spark.createDataFrame([(graph_id, *row) for row in parse_turtle(text)], QUAD)


class TurtleSource(DataSource):
    """spark.read.format("turtle").load(path) after spark.dataSource.register(TurtleSource), for files that tasks can open."""

    @classmethod
    def name(cls):
        return "turtle"

    def schema(self):
        return QUAD

    def reader(self, schema):
        return _TurtleReader(self.options)


class _TurtleReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(f"{self.path}/*.ttl") if os.path.isdir(self.path) else glob.glob(self.path))
        return [InputPartition(f) for f in found]

    def read(self, partition):
        with open(partition.value, encoding="utf-8") as f:
            for row in parse_turtle(f.read()):
                yield (partition.value, *row)
