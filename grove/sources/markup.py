"""HTML pages and Turtle graphs: the two places where text needs a parser of its own."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def headings(html: Column, level: int = 1) -> Column:
    """Texts of the headings of a level, inner tags removed; JVM only."""
    return F.transform(F.regexp_extract_all(html, F.lit(f"(?is)<h{level}[^>]*>(.*?)</h{level}>"), 1), lambda t: F.trim(F.regexp_replace(t, "<[^>]*>", "")))


def items(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit("(?is)<li[^>]*>(.*?)</li>"), 1), lambda t: F.trim(F.regexp_replace(t, "<[^>]*>", "")))


class _Tables(HTMLParser):
    """(group, cell text, title) of table cells under the h4 heading before the table."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.group, self.text, self.title, self.inside = [], None, None, None, None

    def handle_starttag(self, tag, attrs):
        if tag in ("h4", "td"):
            self.text, self.inside, self.title = "", tag, dict(attrs).get("title")
        elif self.inside == "td" and dict(attrs).get("title"):
            self.title = self.title or dict(attrs)["title"]

    def handle_data(self, data):
        if self.inside:
            self.text += data

    def handle_endtag(self, tag):
        if tag == self.inside:
            text = " ".join(self.text.split())
            if tag == "h4":
                self.group = text
            elif self.group is not None:
                self.rows.append((self.group, text, self.title))
            self.inside = None


def table_attributes(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, group_name, attribute, description) of the cells of tables below h4 headings, one task a batch of pages."""
    kind = dict(pages.dtypes)[key]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text in enumerate(b.column(1).to_pylist()):
                p = _Tables()
                p.feed(text or "")
                out += [(i, n, *r) for n, r in enumerate(p.rows)]
            keys = b.column(0).take(pa.array([o[0] for o in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([o[1] for o in out], pa.int32()), *[pa.array([o[j] for o in out], pa.string()) for j in (2, 3, 4)]], names=[key, "pos", "group_name", "attribute", "description"])

    return pages.select(key, html).mapInArrow(parse, f"`{key}` {kind}, pos int, group_name string, attribute string, description string")


#: what the tables of a page are about, in their order (fixed values)
CATEGORIES = ["Klimabedingungen", "Bodenbedingungen", "Natürliche Verbreitung", "Habitus", "Blatt", "Blüte", "Frucht", "Gefährdung", "Beeinträchtigungen"]


class _Grids(HTMLParser):
    """The rows of cell texts of each table; a table inside a cell is one of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append((self.tables[-1], [False]))
        elif self.open and tag == "tr":
            self.open[-1][0].append([])
            self.open[-1][1][0] = False
        elif self.open and tag in ("td", "th") and self.open[-1][0]:
            self.open[-1][0][-1].append("")
            self.open[-1][1][0] = True

    def handle_data(self, data):
        if self.open and self.open[-1][1][0]:
            self.open[-1][0][-1][-1] += data

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th"):
            self.open[-1][1][0] = False
        elif self.open and tag == "table":
            self.open.pop()


def named_tables(pages: DataFrame, key: str, source: str, html: str = "html", names: list[str] = CATEGORIES) -> DataFrame:
    """(key, category, row, cells, source) of each row of the page's tables, which get the names in order.

    Tables without a cell don't count, and tables beyond the names go; `source` is the column that says where the page is from.
    """
    kinds = dict(pages.dtypes)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text in enumerate(b.column(2).to_pylist()):
                p = _Grids()
                p.feed(text or "")
                full = [rows for rows in ([r for r in t if r] for t in p.tables) if rows]
                out += [(i, name, n, [" ".join(c.split()) for c in r]) for name, rows in zip(names, full, strict=False) for n, r in enumerate(rows)]
            at = pa.array([o[0] for o in out], pa.int64())
            new = [pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *new, b.column(1).take(at)], names=[key, "category", "row", "cells", "source"])

    return pages.select(key, F.col(source).alias("source"), html).mapInArrow(parse, f"`{key}` {kinds[key]}, category string, row int, cells array<string>, source {kinds[source]}")


def first_descriptions(cells: DataFrame, key: str) -> DataFrame:
    """The first description that each attribute has."""
    order = F.struct(key, "pos")
    return cells.filter("description is not null").groupBy("attribute").agg(F.min_by("description", order).alias("description"), F.min_by("group_name", order).alias("group_name"))


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3})|(?P<text>"(?:[^"\\\n]|\\.)*")"""
    r"""|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<typed>\^\^)|(?P<end>[.;,])(?=\s|$|[<"#])|(?P<number>[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?=[\s;,.])|(?P<name>[A-Za-z_][\w.-]*(?<!\.):?[\w%-]*(?:\.[\w%-]+)*|:[\w%-]+|:)|(?P<stop>[.;,])"""
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


class TurtleError(ValueError):
    pass


def _unescape(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), s, flags=re.S)


def read_turtle(text: str) -> list[tuple[str, str, str, str, str | None]]:
    """Facts (s, p, o_kind, o_value, o_lang) of a Turtle text without blank nodes and lists; a malformed text is an error."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise TurtleError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            tokens.append(("end" if m.lastgroup == "stop" else m.lastgroup, m[m.lastgroup]))
    prefixes: dict[str, str] = {}
    out, i = [], 0

    def take(*kinds: str) -> tuple[str, str]:
        nonlocal i
        if i >= len(tokens) or tokens[i][0] not in kinds:
            raise TurtleError(f"expected {' or '.join(kinds)} at token {i}")
        i += 1
        return tokens[i - 1]

    def iri(tok: tuple[str, str]) -> str:
        if tok[0] == "iri":
            return _unescape(tok[1][1:-1])
        if tok[1] == "a":
            return TYPE
        head, colon, tail = tok[1].partition(":")
        if not colon or head not in prefixes:
            raise TurtleError(f"unknown prefix in {tok[1]!r}")
        return prefixes[head] + tail

    while i < len(tokens):
        kind, word = tokens[i]
        if (kind, word) == ("lang", "@prefix") or (kind == "name" and word.upper() == "PREFIX"):
            i += 1
            name = take("name")[1]
            prefixes[name.rstrip(":")] = iri(take("iri"))
            if kind == "lang":
                take("end")
            continue
        s = iri(take("iri", "name"))
        while True:
            p = iri(take("iri", "name"))
            while True:
                k, w = take("iri", "name", "text", "long", "number")
                if k in ("text", "long"):
                    value, lang = _unescape(w[3:-3] if k == "long" else w[1:-1]), None
                    if i < len(tokens) and tokens[i][0] == "lang":
                        lang = take("lang")[1][1:].lower()
                    elif i < len(tokens) and tokens[i][0] == "typed":
                        i += 1
                        take("iri", "name")
                    out.append((s, p, "literal", value, lang))
                elif k == "number" or w in ("true", "false"):
                    out.append((s, p, "literal", w, None))
                else:
                    out.append((s, p, "iri", iri((k, w)), None))
                sep = take("end")[1]
                if sep != ",":
                    break
            if sep == "." or (i < len(tokens) and tokens[i] == ("end", ".")):
                if sep == ";":
                    i += 1
                break
    return list(dict.fromkeys(out))


#: a statement on a line of its own, all of it written out: what read_turtle makes of it is known without tokens
_IRI = r"<([^<>\"{}|^`\\\s]*)>"
_STATEMENT = re.compile(rf"""{_IRI}[ \t]+{_IRI}[ \t]+(?:{_IRI}|"([^"\\\n]*(?:\\.[^"\\\n]*)*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)[ \t]+\.(?:\s+|\Z)""")
FACT = ["s", "p", "o_kind", "o_value", "o_lang"]


def turtle_columns(text: str) -> list[list[str | None]]:
    """The facts of read_turtle as five lists. Texts that hold nothing but lines of written-out statements are cut by one pattern, all others are parsed."""
    parts = _STATEMENT.split(text)
    if any(parts[::6]):  # something stands between or around such lines
        return [list(c) for c in zip(*read_turtle(text), strict=True)] or [[] for _ in FACT]
    s, p, links, texts, langs = (parts[i::6] for i in range(1, 6))
    values = [x if v is None else v for x, v in zip(links, texts, strict=True)]
    if "\\" in text:
        values = [_unescape(v) if "\\" in v else v for v in values]
    columns = [s, p, ["literal" if x is None else "iri" for x in links], values, [x and x.lower() for x in langs]]
    once = dict.fromkeys(zip(*columns, strict=True))
    return columns if len(once) == len(s) else [list(c) for c in zip(*once, strict=True)]


def scan_turtle(files: DataFrame, most: int = 100_000) -> DataFrame:
    """Triples of rows (entity, text), a graph each; some `most` triples at a time."""
    schema = pa.schema([(c, pa.string()) for c in ("entity", *FACT)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in schema]
        for b in batches:
            for e, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                columns = turtle_columns(text or "")
                for into, new in zip(held, [[e] * len(columns[0]), *columns], strict=True):
                    into += new
                if len(held[0]) >= most:
                    yield pa.record_batch(held, schema=schema)
                    held = [[] for _ in schema]
        yield pa.record_batch(held, schema=schema)

    return files.select("entity", "text").mapInArrow(parse, "entity string, s string, p string, o_kind string, o_value string, o_lang string")


def missing_graphs(targets: DataFrame, triples: DataFrame) -> DataFrame:
    return targets.join(triples.select(F.col("entity").alias("qid")).distinct(), "qid", "left_anti")


def turtle_lines(triples: DataFrame) -> DataFrame:
    """(entity, line): each fact as a line of Turtle; JVM only."""
    quoted = F.col("o_value")
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        quoted = F.replace(quoted, F.lit(raw), F.lit(out))
    literal = F.concat(F.lit('"'), quoted, F.lit('"'), F.coalesce(F.concat(F.lit("@"), "o_lang"), F.lit("")))
    o = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o_value", F.lit(">"))).otherwise(literal)
    return triples.select("entity", F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("line"))
