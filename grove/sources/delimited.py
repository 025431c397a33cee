"""Delimited text with a header contract: exact header, minimal number of fields, trimmed fields, source lines."""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, groupby, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import csv_field, trimmed
from . import ranges

MAPPING = ["baumart_bo", "baumart_de", "wikidata_id"]  # header of a mapping file (fixed values)
REVIEW = ["wikidata_id", "baumart_bo", "baumart_de", "property_id", "attribute_name", "value", "group"]  # of a review file (fixed values)
CONFIG = ["property_id", "type", "action", "config", "description", "import"]  # of a property configuration (fixed values)


class SourceError(ValueError):
    """A file that breaks its contract: kind, path and line."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: a quoted field from within, up to the quote that closes it
_CLOSE = re.compile(r'[^"]*+(?:""[^"]*+)*+"')


@cache
def _mark(sep: str) -> re.Pattern[str]:
    """Where a quoted field begins after another field, or a row ends within a line."""
    return re.compile(re.escape(sep) + '"|\r')


def after(line: str, sep: str, quoted: bool) -> tuple[bool, int]:
    """Whether a quoted field is open where a line ends, and how many rows (blank ones aside) end in it; quoted: one is open where it begins."""
    line = line.removesuffix("\r")
    if '"' not in line and "\r" not in line:
        return quoted, int(not quoted and line != "")
    ended, begin, some, at = 0, 0, quoted, 0
    mark = _mark(sep)
    if not quoted and line.startswith('"'):
        quoted, at = True, 1
    while True:
        if quoted:
            closed = _CLOSE.match(line, at)
            if closed is None:
                return True, ended
            at, some = closed.end(), True
        found = mark.search(line, at)
        if found is None:
            return False, ended + int(some or len(line) > begin)
        at, quoted = found.end(), found[0] != "\r"
        if not quoted:  # a carriage return of its own ends a row as well
            ended += int(some or found.start() > begin)
            begin, some = at, False
            if line.startswith('"', at):
                quoted, at = True, at + 1


@dataclass(frozen=True)
class Place:
    """Where a range stands in its file: whether a quoted field is open at its beginning and at its end, the rows that ended before, and the range
    in which the lines that hold the open field began; and whether a carriage return stands within one of its lines."""

    quoted: bool = False
    open: bool = False
    before: int = 0
    owner: int = 0
    returns: bool = False


def _first(start: int, lines: Iterator[str]) -> Iterator[str]:
    """The lines of a range, without the byte order mark of a file."""
    for i, line in enumerate(lines):
        yield line.removeprefix("\ufeff") if i == 0 and start == 0 else line


def _effects(batches: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    """First pass: whether a range ends in quotes and how many rows end in it, for either state it may begin in; and whether any
    line ends out of quotes if it begins in them, and any has a carriage return within."""
    for (path, start), lines in ranges.by_range(batches):
        ends, rows, closed, returns = [False, True], [0, 0], False, False
        for line in _first(start, lines):
            if ends[0] == ends[1]:
                quoted, n = after(line, sep, ends[0])
                ends, rows = [quoted, quoted], [rows[0] + n, rows[1] + n]
            else:
                for k in (0, 1):
                    ends[k], n = after(line, sep, ends[k])
                    rows[k] += n
            closed |= not ends[1]
            returns = returns or "\r" in line[:-1]
        yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "end0": ends[0], "end1": ends[1], "n0": rows[0], "n1": rows[1], "closed": closed, "returns": returns}])


def _places(pieces: DataFrame, sep: str) -> dict[ranges.Key, Place]:
    """What comes before each range, composed along each file."""
    told = pieces.mapInArrow(lambda batches: _effects(batches, sep), "path string, start long, end0 boolean, end1 boolean, n0 long, n1 long, closed boolean, returns boolean").toArrow().to_pylist()
    out: dict[ranges.Key, Place] = {}
    for path, own in groupby(sorted(told, key=lambda r: (r["path"], r["start"])), lambda r: r["path"]):
        quoted, before, owner = False, 0, 0
        for r in own:
            end, n = (r["end1"], r["n1"]) if quoted else (r["end0"], r["n0"])
            out[path, r["start"]] = Place(quoted, end, before, owner, r["returns"])
            if not quoted or r["closed"]:  # what is open at the end began here
                owner = r["start"]
            quoted, before = end, before + n
    return out


def _split(lines: Iterator[str], sep: str, place: Place) -> Iterator[tuple[str, list[str], int]]:
    """The lines of a range: (`head`, those of a row that began before), (`rows`, lines of whole rows) one row at a time, (`tail`, of a row that
    is open at its end). The number is that of the rows that ended before."""
    quoted, held, before, ended = place.quoted, [], place.before, 0
    kind = "head" if quoted else "rows"
    for line in lines:
        held.append(line)
        quoted, n = after(line, sep, quoted)
        ended += n
        if not quoted:
            yield kind, held, before
            kind, held, before = "rows", [], place.before + ended
    if held:
        yield ("head" if kind == "head" else "tail"), held, before


ROWS = "line long, f array<string>"


@dataclass(frozen=True)
class Contract:
    """What a delimited file has to hold."""

    columns: tuple[str, ...]
    sep: str
    header: bool
    ragged: bool

    def rows(self, name: str, lines: Iterator[str], before: int, cut: bool = False) -> Iterator[pa.RecordBatch]:
        """Fields of the rows in some lines, with their numbers, some thousand at a time; cut: the last row is not whole and left out."""
        n, line, fields = len(self.columns), [], []
        schema = pa.schema([("line", pa.int64()), ("f", pa.list_(pa.string()))])
        csv.field_size_limit(1 << 62)  # a field may be as long as its file
        found = (r for r in csv.reader(lines, delimiter=self.sep) if r)
        for i, r in enumerate((r for r, _ in pairwise(found)) if cut else found, before + 1):
            if self.header and i == 1:
                if r != list(self.columns):
                    raise SourceError(f"invalid_header: {name}: {r}")
                continue
            if len(r) < n and not self.ragged:
                raise SourceError(f"invalid_row_format: {name}, line {i}")
            line.append(i)
            fields.append((r + [""] * n)[:n])
            if len(line) == 10_000:
                yield pa.record_batch([line, fields], schema=schema)
                line, fields = [], []
        if line:
            yield pa.record_batch([line, fields], schema=schema)


def _text(lines: list[str], last: bool = False) -> Iterator[str]:
    """Lines as the parser wants them: with their breaks, those inside a line kept apart. last: a field that the file's end leaves open
    ends without a break."""
    if last or any("\r" in x for x in lines):
        return iter(io.StringIO("\n".join(lines) + ("" if last else "\n"), newline=""))
    return (x + "\n" for x in lines)


def _broken(lines: Iterator[str]) -> Iterator[str]:
    """Lines with a break between them, none behind the last."""
    held = next(lines, None)
    for line in lines:
        yield held + "\n"
        held = line
    if held is not None:
        yield held


def _behind_head(lines: Iterator[str], sep: str, place: Place) -> tuple[int, Iterator[str]]:
    """The lines behind the row that began before the range, and how many rows ended before them."""
    quoted, before = place.quoted, place.before
    while quoted and (line := next(lines, None)) is not None:
        quoted, n = after(line, sep, quoted)
        before += n
    return before, lines


def scan(spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: bool = True, ragged: bool = False, untrimmed: tuple[str, ...] = ()) -> DataFrame:
    """The rows of the file(s) at path with `line`, the ordinal of the row in its file (the header is 1, the first row 2).

    The header must be `columns` exactly; a row needs at least as many fields, unless ragged, where missing ones are empty.
    Blank lines are skipped. Fields are trimmed of Unicode white space but for those in untrimmed. A byte order mark is dropped.

    A file is read by ranges of its bytes, as many tasks as Spark makes of it, although quoted fields may hold line breaks: a first pass (left out for
    small files) tells of each range whether it ends in quotes, and how many rows end in it, for both states it may begin in. A row that crosses into
    further ranges is put together from its parts. A field may be as long as its file; a task holds one row's text at a time. Of a field that the end of
    its file leaves open, a last line break is not kept.
    """
    pieces = ranges.scan_pieces(spark, path)
    contract = Contract(tuple(columns), sep, header, ragged)
    places = {} if ranges.whole_files(spark, path) else _places(pieces, sep)
    shared = spark.sparkContext.broadcast(places)  # one small row a range
    crossing = any(p.quoted or p.open for p in places.values())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, start), lines in ranges.by_range(batches):
            place = shared.value.get((name, start), Place())
            if shared.value and not place.returns:  # the parser finds the rows' ends by itself
                before, rest = _behind_head(_first(start, lines), sep, place)
                yield from contract.rows(name, _broken(rest), before, place.open)
                continue
            begun: list[int] = []

            def own(lines: Iterator[str], place: Place, begun: list[int], name: str = name, start: int = start) -> Iterator[str]:
                for kind, held, before in _split(_first(start, lines), sep, place):
                    if kind == "rows" or kind == "tail" and not shared.value:
                        begun[:] = begun or [before]
                        yield from _text(held, kind == "tail")

            texts = own(lines, place, begun)
            first = next(texts, None)
            if first is not None:
                yield from contract.rows(name, chain([first], texts), begun[0])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Second pass: the parts of rows that cross ranges, to the range they began in."""
        for (name, start), lines in ranges.by_range(batches):
            place = shared.value[name, start]
            if place.quoted or place.open:
                for kind, held, before in _split(_first(start, lines), sep, place):
                    if kind != "rows":
                        owner = place.owner if kind == "head" else start
                        yield pa.RecordBatch.from_pylist([{"path": name, "owner": owner, "start": start, "before": before, "text": "\n".join(held)}])

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by("start")
        lines = "\n".join(t.column("text").to_pylist()).split("\n")
        open_still = after("\n".join(lines), sep, False)[0]
        batches = list(contract.rows(t.column("path")[0].as_py(), _text(lines, open_still), t.column("before")[0].as_py()))
        return pa.Table.from_batches(batches, pa.schema([("line", pa.int64()), ("f", pa.list_(pa.string()))]))

    rows = pieces.mapInArrow(parse, ROWS)
    if crossing:
        rows = rows.unionByName(pieces.mapInArrow(parts, "path string, owner long, start long, before long, text string").groupBy("path", "owner").applyInArrow(join, ROWS))
    cell = lambda i, c: F.get("f", F.lit(i)) if c in untrimmed else trimmed(F.get("f", F.lit(i)))
    return rows.select("line", *[cell(i, c).alias(c) for i, c in enumerate(columns)])


def scan_mapping(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, MAPPING)


def scan_review(spark: SparkSession, path: str) -> DataFrame:
    """As written by write_review; `value` keeps its white space."""
    return scan(spark, path, REVIEW, sep=";", untrimmed=("value",))


def scan_config(spark: SparkSession, path: str) -> DataFrame:
    """The property configuration; rows with a blank id are left out. Feed it to attributes.parse_config."""
    return scan(spark, path, CONFIG, sep=";", ragged=True).filter("property_id <> ''")


def scan_optional(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """No rows where there is no file."""
    if _exists(spark, path):
        return scan(spark, path, columns, sep)
    return spark.createDataFrame([], "line long, " + ", ".join(f"`{c}` string" for c in columns))


def write_review(rows: DataFrame, path: str, columns: list[str] = REVIEW, order: list[str] = (), sep: str = ";") -> None:
    """Lines of fields that are quoted only where needed, below a header in every file, in a fixed order.

    The order is a range partition, so files sort one after the other. They are written beside path and take its place by a rename once all are done, so a writer
    that dies leaves what was there.
    """
    line = F.concat_ws(sep, *[csv_field(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), sep) for c in columns])
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    lines = dealt.select(line.alias("value"))
    head = sep.join(columns)

    def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            if first and b.num_rows:
                first = False
                yield pa.RecordBatch.from_arrays([pa.array([head])], schema=b.schema)
            yield b

    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    lines.mapInArrow(with_header, "value string").write.text(beside + ".new")
    take_place(rows.sparkSession, beside, path)


def take_place(spark: SparkSession, beside: str, path: str) -> None:
    """Folder beside.new becomes path. Between the two renames path is gone for a moment, but both the old and the new stand beside it."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    old, new, own = place(beside + ".old"), place(beside + ".new"), place(path)
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(own) and not fs.rename(own, old):
        raise OSError(f"can't replace {path}")
    if not fs.rename(new, own):
        raise OSError(f"can't write {path}")
    fs.delete(old, True)
