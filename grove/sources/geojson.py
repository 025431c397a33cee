"""GeoJSON collections: scan with validation, rows, and segment files with an index."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geo
from . import ranges, versions
from .delimited import SourceError, _exists, take_place
from .scratch import forget, stored

#: source property -> (type, column); the names of the cadastre (fixed values)
PROPERTIES = {
    "pitID": ("string", "pit_id"), "Standort_N": ("long", "site_number"), "Zusatz": ("string", "addition"), "laufende_n": ("long", "serial_number"), "gefaellt": ("boolean", "felled"),
    "Stammdurch": ("double", "trunk_diameter"), "Stammumfan": ("double", "trunk_circumference"), "Kronendurc": ("double", "crown_diameter"), "Baumhoehe_": ("double", "height"), "Baumgruppe": ("long", "tree_group"),
    "Bezirk_Nr": ("long", "district_number"), "Bezirk_Bez": ("string", "district"), "Objekt_Nr": ("long", "object_number"), "Objekt_Bez": ("string", "object"), "Baumart_bo": ("string", "botanic"),
    "Baumart_de": ("string", "common"), "Baumart_ku": ("string", "short"), "PflE_Art_N": ("long", "care_number"), "PflE_Art_B": ("string", "care"), "Stammradiu": ("double", "trunk_radius"), "Kronenradi": ("double", "crown_radius"),
}
FEATURE_LIST = "array<struct<type: string, properties: struct<" + ", ".join(f"{k}: {t}" for k, (t, _) in PROPERTIES.items()) + ">, geometry: struct<type: string, coordinates: array<double>>>>"
SCHEMA = f"crs struct<properties: struct<name: string>>, features {FEATURE_LIST}"


def feature_rows(collections: DataFrame) -> DataFrame:
    """One row per feature of rows with `features`: pos (place in its collection), the properties, lng, lat and wkt.

    With a column utm_zone (see parse_collections), coordinates of collections that have one are brought to degrees.
    """
    rows = collections.select(*[c for c in collections.columns if c != "features"], F.posexplode("features").alias("pos", "f"))
    xy = [F.get(F.col("f.geometry.coordinates"), F.lit(i)) for i in (0, 1)]
    if "utm_zone" in rows.columns:
        plane = F.col("utm_zone").isNotNull()
        xy = [F.when(plane, there).otherwise(here) for there, here in zip(geo.from_utm(*xy, F.col("utm_zone")), xy, strict=True)]
    rows = rows.select(*[c for c in rows.columns if c not in ("f", "utm_zone")], *[F.col(f"f.properties.{k}").alias(c) for k, (_, c) in PROPERTIES.items()], xy[0].alias("lng"), xy[1].alias("lat"))
    return rows.withColumn("wkt", F.concat(F.lit("POINT("), F.col("lng").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")))


def parse_collections(text: Column) -> Column:
    """(features, code, utm_zone) of GeoJSON texts; code: invalid_json, missing_features, not_a_feature (no object), unknown_crs or null.

    Coordinates are degrees (EPSG:4326, CRS84, or no system named) or metres of a northern UTM zone (EPSG:258zz, 326zz), which is told.
    """
    both = F.struct(F.from_json(text, SCHEMA).alias("parsed"), F.try_parse_json(text).alias("json"))
    return F.get(F.transform(F.array(both), _told), F.lit(0))  # a lambda's variable: what it stands for is parsed once, however often it is read


def _told(x: Column) -> Column:
    parsed, json = x["parsed"], x["json"]
    system = F.upper(parsed["crs"]["properties"]["name"])
    zone = F.regexp_extract(system, r"EPSG:+(?:258|326)(\d\d)$", 1)
    known = system.isNull() | system.rlike("(EPSG:+4326|CRS84)$") | zone.between("01", "60")
    code = F.when(json.isNull(), "invalid_json").when(~F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(json, "$.features", "variant")), F.lit("ARRAY")), F.lit(False)), "missing_features")
    code = code.when(parsed["features"].isNull(), "not_a_feature").when(~known, "unknown_crs")
    return F.struct(F.when(code.isNull(), parsed["features"]).alias("features"), code.alias("code"), F.when(zone != "", zone).cast("int").alias("utm_zone"))


#: a closing quote from within a string; the next mark of structure, strings before it passed over; all that is neither mark nor open string
_CLOSE = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
_MARK = re.compile(rb'[^"{}\[\],]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^"{}\[\],]*+)*+[{}\[\],]', re.DOTALL)
_PLAIN = re.compile(rb'[^"]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^"]*+)*+', re.DOTALL)
_KEY = re.compile(rb'\s*"((?:[^"\\]|\\.)*+)"\s*:\s*', re.DOTALL)
DEPTH = 1000  # how deep Spark's parser lets brackets nest (fixed value)
FEATURES = ord("F")  # stands for the bracket of an array that has the key "features"
PAIRS = {ord("{"): ord("}"), ord("["): ord("]"), FEATURES: ord("]")}


class Marks:
    """Marks of structure in the blobs of a text, one blob after the other; quoted: whether a string is open."""

    def __init__(self, quoted: bool) -> None:
        self.quoted = quoted

    def of(self, blob: bytes) -> Iterator[tuple[int, int]]:
        """The place and the mark: a comma, a bracket, or FEATURES. A blob ends behind a brace, or with its text."""
        at = 0
        if self.quoted:
            closed = _CLOSE.match(blob)
            if closed is None:
                return
            at = closed.end()
        while (found := _MARK.match(blob, at)) is not None:
            mark = blob[found.end() - 1]
            if mark == ord("[") and (key := _KEY.fullmatch(blob, at, found.end() - 1)) and _is_features(key[1]):
                mark = FEATURES
            yield found.end() - 1, mark
            at = found.end()
        self.quoted = _PLAIN.match(blob, at).end() < len(blob)


def _is_features(key: bytes) -> bool:
    if b"\\" not in key:
        return key == b"features"
    try:
        return json.loads(b'"' + key + b'"') == "features"
    except ValueError:
        return False


def _blobs(pieces: Iterator[bytes], ended: bool) -> Iterator[bytes]:
    """Some thousand pieces at a time, each with the brace that ends it; ended: the last one has one as well."""
    for chunk, more in ranges.chunks(pieces, 4096):
        yield b"}".join(chunk) + (b"}" if more or ended else b"")


class _Effect:
    """What a range does to the state it begins in: the brackets that it closes and leaves open, and the commas in each array or object that is open at its beginning
    (seen, the innermost first) or at its end."""

    def __init__(self, quoted: bool) -> None:
        self.marks, self.seen, self.closed, self.left, self.commas, self.broken, self.deep = Marks(quoted), [0], bytearray(), bytearray(), [], False, False

    def add(self, blob: bytes) -> None:
        if self.deep:
            return
        seen, closed, left, commas = self.seen, self.closed, self.left, self.commas
        for _, mark in self.marks.of(blob):
            if mark == ord(","):
                (commas or seen)[-1] += 1
            elif mark in PAIRS:
                left.append(mark)
                commas.append(0)
            elif left:
                commas.pop()
                self.broken |= PAIRS[left.pop()] != mark
            else:
                closed.append(mark)
                seen.append(0)
            if len(left) > DEPTH or len(closed) > DEPTH:  # no valid text does this, whatever comes before or after
                self.deep = True
                return

    def told(self) -> dict:
        if self.deep:
            return {"quoted": False, "seen": [], "closed": b"", "left": b"", "commas": [], "broken": True}
        return {"quoted": self.marks.quoted, "seen": self.seen, "closed": bytes(self.closed), "left": bytes(self.left), "commas": self.commas, "broken": self.broken}


_TOLD = pa.struct([("quoted", pa.bool_()), ("seen", pa.list_(pa.int64())), ("closed", pa.binary()), ("left", pa.binary()), ("commas", pa.list_(pa.int64())), ("broken", pa.bool_())])
_EFFECT = "struct<quoted: boolean, seen: array<long>, closed: binary, left: binary, commas: array<long>, broken: boolean>"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: the effect of each range without the brace behind its last piece, for a beginning out of strings and within one."""
    for (path, start), pieces in ranges.by_range(batches):
        n, both = 0, [_Effect(False), _Effect(True)]
        for blob in _blobs(pieces, False):
            n += len(blob)
            for e in both:
                e.add(blob)
        row = {"path": path, "start": start, "n": n, "out": both[0].told(), "within": both[1].told()}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("out", _TOLD), ("within", _TOLD)]))


@dataclass(frozen=True)
class Place:
    """Where a range stands in its file: whether a string is open, which brackets are, the place of the feature it begins in, and whether a brace ends its last piece."""

    quoted: bool
    open: bytes
    pos: int
    ended: bool


def _places(told: list[dict], sizes: dict[str, int]) -> dict[ranges.Key, Place]:
    """What comes before each range, composed along each file; brackets that don't pair are an error."""
    out: dict[ranges.Key, Place] = {}
    for path, group in groupby(sorted(told, key=lambda r: (r["path"], r["start"])), lambda r: r["path"]):
        own = list(group)
        # each piece of a file ends with a brace, but for the last if what is read is a byte short of that (three bytes may be the mark of byte order)
        whole = sum(r["n"] + 1 for r in own) - sizes[path] not in (1, -2)
        quoted, stack, commas, broken = False, bytearray(), [], False
        for r in own:
            e = r["within"] if quoted else r["out"]
            ended = whole or r is not own[-1]
            out[path, r["start"]] = Place(quoted, bytes(stack), commas[1] if len(commas) > 1 else 0, ended)
            broken |= e["broken"]
            closed = [*e["closed"]]
            for j, n in enumerate(e["seen"]):
                if j and (not stack or PAIRS[stack.pop()] != closed[j - 1] or commas.pop() < 0):
                    broken = True
                    break
                if n and not stack:
                    broken = True
                elif n:
                    commas[-1] += n
            stack += e["left"]
            commas += e["commas"]
            quoted = e["quoted"]
            if ended and not quoted and (not stack or PAIRS[stack.pop()] != ord("}") or commas.pop() < 0):
                broken = True
            if broken or len(stack) > DEPTH:
                raise SourceError(f"invalid_json: {path}")
        if quoted or stack:
            raise SourceError(f"invalid_json: {path}")
    return out


def _cut(blobs: Iterator[bytes], place: Place) -> Iterator[tuple[int | None, bool, str, bytes]]:
    """A range in parts: (place of the feature, None for text around the features; whether it is there from its beginning; the mark that ends it, if any does; text)."""
    marks, stack, pos, held = Marks(place.quoted), bytearray(place.open), place.pos, []
    begun = False  # in this range
    for blob in blobs:
        cut = 0
        for at, mark in marks.of(blob):
            level = len(stack)
            if mark in PAIRS:
                stack.append(mark)
                if level == 1 and stack == b"{F":
                    yield None, False, "", b"".join([*held, blob[cut : at + 1]])
                    held, cut, pos, begun = [], at + 1, 0, True
            else:
                if level == 2 and stack == b"{F":
                    yield pos, begun, chr(mark), b"".join([*held, blob[cut:at]])
                    held, cut, pos, begun = [], at + (mark == ord(",")), pos + 1, True
                if mark != ord(","):
                    stack.pop()
        held.append(blob[cut:])
    yield (pos if stack[:2] == b"{F" else None), begun, "", b"".join(held)


_CUT = "path string, start long, nth long, pos long, whole boolean, end string, text binary"


def _by_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, pos, features: the one feature in an array, code, utm_zone), and one row a file without pos for what stands around the features; stored."""
    pieces = ranges.scan_pieces(spark, path, "}", binary=True)
    told = pieces.mapInArrow(_effects, f"path string, start long, n long, out {_EFFECT}, within {_EFFECT}").toArrow().to_pylist()
    lengths = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), "length").collect()  # fewer than ranges
    shared = spark.sparkContext.broadcast(_places(told, {r.path: r.length for r in lengths}))  # one small row a range

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("nth", pa.int64()), ("pos", pa.int64()), ("whole", pa.bool_()), ("end", pa.string()), ("text", pa.binary())])
        for (name, start), own in ranges.by_range(batches):
            place = shared.value[name, start]
            parts = _cut(_blobs(own, place.ended), place)
            rows = ((name, start, nth, pos, begun and end != "", end, text) for nth, (pos, begun, end, text) in enumerate(parts))
            for chunk, _ in ranges.chunks(rows, 1000):
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*chunk, strict=True), schema, strict=True)], schema=schema)

    parts = stored(pieces.mapInArrow(cut, _CUT).withColumn("text", F.col("text").cast("string")))
    whole = parts.filter("whole").select("path", "pos", "end", "text")
    # a feature that crosses ranges, and the text around the features, which a file's first range begins and ends in several
    ordered = F.array_sort(F.collect_list(F.struct("start", "nth", "text")))
    crossing = parts.filter("not whole").groupBy("path", "pos").agg(F.max("end").alias("end"), F.concat_ws("", F.transform(ordered, lambda x: x["text"])).alias("text"))
    rows = whole.unionByName(crossing)
    around = parse_collections(F.col("text"))
    one = F.concat(F.lit("["), "text", F.lit("]"))
    feature = F.from_json(one, FEATURE_LIST)
    # no feature at all is an empty text that ends the array; elsewhere an empty text is one comma too many
    none = F.col("text").rlike(r"^\s*$")
    code = F.when(F.try_parse_json(one).isNull() | (none & ~((F.col("pos") == 0) & (F.col("end") == "]"))), "invalid_json").when(feature.isNull(), "not_a_feature")
    inner = F.struct(feature.alias("features"), code.alias("code"), F.lit(None).cast("int").alias("utm_zone"))
    out = stored(rows.select("path", "pos", F.when(F.col("pos").isNull(), around).otherwise(inner).alias("c")).select("path", "pos", "c.*"))
    forget(parts)
    return out


def scan_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of the file(s) at path as rows; a missing file, broken JSON, a lack of features, a feature that is no object and an unknown system of coordinates are errors of
    their own. Where all is empty, JSON is broken; an empty file beside others has no rows. A byte order mark is dropped.

    A file is read by ranges of its bytes, as many tasks as Spark makes of it, whether it has line breaks or not: texts are cut at braces; a first pass (left out for small
    files) tells of each range which brackets it closes and leaves open, if it begins in a string and if not, and these are composed along the file. So each range knows where
    it begins, and cuts out its features with their places; one that crosses ranges is put together from its parts. Each feature is then parsed on its own and stored, once. A
    task holds one feature's text, and of each file what stands around the features, as one text.
    """
    if not _exists(spark, path):
        raise SourceError(f"file_not_found: {path}")
    if ranges.whole_files(spark, path):
        files = spark.read.text(path, wholetext=True).select(parse_collections(F.regexp_replace("value", "^\ufeff", "")).alias("c")).select("c.*")
        _refuse(files, path)
        return feature_rows(files.select("features", "utm_zone"))
    rows = _by_ranges(spark, path)
    try:
        _refuse(rows, path)
    except SourceError:
        forget(rows)
        raise
    zones = rows.filter("pos is null").select("path", F.col("utm_zone").alias("zone"))
    own = rows.filter("pos is not null").select("path", F.col("pos").cast("int").alias("at"), "features").join(zones, "path")
    return feature_rows(own.select("at", "features", F.col("zone").alias("utm_zone"))).drop("pos").withColumnRenamed("at", "pos")


def _refuse(rows: DataFrame, path: str) -> None:
    told = rows.agg(F.count("*").alias("n"), F.min("code").alias("code")).first()
    if told.code or not told.n:
        raise SourceError(f"{told.code or 'invalid_json'}: {path}")


def write_segments(points: DataFrame, path: str, properties: list[str], n: int = 10) -> DataFrame:
    """Features in folders cell_x=/cell_y=, one a line, and the index as lines of JSON, which it returns: both below path, shown together as one version, so
    that a reader has either all of what was there before or all of this, even if the writer dies in between. The index then also stands below path-index, for
    readers of plain files.

    A view later reads only the folders of its cells: the layout is the partition pruning.
    """
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry")))
    members = geo.grid_members(points, n)
    # a cell with many features is written by several tasks
    segments = members.select("cell_x", "cell_y", feature.alias("value")).hint("rebalance", "cell_x", "cell_y")
    index = geo.grid_index(points, n)
    entry = F.struct(F.col("min_x").alias("minX"), F.col("max_x").alias("maxX"), F.col("min_y").alias("minY"), F.col("max_y").alias("maxY"), F.col("file_name").alias("fileName"))
    lines = index.select(F.to_json(entry, {"ignoreNullFields": "false"}).alias("value"))
    versions.publish({"segments": (segments, "text", ["cell_x", "cell_y"]), "index": (lines, "text", [])}, path)
    beside = f"{path}-index.{uuid.uuid4().hex}"
    spark = points.sparkSession
    spark.read.text(versions.output(spark, path, "index")).write.text(beside + ".new")
    take_place(spark, beside, f"{path}-index")
    return index


def read_segments(spark: SparkSession, path: str, cells: DataFrame | None = None) -> DataFrame:
    """Features of the segments (of the given cells only: their folders are pruned by the join)."""
    rows = spark.read.text(versions.output(spark, path, "segments"))
    if cells is not None:  # small enough to prune folders with only if Spark finds it so
        rows = rows.join(cells.select("cell_x", "cell_y").distinct(), ["cell_x", "cell_y"])
    f = F.from_json("value", "struct<properties: map<string, string>, geometry: struct<coordinates: array<double>>>")
    return rows.select("cell_x", "cell_y", f.alias("f")).select("cell_x", "cell_y", "f.properties", F.get("f.geometry.coordinates", F.lit(0)).alias("lng"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))
