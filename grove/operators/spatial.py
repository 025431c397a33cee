"""Stored points in a spatial order, searched by their files' boxes, and boxes joined to points through a quadtree. Points have lng and lat columns in degrees."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import geo

ORDER_BITS = 26
DEPTH, STEP = 24, 4  # levels of the quadtree, and how many of them one histogram decides
FILES_A_ROUND = 1000


def is_placed() -> Column:
    """Both coordinates are finite numbers."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)
    return finite("lat") & finite("lng")


def cell_of(v: Column, low: float, width: float, bits: int) -> Column:
    """Number of the cell, of 2**bits over the width, that holds v; what lies outside is in the first or last one. Never falls as v grows."""
    return F.floor(F.least(F.greatest((v - low) / (width or 1.0) * (1 << bits), F.lit(0.0)), F.lit(float((1 << bits) - 1)))).cast("long")


def hilbert(x: Column, y: Column, bits: int = ORDER_BITS) -> Column:
    """Place of a cell on the Hilbert curve over 2**bits by 2**bits cells: neighbours on the curve are neighbours on the map, so that a run of it has a small box."""
    def turn(at: Column, bit: Column) -> Column:
        right, up = (F.call_function("shiftright", at[c], bit).bitwiseAND(F.lit(1).cast("long")) for c in ("x", "y"))
        flip = lambda c: F.when(right == 1, F.lit((1 << bits) - 1).cast("long") - at[c]).otherwise(at[c])
        step = F.when((right == 1) & (up == 0), 3).when(right == 1, 2).otherwise(up).cast("long")
        return F.struct(F.when(up == 0, flip("y")).otherwise(at["x"]).alias("x"), F.when(up == 0, flip("x")).otherwise(at["y"]).alias("y"), (at["d"] * 4 + step).alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, turn, lambda at: at["d"])


def write_points(points: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Points as files of about rows_per_file rows along a Hilbert curve under path/points, and each file's box under path/index, written last: without it there is no table.

    Points in one place are told apart by a hash of their columns, so they make several files; only copies of a whole row keep together. Rows
    without finite coordinates are kept, in no box. The path must be new.
    """
    place = hilbert(cell_of(F.col("lng"), -180.0, 360.0, ORDER_BITS), cell_of(F.col("lat"), -90.0, 180.0, ORDER_BITS))
    plain = [F.col(f"`{f.name}`") for f in points.schema if "map" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    keyed = points.select(F.when(is_placed(), place).alias("__place"), F.xxhash64(*plain).alias("__hash"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("__row"))
    parts = max(1, math.ceil(points.count() / rows_per_file))
    keyed.repartitionByRange(parts, "__place", "__hash").sortWithinPartitions("__place", "__hash").select("__row.*").write.parquet(f"{path}/points")
    rows = points.sparkSession.read.schema(points.schema).parquet(f"{path}/points")
    own = rows.select(F.col("_metadata.file_path").alias("file"), F.when(is_placed(), F.col("lng")).alias("lng"), F.when(is_placed(), F.col("lat")).alias("lat"))
    off = (F.abs("lat") > 90) | (F.abs("lng") > 180)
    boxes = own.groupBy("file").agg(
        F.count("*").alias("n"), F.min("lng").alias("min_lng"), F.max("lng").alias("max_lng"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.coalesce(F.bool_or(off), F.lit(False)).alias("off_globe"),
    )
    boxes.write.parquet(f"{path}/index")


class Found(NamedTuple):
    """Rows that a search found, and how many of the table's files were chosen for it."""

    rows: DataFrame
    files_read: int
    files: int


class StoredPoints:
    """A table that write_points made."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.index = spark.read.parquet(f"{path}/index")
        self.schema = spark.read.parquet(f"{path}/points").schema

    def points(self, files: list[str] | None = None) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(files if files is not None else [f"{self.path}/points"]))

    def nearest(self, lat: float, lng: float, k: int, key: str = "id", species: list[str] | None = None) -> Found:
        """geo.nearest's rows among points with finite coordinates, best files first: files are read in the order of their boxes' distances, twice as many a
        round, but none that is further away than the k-th point found so far.

        Equal whole metres go by key, so a file at just that distance is read too. The driver sees one round's file names and one row a round;
        a round's k best points are stored. k is at least 1.
        """
        if k < 1:
            raise ValueError("k must be at least 1")
        by_distance = stored(self.index.filter("min_lat is not null").select("file", (box_distance(lat, lng) - 1).alias("least")))  # a metre for rounding
        total, taken, step, found, edge = by_distance.count(), 0, 4, None, math.inf
        while True:
            near = by_distance.filter(F.col("least") <= edge).orderBy("least", "file")
            files = [r.file for r in near.offset(taken).limit(step).collect()]
            if not files:
                break
            own = geo.of_species(self.points(files).filter(is_placed()), species)
            best = stored(geo.nearest(own, lat, lng, k, key))
            found = best if found is None else found.unionByName(best)
            taken += len(files)
            step = min(2 * step, FILES_A_ROUND)
            last = found.select("metres").orderBy("metres").limit(k).agg(F.count("*").alias("n"), F.max("metres").alias("metres")).first()
            edge = last.metres if last.n == k else edge
        if found is None:
            found = geo.with_distance(self.points().filter(F.lit(False)), lat, lng)
        return Found(found.orderBy("metres", key).limit(k), taken, total)

    def view(self, min_lat: float, min_lng: float, max_lat: float, max_lng: float) -> Found:
        """geo.viewport's rows, from the files whose boxes meet the view. Of more than FILES_A_ROUND such files the names are not brought to the
        driver: the same comparisons on all files then leave it to their statistics."""
        inside = (F.col("min_lat") <= max_lat) & (F.col("max_lat") >= min_lat) & (F.col("min_lng") <= max_lng) & (F.col("max_lng") >= min_lng)
        total = self.index.count()
        files = [r.file for r in self.index.filter(inside).select("file").limit(FILES_A_ROUND + 1).collect()]
        few = len(files) <= FILES_A_ROUND
        rows = self.points(files if few else None) if files else self.points().filter(F.lit(False))
        return Found(geo.viewport(rows.filter(is_placed()), min_lat, min_lng, max_lat, max_lng), len(files) if few else total, total)


def box_distance(lat: float, lng: float) -> Column:
    """Metres from a place to the nearest point of a row's box (min_lng, max_lng, min_lat, max_lat); 0 where the box leaves the globe.

    The box's meridian nearest to the place holds the nearest point: at the foot of the perpendicular, moved into the box, or at an end.
    """
    away = lambda c: F.least(F.abs(F.col(c) - lng), 360 - F.abs(F.col(c) - lng))
    inside = F.lit(lng).between(F.col("min_lng"), F.col("max_lng"))
    d = F.when(inside, 0.0).otherwise(F.least(away("min_lng"), away("max_lng")))
    foot = F.degrees(F.atan2(F.lit(math.sin(math.radians(lat))), F.lit(math.cos(math.radians(lat))) * F.cos(F.radians(d))))
    reach = lambda at: geo.haversine_m(F.lit(lat), F.lit(0.0), at, d)
    nearest = F.least(reach(F.least(F.greatest(foot, "min_lat"), "max_lat")), reach(F.col("min_lat")), reach(F.col("max_lat")))
    return F.when(F.col("off_globe") | (F.lit(abs(lat) > 90 or abs(lng) > 180)), 0.0).otherwise(F.coalesce(nearest, F.lit(0.0)))


def quadtree(cells: DataFrame, most: int) -> list[DataFrame]:
    """For cells (x, y of DEPTH bits, n points) a table for each STEP levels: x, y of a cell at its deepest level, and the leaf's level and points, both
    null where the next table goes on.

    A cell splits while it holds more than `most` points and is above the last level. One histogram decides STEP levels: only cells that are still
    too large have rows in the next.
    """
    tables, open_cells = [], cells
    for top in range(0, DEPTH, STEP):
        bottom = top + STEP
        up = DEPTH - bottom
        low = stored(open_cells.groupBy(F.shiftright("x", up).alias("x"), F.shiftright("y", up).alias("y")).agg(F.sum("n").alias("n")))
        at = F.explode(F.sequence(F.lit(top), F.lit(bottom))).alias("level")
        up_to = low.select("x", "y", "n", at).select("x", "y", "n", "level", *[F.call_function("shiftright", F.col(c), F.lit(bottom) - F.col("level")).alias(f"{c}_up") for c in ("x", "y")])
        sums = up_to.groupBy("level", "x_up", "y_up").agg(F.sum("n").alias("held"))
        fits = (F.col("held") <= most) | (F.col("level") == DEPTH)
        leaf = up_to.join(sums.filter(fits), ["level", "x_up", "y_up"]).groupBy("x", "y").agg(F.min(F.struct("level", "held")).alias("leaf"))
        table = stored(low.join(leaf, ["x", "y"], "left").select("x", "y", F.col("leaf.level").alias("level"), F.col("leaf.held").alias("held")))
        tables.append(table)
        left = table.filter("level is null")
        if left.isEmpty():
            break
        wide = open_cells.withColumns({"x_up": F.shiftright("x", up), "y_up": F.shiftright("y", up)})
        open_cells = wide.join(left.select(F.col("x").alias("x_up"), F.col("y").alias("y_up")), ["x_up", "y_up"]).select("x", "y", "n")
    return tables


LEAF = ["level", "leaf_x", "leaf_y"]
EDGES = ["min_lat", "min_lng", "max_lat", "max_lng"]


class Meeting(NamedTuple):
    """Points (p_key, lat, lng) and boxes (number, b_key, edges) by leaves of a quadtree: `points` have their leaf and its size, `meets` has each leaf
    that a box meets, and whether it lies in the box as a whole."""

    points: DataFrame
    boxes: DataFrame
    meets: DataFrame | None


def meeting(points: DataFrame, boxes: DataFrame, most: int, key: str, box: str) -> Meeting:
    """Both sides by the leaves of a quadtree over the points, which splits by counts."""
    own = points.filter(is_placed()).select(F.col(key).alias("p_key"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    views = boxes.select(F.col(box).alias("b_key"), *[F.col(c).cast("double").alias(c) for c in EDGES]).withColumn("number", F.monotonically_increasing_id())
    bounds = own.agg(F.min("lng").alias("x0"), F.max("lng").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1")).first()
    if bounds.x0 is None:
        return Meeting(own, stored(views), None)
    x_of = lambda c: cell_of(F.col(c), bounds.x0, bounds.x1 - bounds.x0, DEPTH)
    y_of = lambda c: cell_of(F.col(c), bounds.y0, bounds.y1 - bounds.y0, DEPTH)
    own = own.withColumns({"x": x_of("lng"), "y": y_of("lat")})
    tables = quadtree(own.groupBy("x", "y").agg(F.count("*").alias("n")), most)

    level, held = F.lit(None).cast("int"), F.lit(None).cast("long")
    up = lambda c: F.call_function("shiftright", F.col(c), F.lit(DEPTH) - F.col("level"))
    for i, table in enumerate(tables, 1):
        shift = DEPTH - i * STEP
        t = table.filter("level is not null").select(F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"), F.col("level").alias(f"level{i}"), F.col("held").alias(f"held{i}"))
        own = own.join(t, (F.shiftright("x", shift) == F.col(f"x{i}")) & (F.shiftright("y", shift) == F.col(f"y{i}")), "left")
        level, held = F.coalesce(level, f"level{i}"), F.coalesce(held, f"held{i}")
    own = own.select("p_key", "lat", "lng", "x", "y", level.alias("level"), held.alias("held")).withColumns({"leaf_x": up("x"), "leaf_y": up("y")})

    # boxes have a number of their own, so that two with one key and the same edges stay two
    sound = " and ".join(f"{c} is not null and not isnan({c})" for c in EDGES) + " and min_lat <= max_lat and min_lng <= max_lng"
    near = (F.col("max_lng") >= bounds.x0) & (F.col("min_lng") <= bounds.x1) & (F.col("max_lat") >= bounds.y0) & (F.col("min_lat") <= bounds.y1)
    numbered = stored(views)
    reach = {"x_low": x_of("min_lng"), "x_high": x_of("max_lng"), "y_low": y_of("min_lat"), "y_high": y_of("max_lat")}
    # the outermost cells that are in the box as a whole; the cells that hold its edges are not, but where it goes past the last point
    full = {
        "x_from": F.when(F.col("min_lng") <= bounds.x0, 0).otherwise(F.col("x_low") + 1), "x_to": F.when(F.col("max_lng") >= bounds.x1, 1 << DEPTH).otherwise(F.col("x_high") - 1),
        "y_from": F.when(F.col("min_lat") <= bounds.y0, 0).otherwise(F.col("y_low") + 1), "y_to": F.when(F.col("max_lat") >= bounds.y1, 1 << DEPTH).otherwise(F.col("y_high") - 1),
    }
    going = numbered.filter(sound).filter(near).withColumns(reach).withColumns(full).select("number", *reach, *full, F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))
    first = lambda c: F.call_function("shiftleft", F.col(f"leaf_{c}"), F.lit(DEPTH) - F.col("level"))
    last = lambda c: F.call_function("shiftleft", F.col(f"leaf_{c}") + 1, F.lit(DEPTH) - F.col("level")) - 1
    whole = (first("x") >= F.col("x_from")) & (last("x") <= F.col("x_to")) & (first("y") >= F.col("y_from")) & (last("y") <= F.col("y_to"))
    meets = None
    for i, table in enumerate(tables, 1):
        shift = DEPTH - i * STEP

        def cells(low: str, high: str, inside: str, shift: int = shift) -> Column:
            start, end = F.shiftleft(F.col(inside), STEP), F.shiftleft(F.col(inside), STEP) + (1 << STEP) - 1
            return F.explode(F.sequence(F.greatest(start, F.shiftright(low, shift)), F.least(end, F.shiftright(high, shift))))

        tried = going.select("*", cells("x_low", "x_high", "cx").alias("x")).select("*", cells("y_low", "y_high", "cy").alias("y")).drop("cx", "cy")
        met = tried.join(table, ["x", "y"])
        here = met.filter("level is not null").withColumns({f"leaf_{c}": F.call_function("shiftright", F.col(c), F.lit(i * STEP) - F.col("level")) for c in ("x", "y")})
        here = here.select("number", *LEAF, "held", whole.alias("whole")).distinct()
        meets = here if meets is None else meets.unionByName(here)
        going = met.filter("level is null").withColumnsRenamed({"x": "cx", "y": "cy"}).drop("level", "held")
    return Meeting(own, numbered, stored(meets))


def pairs_in(at: Meeting, meets: DataFrame, most: int) -> DataFrame:
    """(number, b_key, p_key) of the points in boxes that share one of the leaves in meets; of a leaf, `most` points meet `most` boxes at a time."""
    parts = lambda c: F.ceil(c / most).cast("long")
    counts = meets.groupBy(*LEAF).agg(parts(F.count("*")).alias("b_parts"))
    copied = meets.withColumn("p_part", F.explode(F.sequence(F.lit(0).cast("long"), parts(F.col("held")) - 1))).join(counts, LEAF)
    copied = copied.withColumn("b_part", F.pmod(F.xxhash64("number"), F.col("b_parts"))).drop("held", "whole", "b_parts").join(at.boxes, "number")
    dealt = at.points.join(counts, LEAF).withColumn("p_part", F.pmod(F.xxhash64("p_key", "lat", "lng"), parts(F.col("held"))))
    dealt = dealt.withColumn("b_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b_parts") - 1))).select("p_key", "lat", "lng", *LEAF, "p_part", "b_part")
    pairs = dealt.join(copied, [*LEAF, "p_part", "b_part"])
    return pairs.filter(F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lng").between(F.col("min_lng"), F.col("max_lng"))).select("number", "b_key", "p_key")


def box_members(points: DataFrame, boxes: DataFrame, most: int = 5_000, key: str = "id", box: str = "box") -> DataFrame:
    """(box, key) for each point in each box, edges included. boxes: box, min_lat, min_lng, max_lat, max_lng.

    Points are in one leaf of a quadtree that splits by counts, boxes are copied to the leaves they meet, and both meet there by an equi-join. A leaf of
    more than `most` points (all in one place) or boxes is cut into parts, so no group has more than about `most` of either (copies of a point, key and all, keep
    together). Each pair comes once, as a point has one leaf. Rows of one key, and of one box, are rows of their own. Points without finite coordinates are in no
    box; boxes with an edge that is null or no number, or with edges in the wrong order, hold nothing. Where boxes are as dense as points, the
    pairs themselves grow with the square of the table: box_counts doesn't make them.
    """
    at = meeting(points, boxes, most, key, box)
    if at.meets is None:
        return at.boxes.crossJoin(at.points.limit(0)).select(F.col("b_key").alias(box), F.col("p_key").alias(key))
    return pairs_in(at, at.meets, most).select(F.col("b_key").alias(box), F.col("p_key").alias(key))


def box_counts(points: DataFrame, boxes: DataFrame, most: int = 500, key: str = "id", box: str = "box") -> DataFrame:
    """(box, n): the number of points in each box, a row a box, 0 included. Rows as in box_members.

    Leaves that lie in a box as a whole are counted by their sizes; points are looked at in leaves on the edges only, and counted before they are shuffled.
    """
    at = meeting(points, boxes, most, key, box)
    if at.meets is None:
        return at.boxes.select(F.col("b_key").alias(box), F.lit(0).cast("long").alias("n"))
    inner = at.meets.filter("whole").groupBy("number").agg(F.sum("held").alias("n"))
    edge = pairs_in(at, at.meets.filter("not whole"), most).groupBy("number").agg(F.count("*").alias("n"))
    sums = inner.unionByName(edge).groupBy("number").agg(F.sum("n").alias("n"))
    return at.boxes.join(sums, "number", "left").select(F.col("b_key").alias(box), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
