"""Points, boxes, grids and nearest places. Points have lng and lat columns in degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import stored

EARTH_M = 6_371_000
RADII = (0.0015, 0.005, 0.01)


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    d_lat, d_lng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lng / 2), 2)
    return EARTH_M * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def with_distance(points: DataFrame, lat: float, lng: float) -> DataFrame:
    """Adds metres: the great-circle distance to a place in whole metres, halves up."""
    d = haversine_m(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    return points.withColumn("metres", F.floor(d + 0.5).cast("long"))


def nearest(points: DataFrame, lat: float, lng: float, k: int | None, key: str = "id") -> DataFrame:
    """The k nearest points by whole metres, then key: a top-k without a sort of everything. Without k, all points in that order."""
    ranked = with_distance(points, lat, lng).orderBy("metres", key)
    return ranked if k is None else ranked.limit(k)


def bounding_box(lat: float, lng: float, radius: float) -> dict[str, float]:
    """Box around a place; the radius is in degrees."""
    return {"min_lat": lat - radius, "max_lat": lat + radius, "min_lng": lng - radius, "max_lng": lng + radius}


def in_box(box: dict[str, float]) -> Column:
    """Inclusive on all four edges; plain comparisons, so a scan of stored coordinates can skip by them."""
    return F.col("lat").between(box["min_lat"], box["max_lat"]) & F.col("lng").between(box["min_lng"], box["max_lng"])


def viewport(points: DataFrame, min_lat: float, min_lng: float, max_lat: float, max_lng: float) -> DataFrame:
    return points.filter(in_box({"min_lat": min_lat, "max_lat": max_lat, "min_lng": min_lng, "max_lng": max_lng}))


def of_species(points: DataFrame, species: list[str] | None) -> DataFrame:
    """An empty list is no filter; a missing species counts as the empty text."""
    return points.filter(F.coalesce("species", F.lit("")).isin(*species)) if species else points


def register_functions(spark: SparkSession, points: DataFrame, columns: dict[str, str]) -> None:
    """SQL table functions of the session over points: nearby_trees(lat, long) with dist_meters, and trees_in_view(min_lat, min_long, max_lat, max_long).

    columns: of points, by the names that results have (`lat` and `long` among them). The optimizer puts the functions' bodies in place of the calls, so
    filters, limits and projections around them reach the scan; arguments may be columns of a lateral join. Rows come in no order: ORDER BY dist_meters
    (metres of the great circle, not rounded) where it matters. Trees without a place are in no view; their distance is null.
    """
    points.select(*[F.col(c).alias(n) for n, c in columns.items()]).createOrReplaceTempView("grove_trees")
    fields = [(n, f.dataType.simpleString()) for n, f in zip(columns, (points.schema[c] for c in columns.values()), strict=True)]
    shape, listed = ", ".join(f"`{n}` {t}" for n, t in fields), ", ".join(f"t.`{n}`" for n in columns)
    a = "pow(sin(radians(t.lat - nearby_trees.lat) / 2), 2) + cos(radians(nearby_trees.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.long - nearby_trees.long) / 2), 2)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION nearby_trees(lat DOUBLE, long DOUBLE) RETURNS TABLE({shape}, dist_meters DOUBLE) RETURN SELECT {listed}, {EARTH_M} * 2 * atan2(sqrt({a}), sqrt(1 - ({a}))) FROM grove_trees t")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION trees_in_view(min_lat DOUBLE, min_long DOUBLE, max_lat DOUBLE, max_long DOUBLE) RETURNS TABLE({shape}) RETURN SELECT {listed} FROM grove_trees t WHERE t.lat BETWEEN min_lat AND max_lat AND t.long BETWEEN min_long AND max_long")


def expanding_search(points: DataFrame, lat: float, lng: float, species: list[str] | None = None, radii: tuple[float, ...] = RADII, k: int = 5) -> DataFrame:
    """The k nearest points of the first radius whose box holds any match, in one pass.

    Each point gets the number of the smallest box it is in; the least number among matches is the winning box, and the points
    with that number are what it holds, since smaller boxes hold none. The number comes from one global minimum, no loop.
    """
    ring = F.lit(None).cast("int")
    for i in reversed(range(len(radii))):
        ring = F.when(in_box(bounding_box(lat, lng, radii[i])), i).otherwise(ring)
    near = of_species(points, species).filter(in_box(bounding_box(lat, lng, max(radii)))).withColumn("ring", ring)
    first = near.agg(F.min("ring").alias("first"))  # one row
    won = near.join(F.broadcast(first), F.col("ring") == F.col("first")).drop("first")
    return nearest(won, lat, lng, k)


def expanding_search_all(points: DataFrame, places: DataFrame, species: list[str] | None = None, radii: tuple[float, ...] = RADII, k: int = 5, key: str = "id", place: str = "place") -> DataFrame:
    """expanding_search for a table of places (place, unique; lat, lng): place, key, metres and rank (from 1) of the k nearest points of each place's first box that holds any.

    For each radius, points and places meet by an equi-join on cells a little wider than the radius, nine cells a place, and only places without a match so far go on to the
    next one. The k best are chosen before rows are shuffled by place. Rows of one key are points of their own; points and places without coordinates, and places
    with no point in the widest box, are in no row.
    """
    own = of_species(points, species).select(F.col(key).alias("p_key"), F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    left = places.select(F.col(place).alias("at"), "lat", "lng")
    found = None
    for r in radii:
        cell = lambda c, side=r * 1.001: F.floor(F.col(c) / side)  # noqa: E731 - wider, so that rounding leaves a box within the cells next to the place's
        around = left.select("*", F.explode(F.sequence(cell("lng") - 1, cell("lng") + 1)).alias("x")).select("*", F.explode(F.sequence(cell("lat") - 1, cell("lat") + 1)).alias("y"))
        met = around.join(own.select("*", cell("p_lng").alias("x"), cell("p_lat").alias("y")), ["x", "y"])
        met = met.filter(F.col("p_lat").between(F.col("lat") - r, F.col("lat") + r) & F.col("p_lng").between(F.col("lng") - r, F.col("lng") + r))
        metres = F.floor(haversine_m(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")) + 0.5).cast("long")
        ranked = met.select("at", "p_key", metres.alias("metres")).withColumn("rank", F.row_number().over(W.partitionBy("at").orderBy("metres", "p_key"))).filter(F.col("rank") <= k)
        won = stored(ranked)
        found = won if found is None else found.unionByName(won)
        left = left.join(won.filter("rank = 1").select("at"), "at", "left_anti")
    return found.select(F.col("at").alias(place), F.col("p_key").alias(key), "metres", "rank")


def grid(points: DataFrame, n: int = 10) -> DataFrame:
    """n * n cells over the points' bounds (n * n rows): cell_x, cell_y from 0, and edges min + k * width."""
    b = points.agg(F.min("lng").alias("x0"), F.max("lng").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    cells = b.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("cell_x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("cell_y"))
    w, h = (F.col("x1") - F.col("x0")) / n, (F.col("y1") - F.col("y0")) / n
    edge = lambda low, k, step: F.col(low) + k * step
    return cells.filter("x0 is not null").select(
        "cell_x", "cell_y",
        edge("x0", F.col("cell_x"), w).alias("min_x"), edge("x0", F.col("cell_x") + 1, w).alias("max_x"),
        edge("y0", F.col("cell_y"), h).alias("min_y"), edge("y0", F.col("cell_y") + 1, h).alias("max_y"),
    )


def grid_members(points: DataFrame, n: int = 10) -> DataFrame:
    """Each point with each cell that holds it, edges included: a point on a shared edge is in both cells.

    Points find the (at most 9) cells around their rough place by arithmetic, then meet those cells by an equi-join and the
    edges' own formula decides. The cells are n * n rows, so they are broadcast; no pair of all points and all cells is made.
    """
    cells = grid(points, n)
    b = points.agg(F.min("lng").alias("x0"), F.max("lng").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))

    def around(v: str, low: str, high: str) -> Column:
        width = F.col(high) - F.col(low)
        k = F.when(width > 0, F.floor((F.col(v) - F.col(low)) / width * n)).otherwise(0).cast("int")
        reach = F.sequence(F.greatest(k - 1, F.lit(0)), F.least(k + 1, F.lit(n - 1)))
        return F.when(width > 0, reach).otherwise(F.sequence(F.lit(0), F.lit(n - 1)))

    near = points.filter("lng is not null and lat is not null").join(F.broadcast(b))  # one row
    near = near.withColumn("cell_x", F.explode(around("lng", "x0", "x1"))).withColumn("cell_y", F.explode(around("lat", "y0", "y1"))).drop("x0", "x1", "y0", "y1")
    held = near.join(F.broadcast(cells), ["cell_x", "cell_y"])
    return held.filter("lng between min_x and max_x and lat between min_y and max_y")


def cell_file(x: Column, y: Column) -> Column:
    return F.format_string("segment_%02d_%02d.geojson", x + 1, y + 1)


def grid_index(points: DataFrame, n: int = 10) -> DataFrame:
    """All cells with their number of points and file name; an empty cell has no file but stays in the index."""
    counts = grid_members(points, n).groupBy("cell_x", "cell_y").agg(F.count("*").alias("n_points"))
    cells = grid(points, n).join(counts, ["cell_x", "cell_y"], "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))
    return cells.withColumn("file_name", F.when(F.col("n_points") > 0, cell_file(F.col("cell_x"), F.col("cell_y"))))


def matching_cells(index: DataFrame, min_x: float, max_x: float, min_y: float, max_y: float) -> DataFrame:
    """Cells with a file whose box meets the view, edges included."""
    return index.filter("file_name is not null").filter((F.col("min_x") <= max_x) & (F.col("max_x") >= min_x) & (F.col("min_y") <= max_y) & (F.col("max_y") >= min_y))


def unloaded_cells(cells: DataFrame, loaded: DataFrame) -> DataFrame:
    return cells.join(loaded, "file_name", "left_anti")


def quantiles(stacked: DataFrame, at: dict[str, float]) -> DataFrame:
    """column and the exact quantiles, between two neighbouring values in proportion, of rows (column, v).

    Values are counted, and the distinct ones dealt by ranges: the ranges' sums tell in which of them a rank lies, and only there
    values are summed up one by one. No task holds more than a range.
    """
    spark = stacked.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = stacked.groupBy("column", "v").agg(F.count("*").alias("n"))
    dealt = stored(counted.repartitionByRange(parts, "column", "v").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("column", "part").agg(F.sum("n").alias("s"))  # a row for each column and range
    own = W.partitionBy("column")
    sums = sums.select("column", "part", "s", F.sum("s").over(own).alias("all"), F.coalesce(F.sum("s").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = lambda q: F.lit(q) * (F.col("all") - 1)
    ranks = [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), side_of(place(q)).cast("long").alias("rank"), (place(q) - F.floor(place(q))).alias("share")) for name, q in at.items() for side, side_of in (("low", F.floor), ("high", F.ceil))]
    wanted = sums.select("column", "part", "s", "before", F.explode(F.array(*ranks)).alias("r")).filter((F.col("r.rank") >= F.col("before")) & (F.col("r.rank") < F.col("before") + F.col("s")))
    wanted = wanted.select("column", "part", "r.name", "r.side", "r.share", (F.col("r.rank") - F.col("before")).alias("rank"))  # two rows a quantile
    up_to = F.sum("n").over(W.partitionBy("column", "part").orderBy("v"))
    local = dealt.join(F.broadcast(wanted.select("column", "part").distinct()), ["column", "part"]).withColumn("to", up_to)
    found = local.join(F.broadcast(wanted), ["column", "part"]).filter((F.col("rank") < F.col("to")) & (F.col("rank") >= F.col("to") - F.col("n")))
    value = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("v")))
    share = lambda name: F.max(F.when(F.col("name") == name, F.col("share")))
    return found.groupBy("column").agg(*[((1 - share(x)) * value(x, "low") + share(x) * value(x, "high")).alias(x) for x in at])


def describe(points: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column, rounded to 6 places, one row a column."""
    stacked = points.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "column", "v").filter("v is not null")
    r = lambda c: F.round(c, 6)
    sums = stacked.groupBy("column").agg(F.count("v").alias("n"), r(F.avg("v")).alias("mean"), r(F.stddev_samp("v")).alias("std"), r(F.min("v")).alias("least"), r(F.max("v")).alias("most"))
    quartiles = quantiles(stacked, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return sums.join(quartiles, "column").select("column", "n", "mean", "std", "least", *[r(F.col(p)).alias(p) for p in ("p25", "p50", "p75")], "most")


def species_share(rows: DataFrame, species: str = "species") -> DataFrame:
    counts = rows.groupBy(species).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy())  # over one row a species
    return counts.select(species, "n", F.round(F.col("n") / total, 6).alias("share"))


def top_species(rows: DataFrame, k: int = 30, species: str = "species") -> DataFrame:
    return rows.groupBy(species).agg(F.count("*").alias("n")).orderBy(F.desc("n"), species).limit(k)


def group_examples(rows: DataFrame, group: str, order: str, k: int = 3) -> DataFrame:
    """The first k rows of each group and the group's size."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("group_size"))
    ranked = rows.withColumn("nth", F.row_number().over(W.partitionBy(group).orderBy(order))).filter(F.col("nth") <= k)
    return ranked.join(sizes, group)


#: the ellipsoid and scale of universal transverse Mercator coordinates (fixed values)
AXIS, FLATTENING, SCALE, EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def utm_series() -> tuple[float, list[float], list[float]]:
    """Metres of the meridian's arc a radian, and the coefficients of Krüger's series from the plane to the sphere and on to the ellipsoid."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return radius, [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480], [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]


def from_utm(x: Column, y: Column, zone: Column | int) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees of a place on the northern half of a UTM zone, to fractions of a millimetre; JVM only."""
    radius, plane, sphere = utm_series()
    xi, eta = y / (SCALE * radius), (x - EASTING) / (SCALE * radius)
    up, side = xi, eta
    for j, b in enumerate(plane, 1):
        up = up - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        side = side - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(up) / F.cosh(side))
    lat = chi
    for j, d in enumerate(sphere, 1):
        lat = lat + d * F.sin(2 * j * chi)
    middle = (F.lit(zone) if isinstance(zone, int) else zone) * 6 - 183
    return middle + F.degrees(F.atan2(F.sinh(side), F.cos(up))), F.degrees(lat)
