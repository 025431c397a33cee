import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grove.operators import geo, spatial
from grove.sources.scratch import shared_path


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, species string, lng double, lat double")


def scattered(seed, n=2000, hot=400):
    """A city, a place where many trees stand, trees far away, some without a place."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["oak", "elm", None]), 8.5 + rng.gauss(0, 0.05), 52 + rng.gauss(0, 0.03)) for i in range(n)]
    rows += [(n + i, "oak", 8.51, 52.01) for i in range(hot)]
    rows += [(n + hot + i, "elm", rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(n // 10)]
    base = n + hot + n // 10
    return rows + [(base, "oak", None, 52.0), (base + 1, "oak", 8.5, None), (base + 2, "elm", math.nan, 52.0), (base + 3, "elm", math.inf, 52.0)]


def placed(rows):
    return [r for r in rows if r[2] is not None and r[3] is not None and math.isfinite(r[2]) and math.isfinite(r[3])]


@pytest.fixture(scope="module")
def table(spark):
    path = shared_path(spark)
    rows = scattered(7)
    spatial.write_points(frame(spark, rows), path, rows_per_file=100)
    return spatial.StoredPoints(spark, path), rows


def test_the_curve_visits_every_cell_once_and_never_jumps(spark):
    cells = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    got = sorted((r.d, r.x, r.y) for r in cells.select("x", "y", spatial.hilbert(F.col("x"), F.col("y"), 4).alias("d")).collect())
    assert [g[0] for g in got] == list(range(256))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(got, got[1:], strict=False))


def test_all_rows_are_stored_and_files_are_small(spark, table):
    stored, rows = table
    assert stored.points().count() == len(rows)
    sizes = [r.n for r in stored.index.collect()]
    assert sum(sizes) == len(rows) and len(sizes) >= 20 and max(sizes) < 300


@pytest.mark.parametrize("place", [(52.0, 8.5), (52.01, 8.51), (-33.0, 151.0), (89.9, -10.0), (10.0, 179.9), (10.0, -179.9)])
@pytest.mark.parametrize("k,species", [(5, None), (40, ["elm"]), (1, ["beech"])])
def test_nearest_equals_the_full_scan(spark, table, place, k, species):
    stored, rows = table
    want = [(r.metres, r.id) for r in geo.nearest(geo.of_species(frame(spark, placed(rows)), species), *place, k).collect()]
    found = stored.nearest(*place, k, species=species)
    assert [(r.metres, r.id) for r in found.rows.collect()] == want
    if species is None and place[0] == 52.0:
        assert found.files_read <= found.files // 3
    if species == ["beech"]:
        assert found.files_read == found.files  # nothing is told apart without reading all


def test_distance_to_a_box_is_never_too_long(spark):
    rng = random.Random(3)
    boxes = []
    for i in range(300):
        w, h = rng.choice([0.01, 1, 30, 200]), rng.choice([0.01, 1, 30, 120])
        x, y = rng.uniform(-180, 180 - min(w, 350)), rng.uniform(-90, 90 - h) if h < 180 else -90
        boxes.append((i, x, min(x + w, 180.0), y, min(y + h, 90.0), False))
    f = spark.createDataFrame(boxes, "i int, min_lng double, max_lng double, min_lat double, max_lat double, off_globe boolean")
    for lat, lng in ((52.0, 8.5), (0.0, 0.0), (-89.0, 179.0), (80.0, -170.0)):
        inside = f.select("*", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("a")).select("*", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("b"))
        at_lat, at_lng = (F.col(f"min_{c}") + (F.col(f"max_{c}") - F.col(f"min_{c}")) * F.col(n) / 12 for c, n in (("lat", "a"), ("lng", "b")))
        real = inside.groupBy("i").agg(F.min(geo.haversine_m(F.lit(lat), F.lit(lng), at_lat, at_lng)).alias("real"))
        got = f.select("i", spatial.box_distance(lat, lng).alias("bound")).join(real, "i")
        assert got.filter("bound > real + 0.5").isEmpty()
        assert got.filter("bound > 0").count() > 50


def test_view_equals_the_full_scan(spark, table):
    stored, rows = table
    for view in ((51.99, 8.49, 52.01, 8.51), (52.01, 8.51, 52.01, 8.51), (-90.0, -180.0, 90.0, 180.0), (60.0, 60.0, 59.0, 61.0)):
        found = stored.view(*view)
        assert sorted(r.id for r in found.rows.collect()) == sorted(r[0] for r in placed(rows) if view[0] <= r[3] <= view[2] and view[1] <= r[2] <= view[3])
    assert stored.view(51.99, 8.49, 52.01, 8.51).files_read < stored.index.count() // 2


def test_empty_tables_clashing_names_and_points_off_the_globe(spark):
    path = shared_path(spark)
    spatial.write_points(frame(spark, []), path)
    empty = spatial.StoredPoints(spark, path)
    assert empty.nearest(52.0, 8.5, 3).rows.isEmpty() and empty.view(0.0, 0.0, 1.0, 1.0).rows.isEmpty()
    odd = spark.createDataFrame([(1, "a", 400.0, 95.0, 1, {"x": 1}), (2, "b", 8.5, 52.0, 2, None)], "id long, species string, lng double, lat double, `__place` int, `m.p` map<string,int>")
    path = shared_path(spark)
    spatial.write_points(odd, path, rows_per_file=1)
    stored = spatial.StoredPoints(spark, path)
    assert [r.id for r in stored.nearest(52.0, 8.5, 2).rows.collect()] == [2, 1]
    assert [r.id for r in stored.view(90.0, 300.0, 99.0, 500.0).rows.collect()] == [1]


def brute(rows, boxes):
    ok = [b for b in boxes if all(v is not None and not math.isnan(v) for v in b[1:])]
    return sorted((b[0], p[0]) for b in ok for p in placed(rows) if b[1] <= p[3] <= b[3] and b[2] <= p[2] <= b[4])


BOXES = "box int, min_lat double, min_lng double, max_lat double, max_lng double"


@pytest.mark.parametrize("most", [3, 60, 100_000])
def test_boxes_and_points_against_all_pairs(spark, most):
    rng = random.Random(most)
    rows = scattered(11, 500, 200) + [(1, "oak", 8.5, 52.0)] * 2
    boxes = [(i, y := 52 + rng.gauss(0, 0.03), x := 8.5 + rng.gauss(0, 0.05), y + rng.choice([0.0, 0.001, 0.02]), x + 0.01) for i in range(60)]
    boxes += [(100, 52.01, 8.51, 52.01, 8.51)] * 10  # a box that comes often, on the place where many trees stand
    boxes += [(101, -90.0, -180.0, 90.0, 180.0), (102, 53.0, 8.0, 51.0, 9.0), (103, None, 8.0, 53.0, 9.0), (104, math.nan, 8.0, 53.0, 9.0), (105, 51.0, 8.0, math.nan, 9.0), (106, -math.inf, -math.inf, math.inf, math.inf)]
    got = spatial.box_members(frame(spark, rows), spark.createDataFrame(boxes, BOXES), most).collect()
    assert sorted((r.box, r.id) for r in got) == brute(rows, boxes)
    held = Counter(b for b, _ in brute(rows, boxes))
    times = Counter(b[0] for b in boxes)
    counted = spatial.box_counts(frame(spark, rows), spark.createDataFrame(boxes, BOXES), most).collect()
    assert sorted((r.box, r.n) for r in counted) == sorted((b[0], held[b[0]] // times[b[0]]) for b in boxes)


def test_no_points_no_boxes_one_place(spark):
    none, one = frame(spark, [(1, "oak", None, None)]), frame(spark, [(i, "oak", 8.0, 50.0) for i in range(9)])
    boxes = spark.createDataFrame([(1, 50.0, 8.0, 50.0, 8.0), (2, 50.1, 8.0, 51.0, 8.0)], BOXES)
    assert spatial.box_members(none, boxes).isEmpty()
    assert sorted(map(tuple, spatial.box_counts(none, boxes).collect())) == [(1, 0), (2, 0)]
    assert sorted(map(tuple, spatial.box_counts(one, boxes, most=2).collect())) == [(1, 9), (2, 0)]
    assert spatial.box_members(one, boxes.limit(0)).isEmpty()
    assert sorted((r.box, r.id) for r in spatial.box_members(one, boxes, most=2).collect()) == [(1, i) for i in range(9)]


def test_leaves_split_by_counts(spark):
    rows = frame(spark, placed(scattered(5)))
    cells = rows.select(spatial.cell_of(F.col("lng"), -180.0, 360.0, spatial.DEPTH).alias("x"), spatial.cell_of(F.col("lat"), -90.0, 180.0, spatial.DEPTH).alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
    tables = spatial.quadtree(cells, 50)
    leaves = [t.filter("level is not null") for t in tables]
    assert all(t.filter("held > 50 and level < 24").isEmpty() for t in leaves)
    assert sum(t.filter("held > 50").count() for t in leaves) == 1  # the place of many trees
