import math
import random

import pytest

from grove.operators import geo


def frame(spark, points):
    return spark.createDataFrame(points, "id long, species string, lng double, lat double")


def metres(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return math.floor(6_371_000 * 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x)) + 0.5)


def points(seed, n=300, spread=0.02):
    rng = random.Random(seed)
    return [(i, rng.choice(["oak", "elm", None]), 8.5 + rng.uniform(-spread, spread), 52 + rng.uniform(-spread, spread)) for i in range(n)]


def test_expanding_search_against_the_loop(spark):
    for seed, wanted in ((1, None), (2, ["elm"]), (3, ["beech"]), (4, ["", "oak"]), (5, [])):
        rows = points(seed, 40 * seed)
        best = []
        for r in geo.RADII:
            best = [p for p in rows if abs(p[2] - 8.5) <= r + 1e-12 and abs(p[3] - 52) <= r + 1e-12 and (not wanted or (p[1] or "") in wanted)]
            if best:
                break
        best = sorted((metres(52, 8.5, p[3], p[2]), p[0]) for p in best)[:5]
        got = [(r.metres, r.id) for r in geo.expanding_search(frame(spark, rows), 52.0, 8.5, wanted).collect()]
        assert got == best


def test_shared_edges_belong_to_all_their_cells(spark):
    rows = [(i * 11 + j, "oak", float(i), float(j)) for i in range(11) for j in range(11)]  # every point stands on cell corners
    got = {}
    for r in geo.grid_members(frame(spark, rows)).collect():
        got.setdefault(r.id, set()).add((r.cell_x, r.cell_y))
    for i in range(11):
        for j in range(11):
            assert got[i * 11 + j] == {(x, y) for x in (i - 1, i) for y in (j - 1, j) if 0 <= x < 10 and 0 <= y < 10}


def test_grid_against_all_cells(spark):
    for seed in (1, 2):
        rows = points(seed)
        f = frame(spark, rows)
        cells = geo.grid(f).collect()
        want = {(p[0], c.cell_x, c.cell_y) for p in rows for c in cells if c.min_x <= p[2] <= c.max_x and c.min_y <= p[3] <= c.max_y}
        assert {(r.id, r.cell_x, r.cell_y) for r in geo.grid_members(f).collect()} == want
        index = geo.grid_index(f).collect()
        assert len(index) == 100 and sum(r.n_points for r in index) == len(want)
        assert all((r.file_name is None) == (r.n_points == 0) for r in index)


def test_points_in_one_place_and_none(spark):
    one = frame(spark, [(1, "oak", 8.0, 50.0), (2, "oak", 8.0, 50.0)])
    assert {(r.id, r.cell_x, r.cell_y) for r in geo.grid_members(one).collect()} == {(i, x, y) for i in (1, 2) for x in range(10) for y in range(10)}
    none = one.filter("false")
    assert geo.grid_index(none).count() == 0 and geo.expanding_search(none, 52.0, 8.5).count() == 0


def test_box_meets_on_its_edges(spark):
    index = spark.createDataFrame([("a", 0.0, 1.0, 0.0, 1.0), ("b", 1.0, 2.0, 0.0, 1.0), (None, 0.0, 9.0, 0.0, 9.0), ("c", 3.0, 4.0, 3.0, 4.0)], "file_name string, min_x double, max_x double, min_y double, max_y double")
    assert {r.file_name for r in geo.matching_cells(index, 0.5, 1.0, 1.0, 2.0).collect()} == {"a", "b"}
    loaded = spark.createDataFrame([("a",)], "file_name string")
    assert {r.file_name for r in geo.unloaded_cells(geo.matching_cells(index, 0.0, 9.0, 0.0, 9.0), loaded).collect()} == {"b", "c"}


def test_all_points_are_ranked(spark):
    from grove.plans import catalogue

    sf = "/root/testdata/sf0.1"
    got = [(r.metres, r.id) for r in catalogue.queries()["geo_all_ranked"](spark, sf).collect()]
    every = [(r.metres, r.id) for r in catalogue.queries()["geo_distance_m"](spark, sf).collect()]
    assert got == sorted(every) and len(got) > 1000


def test_quantiles_are_exact(spark):
    import random
    import statistics

    rng = random.Random(4)
    for values in ([5.0], [1.0, 2.0], [rng.choice([0.0, 0.0, 0.0, 1.5, rng.random()]) for _ in range(999)], [float(rng.randrange(50)) for _ in range(400)]):
        row = geo.describe(spark.createDataFrame([(v, v * 2) for v in values], "a double, b double"), ["a", "b"]).filter("column = 'a'").first()
        cut = statistics.quantiles(values, n=4, method="inclusive") if len(values) > 1 else values * 3
        assert [row.p25, row.p50, row.p75] == [pytest.approx(round(c, 6)) for c in cut] and row.n == len(values)
    assert geo.describe(spark.createDataFrame([], "a double"), ["a"]).count() == 0


def test_searches_from_many_places_are_those_from_each(spark):
    """Against a plain scan for each place, with points on the edges of boxes, equal distances, a hot cell, and rows without coordinates."""
    rng = random.Random(4)
    at = [(f"p{i}", 52 + rng.choice([0, 0.003, 0.0115]) + i * 0.02, 8.5 - i * 0.03) for i in range(12)]
    rows = [(i, rng.choice("ab"), p[1] + rng.choice(d), p[2] + rng.choice(d)) for i in range(150) for p in [rng.choice(at[:9])] for d in [rng.choice([[0, 0.0015, -0.0015], [0.005, -0.004], [0.01, -0.009, 0.0101]])]]
    rows += [(1000 + i, "a", at[3][1], at[3][2]) for i in range(60)] + [(2000, "a", None, 8.5), (2001, "b", 52.0, None)]
    points = spark.createDataFrame(rows, "id long, species string, lat double, lng double")
    places = spark.createDataFrame([*at, ("nowhere", 10.0, -170.0), ("none", None, 8.5)], "place string, lat double, lng double")

    def plain(lat, lng, species):
        for r in geo.RADII:
            held = [p for p in rows if None not in p and p[1] in species and lat - r <= p[2] <= lat + r and lng - r <= p[3] <= lng + r]
            if held:
                def metres(p):
                    a = math.sin(math.radians(p[2] - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(p[2])) * math.sin(math.radians(p[3] - lng) / 2) ** 2
                    return math.floor(6_371_000 * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a)) + 0.5)

                return sorted((metres(p), p[0]) for p in held)[:5]
        return []

    for species in (None, ["b"]):
        got = sorted(tuple(r) for r in geo.expanding_search_all(points, places, species).collect())
        want = sorted((name, i, m, n) for name, lat, lng in at for n, (m, i) in enumerate(plain(lat, lng, species or ["a", "b"]), 1))
        assert got == want and len(want) > 20
    assert geo.expanding_search_all(points.limit(0), places).count() == 0
