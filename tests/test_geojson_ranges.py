"""GeoJSON collections read by ranges of a few bytes, against whole texts parsed at once."""

import json
import random

import pytest

from grove.sources import geojson, ranges
from grove.sources.delimited import SourceError


@pytest.fixture
def small_ranges(spark):
    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def feature(rng, i):
    odd = ["plain", "a }{ b", 'say "[{', "back\\", "\\\"}", "é— ü", "line\nbreak", "},{", "]}", '"features":['] + ["x}" * 300]
    f = {"type": "Feature", "properties": {"pitID": rng.choice(odd) + str(i), "Standort_N": i, "Zusatz": rng.choice([None, *odd]), "gefaellt": i % 2 == 0}, "geometry": {"type": "Point", "coordinates": [8 + i / 7, 52.5]}}
    if rng.random() < 0.2:
        f["properties"]["nested"] = {"features": [1, [2, {"features": [{}, {}]}]], rng.choice(odd): [[], {}]}
    return None if rng.random() < 0.05 else f


def collection(rng, n):
    top = [("type", "FeatureCollection"), ("crs", {"properties": {"name": rng.choice(["EPSG:4326", "EPSG:25832"])}}), ("features", [feature(rng, i) for i in range(n)])]
    if rng.random() < 0.7:
        top += [("note", 'a "features": [{} ] }'), ("other", [1, {"features": [{"a": [1]}, 2]}, {}])]
    rng.shuffle(top)
    return json.dumps(dict(top), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1]))


def seen(spark, path):
    """The rows, or the code of the refusal."""
    try:
        return sorted(map(repr, geojson.scan_geojson(spark, str(path)).collect()))
    except SourceError as error:
        return str(error).split(":")[0]


@pytest.mark.parametrize(("seed", "size"), [(0, 700), (1, 3000)])
def test_ranges_give_the_features_of_a_whole_text(spark, tmp_path, small_ranges, seed, size):
    rng = random.Random(seed)
    for x, n in enumerate((0, 1, 7, 30)):
        tail = rng.choice(["", "\n", " \n\n"])
        (tmp_path / f"f{x}.geojson").write_bytes((("﻿" if x == 2 else "") + collection(rng, n) + tail).encode())
    small_ranges(1 << 22)
    assert ranges.whole_files(spark, str(tmp_path))
    want = seen(spark, tmp_path)
    assert len(want) == 38
    small_ranges(size)
    assert not ranges.whole_files(spark, str(tmp_path))
    assert seen(spark, tmp_path) == want


def test_a_compressed_file_is_one_range(spark, tmp_path, small_ranges):
    import gzip

    text = collection(random.Random(5), 40)
    (tmp_path / "f.geojson.gz").write_bytes(gzip.compress(text.encode()))
    small_ranges(1 << 22)
    want = seen(spark, tmp_path)
    small_ranges(100)
    assert seen(spark, tmp_path) == want and len(want) == 40


def in_ranges(text, size):
    """The features that ranges of some bytes cut out of a text, or the code of the refusal."""
    pieces, at, dealt = text.split(b"}"), 0, {}
    if not pieces[-1]:
        pieces.pop()
    for p in pieces:
        dealt.setdefault(at // size * size, []).append(p)
        at += len(p) + 1
    told = []
    for start, own in dealt.items():
        both = [geojson._Effect(False), geojson._Effect(True)]
        blobs = list(geojson._blobs(iter(own), False))
        for e in both:
            for b in blobs:
                e.add(b)
        told.append({"path": "f", "start": start, "n": sum(map(len, blobs)), "out": both[0].told(), "within": both[1].told()})
    try:
        places = geojson._places(told, {"f": len(text)})
    except SourceError as error:
        return str(error).split(":")[0]
    features, around = {}, b""
    for start, own in dealt.items():
        place = places["f", start]
        for pos, _, _, part in geojson._cut(geojson._blobs(iter(own), place.ended), place):
            if pos is None:
                around += part
            else:
                features[pos] = features.get(pos, b"") + part
    assert sorted(features) == list(range(len(features)))
    return json.loads(around), [json.loads(f) for f in features.values() if f.strip()]


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_those_of_a_parser(seed):
    rng = random.Random(seed)
    text = collection(rng, rng.choice([0, 1, 2, 12])) + rng.choice(["", "\n"])
    want = json.loads(text)
    features = want.pop("features")
    for size in (1, 5, 40, 333, 1 << 20):
        around, found = in_ranges(text.encode(), size)
        assert around.pop("features") == [] and around == want and found == features
    for cut in (text.rstrip()[:-1], text[: len(text) // 2], text.replace("}", "]", 1) if '"}' not in text else text + "]"):
        try:
            json.loads(cut)
        except ValueError:
            assert {in_ranges(cut.encode(), size) for size in (1, 40, 1 << 20)} == {"invalid_json"}


GOOD = '{"type": "FeatureCollection", "features": [{"properties": {"pitID": "a}"}}, {"properties": {"pitID": "b"}}], "end": {"x": 1}}'


@pytest.mark.parametrize(
    "text",
    [
        GOOD, GOOD[:-1], GOOD[:-1] + "\n", GOOD.replace("}}, {", "}} {"), GOOD.replace("}}, {", "}},, {"), GOOD.replace("}}]", "}},]"), GOOD.replace("features", "f\\u0065atures"), GOOD.replace('"end": {"x": 1}', '"features": [{}, {}]'),
        GOOD.replace('{"properties": {"pitID": "b"}}', "3"), GOOD.replace('"b"', '"b", "pitID": 1'), "[{" * 700, '{"features": [ ], "a": {}, "b": "a long text"}', '{"features": {"a": []}, "b": "a long text"}', '{"crs": {"properties": {"name": "EPSG:31467"}}, "features": [{}]}',
    ],
    ids=str,
)
def test_what_is_refused_does_not_depend_on_ranges(spark, tmp_path, small_ranges, text):
    path = tmp_path / "f.geojson"
    path.write_text(text)
    small_ranges(1 << 22)
    want = seen(spark, path)
    small_ranges(min(400, len(text) // 3))
    assert seen(spark, path) == want


def test_an_empty_file_among_others_and_a_file_of_bytes(spark, tmp_path, small_ranges):
    (tmp_path / "a.geojson").write_text(GOOD)
    (tmp_path / "b.geojson").write_text("")
    small_ranges(60)
    assert len(seen(spark, tmp_path)) == 2
    assert seen(spark, tmp_path / "b.geojson") == "invalid_json"
    (tmp_path / "b.geojson").write_bytes(GOOD.encode().replace(b'"b"', b'"\xff\xfe}"'))
    assert len(seen(spark, tmp_path)) == 4


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    path = tmp_path / "m.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"pitID": f"p{i}", "Zusatz": "}" * (i % 3)}, "geometry": {"coordinates": [8.0, 52.0]}} for i in range(20_000)]}))
    small_ranges(50_000)
    assert ranges.scan_pieces(spark, str(path), "}").select("start").distinct().count() > 20
    rows = geojson.scan_geojson(spark, str(path)).orderBy("pos").select("pos", "pit_id", "addition").collect()
    assert [tuple(r) for r in rows] == [(i, f"p{i}", "}" * (i % 3)) for i in range(20_000)]
