import json
import os

import pytest

from grove.operators import activity as act
from grove.sources import delimited, geojson, markup
from grove.sources import tables as tab
from grove.sources.delimited import SourceError
from grove.streaming import activity as live


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_mapping_contract(spark, tmp_path):
    good = write(tmp_path / "a.csv", '﻿baumart_bo,baumart_de,wikidata_id\n "Acer ""a""" , Ahorn ,Q1\n\nRosa,"two\nlines",,extra\n')
    rows = delimited.scan_mapping(spark, good).orderBy("line").collect()
    assert [tuple(r) for r in rows] == [(2, '"Acer ""a"""', "Ahorn", "Q1"), (3, "Rosa", "two\nlines", "")]
    for text, said in (("a,b,c\n", "invalid_header"), ("baumart_bo,baumart_de,wikidata_id\nx,y\n", "invalid_row_format.*line 2")):
        with pytest.raises(Exception, match=said):
            delimited.scan_mapping(spark, write(tmp_path / "bad.csv", text)).collect()


def test_review_round_trip_keeps_values(spark, tmp_path):
    rows = spark.createDataFrame([("Q1", "b", "d", "P2", "n", ' a;"b"\n ', ""), ("Q1", "a", "d", "P10", "n", "x", "g"), ("Q2", "a", "d", "P10", "n", "", None)], ", ".join(f"`{c}` string" for c in delimited.REVIEW))
    delimited.write_review(rows, str(tmp_path / "out"), order=["baumart_bo", "property_id", "value"])
    back = delimited.scan_review(spark, str(tmp_path / "out")).drop("line").collect()
    assert sorted(tuple(r) for r in back) == sorted(tuple("" if v is None else v for v in r) for r in rows.collect())


def test_ragged_and_optional(spark, tmp_path):
    path = write(tmp_path / "r.csv", "a\nb,c,d,e,f\n")
    assert [tuple(r) for r in delimited.scan(spark, path, ["w", "x", "y", "z"], header=False, ragged=True).orderBy("line").collect()] == [(1, "a", "", "", ""), (2, "b", "c", "d", "e")]
    assert delimited.scan_optional(spark, str(tmp_path / "none.csv"), ["a", "b"]).count() == 0
    assert delimited.scan_config(spark, write(tmp_path / "c.csv", "property_id;type;action;config;description;import\n ;x\nP1;String\n")).count() == 1


def test_geojson_contract(spark, tmp_path):
    ok = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"Baumart_bo": "Acer", "gefaellt": True}, "geometry": None}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [8.5, 52.0]}}]}
    rows = geojson.scan_geojson(spark, write(tmp_path / "a.geojson", json.dumps(ok, indent=1))).orderBy("pos").collect()
    assert [(r.pos, r.botanic, r.felled, r.lng, r.wkt) for r in rows] == [(0, "Acer", True, None, None), (1, None, None, 8.5, "POINT(8.5 52.0)")]
    for text, said in (("{oops", "invalid_json"), ('{"a": 1}', "missing_features")):
        with pytest.raises(SourceError, match=said):
            geojson.scan_geojson(spark, write(tmp_path / "b.geojson", text))
    with pytest.raises(SourceError, match="file_not_found"):
        geojson.scan_geojson(spark, str(tmp_path / "none"))


def test_long_fields_and_many_rows(spark, tmp_path):
    """A field may be longer than the parser's usual limit, and a file's rows come in several batches."""
    long = "x" * 300_000 + '""' + "y" * 100
    text = "baumart_bo,baumart_de,wikidata_id\n" + f'Acer,"{long}",Q1\n' + "".join(f"Rosa {i},Rose,Q2\n" for i in range(25_000))
    rows = delimited.scan_mapping(spark, write(tmp_path / "long.csv", text)).orderBy("line").collect()
    assert rows[0].baumart_de == long.replace('""', '"') and [r.line for r in rows] == list(range(2, 25_003))


def test_coordinates_are_brought_to_degrees(spark, tmp_path):
    """Metres of a UTM zone: the middle meridian at 45 degrees, and a well-known tower in zone 31."""
    def collection(system, xy):
        crs = {"crs": {"type": "name", "properties": {"name": system}}} if system else {}
        return json.dumps(crs | {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": xy}}]})

    def place(system, xy):
        return geojson.scan_geojson(spark, write(tmp_path / "c.geojson", collection(system, xy))).first()

    r = place("urn:ogc:def:crs:EPSG::25832", [500000.0, 0.9996 * 4984944.3779])
    assert r.lng == pytest.approx(9, abs=1e-9) and r.lat == pytest.approx(45, abs=1e-8) and r.wkt == f"POINT({r.lng} {r.lat})"
    r = place("EPSG:32631", [448251.8, 5411932.7])
    assert r.lng == pytest.approx(2.2945, abs=2e-5) and r.lat == pytest.approx(48.8582, abs=2e-5)
    for system in (None, "EPSG:4326", "urn:ogc:def:crs:OGC:1.3:CRS84"):
        r = place(system, [8.5, 52.0])
        assert (r.lng, r.lat) == (8.5, 52.0)
    with pytest.raises(SourceError, match="unknown_crs"):
        place("EPSG:31468", [4400000.0, 5700000.0])


def test_named_tables(spark):
    """Tables get names in their order; those without cells don't count, those beyond the names go."""
    grid = "".join(f"<table><tr><th>k{i}</th><td> v <b>{i}</b></td></tr><tr></tr></table>" for i in range(11))
    pages = spark.createDataFrame([(1, "a.html", "<table></table>" + grid), (2, "b.html", None), (3, "c.html", "<td>no table</td>"), (4, "d.html", "<table><tr><td>open")], "id long, file string, html string")
    rows = markup.named_tables(pages, "id", "file").collect()
    got = [(r.id, r.category, r.row, r.cells, r.source) for r in rows]
    assert got == [(1, c, 0, [f"k{i}", f"v {i}"], "a.html") for i, c in enumerate(markup.CATEGORIES)] + [(4, markup.CATEGORIES[0], 0, ["open"], "d.html")]


def test_turtle(spark):
    text = """@prefix wd: <http://e/> . PREFIX r: <http://r#>
# a comment
wd:Q1 a r:Tree ; r:label "Ahorn"@de , "ma\\"ple\\u00e9"@EN, "plain" ; r:n 5, 2.5 ;
  r:long \"\"\"two
"lines\"\"\" ; r:typed "7"^^<http://www.w3.org/2001/XMLSchema#int> .
<http://e/Q2> r:see wd:Q1 ."""
    facts = markup.read_turtle(text)
    assert ("http://e/Q1", markup.TYPE, "iri", "http://r#Tree", None) in facts and ("http://e/Q1", "http://r#label", "literal", 'ma"pleé', "en") in facts
    assert ("http://e/Q1", "http://r#long", "literal", 'two\n"lines', None) in facts and ("http://e/Q2", "http://r#see", "iri", "http://e/Q1", None) in facts and len(facts) == 9
    for bad in ("wd:Q1 a wd:Q2 .", "<a> <b> .", '<a> <b> "x', "<a> <b> <c>"):
        with pytest.raises(markup.TurtleError):
            markup.read_turtle(bad)
    df = spark.createDataFrame([("Q1", *f) for f in facts], "entity string, s string, p string, o_kind string, o_value string, o_lang string")
    lines = "\n".join(r.line for r in markup.turtle_lines(df).collect())
    assert set(markup.read_turtle(lines)) == set(facts)


def test_html_tables(spark):
    html = "<h1>A <b>b</b></h1><table><td>loose</td></table><h4>Leaf</h4><table><tr><td title='d1'>Form <i>x</i></td><td><span title='d2'>Size</span></td></tr></table><h4>Root</h4><table><tr><td title='later'>Size</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None)], "id long, html string")
    rows = markup.table_attributes(pages, "id")
    assert [(r.group_name, r.attribute, r.description) for r in rows.orderBy("pos").collect()] == [("Leaf", "Form x", "d1"), ("Leaf", "Size", "d2"), ("Root", "Size", "later")]
    assert {(r.attribute, r.description) for r in markup.first_descriptions(rows, "id").collect()} == {("Form x", "d1"), ("Size", "d2")}
    assert pages.select(markup.headings(pages.html)).first()[0] == ["A b"]


def test_segments(spark, tmp_path):
    pts = spark.createDataFrame([(i, "oak", float(i % 7), float(i % 5)) for i in range(40)], "id long, species string, lng double, lat double")
    index = geojson.write_segments(pts, str(tmp_path / "seg"), ["id", "species"])
    assert index.count() == 100
    back = geojson.read_segments(spark, str(tmp_path / "seg"), index.filter("cell_x = 0 and cell_y = 0"))
    assert {int(r.properties["id"]) for r in back.collect()} == {i for i in range(40) if i % 7 == 0 and i % 5 == 0}
    assert spark.read.json(str(tmp_path / "seg-index")).count() == 100


def test_upsert_owned_nulls_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "c", "z")], "k int, v string, other string")
    new = spark.createDataFrame([(1, None), (3, "n"), (None, "m")], "k int, v string")
    got = sorted(((r.k or 0), r.v, r.other) for r in tab.upsert(old, new, ["k"]).collect())
    assert got == [(0, "m", "z"), (1, None, "x"), (2, "b", "y"), (3, "n", None)]


def test_rewrite_and_constraints(spark):
    old = spark.createDataFrame([(1, "p", "v"), (1, "q", "v"), (2, "p", "v")], "t int, a string, v string")
    new = spark.createDataFrame([(1, "p", "w")], "t int, a string, v string")
    scope = spark.createDataFrame([(1,)], "t int"), spark.createDataFrame([("p",)], "a string")
    assert {tuple(r) for r in tab.rewrite_scope(old, new, *scope).collect()} == {(1, "q", "v"), (2, "p", "v"), (1, "p", "w")}
    rows = spark.createDataFrame([(1, None, 9), (1, None, None), (2, "u", 1)], "t int, unit string, ref int")
    parent = spark.createDataFrame([(1,)], "ref int")
    assert {r.rule: r.n for r in tab.violations(rows, ["t", "unit"], ["unit"], (parent, "ref")).collect()} == {"unique": 1, "not_null:unit": 2, "reference:ref": 1}
    assert {r.ref for r in tab.cascade(rows, parent, "ref").collect()} == {None, 1}
    assert sorted(str(r.ref) for r in tab.set_null(rows, parent, "ref").collect()) == ["1", "None", "None"]


def test_activity_and_streams(spark, tmp_path):
    toggles = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (3, 1, 5), (4, 2, 5), (5, 2, 5), (6, 3, 7)], "id long, tree long, user_id long")
    held = {(1, 5), (3, 7)}
    assert {tuple(r) for r in act.adopted(toggles).collect()} == held
    assert {tuple(r) for r in act.toggle(act.toggle(act.adopted(toggles), 1, 5), 9, 9).collect()} == {(3, 7), (9, 9)}
    toggles.repartition(3).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(toggles.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    assert {tuple(r) for r in live.run_adopted(stream, spark).collect()} == held
    wat = spark.createDataFrame([(1, 5, 7, 10.0), (2, 5, None, 20.0), (3, 6, 7, 5.0)], "id long, tree long, user_id long, amount double")
    ids = wat.select("id")
    assert {r.id for r in act.delete_own(wat, ids, 7).collect()} == {2}
    msg = spark.createDataFrame([('{"type": "a", "ai": true, "payload": {"message": "hi", "buttons": [{"name": "x"}]}}',), ('{"type": "path"}',), ("junk",)], "raw string")
    flat = msg.select(act.flatten_messages(msg.raw).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in flat] == [("hi", "a", ["x"], True), ("", "path", [], False), ("", None, [], False)]


def test_late_waterings_are_dropped(spark, tmp_path):
    day = lambda rows, n: spark.createDataFrame(rows, "tree long, amount double, created_at string").selectExpr("tree", "amount", "timestamp(created_at) AS created_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "w" / str(n)))
    day([(1, 5.0, "2024-01-01 00:10:00"), (1, 6.0, "2024-01-01 00:50:00")], 0)
    day([(1, 1.0, "2024-01-01 09:00:00")], 1)
    day([(1, 1.0, "2024-01-01 10:00:00")], 2)
    day([(1, 99.0, "2024-01-01 00:20:00"), (2, 1.0, "2024-01-02 00:00:00")], 3)
    for n in range(4):  # files are taken in the order of their times
        for f in (tmp_path / "w" / str(n)).glob("*.parquet"):
            os.utime(f, (1_700_000_000 + 60 * n,) * 2)
    schema = spark.read.parquet(str(tmp_path / "w" / "0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "w" / "*"))
    got = {(r.tree, str(r.start)[11:16]): (r.litres, r.n) for r in live.run_windows(stream, spark).collect()}
    assert got[1, "00:00"] == (11.0, 2)


def test_a_write_that_dies_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    row = lambda v: spark.createDataFrame([("Q1", "b", "d", "P2", "n", v, "")], ", ".join(f"`{c}` string" for c in delimited.REVIEW))
    delimited.write_review(row("one"), path)

    def broken(batches):
        raise RuntimeError("lost")
        yield

    lost = row("two").mapInArrow(broken, row("two").schema)
    with pytest.raises(Exception, match="lost"):
        delimited.write_review(lost, path)
    assert [r.value for r in delimited.scan_review(spark, path).collect()] == ["one"]
    delimited.write_review(row("three"), path)
    assert [r.value for r in delimited.scan_review(spark, path).collect()] == ["three"]
    pts = spark.createDataFrame([(1, "oak", 1.0, 2.0), (2, "ash", 3.0, 4.0)], "id long, species string, lng double, lat double")
    geojson.write_segments(pts, path + "-seg", ["id"], n=2)
    broken_pts = pts.mapInArrow(broken, pts.schema)
    with pytest.raises(Exception, match="lost"):
        geojson.write_segments(broken_pts, path + "-seg", ["id"], n=2)
    assert sorted(r.properties["id"] for r in geojson.read_segments(spark, path + "-seg").collect()) == ["1", "2"]


def test_written_out_turtle_needs_no_tokens(spark, monkeypatch):
    plain = '<http://a/1> <http://b/x> "q\\"uo\\\\te \\u00e9 ; . #"@DE-at .\n<http://a/1>\t<http://b/x> <http://c/2> .\n\n<http://a/1> <http://b/y> "" . <http://a/1> <http://b/y> "" .'
    odd = ['"x" .', "<http://a/1> <http://b/x> 5 .", '<http://a/1> <http://b/x> """a\n"b""" .', '@prefix a: <http://a/> .\na:1 a:x "y"@en, a:z ; a a:T .', plain + "\n# note\n", ""]
    read = lambda text: [tuple(r) for r in zip(*markup.turtle_columns(text), strict=True)]
    for text in (plain, *odd[1:]):
        assert read(text) == markup.read_turtle(text), text
    with pytest.raises(markup.TurtleError):
        read(odd[0])
    files = spark.createDataFrame([("Q1", plain), ("Q2", odd[3]), ("Q3", None)], "entity string, text string")
    assert sorted(map(tuple, markup.scan_turtle(files, 2).collect()), key=str) == sorted([(e, *f) for e, x in (("Q1", plain), ("Q2", odd[3])) for f in markup.read_turtle(x)], key=str)
    want = markup.read_turtle(plain)
    monkeypatch.setattr(markup, "read_turtle", None)
    assert read(plain) == want and len(want) == 3


def test_collections_of_a_small_file_are_parsed_by_many_tasks(spark):
    from grove.plans.app_queries import plane_collections

    assert plane_collections(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
