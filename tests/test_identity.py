import random
from urllib.parse import quote_plus

import pytest
from pyspark.sql import functions as F

from grove.operators import identity as idn
from grove.operators import matching as mat
from grove.operators import planner, relations
from grove.operators.attributes import parse_config

MAP = "line long, botanic string, common string, qid string"


def fold(rows):
    """Row by row: (targets, {line: code})."""
    kept, codes = {}, {}
    for line, botanic, common, qid in sorted(rows):
        key = " ".join(botanic.lower().split())
        if qid == "":
            codes[line] = "blank_mapping_qid"
        elif not (qid[1:].isdigit() and qid[1] != "0"):
            codes[line] = "invalid_qid"
        elif key in kept:
            codes[line] = "duplicate_mapping" if kept[key] == qid else "conflicting_mapping_qids"
        else:
            kept[key], codes[line] = qid, None
    return codes


def test_mapping_codes_against_the_fold(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(i, rng.choice(["Acer alba", "acer  alba", "Rosa", " ROSA ", "Ulmus x"]), rng.choice("ab"), rng.choice(["", "Q0", "Q1", "Q2", "Q01"])) for i in range(2, 60)]
        rng.shuffle(rows)
        got = {r.line: r.code for r in idn.classify_mapping(spark.createDataFrame(rows, MAP)).collect()}
        assert got == fold(rows)


def test_mapping_is_rejected_as_a_whole(spark):
    good = spark.createDataFrame([(2, "Acer a", "x", "Q1"), (3, "Rosa b", "y", "Q1"), (4, "Ulmus", "z", "")], MAP)
    targets, entities, warnings = idn.build_mapping(good)
    assert targets.count() == 2 and [r.line for r in entities.collect()] == [2] and [r.line for r in warnings.collect()] == [4]
    with pytest.raises(idn.MappingRejected, match="invalid_qid: line 5.*\n.*duplicate_mapping: line 6"):
        idn.build_mapping(good.unionByName(spark.createDataFrame([(5, "Tilia", "x", "Q0"), (6, "ACER  A", "other", "Q1")], MAP)))


def test_first_rows_conflicts_and_merges(spark):
    rows = spark.createDataFrame([(3, "acer a", "C"), (1, "Acer A", "A"), (2, "Acer  a", "B"), (4, " ", "D"), (5, "Rosa", None), (6, "rosa", "E"), (7, "Acer A", "A")], "pos long, botanic string, common string")
    assert sorted(r.pos for r in idn.distinct_species(rows).collect()) == [1, 5]
    assert sorted(r.pos for r in idn.name_conflicts(rows).collect()) == [2, 3, 6]
    assert {(r.kept, r.merged) for r in idn.spelling_merges(rows).collect()} == {("Acer A", "Acer  a"), ("Acer A", "acer a"), ("Rosa", "rosa")}


REF = [
    (1, "Acer alba", "", "Q1"), (2, "Acer alba", "", "Q2"), (3, "Tilia × vulgaris", "", "Q3"), (4, "Pinus mugo", "", "Q4"), (5, "pinus  MUGO", "", "Q5"), (6, "Quercus petraea", "", ""), (7, "Rosa canina", "", "Q7"),
]
EXT = {
    "Acer alba": ("exact", "Q2", "Acer alba"), "Acer alba Mill.": ("author_stripped", "Q2", "Acer alba"), "PINUS MUGO Turra": ("normalized", "Q4", "Pinus mugo"), "Tilia x vulgaris Hayne": ("hybrid_agnostic", "Q3", "Tilia × vulgaris"),
    "Pinus mugo Turra subsp. rotundata": ("infraspecific_stripped", "Q4", "Pinus mugo"), "Dog rose": ("synonym", "Q7", "ROSA canina"), "Lost name Auth.": (None, None, None), "Xyz abc (R. nothing) (Rosa canina L.)": ("parenthetical_synonym", "Q7", "Rosa canina"),
    "By hand": ("manual", "Q99", None), "Quercus petraea": ("exact", "", "Quercus petraea"), "Bad syn (Rosa canina)": ("parenthetical_synonym", "Q7", "Rosa canina"), "Nothing here": (None, None, None),
    "Robur tree (T. vulgaris)": (None, None, None), "Tilia foo (T. × vulgaris)": ("parenthetical_synonym", "Q3", "Tilia × vulgaris"),
}


def test_each_level_of_the_cascade(spark):
    rows = [(i, n, "s", None, "") for i, n in enumerate(EXT)] + [(100, "Acer alba", "t", "Q55", "kept"), (101, "Acer alba", "t", "", "")]
    ext = spark.createDataFrame(rows, "pos long, botanic string, strain string, qid string, ref_botanic string")
    ref = spark.createDataFrame(REF, "pos long, botanic string, common string, qid string")
    syn = spark.createDataFrame([(1, "Dog rose", "ROSA canina"), (2, "Dog rose", "Acer alba"), (3, "Lost name", "Acer alba"), (0, "Lost name Auth.", "no such"), (4, "Bad syn", "no such")], "pos long, botanic string, target string")
    man = spark.createDataFrame([("By hand", "Q99"), ("Acer alba", "Q98")], "botanic string, qid string")
    got = {r.pos: (r.level, r.match_qid, r.match_botanic) for r in mat.reconcile(ext, ref, syn, man).collect()}
    assert got.pop(100) == ("existing", "Q55", "kept") and got.pop(101) == ("exact", "Q2", "Acer alba")
    assert {n: got[i] for i, n in enumerate(EXT)} == EXT


def test_write_back_keeps_what_is_there(spark):
    ext = spark.createDataFrame([(1, "A a", "x", None, "mine"), (2, "A a", None, None, ""), (3, "B b", "", None, None)], "pos long, botanic string, strain string, qid string, ref_botanic string")
    matches = spark.createDataFrame([(1, "A a", "x", "exact", "Q1", "ref"), (2, "A a", None, "exact", "Q2", "ref"), (3, "B b", "", None, None, None)], "pos long, botanic string, strain string, level string, match_qid string, match_botanic string")
    assert sorted((r.pos, r.qid, r.ref_botanic) for r in mat.write_back(ext, matches).collect()) == [(1, "Q1", "mine"), (2, "Q2", "ref"), (3, None, "")]


CFG = "line long, property_id string, type string, action string, config string, description string, import string"


def test_values_meet_every_outcome(spark):
    cfg = [
        (2, "P1", "String", "", "", "Höhe – x", ""), (3, "P2", "String", "ignore", "", "d", ""), (4, "P3", "String", "", "", "", ""), (5, "P4", "WikibaseItem", "inline", '{"target": "hoehe"}', "d", ""), (6, "P5", "Url", "", "", "d", "skip"), (7, " ", "x", "", "", "", ""), (8, "P1", "Quantity", "odd", "", "Höhe – x", ""),
    ]
    review = [(2, "ACER a", "P1", "v"), (3, "Acer  a", "P4", "v"), (4, "Rosa", "P1", "v"), (5, "Ulmus", "P1", "v"), (6, "Acer a", "P2", "v"), (7, "Acer a", "P3", "v"), (8, "Acer a", "P9", "v"), (9, "Acer a", "P5", "v"), (10, "Acer a", "P1", "w"), (11, "Acer a", "P1", "v")]
    frames = [
        spark.createDataFrame([(2, "Acer a", "Ahorn", "Q1"), (3, "Ulmus", "Ulme", "Q2")], MAP),
        spark.createDataFrame([(line, b, "Ahorn", "Q1", p, "hoehe", v) for line, b, p, v in review], "line long, botanic string, common string, qid string, property_id string, attribute_name string, value string"),
        spark.createDataFrame([(1, "acer a", "Ahorn"), (2, "Rosa", "Rose")], "pos long, botanic string, common string"),
    ]
    plan = planner.build(parse_config(spark.createDataFrame(cfg, CFG)), *frames)
    got = {r.line: r.reason for r in plan["values"].collect()}
    assert got == {2: None, 3: "duplicate_value", 4: "missing_mapping", 5: "no_cadastre_tree_type", 6: "property_not_importable", 7: "missing_attribute_name", 8: "property_not_importable", 9: "property_not_importable", 10: None, 11: "duplicate_value"}
    assert planner.summary(plan).first().asDict() == {"n_values": 2, "skipped_values": 8, "tree_types": 2, "matched": 1, "unmatched_species": 1, "unmatched_mapping": 1, "attributes": 2}
    assert [(r.attribute_name, r.property_ids) for r in plan["key_issues"].collect()] == [("hoehe", ["P1", "P4"])]
    assert {r.property_id: r.vocabulary for r in plan["attributes"].collect()} == {"P1": "number", "P4": "string"}
    assert {(r.line, r.code) for r in plan["identity_issues"].collect()} == {(5, "mapping_review_qid_mismatch")}
    with pytest.raises(planner.PlanRejected, match="duplicate_attribute_key: hoehe, P1, P4") as told:
        planner.gate(plan)
    assert len(str(told.value).splitlines()) == told.value.issues.count() == 2  # every issue is listed
    wrote = {}
    for dry in (True, False):
        with pytest.raises(planner.PlanRejected):
            planner.run(plan, {}, wrote.__setitem__, dry)
    assert not wrote


def test_one_plan_is_reported_or_carried_out(spark):
    cfg = [(2, "P1", "String", "", "", "Höhe", ""), (3, "P4", "Quantity", "", "", "Alter", "")]
    review = [(2, "ACER a", "P1", "v"), (3, "Acer  a", "P4", "7"), (4, "Acer a", "P1", "v")]
    names = {"P1": "hoehe", "P4": "alter"}
    plan = planner.build(
        parse_config(spark.createDataFrame(cfg, CFG)),
        spark.createDataFrame([(2, "Acer a", "Ahorn", "Q1")], MAP),
        spark.createDataFrame([(line, b, "Ahorn", "Q1", p, names[p], v) for line, b, p, v in review], "line long, botanic string, common string, qid string, property_id string, attribute_name string, value string"),
        spark.createDataFrame([(1, "acer a", "Ahorn"), (2, "Rosa", "Rose")], "pos long, botanic string, common string"),
    )
    tables = {
        "tree_types": spark.createDataFrame([("acer a", "old", None), ("Ulmus", "Ulme", "Q9")], "name_botanic string, name string, wikidata_id string"),
        "attributes": spark.createDataFrame([("alter", "string", "P0"), ("own", "string", None)], "name string, datatype string, wikidata_id string"),
        "values": spark.createDataFrame([("acer a", "alter", "5"), ("acer a", "own", "x"), ("Ulmus", "alter", "8")], "name_botanic string, attribute string, value string"),
    }
    wrote = {}
    keep = lambda name, rows: wrote.__setitem__(name, {tuple(r) for r in rows.collect()})
    dry = planner.run(plan, tables, keep, dry_run=True).first().asDict()
    assert dry.pop("dry_run") and not wrote
    real = planner.run(plan, tables, keep).first().asDict()
    assert not real.pop("dry_run") and dry == real == {"n_values": 2, "skipped_values": 1, "tree_types": 2, "matched": 1, "unmatched_species": 1, "unmatched_mapping": 0, "attributes": 2}
    assert wrote == {
        "tree_types": {("acer a", "Ahorn", "Q1"), ("Rosa", "Rose", None), ("Ulmus", "Ulme", "Q9")},
        "attributes": {("hoehe", "string", "P1"), ("alter", "number", "P4"), ("own", "string", None)},
        "values": {("acer a", "hoehe", "v"), ("acer a", "alter", "7"), ("acer a", "own", "x"), ("Ulmus", "alter", "8")},
    }


def test_all_issues_of_a_mapping_are_listed(spark):
    rows = spark.range(2500).selectExpr("id + 2 as line", "concat('Acer ', id) as botanic", "'x' as common", "'Q0' as qid")
    with pytest.raises(idn.MappingRejected) as told:
        idn.build_mapping(rows)
    assert len(str(told.value).splitlines()) == 2500


def test_config_json_is_checked(spark):
    rows = [(2, "P1", "t", "inline", "", "", ""), (3, "P2", "t", "inline", '{"target": 5}', "", ""), (4, "P3", "t", "", "junk", "", '{"group": 7}'), (5, "P4", "t", "", "", "", "[1]"), (6, "P5", "t", "inline", '{"target": "x", "keep_source": true, "source": "P7"}', "", ' {"attribute_name": "n"} ')]
    got = {r.property_id: r for r in parse_config(spark.createDataFrame(rows, CFG)).collect()}
    assert {k: r.code for k, r in got.items()} == {"P1": "invalid_inline_config", "P2": "invalid_inline_config", "P3": "invalid_import_config", "P4": "invalid_import_config", "P5": None}
    assert (got["P5"].inline_target, got["P5"].keep_source, got["P5"].inline_source, got["P5"].import_name, got["P5"].import_group) == ("x", True, "P7", "n", None)


def test_chunks_and_cache(spark):
    rows = spark.range(1234).withColumnRenamed("id", "x")
    got = {r.x: r.chunk for r in planner.chunks(rows, "x", 100).collect()}
    assert got == {i: i // 100 for i in range(1234)}
    pairs = planner.chunk_pairs(spark.range(401).toDF("t"), spark.range(72).toDF("a"), "t", "a").collect()
    assert len(pairs) == 10 and all(len(p.type_ids) <= 100 and len(p.attribute_ids) <= 40 for p in pairs)
    assert sorted((x, y) for p in pairs for x in p.type_ids for y in p.attribute_ids) == [(x, y) for x in range(401) for y in range(72)]
    assert planner.chunk_pairs(spark.range(5).toDF("t"), spark.range(0).toDF("a"), "t", "a").count() == 0
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k long")
    for mode, read, fetch in (("auto", {2}, {1}), ("skip", {2}, set()), ("force", set(), {1, 2})):
        parts = relations.split_cached(ids(1, 2), ids(2, 3, 4), ids(1, 2, 3), "k", mode)
        assert [{r.k for r in parts[p].collect()} for p in ("read", "fetch", "stale")] == [read, fetch, {4}]


def packed(ids, budget, most):
    out, used = [[]], 0
    for i in sorted(ids, key=str.encode):
        size = len(quote_plus(i))
        if out[-1] and (used + 3 + size > budget or len(out[-1]) == most):
            out.append([])
        used = size if not out[-1] else used + 3 + size
        out[-1].append(i)
    return out if ids else []


@pytest.mark.parametrize(("n", "budget", "most"), [(0, 50, 5), (1, 50, 5), (300, 60, 4), (300, 200, 100), (300, 20, 7), (250, 100_000, 100), (40, 100_000, 100)])
def test_packs_are_those_of_a_greedy_loop(spark, n, budget, most):
    rng = random.Random(n * budget)
    ids = sorted({"".join(rng.choice("aé# -") for _ in range(rng.randint(1, rng.choice([3, 12])))) for _ in range(n)})
    rows = spark.createDataFrame([(i,) for i in ids * 2] + [(None,)], "k string")
    got = {}
    for r in planner.packs(rows, "k", budget, most).collect():
        got.setdefault(r.pack, []).append(r.id)
    assert [sorted(got[p], key=str.encode) for p in sorted(got)] == packed(ids, budget, most)
    assert sorted(got) == list(range(len(got)))


def test_requests_stay_under_their_bound(spark):
    types, attributes = ([(f"{x}{i:08d}-0000-0000-0000-00000000{i % 10_000:04d}",) for i in range(n)] for x, n in (("1", 401), ("2", 72)))
    make = lambda t, a, **more: planner.delete_requests(spark.createDataFrame(t, "t string"), spark.createDataFrame(a, "a string"), "t", "a", "/rest/v1/v", ("t", "a"), **more).collect()
    got = make(types + [(None,)], attributes + [(None,)])
    for r in got:
        target = "/rest/v1/v?t=in." + quote_plus("(" + ",".join(r.type_ids) + ")") + "&a=in." + quote_plus("(" + ",".join(r.attribute_ids) + ")")
        assert len(target) == r.n_bytes <= 7500 and r.fits and len(r.type_ids) <= 100 and len(r.attribute_ids) <= 40
    assert {(t, a) for r in got for t in r.type_ids for a in r.attribute_ids} == {(t, a) for (t,) in types for (a,) in attributes}
    assert make([], attributes[:0] + [(None,)]) == [] and make(types, [(None,)]) == []
    assert [r.fits for r in make([("x" * 200,)], [("y",)], most_bytes=150)] == [False]
    pairs = planner.chunk_pairs(spark.createDataFrame([(i,) for i in [None, *range(40)]], "t int"), spark.createDataFrame([(i,) for i in [None, *range(40)]], "a int"), "t", "a").collect()
    assert [(len(r.type_ids), len(r.attribute_ids)) for r in pairs] == [(40, 40)]


def test_pairs_are_dealt_in_blocks_and_cross_no_shuffle(spark):
    made = planner.chunk_pairs(spark.range(1100).toDF("t"), spark.range(300).toDF("a"), "t", "a", 1, 1)
    told = made.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in told) == 330_000 and max(r.n for r in told) <= 1.1 * planner.LEFT_BLOCK * planner.RIGHT_BLOCK
    assert made.select("type_chunk", "attribute_chunk").distinct().count() == 330_000
    ids = [spark.createDataFrame([(f"{x}{i}",) for i in range(1000)], "x string") for x in "ab"]
    asked = planner.delete_requests(*ids, "x", "x", "/v", ("a", "b"), n_types=1, n_attributes=1)
    assert asked.count() == 1_000_000
    assert max(r["count"] for r in asked.groupBy(F.spark_partition_id()).count().collect()) <= 1.1 * planner.LEFT_BLOCK * planner.RIGHT_BLOCK
