import pytest
from pyspark.sql import functions as F

from grove.operators import attributes as att
from grove.operators import triples as tri

FACT = "entity string, s string, p string, o_kind string, o_value string, o_lang string"
CFG = "line long, property_id string, type string, action string, config string, description string, import string"


def graph(spark, rows):
    short = lambda x: x.replace("wd:", tri.WD).replace("wdt:", tri.WDT).replace("label", tri.LABEL)
    return spark.createDataFrame([(e, short(s), short(p), k, o.replace("wd:", tri.WD), lang) for e, s, p, k, o, lang in rows], FACT)


def config(spark):
    rows = [(2, "P1", "WikibaseItem", "inline", '{"target": "shape"}', "", ""), (3, "P2", "WikibaseItem", "inline", '{"target": "kept", "keep_source": true}', "Kept one", ""), (4, "P3", "String", "ignore", "", "", ""), (5, "P4", "String", "", "", "Name – x", '{"group": "g"}'), (6, "P5", "WikibaseItem", "", "", "Link", "")]
    return att.with_attribute_names(att.parse_config(spark.createDataFrame(rows, CFG)))


RAW = [
    ("Q1", "wd:Q1", "label", "literal", "Ahorn", "de"), ("Q1", "wd:Q1", "label", "literal", "érable", "fr"), ("Q1", "wd:Q1", "wdt:P1", "iri", "wd:Q10", None), ("Q1", "wd:Q1", "wdt:P1", "iri", "wd:Q11", None),
    ("Q1", "wd:Q1", "wdt:P2", "iri", "wd:Q12", None), ("Q1", "wd:Q1", "wdt:P3", "literal", "gone", None), ("Q1", "wd:Q1", "wdt:P4", "literal", "b", "en"), ("Q1", "wd:Q1", "wdt:P4", "literal", "plain", None), ("Q1", "wd:Q1", "wdt:P4", "literal", "a", "en"),
    ("Q1", "wd:Q1", "wdt:P5", "iri", "http://x/y.jpg", None), ("Q1", "wd:Q1", "wdt:P5", "iri", "wd:Q12", None), ("Q1", "wd:Q1", "wdt:P5", "iri", "wd:Q11", None), ("Q1", "wd:Q1", "http://other", "literal", "no", None),
    ("Q1", "wd:Q10", "label", "literal", "round", "en"), ("Q1", "wd:Q10", "label", "literal", "rund", "de"), ("Q1", "wd:Q11", "label", "literal", "rond", "fr"), ("Q1", "wd:Q12", "label", "literal", "twelve", "en"), ("Q1", "wd:Q12", "label", "literal", "zwölf", None),
    ("Q1", "wd:Q13", "label", "literal", "unlinked", "de"),
]


def test_processing_order(spark):
    done = {(r.s.replace(tri.WD, ""), r.p.replace(tri.WDT, "").replace(tri.NS, "ns:"), r.o_value.replace(tri.WD, ""), r.o_lang) for r in tri.process(graph(spark, RAW), config(spark)).collect()}
    own = {x for x in done if x[0] == "Q1"}
    assert {x[1:] for x in own if x[1] in ("P1", "ns:shape", "P2", "ns:kept", "P3", "http://other")} == {("P1", "Q11", None), ("ns:shape", "rund", "de"), ("P2", "Q12", None), ("ns:kept", "twelve", "en")}
    assert not any(x[0] in ("Q10", "Q13") for x in done)  # Q10's link went, so what it says went too
    assert ("Q12", tri.LABEL, "zwölf", None) in done and not any(x[3] == "fr" for x in done)


def test_export_gives_each_target_all_values_once(spark):
    targets = spark.createDataFrame([(2, "Acer a", "A", "Q1"), (3, "Acer b", "B", "Q1"), (4, "No graph", "C", "Q7")], "line long, botanic string, common string, qid string")
    rows = tri.export(targets, tri.process(graph(spark, RAW), config(spark)), config(spark)).collect()
    want = [("P1", "shape", "rund", ""), ("P2", "kept", "twelve", ""), ("P4", "name", "a", "g"), ("P4", "name", "b", "g"), ("P4", "name", "plain", "g"), ("P5", "link", "http://x/y.jpg", ""), ("P5", "link", "zwölf", "")]
    for line in (2, 3):
        assert sorted((r.property_id, r.attribute_name, r.value, r.group_name) for r in rows if r.line == line) == want
    assert len(rows) == 2 * len(want)


def test_label_chains(spark):
    raw = graph(spark, [("Q1", "wd:Q5", "label", "literal", t, lang) for t, lang in (("x", None), ("e2", "en"), ("e1", "en"), ("f", "fr"))])
    assert [tri.preferred_labels(raw, c).first().label for c in ("inline", "export")] == ["e1", "x"]


def test_vocabulary_and_new_properties(spark):
    c = config(spark)
    facts = tri.process(graph(spark, RAW), c)
    assert {r.p.replace(tri.NS, ""): r.label for r in tri.namespace_labels(facts, c).collect()} == {"shape": "shape", "kept": "Kept one"}
    voc = spark.createDataFrame([(tri.WD + "P77", tri.PROPERTY_TYPE, "iri", tri.ONTOLOGY + "WikibaseItem", None), (tri.WD + "P77", tri.LABEL, "literal", "Große Form", "de"), (tri.WD + "P77", tri.DESCRIPTION, "literal", "text", "en"), ("http://no", tri.LABEL, "literal", "x", "de")], "s string, p string, o_kind string, o_value string, o_lang string")
    meta = tri.property_metadata(voc)
    assert [tuple(r) for r in meta.select("property_id", "type", "label", "description").collect()] == [("P77", "WikibaseItem", "Große Form", "Große Form – text")]
    more = graph(spark, RAW + [("Q1", "wd:Q1", "wdt:P77", "literal", "v", None), ("Q1", "wd:Q1", "wdt:P78", "literal", "v", None)])
    got = {r.property_id: (r.action, r.config) for r in tri.new_properties(more, c, meta).collect()}
    assert got == {"P77": ("inline", '{"target": "grosse_form", "keep_source": true}'), "P78": ("", "")}


def test_values_and_types(spark):
    wide = spark.createDataFrame([(1, "x", ["a", "b"], True, None), (2, None, None, None, 2.5)], "id long, name string, tags array<string>, flag boolean, size double")
    rows = att.values_as_text(wide, "id", ["name", "tags", "flag", "size"])
    assert {(r.id, r.attribute, r.type, r.value) for r in rows.collect()} == {(1, "name", "string", "x"), (1, "tags", "string", "a"), (1, "tags", "string", "b"), (1, "flag", "boolean", "true"), (2, "size", "number", "2.5")}
    long = att.melt_joined(wide.select("id", "name"), "id", ["name"], spark.createDataFrame([("name", "g")], "attribute string, group_name string"))
    assert {(r.id, r.value, r.group_name) for r in long.collect()} == {(1, "x", "g"), (2, None, "g")}
    assert att.with_surrogates(wide, ["name"], "key").select(F.countDistinct("key")).first()[0] == 2


def test_closure_is_that_of_with_secondary_without_a_distinct(spark):
    q = lambda i: f"{tri.WD}Q{i}"
    own = [("Q1", q(1), tri.WDT + "P1", "iri", q(1), None), ("Q1", q(1), tri.WDT + "P1", "iri", q(2), None), ("Q1", q(1), tri.WDT + "P9", "iri", q(3), None), ("Q1", q(1), tri.LABEL, "literal", "a", "de"), ("Q1", q(1), "http://schema.org/about", "iri", q(4), None)]
    others = [("Q1", q(i), tri.LABEL, "literal", f"x{i}", lang) for i in (2, 3, 4) for lang in ("de", "fr", None)] + [("Q2", q(2), tri.WDT + "P9", "literal", "b", None), ("Q2", q(2), tri.LABEL, "literal", "b", "en"), ("Q1", q(2), None, "literal", "no p", None), ("Q1", q(1), None, "literal", "no p", None)]
    raw = spark.createDataFrame(own + others, "entity string, s string, p string, o_kind string, o_value string, o_lang string")
    ignored = spark.createDataFrame([("P9",)], "property_id string")
    got = tri.closure(raw, ignored)
    want = tri.with_secondary(tri.main_facts(raw, ignored), raw)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.count() == 11 and got._jdf.queryExecution().optimizedPlan().toString().startswith("Union") and not want._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


@pytest.mark.parametrize("name", ["tri_vocab", "tri_vocab_labels"])
def test_vocabularies_store_no_processed_facts(spark, name):
    from grove.plans.fact_queries import Q
    from grove.sources import scratch

    before = set(scratch._tables)
    Q[name](spark, "/root/testdata/sf0.001")
    made = [spark.read.parquet(p).columns for p in scratch._tables if p not in before]
    assert made.count(tri.COLUMNS) == 1  # the raw ones


def plain_process(raw, rules):
    """One entity after the other, in Python. rules: property to (action, target, keep_source)."""
    out = set()
    for e in {x[0] for x in raw}:
        mine, subject = {x for x in raw if x[0] == e}, tri.WD + e
        pid = lambda x: x[2].removeprefix(tri.WDT) if x[2] and x[2].startswith(tri.WDT) else None
        rule = lambda x: rules.get(pid(x), ("keep", None, False))
        kept, made = set(), set()
        for x in (x for x in mine if x[1] == subject and (x[2] == tri.LABEL or (pid(x) and rule(x)[0] != "ignore"))):
            labels = [y for lang in ("de", "en") for y in sorted((y for y in mine if y[1] == x[4] and y[2] == tri.LABEL and y[3] == "literal" and y[5] == lang), key=str)]
            hit = rule(x)[0] == "inline" and x[3] == "iri" and labels
            if hit:
                made.add((e, subject, tri.NS + rule(x)[1], "literal", *labels[0][4:]))
            if not hit or rule(x)[2]:
                kept.add(x)
        linked = {x[4] for x in kept if x[3] == "iri" and x[4].startswith(tri.WD)}
        out |= {x for x in kept | made | {x for x in mine if x[1] in linked} if x[5] in (None, "de", "en")}
    return out


def test_processing_is_that_of_plain_python_on_graphs_that_point_to_themselves(spark):
    import random

    rnd, raw = random.Random(3), set()
    for e in (f"Q{i}" for i in range(1, 13)):
        node = lambda: f"{tri.WD}Q{rnd.randint(1, 14)}" if rnd.random() < 0.8 else f"{tri.WD}{e}"  # noqa: B023, E731
        for _ in range(60):
            p = rnd.choice([tri.LABEL, tri.LABEL, *[f"{tri.WDT}P{i}" for i in (1, 1, 2, 3, 4, 5)], "http://other", None, tri.NS + "shape"])
            s = node() if p == tri.LABEL else rnd.choice([node(), tri.WD + e, tri.WD + e])
            if p != tri.LABEL and rnd.random() < 0.6:
                raw.add((e, s, p, "iri", rnd.choice([node(), node(), "http://x/y"]), rnd.choice([None] * 9 + ["fr"])))
            else:
                raw.add((e, s, p, "literal", rnd.choice("abc"), rnd.choice([None, "de", "en", "en", "fr"])))
    rules = {"P1": ("inline", "shape", False), "P2": ("inline", "kept", True), "P3": ("ignore", None, False)}
    got = [tuple(r) for r in tri.process(spark.createDataFrame(sorted(raw, key=str), FACT), config(spark)).collect()]
    assert sorted(got, key=str) == sorted(plain_process(raw, rules), key=str)


def made_by(spark, name):
    """The query's frame, and the columns of each table that it stored."""
    from grove.plans.fact_queries import Q
    from grove.sources import scratch

    before = set(scratch._tables)
    out = Q[name](spark, "/root/testdata/sf0.001")
    return out, [spark.read.parquet(p).columns for p in scratch._tables if p not in before]


def test_processing_deals_facts_once_and_stores_none(spark):
    out, stored = made_by(spark, "tri_process")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert stored == [] and plan.count("Exchange hashpartitioning(entity#") == 1 and "SortMergeJoin" not in plan


def test_export_stores_targets_only_and_processes_their_entities_only(spark):
    out, stored = made_by(spark, "tri_export")
    assert stored == [["line", "botanic", "common", "qid", "key"]]
    facts = graph(spark, [("Q1", "wd:Q1", "label", "literal", "a", "de"), ("Q2", "wd:Q2", "label", "literal", "b", "de")])
    targets = spark.createDataFrame([(2, "Q1"), (3, "Q1"), (4, "Q7"), (5, None)], "line long, qid string")
    assert [r.o_value for r in tri.of_entities(facts, targets).collect()] == ["a"]


def test_export_tells_literals_of_a_property_and_labels_of_a_node_apart(spark):
    rows = [("Q1", "wd:Q1", "wdt:P4", "literal", "x", "en"), ("Q1", "wd:Q1", "wdt:P4", "literal", "y", "de"), ("Q1", "wd:Q1", "wdt:P5", "literal", "z", "en"), ("Q1", "wd:Q1", "wdt:P5", "literal", "w", "fr"), ("Q1", "wd:Q1", "wdt:P5", "other", "v", None),
            ("Q1", "wd:Q1", "wdt:P5", "iri", "wdt:P4", None), ("Q1", "wd:Q1", "wdt:P5", "iri", "wd:Q2", None), ("Q1", "wd:Q1", "wdt:P5", "iri", "wd:Q3", None), ("Q1", "wd:Q2", "label", "literal", "two", "en"), ("Q1", "wd:Q2", "label", "literal", "zwei", None),
            ("Q2", "wd:Q2", "label", "literal", "another graph", "de"), ("Q1", "wd:Q2", "wdt:P4", "literal", "not its own", None)]
    targets = spark.createDataFrame([(2, "A", "B", "Q1")], "line long, botanic string, common string, qid string")
    got = sorted((r.property_id, r.value) for r in tri.export(targets, graph(spark, rows), config(spark)).collect())
    assert got == [("P4", "y"), ("P5", "wdt:P4"), ("P5", "z"), ("P5", "zwei")]
