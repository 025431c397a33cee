import corpus_pipeline as pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_ngram_join import grams
from tests.llm.test_suffix_dedup import brute as repeats

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def components(rows, k, per_100):
    sets = {i: grams(t, k) for i, t in rows}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= per_100 * (len(sets[a]) + len(sets[b]) - n):
                low, high = sorted((comp[a], comp[b]))
                comp = {i: low if c == high else c for i, c in comp.items()}
    return {i for i, c in comp.items() if i == c}


def test_each_stage_against_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.columns[:5] == COLUMNS or sorted(out.columns) == sorted(COLUMNS), name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            gone = set(rows) - set(got)
            assert len(gone & toxic) >= 0.8 * len(toxic) and len(gone - toxic) <= 0.05 * len(rows)
        elif name == "ngram_join":
            assert set(got) == components(list(rows.items()), 5, 80)
        elif name == "suffix_dedup":
            want = repeats(list(rows.items()), 50)
            assert set(got) >= {i for i, (spans, kept) in want.items() if len(kept) > 3}
            for i, r in got.items():
                spans, kept = want[i]
                assert 0 <= len(r.text.encode()) - len(kept) <= 6 * len(spans) and r.n_chars == len(r.text)
                assert "�" not in r.text
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            short = {i: t for i, t in rows.items() if len(t) < 5000}
            assert set(got) & set(short) == set(short) - {d for d, _ in leaks(list(short.items()), items)}
        else:
            assert set(got) == set(rows) and all(r.round_trip and r.n_ids == len(r.ids) for r in got.values())
        rows = {i: r.text for i, r in got.items()}


def test_odd_documents(spark):
    odd = [(None, "a b c d e f", "en", "s", 11), (1, None, None, None, None), (2, "", "en", None, 0), (3, "w " * 3000, "en", "s", 6000), (4, "w " * 3000, "en", "s", 6000), (4, "w " * 3000, "en", "s", 6000), (5, " \n", "en", "s", 2)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS severity", "2 AS kept", "3 AS comp", "4 AS row")
    for _, stage in pipeline.STAGES:
        out = pipeline.stored(stage(spark, docs, SF))
        assert pipeline.stored(stage(spark, docs.filter("false"), SF)).count() == 0
        docs = out
    assert sorted((r.doc_id or -1) for r in docs.collect()) == [-1, 1, 2, 3, 5]


def test_texts_that_share_an_id(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(30))
    rows = [(5, text("a")), (5, text("b")), (1, text("c")), (6, text("c")), (6, text("d")), (7, text("e")), (7, text("f")), (8, text("f") + " more"), (8, text("g")), (9, text("h")), (9, text("h")), (9, text("h") + " x"), (10, ""), (10, None), (10, text("i")), (11, ""), (None, text("a"))]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long").repartition(3, "n")
    out = pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or 0, (r.text or "")[:1]) for r in out.collect()))
    assert got == [(0, "a"), (1, "c"), (5, "a"), (5, "b"), (6, "d"), (7, "e"), (7, "f"), (8, "g"), (9, "h"), (10, ""), (10, "i"), (11, "")]


def test_spans_of_one_text_do_not_cut_another_of_its_id(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(1, text("a")), (2, text("b") + " " + text("a")), (2, text("c") + " " + text("d")), (None, text("a")), (3, text("e"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.drop_repeats(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text.strip()) for r in out.collect())
    assert got == sorted([(0, text("a")), (1, text("a")), (2, text("b")), (2, text("c") + " " + text("d")), (3, text("e"))])


def test_columns_of_any_name(spark):
    rows = [(i, f"some clean text of number {i} that nothing else has", {"k": i}, i) for i in (1, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` map<string, int>, `row` int")
    for name, stage in pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {(r.doc_id, r["a.b"]["k"], r["row"]) for r in out.collect()} <= {(1, 1, 1), (2, 2, 2)}, name
