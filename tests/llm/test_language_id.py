import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from grove.llm import language_id as lid


def plain_subwords(text):
    """(bytes, count) of the subwords of one text."""
    raw = text.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    framed = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in b" " + raw + b" ")
    out = {}
    for n in (2, 3, 4, 5):
        for i in range(len(framed) - n + 1):
            g = framed[i : i + n]
            if 32 not in g[1:-1] and g.strip(b" "):
                out[g] = out.get(g, 0) + 1
    return out


def bucket(g):
    m = (1 << 64) - 1
    x = (int.from_bytes(g, "little") * 0x9E3779B97F4A7C15 + len(g)) & m
    for _ in range(2):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & m
    return (x ^ (x >> 32)) >> (64 - lid.BITS)


@pytest.mark.parametrize("step", [7, 64, lid.STEP])
def test_subwords_are_those_of_a_plain_loop(step):
    texts = ["", "Ab", "été à la", "x", "  two  words\n", "123 -", "don't STOP", "длинное слово", "z" * 40]
    raw = [t.encode() for t in texts]
    got = [{} for _ in texts]
    for b, t in lid.subwords(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])], step):
        assert (np.diff(t) >= 0).all()
        for x, y in zip(b.tolist(), t.tolist()):
            got[y][x] = got[y].get(x, 0) + 1
    for text, counts in zip(texts, got):
        want = {}
        for g, n in plain_subwords(text).items():
            want[bucket(g)] = want.get(bucket(g), 0) + n
        assert counts == want


@pytest.fixture(scope="module")
def model(spark):
    return lid.train_languages(corpus(spark, range(0, 600)), texts=400)


SOUNDS = {"aa": ["the", "ing", "and", "th", "er"], "bb": ["é", "eau", "oi", "en", "ç"], "cc": ["sch", "ü", "ei", "nd", "ge"]}


def sentence(seed):
    rng = random.Random(seed)
    lang = rng.choice(sorted(SOUNDS))
    return lang, " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([1, 2, 5, 20, 80])))


def corpus(spark, ids):
    return spark.createDataFrame([(i, *sentence(i)) for i in ids], "doc_id long, lang string, text string")


def test_held_out_texts_are_told(spark, model):
    assert model.languages == ["aa", "bb", "cc"] and 0 < model.temperature
    got = lid.predict_languages(corpus(spark, range(1000, 1400)), model).collect()
    right = [r.lang == r.lang_pred for r in got]
    assert np.mean(right) > 0.95
    accepted = [r for r in got if r.accepted]
    assert len(accepted) > 300 and np.mean([r.lang == r.lang_pred for r in accepted]) > 0.97
    assert all(1 / 3 - 1e-9 <= r.score <= 1 for r in got)


def test_scores_are_those_of_a_plain_sum(spark, model):
    rows = [sentence(i)[1] for i in range(2000, 2030)]
    got = lid.predict_languages(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string"), model).collect()
    for r in got:
        total, n = [0] * 3, 0
        for g, c in plain_subwords(r.text).items():
            n += c
            for k in range(3):
                total[k] += c * int(model.table[bucket(g), k])
        e = [math.exp((x / lid.SCALE / n + b) / model.temperature) for x, b in zip(total, model.bias.tolist())]
        best = max(range(3), key=lambda k: (e[k], -k))
        assert r.lang_pred == model.languages[best]
        assert math.isclose(r.score, e[best] / sum(e), rel_tol=1e-9)


def test_odd_texts_and_tables(spark, model):
    long = sentence(7)[1] + " " + " ".join(sentence(i)[1] for i in range(0, 3000) if sentence(i)[0] == sentence(7)[0])
    rows = [(1, None, "x"), (1, "", "x"), (2, "123 -- !", "x"), (3, "→ — 。", "x"), (4, "a", "x"), (5, "語", "x"), (6, long * 10, "x"), (6, long * 10, "x")]
    got = lid.predict_languages(spark.createDataFrame(rows, "doc_id int, text string, lang_pred string").withColumn("a.b", F.lit(1)).withColumn("score", F.lit(None)), model).collect()
    by = [(r.doc_id, r.lang_pred, r.accepted) for r in got]
    assert [r[1] for r in by[:4]] == ["und"] * 4 and all(r.score == 0 and not r.accepted for r in got[:4])
    assert all(r[1] in SOUNDS for r in by[4:]) and got[6] == got[7] and by[6][1] == sentence(7)[0]
    assert lid.predict_languages(spark.createDataFrame([], "text string, n int"), model).count() == 0
    for nothing in (spark.createDataFrame([], "lang string, text string"), spark.createDataFrame([("aa", None), (None, "x"), ("aa", "12")], "lang string, text string")):
        none = lid.train_languages(nothing)
        assert [tuple(r) for r in lid.predict_languages(spark.createDataFrame([("the",)], "text string"), none).collect()] == [("the", "und", 0.0, False)]
    one = lid.train_languages(spark.createDataFrame([("aa", "the thing")] * 3, "lang string, text string"))
    assert [r.lang_pred for r in lid.predict_languages(spark.createDataFrame([("zz",)], "text string"), one).collect()] == ["aa"]
    with pytest.raises(ValueError, match="256 languages"):
        lid.train_languages(spark.range(300).select(F.col("id").cast("string").alias("lang"), F.lit("x").alias("text")))


def test_calibration():
    rng = np.random.default_rng(0)
    label = rng.integers(0, 3, 4000)
    logits = rng.normal(0, 1, (4000, 3))
    logits[np.arange(4000), label] += 2
    t, least = lid.calibrate(logits * 5, label, 0.05)
    assert 2 < t < 3  # the added 2 makes twice a logit the odds
    p = lid.softmax(logits * 5 / t)
    kept = p.max(1) >= least
    assert 0.2 < kept.mean() < 1 and (p.argmax(1) != label)[kept].mean() <= 0.05


def test_query_on_held_out_documents(spark):
    from grove.llm.queries import op12_language_id

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op12_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.98
    assert np.mean([r.accepted for r in held]) >= 0.98
