import random
import re
from collections import Counter

import numpy as np
import pytest

from grove.llm import decontaminate


def cut(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def brute(docs, items, k=5):
    """Best (similarity, first word) of each pair by sliding a window of the item's length over every document."""
    out = {}
    for d, text in docs:
        w = cut(text)
        for i, item in items:
            v = cut(item)
            n = min(k, len(v))
            if not v:
                continue
            want = Counter(tuple(v[x : x + n]) for x in range(len(v) - n + 1))
            for s in range(len(w) - len(v) + 1):
                win = w[s : s + len(v)]
                seen = Counter(tuple(win[x : x + n]) for x in range(len(v) - n + 1))
                shared = sum((want & seen).values())
                total = sum((want | seen).values())
                if 100 * shared >= 80 * total and (shared / total, -s) > out.get((d, i), (0, 0)):
                    out[d, i] = (shared / total, -s)
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice([3, 8, 15, 30, 60]))) for i in range(25)]
    docs = []
    for d in range(400):
        w = text(rng.randint(0, 120))
        for _ in range(rng.choice([1, 1, 2])):
            leak = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 0, 1])):
                leak[rng.randrange(len(leak))] = rng.choice(vocabulary)
            at = rng.randint(0, len(w))
            w[at:at] = leak
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    items = [(i, " ".join(w).title()) for i, w in items] + [(90, None), (91, ""), (92, "?!")]
    return docs + [(500, None), (501, ""), (502, "...")], items


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    docs, items = corpus(seed)
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): (pytest.approx(r.similarity), -r.first_word) for r in got} == want
    assert len(got) == len(want) > 30


def test_several_blocks_and_dropping(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_ITEM_CHARS", 500)
    docs, items = corpus(9)
    d, i = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    want = {x for x, _ in brute(docs, items)}
    assert {r.doc_id for r in decontaminate.find_leaks(d, i).collect()} == want
    kept = decontaminate.drop_leaks(d, i)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {x for x, _ in docs} - want


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 300).astype(np.uint64)
    asked = prints.copy()
    for b in range(24):
        asked ^= np.where(rng.random(300) < 0.8, np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64), np.uint64(0))
    row, item, distance = decontaminate.HammingIndex(prints, 20).find(asked)
    near = np.bitwise_count(asked[:, None] ^ prints[None, :])
    assert set(zip(row.tolist(), item.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near <= 20))))


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], "item_id long, text string")
    assert decontaminate.find_leaks(none, items).count() == 0
    docs = spark.createDataFrame([(None, "x a b c d e f"), (3, "A, b. C d e f!"), (3, "A, b. C d e f!")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id, r.first_word) for r in decontaminate.find_leaks(docs, items).collect()) == [(0, 1, 1), (3, 1, 0), (3, 1, 0)]
    assert decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_query_on_sf(spark):
    from grove.llm.queries import op1_decontamination

    sf = "/root/testdata/sf0.001"
    take = lambda t, c: [(r[c], r.text) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    docs = [x for x in take("documents", "doc_id") if len(x[1]) < 6000]
    keep = {d for d, _ in docs}
    want = brute(docs, take("benchmark", "item_id"))
    assert {(r.doc_id, r.item_id) for r in op1_decontamination(spark, sf).collect() if r.doc_id in keep} == set(want)


def test_document_shorter_than_the_item(spark):
    item = [f"w{x}" for x in range(40)]
    docs = [(1, " ".join(item[:37])), (2, " ".join(item[3:])), (3, " ".join(item[:33])), (4, " ".join(item[:32])), (5, "w0 w1 w2 w3"), (6, "clean"), (7, "")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item)), (8, "w0 w1 w2 w3 w4")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.similarity) for r in decontaminate.find_leaks(d, i).collect()}
    assert {x: v for x, v in got.items() if x[1] == 9} == {(1, 9): (0, 37, 33 / 36), (2, 9): (0, 37, 33 / 36), (3, 9): (0, 33, 29 / 36)}
    assert {x: v for x, v in got.items() if x[1] == 8} == {(x, 8): (0, 5, 1.0) for x in (1, 3, 4)}
    assert {r.doc_id for r in decontaminate.drop_leaks(d, i).collect()} == {5, 6, 7}


@pytest.mark.parametrize("seed", range(3))
def test_shorter_documents_match_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "d"] if seed == 2 else [f"w{x}" for x in range(200)]  # few words: shingles that repeat
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 9, 12, 20, 40, 90]))] for _ in range(40)]
    for w in base[:20]:  # items that are near copies of others
        w = list(w)
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
        base.append(w + [rng.choice(vocabulary)])
    docs = []
    for x in range(600):
        w = list(rng.choice(base))
        w = w[rng.randint(0, len(w) // 12) : len(w) - rng.randint(0, 1 + len(w) // 10)]
        if w and rng.random() < 0.3:
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((x, w))
    want = {}
    for x, w in docs:
        for y, v in enumerate(base):
            if len(w) < len(v) and len(v) >= 5:
                seen, item = (Counter(tuple(t[s : s + 5]) for s in range(len(t) - 4)) for t in (w, v))
                shared, total = sum((seen & item).values()), sum((seen | item).values())
                if 100 * shared >= 80 * total:
                    want[x, y] = (0, len(w), shared / total)
    frames = spark.createDataFrame([(x, " ".join(w)) for x, w in docs], "doc_id long, text string"), spark.createDataFrame([(y, " ".join(v)) for y, v in enumerate(base)], "item_id long, text string")
    got = decontaminate.find_leaks(*frames).collect()
    assert {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.similarity) for r in got if len(docs[r.doc_id][1]) < len(base[r.item_id])} == want
    assert len(want) > 100


def test_far_fingerprints_at_the_threshold(spark):
    for x in (2627, 9189, 24377):  # of similarity 0.8, and 21 bits apart
        item = [f"i{x}w{y}" for y in range(40)]
        doc = [*item[:36], "other", *item[37:]]
        got = decontaminate.find_leaks(spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string"), spark.createDataFrame([(2, " ".join(item))], "item_id long, text string")).collect()
        assert [(r.similarity, r.distance) for r in got] == [(0.8, 21)]


def test_long_text_that_repeats_an_item():
    """Every window of it is a candidate: they are looked at some at a time, in bounded memory."""
    import pyarrow as pa

    from grove.llm.common import texts

    item = [f"w{x}" for x in range(400)]
    other = " ".join(item).replace("w7 ", "zz ")
    b = decontaminate.Benchmark([1, 2], [" ".join(item), other], 5, 80, 23)
    found = b.leaks(*texts(pa.array([None, " ".join(item[200:] + item * 500), "w1 w2"])))
    assert [(t, i, at, n) for t, i, at, n, _, _ in found] == [(1, 1, 200, 400), (1, 2, 200, 400)]
    assert found[0][4] == 1 and found[1][4] == pytest.approx(391 / 401)


def test_patterned_words_are_no_leak(spark):
    word = lambda n: "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    other = str.maketrans("ab", "ba")
    text = " ".join(f"{word(n)} one {word(n + 7)} two {word(n + 1)}" for n in (1024, 2048, 4096))
    docs = spark.createDataFrame([(1, text.translate(other)), (2, text)], "doc_id long, text string")
    items = spark.createDataFrame([(9, text)], "item_id long, text string")
    assert [(r.doc_id, r.similarity) for r in decontaminate.find_leaks(docs, items).collect()] == [(2, 1.0)]
