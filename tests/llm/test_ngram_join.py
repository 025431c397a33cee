import random
import re

import numpy as np
import pytest

from grove.llm import ngram_join


def grams(text, k=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, per_100=85):
    """(size, component, links) of each id by comparing all pairs."""
    sets = {i: grams(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids, links = sorted(sets), dict.fromkeys(sets, 0)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= per_100 * (len(sets[a]) + len(sets[b]) - n):
                u, v = sorted((find(a), find(b)))
                top[v] = u
                links[a] += 1
                links[b] += 1
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


def corpus(seed, n=250, copies=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    text = lambda m: [rng.choice(vocabulary) for _ in range(m)]
    base = [text(rng.choice([3, 5, 12, 30, 80, 200])) for _ in range(8)]
    rows = []
    for i in rng.sample(range(10_000), n):
        w = list(rng.choice(base)) if rng.random() < 0.6 else text(rng.randint(0, 90))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    rows += [(20_000 + i, " ".join(base[-1])) for i in range(copies)]
    return rows + [(30_000, None), (30_001, ""), (30_002, " \t\n"), (30_003, "one two"), (30_004, "ONE  two"), (30_005, "one")]


@pytest.mark.parametrize("seed", range(2))
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    got = ngram_join.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == want


def test_large_group_is_split(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SUB", 8)
    rows = corpus(7, n=160, copies=5)
    got = ngram_join.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == brute(rows)


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**52, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(5, 250), replace=False), rng.integers(0, 2**52, rng.integers(0, 40)).astype(np.uint64)])) for _ in range(150)]
    sets += [np.sort(np.delete(s, rng.integers(0, len(s), 2))) for s in sets if len(s) > 30]
    tree = ngram_join.SignatureTree(sets, 1024)
    found = {tuple(sorted((int(i), int(j)))) for a, b in ngram_join.tree_join(tree, tree, 85) for i, j in zip(a, b)}
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                assert (i, j) in found


def test_odd_tables(spark):
    assert ngram_join.join_ngrams(spark.createDataFrame([], "doc_id long, text string, comp int")).count() == 0
    rows = [(1, "a b c d e", 0), (1, "a b c d e", 0), (None, "a b c d e", 1), (2, "A b c d\ne", 2)]
    got = ngram_join.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == [(0, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_query_on_sf(spark):
    from grove.llm.queries import op4_ngram_join

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in op4_ngram_join(spark, sf).collect()} == brute(rows)


def test_words_of_one_pattern_are_not_alike(spark):
    """Thue-Morse words and their complements: sums of powers modulo 2 ** 64 can't tell them apart."""
    word = lambda n: "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    other = str.maketrans("ab", "ba")
    rows = [(2 * i + j, word(n).translate(other) if j else word(n)) for i, n in enumerate((1024, 2048, 4096)) for j in (0, 1)] + [(9, word(1024))]
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, 1), 9: (0, 1), **{i: (i, 0) for i in range(1, 6)}}


def test_chains_of_parts_are_chains_of_all():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        gram, size, ids = rng.integers(0, 4, n).astype(np.uint64), rng.integers(1, 300, n), rng.permutation(1000)[:n]
        part = rng.integers(0, 4, n)
        edges, tops = [], []
        for p in range(4):
            x = part == p
            held, a, b = ngram_join.chain(gram[x], size[x], size[x], ids[x], 85)
            edges += list(zip(a.tolist(), b.tolist()))
            tops.append(held)
        _, a, b = ngram_join.chain(*(np.concatenate(v) for v in zip(*tops)), 85)
        edges += list(zip(a.tolist(), b.tolist()))
        want = []
        for g in range(4):
            own = sorted((s, i) for s, i in zip(size[gram == g].tolist(), ids[gram == g].tolist()))
            want += [(x[1], y[1]) for x, y in zip(own, own[1:]) if x[0] * 100 >= 85 * y[0]]

        def groups(pairs):
            top = {i: i for i in ids.tolist()}
            find = lambda i: i if top[i] == i else find(top[i])
            for x, y in pairs:
                x, y = find(x), find(y)
                top[max(x, y)] = min(x, y)
            return {i: find(i) for i in top}

        assert groups(edges) == groups(want)
