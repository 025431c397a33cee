import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from grove.llm import divergence


def brute(rows, least=10, top=10):
    """rows: (lang, source, text)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    count, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        sources[lang].add(source)
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, own in sources.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v = len(kept)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts[k] for k in kept) + 2 * v) for t in kept}
        differ = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: share(count[lang, s]) for s in own}
        q = share(sum((count[lang, s] for s in own), Counter()))
        for s in own:
            pairs = [(sum(differ(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(differ(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def told(spark, rows, **more):
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "lang string, source string, text string, cell int, `a.b` int")
    got = divergence.audit_sources(df, **more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in got.collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÉé漢Z") for _ in range(rng.randint(1, 3))) for _ in range(50)]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "fr", None])
        source = rng.choice(["s1", "s1", "s1", "S2", "é", None, ""])
        favour = words[: 10 + 7 * len(source or "")]
        rows.append((lang, source, rng.choice([" ", "-", "\n1"]).join(rng.choice(favour if rng.random() < 0.6 else words) for _ in range(rng.randint(0, 12)))))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_matches_plain_sums(spark, seed):
    rows = corpus(seed, 150) + [("en", "quiet", ""), ("en", "quiet", None), ("lone", "s1", "one source only"), ("de", "a", "rare"), ("de", "b", None)]
    assert told(spark, rows) == brute(rows)


def test_other_bounds_repeats_and_empty_table(spark):
    rows = corpus(9, 40) * 3 + [("en", "s1", None)] * 4
    assert told(spark, rows, least=4, top=2) == brute(rows, 4, 2)
    assert told(spark, []) == []


def test_long_texts_and_terms(spark):
    rows = [("en", "a", "x" * 200_000 + " y" * 50_000)] * 10 + [("en", "b", "é y " * 100_000)] * 2
    assert told(spark, rows, least=2) == brute(rows, 2)


def test_counts_beyond_64_bits_and_merging():
    """10**9 * count is beyond a long; what is counted in slices adds up."""
    shard = pa.table({"lang": ["en"] * 3, "source": ["a", "a", "b"], "term": ["x", "y", "x"], "n": [10**13, 5, 7]})
    sizes = pa.table({"lang": ["en"] * 3, "source": ["a", "b", "c"], "total": [10**13 + 5, 7, 0], "v": [2, 2, 2], "lang_total": [10**13 + 12] * 3})
    p = {s: [1 + 10**9 * (n + 2) // (t + 4) for n in c] for s, c, t in (("a", (10**13, 5), 10**13 + 5), ("b", (7, 0), 7), ("c", (0, 0), 0))}
    want = {(s, o): sum((x - y) ** 2 // (x + y) for x, y in zip(p[s], p[o])) for s in p for o in p if s < o}
    got = divergence.compare_sources(shard, sizes, 10).to_pylist()
    assert {(r["source"], r["item"]): r["value"] for r in got if r["part"] == "pair"} == want


def test_a_task_adds_up_what_it_counts(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 60)
    rows = corpus(4, 120)
    batches = pa.table(dict(zip(("lang", "source", "text"), (list(c) for c in zip(*rows))))).to_batches(17)
    want = Counter()
    for lang, source, text in rows:
        want.update((lang or "", source or "", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))
    for flush in (1 << 20, 5):
        monkeypatch.setattr(divergence, "FLUSH_ROWS", flush)
        got = Counter()
        for b in divergence.count_terms(iter(batches)):
            for r in b.to_pylist():
                got[r["lang"], r["source"], r["term"]] += r["n"]
        assert got == want
