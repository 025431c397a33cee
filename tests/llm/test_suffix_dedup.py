import hashlib
import random

import numpy as np
import pytest

from grove.llm import suffix_dedup
from grove.llm.suffix_sort import equal_runs, sort_suffixes


def brute(rows, length):
    """Spans and kept bytes by a set of all windows."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(i, least.get(w, i))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans, p = [], 0
        while p < len(b):
            q = p
            while q < len(b) and gone[q] == gone[p]:
                q += 1
            if gone[p]:
                spans.append((p, q))
            p = q
        out[i] = (spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abcd"])
def test_suffix_order(letters):
    rng = np.random.default_rng(len(letters))
    text = rng.choice(np.frombuffer(letters, np.uint8), 3000)
    pos = rng.permutation(2900)[:1500]
    raw = text.tobytes() + bytes(200)
    order = sort_suffixes(text, pos, 50)
    keys = [raw[p : p + 50] for p in pos[order]]
    assert keys == sorted(keys)
    order, same = equal_runs(text, pos, 50)
    keys = [raw[p : p + 50] for p in pos[order]]
    assert [a != b for a, b in zip(keys, keys[1:])] == list(np.diff(same) > 0)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), 60):
        rows.append((i, "".join(rng.choice([text(rng.randint(1, 30)), rng.choice(shared), rng.choice(shared)[: rng.randint(20, 80)]]) for _ in range(rng.randint(0, 5)))))
    rows += [(2000, None), (2001, ""), (2002, "x" * 400), (2003, "x" * 130), (2004, rows[3][1]), (2005, rows[3][1]), (2006, "short")]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=50).collect()
    want = brute(rows, 50)
    assert len(got) == len(rows)
    for r in got:
        assert ([(s.start, s.end) for s in r.spans], bytes(r.kept)) == want[r.doc_id], r.doc_id


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, spans int")
    assert suffix_dedup.remove_repeats(empty).count() == 0
    long = "word" * 40
    rows = [(None, long, 1), (None, long, 2), (5, long, 3), (5, long, 3), (9, long, 4)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()
    assert sorted((r.doc_id or -1, len(r.kept)) for r in got) == [(-1, 160), (-1, 160), (5, 160), (5, 160), (9, 0)]


def test_query_on_sf(spark):
    from grove.llm.queries import op8_suffix_dedup

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows, 50)
    for r in op8_suffix_dedup(spark, sf).collect():
        spans, kept = want[r.doc_id]
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared, other = text(30), text(30)
    rows = [(1, shared), (2, other), (7, text(9) + shared), (7, text(20) + other + text(3)), (7, shared + text(4)), (9, text(5) + shared + other)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    least = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            least[t[p : p + 50]] = min(i, least.get(t[p : p + 50], i))
    want = []
    for i, t in rows:
        gone = [any(least[t[p : p + 50]] < i for p in range(max(0, x - 49), min(x, len(t) - 50) + 1)) for x in range(len(t))]
        want.append((i, "".join(c for c, g in zip(t, gone) if not g)))
    assert sorted((r.doc_id, bytes(r.kept).decode()) for r in got) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_hot_anchors_are_split_without_a_loss(spark, seed, monkeypatch):
    rng = random.Random(seed)
    line = "all of this stands in every text, as a line that many share"
    text = lambda n: " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(rng.randint(0, 12)) + line[rng.randint(0, 9) : rng.randint(40, len(line))] + text(rng.randint(0, 12))) for i in rng.sample(range(500), 90)]
    import pyarrow as pa
    import pyarrow.compute as pc

    def join(often):  # the steps by themselves, so that the bound of chunks can be set
        monkeypatch.setattr(suffix_dedup, "HOT_CHUNKS", often)
        chunk = lambda c: pa.table({"__id": pa.array([r[0] for r in rows if r[0] % 6 == c]), "__text": [r[1] for r in rows if r[0] % 6 == c], "__chunk": pa.array([c] * sum(r[0] % 6 == c for r in rows), pa.int32())})
        tables = [chunk(c) for c in range(6)]
        named = pa.concat_tables([suffix_dedup._names(t, 50, 3) for t in tables])
        by = lambda t, c, v: t.filter(pc.equal(t.column(c), v))
        told = pa.concat_tables([suffix_dedup._repeated(by(named, "bucket", b)) for b in range(3)])
        sent = pa.concat_tables([suffix_dedup._send(t, by(told, "chunk", c), 50, 3) for c, t in enumerate(tables)])
        spans = pa.concat_tables([suffix_dedup._resolve(by(sent, "bucket", b), 50) for b in range(3)])
        schema = pa.schema([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        out = {}
        for c, t in enumerate(tables):
            cut = suffix_dedup._cut(t, by(spans, "chunk", c), ["__id"], schema, False)
            out |= {i: ([(x["start"], x["end"]) for x in s], k) for i, s, k in zip(cut.column("__id").to_pylist(), cut.column("spans").to_pylist(), cut.column("kept").to_pylist())}
        return out, told

    want = brute(rows, 50)
    for often in (2, 3, 100):
        got, told = join(often)
        assert got == want
        assert any(len(h) for h in told.column("hot").to_pylist()) == (often < 100)


def test_columns_of_any_name_and_long_strings(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3_000)) * 2
    df = spark.createDataFrame([(1, text, 5, {"a": 1}), (2, text, 6, None), (3, "x" + text, 7, None)], "doc_id long, text string, `__id` int, `a.b` map<string, int>").selectExpr("*", "doc_id as __text", "1 as __chunk")
    got = suffix_dedup.remove_repeats(df, length=1000)
    with pytest.raises(ValueError, match="length"):
        suffix_dedup.remove_repeats(df, length=1001)
    assert got.columns == ["doc_id", "text", "__id", "a.b", "__text", "__chunk", "spans", "kept"]
    assert [(r.doc_id, r["__id"], r["a.b"], r["__text"], len(r.kept)) for r in got.orderBy("doc_id").collect()] == [(1, 5, {"a": 1}, 1, 6_000), (2, 6, None, 2, 0), (3, 7, None, 3, 1)]
