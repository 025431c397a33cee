import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from grove.llm import merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def tree(nodes):
    """All levels of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 16
        out.append((level[first:i], level[i + 1 : first + 16]))
        i //= 16
    return out


def brute(rows):
    """rows: (key, group, leaf, tampered)."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: tree([r[2] for r in groups[g]]) for g in order}
    outer = tree([inner[g][-1][0] for g in order])
    root, out = outer[-1][0], []
    for x, g in enumerate(order):
        for i, (key, _, leaf, tampered) in enumerate(groups[g]):
            path = siblings(inner[g], i) + siblings(outer, x)
            digest = tampered or leaf
            for before, after in path:
                digest = h("".join(before) + digest + "".join(after))
            out.append((key, leaf, inner[g][-1][0], root, h("".join("".join(b + a) for b, a in path)), digest, digest == root))
    return out


def told(spark, rows):
    df = spark.createDataFrame(rows, "id long, place string, digest string, tampered string, `group` int, `a.b` int")
    got = merkle.manifest(df, "id", "place", F.col("digest"), F.col("tampered"))
    assert got.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def check(spark, rows):
    assert told(spark, [(*r, 1, 2) for r in rows]) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("sizes", [[1], [1, 1, 1], [16, 17, 1], [2] * 40, [5000, 3, 300]])
def test_matches_a_plain_tree(spark, sizes):
    rng = random.Random(len(sizes))
    names = [None, "", "é", "z", "Z", "a.b"] + [f"g{i}" for i in range(100)]
    rows, key = [], 0
    for size, name in zip(sizes, names):
        for _ in range(size):
            key += rng.randint(1, 3)
            rows.append((key, name, h(str(key)), h(f"not {key}") if rng.random() < 0.2 else None))
    rng.shuffle(rows)
    check(spark, rows)


def test_null_and_repeated_keys(spark):
    rows = [(None, "a", h("0"), None), (None, "a", h("1"), None), (7, "a", h("7"), None), (7, "a", h("7"), None), (7, "a", h("8"), h("9")), (7, None, h("7"), None), (-3, None, h("x"), h("x"))]
    check(spark, rows)
    got = told(spark, [(*r, 1, 2) for r in rows])
    assert [r[0] for r in got if not r[-1]] == [7]  # tampering that changes nothing is not found


def test_empty_table(spark):
    assert told(spark, []) == []


def test_rows_read_one_way_only(spark):
    rows = [("1:2", None, 3), ("1", "2", 3), (None, "-", 3), ("-", None, 3), ("", None, 3), (None, None, 3), ("é" * 20_000, "A", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string, c int").select(merkle.row_digest(F.col("a"), F.col("b"), F.col("c"))).collect()]
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert got == [h("".join(map(field, r))) for r in rows]
    assert len(set(got)) == len(rows)


def test_query_tells_the_tampered_documents(spark):
    import zlib

    from grove.llm.queries import op11_merkle_manifest

    sf = "/root/testdata/sf0.001"
    lowered = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in r.text or "")}
    got = op11_merkle_manifest(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {r.doc_id for r in got if not r.verified} == lowered
