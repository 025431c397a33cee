import random

import pytest

from grove.sources import versions as ver


def rows(spark, data):
    return spark.createDataFrame(data, "id long, name string, n int")


def held(spark, path, **more):
    return sorted((tuple(r) for r in ver.read(spark, path, **more).collect()), key=repr)


def test_merges_rewrite_only_what_changes(spark, tmp_path):
    path, rng = str(tmp_path / "t"), random.Random(1)
    want = {i: (i, f"a{i}", i) for i in [None, *range(200)]}
    first = ver.create(rows(spark, list(want.values())), path, ["id"], 16)
    for k in range(3):
        new = [(i, f"b{k}", None) for i in rng.sample(range(260), 3)] + ([(None, "null", k)] if k == 1 else [])
        m, n = ver.merge(rows(spark, new), path)
        want |= {i: r for i, *_, r in [(x[0], x) for x in new]}
        assert (m.version, held(spark, path)) == (k + 1, sorted(want.values(), key=repr)) and 0 < n <= len(new)
        same, n = ver.merge(rows(spark, new), path)
        assert (same.version, n) == (k + 1, 0)
    m, _ = ver.merge(spark.createDataFrame([(5, 77), (999, 78)], "id long, n int"), path, owned=["n"])
    want |= {5: (5, want[5][1], 77), 999: (999, None, 78)}
    assert held(spark, path) == sorted(want.values(), key=repr)
    assert held(spark, path, version=first) == sorted(((i, f"a{i}", i) if i is not None else (None, "aNone", None) for i in [None, *range(200)]), key=repr)
    with pytest.raises(ValueError, match="repeat"):
        ver.merge(rows(spark, [(1, "x", 1), (1, "y", 1)]), path)
    with pytest.raises(ver.ConflictError):
        ver.merge(rows(spark, [(1, "late", 1)]), path, version=first)
    assert held(spark, path) == sorted(want.values(), key=repr)


def test_rewrites_of_a_scope(spark, tmp_path):
    path = str(tmp_path / "t")
    old = [(i % 40, f"a{i % 3}", i) for i in range(300)] + [(None, "a0", 1), (1, None, 2)]
    ver.create(rows(spark, old), path, ["id"], 16)
    ids, names = spark.createDataFrame([(1,), (2,), (None,)], "id long"), spark.createDataFrame([("a0",), ("a1",), ("a1",)], "name string")
    new = [(1, "a0", 1000), (1, "a0", 1000), (90, "new", 1)]
    want = sorted([r for r in old if not (r[0] in (1, 2) and r[1] in ("a0", "a1"))] + new, key=repr)
    m, n = ver.rewrite(rows(spark, new), [ids, names], path)
    assert held(spark, path) == want and m.version == 1 and n <= 3
    m, n = ver.rewrite(rows(spark, [r for r in new if r[0] == 1]), [ids, names], path)
    assert (m.version, n) == (1, 0)
    m, n = ver.rewrite(rows(spark, []), [names], path)
    assert held(spark, path) == sorted((r for r in want if r[1] not in ("a0", "a1")), key=repr) and m.version == 2
    m, n = ver.rewrite(rows(spark, []), [spark.createDataFrame([("a2",), ("new",)], "name string")], path)
    assert held(spark, path) == [(1, None, 2)]
    ver.rewrite(rows(spark, []), [ids], path)
    assert held(spark, path) == []
    ver.merge(rows(spark, [(7, "x", 1)]), path)
    assert held(spark, path) == [(7, "x", 1)]


def test_a_write_that_dies_half_way_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    ver.create(rows(spark, [(1, "a", 1)]), path, ["id"], 4)
    monkeypatch.setattr(ver, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        ver.merge(rows(spark, [(1, "b", 2)]), path)
    assert held(spark, path) == [(1, "a", 1)]
    monkeypatch.undo()
    ver.merge(rows(spark, [(1, "c", 3)]), path)
    assert held(spark, path) == [(1, "c", 3)]


def test_outputs_are_shown_together(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    with pytest.raises(FileNotFoundError):
        ver.latest(spark, path)
    show = lambda: [spark.read.json(ver.output(spark, path, x)).count() for x in ("a", "b")]
    ver.publish({"a": (spark.range(3), "json", []), "b": (spark.range(4), "json", [])}, path)
    assert show() == [3, 4]

    def broken(batches):
        raise RuntimeError("lost")
        yield

    with pytest.raises(Exception, match="lost"):
        ver.publish({"a": (spark.range(5), "json", []), "b": (spark.range(6).mapInArrow(broken, "id long"), "json", [])}, path)
    assert show() == [3, 4]
    ver.publish({"a": (spark.range(7), "json", []), "b": (spark.range(8), "json", [])}, path)
    assert show() == [7, 8]
