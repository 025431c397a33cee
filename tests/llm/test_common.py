import numpy as np
from pyspark.sql import functions as F

from grove.llm import common


def test_spread_undoes_the_hash_by_which_rows_are_dealt(spark):
    rows = spark.range(5000).select(F.col("id").cast("int").alias("i"), common.spread(F.col("id")).alias("x")).select("i", "x", F.hash("x").alias("h")).collect()
    assert all(r.h == r.i for r in rows)
    assert np.array_equal(common.spread(np.arange(5000)), [r.x for r in rows])
    dealt = spark.range(64).select(common.spread(F.col("id")).alias("x")).repartition(64, "x").groupBy(F.spark_partition_id()).count().collect()
    assert [r["count"] for r in dealt] == [1] * 64


def thue_morse(n):
    return bytes(97 + bin(i).count("1") % 2 for i in range(n))


def test_words_of_one_pattern_have_different_hashes():
    """Thue-Morse words and their complements have equal sums of powers modulo 2 ** 64 for every odd base."""
    for n in (64, 128, 1024, 2048, 4096):
        a = thue_morse(n)
        data = np.frombuffer(a + b" " + a.translate(bytes.maketrans(b"ab", b"ba")) + b" " + a, np.uint8)
        h, start, end, _ = common.words(data, np.array([0, len(data)]))
        assert len(h) == 3 and h[0] == h[2] != h[1]


def test_hashes_tell_words_apart():
    rng = np.random.default_rng(0)
    words = sorted({bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in rng.integers(1, 140, 4000)})
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    h = common.word_hashes(data, start, size)
    assert len(np.unique(h)) == len(words)
    other = np.roll(np.arange(len(words)), 1)
    same = common.equal_bytes(data, start, data, start[other], size)
    assert list(same) == [words[i] == words[j][: len(words[i])] if len(words[j]) >= len(words[i]) else data[start[j] : start[j] + size[i]].tobytes() == words[i] for i, j in enumerate(other)]
    assert common.equal_bytes(data, start, data.copy(), start, size).all()
