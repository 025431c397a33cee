import random

import pytest
import sentencepiece

from grove.llm import sentencepiece_codec as codec

ODD = ["", None, " ", "  ", "a", "   x  ", "日本 日本", "▁a ▁▁b", "x" * 300, " " * 100, "é" * 50, " " * 40 + "日", "  \U0001f600  a", "\x00\x00 a\x00", "tab\t\tnew\n\n line ", "a" * 6000]


def random_texts(seed, n):
    rng = random.Random(seed)
    letters = [chr(c) for c in [*range(32, 127), 0, 9, 10, 0xE9, 0x65E5, 0x672C, 0x1F600, 0x2581, 0x416, 0x430]] + [" "] * 20 + list("etaoin") * 10
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)


def test_same_as_library_and_back(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD + random_texts(1, 1500))] * 2
    out = codec.decode(codec.encode(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == library.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ") and r.round_trip


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_long_words_and_texts(spark, library, monkeypatch):
    """Words of one pattern and their complements, words beyond a window, and texts that are encoded in parts."""
    rng = random.Random(8)
    other = str.maketrans("ab", "ba")
    texts = [f"{thue_morse(n)} {thue_morse(n).translate(other)}" for n in (64, 500, 1024, 2048, 4096)]
    texts += ["".join(rng.choice("etaoinshré日") for _ in range(n)) for n in (511, 512, 3000, 70_000)] + ["a" * 70_000]
    texts += ["".join(rng.choice(["the ", "  ", "thing", "é", " a", "▁", "\n"]) for _ in range(700_000))]
    for r in codec.encode(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        assert r.ids == library.encode(r.text) and r.round_trip


def test_a_million_letters_in_seconds():
    import time

    model = codec._model(open(codec.MODEL, "rb").read())
    rng = random.Random(9)
    began = time.time()
    ids, _ = codec.encode_texts(model, codec.np.frombuffer("".join(rng.choice("etaoinshr") for _ in range(1_000_000)).encode(), codec.np.uint8), codec.np.array([0, 1_000_000]))
    assert len(ids) > 100_000 and time.time() - began < 60


def test_words_with_one_hash(library, monkeypatch):
    """Were two words to have one hash, each would still be encoded by its bytes."""
    monkeypatch.setattr(codec, "word_hashes", lambda data, start, size: codec.np.full(len(start), 7, codec.np.uint64))
    model = codec.PieceModel(open(codec.MODEL, "rb").read())
    for text in ("one word and another one", "quite other words"):
        raw = codec.np.frombuffer(text.encode(), codec.np.uint8)
        assert codec.encode_texts(model, raw, codec.np.array([0, len(raw)]))[0].tolist() == library.encode(text)


def test_query_on_sf(spark, library):
    from grove.llm.queries import op9_sentencepiece

    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op9_sentencepiece(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        assert r.ids == library.encode(text[r.doc_id]) and r.n_ids == len(r.ids) and r.round_trip


def test_forgotten_words_and_full_pair_table(library):
    import pyarrow as pa

    from grove.llm.common import texts

    with open(codec.MODEL, "rb") as f:
        model = codec.PieceModel(f.read())
    for seed in range(4):
        if seed == 2:
            model.clear()
        some = random_texts(seed, 400)
        ids, off = codec.encode_texts(model, *texts(pa.array(some)))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == library.encode(some)


def test_odd_tables(spark):
    assert codec.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = codec.encode(spark.createDataFrame([(None, "a b", [9])], "doc_id long, text string, ids array<int>")).collect()
    assert got[0].ids == codec.encode(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first().ids
