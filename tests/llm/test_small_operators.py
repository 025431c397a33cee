"""Sharding, chat formatting, token counts, top-k search and URL filters on small tables, against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from grove.llm import chat_format, queries, sharding, token_counts, topk_search, url_filter
from grove.llm.oracle import ORACLE
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, name):
    assert compare(spark, duck(SF), queries.QUERIES[name](spark, SF), ORACLE[name]) == ""


# sharding


def plain_shards(rows, limit):
    """Splits buckets one by one."""
    h = {k: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16) for k, _ in rows}
    out, stack = {}, [(0, 0, rows)]
    while stack:
        depth, prefix, bucket = stack.pop()
        size = sum(n or 0 for _, n in bucket)
        if size <= limit or len({h[k] for k, _ in bucket}) == 1:
            for k, _ in bucket:
                out[k] = (depth, (1 << depth) + prefix, size)
            continue
        for bit in (0, 1):
            part = [r for r in bucket if (h[r[0]] >> (59 - depth)) & 1 == bit]
            if part:
                stack.append((depth + 1, 2 * prefix + bit, part))
    return out


@pytest.mark.parametrize("round_bits", [12, 3])
def test_shards_split_only_where_needed(spark, round_bits):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 10, 200, 3000])) for i in range(600)] + [(7777, 500)] * 40 + [(None, 5), (None, 5), (9000, None), (9001, 10**6)]
    df = spark.createDataFrame(rows, "key long, bytes long")
    got = sharding.assign_shards(df, "key", F.col("bytes"), 4000, round_bits).collect()
    want = plain_shards(rows, 4000)
    assert len(got) == len(rows)
    assert {r.key: (r.depth, r.shard_id, r.shard_bytes) for r in got} == want
    assert {r.key for r in got if r.oversized} == {7777, 9001}
    assert sharding.assign_shards(df.filter("false"), "key", F.col("bytes"), 4000).count() == 0


def test_shards_are_written(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 50, i) for i in range(200)], "key long, text string, depth long")
    directory = sharding.write_shards(df, "key", F.length("text"), 1000, str(tmp_path / "s"))
    sizes = {r.shard_id: r.shard_bytes for r in directory.collect()}
    back = spark.read.parquet(str(tmp_path / "s")).groupBy("shard_id").agg(F.sum(F.length("text")).alias("b")).collect()
    assert {r.shard_id: r.b for r in back} == sizes and sum(sizes.values()) == 10_000 and max(sizes.values()) <= 1000


def test_written_shards_with_clashing_columns_and_one_hot_key(spark, tmp_path):
    rows = [(None, "n" * 10, 7), ("", "e" * 10, 7)] + [("hot", f"{i:04d}" * 25, 7) for i in range(60)] + [(f"k{i}", "x" * 90, 7) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, text string, shard_id int")
    directory = {r.shard_id: (r.shard_bytes, r.n_rows, r.oversized) for r in sharding.write_shards(df, "key", F.length("text"), 1000, str(tmp_path / "s")).collect()}
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.columns == ["key", "text", "shard_id"] and back.count() == len(rows)
    assert {r.shard_id: (r.b, r.n) for r in back.groupBy("shard_id").agg(F.sum(F.length("text")).alias("b"), F.count("*").alias("n")).collect()} == {k: v[:2] for k, v in directory.items()}
    hot = back.filter("key = 'hot'").first().shard_id
    assert directory[hot][2]


# chat formatting


def test_examples_and_masks(spark):
    odd = "a\\<|b<|end|>\n<|turn|>assistant<|text|>\\"
    rows = [(1, 0, "system", odd), (1, 1, "user", ""), (1, 2, "assistant", odd), (1, 2, "assistant", odd), (1, 3, None, None), (2, 0, "user", "no reply"), (3, None, "assistant", "é\U0001f600"), (None, 1, "assistant", "x"), (4, 5, "assistant<|", "y")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat_format.format_chats(df)
    for e in examples.collect():
        own = [r for r in sorted([r for r in rows if r[0] == e.conv_id], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))][: e.target]
        masked = e.formatted[e.loss_start - 1 : e.loss_start - 1 + e.loss_chars]
        assert e.trained == (own[-1][2] == "assistant")
        assert (masked.replace("\\\\", "\0").replace("\\|", "|").replace("\0", "\\") if e.trained else "") == (own[-1][3] if e.trained else "")
    told = {r.conv_id: r for r in chat_format.digest(examples).collect()}
    assert {k: (r.n_turns, r.n_examples) for k, r in told.items()} == {1: (5, 2), 2: (1, 0), 3: (1, 1), None: (1, 1), 4: (1, 0)}
    want = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:5])
    assert told[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and told[1].loss_sha256 == hashlib.sha256((odd * 2).encode()).hexdigest() and told[1].loss_chars == 2 * len(odd)
    assert chat_format.format_chats(df.filter("false")).count() == 0


# token counts


def test_suffix_sums_answer_every_limit(spark):
    rng = random.Random(5)
    texts = [None, ""] + [" ".join(rng.choice(["tree", "Ähre", "日本", "x1", "\n\n"]) for _ in range(rng.randint(0, 900))) for _ in range(150)]
    lengths = token_counts.encoded_lengths(spark.createDataFrame([(t, 3) for t in texts], "text string, n_tokens int"))
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = sorted(len(enc.encode_ordinary(t or "")) for t in texts)
    assert sorted(r.n_tokens for r in lengths.collect()) == n
    rows = token_counts.suffix_sums(token_counts.length_histogram(lengths), block=16).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(n))
    for r in rows:
        limit = r.n_tokens
        assert (r.n_docs, r.docs_longer, r.docs_fitting) == (n.count(limit), sum(x > limit for x in n), sum(x <= limit for x in n))
        assert (r.tokens_total, r.tokens_longer, r.tokens_truncated) == (sum(n), sum(x for x in n if x > limit), sum(min(x, limit) for x in n))
        assert (r.p50, r.p90, r.p99) == tuple(min(limit, n[math.ceil(q * len(n)) - 1]) for q in (0.5, 0.9, 0.99))
    assert token_counts.suffix_sums(token_counts.length_histogram(lengths.filter("false"))).count() == 0


@pytest.mark.parametrize("text", [" " * 2_000_000 + "a", "a" + "\n" * 1_500_000, "a  " + " " * 20_000 + "\t" * 3 + "b" + " " * 10_000 + "\u3000x", "a" * 3_000_000, " " * 1_000_000])
def test_long_runs_are_counted(spark, text):
    """Runs that the tokenizer itself can't split are counted as it splits shorter ones."""
    got = token_counts.encoded_lengths(spark.createDataFrame([(text,)], "text string")).first().n_tokens
    enc = token_counts._encoding(open(token_counts.VOCABULARY, "rb").read(), token_counts.PATTERN)
    if len(text) < 100_000 or text.startswith("aa"):
        assert got == len(enc.encode_ordinary(text))
    else:
        run = max((len(m) for m in text.split("a")), default=0)  # one piece of white space, and what is left
        piece = text.strip("a")[: run - text.endswith("a")]
        assert got == len(enc._encode_single_piece(piece.encode())) + len(enc.encode_ordinary(text.replace(piece, "", 1)))


def test_cut_runs_count_like_whole_ones(monkeypatch):
    enc = token_counts._encoding(open(token_counts.VOCABULARY, "rb").read(), token_counts.PATTERN)
    import re

    monkeypatch.setattr(token_counts, "LONG_RUN", 3)
    monkeypatch.setattr(token_counts, "_RUN", re.compile(token_counts._RUN.pattern.replace("10000", "3")))
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice([" ", " ", "  ", "\n", "\t", "\u3000", "\x1c", "a", "1", "!", "'s", "é"]) for _ in range(rng.randint(0, 30)))
        assert token_counts._length(enc, text, True) == len(enc.encode_ordinary(text)), repr(text)


def test_token_query_counts_all_documents(spark):
    rows = queries.op6_token_counts(spark, SF).collect()
    assert sum(r.n_docs for r in rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


# top-k search


@pytest.mark.parametrize("kind", ["spread", "grouped", "equal"])
def test_tree_finds_the_best(kind):
    rng = np.random.default_rng(1)
    x = {"spread": rng.integers(-60, 60, (2500, 12)), "grouped": rng.integers(-5, 5, (2500, 12)) + rng.integers(-300, 300, (20, 12))[rng.integers(0, 20, 2500)], "equal": np.tile(rng.integers(-9, 9, (3, 12)), (900, 1))[:2500]}[kind].astype(float)
    ids = rng.permutation(5000)[:2500].astype(np.int64)
    tree = topk_search.MTree(ids, x)
    asked = np.arange(0, 2500, 97)
    row, got_ids, got_s = tree.search(x[asked], ids[asked], 5)
    blurred = topk_search.MTree(ids, x).search(x[asked], ids[asked], 5, (x, x[asked]))  # scores made of whole numbers
    for n, i in enumerate(asked):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:5]
        assert got_ids[row == n].tolist() == ids[order].tolist() and got_s[row == n].tolist() == s[order].tolist()
        assert blurred[1][blurred[0] == n].tolist() == ids[order].tolist()
    if kind == "grouped":
        assert tree.computed < 0.8 * 2500 * 26  # stored distances spare some


def test_many_parts_and_chunks(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-9, 9, (300, 8)) * s for s in (1, 5, 30)] + [np.tile(rng.integers(-9, 9, (1, 8)), (300, 1))]).astype(float) / 256
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = topk_search.search_top_k(df, df.filter("vec_id % 50 = 0"), part_rows=(16, 60), query_rows=7).orderBy("query_id", "rank").collect()
    w = np.floor(x * 256)
    want = []
    for i in range(0, len(x), 50):
        s = w @ w[i]
        want += [(i, n + 1, j, int(s[j])) for n, j in enumerate([j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:5])]
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == want


def test_components_beyond_doubles(spark):
    """Whole numbers that no double product holds are still ranked exactly; scores beyond a long are told as the nearest long."""
    rows = [(0, [2.0**40, 1.0]), (50, [1e300, -1e300]), (1, [2.0**40, 3.0]), (2, [2.0**40, 2.0]), (3, [-(2.0**40), 9.0]), (4, [1e300, 1.0]), (5, [1.7e308, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(c * 256) for c in v] for i, v in rows if i != 5}  # 5 is not finite once scaled
    want = []
    for q in (0, 50):
        score = {i: sum(a * b for a, b in zip(v, whole[q])) for i, v in whole.items() if i != q}
        want += [(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, score[i]))) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5])]
    got = topk_search.search_top_k(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, [1.0, None]), (100, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.25]), (6, [1.0, 0.5]), (6, [1.0, 0.5]), (7, []), (None, [1.0, 1.0]), (150, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.search_top_k(df, df.filter("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect()]
    a, b = 256 * 256 + 128 * 128, 256 * 128 + 128 * 128
    assert got == [(0, 1, 6, a), (0, 2, 6, a), (0, 3, 150, b), (150, 1, 0, b), (150, 2, 6, b), (150, 3, 6, b)]
    assert topk_search.search_top_k(df.filter("false"), df.filter("false")).count() == 0
    assert topk_search.search_top_k(df.filter("vec_id = 0"), df.filter("vec_id = 0")).count() == 0


# url filters

URLS = [
    None, "", "no scheme", "http://", "HTTPS://A.Example.COM/en/7?x", "http://example.com/en/70/x", "http://com/en/", "http://com/en", "http://xcom/en/", "http://b.net/de/8", "http://example.net/de/8#f", "http://example.net?/de/8", "ftp://a.org/es/x://y", "http://a.b.c.org/es", "http://example.com:80/en/7", "http://É.com/en/é", "a://b://c.com/en/",
]


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        h, p = h.lower(), rule[len(h) :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(rule), rule, verdict) > best):
            best = (len(rule), rule, verdict)
    return host, path, best and best[1], best[2] if best else "allow"


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_verdicts(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_TRIE_BYTES", most)
    rng = random.Random(6)
    part = lambda seq, n, sep: sep.join(rng.choice(seq) for _ in range(n))
    rules = [*queries.RULES, *[(rng.choice(["allow", "block"]), part(["a", "b", "com"], rng.randint(1, 3), ".") + rng.choice(["", "/", "/x", "/x/", "/x/y"])) for _ in range(20)]]
    rules += [(v, r) for v in ("block", "allow") for r in ("twice.com/a", "Twice.com/b", "twice.com/b")] + [("block", "a.com/x"), ("allow", "a.com/x")]
    urls = URLS + ["http://twice.com/a1", "http://twice.com/b", "http://a.com/x", "http://com/" + "x/" * 50_000] + [f"http://{part(['a', 'b', 'com'], rng.randint(1, 4), '.')}/{part(['x', 'y', 'xy', ''], rng.randint(0, 3), '/')}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] * 2, "page_id long, url string, verdict string")
    got = url_filter.judge_urls(df, rules).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(urls[r.page_id], rules), urls[r.page_id]
    assert url_filter.judge_urls(df.filter("false"), rules).count() == 0


def test_rule_hosts_are_lowered_like_urls(spark):
    """A-Z only: a letter beyond ASCII stays as it is in rules and urls alike; other columns may have any name."""
    pages = spark.createDataFrame([(1, "http://Éx.com/a", "k", {"m": 1}), (2, "http://éx.com/a", "k", None)], "page_id int, url string, `__url` string, `a.b` map<string, int>")
    got = url_filter.judge_urls(pages, [("block", "ÉX.com/")])
    assert got.columns == ["page_id", "url", "__url", "a.b", "host", "path", "rule", "verdict"]
    assert [(r.page_id, r.host, r.rule, r.verdict) for r in got.orderBy("page_id").collect()] == [(1, "Éx.com", "ÉX.com/", "block"), (2, "éx.com", None, "allow")]


def test_shards_of_rows_with_maps(spark, tmp_path):
    df = spark.range(50).select("id", F.create_map(F.lit("k"), F.col("id")).alias("m"))
    sharding.write_shards(df, "id", F.lit(10), 100, str(tmp_path / "s"))
    assert sorted(r.m["k"] for r in spark.read.parquet(str(tmp_path / "s")).collect()) == list(range(50))
