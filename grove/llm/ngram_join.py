"""N-gram Jaccard join: documents whose sets of word n-grams are alike, exactly, by signature trees.

  1. Texts are dealt into chunks once. Each chunk names the n-grams of its distinct sets (of equal sets anywhere only the one of the least
     id takes part), and learns in how many sets each of them stands.
  2. With its n-grams ordered from rare to frequent, a set of n can only reach the threshold t with a set that shares one of its
     first n - ceil(t * n) + 1. Those of them that stand elsewhere are posted: a chunk chains its own sets of an n-gram by size, and
     posts each chain once, by its range of sizes and least id, so that an n-gram of however many sets makes few postings a chunk.
     Postings of an n-gram are chained in turn, which gives groups outside which no pair can be alike.
  3. Each group is joined by signature trees: nodes hold the OR of their members' bitmaps and their range of sizes; pairs of
     nodes whose greatest possible overlap is too small are left out, pairs of leaves are settled by the sets themselves. What travels are
     the sets, 8 bytes an n-gram. Groups share tasks by bytes; large ones are dealt into sub-blocks, joined two by two in tasks of their own.
No pair is capped or sampled. Links are counted where they are found; of a task's links only a spanning forest travels on, to the components.
N-grams are compared by 64-bit hashes: of n different ones in two documents any two do with odds of n * n / 2**65, 1 in 4 * 10**11 for 10,000.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc  # not part of pyarrow until it is imported
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, forget, mix, pieces, shingles, spread, stored, texts, width, words
from .components import components
from .suffix_dedup import sizes as chunk_sizes
from .suffix_dedup import split_key

SLICE = 4096  # texts whose n-grams are made at once
LEAF, FAN = 32, 8
SUB = 96  # members of a sub-block of a large group, which has 32 sub-blocks or, if these held more bytes of sets, sub-blocks of BLOCK_BYTES
BLOCK_BYTES = 16 << 20
SIDE = 31  # bits of a sub-block's number in the number of a pair
TASK_BYTES = 4 << 20  # of sets of small groups that share a task


def sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text, laid end to end, and where each text's begin. A text under k words is one n-gram."""
    out, count = [], []
    for x in range(0, len(off) - 1, SLICE):
        o = off[x : x + SLICE + 1]
        h, _, _, first = words(data[o[0] : o[-1]], o - o[0])
        gram, owner, _ = shingles(h, first, k)
        by = np.argsort(owner, kind="stable")
        gram, owner = gram[by], owner[by]
        edge = np.searchsorted(owner, np.arange(len(o)))
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            gram[i:j].sort()
        if len(gram):
            new = np.r_[True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])]
            gram, owner = gram[new], owner[new]
        out.append(gram)
        count.append(np.bincount(owner, minlength=len(o) - 1))
    grams = np.concatenate(out) if out else np.zeros(0, U64)
    return grams, np.r_[0, np.cumsum(np.concatenate(count))] if count else np.zeros(1, np.int64)


def digests(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set that together name it; 0 for the empty set."""
    out = np.zeros((2, len(first) - 1), U64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[0, some] = np.add.reduceat(mix(grams), first[:-1][some])
        out[1, some] = np.add.reduceat(mix(grams ^ U64(0x5851F42D4C957F2D)), first[:-1][some])
    return out.view(np.int64)


def describe_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (size of the set), d1, d2 (its digest) of each row of (doc_id, text)."""

    def run(batches):
        for b, data, off in pieces(batches, "text"):
            grams, first = sets(data, off, k)
            d = digests(grams, first)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first)), pa.array(d[0]), pa.array(d[1])], names=["doc_id", "n", "d1", "d2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long")


def pack_sets(docs: DataFrame, k: int) -> DataFrame:
    """The rows of docs with the set of `text` as binary `grams` (8 bytes each) in its place."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        for b, data, off in pieces(batches, "text"):
            grams, first = sets(data, off, k)
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(np.ascontiguousarray(first * 8, np.int64)), pa.py_buffer(grams)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), held.cast(pa.binary())], names=[*names, "grams"])

    return docs.select(*names, "text").mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), T.StructField("grams", T.BinaryType())]))


def _chunk(t: pa.Table, answers: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sets and their beginnings of a chunk's documents whose ids stand for a distinct set."""
    ids = t.column("doc_id").to_numpy().astype(np.int64)
    reps = answers.column("reps").combine_chunks().flatten().to_numpy()
    rows = np.flatnonzero(np.isin(ids, reps))
    data, off = texts(t.column("text").take(pa.array(rows)))
    grams, first = sets(data, off, k)
    ids = ids[rows]
    keep = np.flatnonzero(np.diff(first))
    keep = keep[np.lexsort((*digests(grams, first)[:, keep], ids[keep]))]  # the same order whenever the chunk is read
    n = np.diff(first)[keep]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[keep], n)
    return ids[keep], grams[at], np.r_[0, np.cumsum(n)]


NAMES = "bucket int, chunk int, keys binary, counts binary"


def _names(t: pa.Table, reps: pa.Table, k: int, buckets: int) -> pa.Table:
    """Step 1 of a chunk: its n-grams and in how many of its distinct sets they stand (255 for more)."""
    if not t.num_rows or not reps.num_rows:
        return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
    _, grams, _ = _chunk(t, reps, k)
    gram, count = np.unique(grams, return_counts=True)
    b, low = split_key(mix(gram), buckets)
    by = np.argsort(b, kind="stable")
    low, count = low[by], np.minimum(count[by], 255).astype(np.uint8)
    cut = np.searchsorted(b[by], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cut))
    chunk = t.column("chunk")[0].as_py()
    press = zstandard.ZstdCompressor(level=1)
    return pa.table({"bucket": pa.array(used.astype(np.int32)), "chunk": pa.array(np.full(len(used), chunk, np.int32)),
                     "keys": pa.array([low[cut[x] : cut[x + 1]].tobytes() for x in used], pa.binary()),
                     "counts": pa.array([press.compress(count[cut[x] : cut[x + 1]].tobytes()) for x in used], pa.binary())})


def _frequent(t: pa.Table) -> pa.Table:
    """Step 1 of a bucket: tells each chunk which of its n-grams stand in several sets, and a grade of how many."""
    expand = zstandard.ZstdDecompressor()
    keys = [np.frombuffer(x, np.uint32) for x in t.column("keys").to_pylist()]
    counts = [np.frombuffer(expand.decompress(x), np.uint8) for x in t.column("counts").to_pylist()]
    value, which = np.unique(np.concatenate(keys), return_inverse=True)
    df = np.bincount(which, np.concatenate(counts).astype(np.float64))
    grade = np.minimum(np.floor(np.log2(np.maximum(df, 1)) * 8), 255).astype(np.uint8)
    edge = np.cumsum([0, *map(len, keys)])
    out_k, out_g = [], []
    for x, key in enumerate(keys):
        w = which[edge[x] : edge[x + 1]]
        on = df[w] > 1
        out_k.append(key[on])
        out_g.append(grade[w[on]])
    some = [x for x in range(len(keys)) if len(out_k[x])]
    chunk, bucket = t.column("chunk").to_pylist(), t.column("bucket").to_pylist()
    press = zstandard.ZstdCompressor(level=1)
    return pa.table({"chunk": pa.array([chunk[x] for x in some], pa.int32()), "bucket": pa.array([bucket[x] for x in some], pa.int32()),
                     "keys": pa.array([out_k[x].tobytes() for x in some], pa.binary()), "grades": pa.array([press.compress(out_g[x].tobytes()) for x in some], pa.binary())})


POSTINGS = "bucket int, gram binary, least binary, low binary, high binary, a binary, b binary"


def chain(gram: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, per_100: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """Chains of the ranges low..high of sizes of each n-gram, where neighbours in size may be alike.

    Returns the chains as (gram, low, high, least id), and the edges from each chain's least id to the other ids: only those that
    join two trees, when all n-grams' edges are taken together.
    """
    by = np.lexsort((least, low, gram))
    gram, low, high, least = gram[by], low[by], high[by], least[by]
    if not len(gram):
        return (gram, low, high, least), least, least
    # the greatest size so far of each n-gram: its rank keeps n-grams apart
    rank = np.cumsum(np.r_[True, gram[1:] != gram[:-1]])
    top = np.maximum.accumulate(rank * (np.int64(1) << 40) + high) & ((1 << 40) - 1)
    begin = np.flatnonzero(np.r_[True, (rank[1:] != rank[:-1]) | (top[:-1] * 100 < per_100 * low[1:])])
    size = np.diff(np.r_[begin, len(gram)])
    first = np.minimum.reduceat(least, begin)
    pair = np.unique(np.stack([np.repeat(first, size), least], 1)[np.repeat(first, size) != least], axis=0)
    pair = pair[forest(*(np.unique(pair, return_inverse=True)[1].reshape(-1, 2).T.tolist()))]
    return (gram[begin], low[begin], np.maximum.reduceat(high, begin), first), pair[:, 0], pair[:, 1]


def _post(t: pa.Table, answers: pa.Table, k: int, per_100: int, buckets: int) -> pa.Table:
    """Step 2 of a chunk: the n-grams by which a set must meet any set it is alike to, and edges between the chunk's own sets."""
    rows: dict = {c.split()[0]: [] for c in POSTINGS.split(", ")}
    schema = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in list(rows)[1:]]])
    reps, answers = answers.filter(pc.is_null(answers.column("bucket"))), answers.filter(pc.is_valid(answers.column("bucket")))
    if not t.num_rows or not answers.num_rows or not reps.num_rows:
        return pa.table(rows, schema)
    ids, grams, first = _chunk(t, reps, k)
    expand = zstandard.ZstdDecompressor()
    known = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) | (b << 32) for b, x in zip(answers.column("bucket").to_pylist(), answers.column("keys").to_pylist(), strict=True)])
    grades = np.concatenate([np.frombuffer(expand.decompress(x), np.uint8) for x in answers.column("grades").to_pylist()])
    by = np.argsort(known)
    known, grades = known[by], grades[by]
    b, low = split_key(mix(grams), buckets)
    key = low.astype(np.int64) | (b << 32)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    shared = known[at] == key
    n = np.diff(first)
    prefix = n - (-(-per_100 * n // 100)) + 1
    alone = np.add.reduceat((~shared).astype(np.int64), first[:-1]) if len(n) else n
    able = np.repeat(alone < prefix, n) & shared  # the set's own n-grams come first in the order
    x = np.flatnonzero(able)
    if not len(x):
        return pa.table(rows, schema)
    owner = np.repeat(np.arange(len(n)), n)[x]
    by = np.lexsort((grams[x], grades[at[x]], owner))
    x, owner = x[by], owner[by]
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    place = np.arange(len(x)) - np.repeat(begin, np.diff(np.r_[begin, len(x)])) + alone[owner]
    on = place < prefix[owner]
    x, owner = x[on], owner[on]
    size = n[owner].astype(np.int64)
    (gram, low, high, least), a, e = chain(grams[x], size, size, ids[owner], per_100)
    b = split_key(mix(gram), buckets)[0]
    by = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[by], np.arange(buckets + 1))
    mine = t.column("chunk")[0].as_py() % buckets
    for c in np.union1d(np.flatnonzero(np.diff(cut)), [mine]).tolist():
        s = by[cut[c] : cut[c + 1]]
        rows["bucket"].append(c)
        for name, v in (("gram", gram[s]), ("least", least[s]), ("low", low[s]), ("high", high[s]), ("a", a if c == mine else a[:0]), ("b", e if c == mine else e[:0])):
            rows[name].append(v.tobytes())
    return pa.table(rows, schema)


def forest(a: list[int], b: list[int]) -> list[int]:
    """The edges that join two trees, when edges between whole numbers are taken in order."""
    top = list(range(1 + max([*a, *b], default=-1)))
    keep = []
    for e, (i, j) in enumerate(zip(a, b, strict=True)):
        while top[i] != i:
            top[i] = i = top[top[i]]
        while top[j] != j:
            top[j] = j = top[top[j]]
        if i != j:
            top[max(i, j)] = min(i, j)
            keep.append(e)
    return keep


def _chain(t: pa.Table, per_100: int) -> pa.Table:
    """Step 2 of a bucket: the chunks' chains of each n-gram are chained again. Edges to the least id of each, and those of the chunks."""
    take = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()] or [np.zeros(0, kind)])
    _, a, b = chain(take("gram", U64), take("low", np.int64), take("high", np.int64), take("least", np.int64), per_100)
    return pa.table({"a": pa.array(np.r_[a, take("a", np.int64)]), "b": pa.array(np.r_[b, take("b", np.int64)])})


class SignatureTree:
    """Sets in order of size and bitmap; each node knows the OR of its members' bitmaps, their sizes and their spare n-grams.

    Spare are the n-grams beyond one per bit: a set x shares at most popcount(x & node) + spare(x) n-grams with any member.
    """

    def __init__(self, grams: list[np.ndarray], bits: int):
        self.n = np.array([len(g) for g in grams], np.int64)
        marks = np.zeros((len(grams), bits), bool)
        for i, g in enumerate(grams):
            marks[i, (mix(g) % U64(bits)).astype(np.int64)] = True
        maps = np.packbits(marks, axis=1).view(U64)
        order = np.lexsort((*(maps[:, j] for j in range(min(4, maps.shape[1]))), self.n))
        self.rows, self.maps = order, maps[order]
        self.size = self.n[order]
        self.spare = self.size - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        nodes = [(i, min(i + LEAF, len(order)), ()) for i in range(0, len(order), LEAF)]
        level = [self._node(a, b, ()) for a, b, _ in nodes]
        while len(level) > 1:
            level = [self._node(g[0]["a"], g[-1]["b"], g) for g in (level[i : i + FAN] for i in range(0, len(level), FAN))]
        self.root = level[0] if level else None

    def _node(self, a: int, b: int, children) -> dict:
        return {"a": a, "b": b, "children": children, "or": np.bitwise_or.reduce(self.maps[a:b], axis=0), "least": int(self.size[a]), "most": int(self.size[b - 1]), "spare": int(self.spare[a:b].max())}


def tree_join(left: SignatureTree, right: SignatureTree, per_100: int):
    """Pairs of rows (of left, of right) that may reach the threshold, leaf pair by leaf pair; left may be right."""
    if left.root is None or right.root is None:
        return
    stack = [(left.root, right.root)]
    while stack:
        x, y = stack.pop()
        if x["most"] * 100 < per_100 * y["least"] or y["most"] * 100 < per_100 * x["least"]:
            continue
        common = int(np.bitwise_count(x["or"] & y["or"]).sum())
        best = min(common + min(x["spare"], y["spare"]), x["most"], y["most"])
        if best * (100 + per_100) < per_100 * (x["least"] + y["least"]):
            continue
        if x["children"] or y["children"]:
            if x is y:
                c = x["children"]
                stack += [(c[i], c[j]) for i in range(len(c)) for j in range(i, len(c))]
            elif x["children"] and (not y["children"] or x["b"] - x["a"] >= y["b"] - y["a"]):
                stack += [(c, y) for c in x["children"]]
            else:
                stack += [(x, c) for c in y["children"]]
            continue
        xs, ys = slice(x["a"], x["b"]), slice(y["a"], y["b"])
        both = np.bitwise_count(left.maps[xs][:, None, :] & right.maps[ys][None, :, :]).sum(2, dtype=np.int64)
        bound = np.minimum(both + left.spare[xs][:, None], both + right.spare[ys][None, :])
        ok = bound * (100 + per_100) >= per_100 * (left.size[xs][:, None] + right.size[ys][None, :])
        if x is y:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        i, j = np.nonzero(ok)
        if len(i):
            yield left.rows[xs][i], right.rows[ys][j]


def overlaps(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left[i] with right[j], pair by pair; many pairs at once by products of 0/1 matrices."""
    if len(i) < 16:
        return np.array([len(np.intersect1d(left[x], right[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    (xs, x), (ys, y) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    rows = [np.repeat(np.arange(len(k)), [len(s[r]) for r in k]) for s, k in ((left, xs), (right, ys))]
    cols = [np.concatenate([s[r] for r in k]) for s, k in ((left, xs), (right, ys))]
    shared = np.intersect1d(*cols)
    out = np.zeros((len(xs), len(ys)), np.float32)
    for at in range(0, len(shared), 1 << 15):
        part, both = shared[at : at + (1 << 15)], []
        for r, c, k in zip(rows, cols, (xs, ys), strict=True):
            place = np.minimum(np.searchsorted(part, c), len(part) - 1)
            on = part[place] == c
            m = np.zeros((len(k), len(part)), np.float32)
            m[r[on], place[on]] = 1
            both.append(m)
        out += both[0] @ both[1].T
    return out[x, y].astype(np.int64)


def link(grams: list[np.ndarray], side: np.ndarray, cross: bool, copies: np.ndarray, per_100: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links among sets, or with `cross` between sides 0 and 1 only: some that span the components of all of them, and for each set the
    copies that its partners stand for."""
    degree = np.zeros(len(grams), np.int64)
    groups = [np.flatnonzero(side == s) for s in (0, 1)] if cross else [np.arange(len(grams))]
    if len(grams) < 2 or not all(map(len, groups)):
        return [], degree
    bits = int(np.clip(1 << int(4 * np.median([len(g) for g in grams])).bit_length(), 256, 4096))
    sets_of = [[grams[i] for i in g] for g in groups]
    trees = [SignatureTree(s, bits) for s in sets_of]
    size = np.array([len(g) for g in grams], np.int64)
    found = []
    for a, b in tree_join(trees[0], trees[-1], per_100):
        x, y = groups[0][a], groups[-1][b]
        common = overlaps(sets_of[0], sets_of[-1], a, b)
        on = 100 * common >= per_100 * (size[x] + size[y] - common)
        x, y = x[on], y[on]
        np.add.at(degree, x, copies[y])
        np.add.at(degree, y, copies[x])
        found.append((x, y))
    x, y = (np.concatenate(v).tolist() for v in zip(*found, strict=True)) if found else ([], [])
    return [(x[e], y[e]) for e in forest(x, y)], degree


def _join_block(t: pa.Table, per_100: int) -> pa.Table:
    """Step 3: the groups (or one pair of sub-blocks of a group) that were dealt to one task. Links have a and b, degrees a and n."""
    data, first = texts(t.column("grams"))
    grams, first = data.view(U64), first // 8
    comp, side, ids, part, copies = (t.column(c).to_numpy() for c in ("comp", "side", "doc_id", "part", "copies"))
    by = np.lexsort((ids, side, part, comp))
    edge = np.flatnonzero(np.r_[True, (comp[by][1:] != comp[by][:-1]) | (part[by][1:] != part[by][:-1])]) if len(by) else np.zeros(0, int)
    a, b, n = [], [], []
    for x, y in zip(edge, np.r_[edge[1:], len(by)], strict=True):
        rows = by[x:y]
        cross = (part[rows[0]] >> SIDE) != (part[rows[0]] & ((1 << SIDE) - 1))
        found, degree = link([grams[first[r] : first[r + 1]] for r in rows], side[rows], bool(cross), copies[rows], per_100)
        some = np.flatnonzero(degree)
        a += [int(ids[rows[i]]) for i, _ in found] + ids[rows[some]].tolist()
        b += [int(ids[rows[j]]) for _, j in found] + [None] * len(some)
        n += [None] * len(found) + degree[some].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})


def join_ngrams(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, per_100: int = 85) -> DataFrame:
    """Component of each row under links of 100 * |x & y| >= per_100 * |x | y|: (doc_id, n_shingles, rep_id, component_id, n_links).

    A set holds the distinct runs of k words (A-Z lower-cased, cut at white space) of the whole text; fewer words make one run. rep_id
    is the least id with an equal set, component_id the least id that links reach, n_links the number of other documents that the row's links
    with (of copies all count, without being compared one by one). Null and empty texts, and texts without
    words, have an empty set and link with nothing, so both ids are their own. Repeated rows give repeated rows; texts that
    share an id are one document to links, so what either is alike to is one component. Rows without an id are left out of the
    search; they come back with null rep_id, component_id and n_links. An empty table gives an empty table; other columns, whatever their
    names, are ignored. Very long words and texts are hashed whole; a text is read, and its set held, in one task.
    """
    spark = docs.sparkSession
    all_docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    told = stored(describe_sets(all_docs, k))
    docs = all_docs.filter("doc_id is not null")
    parts, n_chunks, buckets = chunk_sizes(spark, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    classes = stored(told.filter("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("copies")))
    # an id that comes with several texts stands for all their sets
    reps = stored(classes.groupBy(F.col("rep_id").alias("doc_id")).agg(F.sum("copies").alias("copies"), F.sum("n").alias("n")))
    chunk = spread(F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks)))
    dealt = docs.withColumn("chunk", chunk).repartition(parts, "chunk")
    of_chunk = reps.select("doc_id", chunk.alias("chunk")).groupBy("chunk").agg(F.collect_list("doc_id").alias("reps"))  # ids of a chunk of texts
    to_bucket = lambda df: df.withColumn("place", spread(F.col("bucket"))).groupBy("place")  # noqa: E731, so many buckets in each task
    named = dealt.groupBy("chunk").cogroup(of_chunk.groupBy("chunk")).applyInArrow(lambda t, r: _names(t, r, k, buckets), NAMES)
    often = to_bucket(named).applyInArrow(_frequent, "chunk int, bucket int, keys binary, grades binary")
    answers = often.withColumn("reps", F.lit(None).cast("array<long>")).unionByName(of_chunk, allowMissingColumns=True)
    posted = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, a: _post(t, a, k, per_100, buckets), POSTINGS)
    near = stored(to_bucket(posted).applyInArrow(lambda t: _chain(t, per_100), "a long, b long"))
    groups = components(near)
    # a group of many members or bytes is dealt into sub-blocks, and each pair of them is a task; small groups share tasks
    members = groups.withColumnRenamed("id", "doc_id").join(reps, "doc_id")
    sizes = members.groupBy("comp").agg(F.count("*").alias("m"), (F.sum("n") * 8).alias("bytes"))
    by_count = F.when(F.col("m") <= 32 * SUB, F.ceil(F.col("m") / SUB)).otherwise(32)
    sizes = stored(sizes.select("comp", "bytes", F.greatest(by_count, F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("q")))
    shared = sizes.filter("q = 1").agg(F.sum("bytes")).first()[0] or 0
    tasks = max(width(spark), -(-shared // TASK_BYTES))
    member = members.join(sizes.select("comp", "q"), "comp").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("q")).cast("int"))
    member = stored(member.select("doc_id", "comp", "q", "own", "copies"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda o: F.struct(F.least(o, "own").alias("i"), F.greatest(o, "own").alias("j")))
    blocks = pack_sets(docs.join(member, "doc_id"), k).withColumn("p", F.explode(pairs))
    blocks = blocks.select(
        "doc_id",
        "comp",
        "copies",
        "grams",
        (F.shiftleft(F.col("p.i").cast("long"), SIDE) + F.col("p.j")).alias("part"),
        ((F.col("own") == F.col("p.j")) & (F.col("p.i") < F.col("p.j"))).cast("int").alias("side"),
        F.when(F.col("q") > 1, F.xxhash64("comp", "p.i", "p.j")).otherwise(spread(F.pmod(F.xxhash64("comp"), F.lit(tasks)))).alias("task"),
    )
    links = stored(blocks.groupBy("task").applyInArrow(lambda t: _join_block(t, per_100), "a long, b long, n long"))
    forget(near, groups, sizes, member, reps)
    linked = components(links.filter("b is not null").select("a", "b"))
    degrees = links.filter("n is not null").groupBy(F.col("a").alias("rep_id")).agg(F.sum("n").alias("partners"))
    found = classes.join(linked.select(F.col("id").alias("rep_id"), "comp"), "rep_id", "left").join(degrees, "rep_id", "left")
    count = F.coalesce("partners", F.lit(0)) + F.col("copies") - 1
    # stored, so that Spark can split a class with many copies in the join
    found = stored(found.select("d1", "d2", "n", "rep_id", F.coalesce("comp", "rep_id").alias("comp"), count.alias("links")))
    forget(classes, links, linked)
    out = told.join(found, ["d1", "d2", "n"], "left")
    own = {"rep_id": F.coalesce("rep_id", "doc_id"), "component_id": F.coalesce("comp", "doc_id"), "n_links": F.coalesce("links", F.lit(0))}
    return out.select("doc_id", F.col("n").alias("n_shingles"), *[F.when(F.col("doc_id").isNotNull(), c).alias(name) for name, c in own.items()])
