"""Suffix-array dedup: removes text that already stands in a document with a smaller id.

The plan deals texts into chunks once and uses that exchange three times:
  1. each chunk names its anchors: of the K-grams in a window of `length` bytes, the one with the least hash. Equal windows have
     equal anchors at equal places, so windows whose anchor stands in one document only can be left out without a loss;
  2. chunks send the windows of the other anchors, as pieces of text, to the suffix bucket of their anchor. An anchor of many
     chunks is split: its windows go by the anchor and the bytes that all of them have before or behind it. A bucket sorts its
     suffixes block by block with a difference cover (suffix_sort) and finds the equal ones and their least document;
  3. the spans go back to the chunks.
What travels in 1 and 2 is packed into one row per chunk and bucket, and equal keys or pieces of a chunk travel once, so
a passage that a third of all documents share makes as many entries as there are chunks, not documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc  # not part of pyarrow until it is imported
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BACK, BASE, BYTE, U64, boxed, equal_bytes, mix, plus, powers, quoted, spread, texts, unboxed, width, word_hashes
from .suffix_sort import equal_runs

KGRAM = 26
STEP = 1 << 18
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 24 << 20
BLOCK_WINDOWS = 1 << 18
MOST_LENGTH = 1000  # of the strings that are compared; a block's sort holds that many bytes a window
HOT_CHUNKS = 32  # an anchor that stands in so many chunks is split by the bytes around it
SPAN = "array<struct<start:long,end:long>>"


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (key, place of the anchor, first window, last window), as places in data."""
    k = min(KGRAM, length)
    wide = length - k + 1
    found = []
    for s in range(0, len(data) - length + 1, STEP):
        seg = data[s : s + STEP + length - 1]
        n = len(seg)
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum(BYTE[seg] * powers(n, BASE, "up"), out=total[1:])
        h = mix((total[k:] - total[:-k]) * powers(n, BACK, "down")[: n - k + 1])
        low = (h & ~U64(0xFFFFF)) | np.arange(len(h), dtype=U64)  # the place in the low 20 bits: the first of equal ones wins
        span = 1
        while span * 2 <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < wide:
            low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        low = low[: n - length + 1]
        cut = np.r_[True, low[1:] != low[:-1]]
        inner = off[(off > s) & (off < s + len(low))] - s
        cut[inner] = True
        i = np.flatnonzero(cut)
        j = np.r_[i[1:], len(low)] - 1
        p = (low[i] & U64(0xFFFFF)).astype(np.int64)
        found.append((h[p], p + s, i + s, j + s))
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, none
    key, p, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    end = off[np.searchsorted(off, i, "right")]  # of the text in which the run begins
    j = np.minimum(j, end - length)
    ok = i <= j
    return key[ok], p[ok], i[ok], j[ok]


def split_key(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((key >> U64(32)) % U64(buckets)).astype(np.int64), key.astype(np.uint32)


def same_as_before(data: np.ndarray, i: np.ndarray, n: np.ndarray, by: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Along the order `by`: whether a piece has the keys, the length and the bytes of the one before it."""
    same = np.zeros(len(by), bool)
    same[1:] = n[by][1:] == n[by][:-1]
    for key in keys:
        same[1:] &= key[by][1:] == key[by][:-1]
    at = np.flatnonzero(same)
    same[at] = equal_bytes(data, i[by[at]], data, i[by[at - 1]], n[by[at]])
    return same


def _sound(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and ids of a chunk's texts, ordered by id, and the rows' numbers; rows without id are left out.

    Rows of one id are in the order of their texts' hashes, so that a place in this order means the same text each time the chunk is read.
    """
    ids = t.column("__id").combine_chunks()
    rows = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
    num = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[rows]
    by = np.argsort(num, kind="stable")
    rows, num = rows[by], num[by]
    again = np.flatnonzero(np.isin(num, num[1:][num[1:] == num[:-1]]))
    if len(again):
        data, off = texts(t.column("__text").take(pa.array(rows[again])))
        rows[again] = rows[again][np.lexsort((word_hashes(data, off[:-1], np.diff(off)), num[again]))]
    data, off = texts(t.column("__text").take(pa.array(rows)))
    return data, off, num, rows


def _gather(data: np.ndarray, i: np.ndarray, n: np.ndarray) -> np.ndarray:
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return data[at + np.repeat(i, n)]


def _names(t: pa.Table, length: int, buckets: int) -> pa.Table:
    """Step 1 of a chunk: its anchors' keys, once each, those of one document apart from those of several."""
    data, off, num, _ = _sound(t)
    key, _, i, _ = anchors(data, off, length)
    doc = num[np.searchsorted(off, i, "right") - 1]
    by = np.lexsort((doc, key))
    key, doc = key[by], doc[by]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    several = np.maximum.reduceat(doc, first) > doc[first] if len(first) else np.zeros(0, bool)
    b, low = split_key(key[first], buckets)
    by = np.lexsort((low, several, b))
    b, low, several = b[by], low[by], several[by]
    cut = np.searchsorted(b, np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cut))
    chunk = t.column("__chunk")[0].as_py()
    return pa.table({"bucket": pa.array(used.astype(np.int32)), "chunk": pa.array(np.full(len(used), chunk, np.int32)),
                     "one": pa.array([int((~several[cut[x] : cut[x + 1]]).sum()) for x in used], pa.int32()),
                     "keys": pa.array([low[cut[x] : cut[x + 1]].tobytes() for x in used], pa.binary())})


def _repeated(t: pa.Table) -> pa.Table:
    """Step 1 of a bucket: tells each chunk which of its keys stand in several documents, and which of those in many chunks."""
    keys = [np.frombuffer(x, np.uint32) for x in t.column("keys").to_pylist()]
    one, chunk = t.column("one").to_pylist(), t.column("chunk").to_pylist()
    everything = np.concatenate(keys)
    value, count = np.unique(everything, return_counts=True)
    repeated, often = value[count > 1], value[count >= HOT_CHUNKS]
    out, hot = [], []
    for k, n in zip(keys, one, strict=True):
        held = np.zeros(len(k), bool)
        held[n:] = True
        if len(repeated):
            at = np.minimum(np.searchsorted(repeated, k), len(repeated) - 1)
            held |= repeated[at] == k
        out.append(k[held])
        hot.append(np.intersect1d(k, often))
    some = [x for x, k in enumerate(out) if len(k)]
    bucket = t.column("bucket").to_pylist()
    return pa.table({"chunk": pa.array([chunk[x] for x in some], pa.int32()), "bucket": pa.array([bucket[x] for x in some], pa.int32()), "keys": pa.array([out[x].tobytes() for x in some], pa.binary()), "hot": pa.array([hot[x].tobytes() for x in some], pa.binary())})


PIECES = "bucket int, chunk int, kind int, keys binary, doc binary, row binary, low binary, n binary, lead binary, text binary"


def _rows(rows: list[dict]) -> pa.Table:
    kinds = {"bucket": pa.int32(), "chunk": pa.int32(), "kind": pa.int32()}
    return pa.table({c: pa.array([r.get(c) for r in rows], kinds.get(c, pa.binary())) for c in (x.split()[0] for x in PIECES.split(", "))})


def _told(answers: pa.Table, column: str) -> np.ndarray:
    """The keys that buckets told a chunk, each with its bucket above 32 bits, in order."""
    parts = [np.frombuffer(k, np.uint32).astype(np.int64) | (b << 32) for b, k in zip(answers.column("bucket").to_pylist(), answers.column(column).to_pylist(), strict=True)]
    return np.sort(np.concatenate(parts))


def _split_hot(data: np.ndarray, hot: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Pieces of hot anchors in two: (piece, first window, last window, key). Windows with `half` or more bytes before the anchor go by
    those and it, the others, which have more behind it, by it and the `half` bytes that follow. So equal windows still meet."""
    k = min(KGRAM, length)
    half = (length - k) // 2
    before, after = hot[i[hot] <= p[hot] - half], hot[j[hot] > p[hot] - half]
    rows = np.r_[before, after]
    first = np.r_[i[before], np.maximum(i[after], p[after] - half + 1)]
    last = np.r_[np.minimum(j[before], p[before] - half), j[after]]
    key = word_hashes(data, np.r_[p[before] - half, p[after]], np.full(len(rows), k + half, np.int64))
    return rows, first, last, mix(key ^ (np.arange(len(rows)) < len(before)).astype(U64))


def _send(t: pa.Table, answers: pa.Table, length: int, buckets: int) -> pa.Table:
    """Step 2 of a chunk: pieces of text (all windows of one anchor) whose anchors are repeated, to their buckets.

    Of equal pieces only those of the least document go; the others' windows are known to be copies, and go as spans (kind 1).
    """
    if not t.num_rows or not answers.num_rows:
        return _rows([])
    chunk = t.column("__chunk")[0].as_py()
    data, off, num, _ = _sound(t)
    key, p, i, j = anchors(data, off, length)
    bucket, low = split_key(key, buckets)
    wanted, hot = _told(answers, "keys"), _told(answers, "hot")
    full = low.astype(np.int64) | (bucket << 32)
    among = lambda x, known: known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)
    on = among(full, wanted)
    often = on & among(full, hot)
    rows, first, last, wider = _split_hot(data, np.flatnonzero(often), p, i, j, length)
    on = np.flatnonzero(on & ~often)
    wide_bucket, wide_low = split_key(wider, buckets)
    bucket, low = np.r_[bucket[on], wide_bucket], np.r_[low[on], wide_low]
    p, i, j = np.r_[p[on], p[rows]], np.r_[i[on], first], np.r_[j[on], last]
    n = j - i + length
    text_no = np.searchsorted(off, i, "right") - 1
    doc, start, lead = num[text_no], i - off[text_no], p - i
    h = word_hashes(data, i, n)
    by = np.lexsort((doc, lead, h))
    same = same_as_before(data, i, n, by, h, lead)
    least = doc[by][np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))] if len(by) else doc
    copy = np.zeros(len(by), bool)
    copy[by] = doc[by] > least
    out = []
    if copy.any():
        c = np.flatnonzero(copy)
        out.append({"bucket": chunk % buckets, "chunk": chunk, "kind": 1, "text": np.stack([text_no[c], start[c], n[c]]).tobytes()})
    go = np.flatnonzero(~copy)
    go = go[np.lexsort((i[go], bucket[go]))]
    cut = np.searchsorted(bucket[go], np.arange(buckets + 1))
    press = zstandard.ZstdCompressor(level=3)
    for b in np.flatnonzero(np.diff(cut)):
        x = go[cut[b] : cut[b + 1]]
        out.append({"bucket": int(b), "chunk": chunk, "kind": 0, "keys": low[x].tobytes(), "doc": press.compress(doc[x].tobytes()), "row": press.compress(text_no[x].astype(np.uint32).tobytes()), "low": start[x].astype(np.uint32).tobytes(), "n": n[x].astype(np.uint16).tobytes(), "lead": lead[x].astype(np.uint16).tobytes(), "text": press.compress(_gather(data, i[x], n[x]).tobytes())})
    return _rows(out)


def copied_windows(text: np.ndarray, begin: np.ndarray, n: np.ndarray, lead: np.ndarray, key: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows in the pieces that also start in a smaller document: (piece, first window in it, last window)."""
    h = word_hashes(text, begin, n)
    by = np.lexsort((doc, lead, h, key))
    new = ~same_as_before(text, begin, n, by, key, h, lead)
    head = by[np.flatnonzero(new)]  # of each distinct piece the one of the least document
    kind = np.empty(len(by), np.int64)
    kind[by] = np.cumsum(new) - 1
    wholly = np.flatnonzero(doc > doc[head][kind])
    found = [(wholly, np.zeros(len(wholly), np.int64), n[wholly] - length)]
    # among distinct pieces, those whose anchor has several: sorted block by block; a block ends between two anchors
    many = np.bincount(np.unique(key[head], return_inverse=True)[1])
    rank = np.unique(key[head], return_inverse=True)[1]
    some = np.flatnonzero(many[rank] > 1)
    some = some[np.argsort(rank[some], kind="stable")]
    windows = (n[head[some]] - length + 1).astype(np.int64)
    block = np.cumsum(windows) // BLOCK_WINDOWS
    if len(some):
        r = rank[some]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        block = np.repeat(block[first], np.diff(np.r_[first, len(r)]))
    marks = []
    for b in np.unique(block):
        x = some[block == b]
        at = head[x]
        m = n[at]
        local = np.cumsum(m) - m
        w = m - length + 1
        piece = np.repeat(np.arange(len(x)), w)
        place = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        order, same = equal_runs(_gather(text, begin[at], m), local[piece] + place, length)
        d = doc[at][piece][order]
        least = np.minimum.reduceat(d, np.flatnonzero(np.r_[True, same[1:] != same[:-1]]))
        gone = np.zeros(len(order), bool)
        gone[order] = d > least[same]
        g = np.flatnonzero(gone)
        marks.append((x[piece[g]], place[g]))
    if marks:
        k, place = (np.concatenate(v) for v in zip(*marks, strict=True))
        by_k = np.lexsort((place, k))
        k, place = k[by_k], place[by_k]
        edge = np.r_[True, (k[1:] != k[:-1]) | (place[1:] != place[:-1] + 1)] if len(k) else np.zeros(0, bool)
        s = np.flatnonzero(edge)
        e = np.r_[s[1:], len(k)] - 1 if len(s) else s
        # a run holds for every piece of the least document that is equal to its kind's head
        lead_rows = np.flatnonzero(doc == doc[head][kind])
        lead_rows = lead_rows[np.argsort(kind[lead_rows], kind="stable")]
        lo, hi = np.searchsorted(kind[lead_rows], k[s], "left"), np.searchsorted(kind[lead_rows], k[s], "right")
        times = hi - lo
        take = np.repeat(lo, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        found.append((lead_rows[take], np.repeat(place[s], times), np.repeat(place[e], times)))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _resolve(t: pa.Table, length: int) -> pa.Table:
    """Step 2 of a bucket: spans (place of the document in its chunk, start, bytes) to the chunks they came from."""
    expand = zstandard.ZstdDecompressor()
    chunks, blobs = [], []
    sent = [r for r in t.to_pylist() if r["kind"] == 0]
    for r in t.filter(pc.equal(t.column("kind"), 1)).to_pylist() if t.num_rows > len(sent) else ():
        chunks.append(r["chunk"])
        blobs.append(r["text"])
    if sent:
        take = lambda c, kind: [np.frombuffer(expand.decompress(r[c]) if c in ("doc", "row") else r[c], kind) for r in sent]
        keys, doc, row, low, n, lead = take("keys", np.uint32), take("doc", np.int64), take("row", np.uint32), take("low", np.uint32), take("n", np.uint16), take("lead", np.uint16)
        text = np.frombuffer(b"".join(expand.decompress(r["text"]) for r in sent), np.uint8)
        chunk = np.repeat([r["chunk"] for r in sent], [len(k) for k in keys])
        keys, doc, row, low, n, lead = (np.concatenate(v) for v in (keys, doc, row, low, n, lead))
        row, low, n, lead = (v.astype(np.int64) for v in (row, low, n, lead))
        piece, a, b = copied_windows(text, np.cumsum(n) - n, n, lead, keys, doc, length)
        by = np.lexsort((low[piece] + a, row[piece], chunk[piece]))
        piece, a, b = piece[by], a[by], b[by]
        d, s, e, c = row[piece], low[piece] + a, low[piece] + b + length, chunk[piece]
        cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, int)
        for x, y in zip(cut, np.r_[cut[1:], len(c)], strict=True):
            chunks.append(int(c[x]))
            blobs.append(np.stack([d[x:y], s[x:y], (e - s)[x:y]]).tobytes())
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "spans": pa.array(blobs, pa.binary())})


def _inward(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the characters that they hold in part only."""
    inside = lambda p: p < len(text) and text[p] & 0xC0 == 0x80
    moved = []
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        while a < b and inside(a):
            a += 1
        while a < b and inside(b):
            b -= 1
        if a < b:
            moved.append((a, b))
    return tuple(np.array(moved, np.int64).reshape(-1, 2).T)


def _cut(t: pa.Table, answers: pa.Table, names: list[str], schema: pa.Schema, whole_characters: bool) -> pa.Table:
    """Step 3: the rows of a chunk with their maximal spans and what is left of their texts."""
    data, off, num, rows = _sound(t)
    parts = [np.frombuffer(x, np.int64).reshape(3, -1) for x in answers.column("spans").to_pylist()]
    d, s, n = np.concatenate(parts, 1) if parts else np.zeros((3, 0), np.int64)
    by = np.lexsort((s, d))
    d, s, e = d[by], s[by], (s + n)[by]
    lo, hi = np.searchsorted(d, np.arange(len(num)), "left"), np.searchsorted(d, np.arange(len(num)), "right")
    spans: list = [[] for _ in range(t.num_rows)]
    kept: list = [None] * t.num_rows
    raw = data.tobytes()
    for x, row in enumerate(rows):
        text = raw[off[x] : off[x + 1]]
        if lo[x] == hi[x]:
            kept[row] = text
            continue
        a, b = s[lo[x] : hi[x]], e[lo[x] : hi[x]]
        top = np.maximum.accumulate(b)
        edge = np.flatnonzero(np.r_[True, a[1:] > top[:-1]])
        start, end = a[edge], np.r_[top[edge[1:] - 1], top[-1]]
        if whole_characters:
            start, end = _inward(text, start, end)
        spans[row] = [{"start": int(u), "end": int(v)} for u, v in zip(start, end, strict=True)]
        kept[row] = b"".join(text[u:v] for u, v in zip(np.r_[0, end], np.r_[start, len(text)], strict=True))
    for row in np.flatnonzero([k is None for k in kept]):
        kept[row] = (t.column("__text")[int(row)].as_py() or "").encode()
    out = {c: t.column(c) for c in names} | {"spans": pa.array(spans, schema.field("spans").type), "kept": pa.array(kept, pa.binary())}
    return pa.table(out)


def sizes(spark: SparkSession, total: int) -> tuple[int, int, int]:
    """Partitions, chunks and buckets for so many bytes of text: chunks of CHUNK_BYTES or less, equally many in each partition, some two of them."""
    parts = max(width(spark), -(-total // (2 * CHUNK_BYTES)))
    return parts, parts * max(1, -(-total // (parts * CHUNK_BYTES))), max(width(spark), -(-total // BUCKET_BYTES))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50, whole_characters: bool = False) -> DataFrame:
    """The rows of docs with two more columns: spans (removed byte ranges of the UTF-8 text) and kept (the bytes left).

    A byte goes when a string of `length` bytes that covers it also starts in a document with a smaller id. Strings are judged on the
    input and never cross documents. Null and empty texts, and texts shorter than `length`, lose nothing (kept is empty for
    null). Rows with the same id are parts of one document for each other, so they remove nothing from each other, and each loses what
    documents with smaller ids hold, whether their texts are equal or not. Very long texts are read whole, as a chunk of their own size, in
    one task: some 40 bytes of memory a byte of text. Rows without an id take no part and stay whole. An empty table gives an
    empty table. A length over MOST_LENGTH is an error. Columns named spans or kept are replaced. With whole_characters, a character that a span holds in part stays,
    so that kept is UTF-8 again.
    """
    if not 1 <= length <= MOST_LENGTH:
        raise ValueError(f"length must be 1 to {MOST_LENGTH}")
    spark = docs.sparkSession
    docs = docs.drop("spans", "kept")
    names = docs.columns
    total = docs.agg(F.sum(F.octet_length(F.col(quoted(text)).cast("string")))).first()[0] or 0
    parts, n_chunks, buckets = sizes(spark, total)
    own = F.col(quoted(doc_id)).cast("long")
    # the text travels once, the other columns as one struct, whatever their names
    apart = {text: F.col("__text")} if docs.schema[text].dataType == T.StringType() else {}
    dealt = docs.select(boxed([c for c in names if c not in apart]), own.alias("__id"), F.col(quoted(text)).cast("string").alias("__text"), spread(F.pmod(F.xxhash64(own), F.lit(n_chunks))).alias("__chunk"))
    slim = dealt.repartition(parts, "__chunk")
    named = slim.groupBy("__chunk").applyInArrow(lambda t: _names(t, length, buckets), "bucket int, chunk int, one int, keys binary")
    to_bucket = lambda df: df.withColumn("place", spread(F.col("bucket"))).groupBy("place")  # noqa: E731, so many buckets in each task
    repeated = to_bucket(named).applyInArrow(_repeated, "chunk int, bucket int, keys binary, hot binary")
    sent = slim.groupBy("__chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(lambda t, a: _send(t, a, length, buckets), PIECES)
    spans = to_bucket(sent).applyInArrow(lambda t: _resolve(t, length), "chunk int, spans binary")
    schema = plus(dealt.select("row", "__text"), f"spans {SPAN}, kept binary")
    arrow = pa.schema([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    out = slim.groupBy("__chunk").cogroup(spans.groupBy("chunk")).applyInArrow(lambda t, a: _cut(t, a, ["row", "__text"], arrow, whole_characters), schema)
    return out.select(*unboxed(names, apart), "spans", "kept")
