"""SentencePiece encoding and decoding by suffix-array matching, equal to the library's for BPE models with byte fallback.

A batch's distinct words that its task does not know yet are laid end to end and their suffixes sorted; every piece of the vocabulary is looked up by binary
search, which gives the range of suffixes that begin with it, that is, all its occurrences. Each occurrence is an edge from its first
to its last position. Edges are sorted by position and relaxed: a position keeps the one edge that can end a BPE encoding of
what stands before it, which holds when its piece and the piece before it stay as they are if merged by rank together.
(The shortest path by summed scores, right for unigram models, is not what a BPE model encodes.)
Short words are relaxed all at once, a position a step; a long word by itself, in windows of its characters, in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, equal_bytes, mix, pieces, plus, word_hashes
from .suffix_sort import sort_suffixes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SLICE = 1 << 20  # bytes of text that are indexed at once
# what a task keeps of earlier batches; beyond it starts anew, and what comes again is encoded again
CACHED_WORDS, CACHED_BYTES, CACHED_PAIRS = 1_000_000, 32 << 20, 4_000_000
LONG_WORD = 512  # bytes from which a word is relaxed by itself
WINDOW = 1 << 16  # characters of a long word whose pieces are looked up at once


class PieceModel:
    """The vocabulary, and whether two pieces stay apart when merged together (asked once for each pair)."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(proto)
        spec = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or len(spec.precompiled_charsmap) or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalization are read")
        self.names = [p.piece for p in m.pieces]
        self.score = {p.piece: p.score for p in m.pieces if p.type == 1}
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.id):
            raise ValueError("a piece holds a space after another character")
        self.byte_id = np.zeros(256, np.int32)
        raw = [b""] * len(self.names)
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                raw[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 1:
                raw[i] = p.piece.replace(SPACE, " ").encode()
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.space = self.id[SPACE]
        # pieces to look up: those that merging yields, without runs of spaces, which are encoded apart
        self.find = [i for p, i in self.id.items() if p.strip(SPACE) and self.merge(p) == [i]] + [self.space]
        self.find.sort(key=lambda i: raw[i])
        self.find_len = np.array([len(raw[i]) for i in self.find], np.int64)
        width = 8 * -(-int(self.find_len.max()) // 8)
        self.keys = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in self.find), ">u8").reshape(len(self.find), -1).astype(U64)
        self.find = np.array(self.find, np.int64)
        self.cache: dict = {}
        self.clear()
        self.clear_pairs()

    def clear(self) -> None:
        """Forgets all words: their hashes in order, and for each its ids (in pool) and its bytes (in seen)."""
        self.word_hash, self.word_at, self.word_n = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.seen_at, self.seen_n, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self.pool = np.zeros(0, np.int32)
        self.cache.clear()

    def clear_pairs(self) -> None:
        self.pairs, self.n_pairs = np.full(1 << 16, -1, np.int64), 0  # a hash table of 2 * pair + (whether they stay apart)
        self.known_pairs: dict[int, bool] = {}  # the same for long words

    def merge(self, text: str) -> list:
        """BPE by its definition: of all neighbours that join to a piece, the best score first, the leftmost of equal ones."""
        part = list(text)
        score = self.score
        rank = [score.get(part[i] + part[i + 1]) for i in range(len(part) - 1)]
        while True:
            best = None
            for i, r in enumerate(rank):
                if r is not None and (best is None or r > rank[best]):
                    best = i
            if best is None:
                return [self.id.get(p, p) for p in part]
            part[best : best + 2] = [part[best] + part[best + 1]]
            del rank[best]
            if best < len(rank):
                rank[best] = score.get(part[best] + part[best + 1])
            if best:
                rank[best - 1] = score.get(part[best - 1] + part[best])

    def spaces(self, n: int) -> np.ndarray:
        if n not in self.cache:
            sizes, out = sorted((len(p) for p in self.id if not p.strip(SPACE)), reverse=True), []
            left = n
            while left > max(64, 2 * sizes[0]) and all(s in sizes for s in range(1, sizes[0] + 1)):
                out.append(self.id[SPACE * sizes[0]])  # equal scores: the leftmost run grows until it is the longest piece
                left -= sizes[0]
            self.cache[n] = np.array(out + self.merge(SPACE * left), np.int32)
        return self.cache[n]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, merged together, stay a and b."""
        key = (a << 32) + b
        found = self._seek(key)
        new = np.unique(key[found < 0])
        if len(new):
            ok = [self.stay(k) for k in new.tolist()]
            if 3 * (self.n_pairs + len(new)) > len(self.pairs):
                have, room = self.pairs[self.pairs >= 0], len(self.pairs)
                while 3 * (len(have) + len(new)) > room:
                    room *= 2
                self.pairs, self.n_pairs = np.full(room, -1, np.int64), 0
                self._put(have)
            self._put(2 * new + np.array(ok, np.int64))
            found = self._seek(key)
        return (found & 1).astype(bool)

    def stay(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        return self.merge(self.names[a] + self.names[b]) == [a, b]

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(U64)) & U64(len(self.pairs) - 1)).astype(np.int64)

    def _seek(self, key: np.ndarray) -> np.ndarray:
        """The entry of each pair, -1 for none; every round looks one place further for those that met another pair."""
        at = self._slots(key)
        found = self.pairs[at]
        wrong = np.flatnonzero((found >= 0) & (found >> 1 != key))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.pairs) - 1)
            found[wrong] = self.pairs[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (found[wrong] >> 1 != key[wrong])]
        return found

    def _put(self, entries: np.ndarray) -> None:
        self.n_pairs += len(entries)
        at = self._slots(entries >> 1)
        while len(entries):
            free = self.pairs[at] < 0
            self.pairs[at[free]] = entries[free]  # of several for one place the last stays
            on = self.pairs[at] != entries
            entries, at = entries[on], (at[on] + 1) & (len(self.pairs) - 1)


def occurrences(model: PieceModel, text: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, row of model.find) of each occurrence of each piece at the places pos of the text."""
    depth = model.keys.shape[1] * 8
    order = pos[sort_suffixes(text, pos, depth)]
    buffer = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    view = np.ndarray((len(text) + depth,), ">u8", buffer, strides=(1,))
    lo, hi = np.zeros(len(model.find), np.int64), np.full(len(model.find), len(order), np.int64)
    for j in range(model.keys.shape[1]):
        left = np.clip(model.find_len - 8 * j, 0, 8)
        on = np.flatnonzero((left > 0) & (hi > lo))
        if not len(on):
            break
        word = view[order + 8 * j].astype(U64)
        first = model.keys[on, j]
        last = first | np.where(left[on] == 8, U64(0), ~U64(0) >> (U64(8) * left[on].astype(U64) % U64(64)))
        if j == 0:
            lo[on], hi[on] = np.searchsorted(word, first, "left"), np.searchsorted(word, last, "right")
            continue
        for target, ends, after in ((first, "lo", False), (last, "hi", True)):  # all binary searches at once
            a, b = lo[on].copy(), hi[on].copy()
            while (a < b).any():
                mid = (a + b) // 2
                w = word[np.minimum(mid, len(word) - 1)]
                up = (w <= target if after else w < target) & (a < b)
                b = np.where(up | (a >= b), b, mid)
                a = np.where(up, mid + 1, a)
            if ends == "lo":
                new_lo = a
            else:
                lo[on], hi[on] = new_lo, a
    n = np.maximum(hi - lo, 0)
    piece = np.repeat(np.arange(len(n)), n)
    return order[np.repeat(lo, n) + np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)], piece


def encode_words(model: PieceModel, text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words text[begin[i] : begin[i + 1]], laid end to end, and the number of each."""
    opens = (text & 0xC0) != 0x80
    starts = np.flatnonzero(opens)
    char_at = np.r_[0, np.cumsum(opens)]  # characters that begin before each byte
    char = char_at[begin]  # of each word's first character, and the total
    n_char = np.diff(char)
    slot = char[:-1] + np.arange(len(n_char))  # a slot for each position between characters: n + 1 a word
    word_of = np.repeat(np.arange(len(n_char)), n_char)
    place, piece = occurrences(model, text, starts)
    c = char_at[place]
    w = word_of[c]
    end = place + model.find_len[piece]
    inside = end <= begin[w + 1]
    c, w, end, piece = c[inside], w[inside], end[inside], piece[inside]
    e = char_at[end]
    s_off, e_off, ident = c - char[w], e - char[w], model.find[piece]
    single = np.ones(len(starts), bool)
    single[c[e_off - s_off == 1]] = False
    alone = np.flatnonzero(single)  # characters outside the vocabulary: edges of their own, which merge with nothing
    w, s_off = np.r_[w, word_of[alone]], np.r_[s_off, alone - char[word_of[alone]]]
    e_off, ident = np.r_[e_off, alone - char[word_of[alone]] + 1], np.r_[ident, np.full(len(alone), -1)]
    by = np.lexsort((s_off, w, e_off))
    w, s_off, e_off, ident = w[by], s_off[by], e_off[by], ident[by]
    total = len(starts) + len(n_char)
    last, back = np.full(total, -2, np.int64), np.zeros(total, np.int64)
    cut = np.searchsorted(e_off, np.arange(1, int(n_char.max(initial=0)) + 2))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        at, t2 = slot[w[a:b]] + s_off[a:b], ident[a:b]
        t1 = last[at]
        ok = (s_off[a:b] == 0) | (t1 == -1) | (t2 == -1)
        ask = np.flatnonzero(~ok & (t1 >= 0))
        ok[ask] = model.apart(t1[ask], t2[ask])
        k = np.flatnonzero(ok)
        to = slot[w[a:b]][k] + e_off[a:b][k]
        last[to], back[to] = t2[k], s_off[a:b][k]
    # from the ends of the words back to their beginnings
    live, at_off = np.flatnonzero(n_char), n_char.copy()
    got_w, got_e, got_t, got_s = [], [], [], []
    while len(live):
        g = slot[live] + at_off[live]
        if (last[g] == -2).any():
            raise ValueError("a word has no encoding")
        got_w.append(live)
        got_e.append(at_off[live])
        got_t.append(last[g])
        got_s.append(back[g])
        at_off[live] = back[g]
        live = live[at_off[live] > 0]
    if not got_w:
        return np.zeros(0, np.int32), np.zeros(len(n_char), np.int64)
    gw, ge, gt, gs = (np.concatenate(x) for x in (got_w, got_e, got_t, got_s))
    by = np.lexsort((ge, gw))
    gw, gt, gs = gw[by], gt[by], gs[by]
    unknown = gt == -1
    if unknown.any():
        first = starts[char[gw] + gs]
        stop = np.r_[starts, len(text)][char[gw] + gs + 1]
        n = np.where(unknown, stop - first, 1)
        src = np.repeat(np.arange(len(gt)), n)
        step = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
        ids = np.where(unknown[src], model.byte_id[text[np.minimum(first[src] + step, len(text) - 1)]], gt[src])
        gw = gw[src]
    else:
        ids = gt
    return ids.astype(np.int32), np.bincount(gw, minlength=len(n_char))


def encode_long(model: PieceModel, text: np.ndarray) -> list[int]:
    """Ids of one long word: edges are relaxed by where they begin, so that a window of characters needs nothing of those behind it."""
    opens = np.r_[np.flatnonzero((text & 0xC0) != 0x80), len(text)]
    n, most = len(opens) - 1, int(model.find_len.max())
    last, back, known = [-2] * (n + 1), [0] * (n + 1), model.known_pairs
    for a in range(0, n, WINDOW):
        b = min(n, a + WINDOW)
        part = text[opens[a] : opens[b] + most]
        place, piece = occurrences(model, part, opens[a:b] - opens[a])
        end = place + opens[a] + model.find_len[piece]
        place, piece, end = place[end <= len(text)], piece[end <= len(text)], end[end <= len(text)]
        c, e = np.searchsorted(opens, place + opens[a]), np.searchsorted(opens, end)
        alone = np.setdiff1d(np.arange(a, b), c[e - c == 1])  # characters outside the vocabulary
        c, e, ident = np.r_[c, alone], np.r_[e, alone + 1], np.r_[model.find[piece], np.full(len(alone), -1)]
        by = np.argsort(c, kind="stable")
        for i, j, t2 in zip(c[by].tolist(), e[by].tolist(), ident[by].tolist(), strict=True):
            t1 = last[i]
            if i and t1 != -1 and t2 != -1:
                if t1 < 0:
                    continue
                pair = (t1 << 32) + t2
                ok = known.get(pair)
                if ok is None:
                    ok = known[pair] = model.stay(pair)
                if not ok:
                    continue
            last[j], back[j] = t2, i
    out, e = [], n
    while e:
        if last[e] == -2:
            raise ValueError("a word has no encoding")
        out += [last[e]] if last[e] >= 0 else model.byte_id[text[opens[back[e]] : opens[e]]][::-1].tolist()
        e = back[e]
    return out[::-1]


def _encode_new(model: PieceModel, text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """encode_words, with the long words by themselves."""
    size = np.diff(begin)
    long = np.flatnonzero(size >= LONG_WORD)
    if not len(long):
        return encode_words(model, text, begin)
    short = np.flatnonzero(size < LONG_WORD)
    n = size[short]
    src = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[short], n)
    ids, count = encode_words(model, text[src], np.r_[0, np.cumsum(n)])
    own = np.split(ids, np.cumsum(count)[:-1]) if len(count) else []
    out: list = [None] * len(size)
    for i, x in zip(short.tolist(), own, strict=True):
        out[i] = x
    for i in long.tolist():
        out[i] = np.array(encode_long(model, text[begin[i] : begin[i + 1]]), np.int32)
    return np.concatenate(out), np.array([len(x) for x in out])


def encode_texts(model: PieceModel, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts laid end to end, and the n + 1 offsets."""
    n = len(off) - 1
    raw = data.tobytes()
    mine = [raw[off[i] : off[i + 1]] for i in range(n)]
    if SPACE.encode() in raw:
        mine = [t.replace(SPACE.encode(), b" ") for t in mine]
    mine = [b" " + t if t else t for t in mine]  # the dummy prefix
    data = np.frombuffer(b"".join(mine), np.uint8)
    off = np.r_[0, np.cumsum([len(t) for t in mine])].astype(np.int64)
    if len(data) <= 2 * SLICE:
        return _encode_prefixed(model, data, off)
    # a very long text is encoded in parts, cut before spaces, where no piece goes on
    out, total = [np.zeros(0, np.int32)], [0]
    for i in range(n):
        text = data[off[i] : off[i + 1]]
        gap = text == 0x20
        cuts = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
        cuts = np.unique(cuts[np.minimum(np.searchsorted(cuts, np.arange(SLICE, len(text), SLICE)), len(cuts) - 1)]) if len(cuts) else cuts
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(text)], strict=True):
            out.append(_encode_prefixed(model, text[a:b], np.array([0, b - a]))[0])
        total.append(sum(map(len, out)))
    return np.concatenate(out), np.array(total, np.int64)


def _encode_prefixed(model: PieceModel, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    gap = data == 0x20
    start = gap.copy()
    start[1:] &= ~gap[:-1]
    start[off[:-1][off[:-1] < len(data)]] = True
    w0 = np.flatnonzero(start)  # a word: spaces, then other characters up to the next space
    w1 = np.r_[w0[1:], len(data)]
    solid = np.flatnonzero(~gap)
    at = np.searchsorted(solid, w0)
    body = np.minimum(np.r_[solid, len(data)][at], w1)
    run = body - w0
    core = np.where(body < w1, body - (run > 0), w1)  # one space goes with the word
    size = w1 - core
    kind, first, which = np.unique(word_hashes(data, core, size), return_index=True, return_inverse=True)
    if len(model.word_hash) > CACHED_WORDS or len(model.seen) > CACHED_BYTES:
        model.clear()
    if max(model.n_pairs, len(model.known_pairs)) > CACHED_PAIRS:
        model.clear_pairs()

    def encoded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n_b = size[rows]
        begin = np.r_[0, np.cumsum(n_b)]
        text = data[np.arange(int(begin[-1])) - np.repeat(begin[:-1], n_b) + np.repeat(core[rows], n_b)]
        return text, begin, *_encode_new(model, text, begin)

    have = model.word_hash
    new = kind[have[np.minimum(np.searchsorted(have, kind), len(have) - 1)] != kind] if len(have) else kind
    if len(new):
        text, begin, ids, count = encoded(first[np.searchsorted(kind, new)])
        into = np.searchsorted(have, new)
        model.word_hash = np.insert(have, into, new)
        model.word_at = np.insert(model.word_at, into, np.cumsum(count) - count + len(model.pool))
        model.word_n = np.insert(model.word_n, into, count)
        model.seen_at = np.insert(model.seen_at, into, begin[:-1] + len(model.seen))
        model.seen_n = np.insert(model.seen_n, into, np.diff(begin))
        model.pool, model.seen = np.concatenate([model.pool, ids]), np.concatenate([model.seen, text])
    row = np.searchsorted(model.word_hash, kind)[which]
    w_at, w_n, pool = model.word_at[row], model.word_n[row], model.pool
    # a word is the one that its hash names if it has the same bytes; any other is encoded for itself
    own = model.seen_n[row] == size
    own[own] = equal_bytes(data, core[own], model.seen, model.seen_at[row[own]], size[own])
    other = np.flatnonzero(~own)
    if len(other):
        _, _, ids, w_n[other] = encoded(other)
        w_at[other] = np.cumsum(w_n[other]) - w_n[other] + len(pool)
        pool = np.concatenate([pool, ids])
    extra = np.where(body < w1, np.maximum(run - 1, 0), run)
    lone = np.flatnonzero((extra > 0) & (body < w1))
    lone = lone[pool[w_at[lone]] == model.space]  # the word's own space stayed alone: it belongs to the run
    extra[lone] += 1
    w_at[lone] += 1
    w_n[lone] -= 1
    runs = {r: model.spaces(r) for r in np.unique(extra[extra > 0]).tolist()}
    s_at, s_n = np.zeros(len(extra), np.int64), np.zeros(len(extra), np.int64)
    for r, ids in runs.items():
        x = extra == r
        s_at[x], s_n[x] = len(pool), len(ids)
        pool = np.concatenate([pool, ids])
    a, m = np.stack([s_at, w_at], 1).ravel(), np.stack([s_n, w_n], 1).ravel()
    out = pool[np.repeat(a, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)]
    ends = np.r_[0, np.cumsum(s_n + w_n)]
    return out, ends[np.searchsorted(w0, off)]


def decode_ids(model: PieceModel, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts that ids encode, laid end to end without their dummy prefixes, and the offsets."""
    n = model.raw_len[ids]
    data = model.raw[np.repeat(model.raw_at[ids], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    ends = np.r_[0, np.cumsum(n)][off]
    drop = ends[:-1][np.diff(ends) > 0]
    keep = np.ones(len(data), bool)
    keep[drop] = data[drop] != 0x20
    return data[keep], np.r_[0, np.cumsum(keep)][ends]


_models: dict[int, PieceModel] = {}


def _model(proto: bytes) -> PieceModel:
    key = hash(proto)
    if key not in _models:
        _models[key] = PieceModel(proto)
    return _models[key]


def encode(df: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """Adds ids (array<int>), the library's encoding of the whole text, and round_trip: whether they decode to the text again.

    Null and empty texts have no ids. A literal U+2581 is the same as a space to the model, in the text it decodes to as well;
    apart from that every text comes back byte by byte. The model (fixed, under 1 MB) goes to every task. Repeated rows are encoded
    one by one; an empty table gives an empty table; columns named ids or round_trip are replaced. Very long texts are encoded in parts and
    very long words in linear time: a million letters without a space take some seconds.
    """
    df = df.drop("ids", "round_trip")
    with open(model, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared.value)
        for b, data, off in pieces(batches, text, SLICE):
            ids, at = encode_texts(m, data, off)
            back, ends = decode_ids(m, ids, at)
            raw, again = data.tobytes(), back.tobytes()
            if raw == again:
                same = [True] * (len(off) - 1)
            else:
                same = [raw[off[i] : off[i + 1]].replace(SPACE.encode(), b" ") == again[ends[i] : ends[i + 1]] for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at.astype(np.int32), ids), pa.array(same)], names=[*b.schema.names, "ids", "round_trip"])

    return df.mapInArrow(run, plus(df, "ids array<int>, round_trip boolean"))


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """Adds decoded, the text of each row's ids; null ids give an empty text. A column named decoded is replaced."""
    df = df.drop("decoded")
    with open(model, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared.value)
        for b in batches:
            lists = b.column(at)
            off = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
            data, ends = decode_ids(m, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), off)
            raw = data.tobytes()
            texts = pa.array([raw[a:z].decode("utf-8", "replace") for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, "decoded"])

    return df.mapInArrow(run, plus(df, "decoded string"))
