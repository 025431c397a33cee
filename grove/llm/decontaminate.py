"""Benchmark decontamination: SimHashes of item-sized windows, found through multi-index Hamming blocks, then compared exactly.

A window of a document that has as many words as an item is a leak of it when their weighted shingles (k words each, counted) are alike:
sum of the lesser counts over sum of the greater ones >= per_100 / 100. Only windows with enough shingles that stand in
some item can be, so the others are left out first, without a loss. The rest are fingerprinted; any fingerprint within
`radius` bits of an item's must agree with it, in one of BLOCKS blocks, in all but radius // BLOCKS bits, and the items
under all such block values are kept in a table, one for the items of each length. Candidates are then compared shingle by shingle, and what is
told as a leak by its very words. (At a radius of 23 of 64 bits a table can't leave out much: a print meets on average 1.16 entries for each
item of its window's length, seven in ten of these items. What spares work is that a window meets items of its own length only.)

A document with fewer words than an item has one window for it, the whole document. It is compared, without a fingerprint, with every
longer item that has one of its rarest shingles, of which there are enough that no item that is alike can lack all of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_WORD, U64, forget, mix, pieces, stored, texts, words

BLOCKS, BLOCK_BITS = 8, 8
#: Characters of items that go to every task at once; more items are searched for in further passes.
MOST_ITEM_CHARS = 4 << 20
REACH = 1 << 13  # places of a text whose windows are fingerprinted at once
CELLS = 1 << 18  # shingles of windows that are laid out at once


def simhashes(g: np.ndarray, s: np.ndarray, m: int) -> np.ndarray:
    """64-bit SimHash of each window of m shingle hashes g[s : s + m], for rising s; a shingle weighs as often as it comes.

    REACH places at a time: where windows lie close, bits are summed along the text, so that those that overlap share the work;
    where they are few, each is summed by itself.
    """
    out = np.empty(len(s), U64)
    pack = lambda ones: np.packbits(2 * ones > m, axis=1).view(U64).ravel()
    bits = lambda part: np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(*part.shape, 8), axis=-1)
    x = 0
    while x < len(s):
        y = int(np.searchsorted(s, s[x] + REACH))
        if (y - x) * m < s[y - 1] + m - s[x]:
            for z in range(x, y, max(1, CELLS // m)):
                at = s[z : min(y, z + max(1, CELLS // m))]
                out[z : z + len(at)] = pack(bits(g[at[:, None] + np.arange(m)[None, :]]).sum(1, dtype=np.int32))
        else:
            part = g[s[x] : s[y - 1] + m]
            total = np.zeros((len(part) + 1, 64), np.int32)
            np.cumsum(bits(part), axis=0, dtype=np.int32, out=total[1:])
            at = s[x:y] - s[x]
            out[x:y] = pack(total[at + m] - total[at])
        x = y
    return out


def simhash(grams: np.ndarray) -> np.ndarray:
    """The same of each row of a matrix."""
    return simhashes(np.ascontiguousarray(grams).ravel(), np.arange(len(grams)) * grams.shape[1], grams.shape[1])


class HammingIndex:
    """Items by every value that each of their fingerprints' blocks takes within radius // BLOCKS bits."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        near = radius // BLOCKS
        flips = np.array([sum(1 << b for b in c) for n in range(near + 1) for c in combinations(range(BLOCK_BITS), n)])
        self.tables = []
        for block in range(BLOCKS):
            value = self._block(prints, block)
            key = (value[:, None] ^ flips[None, :]).ravel()
            item = np.repeat(np.arange(len(prints), dtype=np.int32), len(flips))
            by = np.argsort(key, kind="stable")
            self.tables.append((item[by], np.searchsorted(key[by], np.arange((1 << BLOCK_BITS) + 1))))

    @staticmethod
    def _block(prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> U64(block * BLOCK_BITS)) & U64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (row of prints, item, distance) within the radius; some prints at a time, so that memory is bounded."""
        keys, step, n_items = [np.zeros(0, np.int64)], max(1, (1 << 21) // max(1, len(self.prints))), max(1, len(self.prints))
        for x in range(0, len(prints), step):
            part, found = prints[x : x + step], []
            for block, (item, cut) in enumerate(self.tables):
                v = self._block(part, block)
                n = cut[v + 1] - cut[v]
                row = np.repeat(np.arange(len(part)), n)
                at = np.repeat(cut[v], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                near = np.bitwise_count(part[row] ^ self.prints[item[at]]) <= self.radius
                found.append((row[near] + x) * n_items + item[at][near])
            keys.append(np.unique(np.concatenate(found)))
        key = np.concatenate(keys)
        row, item = key // n_items, key % n_items
        return row, item, np.bitwise_count(prints[row] ^ self.prints[item]).astype(np.int64)


def numbered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of a matrix in order, and for each value the number of equal ones before it in its row."""
    rows = np.sort(rows, axis=1)
    place = np.broadcast_to(np.arange(rows.shape[1]), rows.shape)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    return rows, place - np.maximum.accumulate(np.where(new, place, 0), axis=1)


class Items:
    """The items of one length: their ids, shingles by number, counted, and fingerprints."""

    def __init__(self, ids: list[int], grams: np.ndarray, per_100: int, radius: int):
        self.ids, self.m = ids, grams.shape[1]
        self.need = -(-2 * per_100 * self.m // (100 + per_100))  # of m shingles each, so many must be shared
        self.index = HammingIndex(simhash(grams), radius)

    def number(self, known: np.ndarray, grams: np.ndarray) -> None:
        """Keys of (item, shingle's place in known, which of equal ones), in order."""
        code, nth = numbered(np.searchsorted(known, grams))
        self.width = (len(known) + 1) * self.m
        self.keys = np.sort((np.arange(len(code))[:, None] * self.width + code * self.m + nth).ravel())

    def shared(self, code: np.ndarray, s: np.ndarray, item: np.ndarray) -> np.ndarray:
        """How many shingles, counted, each window code[s : s + m] has in common with the item."""
        out, step = np.empty(len(s), np.int64), max(1, CELLS // self.m)
        for x in range(0, len(s), step):
            own, nth = numbered(code[s[x : x + step, None] + np.arange(self.m)[None, :]])
            key = item[x : x + step, None] * self.width + own * self.m + nth
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[x : x + step] = ((self.keys[at] == key) & (own >= 0)).sum(1)
        return out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on, as far as there are k (across texts as well)."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, k, U64)
    for j in range(k):
        out = mix(out * U64(0x9FB21C651E98DF25) + h[j : j + n])
    return out


class Benchmark:
    """The items by length in words, with the shingles of all of them."""

    def __init__(self, ids: list[int], item_texts: list[str | None], k: int, per_100: int, radius: int):
        h, _, _, first = words(*texts(pa.array(item_texts, pa.string())), NOT_WORD)
        n = np.diff(first)
        self.k, self.per_100 = k, per_100
        self.text: dict[int, list[str | None]] = {}
        for i, t in zip(ids, item_texts, strict=True):
            self.text.setdefault(i, []).append(t)
        self.lengths: dict[int, tuple[int, Items]] = {}
        self.items: list[tuple[int, int]] = []  # (length, place under it) of items of k words or more
        grams: dict[int, list] = {}
        laid: dict[int, np.ndarray] = {}
        every, whose = [np.zeros(0, U64)], [np.zeros(0, np.int32)]
        for length in np.unique(n[n > 0]).tolist():
            size = min(k, length)
            rows = np.flatnonzero(n == length)
            g = laid[length] = np.stack([runs(h[first[r] : first[r + 1]], size) for r in rows])
            self.lengths[length] = (size, Items([ids[r] for r in rows], g, per_100, radius))
            grams.setdefault(size, []).append(np.unique(g))
            if size == k:
                every.append(g.ravel())
                whose.append(np.repeat(np.arange(len(self.items), len(self.items) + len(rows), dtype=np.int32), length - size + 1))
                self.items += [(length, x) for x in range(len(rows))]
        self.grams = {s: np.unique(np.concatenate(g)) for s, g in grams.items()}
        for length, (size, items) in self.lengths.items():
            items.number(self.grams[size], laid[length])
        every, whose = np.concatenate(every), np.concatenate(whose)
        by = np.argsort(every, kind="stable")
        self.whose = whose[by]  # the items of each of self.grams[k], from cut to cut
        self.cut = np.r_[np.searchsorted(every[by], self.grams.get(k, every[:0])), len(by)]
        self.shingles = np.array([length - k + 1 for length, _ in self.items], np.int64)
        self.filters = {}
        for s, g in self.grams.items():
            bits = max(20, int(16 * len(g)).bit_length())
            table = np.zeros(1 << bits, bool)
            table[(g >> U64(64 - bits)).astype(np.int64)] = True
            self.filters[s] = (bits, table)

    def _whole(self, g: np.ndarray, hit: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item id, similarity, distance, words) of each text and item with more words than it that are alike.

        g has the k-word shingles of the texts, of which those at hit stand in some item.
        """
        p, grams = self.per_100, self.grams[self.k]
        text = np.searchsorted(first, hit, "right") - 1
        words_of = np.diff(first)
        known = np.bincount(text[hit + self.k <= first[text + 1]], minlength=len(words_of))
        m_of = words_of - self.k + 1
        for t in np.flatnonzero((known > 0) & ((100 + p) * known >= p * (2 * m_of + 1))).tolist():
            m = int(m_of[t])
            own = g[first[t] : first[t] + m]
            place = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            n = np.where(grams[place] == own, self.cut[place + 1] - self.cut[place], 0)
            need = -(-p * (2 * m + 1) // (100 + p))  # an item with one shingle more must share so many
            rare = np.argsort(n, kind="stable")[: m - need + 1]
            near = [self.whose[self.cut[x] : self.cut[x + 1]] for x in np.unique(place[rare[n[rare] > 0]])]
            if not near:
                continue
            near = np.unique(np.concatenate(near))
            near = near[(self.shingles[near] > m) & (p * self.shingles[near] <= 100 * m)]
            printed = simhash(own[None, :])[0]
            mine, nth = (v[0] for v in numbered(np.where(grams[place] == own, place, -1)[None, :]))
            for x in near.tolist():
                length, r = self.items[x]
                items = self.lengths[length][1]
                key = (r * items.width + mine * items.m + nth)[(mine >= 0) & (nth < items.m)]
                at = np.minimum(np.searchsorted(items.keys, key), len(items.keys) - 1)
                shared = int((items.keys[at] == key).sum())
                total = m + int(self.shingles[x]) - shared
                if 100 * shared >= p * total:
                    yield t, items.ids[r], shared / total, int(np.bitwise_count(printed ^ items.index.prints[r])), int(words_of[t])

    def _windows(self, hit: np.ndarray, items: Items, length: int, first: np.ndarray) -> np.ndarray:
        """Places whose window of `length` words, within one text, has enough shingles at `hit` to be alike to an item."""
        m, need = items.m, items.need
        if len(hit) < need:
            return hit[:0]
        a, b = hit[: len(hit) - need + 1], hit[need - 1 :]
        ok = b - a < m
        low, high = np.maximum(b[ok] - m + 1, 0), a[ok]
        if not len(low):
            return hit[:0]
        begin = np.flatnonzero(np.r_[True, low[1:] > high[:-1] + 1])  # both only rise: ranges that meet are one
        low, high = low[begin], high[np.r_[begin[1:] - 1, len(high) - 1]]
        n = high - low + 1
        s = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        text = np.searchsorted(first, s, "right") - 1
        return s[s + length <= first[np.minimum(text + 1, len(first) - 1)]]

    def _best(self, s: np.ndarray, item: np.ndarray, text: np.ndarray, hit: np.ndarray, code: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """Of the candidates (window, item), for each text and item the one that shares most, the first of equal ones: (row, shared).

        No window shares more than it has hits; so each pair's windows are compared from the most hits on, one, then four and so on, until
        the next can't be better.
        """
        most = np.searchsorted(hit, s + items.m) - np.searchsorted(hit, s)
        by = np.lexsort((s, -most, item, text))
        new = np.r_[True, (text[by][1:] != text[by][:-1]) | (item[by][1:] != item[by][:-1])]
        begin = np.flatnonzero(new)
        end = np.r_[begin[1:], len(by)]
        best, row = np.zeros(len(begin), np.int64), by[begin]
        live, at, step = np.arange(len(begin)), begin.copy(), 1
        while len(live):
            n = np.minimum(step, end[live] - at[live])
            group = np.repeat(live, n)
            x = by[np.repeat(at[live], n) + np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)]
            able = (most[x] > best[group]) | ((most[x] == best[group]) & (s[x] < s[row[group]]))
            group, x = group[able], x[able]
            got = items.shared(code, s[x], item[x])
            o = np.lexsort((s[x], -got, group))
            lead = o[np.flatnonzero(np.r_[True, group[o][1:] != group[o][:-1]])] if len(o) else o
            better = (got[lead] > best[group[lead]]) | ((got[lead] == best[group[lead]]) & (s[x[lead]] < s[row[group[lead]]]))
            lead = lead[better]
            best[group[lead]], row[group[lead]] = got[lead], x[lead]
            at[live] += n
            live = live[at[live] < end[live]]
            live = live[most[by[at[live]]] >= best[live]]
            step *= 4
        return row, best

    def _by_words(self, data: np.ndarray, off: np.ndarray, item: int, size: int) -> float:
        """Similarity of the words of a passage to those of the item (of several with that id, the most alike), byte for byte."""

        def counted(data: np.ndarray, off: np.ndarray) -> Counter:
            _, start, end, _ = words(data, off, NOT_WORD)
            raw = LOWER[data].tobytes()
            own = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            return Counter(tuple(own[x : x + size]) for x in range(len(own) - size + 1))

        seen = counted(data, off)
        want = [counted(*texts(pa.array([t], pa.string()))) for t in self.text[item]]
        return max(sum((seen & w).values()) / max(1, sum((seen | w).values())) for w in want)

    def leaks(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, float, int]]:
        """(text, item id, first word, words, similarity, distance) of each text's best window for each item it leaks."""
        h, start, end, first = words(data, off, NOT_WORD)
        best: dict = {}
        for size, grams in self.grams.items():
            g = runs(h, size)
            bits, table = self.filters[size]
            hit = np.flatnonzero(table[(g >> U64(64 - bits)).astype(np.int64)])
            place = np.minimum(np.searchsorted(grams, g[hit]), len(grams) - 1)
            on = grams[place] == g[hit]
            hit, place = hit[on], place[on]
            if not len(hit):
                continue
            code = np.full(len(g), -1, np.int64)  # the number of each shingle among the items'
            code[hit] = place
            if size == self.k:
                for t, i, sim, d, n in self._whole(g, hit, first):
                    best[t, i] = max((sim, 0, d, n), best.get((t, i), (0.0, 0, 0, 0)))
            for length, (own, items) in self.lengths.items():
                s = self._windows(hit, items, length, first) if own == size else hit[:0]
                if not len(s):
                    continue
                near, item, distance = items.index.find(simhashes(g, s, items.m))
                if not len(near):
                    continue
                s = s[near]
                text = np.searchsorted(first, s, "right") - 1
                row, shared = self._best(s, item, text, hit, code, items)
                for r, n in zip(row.tolist(), shared.tolist(), strict=True):
                    if 100 * n >= self.per_100 * (2 * items.m - n):
                        t, i = int(text[r]), items.ids[item[r]]
                        new = (n / (2 * items.m - n), -int(s[r] - first[t]), int(distance[r]), length)
                        best[t, i] = max(new, best.get((t, i), new))
        out = []
        for (t, i), (sim, at, d, n) in sorted(best.items()):
            a, b = start[first[t] - at], end[first[t] - at + n - 1]
            if 100 * self._by_words(data[a:b], np.array([0, b - a]), i, min(self.k, n)) >= self.per_100 - 1e-9:
                out.append((t, i, -at, n, sim, d))
        return out


def _benchmarks(items: DataFrame, item_id: str, text: str, k: int, per_100: int, radius: int) -> Iterator:
    """The items as broadcasts of at most MOST_ITEM_CHARS each (or of one longer item), each made when it is asked for, and how many there are."""
    spark = items.sparkSession
    items = items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).filter("i is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = 1 + chars // MOST_ITEM_CHARS
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()  # one block of the stated size
        yield blocks, spark.sparkContext.broadcast(Benchmark([r.i for r in rows], [r.t for r in rows], k, per_100, radius))


def find_leaks(docs: DataFrame, items: DataFrame, k: int = 5, per_100: int = 80, radius: int = 23, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row and item it leaks: doc_id, item_id, first_word, n_words, similarity, distance (of the best window).

    A document with fewer words than an item is compared with it as a whole: first_word is 0 and n_words the document's number of words.
    Words are runs of letters and digits (A-Z lower-cased), so punctuation doesn't matter. Of equal windows the first is told. Items
    under k words are one shingle and must stand in the text as they are; items without words, with null text or null id match
    nothing. Null and empty documents leak nothing; repeated rows are told each; a null doc_id stays null. Empty tables give none; other
    columns, whatever their names, are ignored. A very long text is read whole in one task, its windows some at a time.
    A similarity of exactly 0.8 makes fingerprints differ in 8.7 to 9.6 of 64 bits, with a deviation of 2.7 to 2.9 (items of 13 to 184 words,
    random shingle hashes); of such windows radius 23 missed 1 to 5 in a million, where radius 20 would miss 0.7 to 2.9 in 10,000.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = "doc_id long, item_id long, first_word long, n_words long, similarity double, distance long"

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, data, off in pieces(batches, "text"):
                found = shared.value.leaks(data, off)
                ids = b.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                rest = [pa.array([f[j] for f in found], kind) for j, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64()), (5, pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "item_id", "first_word", "n_words", "similarity", "distance"])

        return docs.mapInArrow(run, schema)

    out = []
    for blocks, shared in _benchmarks(items, item_id, item_text, k, per_100, radius):
        out.append(search(shared))
        if blocks > 1:  # one pass after the other, so that no more than one block of items is held
            out[-1] = stored(out[-1])
            shared.destroy()
    return reduce(DataFrame.unionByName, out)


def drop_leaks(docs: DataFrame, items: DataFrame, k: int = 5, per_100: int = 80, radius: int = 23, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that leak no item, judged as by find_leaks, without a shuffle. More than one block of items: one pass after the other."""
    for blocks, shared in _benchmarks(items, item_id, item_text, k, per_100, radius):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b, data, off in pieces(batches, text):
                keep = np.ones(b.num_rows, bool)
                keep[[f[0] for f in shared.value.leaks(data, off)]] = False
                yield b.filter(pa.array(keep))

        left = docs.mapInArrow(run, docs.schema)
        if blocks > 1:
            left = stored(left)
            shared.destroy()
            forget(docs)
        docs = left
    return docs
