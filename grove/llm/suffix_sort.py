"""Suffix sorting by difference covers, for one bucket of suffixes at a time.

A difference cover D modulo V holds, for any two residues, a shift k < V that takes both into D. Suffixes at positions whose
residue is in D form the sample, which is ranked first. Other suffixes are then sorted by their first V bytes only, and
longer ties are settled by the ranks that both have after their common shift. Memory is bounded by the bucket.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
V = 31
COVER = [1, 5, 11, 24, 25, 27]  # a perfect difference set modulo 31 (fixed values)
_in = np.zeros(V, bool)
_in[COVER] = True
#: SHIFT[a, b]: the least k with (a + k) and (b + k) in the cover
SHIFT = np.array([[next(k for k in range(V) if _in[(a + k) % V] and _in[(b + k) % V]) for b in range(V)] for a in range(V)])


class Words:
    """Big-endian 8-byte words at any position of a text, which is padded with zeros for depths of up to 1,000 bytes."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        self.buffer = np.concatenate([text, np.zeros(2 * V + 1024, np.uint8)])
        self.view = np.ndarray((len(self.buffer) - 7,), ">u8", self.buffer, strides=(1,))

    def at(self, pos: np.ndarray, depth: int) -> list[np.ndarray]:
        """The first `depth` bytes of each suffix as words, the last one masked."""
        out = []
        for j in range(0, depth, 8):
            w = self.view[pos + j].astype(U64)
            left = min(8, depth - j)
            out.append(w if left == 8 else w & ~U64((1 << (8 * (8 - left))) - 1))
        return out


def _changes(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Whether each suffix differs from the one before it in order."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return new


def sample_ranks(words: Words, depth: int) -> np.ndarray:
    """Rank of the sample's suffixes by their first `depth` bytes; -1 elsewhere."""
    pos = np.flatnonzero(np.resize(_in, words.n + V))
    keys = words.at(pos, depth)
    order = np.lexsort(keys[::-1])
    rank = np.full(words.n + 2 * V, -1, np.int64)
    rank[pos[order]] = np.cumsum(_changes(keys, order))
    return rank


def sort_suffixes(text: np.ndarray, pos: np.ndarray, depth: int, words: Words | None = None) -> np.ndarray:
    """The order of the suffixes at pos by their first `depth` bytes (or more)."""
    words = words or Words(text)
    head = words.at(pos, min(depth, V))
    order = np.lexsort(head[:2][::-1])
    if len(head) > 2:  # the other words matter only where the first two tie
        group = np.cumsum(_changes(head[:2], order)) - 1
        tie = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else group
        rows = order[tie]
        order[tie] = rows[np.lexsort([*(h[rows] for h in head[:1:-1]), group[tie]])]
    if depth <= V or len(pos) < 2:
        return order
    group = np.cumsum(_changes(head, order)) - 1
    rank = sample_ranks(words, depth)
    # ties: quicksort of all groups at once, with one pivot each
    active = np.flatnonzero(np.bincount(group)[group] > 1)
    while len(active):
        g = group[active]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[first, len(g)])
        own = pos[order[active]]
        pivot = np.repeat(own[first + size // 2], size)
        k = SHIFT[own % V, pivot % V]
        side = np.sign(rank[own + k] - rank[pivot + k])
        block = np.repeat(np.arange(len(first)), size)
        key = block * 3 + side + 1
        by = np.argsort(key, kind="stable")
        order[active] = order[active][by]
        key = key[by]
        edge = np.r_[True, key[1:] != key[:-1]]
        n = np.diff(np.r_[np.flatnonzero(edge), len(key)])
        group[active] = np.cumsum(edge) - 1
        active = active[(key % 3 != 1) & (np.repeat(n, n) > 1)]
    return order


def equal_runs(text: np.ndarray, pos: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and, along it, the number of the class of suffixes with the same first `depth` bytes."""
    words = Words(text)
    order = sort_suffixes(text, pos, depth, words)
    return order, np.cumsum(_changes(words.at(pos, depth), order)) - 1
