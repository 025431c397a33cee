"""Exact top-k inner products by best-first search of M-trees: paged metric nodes with covering radii and parent distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import width

PAGE = 256
FAN = 16
BLOCK = 4096  # queries that go down a tree together
BANDS = 16
SLACK = 1e-6  # relative, for the rounding of distances
EXACT = 2.0**53  # up to which sums of products of whole numbers are exact in doubles


class MTree:
    """Over points that carry one more coordinate, sqrt(m2 - |x|^2): then all have the same norm, and the nearest point has the
    largest inner product. m2 is the largest squared norm of the tree's own points."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        norms = np.einsum("ij,ij->i", x, x)
        self.ids, self.x, self.m2 = ids, x, float(norms.max(initial=0.0))
        self.lift = np.sqrt(np.maximum(self.m2 - norms, 0))
        self.computed = 0
        self.leaves: list[dict] = []
        self.root = self._node(np.arange(len(ids)), 0) if len(ids) else None

    def _between(self, a: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.m2 - 2 * (self.x[rows] @ self.x[a] + self.lift[rows] * self.lift[a]), 0))

    def _node(self, rows: np.ndarray, pivot: int) -> dict:
        d = self._between(pivot, rows)
        node = {"pivot": pivot, "radius": d.max(initial=0.0)}
        if len(rows) <= PAGE:
            order = np.argsort(d, kind="stable")
            node |= {"leaf": len(self.leaves), "rows": rows[order], "x": self.x[rows[order]], "parent": d[order]}
            self.leaves.append(node)
            return node
        if node["radius"] <= SLACK * (1 + np.sqrt(self.m2)):  # copies of one point: no pivot tells them apart
            groups = [(pivot, part) for part in np.array_split(rows, -(-len(rows) // PAGE))]
        else:
            fan = int(np.clip(2 * len(rows) // PAGE, 2, FAN))
            seeds, near, nearest = [], np.zeros(len(rows), np.int64), d.copy()
            for s in range(fan):  # pivots far apart: each is the point farthest from those before it
                seeds.append(rows[nearest.argmax()])
                own = self._between(seeds[-1], rows)
                closer = own < nearest if s else np.ones(len(rows), bool)
                near[closer], nearest[closer] = s, own[closer]
            groups = [(s, rows[near == i]) for i, s in enumerate(seeds) if (near == i).any()]
            if len(groups) == 1:
                groups = [(pivot, part) for part in np.array_split(rows, -(-len(rows) // PAGE))]
        children = [self._node(part, s) for s, part in groups]
        return node | {"children": children, "parent": self._between(pivot, np.array([c["pivot"] for c in children])), "radii": np.array([c["radius"] for c in children])}

    def _distances(self, q: np.ndarray, qq: np.ndarray, rows: np.ndarray) -> np.ndarray:
        self.computed += len(q) * len(rows)
        return np.sqrt(np.maximum(qq[:, None] + self.m2 - 2 * (q @ self.x[rows].T), 0))

    def _bounds(self, q: np.ndarray, qq: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least distance that each leaf may hold for each query (inf where it can't be under `far`), and distances to the leaves' pivots."""
        low, to_pivot = np.full((len(q), len(self.leaves)), np.inf), np.zeros((len(q), len(self.leaves)))
        start = self._distances(q, qq, np.array([self.root["pivot"]]))[:, 0]
        stack = [(self.root, np.arange(len(q)), start, np.maximum(start - self.root["radius"], 0))]
        while stack:
            node, at, d, bound = stack.pop()
            on = bound <= far[at]
            at, d, bound = at[on], d[on], bound[on]
            if not len(at):
                continue
            if "leaf" in node:
                low[at, node["leaf"]], to_pivot[at, node["leaf"]] = bound, d
                continue
            for child, between, radius in zip(node["children"], node["parent"], node["radii"], strict=True):
                stored = np.maximum(np.abs(d - between) - radius, bound)  # without computing a distance
                go = np.flatnonzero(stored <= far[at])
                if len(go):
                    own = self._distances(q[at[go]], qq[at[go]], np.array([child["pivot"]]))[:, 0]
                    stack.append((child, at[go], own, np.maximum(own - radius, stored[go])))
        return low, to_pivot

    def _descend(self, q: np.ndarray, qq: np.ndarray) -> np.ndarray:
        """The leaf that each query comes to by the nearest child of each node."""
        leaf, stack = np.zeros(len(q), np.int64), [(self.root, np.arange(len(q)))]
        while stack:
            node, at = stack.pop()
            if "leaf" in node:
                leaf[at] = node["leaf"]
                continue
            near = self._distances(q[at], qq[at], np.array([c["pivot"] for c in node["children"]])).argmin(1)
            stack += [(c, at[near == i]) for i, c in enumerate(node["children"]) if (near == i).any()]
        return leaf

    def search(self, q: np.ndarray, own: np.ndarray, k: int, whole: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list]:
        """(row of q, id, score) of the k best points for each query, other than those of its own id: highest inner product, ties to the smaller id.

        All queries visit their leaves in the order of the least distances these may hold, one leaf, then two, four and so on, until the
        next may hold nothing nearer than the k-th best. With `whole`, the unscaled points and queries, scores beyond what
        doubles hold are made of whole numbers: the doubles only say which points may be among the best.
        """
        n = len(q)
        if not n or not self.root or k < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), []
        qq = np.einsum("ij,ij->i", q, q)
        best_s, best_i = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        exact: list = [[] for _ in range(n)] if whole else []
        blur = 1e-9 * np.sqrt(qq * self.m2) if whole else np.zeros(n)

        def far(at: np.ndarray) -> np.ndarray:
            with np.errstate(invalid="ignore"):
                d = np.sqrt(np.maximum(qq[at] + self.m2 - 2 * (best_s[at, -1] - blur[at]), 0))
            return np.where(np.isfinite(best_s[at, -1]), d + SLACK * (1 + np.sqrt(self.m2 + qq[at])), np.inf)

        def visit(leaf: dict, at: np.ndarray, d: np.ndarray | None) -> None:
            lo, hi = 0, len(leaf["rows"])
            if d is not None:  # distances to the pivot are stored in order: the rest can't be near enough for any of these queries
                reach = far(at)
                lo, hi = np.searchsorted(leaf["parent"], [(d - reach).min(), (d + reach).max()], side="left")
                hi = min(hi + 1, len(leaf["rows"]))
            if lo >= hi:
                return
            s = q[at] @ leaf["x"][lo:hi].T
            self.computed += s.size
            ids = self.ids[leaf["rows"][lo:hi]]
            i, j = np.nonzero((s >= (best_s[at, -1] - 2 * blur[at])[:, None]) & (ids[None, :] != own[at][:, None]))
            if whole:
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    r = at[x]
                    exact[r].append((-sum(int(a) * int(b) for a, b in zip(whole[1][r], whole[0][leaf["rows"][lo + y]], strict=True)), int(ids[y]), float(s[x, y])))
                    if len(exact[r]) >= 2 * k + 8:
                        exact[r] = sorted(exact[r])[:k]
                for r in at[np.unique(i)]:
                    exact[r] = sorted(exact[r])[:k]
                    if len(exact[r]) == k:
                        best_s[r, -1] = exact[r][-1][2]
                return
            some, i = np.unique(i, return_inverse=True)
            rows = at[some]
            row = np.r_[i, np.repeat(np.arange(len(rows)), k)]
            score, ident = np.r_[s[some[i], j], best_s[rows].ravel()], np.r_[ids[j], best_i[rows].ravel()]
            by = np.lexsort((ident, -score, row))
            first = np.searchsorted(row[by], np.arange(len(rows)))
            keep = by[first[:, None] + np.arange(k)[None, :]]
            best_s[rows], best_i[rows] = score[keep], ident[keep]

        def by_leaf(leaf_of: np.ndarray, at: np.ndarray, to_pivot: np.ndarray | None) -> None:
            by = np.argsort(leaf_of, kind="stable")
            cut = np.searchsorted(leaf_of[by], np.arange(len(self.leaves) + 1))
            for x in np.flatnonzero(np.diff(cut)):
                rows = at[by[cut[x] : cut[x + 1]]]
                visit(self.leaves[x], rows, None if to_pivot is None else to_pivot[rows, x])

        home = self._descend(q, qq)
        by_leaf(home, np.arange(n), None)
        low, to_pivot = self._bounds(q, qq, far(np.arange(n)))
        low[np.arange(n), home] = np.inf
        order = np.argsort(low, axis=1, kind="stable")
        done, step, live = 0, 1, np.arange(n)
        while len(live) and done < len(self.leaves):
            leaf = order[live, done : done + step]
            near = low[live[:, None], leaf] <= far(live)[:, None]
            x, y = np.nonzero(near)
            by_leaf(leaf[x, y], live[x], to_pivot)
            live, done, step = live[near[:, -1]], done + step, 2 * step
        if whole:
            found = [(r, i, -s) for r in range(n) for s, i, _ in sorted(exact[r])[:k]]
            return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64), [f[2] for f in found]
        held = np.isfinite(best_s)
        return np.repeat(np.arange(n), held.sum(1)), best_i[held], best_s[held].astype(np.int64)


def whole_components(c: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as a double; from 2**52 on every double is whole."""
    return F.transform(F.transform(c, lambda v: v.cast("double") * scale), lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v))


def search_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256, part_rows: tuple[int, int] = (4096, 50_000), query_rows: int = 20_000) -> DataFrame:
    """The k highest inner products of each query with all vectors but the row(s) of its own id: query_id, rank, vec_id, score.

    Components become floor(scale * x). Vectors that are null, or hold null or non-finite components (also once scaled), take no part on
    either side; shorter vectors count as padded with zeros; fewer than k candidates give fewer rows; repeated candidate rows count one
    by one, and a query id that comes more than once is answered once. Empty tables give no rows; other columns are ignored. Scores are
    exact and ranked as such however large components are; one beyond a long is told as the nearest long.
    Candidates are dealt by bands of norm, and within a band by hashed id, into parts of `part_rows` (least, most) or so, one M-tree each.
    A task holds one part and one chunk of at most `query_rows` queries or so, whatever the tables' sizes; the parts' k best are ranked.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    take = lambda df: df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), whole_components(F.col(f"`{embedding}`"), scale).alias("v")).filter(sound & F.col("id").isNotNull())
    points, asked = take(vectors), take(queries).dropDuplicates(["id"])
    widest = F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0.0))
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    cuts, top, dim, n = points.agg(F.percentile_approx(norm, [i / BANDS for i in range(1, BANDS)]), F.max(widest), F.max(F.size(v)), F.count("*")).first()
    top_q, dim_q, n_q = asked.agg(F.max(widest), F.max(F.size(v)), F.count("*")).first()
    dim, top, top_q = max(dim or 0, dim_q or 0), top or 0.0, top_q or 0.0
    chunks = max(1, -(-n_q // query_rows))
    # a band of norms has as many parts as its rows need; few rows are one band
    banded = n > BANDS * part_rows[0]
    cut = F.array(*[F.lit(c) for c in sorted(set(cuts or ()))]) if banded else F.array().cast("array<double>")
    band = F.size(F.filter(cut, lambda c: c < norm))
    rows_of = {r["band"]: r["n"] for r in points.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()} if banded else {0: n}  # at most BANDS rows
    parts = [max(1, -(-rows_of.get(b, 0) // part_rows[1]), min(-(-width(spark) // len(rows_of)), rows_of.get(b, 0) // part_rows[0])) for b in range(max([*rows_of, 0]) + 1)]
    first = [sum(parts[:b]) for b in range(len(parts))]
    at = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("band") + 1)
    dealt = points.withColumn("band", band).select((at(first) + F.pmod(F.xxhash64("id"), at(parts))).cast("int").alias("part"), "id", "v")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = dealt.select("part", every(chunks).alias("chunk"), F.lit(False).alias("asks"), "id", "v").unionByName(
        asked.select(F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), "id", "v").select(every(sum(parts)).alias("part"), "chunk", F.lit(True).alias("asks"), "id", "v")
    )
    beyond = dim * top * top_q >= EXACT
    down = 2.0 ** -np.frexp(max(top, top_q))[1] if max(top, top_q) > 1e100 else 1.0  # keeps squares finite

    def search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        lists = t.column("v").combine_chunks()
        n_of = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        raw = np.zeros((len(n_of), dim))
        row = np.repeat(np.arange(len(n_of)), n_of)
        raw[row, np.arange(len(row)) - np.repeat(np.cumsum(n_of) - n_of, n_of)] = lists.flatten().to_numpy()
        asks, ids = t.column("asks").to_numpy(), t.column("id").to_numpy()
        points, wanted, names = raw[~asks], raw[asks], ids[asks]
        tree = MTree(ids[~asks], points * down)
        out = []
        for x in range(0, len(names), BLOCK):
            b = slice(x, x + BLOCK)
            r, i, s = tree.search(wanted[b] * down, names[b], k, (points, wanted[b]) if beyond else None)
            keys = [(v + (1 << 2199)).to_bytes(276, "big") if beyond else None for v in s] if beyond else [None] * len(i)
            out.append((names[b][r], i, np.array([min(max(v, -(1 << 63)), (1 << 63) - 1) for v in s], np.int64) if beyond else s, keys))
        get = lambda c, kind: np.concatenate([o[c] for o in out]) if out else np.zeros(0, kind)
        return pa.table({"query_id": pa.array(get(0, np.int64).astype(np.int64)), "vec_id": pa.array(get(1, np.int64)), "score": pa.array(get(2, np.int64)), "key": pa.array([x for o in out for x in o[3]], pa.binary())})

    near = rows.groupBy("part", "chunk").applyInArrow(search, "query_id long, vec_id long, score long, key binary")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("key"), F.desc("score"), "vec_id"))
    return near.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
