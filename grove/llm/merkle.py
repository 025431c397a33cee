"""Merkle manifest of a table: leaves by group, a tree over each group, one over the groups' roots, and a proof of every row.

  1. Leaves are digests of whole rows, made in the JVM and stored beside the rows' order. Ranges of that order, and the counts of each group
     in each range, give every leaf its place in its group; no window runs over a group.
  2. Trees are built from aligned blocks of FANOUT ** STEP nodes, so that a hot group is many blocks. A block's digests are a contiguous
     matrix of hex characters, FANOUT neighbours are a row of it, and rows are hashed level by level. What a block ends in
     is a node of the next round; rounds are few (3 for 10**10 leaves) and known from the largest group's count.
  3. On the way down, each block gets the path above it, once. Every sibling of its nodes stands at a computed place of its matrices.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, spread, stored, width

FANOUT = 16
STEP = 3
BLOCK = FANOUT**STEP
TASK_ROWS = 1 << 16  # nodes whose blocks share a task
HEX = 64
PATH = "array<struct<before:string,after:string>>"
PATHS = f"tree long, place long, subroot string, root string, path {PATH}"


def digest_rows(level: np.ndarray) -> np.ndarray:
    """The digests of each FANOUT rows of a matrix of hex digests; the last run may have fewer."""
    whole = len(level) // FANOUT
    runs = [bytes(row) for row in level[: whole * FANOUT].reshape(whole, FANOUT * HEX)]
    if whole * FANOUT < len(level):
        runs.append(level[whole * FANOUT :].tobytes())
    return np.frombuffer("".join(sha256(run).hexdigest() for run in runs).encode(), np.uint8).reshape(-1, HEX)


def matrix(digests: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, HEX)


def levels(leaves: np.ndarray, total: int) -> list[np.ndarray]:
    """A block's matrices from its nodes up to the one it ends in; total: nodes of the whole tree at this height, whose depth all blocks share."""
    out = [leaves]
    for _ in range(min(STEP, depth(total))):
        out.append(digest_rows(out[-1]))
    return out


def depth(nodes: int) -> int:
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // FANOUT), n + 1
    return n


def beside(level: bytes, i: int) -> tuple[bytes, bytes]:
    """Digests of the run of node i that stand before and after it, by their places alone."""
    first = i - i % FANOUT
    return level[HEX * first : HEX * i], level[HEX * (i + 1) : HEX * (first + FANOUT)]


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for before, after in path:
        digest = sha256(before + digest + after).hexdigest().encode()
    return digest


def blocks_of(t: pa.Table) -> list[np.ndarray]:
    """The rows of each block of a task's table, in the order of their places."""
    tree, place = t.column("tree").to_numpy(), t.column("place").to_numpy()
    by = np.lexsort((place, tree))
    block = place[by] // BLOCK
    edge = np.flatnonzero((np.diff(tree[by]) != 0) | (np.diff(block) != 0)) + 1
    return np.split(by, edge) if len(by) else []


def _rise(t: pa.Table) -> pa.Table:
    """The nodes that the blocks of a task end in."""
    out = []
    tree, place, total, digest = (t.column(c) for c in ("tree", "place", "total", "digest"))
    for rows in blocks_of(t):
        n = total[int(rows[0])].as_py()
        top = levels(matrix(digest.take(pa.array(rows))), n)[-1]
        left = 1 if n <= BLOCK else -(-n // BLOCK)
        out.append((tree[int(rows[0])].as_py(), place[int(rows[0])].as_py() // BLOCK, left, top.tobytes().decode()))
    return pa.table({"tree": pa.array([r[0] for r in out], pa.int64()), "place": pa.array([r[1] for r in out], pa.int64()), "total": pa.array([r[2] for r in out], pa.int64()), "digest": pa.array([r[3] for r in out], pa.string())})


def _paths(t: pa.Table, above: pa.Table) -> tuple[list[np.ndarray], list[list[list[tuple[bytes, bytes]]]], list[list]]:
    """For each block: its rows, each row's path up to the root of all, and (subroot, root) of the block."""
    key = {(a, b): x for x, (a, b) in enumerate(zip(above.column("tree").to_pylist(), above.column("place").to_pylist(), strict=True))}
    total, digest = t.column("total"), t.column("digest")
    tree, place = t.column("tree").to_pylist(), t.column("place").to_pylist()
    out = ([], [], [])
    for rows in blocks_of(t):
        up = above.slice(key[tree[rows[0]], place[rows[0]] // BLOCK], 1).to_pylist()[0]
        rest = [(p["before"].encode(), p["after"].encode()) for p in up["path"]]
        raw = [m.tobytes() for m in levels(matrix(digest.take(pa.array(rows))), total[int(rows[0])].as_py())]
        out[0].append(rows)
        out[1].append([[beside(level, i // FANOUT**h) for h, level in enumerate(raw[:-1])] + rest for i in range(len(rows))])
        out[2].append((up["subroot"], up["root"]))
    return out


def _descend(t: pa.Table, above: pa.Table) -> pa.Table:
    """The path of each node of a task's blocks. A node without a subroot above it is one itself: the root of a group's tree."""
    cols: dict[str, list] = {c: [] for c in ("tree", "place", "subroot", "root", "path")}
    tree, place, digest = (t.column(c).to_pylist() for c in ("tree", "place", "digest"))
    for rows, paths, (subroot, root) in zip(*_paths(t, above), strict=True):
        for row, path in zip(rows.tolist(), paths, strict=True):
            for c, v in (("tree", tree[row]), ("place", place[row]), ("subroot", subroot), ("root", root), ("path", [{"before": a.decode(), "after": b.decode()} for a, b in path])):
                cols[c].append(v)
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return pa.table({c: pa.array(v, {"tree": pa.int64(), "place": pa.int64(), "path": kind}.get(c, pa.string())) for c, v in cols.items()})


def _prove(t: pa.Table, above: pa.Table) -> pa.Table:
    """Of each leaf of a task's blocks: the proof's digest, and the root that its tampered digest (or else its own) folds to."""
    keep: list[int] = []
    cols: dict[str, list] = {c: [] for c in ("subroot", "root", "proof_sha256", "folded_root")}
    digest, tampered = t.column("digest").to_pylist(), t.column("tampered").to_pylist()
    for rows, paths, (subroot, root) in zip(*_paths(t, above), strict=True):
        for row, path in zip(rows.tolist(), paths, strict=True):
            keep.append(row)
            proof = sha256()
            for before, after in path:
                proof.update(before)
                proof.update(after)
            folded = fold((tampered[row] or digest[row]).encode(), path).decode()
            for c, v in (("subroot", subroot), ("root", root), ("proof_sha256", proof.hexdigest()), ("folded_root", folded)):
                cols[c].append(v)
    own = t.take(pa.array(keep, pa.int64()))
    return pa.table({"key": own.column("key"), "leaf": own.column("digest"), **{c: pa.array(v, pa.string()) for c, v in cols.items()}})


def _numbered(rows: DataFrame, group: str, order: list[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """The rows, stored in ranges of their order with the range `part` and the running number `no`; and of each group in each range `of`,
    `of_part`, the `first` number, the `start` of its places, and the group's `total`.

    `start` counts the group's rows in the ranges before: a window over counts, one row a range and group, never over rows.
    """
    dealt = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()).withColumn("no", F.monotonically_increasing_id()))
    pieces = dealt.groupBy(group, "part").agg(F.min("no").alias("first"), F.count("*").alias("n"))
    by = Window.partitionBy(group)
    start = F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return dealt, stored(pieces.select(F.col(group).alias("of"), F.col("part").alias("of_part"), "first", F.coalesce(start, F.lit(0)).alias("start"), F.sum("n").over(by).alias("total")))


def _placed(dealt: DataFrame, pieces: DataFrame, group: str) -> DataFrame:
    here = (F.col("part") == F.col("of_part")) & F.col("of").eqNullSafe(F.col(group))
    return dealt.join(pieces, here).withColumn("place", F.col("no") - F.col("first") + F.col("start"))


def _task(block: Column, tasks: int) -> Column:
    """Blocks are dealt evenly, whatever their tree."""
    return spread(F.pmod(F.xxhash64("tree", block), F.lit(tasks)))


def _own(nodes: DataFrame, tasks: int) -> DataFrame:
    return nodes.withColumn("task", _task(F.floor(F.col("place") / BLOCK), tasks))


def _climb(nodes: DataFrame, most: int, rows: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes that each round starts from, and the roots of all trees; most: nodes of the largest tree."""
    rounds = [nodes]
    while most > 1:
        tasks = max(width(nodes.sparkSession), -(-rows // TASK_ROWS))
        rounds.append(stored(_own(rounds[-1], tasks).groupBy("task").applyInArrow(_rise, "tree long, place long, total long, digest string")))
        most, rows = -(-most // BLOCK), rows // BLOCK + 1
    return rounds[:-1], rounds[-1]


def _down(nodes: DataFrame, above: DataFrame, rows: int, step, schema: str) -> DataFrame:
    """What `step` makes of each task's blocks and the paths of the nodes that they end in."""
    tasks = max(width(nodes.sparkSession), -(-rows // TASK_ROWS))
    up = above.withColumn("task", _task(F.col("place"), tasks))
    return _own(nodes, tasks).groupBy("task").cogroup(up.groupBy("task")).applyInArrow(step, schema)


def _all_down(rounds: list[DataFrame], above: DataFrame, rows: int) -> DataFrame:
    """Paths of the nodes that the first of `rounds` starts from, given those of the trees' roots."""
    for height in range(len(rounds) - 1, -1, -1):
        above = stored(_down(rounds[height], above, rows // BLOCK**height + 1, _descend, PATHS))
    return above


def manifest(rows: DataFrame, key: str, group: str, leaf: Column, tampered: Column | None = None) -> DataFrame:
    """Merkle proof of each row: (key, leaf, subroot, root, proof_sha256, folded_root, verified).

    H is the lower-case hex SHA-256; `leaf` and `tampered` (null: not tampered with) are hex digests, as `row_digest` makes them. In each group leaves
    ascend by key (null first; rows of one key by their leaves, so that repeated rows take neighbouring places); while a group has several
    nodes, every FANOUT neighbours (the last run fewer, even one) become their H. The groups' roots, in the order of their groups (null first,
    strings by UTF-8 bytes), become the root likewise. proof_sha256 is H of all siblings from the leaf up to the root, left to right
    within a level; a table of one row has the empty text's. folded_root is what the tampered leaf, or else the leaf, and the original siblings come to,
    folded level by level for every row; verified tells whether it is the root. An empty table has no rows and no root. Other
    columns, whatever their names, take no part unless `leaf` names them; texts of any length become leaves in the JVM, and only leaves
    travel. A task holds TASK_ROWS leaves or so and one path for each of their blocks.
    """
    spark = rows.sparkSession
    leaves = stored(rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("group"), leaf.alias("digest"), (F.lit(None) if tampered is None else tampered).cast("string").alias("tampered")))
    count = leaves.count()
    dealt, pieces = _numbered(leaves, "group", ["key", "digest"], max(width(spark), -(-count // (8 * TASK_ROWS))))
    # a tree's number is its group's place in the tree of groups
    groups, ranges = _numbered(pieces.groupBy("of").agg(F.first("total").alias("leaves")).select(F.lit(0).alias("all"), F.col("of").alias("group"), "leaves"), "all", ["group"], width(spark))
    trees = stored(_placed(groups, ranges, "all").select(F.col("group").alias("whose"), "leaves", F.col("place").alias("tree"), F.col("total").alias("trees")))
    numbered = pieces.join(trees.select("whose", "tree"), F.col("of").eqNullSafe(F.col("whose"))).drop("whose")
    nodes = stored(_placed(dealt, numbered, "group").select("tree", "place", "total", "digest", "tampered", "key"))
    most, n_trees = trees.agg(F.coalesce(F.max("leaves"), F.lit(0)), F.coalesce(F.max("trees"), F.lit(0))).first()
    forget(leaves, dealt, pieces, groups, ranges, trees)
    inner, subroots = _climb(nodes.select("tree", "place", "total", "digest"), most, count)
    heads = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n_trees).cast("long").alias("total"), "digest")
    outer, root = _climb(heads, n_trees, n_trees)
    top = root.select("tree", "place", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    of_trees = _all_down(outer, top, n_trees).select(F.col("place").alias("tree"), "root", "path")
    of_trees = of_trees.join(subroots.select("tree", F.col("digest").alias("subroot")), "tree").select("tree", F.lit(0).cast("long").alias("place"), "subroot", "root", "path")
    above = _all_down(inner[1:], of_trees, count // BLOCK + 1)
    kind = rows.schema[key].dataType.simpleString()
    out = _down(nodes, above, count, _prove, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("key", key)


def row_digest(*values: Column) -> Column:
    """H of the values one after the other, each `-` if null, else its UTF-8 byte count, `:` and itself; so no two rows of values read alike."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)
