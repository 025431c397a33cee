"""Connected components by contraction, on DataFrames; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _roots(parent: DataFrame) -> DataFrame:
    """Follows the pointers id -> p, which only ever go down, to their ends; paths halve with each step."""
    while True:
        up = parent.select(F.col("id").alias("p"), F.col("p").alias("further"))
        step = stored(parent.select("id", "p").join(up, "p").select("id", F.col("p").alias("was"), F.col("further").alias("p")))
        forget(parent)
        if step.filter("p <> was").limit(1).isEmpty():
            return step
        parent = step


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for each end of the edges (a, b): comp is the least id that edges reach. No edges, no rows.

    Each round points every vertex to the least of its neighbours and itself (combined before the shuffle), follows the pointers to their
    ends, and draws the edges between the ends; edges inside what has become one vertex go, so that later rounds see few. At least
    half of the vertices that still have edges go in each round. Tables of a round stay in the shared folder.
    """
    low_high = lambda df, a, b: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()
    edges, labels = stored(low_high(edges, "a", "b")), None
    while labels is None or not edges.limit(1).isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = _roots(stored(ends.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("p"))))
        near, far = parent.select(F.col("id").alias("a"), F.col("p").alias("pa")), parent.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        drawn = stored(low_high(edges.join(near, "a").join(far, "b"), "pa", "pb"))
        if labels is None:
            told = stored(parent.select("id", F.col("p").alias("comp")))
        else:
            told = stored(labels.join(parent.select(F.col("id").alias("comp"), "p"), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp")))
            forget(labels)
        forget(edges, parent)
        edges, labels = drawn, told
    forget(edges)
    return labels
