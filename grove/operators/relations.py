"""Filters, projections and set operations as functions of frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def optional_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns (source: name) that are there."""
    return df.select(*[F.col(c).alias(n) for c, n in wanted.items() if c in df.columns])


def within(df: DataFrame, **lists: list) -> DataFrame:
    """Rows whose columns are each in their list."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]).isin(*kv[1])), lists.items(), df)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of left that are not in right."""
    return left.distinct().join(right, left.columns, "left_anti")


def split_cached(wanted: DataFrame, cached: DataFrame, known: DataFrame, key: str, mode: str = "auto") -> dict[str, DataFrame]:
    """What to read from the cache, what to fetch, and which cached entries nothing known asks for.

    Modes: auto uses what is there, skip fetches nothing, force and clear fetch all. Stale entries are judged by all known keys,
    not by the wanted ones, which may be a limited part.
    """
    w, c = wanted.select(key).distinct(), cached.select(key).distinct()
    none = w.limit(0)
    read = {"auto": w.join(c, key, "left_semi"), "skip": w.join(c, key, "left_semi")}.get(mode, none)
    fetch = {"auto": w.join(c, key, "left_anti"), "skip": none}.get(mode, w)
    return {"read": read, "fetch": fetch, "stale": c.join(known.select(key).distinct(), key, "left_anti")}


def sorted_concat(frames: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """All rows with the name of the frame they are from."""
    return reduce(DataFrame.unionByName, [df.withColumn(source, F.lit(n)) for n, df in frames.items()])


def repeats(df: DataFrame) -> DataFrame:
    """(n_rows, n_distinct) of a frame."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"))


def existing(rows: DataFrame, path: str, listing: DataFrame, name: str = "name") -> DataFrame:
    """rows with `exists`: whether the last part of the path is listed; a null path is not."""
    there = listing.select(F.col(name).alias("__name")).distinct().withColumn("__there", F.lit(True))
    out = rows.join(there, F.substring_index(path, "/", -1) == F.col("__name"), "left")
    return out.select(*rows.columns, F.coalesce("__there", F.lit(False)).alias("exists"))
