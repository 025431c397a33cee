"""Writes onto stored tables, as pure frames: upserts, scoped rewrites, constraints. Write the result where it belongs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], owned: list[str] | None = None) -> DataFrame:
    """old with the rows of new put in by key. Columns in `owned` (default: all of new) are taken from new where it has the key, nulls
    included; other columns of a known row stay as they are. Keys are compared with nulls equal."""
    owned = [c for c in (owned or new.columns) if c not in keys]
    a, b = old.withColumn("__old", F.lit(True)).alias("a"), new.select(*keys, *owned).withColumn("__new", F.lit(True)).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.join(b, same, "full_outer")
    hit = F.col("b.__new").isNotNull()
    pick = lambda c: F.when(hit, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in keys or c in owned else F.col(f"a.{c}")
    return both.select(*[pick(c).alias(c) for c in old.columns])


def rewrite_scope(old: DataFrame, new: DataFrame, *scopes: DataFrame) -> DataFrame:
    """old without the rows that are in every scope (each a frame of one key column), then new: others' rows stay."""
    doomed = old
    for s in scopes:
        doomed = doomed.join(s.distinct(), s.columns, "left_semi")
    keys = [s.columns[0] for s in scopes]
    kept = old.join(doomed.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new)


def cascade(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """ON DELETE CASCADE: children whose parent is there; a null reference stays."""
    return child.filter(F.col(key).isNull()).unionByName(child.join(parent.select(key).distinct(), key, "left_semi").select(*child.columns))


def set_null(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """ON DELETE SET NULL."""
    there = parent.select(key).distinct().withColumn("__there", F.lit(True))
    return child.join(there, key, "left").withColumn(key, F.when(F.col("__there"), F.col(key))).select(*child.columns)


def violations(df: DataFrame, unique: list[str], not_null: list[str] = (), reference: tuple[DataFrame, str] | None = None) -> DataFrame:
    """(rule, n): keys that repeat (nulls are one value), nulls where none may be, references without a target."""
    out = df.groupBy(*unique).agg(F.count("*").alias("c")).filter("c > 1").agg(F.count("*").alias("n")).select(F.lit("unique").alias("rule"), "n")
    for c in not_null:
        out = out.unionByName(df.agg(F.count_if(F.col(c).isNull()).alias("n")).select(F.lit(f"not_null:{c}").alias("rule"), "n"))
    if reference:
        parent, key = reference
        lost = df.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")
        out = out.unionByName(lost.agg(F.count("*").alias("n")).select(F.lit(f"reference:{key}").alias("rule"), "n"))
    return out
