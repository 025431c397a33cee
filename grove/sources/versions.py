"""Stored tables that are changed bucket by bucket, in versions that readers see whole.

A table is a folder: below `data`, immutable folders of one bucket each; below `_versions`, a numbered manifest for each version, which names the folder of
every bucket. Rows belong to a bucket by the hash of their key. A change writes new folders for the buckets in which a row really changes, and
becomes visible by the creation of the next manifest, which only one writer can do: the others are told of the conflict. What a killed writer
leaves behind is named by no manifest. A manifest holds one line a bucket, whatever the rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConflictError(RuntimeError):
    """Another writer made the version that this one wanted to make."""


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    keys: tuple[str, ...]
    buckets: int
    folders: dict[int, str]  # of the buckets that have rows


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str) -> Manifest:
    """The newest version."""
    place, fs = _fs(spark, f"{path}/_versions")
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    names = [n for n in names if n.endswith(".json") and not n.startswith("_")]
    if not names:
        raise FileNotFoundError(f"no version of a table at {path}")
    held = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/_versions/{max(names)}", wholetext=True).collect()))
    return Manifest(held["version"], held["schema"], tuple(held["keys"]), held["buckets"], {int(k): v for k, v in held["folders"].items()})


def _commit(spark: SparkSession, path: str, m: Manifest) -> Manifest:
    """Shows version m to readers. The manifest is written beside, then gets its name, unless another has it."""
    body = json.dumps({"version": m.version, "schema": m.schema, "keys": m.keys, "buckets": m.buckets, "folders": m.folders})
    name = f"{path}/_versions/{m.version:020d}.json"
    beside, fs = _fs(spark, f"{path}/_versions/_{uuid.uuid4().hex}.json")
    out = fs.create(beside, False)
    out.write(bytearray(body.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(_fs(spark, name)[0]), none)
    except Exception as x:
        fs.delete(beside, False)
        if "FileAlreadyExists" in str(x):
            raise ConflictError(f"version {m.version} of {path} is there already") from None
        raise
    return m


def _bucket(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, m: Manifest) -> dict[int, str]:
    """Folders of the rows' buckets, each written by one task or, where a bucket is large, by several."""
    spark, name = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    rows.withColumn("__bucket", _bucket(m.keys, m.buckets)).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{path}/{name}")
    place, fs = _fs(spark, f"{path}/{name}")
    found = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()]
    return {int(n.partition("=")[2]): f"{name}/{n}" for n in found if n.startswith("__bucket=")}


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> Manifest:
    """The first version. Choose so many buckets that one is what a task should rewrite for a changed row; a key's rows share a bucket."""
    empty = Manifest(0, rows.schema.json(), tuple(keys), buckets, {})
    return _commit(rows.sparkSession, path, replace(empty, folders=_write(rows, path, empty)))


def read(spark: SparkSession, path: str, version: Manifest | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a version (the newest), or of some of its buckets."""
    m = version or latest(spark, path)
    schema = T.StructType.fromJson(json.loads(m.schema))
    folders = [f"{path}/{f}" for b, f in sorted(m.folders.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _touched(rows: DataFrame, m: Manifest) -> list[int]:
    """Buckets of the rows: at most as many numbers as there are buckets."""
    return sorted(r[0] for r in rows.select(_bucket(m.keys, m.buckets).alias("b")).distinct().collect())


def _replace(spark: SparkSession, path: str, m: Manifest, touched: list[int], rows: DataFrame) -> tuple[Manifest, int]:
    """The version in which the touched buckets hold `rows`, and how many there were; with none, the same version."""
    if not touched:
        return m, 0
    written = _write(rows, path, m)
    kept = {b: f for b, f in m.folders.items() if b not in set(touched)}
    return _commit(spark, path, replace(m, version=m.version + 1, folders=kept | written)), len(touched)


def _same(a: Column, b: Column, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")) for c in columns], F.lit(True))


def merge(new: DataFrame, path: str, owned: list[str] | None = None, version: Manifest | None = None) -> tuple[Manifest, int]:
    """Upserts by the table's key: (the version that has the rows of new, buckets rewritten).

    Columns in `owned` (default: all of new) are taken from new where it has the key, nulls included; the others of a known row stay, those of an unknown row are
    null. Keys are compared with nulls equal; keys repeated in new are an error. Buckets whose rows already are as new has them are not rewritten, so the same merge
    again makes no version. `version`: what the caller has read; if another writer has made the next one since then, it is a ConflictError.
    """
    spark = new.sparkSession
    m = version or latest(spark, path)
    names, keys = T.StructType.fromJson(json.loads(m.schema)).names, list(m.keys)
    owned = [c for c in (owned or new.columns) if c not in keys]
    new = new.select(*[F.col(f"`{c}`") for c in (*keys, *owned)])
    if not new.groupBy(*[F.col(f"`{k}`") for k in keys]).count().filter("count > 1").limit(1).isEmpty():
        raise ValueError(f"keys repeat in the rows to merge: {keys}")
    near = read(spark, path, m, _touched(new, m))
    fresh = new.alias("n").join(near.alias("o"), _same("n", "o", [*keys, *owned]), "left_anti")
    touched = _touched(fresh, m)
    old = read(spark, path, m, touched).withColumn("__old", F.lit(True)).alias("o")
    put = new.filter(_bucket(m.keys, m.buckets).isin(touched)).withColumn("__new", F.lit(True)).alias("n")
    both = old.join(put, _same("o", "n", keys), "full_outer")
    pick = lambda c: F.when(F.col("n.__new"), F.col(f"n.`{c}`")).otherwise(F.col(f"o.`{c}`")) if c in (*keys, *owned) else F.col(f"o.`{c}`")
    return _replace(spark, path, m, touched, both.select(*[pick(c).alias(c) for c in names]))


def rewrite(new: DataFrame, scopes: list[DataFrame], path: str, version: Manifest | None = None) -> tuple[Manifest, int]:
    """Replaces the rows that are in every scope (each a frame of one column) by those of new: (version, buckets rewritten).

    Rows outside the scope stay. Where a scope's column is the table's whole key, only the buckets of its values are read. A bucket that holds just the rows it is to
    hold is not rewritten, so the same rewrite again makes no version. Null is in no scope. Conflicts are as in merge.
    """
    spark = new.sparkSession
    m = version or latest(spark, path)
    schema = T.StructType.fromJson(json.loads(m.schema))
    new = new.select(*[F.col(f"`{c}`").cast(schema[c].dataType).alias(c) for c in schema.names])
    by_key = [s for s in scopes if tuple(s.columns) == m.keys]
    typed = lambda s: s.select(F.col(f"`{s.columns[0]}`").cast(schema[s.columns[0]].dataType).alias(s.columns[0])).distinct()
    near = sorted({*_touched(typed(by_key[0]), m), *_touched(new, m)}) if by_key else None
    doomed = reduce(lambda d, s: d.join(typed(s), s.columns, "left_semi"), scopes, read(spark, path, m, near))
    columns = [F.col(f"`{c}`") for c in schema.names]
    count = lambda df, sign: df.groupBy(*columns).agg(F.count("*").alias("__n")).withColumn("__n", F.col("__n") * sign)
    changed = count(doomed, -1).unionByName(count(new, 1)).groupBy(*columns).agg(F.sum("__n").alias("__n")).filter("__n <> 0")
    touched = _touched(changed, m)
    here = read(spark, path, m, touched)
    gone = reduce(lambda d, s: d.join(typed(s).withColumn(f"__in_{s.columns[0]}", F.lit(True)), s.columns, "left"), scopes, here)
    inside = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"`__in_{s.columns[0]}`"), F.lit(False)) for s in scopes], F.lit(True))
    kept = gone.filter(~inside).select(*columns)
    return _replace(spark, path, m, touched, kept.unionByName(new.filter(_bucket(m.keys, m.buckets).isin(touched))))


def publish(frames: dict[str, tuple[DataFrame, str, list[str]]], path: str) -> Manifest:
    """Writes several outputs (name: rows, format, columns of folders) and shows them together, as one version: readers see all of the old ones or all of the new.

    What is named in `schema` is the outputs' names; `output` finds one.
    """
    spark = next(iter(frames.values()))[0].sparkSession
    name = f"data/{uuid.uuid4().hex}"
    for part, (rows, kind, folders) in frames.items():
        rows.write.partitionBy(*folders).format(kind).save(f"{path}/{name}/{part}")
    try:
        before = latest(spark, path).version
    except FileNotFoundError:
        before = -1
    return _commit(spark, path, Manifest(before + 1, json.dumps(sorted(frames)), (), len(frames), {i: f"{name}/{part}" for i, part in enumerate(sorted(frames))}))


def output(spark: SparkSession, path: str, name: str, version: Manifest | None = None) -> str:
    """The folder of one of the published outputs."""
    m = version or latest(spark, path)
    return f"{path}/{m.folders[json.loads(m.schema).index(name)]}"
