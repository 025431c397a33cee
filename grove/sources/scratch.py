"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: dict[str, SparkSession] = {}  # tables of this session that are still there
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder (tests); a cluster is refused."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="grove-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/grove-{uuid.uuid4().hex}"
    _tables[path] = spark
    return path


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read again: cuts lineage, survives lost executors, and is computed once.

    The shuffle files that made the rows go as soon as they are written. The table goes with forget(), or when Python ends.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    before = spark.conf.get(CLEANUP, None)
    if before is not None:  # unknown to older versions
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that stored() returned and that no rows will be read from any more."""
    for t in tables:
        path = getattr(t, "stored_at", None)
        if path in _tables:
            _delete(_tables.pop(path), path)


@atexit.register
def _forget_all() -> None:
    for path, spark in list(_tables.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session is gone, and with it the way to the folder
            return
