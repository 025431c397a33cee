"""Text files by byte ranges: pieces between separators, as many tasks to a file as Spark makes ranges of it.

Spark deals a file into ranges, and a range has the pieces that begin in it, in order. What a format needs to know where a range begins (inside quotes
or not, how deep in brackets) is found in two passes: each range tells what it does to every state it may begin in, and these functions are
composed along the file. The driver does that, with one small row a range; Spark's own plan of the scan holds as many.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, islice, pairwise
from operator import itemgetter
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
Key = tuple[str, int]  # a range: path of the file, first byte


def scan_pieces(spark: SparkSession, path: str, separator: str = "\n", binary: bool = False) -> DataFrame:
    """path, start (of the range) and value (text, or its bytes) of each piece between separators; rows of a task stand in the order of their file."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary" if binary else "string").alias("value"))


def chunks(items: Iterable[T], n: int) -> Iterator[tuple[list[T], bool]]:
    """Up to n items at a time, and whether more come after them."""
    it = iter(items)
    chunk = list(islice(it, n))
    while chunk:
        after = list(islice(it, n))
        yield chunk, bool(after)
        chunk = after


def whole_files(spark: SparkSession, path: str) -> bool:
    """Whether all files at path together are too small for Spark to make two ranges of any of them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    size = sum(fs.getContentSummary(s.getPath()).getLength() for s in fs.globStatus(p) or [])
    conf = spark._jsparkSession.sessionState().conf()
    return size <= min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Key, pa.Array]]:
    """Pieces that stand together and are of one range."""
    for b in batches:
        if b.num_rows:
            paths, starts = b.column(0).dictionary_encode(), b.column(1).to_numpy(zero_copy_only=False)
            codes = paths.indices.to_numpy(zero_copy_only=False)
            at = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), b.num_rows]
            for i, j in pairwise(at):
                yield (b.column(0)[i].as_py(), int(starts[i])), b.column(2).slice(i, j - i)


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Key, Iterator]]:
    """The pieces of each range of a task."""
    for key, own in groupby(_runs(batches), itemgetter(0)):
        yield key, (x for _, values in own for x in values.to_numpy(zero_copy_only=False).tolist())
