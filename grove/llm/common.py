"""Helpers shared by the training-data operators: tables, shared scratch space, byte-level text arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import forget, stored

__all__ = ["forget", "stored"]

U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plus(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df with more fields."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(ddl).fields])


def quoted(name: str) -> str:
    """A column's name as Spark reads it, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def boxed(names: list[str]) -> Column:
    """The columns `names` as one struct `row`, so that none can clash with what an operator adds, nor its name matter."""
    return F.struct(F.lit(0).alias("_"), *[F.col(quoted(c)).alias(c) for c in names]).alias("row")


def unboxed(names: list[str], own: dict[str, Column]) -> list[Column]:
    """The columns `names` again, from the struct `row` or as `own` has them."""
    return [(own[c] if c in own else F.col("row." + quoted(c))).alias(c) for c in names]


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(number: Column | np.ndarray) -> Column | np.ndarray:
    """The int whose hash, by which Spark deals rows to n partitions, is `number`; so groups numbered 0, 1, ... fill all partitions evenly.

    Spark hashes an int by Murmur3 with seed 42, whose steps can all be undone. Were it to deal otherwise, only the evenness would be lost.
    """
    mask, ours = 0xFFFFFFFF, isinstance(number, np.ndarray)
    low = lambda v: v & mask if ours else v.bitwiseAND(F.lit(mask).cast("long"))
    xor = lambda v, w: v ^ w if ours else v.bitwiseXOR(F.lit(w).cast("long") if isinstance(w, int) else w)
    down = lambda v, n: v >> n if ours else F.shiftright(v, n)
    up = lambda v, n: low(v << n if ours else F.shiftleft(v, n))
    undo = lambda c: pow(c, -1, 1 << 32)
    times = lambda c: lambda v: low(up(low(v * (c >> 16)), 16) + v * (c & 0xFFFF))
    turn = lambda n: lambda v: up(v, 32 - n) + down(v, n)  # noqa: E731, a rotation to the right
    steps = [low, lambda v: xor(v, down(v, 16)), times(undo(0xC2B2AE35)), lambda v: xor(xor(v, down(v, 13)), down(v, 26)), times(undo(0x85EBCA6B)),
             lambda v: xor(xor(v, down(v, 16)), 4), lambda v: low(v + ((1 << 32) - 0xE6546B64)), times(undo(5)), turn(13), lambda v: xor(v, 42),
             times(undo(0x1B873593)), turn(15), times(undo(0xCC9E2D51))]
    if ours:
        x = number.astype(np.int64)
        for step in steps:
            x = step(x)
        return x.astype(np.uint32).view(np.int32)
    x = F.array(number.cast("long"))
    for step in steps:  # each in an array of one, so that what a step uses twice is there once
        x = F.transform(x, step)
    return F.get(F.transform(x, lambda v: F.when(v < 1 << 31, v).otherwise(v - (1 << 32)).cast("int")), F.lit(0))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n + 1 offsets. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about `most` bytes of text each (a longer text is a slice of its own)."""
    for batch in batches:
        data, off = texts(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


_RNG = np.random.default_rng(20240607)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BACK = U64(pow(int(BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: U64, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 1 << 23:
            _powers[key] = have
    return have[:n]


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: everything but ASCII letters, digits and bytes of longer characters
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


LONG_WORD = 128
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number; the data need LONG_WORD more bytes at their end."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start : start + size]; up to LONG_WORD bytes by scrambling eight at a time, of longer ones by BLAKE2.

    Neither is a sum over bytes, so no pattern of letters makes different words collide; of n words any two do with odds of n * n / 2**65.
    """
    view = eight_bytes(np.concatenate([data, np.zeros(LONG_WORD, np.uint8)]))
    h = mix(size.astype(U64) * U64(0x9FB21C651E98DF25) + U64(0x2545F4914F6CDD1D))
    for j in range(0, LONG_WORD, 8):
        on = slice(None) if j == 0 else np.flatnonzero(size > j)
        if j and not len(on):
            break
        h[on] = mix(h[on] * U64(0x9E3779B97F4A7C15) + (view[start[on] + j].astype(U64) & _MASKS[np.clip(size[on] - j, 0, 8)]))
    raw = memoryview(np.ascontiguousarray(data))
    for x in np.flatnonzero(size > LONG_WORD).tolist():
        h[x] = int.from_bytes(hashlib.blake2b(raw[start[x] : start[x] + size[x]], digest_size=8, key=b"grove").digest(), "little")
    return h


def equal_bytes(data: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each data[a : a + size] is other[b : b + size]."""
    views = [eight_bytes(np.concatenate([x, np.zeros(LONG_WORD, np.uint8)])) for x in (data, other)]
    same = np.ones(len(a), bool)
    for j in range(0, min(LONG_WORD, int(size.max(initial=0))), 8):
        on = np.flatnonzero(same & (size > j))
        same[on] = (views[0][a[on] + j] ^ views[1][b[on] + j]) & _MASKS[np.minimum(size[on] - j, 8)] == 0
    for x in np.flatnonzero(same & (size > LONG_WORD)).tolist():
        same[x] = np.array_equal(data[a[x] : a[x] + size[x]], other[b[x] : b[x] + size[x]])
    return same


def words(data: np.ndarray, off: np.ndarray, gap: np.ndarray = WHITE, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end, A-Z lower-cased: (hash, start, end, first word of each text and the total).

    With `most`, the hash is that of the word's first so many bytes.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, np.zeros(len(off), np.int64)
    inside = ~gap[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = off[:-1][off[:-1] < n]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    size = end - start if most is None else np.minimum(end - start, most)
    return word_hashes(LOWER[data], start, size), start, end, np.searchsorted(start, off)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text number of each run of k words, and its first word's place; a text of 1 to k - 1 words is one shingle."""
    nw = np.diff(first)
    whole = np.flatnonzero((nw > 0) & (nw < k))
    count = np.maximum(nw - k + 1, 0)
    owner = np.repeat(np.arange(len(nw)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][owner]
    out = np.full(len(at), k, U64)
    for j in range(k):
        out = mix(out * U64(0x9FB21C651E98DF25) + h[at + j])
    if len(whole):
        short = nw[whole].astype(U64)
        for j in range(k - 1):
            more = nw[whole] > j
            short[more] = mix(short[more] * U64(0x9FB21C651E98DF25) + h[first[:-1][whole[more]] + j])
        out, owner, at = np.concatenate([out, short]), np.concatenate([owner, whole]), np.concatenate([at, first[:-1][whole]])
    return out, owner, at
