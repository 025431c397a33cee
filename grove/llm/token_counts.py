"""Token counts: documents by encoded length, and suffix sums that answer every context limit."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the public pre-tokenization pattern of this vocabulary (fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A run of the pattern's white space so long that it is cut out; as a whole it would overflow the tokenizer's stack.
LONG_RUN = 10_000
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
_encodings: dict = {}


def _encoding(ranks: bytes, pattern: str):
    key = (hash(ranks), pattern)
    if key not in _encodings:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def _length(encoding, text: str, cut: bool) -> int:
    """Tokens of a text. By the pattern, a run of white space is one piece, but for its last character if another character follows."""
    n, at = 0, 0
    for m in _RUN.finditer(text) if cut and len(text) >= LONG_RUN else ():
        end = m.end() if m.end() == len(text) else m.end() - 1
        n += len(encoding.encode_ordinary(text[at : m.start()])) + len(encoding._core_bpe.encode_single_piece(text[m.start() : end].encode()))
        at = end
    return n + len(encoding.encode_ordinary(text[at:]))


def encoded_lengths(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per row of df: n_tokens of its whole text (0 for null and empty). The vocabulary (fixed, under 2 MB) goes to every task.

    Repeated rows are counted each; an empty table gives none; other columns, whatever their names, are ignored. Very long words and, with
    the default pattern, very long runs of white space are encoded as they are; a text is held whole in one task. `vocabulary` is a file of
    the driver's: lines of a token in base 64 and its rank.
    """
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, cut = _encoding(shared.value, pattern), pattern == PATTERN
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_length(encoding, x.as_py() or "", cut) for x in b.column(0)], pa.int64())], names=["n_tokens"])

    return df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Distinct lengths with their number of documents; its size is bounded by the longest document, not by their number."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99), block: int = 256) -> DataFrame:
    """For every length L of the histogram, taken as a context limit: what fits, what is longer, and what is left when cut at L.

    Columns: n_tokens (L), n_docs, docs_longer and tokens_longer (documents over L), docs_fitting, tokens_total (of all documents),
    tokens_truncated (sum of min(length, L)), and pXX (quantiles of min(length, L), the least length with at least that
    share of documents at or below it). A limit between two lengths is answered by tokens_truncated of the lower one
    plus the difference times docs_longer. Sums run within blocks of lengths and then over the blocks' totals, so no
    task sees all rows. An empty histogram gives no rows.
    """
    hist = stored(hist)  # it is read several times below, and to count it is to tokenize all texts
    weight = F.col("n_tokens") * F.col("n_docs")
    rows = hist.select("n_tokens", "n_docs", weight.alias("mass"), F.floor(F.col("n_tokens") / block).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("mass").alias("m"))
    above = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("m").over(above), F.lit(0)).alias("m_above"),
        F.sum("d").over(everything).alias("d_all"),
        F.sum("m").over(everything).alias("m_all"),
    )
    longer = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("d_above")).alias("docs_longer"),
        (F.coalesce(F.sum("mass").over(longer), F.lit(0)) + F.col("m_above")).alias("tokens_longer"),
        F.col("d_all"),
        F.col("m_all").alias("tokens_total"),
    )
    out = out.withColumn("docs_fitting", F.col("d_all") - F.col("docs_longer"))
    out = out.withColumn("tokens_truncated", F.col("tokens_total") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer"))
    names = [f"p{round(q * 100):02d}" for q in quantiles]
    at = [F.min(F.when(F.col("docs_fitting") >= F.ceil(F.lit(q) * F.col("d_all")), F.col("n_tokens"))) for q in quantiles]
    cuts = out.agg(*at).first()  # one number a quantile
    return out.select("n_tokens", "n_docs", "docs_fitting", "docs_longer", "tokens_longer", "tokens_total", "tokens_truncated", *[F.least("n_tokens", F.lit(c).cast("long")).alias(n) for n, c in zip(names, cuts, strict=True)])
