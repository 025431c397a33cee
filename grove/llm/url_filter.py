"""URL filters: a trie over reversed host labels and path segments, sent to every task; the longest matching rule decides."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, plus, quoted, unboxed

#: Rules whose trie would hold more bytes than this are joined to the urls instead of being sent to every task; the verdicts are the same.
MOST_TRIE_BYTES = 128 << 20
#: Hosts of rules and of urls are lower-cased alike, A-Z only
_LOWER = {x: x + 32 for x in range(65, 91)}


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(_LOWER), slash + path


class UrlTrie:
    """Host labels from the right, then whole path segments; the last segment of a rule is a prefix, kept at its node by length.

    Of rules for one host and path the greatest (rule, verdict) counts, in whatever order they come. `size` is about its bytes.
    """

    def __init__(self, rules: Iterable[tuple[str, str]], most: float = float("inf")):
        self.root, self.size = {}, 0
        for verdict, rule in rules:
            host, path = split_rule(rule)
            node = self.root
            for label in reversed(host.split(".")):
                node = self._step(self._step(node, "hosts"), label)
            node = self._step(node, "paths")
            *whole, last = path.split("/")
            for segment in whole:
                node = self._step(self._step(node, "next"), segment)
            ends, new = self._step(self._step(node, "ends"), len(last)), (len(host) + len(path), rule, verdict)
            self.size += 0 if last in ends else 150 + sys.getsizeof(last) + sys.getsizeof(rule)
            ends[last] = max(new, ends.get(last, new))
            if self.size > most:
                return

    def _step(self, node: dict, key: str | int) -> dict:
        if key not in node:
            self.size += 250 + sys.getsizeof(key)
            node[key] = {}
        return node[key]

    def find(self, host: str, path: str) -> tuple[int, str, str] | None:
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            at = node.get("paths")
            for segment in segments if at else ():
                for n, ends in at.get("ends", {}).items():
                    hit = ends.get(segment[:n]) if n <= len(segment) else None
                    if hit and (best is None or hit >= best):
                        best = hit
                at = at.get("next", {}).get(segment)
                if at is None:
                    break
        return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judge_urls(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to each row.

    rules: (verdict, "host/path") pairs; a rule fits its host and all subdomains when the url's path starts with the rule's.
    The longest host and path wins; of equal ones, the greater rule text, then the greater verdict by name ("block"). Null, empty or odd
    urls have an empty host and path, match nothing and get `default`; very long ones are judged whole. Repeated rows are judged one by
    one; an empty table gives an empty table. Columns of the input named host, path, rule or verdict are replaced. Rules whose trie
    would be over MOST_TRIE_BYTES are joined, not broadcast.
    """
    keep = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col("url"))
    df = df.select(boxed(keep), F.col(quoted(url)).cast("string").alias("url")).select("row", host.alias("host"), path.alias("path"))
    trie = UrlTrie(rules, MOST_TRIE_BYTES)
    if trie.size > MOST_TRIE_BYTES:
        return _joined(df, rules, default).select(*unboxed(keep, {}), "host", "path", "rule", "verdict")
    shared = df.sparkSession.sparkContext.broadcast(trie)
    h, p = df.columns.index("host"), df.columns.index("path")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for b in batches:
            found = [trie.find(x, y) for x, y in zip(b.column(h).to_pylist(), b.column(p).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f and f[1] for f in found], pa.string()), pa.array([f[2] if f else default for f in found], pa.string())],
                names=[*b.schema.names, "rule", "verdict"],
            )

    return df.mapInArrow(judge, plus(df, "rule string, verdict string")).select(*unboxed(keep, {}), "host", "path", "rule", "verdict")


def _joined(df: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """The same by joins, for more rules than a task should hold: each host suffix of a url meets the rules of that host."""
    spark = df.sparkSession
    table = spark.createDataFrame([(*split_rule(r), r, v) for v, r in rules], "r_host string, r_path string, rule string, verdict string")
    urls = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = urls.select("host", "path", F.explode(suffixes).alias("r_host")).join(table, "r_host").filter(F.expr("startswith(path, r_path)"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), "rule", "verdict")).alias("b"))
    best = best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict"))
    return df.join(best, ["host", "path"], "left").select(*df.columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
