"""Source divergence audit: how the words of each source of a language differ from those of the language and of its other sources.

  1. Tasks count the terms of their texts with vectorized SQL (DuckDB), some megabytes of text at a time, and add up as they go, so that a
     task sends a term of a source once (or once for each FLUSH_ROWS distinct ones).
  2. Terms are dealt by their hash into cells; a shard is one language's terms of one cell. Spark adds up what the tasks sent, row by row, so that
     a term in every text is no hot group; a shard's SQL keeps its frequent terms.
  3. Spark adds up the kept counts to the sizes of groups and languages, and each shard gets those of its language. Its SQL makes the sums of
     pairs of sources over its terms, from the terms that one of the two has, and its ten best terms of each source. Spark adds up the sums, and ranks.
Nothing is estimated: probabilities are whole billionths, and all sums are sums of whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, spread, stored, width

SLICE_BYTES = 8 << 20
FLUSH_ROWS = 1 << 20
SHARD_BYTES = 512 << 20  # of text for each cell of terms, where the session has no more partitions anyway
KEPT_ROWS = 1 << 17  # rows of kept counts for each cell of the second step; more where languages have more pairs of sources
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BILLION = 1_000_000_000


def connect() -> duckdb.DuckDBPyConnection:
    """A database in the memory of one task: one thread, nothing on disk."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "900MB"})
    con.execute("SET temp_directory = ''")
    con.execute("SET preserve_insertion_order = false")
    return con


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of the batches, with about SLICE_BYTES of text in each slice (a longer text is a slice of its own)."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        first = 0
        for i, n in enumerate(sizes):
            if size and size + n > SLICE_BYTES:
                yield pa.Table.from_batches([*held, batch.slice(first, i - first)])
                held, size, first = [], 0, i
            size += n
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


COUNT = f"""
INSERT INTO counts
WITH w AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM slice)),
d AS (SELECT row, lang, source, term, count(*) AS n FROM w GROUP BY ALL)
SELECT lang, source, term, CAST(sum(n) AS BIGINT), count(*) FROM d GROUP BY lang, source, term
"""
ADDED = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM counts GROUP BY ALL"
COUNTS = "lang string, source string, term string, n long, docs long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of a task's texts."""
    con = connect()
    make = "CREATE OR REPLACE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)"
    con.execute(make)
    rows = 0
    for part in slices(batches):
        con.register("slice", part)
        rows += con.execute(COUNT).fetchall()[0][0]
        con.unregister("slice")
        if rows > 2 * FLUSH_ROWS:
            con.execute(f"CREATE TABLE added AS {ADDED}")
            con.execute("DROP TABLE counts")
            con.execute("ALTER TABLE added RENAME TO counts")
            rows = con.execute("SELECT count(*) FROM counts").fetchall()[0][0]
            if rows > FLUSH_ROWS:
                yield from con.sql("FROM counts").to_arrow_table().to_batches(1 << 16)
                con.execute(make)
                rows = 0
    yield from con.sql(ADDED).to_arrow_table().to_batches(1 << 16)
    con.close()


KEEP = """
WITH t AS (SELECT term, sum(docs) AS docs FROM shard GROUP BY term HAVING sum(docs) >= $least)
SELECT shard.lang, shard.source, shard.term, shard.n, row_number() OVER (PARTITION BY shard.term ORDER BY shard.source) = 1 AS head FROM shard JOIN t USING (term)
"""


def keep_terms(shard: pa.Table, least: int) -> pa.Table:
    """Step 2 of a shard (one row a term and source): the counts of terms in at least so many documents. `head` marks one row of each term."""
    con = connect()
    con.register("shard", shard)
    return con.execute(KEEP, {"least": least}).to_arrow_table()


#: p of a count, in billionths; the product is beyond 64 bits for counts that a large corpus has
_P = "CAST(1 + CAST({n} + 2 AS HUGEINT) * 1000000000 // CAST({total} + 2 * {v} AS HUGEINT) AS BIGINT)"
_F = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
SHARE = f"""
CREATE TABLE g AS SELECT source, {_P.format(n="0", total="total", v="v")} AS zero, total, v, lang_total FROM sizes;
CREATE TABLE c AS SELECT term, source, n, {_P.format(n="n", total="total", v="v")} AS p FROM shard JOIN g USING (source);
"""
#: Each pair once, as both its sources have the same sum. x: terms that a has, beside all other sources; y: those that only a has, so that they are no term of (b, a) in x
PAIRS = f"""
WITH x AS (
  SELECT a.source AS a, b.source AS b, sum({_F.format(p="a.p", q="coalesce(c.p, b.zero)")}) AS f,
         sum({_F.format(p="a.p", q="b.zero")}) FILTER (c.p IS NULL) AS y, count(*) AS n, count(*) FILTER (c.p IS NULL) AS m
  FROM c AS a JOIN g AS b ON a.source <> b.source LEFT JOIN c ON c.term = a.term AND c.source = b.source GROUP BY ALL),
k AS (SELECT count(DISTINCT term) AS terms FROM c),
p AS (SELECT a.source AS a, b.source AS b, {_F.format(p="a.zero", q="b.zero")} AS zero FROM g AS a JOIN g AS b ON a.source < b.source)
SELECT p.a, p.b, CAST(coalesce(x.f, 0) + coalesce(z.y, 0) + (k.terms - coalesce(x.n, 0) - coalesce(z.m, 0)) * p.zero AS BIGINT) AS value
FROM p LEFT JOIN x ON x.a = p.a AND x.b = p.b LEFT JOIN x AS z ON z.a = p.b AND z.b = p.a, k
"""
TERMS = f"""
WITH l AS (SELECT term, {_P.format(n="sum(n)", total="any_value(lang_total)", v="any_value(v)")} AS q FROM c JOIN g USING (source) GROUP BY term),
f AS (SELECT source, term, {_F.format(p="p", q="q")} AS value FROM c JOIN l USING (term) WHERE p > q)
SELECT source, term, value FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY value DESC, term) <= $top
"""
PARTIAL = "lang string, source string, part string, item string, value long"


def compare_sources(shard: pa.Table, sizes: pa.Table, top: int) -> pa.Table:
    """Step 3 of a shard: its share of the sum of each pair (of the smaller source and the greater), and its best terms of each source."""
    if not shard.num_rows:
        return pa.table({c: pa.array([], pa.int64() if c == "value" else pa.string()) for c in ("lang", "source", "part", "item", "value")})
    con = connect()
    con.register("shard", shard)
    con.register("sizes", sizes)
    con.execute(SHARE)
    pairs, terms = con.sql(PAIRS).to_arrow_table(), con.execute(TERMS, {"top": top}).to_arrow_table()
    lang = shard.column("lang")[0]
    named = lambda part, a, item, value: pa.table({"lang": pa.repeat(lang, len(a)), "source": a, "part": pa.repeat(pa.scalar(part), len(a)), "item": item, "value": value})
    return pa.concat_tables([named("pair", *pairs.columns), named("term", *terms.columns)])


def _cell(term: Column, cells: int) -> Column:
    """Each cell is a partition, in which each language has one shard."""
    return spread(F.pmod(F.xxhash64(term), F.lit(cells)))


def audit_sources(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 10, top: int = 10) -> DataFrame:
    """Divergence of the groups (language, source): (lang, source, part, item, value, rank).

    Terms are runs of ASCII letters and characters beyond ASCII in the whole text, A-Z lower-cased. A language keeps the V terms that stand in at
    least `least` of its rows. A kept term that a group (or a language) holds n times among N of kept terms has the share
    p = 1 + floor(10**9 * (n + 2) / (N + 2 * V)); two shares differ by f = floor((p - q)**2 / (p + q)). Part `pair`: item is each other source of the
    language, value the sum of f over all kept terms. Part `term`: item is each kept term of the group whose p is above the language's, value its f, the
    `top` greatest. Ranks are 1, 2, ... within group and part by value descending, then by the item's UTF-8 bytes.

    Null language, source and text are read as ''. Every language and source that occurs makes a group, with or without terms; a language without kept
    terms has pairs of 0, a language with one source has no pairs. Repeated rows count as often as they stand there. Empty table: no rows. Other columns,
    whatever their names, take no part. Texts and terms of any length are counted whole; a text is read in one task. Pairs are a result
    of their own: S sources of a language have S * (S - 1).
    """
    spark = docs.sparkSession
    text_of = lambda c: F.col(f"`{c}`").cast("string")
    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("text"))
    occurring = stored(rows.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct())
    cells = max(width(spark), -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    counted = rows.mapInArrow(count_terms, COUNTS).withColumn("cell", _cell(F.col("term"), cells)).repartition(cells, "cell")
    added = counted.groupBy("cell", "lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    shards = added.select("cell", "lang", "source", "term", "n", "docs").groupBy("cell", "lang")
    kept = stored(shards.applyInArrow(lambda t: keep_terms(t, least), "lang string, source string, term string, n long, head boolean"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("head").cast("long")).alias("heads"))
    of_lang = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("heads").alias("v"))
    sizes = stored(occurring.join(totals.drop("heads"), ["lang", "source"], "left").join(of_lang, "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "v", "lang_total"))
    # so many cells that all their sums of pairs are no more rows than the counts
    n_pairs = occurring.groupBy("lang").agg(F.count("*").alias("s")).agg(F.sum(F.col("s") * (F.col("s") - 1) / 2)).first()[0] or 0
    cells = max(1, -(-kept.count() // max(KEPT_ROWS, int(n_pairs))))
    own = kept.withColumn("cell", _cell(F.col("term"), cells)).repartition(cells, "cell").select("cell", "lang", "source", "term", "n")
    # each shard gets its language's sizes: as many rows as it makes sums for each source
    places = kept.select(_cell(F.col("term"), cells).alias("at"), F.col("lang").alias("of")).distinct()
    everywhere = sizes.join(places, F.col("lang") == F.col("of"))
    partial = stored(own.groupBy("cell", "lang").cogroup(everywhere.groupBy("at", "of")).applyInArrow(lambda t, s: compare_sources(t, s, top), PARTIAL))
    sums = partial.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("p"), "value").select("lang", "p.*", "value")
    others = occurring.select("lang", F.col("source").alias("item"))
    pairs = occurring.join(others, "lang").filter("source <> item").join(both, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = partial.filter("part = 'term'").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    forget(kept, sizes)
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(terms)
