"""A corpus pipeline of five operators: STAGES of (name, function), and run(), which applies them to the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm import decontaminate, ngram_join, sentencepiece_codec, suffix_dedup, toxicity
from grove.llm.common import boxed, forget, quoted, read, stored, unboxed, width
from grove.llm.queries import REJECT


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any toxic grade is under REJECT; the model is fitted on labels of documents that are left."""
    model = toxicity.train_toxicity(docs, read(spark, sf_dir, "labels"))
    rows = docs.select("text", boxed([c for c in docs.columns if c != "text"]))  # so that no column of docs can clash
    return toxicity.score_toxicity(rows, model).filter(F.col("p_toxic") < REJECT).select(*unboxed(docs.columns, {"text": F.col("text")}))


def _numbered(named: DataFrame) -> DataFrame | None:
    """(n, row) of each row where ids repeat, stored: numbers in the order of ids, then of texts' hashes, then of all columns'. None where no id repeats."""
    if named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).isEmpty():
        return None
    rows = named.select(F.struct(*[F.col(quoted(c)).alias(c) for c in named.columns]).alias("row"))
    told = [f"row.{quoted(c)}" for c in named.columns if not any(x in named.schema[c].dataType.simpleString() for x in ("map<", "variant"))]  # Spark hashes no maps
    dealt = rows.repartitionByRange(width(named.sparkSession), "row.doc_id").sortWithinPartitions("row.doc_id", F.xxhash64("row.text"), F.xxhash64(*told))
    return stored(dealt.select(F.monotonically_increasing_id().alias("n"), "row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their 5-word shingles, the one with the least id.

    Documents without words or without an id all stay. Rows that share an id are told apart by their texts: each is compared on its
    own, and of those that are alike, or without words, one row stays.
    """
    named = docs.filter("doc_id is not null")
    rows = _numbered(named)
    if rows is None:
        told = ngram_join.join_ngrams(named, k=5, per_100=80)
        out = named.join(told.filter("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")
    else:
        told = ngram_join.join_ngrams(rows.select("n", "row.text"), doc_id="n", k=5, per_100=80).withColumnRenamed("doc_id", "n")
        wordless = F.col("n_shingles") == 0
        group = [F.when(~wordless, F.col("component_id")).alias("component"), F.when(wordless, F.col("id")).alias("id")]
        least = told.join(rows.select("n", F.col("row.doc_id").alias("id")), "n").groupBy(*group).agg(F.min("n").alias("n"))
        out = rows.join(stored(least.select("n")), "n", "left_semi").select("row.*")
    nameless = docs.filter("doc_id is null")
    return out if nameless.limit(1).isEmpty() else out.unionByName(nameless)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that stand in a document with a smaller id; texts of which nothing is left go.

    Rows that share an id are documents of their own, in the order of their texts' hashes.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").alias("n"), "doc_id", "text", boxed(rest))
    numbered = _numbered(docs.filter("doc_id is not null"))
    if numbered is not None:  # spans are found by id and place, so each row needs an id of its own
        own_ids = numbered.select("n", "row.doc_id", "row.text", F.struct(F.lit(0).alias("_"), *[F.col(f"row.{quoted(c)}").alias(c) for c in rest]).alias("row"))
        rows = own_ids.unionByName(rows.filter("doc_id is null"))
    cut = suffix_dedup.remove_repeats(rows, doc_id="n", length=50, whole_characters=True)
    cut = cut.filter((F.octet_length("kept") > 0) | (F.size("spans") == 0))
    text = F.when(F.col("text").isNotNull(), F.decode("kept", "UTF-8"))
    own = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.char_length(text).cast("long")}
    return cut.select(*[own.get(c, F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands, or nearly so."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    return sentencepiece_codec.encode(docs).withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: A classifier, tokenization and components are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        out = stored(stage(spark, docs, sf_dir))
        forget(docs)
        docs = out
    return docs
