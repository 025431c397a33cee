"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, divergence, language_id, merkle, ngram_join, sentencepiece_codec, sharding, suffix_dedup, token_counts, topk_search, toxicity, url_filter
from .common import read

#: The verdicts and rules that the url query holds (fixed values).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
SHARD_BYTES = 1 << 20
#: Texts whose probability of any toxic grade reaches this are rejected: the greatest tenth that loses no toxic text on the part of the
#: labels of sf0.1 that is kept for choosing (tests/llm/test_toxicity.py); that part also chose the penalty of the fit.
REJECT = 0.3


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "first_word", "n_words", "similarity")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = sharding.assign_shards(docs, "doc_id", F.octet_length("text"), SHARD_BYTES)
    return out.withColumnRenamed("key", "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "severity", "p_toxic", "grade", (F.col("p_toxic") >= REJECT).alias("toxic"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_ngrams(read(spark, sf_dir, "documents"), k=4, per_100=85)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.digest(chat_format.format_chats(chats.unionByName(more)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return token_counts.suffix_sums(token_counts.length_histogram(token_counts.encoded_lengths(docs)))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk_search.search_top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, length=50)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fields = lambda text: merkle.row_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(docs, "doc_id", "source", fields(F.col("text")), F.when(hit, fields(lowered)))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.train_languages(docs.filter(~held_out))
    return language_id.predict_languages(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_sharding, op3_toxicity, op4_ngram_join, op5_chat_formatting, op6_token_counts, op7_topk_search, op8_suffix_dedup, op9_sentencepiece, op10_url_filters, op11_merkle_manifest, op12_language_id, op13_source_divergence)}
