"""The registered queries of the corpus operators: each applies its operator to the whole table and returns the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, linededup, mixing, oracles, quality, repair, setsketch, substr, tokencount, urlfilter


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures: every page's url, fetched on a day that follows from its id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return pages.withColumn("fetched", F.expr("date_add(DATE '2024-01-01', cast(page_id * 37 % 600 AS int))"))


def _list(captures: DataFrame) -> DataFrame:
    """Dated list entries for about a third of the keys of all captures (paths of two folders at most, as in the SQL), their days and
    categories from a hash of the key."""
    keys = captures.select(F.explode(urlfilter.keys_of("url", 2)).alias("key")).distinct()
    number = lambda at: F.conv(F.substring(F.md5(F.col("key").cast("binary")), at, 4), 16, 10).cast("int")
    e = keys.select("key", number(1).alias("x"), number(5).alias("y")).filter("x % 3 = 0")
    e = e.withColumn("day", F.expr("x % 300")).withColumn("category", F.expr("element_at(array('ads', 'malware', 'spam'), 1 + y % 3)"))
    dated = [e.select("key", "category", "day", F.lit("add").alias("action"))]
    dated.append(e.filter("y % 4 <> 0").select("key", "category", F.expr("day + 30 + y % 200").alias("day"), F.lit("remove").alias("action")))
    dated.append(e.filter("y % 4 <> 0 AND y % 5 = 0").select("key", "category", F.expr("day + 50 + y % 200").alias("day"), F.lit("add").alias("action")))
    every = dated[0].unionByName(dated[1]).unionByName(dated[2])
    return every.select("key", "category", F.expr("date_add(DATE '2024-01-01', day)").alias("ts"), "action")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share in a mix of all sources."""
    return mixing.mix(_docs(spark, sf_dir)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontam.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal and near lines of all documents, and those that go."""
    return linededup.dedup_lines(_docs(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 35 words that start twice."""
    return substr.remove_repeats(_docs(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix-array repetition rules over every document."""
    return quality.with_facts(_docs(spark, sf_dir).select("doc_id", "text")).drop("text")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SetSketch near-duplicate components of every document."""
    return setsketch.near_duplicates(_docs(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the 32k piece model."""
    return tokencount.count_tokens(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = _docs(spark, sf_dir)
    return langid.predict(docs, langid.learn(docs))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries active when each page was fetched."""
    captures = _pages(spark, sf_dir)
    return urlfilter.active(captures, _list(captures)).select("page_id", F.col("fetched").cast("string").alias("fetched"), *urlfilter.RESULT)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, read back from compressed shards."""
    return repair.token_ids(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_decontaminate, op3_line_dedup, op4_substring_dedup, op5_quality_rules, op6_minhash_near_dedup, op7_token_counts, op8_language_id, op9_url_filters, op10_token_ids)}
ORACLES = oracles.ORACLES
