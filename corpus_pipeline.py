"""A corpus pipeline of the library's operators: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
`documents`; the last returns their encodings. Extra columns of docs, whatever their names, are
left out; an empty table gives an empty result; texts of any length are taken whole. What else is
defined for odd rows is said with each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, langid, line_dedup, mixing, similar
from ledgerloom.llm._shared import durable, one_of_each, row_key, shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough margin; others, those without a letter among them, go.

    A null or empty text goes. Null ids, sources and labels are no matter; nothing is learned from a row with a null id or
    label. Each of some repeated rows stays or goes like the others.
    """
    return langid.identify(docs.select(*COLUMNS)).filter(~F.col("rejected")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a large share of a source's distinct texts have are taken out; the source stands for the host.

    Copies of a document count once, so that a large group of them doesn't make all its lines boilerplate. Every row stays,
    repeated ones too; without a source nothing is taken out; a null text stays null, with a null n_chars; a text may become empty.
    """
    kept = line_dedup.drop_boilerplate(docs.select(*COLUMNS), "source", "text", share=0.02, pages_least=5, distinct=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) one row stays: that with the smallest id, nulls last.

    A hash of all columns tells rows with a null or repeated id; of rows alike in all columns one stays. Null and empty texts
    and those of white space are copies of each other.
    """
    keyed = docs.select(*COLUMNS).select("*", *row_key(*COLUMNS))
    ranked = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_k0", "_k1")
    groups = similar.near_duplicates(keyed.select(ranked.alias("doc_id"), "text"))
    first = groups.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id._k0", "doc_id._k1").agg(F.count(F.lit(1)).alias("_n"))
    return one_of_each(keyed, durable(first)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source, the last.

    A null or empty text has no words and isn't taken. What is taken of rows alike in all columns is summed up and is copies of one.
    """
    keyed = docs.select(*COLUMNS).select("*", *row_key(*COLUMNS))
    return mixing.copies_by_key(keyed, mixing.mix(keyed, keep=("_k0", "_k1")).rows).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of each document, repeated rows too; a null text is empty and has none."""
    ids = bpe.encode(F.col("text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", "source", ids.alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Compression, fingerprints and encoding are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
