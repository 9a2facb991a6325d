"""From raw documents to token ids: five stages, each a function of (spark, docs, sf_dir) on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.llm import bpe, decontaminate, line_dedup, near_copies, quality, simhash
from tipoff.llm.common import prepare, read
from tipoff.llm.queries import TOKENIZER
from tipoff.scratch import stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, does not reject."""
    prepare(spark)
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), model) >= 0.5)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines, a group of copies counting once; n_chars follows the text."""
    done = line_dedup.drop_boilerplate(docs, copies_once=True)
    return done.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: texts whose SimHash fingerprints are as near as op7 has it, or that share 0.8
    of their five-word shingles."""
    prepare(spark)
    return near_copies.one_of_each(docs, max_bits=simhash.MAX_BITS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    prepare(spark)
    return decontaminate.mark(docs, read(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with the hash of what they decode to."""
    prepare(spark)
    done = bpe.round_trip(F.col("text"), public_tokenizers.path(TOKENIZER))
    return docs.select("doc_id", "lang", "source", done.alias("done")).select("doc_id", "lang", "source", "done.*")


STAGES = [
    ("quality", good_documents),
    ("line_dedup", without_boilerplate),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("tokens", tokenised),
]

# compressed sizes and BPE merges are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
