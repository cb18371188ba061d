"""A corpus pipeline over documents: toxicity, quality rules, near duplicates, source mixing and token encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next one.
All but the last return the columns of documents; the last one gives doc_id, n_tokens, ids_sha256 and decoded_sha256 for
every copy that the mix holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import bpe, mixing, ngram_join, quality, toxicity
from sievework.llm.common import materialize, table
from sievework.llm.queries import bpe_digests, tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the ordinal regression, fitted on a bounded sample of labelled rows, rejects."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that break no rule of the threshold table."""
    return quality.keep(docs)


def reject_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word shingles at a Jaccard index of 0.8 or more."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded text."""
    return bpe_digests(bpe.encode(docs, tokenizer_path(), decoded=True))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality rules", reject_low_quality),
    ("n-gram Jaccard join", reject_near_duplicates),
    ("source mixing", mix_sources),
    ("BPE", encode),
]

#: SQL can express neither the toxicity model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
