"""A training corpus from `documents`: toxic documents go, near-duplicate groups keep one, contaminated documents go,
sources are mixed to target weights, and what is left is dealt out to shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. A stage's result is written as Parquet in the shared checkpoint folder and read again. Null or
empty texts are kept unless they form a group (empty texts share a fingerprint); an empty table stays empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockyard.llm.common import read_table
from blockyard.llm.decontaminate import drop_contaminated
from blockyard.llm.mixing import mixed_rows
from blockyard.llm.sharding import assign_shards
from blockyard.llm.simhash import keep_first
from blockyard.llm.toxicity import drop_toxic
from blockyard.session import materialize, prepare

SHARDS = 8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below their language's threshold."""
    prepare(spark)
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    prepare(spark)
    return keep_first(docs, width=3, radius=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    prepare(spark)
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per reading of a document, range-sorted by its place in training; documents read twice come twice."""
    prepare(spark)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("document")
    return mixed_rows(docs.select("doc_id", "text", "source", row)).select("document.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their shard."""
    prepare(spark)
    return assign_shards(docs, "doc_id", SHARDS)


STAGES = [("toxicity", toxicity), ("simhash near-dedup", simhash_near_dedup), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]

#: SQL can express neither the trained classifier nor XXH64 fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on the rows that the one before has written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
