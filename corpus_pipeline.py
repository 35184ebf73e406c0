"""A training-data pipeline: five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import decontam, line_dedup, ngram_join, packing, store, toxicity

#: At and above this score a document is rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all usable labels of these documents, doesn't find toxic; rows without an id are judged by their text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    toxic = store.written(scored.where(F.col("score") >= TOXIC).select("doc_id", "version").distinct(), "toxic")
    return store.anti_row(docs, toxic)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that near-repeat an earlier one; those left without any text are dropped, all others are judged as documents by the next stage."""
    kept = line_dedup.rewritten(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group that near-duplicate links connect (five-word shingles, similarity of 0.8 or more)."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth; rows without an id are judged by their text."""
    judged = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = store.written(judged.where("contaminated").select("doc_id", "version").distinct(), "contaminated")
    return store.anti_row(docs, found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("ngram_jaccard_join", one_per_group), ("decontamination", drop_contaminated), ("packing", pack)]

#: Classifier, edit join and tokenizer have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
