"""Corpus pipeline: from ``documents`` to sampled piece ids, in five stages that each write a table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import decontamination, jaccard_join, line_dedup, piece_sampling, quality
from chronoloom.llm.shared import WorkTables, write_shared

#: Tables that only the stage before still reads: each stage removes them, since its input is written.
WORK = WorkTables()


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    with WORK:
        return quality.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, or nearly so, go; so does a document that has none left."""
    WORK.release(spark)
    with WORK:
        return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, Jaccard 0.8 or more)."""
    WORK.release(spark)
    with WORK:
        return jaccard_join.keep_one(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item, within its error budget, go."""
    WORK.release(spark)
    with WORK:
        return decontamination.drop_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the sampled piece ids."""
    WORK.release(spark)
    with WORK:
        return piece_sampling.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", sample_pieces),
]
#: Learned weights, an edit join and sampling are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
