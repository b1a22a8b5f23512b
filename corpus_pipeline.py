"""A training-data pipeline over the documents table: each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from semspark.llm import decontaminate, mixing, quality, simhash, toxicity
from semspark.llm.queries import read
from semspark.llm.scratch import cut, made, sweep
from semspark.llm.text import crc_fold


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    judged = quality.score(docs, read(spark, sf_dir, "labels"), crc_fold("doc_id", 3) != 1, carry=True)
    return judged.where("predicted = 1").select("row.*")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic."""
    judged = toxicity.score(docs, read(spark, sf_dir, "labels"), crc_fold("doc_id", 5) != 0, carry=True)
    return judged.where("predicted = 0").select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word Jaccard similarity 0.8): that of the smallest doc_id."""
    return simhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of a benchmark item: one window of 13 words, however long the document, is enough."""
    judged = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"), carry=True)
    return judged.where("n_hit = 0").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies and taken."""
    return mixing.mix(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The marks of the folders that the last stage made.
_last = [0, 0]


def swept(stage: Stage) -> Stage:
    """The stage, which first removes what the one before left in the shared folder: by then its result has been written."""

    def work(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, *_last, keep=docs)
        first = made()
        out = stage(spark, docs, sf_dir)
        _last[:] = first, made()
        return out

    return work


STAGES = [
    ("quality classifier", swept(good_quality)),
    ("toxicity", swept(not_toxic)),
    ("SimHash near-dedup", swept(without_near_copies)),
    ("benchmark decontamination", swept(without_benchmark)),
    ("mixing sources to target weights", swept(mixed)),
]

#: No SQL fits a discriminant, neighbours' votes or a balanced sample; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
