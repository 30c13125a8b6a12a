"""From raw documents to a training mix: five stages, each working on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.llm import decontamination, mixing, neardups, passages, quality
from ledgerscope.llm.tables import read
from ledgerscope.session import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    ranking = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.kept(docs, ranking)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return neardups.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur in one of smaller id."""
    return passages.without_repeats(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def take_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, numbered by ``epoch``."""
    return mixing.mixed(docs)


STAGES = [
    ("quality", keep_good),
    ("near duplicates", keep_one_of_each),
    ("repeated passages", cut_repeats),
    ("decontamination", keep_clean),
    ("mixing", take_mix),
]

# Learned scores, hashes and edit distances have no counterpart in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a directory of tables; each stage is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
