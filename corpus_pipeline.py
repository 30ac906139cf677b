"""A corpus pipeline of five stages; each takes what the one before kept.

run(spark, sf_dir) applies them to the documents of a folder. What a stage returns is written and read again, so a
lost executor repeats one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import decontam, jaccard_join, mixing, queries, sharding, toxicity
from netloom.storage import Store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay; the labels of the folder train the scorer."""
    return toxicity.without_toxic(docs, queries.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word n-grams with a similarity of 0.8 link stays: that of the smallest id."""
    return jaccard_join.keep_one(docs, n=5, percent=80)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage stay."""
    return decontam.clean_of(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of one epoch that the target weights choose stay; rows of a source with one id go together."""
    return mixing.chosen_rows(docs, queries.TREE, queries.TREE_WEIGHTS, queries.PIPELINE_SHARE, queries.TREE_DEFAULTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and place in it."""
    return sharding.assign_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Toxicity's trained scores and the alignment of passages are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    store = Store(spark)
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
