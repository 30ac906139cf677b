"""Several scores of a pair made one weight."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.text import number


def load_scores(df: DataFrame) -> DataFrame:
    """(protein1, protein2, weight) of a frame's first three columns: readable numbers, canonical, without repeats."""
    a, b, w = df.columns[:3]
    rows = df.select(F.least(F.col(a), F.col(b)).alias("protein1"), F.greatest(F.col(a), F.col(b)).alias("protein2"), number(F.col(w).cast("string")).alias("weight"))
    return rows.na.drop("any").dropDuplicates()


def _mean(columns: list[Column]) -> Column:
    present = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(present), F.lit(0))


def mean_of_any(columns: list[Column]) -> Column:
    """The mean of the scores that are there; a zero is a score, a NaN or null is none, and without any it is null."""
    return _mean([F.nanvl(c, F.lit(None)) for c in columns])


def mean_of_all(columns: list[Column]) -> Column:
    """The mean of the scores that are not 0, of which none may be missing; null if one is or all are 0."""
    total, used = reduce(lambda a, b: a + b, columns), reduce(lambda a, b: a + b, [(c != 0).cast("int") for c in columns])
    whole = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in columns])
    return F.when(whole, total / F.nullif(used, F.lit(0)))


def fuse_union(scores: Mapping[str, DataFrame]) -> DataFrame:
    """Every pair of any source with the mean of the scores it has; a zero is a score, a NaN or null is none.

    Of scores that a source repeats for a pair, the largest counts.
    """
    parts = [df.select(F.least("protein1", "protein2").alias("protein1"), F.greatest("protein1", "protein2").alias("protein2"), F.lit(k).alias("kind"), F.nanvl(F.col("weight"), F.lit(None)).alias("weight")) for k, df in scores.items()]
    rows = reduce(DataFrame.unionByName, parts).groupBy("protein1", "protein2")
    best = rows.agg(*[F.max(F.when(F.col("kind") == k, F.col("weight"))).alias(k) for k in scores])
    return best.select("protein1", "protein2", _mean([F.col(k) for k in scores]).alias("weight")).where(F.col("weight").isNotNull())


def fuse_intersection(scores: Mapping[str, DataFrame]) -> DataFrame:
    """(protein1, protein2, mean_weight) of the pairs that all sources have: the mean of the weights that are not 0.

    Pairs whose weights are all 0 go. Sources are made canonical before repeats are removed; of scores that a source
    repeats for a pair, the largest counts. One shuffle by the pair serves all sources.
    """
    parts = [load_scores(df).withColumn("kind", F.lit(k)) for k, df in scores.items()]
    rows = reduce(DataFrame.unionByName, parts).groupBy("protein1", "protein2")
    best = rows.agg(*[F.max(F.when(F.col("kind") == k, F.col("weight"))).alias(k) for k in scores]).na.drop("any", subset=list(scores))
    kinds = [F.col(k) for k in scores]
    total, used = reduce(lambda a, b: a + b, kinds), reduce(lambda a, b: a + b, [(k != 0).cast("int") for k in kinds])
    return best.where(used > 0).select("protein1", "protein2", (total / used).alias("mean_weight"))
