"""How many nodes networks have and share, from sketches that are kept for each part and merged.

A theta sketch of ``2 ** lg_k`` entries is exact up to as many distinct nodes; beyond, its relative standard error is
``1 / sqrt(2 ** lg_k)`` for a union, and for an intersection that times the root of union by intersection. The exact counts
of :mod:`netloom.operators.clean` stay the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14
#: The column of the share that a sketch holds.
SHARE = "share"


def node_sketches(edges: DataFrame, *parts: str, a: str = "protein1", b: str = "protein2", lg_k: int = LG_K, shares: int = 0) -> DataFrame:
    """(parts, sketch) of the end nodes of each part's edges, such as a network's on a day; null ends do not count.

    With ``shares`` the nodes are dealt by hash to so many shares, each with sketches of its own: a column SHARE comes
    along, by which sketches are merged and paired as by any part, and the counts of the shares add up.
    """
    ends = edges.select(*parts, F.explode(F.array(a, b)).alias("node")).where("node IS NOT NULL")
    if shares:
        ends, parts = ends.withColumn(SHARE, F.pmod(F.xxhash64("node"), F.lit(shares))), (*parts, SHARE)
    return ends.groupBy(*parts).agg(F.theta_sketch_agg("node", lg_k).alias("sketch"))


def shares_for(edges: DataFrame, a: str = "protein1", b: str = "protein2", lg_k: int = LG_K) -> int:
    """How many shares keep all sketches exact: about a quarter of ``2 ** lg_k`` nodes in each."""
    found = edges.select(F.explode(F.array(a, b)).alias("node")).agg(F.approx_count_distinct("node").alias("n")).head().n
    return max(1, -(-found * 4 // 2**lg_k))


def merged(sketches: DataFrame, *parts: str, lg_k: int = LG_K) -> DataFrame:
    """The sketches of coarser parts; no edge is read again."""
    return sketches.groupBy(*parts).agg(F.theta_union_agg("sketch", lg_k).alias("sketch"))


def node_counts(sketches: DataFrame) -> DataFrame:
    """The parts with the estimated number of their nodes, shares added up."""
    counts = sketches.withColumn("nodes", F.theta_sketch_estimate("sketch")).drop("sketch")
    if SHARE not in counts.columns:
        return counts
    return counts.groupBy([c for c in counts.columns if c not in (SHARE, "nodes")]).agg(F.sum("nodes").alias("nodes"))


def shared_nodes(sketches: DataFrame, part: str, lg_k: int = LG_K) -> DataFrame:
    """(part, other, shared, either) for part < other: the estimated nodes that both or either of two parts have.

    Parts are few, since each pair is a row of the result.
    """
    by = [SHARE] if SHARE in sketches.columns else []
    one = sketches.select(part, *by, "sketch")
    two = sketches.select(F.col(part).alias("other"), *by, F.col("sketch").alias("with"))
    pairs = (one.join(two.hint("merge"), by) if by else one.crossJoin(two)).where(F.col(part) < F.col("other"))
    counts = pairs.select(part, "other", F.theta_sketch_estimate(F.theta_intersection("sketch", "with")).alias("shared"), F.theta_sketch_estimate(F.theta_union("sketch", "with", lg_k)).alias("either"))
    return counts.groupBy(part, "other").agg(F.sum("shared").alias("shared"), F.sum("either").alias("either")) if by else counts
