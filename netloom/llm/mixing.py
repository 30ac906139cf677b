"""Sources mixed to target weights: a budget of tokens goes down a tree, and each leaf gives a prefix of its epochs.

Every node divides what it gets among its children by weight. A child that has less than its share gives all it has,
and the rest goes to its siblings by weight; only what no sibling can take goes back up, because a node never gets
more than its leaves hold. A leaf deals its documents in an order that a seed and the epoch decide, one epoch after
the other, and gives the longest prefix within its budget. Only DataFrame operations run.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.columns import fresh
from netloom.storage import Store

#: Rows of a leaf that one task adds up at a time.
ROWS_PER_BLOCK = 2_000
#: Leaves whose last draws are sent to where the texts are; of a larger tree, the ids of the chosen rows move.
LEAVES = 50_000


def words_in(text: Column) -> Column:
    """Tokens of a text for budgets: its words between ASCII white space."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain == "", F.lit(0)).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def weight_of(node: Column, weights: Mapping[str, float], default: float) -> Column:
    """The weight of a node by its name; names that the mapping lacks have ``default``."""
    named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    return F.coalesce(named[node], F.lit(float(default))) if weights else F.lit(float(default))


def pour(children: DataFrame, parent: Sequence[str], got: Column) -> DataFrame:
    """``children`` (parent's columns, name, weight, holds) with ``gets``: the parent's budget, filled up by weight.

    In order of what a child holds for its weight, the first children give all they hold, while the level that this
    implies for the others does not go beyond the budget; the others share what is left by weight.
    """
    able = children.where("weight > 0 and holds > 0").withColumn("budget", got)
    order = Window.partitionBy(*parent).orderBy(F.col("holds") / F.col("weight"), "name")
    before = F.coalesce(F.sum("holds").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    beyond = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = able.withColumn("full", before + F.col("holds") / F.col("weight") * beyond <= F.col("budget"))
    whole = Window.partitionBy(*parent)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("holds"))).over(whole), F.lit(0))
    share = F.col("weight") / F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    return full.withColumn("gets", F.when(F.col("full"), F.col("holds").cast("double")).otherwise(left * share)).drop("budget", "full")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, float]], defaults: Sequence[float], budget: float, epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens, n) with ``gets`` for those that get something; the tree has a few thousand nodes."""
    nodes = []
    for depth in range(1, len(levels) + 1):
        own = list(levels[:depth])
        nodes.append(leaves.groupBy(*own).agg((F.sum("tokens") * epochs).alias("holds")).withColumn("weight", weight_of(F.col(own[-1]), weights[depth - 1], defaults[depth - 1])).withColumn("name", F.col(own[-1])))
    top = nodes[0].withColumn("all", F.lit(0))
    given = pour(top, ["all"], F.least(F.lit(float(budget)), F.sum(F.when(F.col("weight") > 0, F.col("holds"))).over(Window.partitionBy("all")).cast("double"))).select(*levels[:1], F.col("gets").alias("above"))
    for depth in range(2, len(levels) + 1):
        parent = list(levels[: depth - 1])
        given = pour(nodes[depth - 1].join(given, parent), parent, F.col("above")).select(*levels[:depth], F.col("gets").alias("above"))
    return leaves.join(given.withColumnRenamed("above", "gets"), list(levels))


def node_of(expression: str) -> Column:
    """The node that a level's SQL expression gives a document; a null is the node ``""``."""
    return F.coalesce(F.expr(expression).cast("string"), F.lit(""))


def draw_of(doc_id: Column, epoch: Column, seed: str) -> Column:
    """What orders a leaf's documents in an epoch; the same for all rows with one id."""
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(df: DataFrame, levels: Mapping[str, str], weights: Sequence[Mapping[str, float]], share: float, epochs: int = 1, defaults: Sequence[float] | None = None, seed: str = "mix", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document that is chosen and epoch: doc_id, the levels, epoch, tokens, and its leaf's budget ``leaf_tokens``.

    ``levels`` names the tree's levels, top first, with the SQL expression that gives a document's node; a null is the
    node ``""``. ``weights`` has a mapping for each level. The budget is ``share`` of all tokens. ``epochs`` is how
    often a document may come at most. A null or empty text has no tokens and comes along if its turn is within the
    budget. Rows with one id have one place in the order; repeated rows are separate documents. A tree of which all
    weights are 0, or an empty table, gives no rows.
    """
    store = Store(df.sparkSession)
    names = [f"level_{i}" for i in range(len(levels))]
    defaults = list(defaults or [1.0] * len(names))
    placed = df.select(F.col(f"`{doc_id}`").alias("doc_id"), words_in(F.col(f"`{text}`")).alias("tokens"), *[node_of(c).alias(n) for n, c in zip(names, levels.values(), strict=True)])
    rows = store.put(placed)
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).head()[0]
    given = store.put(leaf_budgets(leaves, names, weights, defaults, math.floor(total * share), epochs).select(*names, F.col("tokens").alias("leaf_held"), F.floor(F.col("gets") + 1e-6).alias("leaf_tokens"), "n"))
    turn = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    draw = draw_of(F.col("doc_id"), F.col("epoch"), seed)
    unit = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    # A leaf's epoch is cut into blocks by its order, so that no task adds up a leaf alone.
    dealt = rows.join(given, names).select("*", turn.alias("epoch")).withColumn("draw", draw).withColumn("block", F.floor(unit * F.ceil(F.col("n") / ROWS_PER_BLOCK) / F.lit(2**32)).cast("long"))
    leaf, block = [*names], [*names, "epoch", "block"]
    sums = dealt.groupBy(*block).agg(F.sum("tokens").alias("block_tokens"))
    ahead = F.coalesce(F.sum("block_tokens").over(Window.partitionBy(*leaf).orderBy("epoch", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("ahead", ahead).drop("block_tokens")
    within = F.sum("tokens").over(Window.partitionBy(*block).orderBy("draw", "tokens").rowsBetween(Window.unboundedPreceding, 0))
    chosen = dealt.withColumn("within", within).join(sums, block).where("ahead + within <= leaf_tokens")
    return chosen.select("doc_id", *[F.col(n).alias(k) for n, k in zip(names, levels, strict=True)], F.col("epoch").cast("int").alias("epoch"), "tokens", "leaf_tokens")


def chosen_rows(df: DataFrame, levels: Mapping[str, str], weights: Sequence[Mapping[str, float]], share: float, defaults: Sequence[float] | None = None, seed: str = "mix", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that one epoch of :func:`mix` chooses, with their columns.

    Rows of a leaf with one id go together. A leaf's chosen rows are those up to its last draw, so only that is sent to
    the texts, which stay where they are.
    """
    store = Store(df.sparkSession)
    stays, end, *leaf = fresh(df, "stays", "end", *[f"leaf_{i}" for i in range(len(levels))])
    chosen = mix(df, levels, weights, share, 1, defaults, seed, doc_id, text).select(F.col("doc_id").alias(stays), *[F.col(k).alias(n) for n, k in zip(leaf, levels, strict=True)])
    own, epoch = F.col(f"`{doc_id}`"), F.lit(0)
    last = store.put(chosen.groupBy(*leaf).agg(F.max(draw_of(F.col(stays), epoch, seed)).alias(end)))
    same = F.lit(True)
    for n, c in zip(leaf, levels.values(), strict=True):
        same = same & (node_of(c) == F.col(n))
    if last.count() <= LEAVES:
        return df.join(F.broadcast(last), same & (draw_of(own, epoch, seed) <= F.col(end)), "left_semi")
    return df.join(chosen, same & own.eqNullSafe(F.col(stays)), "left_semi")
