"""Edge lists as graphs: neighbours, degrees, density, and node groups that hold together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.text import guarded
from netloom.operators.components import component_labels
from netloom.storage import Store

#: Nodes that a task remembers while it builds forests, and edges of one group that it merges.
HELD_NODES, MERGED_EDGES = 1_000_000, 1_000_000


def simple(edges: DataFrame, a: str = "protein1", b: str = "protein2") -> DataFrame:
    """Distinct edges (u, v), the smaller end first; a loop stays."""
    return edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct()


def symmetric(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(src, dst) in both directions, each once."""
    return edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).union(edges.select(b, a)).distinct()


def weighted(edges: DataFrame, row_id: str, a: str = "protein1", b: str = "protein2", weight: str = "weight") -> DataFrame:
    """Symmetric (src, dst, weight); of edges that come again, the last weight by ``row_id`` counts."""
    one = edges.groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.max_by(weight, row_id).alias("weight"))
    return one.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight").union(one.where("u <> v").select("v", "u", "weight"))


def degrees(both: DataFrame) -> DataFrame:
    """(node, degree) of a symmetric view; a loop makes a node its own neighbour."""
    return both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def interaction_count(both: DataFrame) -> DataFrame:
    """Half the sum of the neighbour counts, rounded down."""
    return both.agg(F.floor(F.count(F.lit(1)) / 2).cast("long").alias("interactions"))


def network_stats(edges: DataFrame, weight: str = "weight", a: str = "protein1", b: str = "protein2") -> DataFrame:
    """One row: proteins, interactions, mean_weight and density (0 with fewer than two proteins)."""
    totals = edges.agg(F.count(F.lit(1)).alias("interactions"), F.avg(weight).alias("mean_weight"))
    n = edges.select(F.col(a).alias("p")).union(edges.select(b)).agg(F.count_distinct("p").alias("proteins"))
    pairs = F.col("proteins") * (F.col("proteins") - 1) / 2
    return totals.crossJoin(F.broadcast(n)).select("proteins", "interactions", "mean_weight", guarded(F.col("interactions"), pairs).alias("density"))


def _inside(own: DataFrame, both: DataFrame) -> DataFrame:
    """(complex_id, a, b), a < b, of the edges between two members of a group.

    A member is looked up with the others of its group or with its neighbours, whichever are fewer.
    """
    known = own.join(degrees(both).withColumnRenamed("node", "protein"), "protein")
    known = known.join(own.groupBy("complex_id").agg(F.count(F.lit(1)).alias("n")), "complex_id").withColumnRenamed("protein", "a")
    ends = own.select("complex_id", F.col("protein").alias("b"))
    half = both.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    pairs = known.where("n <= degree").select("complex_id", "a").join(ends, "complex_id").where("a < b").join(half, ["a", "b"], "left_semi")
    edges = known.where("n > degree").select("complex_id", "a").join(half, "a").join(ends, ["complex_id", "b"], "left_semi")
    return pairs.select("complex_id", "a", "b").union(edges.select("complex_id", "a", "b"))


def spanning_forest(edges: DataFrame, by_group: bool = False) -> DataFrame:
    """Of (complex_id, a, b) the edges that join two trees of their group's forest, as each task sees them.

    A task keeps the roots of the nodes that it has met. It forgets them after HELD_NODES, or with ``by_group``, for rows
    in the order of their groups, behind each group; what it then lets through again is one more edge, which joins no
    trees when forests are merged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        last = None

        def find(x: tuple) -> tuple:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            kept = []
            for i, (group, a, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if group != last if by_group else len(root) > HELD_NODES:
                    root, last = {}, group
                x, y = find((group, a)), find((group, b))
                if x != y:
                    root[x] = y
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return edges.mapInArrow(run, edges.schema)


def _trees(edges: DataFrame, store: Store) -> DataFrame:
    """(complex_id, joined): the edges of each group's spanning forest, which are its nodes less its trees.

    Forests of the tasks are merged group by group. A group whose forests have more than MERGED_EDGES edges between them
    is not for one task; its nodes are labelled together with those of all such groups.
    """
    parts = store.put(spanning_forest(edges))
    giant = parts.groupBy("complex_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MERGED_EDGES).select("complex_id")
    giant = store.put(giant)
    some = not giant.isEmpty()
    rest = parts.join(giant, "complex_id", "left_anti") if some else parts
    merged = spanning_forest(rest.repartition("complex_id").sortWithinPartitions("complex_id"), by_group=True)
    trees = merged.groupBy("complex_id").agg(F.count(F.lit(1)).alias("joined"))
    if not some:
        return trees
    a, b = (F.struct("complex_id", F.col(c).alias("protein")) for c in ("a", "b"))
    labels = component_labels(parts.join(giant, "complex_id", "left_semi").select(a.alias("a"), b.alias("b")), store)
    # A tree's label is one of its nodes; all others of its nodes are one edge each.
    return trees.union(labels.groupBy(F.col("node.complex_id").alias("complex_id")).agg(F.count_if(F.col("node") != F.col("label")).alias("joined")))


def connected_groups(members: DataFrame, both: DataFrame, empty: bool = True, single: bool = True) -> DataFrame:
    """(complex_id, connected) for each group of ``members`` (complex_id, protein) over a symmetric graph.

    Only edges inside the group count; it holds together if its spanning forest has one edge less than it has members.
    ``empty`` and ``single`` are the answers for groups without members and of one. Null members do not count.
    """
    store = Store(members.sparkSession)
    return _judged(store.put(members.select("complex_id", "protein").distinct()), store.put(both.select("src", "dst")), store, empty, single)


def _judged(members: DataFrame, both: DataFrame, store: Store, empty: bool = True, single: bool = True) -> DataFrame:
    """:func:`connected_groups` of distinct members, both frames written before."""
    own = members.where(F.col("protein").isNotNull())
    trees = _trees(_inside(own, both), store)
    sizes = members.groupBy("complex_id").agg(F.count_distinct("protein").alias("n"))
    whole = F.coalesce("joined", F.lit(0)) == F.col("n") - 1
    connected = F.when(F.col("n") == 0, F.lit(empty)).when(F.col("n") == 1, F.lit(single)).otherwise(whole)
    return sizes.join(trees, "complex_id", "left").select("complex_id", connected.alias("connected"))


def filter_groups(members: DataFrame, both: DataFrame, min_size: int = 3) -> DataFrame:
    """(complex_id, status) by the first rule that fails: small, missing, disconnected, or kept."""
    store = Store(members.sparkSession)
    members, both = store.put(members.select("complex_id", "protein").distinct()), store.put(both.select("src", "dst"))
    known = both.select(F.col("src").alias("protein"), F.lit(True).alias("known")).distinct()
    sizes = members.join(known, "protein", "left").groupBy("complex_id").agg(F.count("protein").alias("size"), F.count("known").alias("present"))
    whole = sizes.where((F.col("size") >= min_size) & (F.col("present") == F.col("size")))
    judged = _judged(members.join(whole.select("complex_id"), "complex_id", "left_semi"), both, store)
    status = F.when(F.col("size") < min_size, "small").when(F.col("present") < F.col("size"), "missing").when(F.col("connected"), "kept").otherwise("disconnected")
    return sizes.join(judged, "complex_id", "left").select("complex_id", "size", status.alias("status"))


def filter_counts(statuses: DataFrame) -> DataFrame:
    """One row of counters: total, kept, small, missing, disconnected."""
    return statuses.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("kept", "small", "missing", "disconnected")])


def size_distribution(members: DataFrame) -> DataFrame:
    """(size, groups, share) of the group sizes; mean_size is the same on each row."""
    sizes = members.groupBy("complex_id").agg(F.count_distinct("protein").alias("size"))
    counts = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
    whole = Window.partitionBy(F.lit(0))
    return counts.select("size", "groups", (F.col("groups") / F.sum("groups").over(whole)).alias("share"), (F.sum(F.col("size") * F.col("groups")).over(whole) / F.sum("groups").over(whole)).alias("mean_size"))


def frequent_members(members: DataFrame, n: int = 10) -> DataFrame:
    """The proteins in most groups."""
    return members.distinct().groupBy("protein").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.desc("groups"), "protein").limit(n)


def unique_groups(members: DataFrame, order: str) -> DataFrame:
    """One id for each member set: the first by ``order``, a column of ``members`` that is the same in a group."""
    sets = members.groupBy("complex_id").agg(F.array_join(F.sort_array(F.collect_set("protein")), ";").alias("proteins"), F.min(order).alias("__order"))
    return sets.groupBy("proteins").agg(F.min_by("complex_id", F.struct("__order", "complex_id")).alias("complex_id"))
