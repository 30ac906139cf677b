"""Detected node groups against known ones. Groups are long: (cid, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.text import guarded
from netloom.operators.order import numbered
from netloom.storage import Store


def overlaps(detected: DataFrame, known: DataFrame) -> DataFrame:
    """(did, kid, shared, nd, nk) of the pairs that share a member; others share none, and no pair is formed for them."""
    d, k = detected.select(F.col("cid").alias("did"), "p").distinct(), known.select(F.col("cid").alias("kid"), "p").distinct()
    nd, nk = d.groupBy("did").agg(F.count(F.lit(1)).alias("nd")), k.groupBy("kid").agg(F.count(F.lit(1)).alias("nk"))
    shared = d.join(k, "p").groupBy("did", "kid").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(nd, "did").join(nk, "kid")


def overlap_score() -> Column:
    return F.col("shared") * F.col("shared") / (F.col("nd") * F.col("nk"))


def jaccard() -> Column:
    return F.col("shared") / (F.col("nd") + F.col("nk") - F.col("shared"))


def _count(groups: DataFrame, name: str) -> DataFrame:
    return groups.agg(F.count_distinct("cid").cast("double").alias(name))


def precision_recall(detected: DataFrame, known: DataFrame, threshold: float = 0.2, pairs: DataFrame | None = None, undefined: float = 0.0) -> DataFrame:
    """One row: precision, recall and f_measure. Both rates count detected groups that a known one overlaps enough.

    ``undefined`` is the f_measure of two rates that are 0.
    """
    pairs = overlaps(detected, known) if pairs is None else pairs
    hits = pairs.where(overlap_score() >= threshold).agg(F.count_distinct("did").cast("double").alias("tp"))
    row = hits.crossJoin(_count(detected, "nd")).crossJoin(_count(known, "nk"))
    p, r = guarded(F.col("tp"), F.col("nd")), guarded(F.col("tp"), F.col("nk"))
    return row.select(p.alias("precision"), r.alias("recall")).withColumn("f_measure", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))).otherwise(F.lit(undefined)))


def coverage_rate(detected: DataFrame, known: DataFrame) -> DataFrame:
    """One row: the share of the known groups' members in known groups that share a member with a detected one."""
    touched = known.join(detected.select("p").distinct(), "p", "left_semi").select("cid").distinct()
    covered = known.join(touched, "cid", "left_semi").agg(F.count_distinct("p").cast("double").alias("covered"))
    return covered.crossJoin(known.agg(F.count_distinct("p").cast("double").alias("all"))).select(guarded(F.col("covered"), F.col("all")).alias("coverage"))


def accuracy(detected: DataFrame, known: DataFrame, threshold: float = 0.2, pairs: DataFrame | None = None) -> DataFrame:
    return precision_recall(detected, known, threshold, pairs).select(F.sqrt(F.col("precision") * F.col("recall")).alias("accuracy"))


def matching_ratio(detected: DataFrame, known: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row, mmr: each known group, in the order of ids, takes its best detected one, the first of equals.

    Its score counts if no known group before it took a detected one with the same members; there is no second choice.
    """
    pairs = overlaps(detected, known) if pairs is None else pairs
    best = pairs.groupBy("kid").agg(F.max_by(F.struct("did", overlap_score().alias("score")), F.struct(overlap_score().alias("s"), (-F.col("did")).alias("d"))).alias("b")).select("kid", "b.did", "b.score")
    content = detected.groupBy(F.col("cid").alias("did")).agg(F.array_join(F.sort_array(F.collect_set(F.col("p").cast("string"))), ",").alias("content"))
    taken = best.join(content, "did").groupBy("content").agg(F.min_by("score", "kid").alias("score"))
    total = taken.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"))
    return total.crossJoin(_count(known, "nk")).select(guarded(F.col("total"), F.col("nk")).alias("mmr"))


def matching_pairs(detected: DataFrame, known: DataFrame, epsilon: float = 1e-3, pairs: DataFrame | None = None) -> DataFrame:
    """(kid, did, score) of a matching of known to detected groups, one to one, whose total is the largest but for epsilon.

    It is an auction. Each known group without a partner bids for the detected group that is worth most to it, its
    overlap less its price: up to where the second best would be worth as much, and epsilon more. The highest bid sets the
    price and takes the group from whom it had; of equal bids that of the smallest id does. Whoever would have to pay all
    that an overlap is worth stays alone. The total is less than the largest by epsilon for each known group at most.
    Detected groups with the same members are one, that of the smallest id. Each round is written, and reads only the
    pairs of those who bid; there are as many rounds as bids follow each other on one group.
    """
    store = Store(detected.sparkSession)
    pairs = overlaps(detected, known) if pairs is None else pairs
    content = detected.groupBy(F.col("cid").alias("did")).agg(F.sort_array(F.collect_set("p")).alias("content"))
    first = content.groupBy("content").agg(F.min("did").alias("did")).select("did")
    worth = store.put(pairs.join(first, "did").select("kid", "did", overlap_score().alias("score")))
    prices = store.put(worth.select("did", F.lit(0.0).alias("price"), F.col("kid").alias("owner")).where("false"))
    bidders = store.put(worth.select("kid").distinct())
    order = Window.partitionBy("kid").orderBy(F.desc("gain"), "did")
    while not bidders.isEmpty():
        offers = worth.join(bidders, "kid").join(prices.select("did", "price"), "did", "left").withColumn("price", F.coalesce("price", F.lit(0.0)))
        ranked = offers.withColumn("gain", F.col("score") - F.col("price")).withColumn("r", F.row_number().over(order)).where("r <= 2 AND gain > 0")
        best = ranked.groupBy("kid").agg(F.min_by(F.struct("did", "price", "gain"), "r").alias("b"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("gain"))), F.lit(0.0)).alias("next"))
        bids = store.put(best.select("kid", "b.did", (F.col("b.price") + F.col("b.gain") - F.col("next") + epsilon).alias("bid")))
        won = bids.groupBy("did").agg(F.max_by("kid", F.struct("bid", -F.col("kid"))).alias("kid"), F.max("bid").alias("bid"))
        held = prices.join(won, "did", "full")
        changed = store.put(held.select("did", F.coalesce("bid", "price").alias("price"), F.coalesce("kid", "owner").alias("owner"), F.when(F.col("kid").isNotNull(), F.col("owner")).alias("out")))
        lost = bids.join(changed.select("did", "owner"), "did").where("kid <> owner").select("kid")
        after = store.put(lost.union(changed.where("out IS NOT NULL").select(F.col("out").alias("kid"))))
        store.free(prices, bidders, bids)
        prices, bidders = changed, after
    return prices.select("did", F.col("owner").alias("kid")).join(worth, ["kid", "did"]).select("kid", "did", "score")


def best_matching_ratio(detected: DataFrame, known: DataFrame, epsilon: float = 1e-3) -> DataFrame:
    """One row, mmr and optimal: the ratio of :func:`matching_ratio`, and that of a largest matching, never below it."""
    pairs = Store(detected.sparkSession).put(overlaps(detected, known))
    total = matching_pairs(detected, known, epsilon, pairs).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"))
    row = total.crossJoin(_count(known, "nk")).crossJoin(matching_ratio(detected, known, pairs))
    return row.select("mmr", F.greatest("mmr", guarded(F.col("total"), F.col("nk"))).alias("optimal"))


def jaccard_index(detected: DataFrame, known: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row: jc and jg, the mean best Jaccard of detected and of known groups, and their harmonic mean; 0 if empty."""
    pairs = overlaps(detected, known) if pairs is None else pairs
    jc = pairs.groupBy("did").agg(F.max(jaccard()).alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("sc"))
    jg = pairs.groupBy("kid").agg(F.max(jaccard()).alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("sg"))
    row = jc.crossJoin(jg).crossJoin(_count(detected, "nd")).crossJoin(_count(known, "nk"))
    return row.select(guarded(F.col("sc"), F.col("nd")).alias("jc"), guarded(F.col("sg"), F.col("nk")).alias("jg")).withColumn("jaccard", guarded(2 * F.col("jc") * F.col("jg"), F.col("jc") + F.col("jg")))


def total_score(detected: DataFrame, known: DataFrame, threshold: float = 0.2, undefined: float = 0.0) -> DataFrame:
    """One row with f_measure, coverage, accuracy, mmr, jaccard and their sum; the overlaps are found once and written."""
    pairs = Store(detected.sparkSession).put(overlaps(detected, known))
    pr = precision_recall(detected, known, threshold, pairs, undefined).select("f_measure", F.sqrt(F.col("precision") * F.col("recall")).alias("accuracy"))
    row = pr.crossJoin(coverage_rate(detected, known)).crossJoin(matching_ratio(detected, known, pairs)).crossJoin(jaccard_index(detected, known, pairs).select("jaccard"))
    return row.withColumn("total", F.col("f_measure") + F.col("coverage") + F.col("accuracy") + F.col("mmr") + F.col("jaccard"))


def order_of(groups: DataFrame, *columns: str) -> DataFrame:
    """Running ids from 1 for group rows, in the order of the columns."""
    rows, _ = numbered(groups, "complex_id", *columns)
    return rows.withColumn("complex_id", F.col("complex_id") + 1)
