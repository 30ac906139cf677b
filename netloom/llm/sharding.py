"""Shards by rendezvous hashing: each record goes to the shard for which its key draws the highest score.

The score of key and shard is ``-weight / ln(u)`` with ``u`` from a hash of both, so a shard gets its share by weight.
A shard that is added draws its own scores and leaves all others as they were; only the keys that it wins move.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.columns import fresh
from netloom.storage import Store

#: Rows that one task numbers at a time.
ROWS_PER_BLOCK = 100_000


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, of a string key; shards of weight 0 get nothing, and at least one weight is positive."""
    if not any(w > 0 for w in weights) or any(w < 0 or not math.isfinite(w) for w in weights):
        raise ValueError("weights must not be negative, and one must be positive")

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) * (2.0**-53)
        return F.struct((F.lit(-weight) / F.ln(u)).alias("score"), F.lit(-shard).alias("last"))

    drawn = [score(i, float(w)) for i, w in enumerate(weights) if w > 0]
    return (-(F.greatest(*drawn) if len(drawn) > 1 else drawn[0])["last"]).cast("int")


def key_of(doc_id: Column) -> Column:
    """The key of a record: its id as text; all null ids have one key."""
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def assign_shards(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 24, weights: Sequence[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    ``size`` is the text's UTF-8 bytes (none if null) plus 8. The law is ``key``: the id and the weights decide the
    shard, so rows with one id share it. ``slot`` numbers the rows of a shard from 0 without gaps; ``grown_shard`` is
    the shard if one more is added. An empty table gives no rows. Texts are read where they are and do not move. A
    shard is numbered in blocks by id, size and hash of the text; rows that are the same in these and many are dealt to
    blocks in turns.
    """
    weights = list(weights or [1.0] * shards)
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = key_of(F.col(f"`{doc_id}`"))
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(words) + 8).cast("long").alias("size"), F.crc32(words).alias("text_crc32"), F.lit("key").alias("law"), shard_of(key, weights).alias("shard"), shard_of(key, [*weights, grown_weight]).alias("grown_shard"), key.alias("key"))
    blocks = max(1, math.ceil(df.select(F.lit(1)).count() / len(weights) / ROWS_PER_BLOCK) * 2)
    same = ["key", "text_crc32", "size"]
    rows = rows.withColumns({"block": F.pmod(F.xxhash64(*same, F.lit("block")), F.lit(blocks)).cast("int"), "part": F.lit(0)})
    full = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * ROWS_PER_BLOCK).select("shard", "block")
    full = [tuple(r) for r in full.collect()]
    if full:
        # Few blocks are so much larger than the others: those of rows that are the same.
        rows = Store(df.sparkSession).put(rows.withColumn("row", F.monotonically_increasing_id()))
        within = F.struct("shard", "block").isin([F.struct(F.lit(s), F.lit(b)) for s, b in full])
        often = rows.where(within).groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROWS_PER_BLOCK)
        parts = often.select(*same, F.ceil(F.col("n") / ROWS_PER_BLOCK).cast("int").alias("parts"))
        rows = rows.join(F.broadcast(parts), same, "left").withColumn("part", F.pmod(F.col("row"), F.coalesce("parts", F.lit(1))).cast("int"))
    own = ["shard", "block", "part"]
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1))
    before = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).select(*own, F.coalesce(ahead, F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy(*own).orderBy(*same)) - 1
    numbered = rows.withColumn("place", place).join(before, own)
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), "grown_shard")


def write_shards(df: DataFrame, path: str, doc_id: str = "doc_id", weights: Sequence[float] = (1.0,) * 24) -> None:
    """Write the rows of ``df`` as Parquet, one folder for each shard; ``__shard``, marked if ``df`` has it, names them.

    Rows without an id share a shard; texts are not looked at, and an empty table leaves an empty folder.
    """
    name = fresh(df, "__shard")[0]
    df.withColumn(name, shard_of(key_of(F.col(f"`{doc_id}`")), weights)).write.partitionBy(name).parquet(path)
