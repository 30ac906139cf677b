"""Exact duplicates by content sort.

Splitters sampled from the rows deal the normalised texts out by range; each partition is sorted, spilling to disk, so
that equal texts stand next to each other, and a text is compared in full with its neighbour. A text that the sample
shows to be frequent is dealt to several parts in turns, and the parts' smallest ids and counts meet afterwards. Only
DataFrame operations run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.columns import fresh
from netloom.storage import Store

#: Rows in the sample that looks for frequent texts; what it finds decides only how rows are dealt out.
SAMPLE_ROWS = 20_000
#: Characters of a text that splitters hold.
HEAD = 32


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; a null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def frequent(df: DataFrame, content: Column, partitions: int) -> dict[int, list[int]]:
    """The texts that fill more than a fifth of a partition by a sample, by their hashes; at most five for each partition.

    They come by the number of parts that a text is dealt to: a power of two, so that a part is about that large.
    """
    total = df.count()
    if not total:
        return {}
    least = max(4, int(min(SAMPLE_ROWS, total) / (5 * partitions)))
    sample = df.sample(min(1.0, SAMPLE_ROWS / total), seed=7).groupBy(F.xxhash64(content).alias("digest")).count()
    out: dict[int, list[int]] = {}
    for digest, count in sample.where(F.col("count") >= least).orderBy(F.desc("count"), "digest").limit(5 * partitions).collect():
        out.setdefault(1 << (-(-count // least) - 1).bit_length(), []).append(digest)
    return out


def dedup_exact(df: DataFrame, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Per row, dropped ones too: doc_id, keep_id, group_size, kept and text_sha256 (of the normalised text).

    Texts are equal if they are identical after :func:`normalised`; of equal texts the row with the smallest id stays.
    Rows that share both id and text are one group, of which exactly one row stays; a null id sorts last. An empty
    table gives no rows.
    """
    spark = df.sparkSession
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    content = normalised(F.col(f"`{text}`"))
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), content.alias("content"))
    parts_of = frequent(df, content, partitions)
    hot = [digest for some in parts_of.values() for digest in some]
    parts = F.coalesce(*[F.when(F.xxhash64("content").isin(some), F.lit(n)) for n, some in parts_of.items()], F.lit(1))
    # Rows take turns, so that rows with one id or none are dealt as well.
    salt = F.pmod(F.monotonically_increasing_id(), parts) if hot else None
    # Splitters hold the beginning of a text and a hash of it, so that those sent to the driver are short.
    dealt = rows.select("*", F.left("content", F.lit(HEAD)).alias("head"), F.xxhash64("content").alias("digest"), *([salt.alias("salt")] if hot else []))
    keys = ["head", "digest", *(["salt"] if hot else [])]
    dealt = dealt.repartitionByRange(partitions, *keys)
    part = Window.partitionBy(*keys, "content")
    ordered = part.orderBy(F.col("doc_id").asc_nulls_last())
    sorted_rows = dealt.select(
        "doc_id",
        "content",
        F.row_number().over(ordered).alias("place"),
        F.first("doc_id").over(ordered).alias("part_id"),
        F.count(F.lit(1)).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("part_size"),
        *(["salt"] if hot else []),
    )
    out = sorted_rows.select("doc_id", "place", "part_id", "part_size", *(["salt"] if hot else []), F.sha2("content", 256).alias("text_sha256"), F.xxhash64("content").isin(hot).alias("hot") if hot else F.lit(False).alias("hot"))
    if hot:
        # Without their texts the rows are short; the parts of the frequent texts, a row each, now meet.
        out = Store(spark).put(out)
        parts = out.where("hot and place = 1").groupBy(F.col("text_sha256").alias("whole")).agg(F.min(F.struct(F.col("part_id").isNull(), "part_id", "salt")).alias("least"), F.sum("part_size").alias("size"))
        out = out.join(F.broadcast(parts), out["text_sha256"] == parts["whole"], "left")
        keep, size = F.when(F.col("hot"), F.col("least.part_id")).otherwise(F.col("part_id")), F.coalesce("size", "part_size")
        kept = (F.col("place") == 1) & (~F.col("hot") | (F.col("salt") == F.col("least.salt")))
    else:
        keep, size, kept = F.col("part_id"), F.col("part_size"), F.col("place") == 1
    return out.select("doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def unique_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose id stays; rows that share the id of one that stays come along, and so do rows without an id
    where one of them stays. Null and empty texts are equal."""
    mark = fresh(df, "stays")[0]
    stays = dedup_exact(df, doc_id, text).where("kept").select(F.col("doc_id").alias(mark))
    return df.join(stays, F.col(f"`{doc_id}`").eqNullSafe(F.col(mark)), "left_semi")
