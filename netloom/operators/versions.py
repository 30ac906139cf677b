"""Values that change over time: each row with the version of its key that held at its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a period; a key's rows of one period are sorted together.
PERIOD = 1


def as_of(rows: DataFrame, versions: DataFrame, key: str, time: str, values: Sequence[str], period: int = PERIOD) -> DataFrame:
    """``rows`` with the ``values`` of the last version (key, time, values) of their key that began at their time or before.

    Both frames name key and time alike; the values are columns that ``rows`` does not have. They are null for a row
    before its key's first version, without a key or without a time. Of versions that begin together the one with the
    greatest values holds, in the order in which they are named.

    Time is cut into periods, so that a frequent key is the work of many tasks. In a period, rows and versions are put in
    order and the last version goes along; what holds when a period begins is found from the last version of each.
    """
    names = list(values)
    clash = {c.lower() for c in rows.columns} & {c.lower() for c in names}
    if clash:
        raise ValueError(f"rows has columns of the values' names: {sorted(clash)}")

    def at(c: Column) -> Column:
        return F.floor(F.unix_date(c.cast("date")) / F.lit(period))

    value = F.struct(*[F.col(c) for c in names])
    known = versions.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("k"), F.col(time).alias("t"), value.alias("v"))
    known = known.groupBy("k", "t").agg(F.max("v").alias("v")).withColumn("p", at(F.col("t")))
    placed = F.col(key).isNotNull() & F.col(time).isNotNull()
    own = rows.where(placed).select(F.col(key).alias("k"), F.col(time).alias("t"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")).withColumn("p", at(F.col("t")))

    before = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ends = known.groupBy("k", "p").agg(F.max_by("v", "t").alias("v")).unionByName(own.select("k", "p").distinct(), allowMissingColumns=True)
    ends = ends.groupBy("k", "p").agg(F.max("v").alias("v"))
    starts = ends.select("k", "p", F.last("v", ignorenulls=True).over(before).alias("first")).where("first IS NOT NULL")

    along = Window.partitionBy("k", "p").orderBy("t", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = own.unionByName(known, allowMissingColumns=True).withColumn("held", F.last("v", ignorenulls=True).over(along)).where("row IS NOT NULL")
    met = both.join(starts, ["k", "p"], "left").withColumn("held", F.coalesce("held", "first"))
    found = met.select("row.*", *[F.col("held")[c].alias(c) for c in names])
    kinds = {f.name: f.dataType for f in found.schema.fields}
    rest = rows.where(~placed).select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in names])
    return found.unionByName(rest)
