"""Identifiers translated through mapping tables of (uniprot, db, db_id, line_no).

Mapping tables compress to far less than they are, so their joins say that they are merged; a guess by the size of the
files would send whole tables through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import text


def lookup(idmap: DataFrame, db: str | Sequence[str], key: Column | None = None, keep: str = "first", name: str = "to") -> DataFrame:
    """(key, name): for each foreign identifier the accession on the first or last line."""
    wanted = idmap.where(F.col("db").isin([db] if isinstance(db, str) else list(db))).select((F.col("db_id") if key is None else key).alias("key"), "uniprot", "line_no")
    pick = F.min_by if keep == "first" else F.max_by
    return wanted.where(F.col("key").isNotNull()).groupBy("key").agg(pick("uniprot", "line_no").alias(name))


def map_edges(edges: DataFrame, table: DataFrame, unmapped: str = "drop", canonicalize: bool = False, a: str = "protein1", b: str = "protein2") -> DataFrame:
    """Both ends of ``edges`` through ``table`` (key, to).

    An end that is not in the table drops the row, or stays as it is with ``unmapped="keep"``. Pairs that become equal
    or the same are left, unless ``canonicalize`` orders the ends and removes both.
    """
    if unmapped not in ("drop", "keep"):
        raise ValueError("unmapped is drop or keep")
    how = "inner" if unmapped == "drop" else "left"
    for end in (a, b):
        to = table.select(F.col("key").alias("__key"), F.col("to").alias("__to"))
        edges = edges.join(to.hint("merge"), F.col(end) == F.col("__key"), how).withColumn(end, F.coalesce("__to", end)).drop("__key", "__to")
    if canonicalize:
        edges = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()
    return edges


def cascade(df: DataFrame, column: str, tables: Sequence[tuple[Column, DataFrame]], name: str = "mapped") -> DataFrame:
    """``df`` with the first hit of several tables (key, to), each asked with its own expression of ``column``."""
    hits = []
    for i, (ask, table) in enumerate(tables):
        df = df.withColumn(f"__ask{i}", ask).join(table.select(F.col("key").alias(f"__key{i}"), F.col("to").alias(f"__to{i}")).hint("merge"), F.col(f"__ask{i}") == F.col(f"__key{i}"), "left")
        hits.append(F.col(f"__to{i}"))
    helpers = [f"__{h}{i}" for h in ("ask", "key", "to") for i in range(len(tables))]
    return df.withColumn(name, F.coalesce(*hits)).drop(*helpers)


def expression_lookup(df: DataFrame, column: str, idmap: DataFrame, species: str, name: str = "mapped") -> DataFrame:
    """Gene identifiers to accessions: yeast by locus, then ORF, then upper-cased name; human by upper-cased name."""
    by_name = (F.upper(column), lookup(idmap, "Gene_Name", F.upper("db_id")))
    if species == "human":
        return cascade(df, column, [by_name], name)
    return cascade(df, column, [(F.col(column), lookup(idmap, "Gene_OrderedLocusName")), (F.col(column), lookup(idmap, "ORF")), by_name], name)


def map_compartments(df: DataFrame, idmap: DataFrame, species: str, column: str = "protein_id") -> DataFrame:
    """``df`` with Mapped_UniProtKB_ID and Mapping_Status (Success or Failed).

    An accession stands for itself. Otherwise a human ``ENSP`` identifier goes by the last part of a STRING identifier,
    then by Ensembl_PRO, and a yeast one by its locus; of several lines the last counts.
    """
    own = idmap.select(F.col("uniprot").alias("key"), F.col("uniprot").alias("to")).distinct()
    if species == "human":
        ensp = F.when(F.startswith(F.col(column), F.lit("ENSP")), F.col(column))
        more = [(ensp, lookup(idmap, "STRING", text.dotted_part(F.col("db_id"), -1), "last")), (ensp, lookup(idmap, "Ensembl_PRO", text.dotted_part(F.col("db_id"), 1), "last"))]
    else:
        more = [(F.col(column), lookup(idmap.where(text.is_locus(F.col("db_id"))), ["Gene_OrderedLocusName", "ORF"], None, "last"))]
    mapped = cascade(df, column, [(F.col(column), own), *more], "Mapped_UniProtKB_ID")
    return mapped.withColumn("Mapping_Status", F.when(F.col("Mapped_UniProtKB_ID").isNull(), "Failed").otherwise("Success"))


def mapping_stats(df: DataFrame, status: str = "Mapping_Status") -> DataFrame:
    mapped = F.count_if(F.col(status) == "Success")
    counts = df.agg(F.count(F.lit(1)).alias("total"), mapped.alias("mapped"))
    return counts.select("total", "mapped", (F.col("total") - F.col("mapped")).alias("unmapped"), text.percent(F.col("mapped"), F.col("total")).alias("mapped_share"), text.percent(F.col("total") - F.col("mapped"), F.col("total")).alias("unmapped_share"))
