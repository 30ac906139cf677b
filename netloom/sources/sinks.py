"""Writers of the output formats. Each writes a folder of part files through Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import text
from netloom.operators.idmap import mapping_stats
from netloom.storage import Store

# The columns of mapped compartments.
MAPPED = ("Original_Protein_ID", "Gene_Name", "GO_ID", "GO_Term", "Score", "Mapped_UniProtKB_ID", "GeneID", "Ensembl", "RefSeq", "Entrez_Gene", "STRING_ID", "Mapping_Status")


def tsv(df: DataFrame, path: str, header: bool = False) -> None:
    as_is = {"emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(sep="\t", header=header, **as_is).mode("overwrite").csv(path)


def edge_list(df: DataFrame, path: str, header: bool = False) -> None:
    """Two columns; with a header they are Protein1 and Protein2."""
    tsv(df.select(F.col("protein1").alias("Protein1"), F.col("protein2").alias("Protein2")), path, header)


def scores(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """A score frame with its header; the last column in fixed decimals if asked."""
    if decimals is not None:
        last = df.columns[-1]
        df = df.withColumn(last, F.format_string(f"%.{decimals}f", F.col(last)))
    tsv(df, path, True)


def weighted_network(df: DataFrame, path: str, published: bool = True) -> None:
    """With a header and mean_weight, or as three bare columns."""
    w = df.columns[-1]
    tsv(df.select("protein1", "protein2", F.col(w).alias("mean_weight" if published else "weight")), path, published)


def matrix(df: DataFrame, path: str, names: list[str]) -> None:
    """A square matrix of (protein1, protein2, sim), five decimals, 0 for absent pairs; for few proteins."""
    both = df.select("protein1", "protein2", "sim").union(df.where("protein1 <> protein2").select("protein2", "protein1", "sim"))
    wide = both.groupBy("protein1").pivot("protein2", names).agg(F.first("sim"))
    tsv(wide.select("protein1", *[F.format_string("%.5f", F.coalesce(F.col(f"`{n}`"), F.lit(0.0))).alias(n) for n in names]).orderBy("protein1"), path, True)


def complexes(df: DataFrame, path: str, separator: str = ";", header: bool = True) -> None:
    """An id, a tab and the sorted members of (complex_id, protein)."""
    sets = df.groupBy("complex_id").agg(F.concat_ws(separator, F.sort_array(F.collect_set("protein"))).alias("proteins"))
    tsv(sets, path, header)


def mapped_compartments(df: DataFrame, path: str) -> None:
    """The mapped rows, their statistics and the identifiers that failed, from one pass that is written first."""
    store = Store(df.sparkSession)
    kept = store.put(df)
    absent = [c for c in MAPPED if c not in df.columns]
    tsv(kept.withColumns({c: F.lit("") for c in absent}).na.fill("", ["Mapped_UniProtKB_ID"]).select(*MAPPED), f"{path}/mapped", True)
    tsv(mapping_stats(kept), f"{path}/stats", True)
    tsv(kept.where("Mapping_Status = 'Failed'").select("Original_Protein_ID"), f"{path}/unmapped")
    store.clear()


def statistics(df: DataFrame, path: str) -> None:
    tsv(df, path, True)


def report(df: DataFrame) -> DataFrame:
    """(measure, value) rows of a one-row frame of counts, instead of printed lines."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "measure", "value")


def share(part: str, whole: str):
    return text.percent(F.col(part), F.col(whole))
