"""Records of interactions: filters, evidence, duplicates and cuts. All are DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import text

TARGET = 300_000


def same_taxon(df: DataFrame, a: str, b: str, taxon: str) -> DataFrame:
    return df.where((F.col(a) == taxon) & (F.col(b) == taxon))


def supported_links(df: DataFrame, min_score: int = 700, min_channel: int = 90, channels: Sequence[str] = ("experimental", "coexpression", "database", "textmining")) -> DataFrame:
    """Links with a combined score of ``min_score`` or more and one channel above ``min_channel``; nulls are passed over."""
    return df.where((F.col("combined_score") >= min_score) & (F.greatest(*channels) > min_channel))


def proper_pairs(df: DataFrame, a: str = "protein1", b: str = "protein2") -> DataFrame:
    """Without rows that lack an end or whose ends are the same."""
    return df.na.drop(subset=[a, b]).where(F.col(a) != F.col(b))


def confident(df: DataFrame, value: str = "confidence", above: float = 0.8) -> DataFrame:
    """Rows above the confidence, and rows without one; a value that is no number is rejected."""
    return df.where(F.col(value).isNull() | (F.coalesce(text.number(F.col(value)), F.lit(-1.0)) > above))


def valid_terms(df: DataFrame, term: str) -> DataFrame:
    return df.where(F.col(term).rlike(f"^{text.GO_TERM}$"))


def complete_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of numbers without a gap: none is missing, and none is unreadable."""
    full = df.na.drop("any", subset=[key, *columns])
    return full.select(key, *[text.number(F.col(c)).alias(c) for c in columns]).na.drop("any", subset=list(columns))


def evidence(df: DataFrame, species: str = "yeast", method: str = "Method", kind: str = "IntType", sources: str = "PubIDs") -> DataFrame:
    """``df`` with MethodScore, TypeScore, PubCount and Total = 3 method + 2 type + publications.

    Yeast passes over parts that contain psi-mi and counts a missing publication as one; human does neither.
    """
    yeast = species == "yeast"
    m = text.best_score(F.col(method), text.METHOD_SCORES[species], "psi-mi" if yeast else None)
    t = text.best_score(F.col(kind), text.TYPE_SCORES[species], "psi-mi" if yeast else None)
    n = text.bar_count(F.col(sources), 1 if yeast else None)
    scored = df.withColumns({"MethodScore": m, "TypeScore": t, "PubCount": n})
    return scored.withColumn("Total", 3 * F.col("MethodScore") + 2 * F.col("TypeScore") + F.col("PubCount"))


def canonical(df: DataFrame, a: str = "protein1", b: str = "protein2") -> DataFrame:
    """The smaller end first."""
    return df.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def _first_of(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    # One row for each key survives the partial aggregation, so a frequent key moves a row for each task. Ties go by
    # the columns in their order.
    kept = df.groupBy(*[k.alias(f"__key{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*df.columns), F.struct(*[o.alias(f"__order{i}") for i, o in enumerate(order)], *df.columns)).alias("__row"))
    return kept.select("__row.*")


def undirected_first(df: DataFrame, row_id: str, a: str = "protein1", b: str = "protein2") -> DataFrame:
    """Of rows that join the same two ends, the first by ``row_id``, as it stands."""
    return _first_of(df, [F.least(a, b), F.greatest(a, b)], [F.col(row_id)])


def undirected_best(df: DataFrame, score: str, row_id: str, a: str = "protein1", b: str = "protein2") -> DataFrame:
    """Of rows that join the same two ends, the one with the highest score, then the first by ``row_id``."""
    return _first_of(df, [F.least(a, b), F.greatest(a, b)], [-F.col(score), F.col(row_id)])


def first_row(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """One row for each key, the first by ``row_id``."""
    return _first_of(df, [F.col(key)], [F.col(row_id)])


def pair_set(df: DataFrame, a: str = "protein1", b: str = "protein2") -> DataFrame:
    """The distinct unordered pairs."""
    return df.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def top(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def dynamic_cut(df: DataFrame, score: str, row_id: str, target: int = TARGET) -> DataFrame:
    """About ``target`` rows by score.

    All rows if they are no more than the target. If the rows at the top score are no more than the target: those
    rows if they are 80 % of it or more. If they are more than the target: all rows if these are 120 % of it or less.
    Otherwise the first ``target`` rows by score, then ``row_id``.
    """
    best = df.agg(F.max(score)).head()[0]
    n, at_top = df.agg(F.count(F.lit(1)), F.count_if(F.col(score) == best)).head() if best is not None else (df.count(), 0)
    if n <= target or (at_top > target and n <= 1.2 * target):
        return df
    if 0.8 * target <= at_top <= target:
        return df.where(F.col(score) == best)
    return top(df, target, [F.desc(score), F.asc(row_id)])


def nodes(df: DataFrame, a: str = "protein1", b: str = "protein2", name: str = "protein") -> DataFrame:
    """The distinct ends."""
    return df.select(F.col(a).alias(name)).union(df.select(b)).where(F.col(name).isNotNull()).distinct()


def stage_counts(df: DataFrame, a: str = "protein1", b: str = "protein2", taxon_a: str = "taxon_a", taxon_b: str = "taxon_b", taxon: str = "") -> DataFrame:
    """Rows after each cleaning stage, in one pass."""
    ours = (F.col(taxon_a) == taxon) & (F.col(taxon_b) == taxon)
    named = ours & F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(ours).alias("same_taxon"), F.count_if(named).alias("named"), F.count_if(named & (F.col(a) != F.col(b))).alias("proper"))


def score_summary(df: DataFrame, score: str) -> DataFrame:
    return df.agg(F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.avg(score).alias("mean_score"))


def only(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose value is a key of ``known``."""
    return df.join(known.select(F.col(key).alias("__known")), F.col(column) == F.col("__known"), "left_semi")


def missing(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """The distinct values that are no key of ``known``."""
    return df.select(column).distinct().join(known.select(F.col(key).alias("__known")), F.col(column) == F.col("__known"), "left_anti")


def counted_in_sets(rows: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]], **flags: Column) -> DataFrame:
    """(columns, level, n and a count for each flag) of several groupings of one table, in one pass over it.

    Each of ``sets`` names the columns that it groups by; the others are null in its rows, and ``level`` has a bit for
    each of them, the first column's the highest, so that these nulls differ from those of the table.
    """
    named = rows.select(*columns, *[c.cast("boolean").alias(f"__{k}") for k, c in flags.items()])
    grouped = named.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return grouped.agg(F.grouping_id(*columns).alias("level"), F.count(F.lit(1)).alias("n"), *[F.count_if(f"__{k}").alias(k) for k in flags])
