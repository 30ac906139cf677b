"""Column expressions over identifiers and free text. A value that is absent is null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of accessions, tried in this order, and the scores of experimental evidence.
ACCESSION_PATTERNS = {
    "yeast": (r"uniprot/swiss[\W-]?prot:([A-Z0-9]{6,10})", r"uniprot:([A-Z0-9]{6,10})", r"swiss[\W-]?prot:([A-Z0-9]{6,10})", r"([A-Z0-9]{6,10})\.\d"),
    "human": (r"uniprot/swiss[\W-]?prot:([A-Z0-9]{6,8})", r"uniprot:([A-Z0-9]{6,8})", r"([A-Z0-9]{6,8})\.\d"),
}
METHOD_SCORES = {
    "yeast": {"x-ray crystallography": 10, "electron microscopy": 8, "affinity chromatography": 6, "coimmunoprecipitation": 4, "two hybrid": 2, "pull down": 3, "mass spectrometry": 2},
    "human": {"x-ray crystallography": 4, "electron microscopy": 3, "affinity chromatography": 3, "coimmunoprecipitation": 2, "two hybrid": 2, "pull down": 2, "mass spectrometry": 1},
}
TYPE_SCORES = {"yeast": {"direct interaction": 6, "physical association": 3, "complex": 4}, "human": {"direct interaction": 3, "physical association": 1, "complex": 2}}
LOCUS = r"^Y[A-Z]{2}\d{3}[A-Z]?$"
GO_TERM = r"GO:\d+"


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def accession(x: Column, patterns: Sequence[str], upper: bool = False) -> Column:
    """The first group of the first pattern that matches, whatever the case of the letters; null if none does."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(x, f"(?i){p}", 1), F.lit("")) for p in patterns])
    return F.upper(found) if upper else found


def without(x: Column, part: str) -> Column:
    """Without a literal substring, wherever it stands."""
    return F.replace(x, F.lit(part), F.lit(""))


def dotted_part(x: Column, part: int) -> Column:
    """A part between dots, from 1, or from the end if negative."""
    return F.split_part(x, F.lit("."), F.lit(part))


def go_terms(x: Column) -> Column:
    """All GO identifiers in a text."""
    return F.regexp_extract_all(x, F.lit(GO_TERM), F.lit(0))


def is_locus(x: Column) -> Column:
    return x.rlike(LOCUS)


def number(x: Column) -> Column:
    """As a double; null if it is none."""
    return x.try_cast("double")


def members(x: Column, separator: str) -> Column:
    """A list's distinct, trimmed, non-empty parts."""
    return F.array_distinct(F.filter(F.transform(F.split(x, separator), strip), lambda p: p != ""))


def best_score(x: Column, scores: Mapping[str, int], skip: str | None = None) -> Column:
    """The highest score of the lower-case parts between bars; 1 for a part without one, and if no part is left."""
    table = F.create_map(*[F.lit(v) for kv in scores.items() for v in kv])
    parts = F.split(F.lower(F.coalesce(x, F.lit("nan"))), r"\|")
    if skip:
        parts = F.filter(parts, lambda t: ~F.contains(t, F.lit(skip)))
    return F.coalesce(F.array_max(F.transform(parts, lambda t: F.coalesce(table[t], F.lit(1)))), F.lit(1))


def bar_count(x: Column, default: int | None = None) -> Column:
    """How many parts bars separate; ``default`` for null."""
    n = F.regexp_count(x, F.lit(r"\|")) + 1
    return n if default is None else F.coalesce(n, F.lit(default))


def guarded(x: Column, y: Column) -> Column:
    """The quotient, 0 if the divisor is 0 or null."""
    return F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """A share as text, with one decimal."""
    return F.format_string("%.1f%%", 100.0 * guarded(part.cast("double"), whole))


def of_largest(x: Column, largest: Column) -> Column:
    """A fitness as a share of the largest."""
    return guarded(x, largest)
