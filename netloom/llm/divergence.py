"""How far the sources of a language differ in their words, by exact whole numbers.

A group is a language and source. Its share of a term is ``1 + floor(10^9 (count + 5) / (N + 5 V))``: V terms of the language
are kept, and N is what the group's counts of them sum up to. Two groups differ by the sum of the differences of their
shares over all kept terms.

Words are counted where the texts are. The kept terms of a language are dealt to blocks, and the groups to tiles; a task
has a block's counts of two tiles as dense matrices of groups by terms, takes the differences of all pairs at once by
broadcasting, and gives a partial matrix of sums and each group's heap of top terms. Sums are added up by pair, heaps
are merged by group. What a pair has from terms that neither group contains is the same for each such term, so partial
sums count how much more or less each term gives, and V times that amount is added at the end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.session import ship_code
from netloom.storage import Store

#: Documents of a language that a kept term is in; the top terms of a group.
MIN_DOCS, TOP = 30, 50
#: Terms of a block, on average, and groups of a tile.
BLOCK_TERMS, TILE_GROUPS = 1_024, 256
#: Different terms that a task counts before it hands them on.
HELD_TERMS = 300_000
#: Numbers that one step of broadcasting makes.
STEP = 1 << 21
UNIT, ADDED = 1_000_000_000, 5

#: Bytes of no term become spaces and A-Z small; what is left is split at spaces.
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]")
_PLAIN = bytes(b if _TERM.match(bytes([b])) else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: stretches of ASCII letters and other characters than ASCII, A-Z in small letters."""
    return text.translate(_PLAIN).split(b" ")


def shares(counts: np.ndarray, divisor: np.ndarray) -> np.ndarray:
    """``1 + floor(10^9 (count + 5) / divisor)`` in int64; exact while divisors are below 9 * 10^15, as 10^9 goes in by thousands."""
    out, left = np.divmod(counts + ADDED, divisor)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, divisor)
        out = out * 1000 + digit
    return out + 1


def count_terms(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and documents that have it.

    Null texts, languages and sources count as empty. Each group also has a row of the empty term with n = 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                del n[b""], docs[b""]
                terms = [b"", *n]
                columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, terms = len(n), terms_of(text)
                n.update(terms)
                docs.update(set(terms))
                size += len(n) - before
                if size > HELD_TERMS:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    ship_code(df.sparkSession)
    rows = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (lang, source)], F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    counted = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n_lang) of the terms that at least ``min_docs`` documents of a language have."""
    return counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")


def _matrix(rows: pd.DataFrame, groups: np.ndarray, terms: int) -> np.ndarray:
    """Counts of groups (in rising order) by terms."""
    out = np.zeros((len(groups), terms), np.int64)
    own = rows[rows["gid"].isin(groups)]
    out[np.searchsorted(groups, own["gid"].to_numpy()), own["column"].to_numpy()] = own["n"].to_numpy()
    return out


def _pair_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums of the differences of all rows of a with all rows of b, in steps of bounded size."""
    sums = np.empty((len(a), len(b)), np.int64)
    wide = max(1, STEP // max(1, a.shape[1]))
    for j in range(0, len(b), wide):
        tall = max(1, wide // len(b[j : j + wide]))
        for i in range(0, len(a), tall):
            sums[i : i + tall, j : j + wide] = np.abs(a[i : i + tall, None, :] - b[None, j : j + wide, :]).sum(axis=2)
    return sums


def block_parts(rows: pd.DataFrame, tile_a: int, tile_b: int, top: int) -> pd.DataFrame:
    """What a block of terms gives the pairs of two tiles' groups, and, where both are one tile, its groups' top terms.

    Rows without a term name the tiles' groups with their divisors; the others are counts, with those of the language.
    """
    named = rows["term"].isna()
    groups = rows[named].sort_values("gid")
    counts = rows[~named]
    terms, first = np.unique(counts["term"].to_numpy(object), return_index=True)
    counts = counts.assign(column=np.searchsorted(terms, counts["term"].to_numpy(object)))
    whole = np.zeros(len(terms), np.int64)
    whole[counts["column"].to_numpy()] = counts["n_lang"].to_numpy()

    def side(tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own = groups[groups["tile"] == tile]
        gid, divisor = own["gid"].to_numpy(), own["divisor"].to_numpy()
        n = _matrix(counts, gid, len(terms))
        return gid, n, shares(n, divisor[:, None]), shares(np.zeros(len(gid), np.int64), divisor), own["divisor_lang"].to_numpy()

    gid_a, n, a, none_a, divisor_lang = side(tile_a)
    gid_b, _, b, none_b, _ = side(tile_b)
    more = _pair_sums(a, b) - len(terms) * np.abs(none_a[:, None] - none_b[None, :])
    x, y = np.nonzero(gid_a[:, None] < gid_b[None, :])
    pairs = pd.DataFrame({"a": gid_a[x], "b": gid_b[y], "term": None, "value": more[x, y]})
    if tile_a != tile_b or not len(gid_a):
        return pairs
    above = a - shares(whole, divisor_lang[0])[None, :]
    heaps = []
    for i in range(len(gid_a)):
        at = np.flatnonzero((n[i] > 0) & (above[i] > 0))
        if len(at) > top:
            least = -np.partition(-above[i][at], top - 1)[top - 1]
            at = at[above[i][at] >= least]
        # Terms stand in the order of their characters, which is that of UTF-8, so a stable sort settles ties.
        at = at[np.argsort(-above[i][at], kind="stable")][:top]
        heaps.append(pd.DataFrame({"a": gid_a[i], "b": -1, "term": terms[at], "value": above[i][at]}))
    return pd.concat([pairs, *heaps], ignore_index=True)


def _ranked(rows: DataFrame, part: str, most: int | None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return out.where(F.col("rank") <= most) if most else out


def _share(divisor: Column) -> Column:
    """The share of a term that a group does not have; divisors are V's multiple of 5 at least, and 0 where V is."""
    return F.when(divisor > 0, F.expr(f"{UNIT * ADDED} div divisor") + 1).otherwise(F.lit(0))


def audit_sources(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of each group of ``df``.

    Part ``pair`` has the other sources of the language and how far they differ from the group, part ``term`` at most
    ``top`` terms whose share in the group is above that in the language, and by how much. Ranks go by falling value,
    ties by the item in UTF-8. A kept term is in at least ``min_docs`` documents of the language.

    Null texts, languages and sources count as empty, and form groups like any other; a group without kept terms has its
    pairs all the same, with 0 where the language keeps none. Every row counts, repeated ones too. An empty table gives no
    rows; ids and other columns are not read. A frequent language, source or term is a count that each task has added up
    before it moves; a block has as many rows as its terms have groups of two tiles at most.
    """
    store = Store(df.sparkSession)
    counts = store.put(count_terms(df, text, lang, source))
    kept = store.put(kept_terms(counts, min_docs))
    held = store.put(counts.where("term <> ''").drop("docs").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("all"))
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["own", "v", "all"])
    groups = groups.withColumn("gid", place.cast("long")).withColumns({"tile": F.expr(f"gid div {TILE_GROUPS}"), "divisor": F.expr(f"own + {ADDED} * v"), "divisor_lang": F.expr(f"`all` + {ADDED} * v"), "blocks": F.ceil(F.col("v") / BLOCK_TERMS)})
    groups = store.put(groups)
    tiles = groups.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"))

    # Each tile of groups meets every tile, itself included; the lower number is the first of the two.
    met = groups.join(tiles, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    met = met.withColumns({"tile_a": F.least("tile", "other"), "tile_b": F.greatest("tile", "other")})
    both = ["lang", "tile_a", "tile_b"]
    heads = met.where("v > 0").select(*both, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "gid", "tile", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_lang"), "divisor", "divisor_lang")
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    cells = held.join(met.select("source", *both, "gid", "tile", "blocks"), ["lang", "source"]).select(*both, block.alias("block"), "gid", "tile", "term", "n", "n_lang", F.lit(0).cast("long").alias("divisor"), F.lit(0).cast("long").alias("divisor_lang"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = block_parts(rows, int(key[1]), int(key[2]), top)
        out.insert(0, "lang", key[0])
        return out

    parts = store.put(heads.unionByName(cells).groupBy(*both, "block").applyInPandas(run, "lang string, a long, b long, term string, value long"))
    more = parts.where("term is null").groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    none = _share(F.col("divisor"))
    first = met.where("tile = tile_a").select(*both, F.col("gid").alias("a"), F.col("source").alias("from"), none.alias("none_a"), "v")
    second = met.where("tile = tile_b").select(*both, F.col("gid").alias("b"), F.col("source").alias("to"), none.alias("none_b"))
    # The result has a row for each pair of a language's sources, so all are formed here, tile by tile.
    pairs = first.join(second, both).where("a < b").join(more, ["lang", "a", "b"], "left")
    pairs = pairs.withColumn("value", F.expr("v * abs(none_a - none_b) + coalesce(more, 0)"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("from").alias("source"), F.col("to").alias("item")), F.struct(F.col("to").alias("source"), F.col("from").alias("item")))).alias("x"), "value")
    tops = parts.where("term is not null").join(groups.select("lang", F.col("gid").alias("a"), "source"), ["lang", "a"]).select("lang", "source", F.col("term").alias("item"), "value")
    return _ranked(pairs.select("lang", "x.source", "x.item", "value"), "pair", None).unionByName(_ranked(tops, "term", top))
