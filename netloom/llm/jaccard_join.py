"""Documents linked by the Jaccard similarity of their word n-grams, exactly, as a sparse matrix product in blocks.

The matrix has a row for each different text and a column for each n-gram, a 64-bit hash. Two sets of sizes a and b
with similarity of at least t share ``ceil(t (a + b) / (1 + t))`` elements, so in any common order of all n-grams their
first ``a - ceil(t a) + 1`` and ``b - ceil(t b) + 1`` elements share one: only these cells of the matrix enter the
product. The order puts n-grams that many texts have last (counts by chunk of the input, summed; they steer cost, not
results), so common passages hardly enter.

Texts that are the same string are one row. A row's key is a 64-bit hash; a second one tells keys that two texts have,
and their texts get other keys. First, each text is compared in full with the leader of most of its columns; texts so
linked are one class from then on, and columns within one class are done. When this leaves few pairs, the product of
what is left is formed in blocks of bounded size: the entries of texts of different classes are found, their overlaps
are added up over the columns, and pairs whose sizes and overlap cannot reach the bound are dropped. The others are compared in full,
word by word. No link between texts of different classes is lost.

A column, or a text's pairs, with more than one in PARTS of all is frequent and dealt to parts; at most PARTS can be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.columns import fresh
from netloom.operators.components import component_labels
from netloom.storage import Store

#: N-grams that a task counts at a time, how often one must come there to be told, and how many the order knows.
CHUNK, TOLD, ORDERED = 2_000_000, 3, 1 << 18
#: Rounds with leaders at most, rows of a column that one block holds; pairs for each cell from which a second round pays.
ROUNDS, BLOCK, PAIRS_PER_CELL = 4, 256, 20
#: Pairs of a frequent text that one part holds at least.
PART_PAIRS = 64
#: Bits of the map of the texts whose n-grams are needed in full.
MAP_BITS = 1 << 23
#: A key with more than one row in PARTS, so at most PARTS of them, is frequent: its value goes to where the rows are.
PARTS = 4_000
WORDS_KEPT = 300_000
#: Ids of rows to drop that are sent to where the rows are; more of them meet the rows by key.
DROPPED = 500_000

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Reads texts as sorted arrays of the distinct 64-bit hashes of their n-grams of words."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.known: dict[bytes, int] = {}

    def sequence(self, text: str | None) -> np.ndarray:
        """A hash for each word; bytes are parted at ASCII white space and only ASCII letters are lower-cased."""
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
        try:
            return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(self.known) > WORDS_KEPT:
                self.known.clear()
            for w in set(words):
                if w not in self.known:
                    self.known[w] = xxhash.xxh3_64_intdigest(w) >> 1
            return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        """The hashes of the n-grams; a shorter sequence is one element as a whole, an empty one has none."""
        sequence = self.sequence(text)
        if not len(sequence):
            return np.empty(0, np.uint64)
        ids = sequence.view(np.uint64)
        width = min(self.n, len(ids))
        k = len(ids) - width + 1
        out = ids[:k] + np.uint64(width)
        for i in range(1, width):
            out *= _FACTOR
            out += ids[i : i + k]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out.sort()
        return out[np.append(True, out[1:] != out[:-1])]


def _texts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_key, check, text): two independent 64-bit hashes of the text."""
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(words).alias("text_key"), F.xxhash64(F.lit("check"), words).alias("check"), words.alias("text"))


def _told_apart(rows: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames with keys that no two texts share, as far as 128 bits tell them apart.

    Of N texts, N^2 / 2^65 keys are expected to stand for two: none below a billion, a few at ten billion. Only these
    few come to the driver; their texts are keyed by the second hash instead, until all keys differ.
    """
    for turn in range(8):
        keys = documents.groupBy("text_key").agg(F.min("check").alias("low"), F.max("check").alias("high"))
        double = [r[0] for r in keys.where("low <> high").select("text_key").collect()]
        if not double:
            break
        other = F.when(F.col("text_key").isin(double), F.xxhash64("check", F.lit(turn))).otherwise(F.col("text_key"))
        rows, documents = rows.withColumn("text_key", other), documents.withColumn("text_key", other)
    return rows, documents


def _described(rows: DataFrame, n: int) -> DataFrame:
    """A row (doc_id, text_key, check, n) for each document, and rows (null, hash, 0, count) for n-grams that a chunk has often."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, chunk, held = Shingler(n), [], 0

        def told() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(chunk), return_counts=True)
            often = counts >= TOLD
            n = int(often.sum())
            return out(pa.nulls(n, id_type), pa.array(values[often].astype(np.int64)), pa.array(np.zeros(n, np.int64)), counts[often], True)

        def out(ids: pa.Array, keys: pa.Array, checks: pa.Array, sizes, gram: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, keys, checks, pa.array(sizes, pa.int64()), pa.array([gram] * len(ids), pa.bool_())], ["doc_id", "text_key", "check", "n", "gram"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            sizes = []
            for text in batch.column(3).to_pylist():
                grams = shingle(text)
                sizes.append(len(grams))
                chunk.append(grams)
                held += len(grams)
                if held >= CHUNK:
                    yield told()
                    chunk, held = [], 0
            yield out(batch.column(0), batch.column(1), batch.column(2), sizes, False)
        if chunk:
            yield told()

    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, check long, n long, gram boolean")


def _prefixes(rows: DataFrame, n: int, percent: int, common: np.ndarray, counts: np.ndarray, least: int) -> DataFrame:
    """The cells of the matrix that enter the product: (gram, text_key, n, place, parts). Copies within a task count once.

    ``parts`` is how many parts a column is dealt to: one for each ``least`` rows by the counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(n), set()
        for batch in batches:
            keys, sizes, lengths, grams, parts = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key in seen:
                    continue
                if len(seen) < WORDS_KEPT:
                    seen.add(key)
                found = shingle(text)
                if not len(found):
                    continue
                first = len(found) - (percent * len(found) + 99) // 100 + 1
                dealt = np.ones(first, np.int32)
                if len(common):
                    at = np.searchsorted(common, found)
                    at[at == len(common)] = 0
                    often = common[at] == found
                    rare = found[~often]
                    if len(rare) < first:
                        # The hashes are sorted, so of equal counts the smaller hash comes first.
                        known = counts[at[often]]
                        more = np.argsort(known, kind="stable")
                        dealt[len(rare) :] = (1 + known[more] // least)[: first - len(rare)]
                        rare = np.concatenate([rare, found[often][more]])
                    chosen = rare[:first]
                else:
                    chosen = found[:first]
                keys.append(key)
                sizes.append(len(found))
                lengths.append(len(chosen))
                grams.append(chosen)
                parts.append(dealt)
            if keys:
                place = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).astype(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int32), lengths)), pa.array(place), pa.array(np.concatenate(parts))], ["gram", "text_key", "n", "place", "parts"])

    cells = rows.select("text_key", "text").mapInArrow(run, "gram long, text_key long, n int, place int, parts int")
    return cells.withColumn("part", F.pmod(F.xxhash64("text_key"), F.col("parts")).cast("int"))


def _wanted(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(text_key, text) of the rows whose keys are wanted, and few others, once each.

    The keys set bits of a map of fixed size, of a megabyte, that goes to where the rows are. More keys set more bits,
    so it lets more through, never less, and the joins that follow are exact.
    """
    slot = F.pmod(F.col("text_key"), F.lit(MAP_BITS)) + 1
    bits = keys.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(bits), F.bitmap_bucket_number(slot) == F.col("part"))
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).groupBy("text_key").agg(F.first("text").alias("text"))


def overlap(x: np.ndarray, y: np.ndarray, n: int) -> tuple[int, int]:
    """How many different n-grams two sequences of word numbers share, and have together; exact, without hashes.

    n-grams are numbered by pairs of numbers of shorter ones, as the bits of n say, so no number is ever large.
    """
    n_x, n_y = (min(n, len(s)) for s in (x, y))
    if n_x != n_y:
        return 0, (len(x) > 0) * max(1, len(x) - n + 1) + (len(y) > 0) * max(1, len(y) - n + 1)
    if not n_x:
        return 0, 0

    def numbered(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        """Each two numbers side by side as one number, the same for the same two in both sequences."""
        left, right = np.concatenate(a), np.concatenate(b)
        _, out = np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)
        return [out[: len(a[0])], out[len(a[0]) :]]

    part, size, out, done = [x.astype(np.int64), y.astype(np.int64)], 1, None, 0
    while True:
        if n_x & size:
            out = part if out is None else numbered([o[: len(p) - done] for o, p in zip(out, part, strict=True)], [p[done:] for p in part])
            done += size
        if done == n_x:
            break
        part = numbered([p[:-size] for p in part], [p[size:] for p in part])
        size *= 2
    own, other = np.unique(out[0]), np.unique(out[1])
    shared = len(own) + len(other) - len(np.unique(np.concatenate([own, other])))
    return shared, len(own) + len(other) - shared


def _similar(pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The (a, b) of rows (a, b, text_a, text_b) whose texts are similar enough, compared by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        held: dict[int, np.ndarray] = {}

        def words(key: int, text: str) -> np.ndarray:
            if key not in held:
                if len(held) >= 64 or len(numbers) > WORDS_KEPT:
                    held.clear()
                found = text.encode("utf-8", "surrogatepass").translate(_UPPER).split()
                held[key] = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
            return held[key]

        for batch in batches:
            good = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(numbers) > WORDS_KEPT:
                    numbers.clear()
                    held.clear()
                shared, both = overlap(words(b, y), words(a, x), n)
                good.append(shared * 100 >= both * percent)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _often(pairs: DataFrame, store: Store) -> DataFrame:
    """(text_key, parts) of the texts with so many pairs (a, b) that these are dealt to parts."""
    ends = pairs.select(F.col("a").alias("text_key")).union(pairs.select("b"))
    least = max(PART_PAIRS, pairs.count() // PARTS)
    many = ends.groupBy("text_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return store.put(many.select("text_key", F.ceil(F.col("n") / least).cast("int").alias("parts")))


def _with_ends(pairs: DataFrame, many: DataFrame, values: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the values of both texts, each value with the text's letter behind its name.

    The pairs of a text that is in many are dealt to parts, and its values go to each of them.
    """
    met = pairs
    for end, other in ("ab", "ba"):
        own = F.broadcast(many.select(F.col("text_key").alias(end), "parts"))
        met = met.join(own, end, "left").withColumn(f"part_{end}", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    every = values.join(F.broadcast(many), "text_key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    for end in "ab":
        met = met.join(every.select(F.col("text_key").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("part", *values.columns[1:])]), [end, f"part_{end}"])
    return met


def _linked(pairs: DataFrame, rows: DataFrame, n: int, percent: int, store: Store) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Only the texts that are in a pair move."""
    pairs = store.put(pairs)
    many = _often(pairs, store)
    texts = _wanted(rows, pairs.select(F.col("a").alias("text_key")).union(pairs.select("b")))
    links = store.put(_similar(_with_ends(pairs, many, texts), n, percent))
    store.free(pairs, many)
    return links


def _reaches(most: Column, percent: int) -> Column:
    """Whether sets of the sizes n_a and n_b that share this many at most can be similar enough."""
    return most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent


def _with_column(cells: DataFrame, values: DataFrame) -> DataFrame:
    """``cells`` with what ``values`` (gram, parts, ...) says of their column; each part of a column gets it."""
    each = values.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return cells.join(each, ["gram", "part"])


def _leaders(cells: DataFrame, percent: int, turn: int) -> DataFrame:
    """For each text the leader that shares most columns with it: a text of another class, one for each column.

    The first leaders are the texts with the fewest rarer elements before the column: the least edited of a family.
    Later ones are drawn.
    """
    rank = F.struct("place", "n", "text_key") if turn == 0 else F.struct(F.xxhash64("text_key", F.lit(turn)), "n")
    heads = cells.groupBy("gram").agg(F.first("parts").alias("parts"), F.min(F.struct(rank.alias("rank"), "text_key", "n", "place", "class")).alias("head"))
    met = _with_column(cells.select("gram", "part", "text_key", "n", "place", "class"), heads).withColumns({"n_a": F.col("n"), "n_b": F.col("head.n")})
    # What either set has left from a column that is the first they share; the others only speak for a leader.
    pairs = met.where((F.col("class") != F.col("head.class")) & _reaches(F.least(F.col("n") - F.col("place"), F.col("head.n") - F.col("head.place")), percent))
    shared = pairs.groupBy("text_key", F.col("head.text_key").alias("leader")).agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy("text_key").agg(F.max_by("leader", F.struct("shared", "leader")).alias("leader"))
    return best.select(F.least("text_key", "leader").alias("a"), F.greatest("text_key", "leader").alias("b")).distinct()


def _shared_columns(cells: DataFrame) -> DataFrame:
    """The cells of columns that two texts or more have, once each; of a column in parts, all cells."""
    order = Window.partitionBy("gram", "part").orderBy("text_key")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beside = cells.select("*", F.lag("text_key").over(order).alias("before"), F.first("text_key").over(whole).alias("low"), F.last("text_key").over(whole).alias("high"))
    return beside.where("(low <> high OR parts > 1) AND NOT before <=> text_key").drop("before", "low", "high")


def _open_cells(cells: DataFrame) -> DataFrame:
    """The cells of columns that more than one class has, with the number of cells of their column."""
    columns = cells.groupBy("gram").agg(F.first("parts").alias("parts"), F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("cells"))
    return _with_column(cells.drop("cells"), columns.where("low <> high").select("gram", "parts", "cells"))


def _pairs_left(cells: DataFrame) -> tuple[float, int]:
    """The pairs of different classes that share a column, one for each column, and the cells."""
    of_class = cells.groupBy("gram", "class").agg(F.count(F.lit(1)).cast("double").alias("k"))
    columns = of_class.groupBy("gram").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("own"))
    pairs, all_cells = columns.agg(F.sum((F.col("k") * F.col("k") - F.col("own")) / 2), F.sum("k")).head()
    return pairs or 0.0, int(all_cells or 0)


def _entries(cells: DataFrame, percent: int) -> DataFrame:
    """The entries (a, b) of the product, of texts of different classes, that can be similar enough.

    A column's cells are dealt into blocks; two blocks, or a block and itself, meet in one task, so that no task holds
    more than two blocks of a column. An entry is found where two texts first meet, which is not where both have the
    same cell in front. From there on, what is left of either set, and what it has open in the product with the most
    that can be outside of it (see :func:`_product`), must be enough.
    """
    blocks = F.ceil(F.col("cells") / BLOCK).cast("int")
    own = Window.partitionBy("text_key").orderBy("place")
    front, after = F.lag("gram").over(own), F.count(F.lit(1)).over(own.rowsBetween(0, Window.unboundedFollowing))
    rows = cells.withColumns({"front": front, "open": after, "left": F.col("n") - F.col("place"), "blocks": blocks}).withColumn("at", F.pmod(F.xxhash64("text_key"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left, right = (rows.select("gram", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "n", "front", "open", "left", "at")], F.col("text_key").alias(x), every.alias(f"at_{y}")) for x, y in ("ab", "ba"))
    first = F.col("front_a").isNull() | F.col("front_b").isNull() | (F.col("front_a") != F.col("front_b"))
    fits = _reaches(F.least("left_a", "left_b"), percent) & _reaches(F.least("open_a", "open_b") + _outside(percent), percent)
    met = left.join(right, ["gram", "at_a", "at_b"]).where((F.col("a") < F.col("b")) & (F.col("class_a") != F.col("class_b")) & first & fits)
    return met.select("a", "b").distinct()


def _outside(percent: int) -> Column:
    """How many shared elements of two sets can be outside the product."""
    return F.floor((F.greatest("n_a", "n_b") * percent + 99) / 100) - 1


def _product(cells: DataFrame, percent: int, store: Store) -> DataFrame:
    """The pairs of texts of different classes whose overlap, added up over the columns, lets them be similar enough.

    As with any sparse product, first its entries are found and then their values: the sum over the columns of both
    texts' open cells, which is the number that they share, taken for each entry at once. The bound on what the overlap must be: of the two, let a's last cell in the product come first in the order. Then all
    cells of a in the product that b has are in the product for b too, so the whole overlap is at most theirs and the
    cells of a that are not in it, ``ceil(t a) - 1`` of them.
    """
    entries = store.put(_entries(cells, percent))
    open_cells = cells.groupBy("text_key").agg(F.collect_list("gram").alias("grams"), F.first("n").alias("n"))
    overlap = F.size(F.array_intersect("grams_a", "grams_b"))
    most = F.least(overlap + _outside(percent), "n_a", "n_b")
    return _with_ends(entries, _often(entries, store), open_cells).where(_reaches(most, percent)).select("a", "b")


def near_duplicates(df: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id that links lead to, itself included.

    A text's set has its distinct ``n``-grams of words (ASCII letters lower-cased, parted by ASCII white space); with
    fewer words, the whole sequence is the one element. Two documents link if their similarity is ``percent`` of 100
    or more. A null text, or one without words, has an empty set and links with nothing. Rows with one id are judged
    by their own texts; a null id can be linked, but is no component's id unless all of it have none.

    Links are decided on the words themselves. ``n_shingles`` counts 64-bit hashes of the n-grams: two of a set's m are
    expected to fall together in one of 2^65 / m^2 texts, which for a text of a million words is one in 37 million.
    """
    store = Store(df.sparkSession)
    rows = _texts(df, doc_id, text)
    told = store.put(_described(rows, n))
    rows, documents = _told_apart(rows, told.where("not gram").drop("gram"))
    documents = documents.drop("check")
    common = told.where("gram").groupBy("text_key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "text_key").limit(ORDERED).toArrow()
    grams, counts = common["text_key"].to_numpy().astype(np.uint64), common["n"].to_numpy()
    order = np.argsort(grams)
    # A column that only one text has takes no part in the product.
    cells = _prefixes(rows, n, percent, grams[order], counts[order], max(BLOCK, documents.count() // PARTS))
    cells = store.put(_shared_columns(cells).withColumn("class", F.col("text_key")))
    links, turn, last = [], 0, float("inf")
    left, size = _pairs_left(cells)
    while turn < ROUNDS and size and (not turn or PAIRS_PER_CELL * size < left < 0.8 * last):
        links.append(_linked(_leaders(cells, percent, turn), rows, n, percent, store))
        so_far = component_labels(_union(links), store).select(F.col("node").alias("text_key"), F.col("label").alias("class"))
        labelled = cells.drop("class").join(so_far, "text_key", "left").withColumn("class", F.coalesce("class", "text_key"))
        old, cells, turn, last = cells, store.put(_open_cells(labelled)), turn + 1, left
        store.free(old)
        left, size = _pairs_left(cells)
    if size:
        links.append(_linked(_product(cells, percent, store), rows, n, percent, store))
    store.free(cells)
    texts = documents.where("n > 0").groupBy("text_key").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least"))
    if links:
        labels = component_labels(_union(links), store).select(F.col("node").alias("text_key"), F.col("label").alias("class"))
        classed = store.put(texts.join(labels, "text_key"))
        classes = store.put(classed.groupBy("class").agg(F.count(F.lit(1)).alias("rows"), F.min("least").alias("least")))
        alone = texts.join(labels, "text_key", "left_anti").select("text_key", "rows", "least")
        texts = alone.union(_with_value(classed.drop("least"), classes, "class").select("text_key", "rows", "least"))
    whole = _with_value(documents, store.put(texts), "text_key")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _with_value(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``least`` of their key, null without one; ``values`` (key, rows, least) has each key once.

    ``values.rows`` is how many of ``rows`` have the key. No task gathers the rows of a frequent key.
    """
    total = rows.count()
    hot = values.where(F.col("rows") * PARTS > total).select(key, "least")
    rest = values.where(F.col("rows") * PARTS <= total).select(key, "least")
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(others.join(rest, key, "left"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def keep_one(df: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is their component's; rows with one id are the same document. Columns stay.

    The ids to drop go to where the rows are if they are few by a count.
    """
    mark = fresh(df, "dropped")[0]
    found = near_duplicates(df, n, percent, doc_id, text).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    gone = Store(df.sparkSession).put(found.where("not stays").select(F.col("doc_id").alias(mark)))
    gone = F.broadcast(gone) if gone.count() <= DROPPED else gone
    return df.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col(mark)), "left_anti")
