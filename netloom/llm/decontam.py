"""Benchmark passages in documents, with a few edits allowed, by the q-gram lemma and banded alignment.

A passage of m characters that turns into a stretch of a document by at most k edits shares at least
``m - q + 1 - k q`` q-grams with it, all on at most k + 1 neighbouring diagonals (position in the document minus
position in the passage). Shared q-grams are counted in bands of 2 (k + 1) diagonals that overlap by half, so one band
holds them all; bands that reach the bound are aligned within the band, and stay if the edits are within the budget.

Passages and texts are compared in lower case with each run of white space as one space, and positions refer to that.
The passages are collected in blocks of bounded size, and each block is compared with all documents; of more than one
block, what each finds is written out before the next is fetched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType
from pyspark.sql.pandas.types import to_arrow_type

from netloom.storage import Store

#: Characters of a q-gram; edits for each character of a passage.
Q, RATE = 8, 0.1
#: Characters of the passages that travel with a task at once; of the texts and pairs that a task compares at once.
BLOCK_CHARS, TEXT_CHARS, PAIRS = 2_000_000, 2_000_000, 2_000_000
#: Characters hashed at a time, few enough for a processor's cache; least and most bits of the first look-up's table.
HASHED, FEW_BITS, MOST_BITS = 1 << 15, 12, 24
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> str:
    """The text as it is compared."""
    return " ".join((text or "").lower().replace("\0", " ").split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash for each position at which a q-gram begins: a polynomial of its codes, put together from halves."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, size, out, done = codes.astype(np.uint64), 1, None, 0
    while True:
        power = np.uint64(pow(int(_PRIME), size, 1 << 64))
        if q & size:
            out = part.copy() if out is None else out[: len(codes) - done - size + 1] * power + part[done:]
            done += size
        if done == q:
            break
        part = part[:-size] * power + part[size:]
        size *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def budget(length: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed in a passage: its rate, but no more than leave the lemma's bound at 1."""
    return max(0, min(int(rate * length), (length - q) // q))


def align(item: np.ndarray, window: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The fewest edits between ``item`` and any stretch of ``window``: (edits, start, end), or None beyond ``most``.

    Only cells on diagonals ``low`` to ``high`` (place in the window minus place in the item) are filled.
    """
    m, width, far = len(item), high - low + 1, len(item) + len(window) + 1
    steps = np.arange(width)
    at = steps + low
    best = np.where((at >= 0) & (at <= len(window)), 0, far)
    start = at.copy()
    padded = np.concatenate([np.full(m + width + max(0, -low) + 1, -1, np.int64), window.astype(np.int64), np.full(m + width + max(0, high) + 1, -1, np.int64)])
    origin = m + width + max(0, -low) + 1
    for i in range(1, m + 1):
        # Column j of this row is the place i + low + j in the window; the character before it is one less.
        ends = i + at
        match = padded[origin + low + i - 1 : origin + low + i - 1 + width] != item[i - 1]
        cost = best + match
        came = start
        above = np.append(best[1:] + 1, far)
        cost, came = np.where(above < cost, above, cost), np.where(above < cost, np.append(start[1:], 0), came)
        cost = np.where((ends >= 0) & (ends <= len(window)), cost, far)
        # A skipped character of the window costs one for each step to the right.
        key = (cost - steps) * (width + 1) + steps
        left = np.minimum.accumulate(key) % (width + 1)
        best, start = cost[left] + steps - left, came[left]
        best = np.where((ends >= 0) & (ends <= len(window)), best, far)
        if best.min() > most:
            return None
    j = int(best.argmin())
    return int(best[j]), int(start[j]), int(m + low + j)


class Matcher:
    """Finds the passages ``items`` (id, text as compared) in texts."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE) -> None:
        self.q = q
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.codes = [_codes(t) for t in self.texts]
        self.budgets = np.array([budget(len(t), q, rate) for t in self.texts], np.int64)
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.least = np.maximum(1, lengths - q + 1 - self.budgets * q)
        self.stride = self.budgets + 1
        self.grams = [_qgrams(c, q) for c in self.codes]
        hashes = np.concatenate([*self.grams, np.empty(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.item = np.repeat(np.arange(len(items)), np.array([len(g) for g in self.grams], np.int64))[order]
        self.offset = np.concatenate([*(np.arange(len(g)) for g in self.grams), np.empty(0, np.int64)])[order].astype(np.int64)
        #: The different hashes in order, where each begins in ``item`` and ``offset``, and how often it is there.
        self.hashes, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        bits = min(MOST_BITS, max(FEW_BITS, (16 * len(self.hashes)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.hashes >> self.shift).view(np.int64)] = True
        #: Passages shorter than a q-gram are looked up as they are.
        self.short = [i for i, t in enumerate(self.texts) if 0 < len(t) < q]

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(place of the text, place of the passage, start, end, edits) of each stretch, best first where they overlap."""
        joined = "\0".join(texts)
        codes = _codes(joined)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        out = [(d, i, at, at + len(self.texts[i]), 0) for i in self.short for d, t in enumerate(texts) for at in _places(t, self.texts[i])]
        bands = self._bands(codes)
        regions: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for item, band in bands:
            k, stride = int(self.budgets[item]), int(self.stride[item])
            low = (band - 1) * stride - len(codes)
            doc = int(np.searchsorted(starts, max(0, low + len(self.texts[item]) // 2), "right")) - 1
            for d in {max(0, doc - 1), min(doc, len(texts) - 1), min(doc + 1, len(texts) - 1)}:
                begin, end = int(starts[d]), int(starts[d]) + len(texts[d])
                if begin - len(self.texts[item]) <= low + 2 * stride and low - k <= end:
                    found = self._verify(item, codes[begin:end], texts[d], low - begin, low - begin + 2 * stride - 1)
                    if found:
                        regions.setdefault((d, item), []).append(found)
        for (d, item), found in regions.items():
            taken: list[tuple[int, int]] = []
            for edits, start, end in sorted(set(found)):
                if all(end <= a or b <= start for a, b in taken):
                    taken.append((start, end))
                    out.append((d, item, start, end, edits))
        return out

    def _hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions whose q-gram some passage has, and its place in ``hashes``; a block of codes at a time."""
        at, where = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for begin in range(0, len(codes) if len(self.hashes) else 0, HASHED):
            grams = _qgrams(codes[begin : begin + HASHED + self.q - 1], self.q)
            maybe = np.flatnonzero(self.table[(grams >> self.shift).view(np.int64)])
            grams = grams[maybe]
            place = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
            known = self.hashes[place] == grams
            at.append(maybe[known] + begin)
            where.append(place[known])
        return np.concatenate(at), np.concatenate(where)

    def _bands(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """The (item, band) whose shared q-grams reach the item's bound."""
        at, where = self._hits(codes)
        first, count, size = self.first[where], self.count[where], len(codes)
        keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        # A diagonal is moved by the size, so that it isn't negative; a band of an item is a number below ``wide``.
        wide = 2 * size + 3
        cuts = np.searchsorted(np.cumsum(count), np.arange(PAIRS, int(count.sum()) + PAIRS, PAIRS), "left") + 1 if len(count) else []
        begin = 0
        for cut in cuts:
            a, f, c = at[begin:cut], first[begin:cut], count[begin:cut]
            begin = int(cut)
            if not len(c):
                continue
            entry = np.repeat(f - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(int(c.sum()))
            item = self.item[entry]
            band = (np.repeat(a, c) - self.offset[entry] + size) // self.stride[item]
            both = np.concatenate([item * wide + band, item * wide + band + 1])
            k, n = np.unique(np.concatenate([both, keys]), return_inverse=True)
            total = np.bincount(n[: len(both)], minlength=len(k))
            total[n[len(both) :]] += sums
            keys, sums = k, total
        good = sums >= self.least[keys // wide]
        return [(int(k // wide), int(k % wide)) for k in keys[good]]

    def _verify(self, item: int, codes: np.ndarray, text: str, low: int, high: int) -> tuple[int, int, int] | None:
        k, m = int(self.budgets[item]), len(self.texts[item])
        low, high = low - k, high + k
        begin, end = max(0, low), min(len(codes), high + m)
        if end - begin < m - k:
            return None
        exact = text.find(self.texts[item], begin, end)
        if exact >= 0:
            return 0, exact, exact + m
        # Repeats in the text let a band count a q-gram of the passage many times; the lemma needs that many places of it.
        if int(np.isin(self.grams[item], _qgrams(codes[begin:end], self.q)).sum()) < self.least[item]:
            return None
        found = align(self.codes[item], codes[begin:end], low - begin, high - begin, k)
        if not found or found[0] > k:
            return None
        return found[0], found[1] + begin, found[2] + begin


def _places(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + len(part))


def passage_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The passages in blocks of at most ``BLOCK_CHARS`` characters, and whether a block is the last; empty ones are left out.

    The driver fetches a block when it is asked for. One passage is never parted, so a longer one is a block.
    """
    rows = benchmark.where(F.length(F.trim(F.col(f"`{text}`"))) > 0).select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).head()[0] or 0
    if chars <= BLOCK_CHARS:
        blocks = [rows]
    else:
        parts = 2 * -(-chars // BLOCK_CHARS)
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
        sums = dealt.withColumn("block", F.floor(F.sum(F.length("text")).over(Window.partitionBy("part").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, 0)) / BLOCK_CHARS))
        keys = sorted((r[0], r[1]) for r in sums.select("part", "block").distinct().collect())
        blocks = [sums.where((F.col("part") == p) & (F.col("block") == b)) for p, b in keys]
    for i, block in enumerate(blocks):
        items = [(r["item_id"], plain(r["text"])) for r in block.select("item_id", "text").collect()]
        yield [x for x in items if x[1]], i == len(blocks) - 1


def _batched(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """The texts as compared, a bounded number of characters at a time; a longer text comes alone."""
    begin, part, size = 0, [], 0
    for i, t in enumerate(texts):
        part.append(plain(t))
        size += len(part[-1])
        if size >= TEXT_CHARS:
            yield begin, part
            begin, part, size = i + 1, [], 0
    if part:
        yield begin, part


def contaminated(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """Per stretch of a document that is a passage within its edit budget: doc_id, item_id, start, end, edits.

    The budget is ``rate`` of the passage's length, less where the lemma would bound nothing. Stretches of one passage
    in one document don't overlap. Null and empty texts or passages match nothing; repeated rows each give their rows.
    """
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    id_type, item_type = rows.schema["doc_id"].dataType, benchmark.schema[item_id].dataType
    named, store, out = to_arrow_type(item_type), Store(documents.sparkSession), []
    for items, last in passage_blocks(benchmark, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, q, rate)
            for batch in batches:
                for begin, part in _batched(batch.column(1).to_pylist()):
                    found = matcher.find(part)
                    ids = batch.column(0).take(pa.array([begin + x[0] for x in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([matcher.ids[x[1]] for x in found], named), *(pa.array([x[i] for x in found], pa.int32()) for i in (2, 3, 4))], ["doc_id", "item_id", "start", "end", "edits"])

        part = rows.mapInArrow(run, f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, start int, end int, edits int")
        out.append(part if last else store.put(part))
    if not out:
        return rows.where("false").select("doc_id", F.lit(None).cast(item_type).alias("item_id"), *(F.lit(0).alias(c) for c in ("start", "end", "edits")))
    return reduce(DataFrame.union, out)


def clean_of(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """The rows of ``documents`` without any such stretch, with all their columns; rows are judged where they are.

    Null and empty texts contain nothing and stay; null and empty passages are in nothing.
    """
    store = Store(documents.sparkSession)
    for items, last in passage_blocks(benchmark, item_id, item_text):

        def judge(batches: Iterator[pd.Series], items: list = items) -> Iterator[pd.Series]:
            matcher = Matcher(items, q, rate)
            for texts in batches:
                good = np.ones(len(texts), bool)
                for begin, part in _batched(texts.tolist()):
                    for x in matcher.find(part):
                        good[begin + x[0]] = False
                yield pd.Series(good)

        judged = documents.where(F.pandas_udf(judge, "boolean", PandasUDFType.SCALAR_ITER)(F.col(f"`{text}`")))
        documents = judged if last else store.put(judged)
    return documents
