"""Stretches of a text whose words repeat with a period, found by the power-of-two names of Karp, Miller and Rosenberg.

Level k names every block of 2^k words of a text, so that two blocks have one name exactly if their words are the same.
A block's name comes from the names of its halves; a block that occurs once gets no name, and neither has any longer
block that starts there. How far the words from two places agree, forwards or backwards, is read off the levels from the
highest down. All of it is NumPy over whole arrays: no hash stands for a block, and no suffixes are sorted.

A run of period q and at least 3q words covers a place of the grid of multiples of q from which q words equal the next q.
The first such place of a run is its candidate; it is widened both ways. Of periods with one stretch the smallest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.session import ship_code

#: The least number of words of a run, and how often its period must fit.
MIN_WORDS, MIN_TIMES = 24, 3
#: Places of the grid that are looked at together.
PLACES = 1 << 20


def name_levels(words: list[bytes]) -> list[np.ndarray]:
    """By level k: the name of the block of 2^k words from each place, -1 for a block that occurs once."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    first = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    levels = []
    level = np.where(np.bincount(first)[first] > 1, first, -1) if words else first
    half = 1
    while len(level) and level.max() >= 0:
        levels.append(level)
        if len(level) <= half:
            break
        head, tail = level[:-half], level[half:]
        at = np.flatnonzero((head >= 0) & (tail >= 0))
        _, names, times = np.unique(head[at] * len(words) + tail[at], return_inverse=True, return_counts=True)
        level = np.full(len(head), -1, np.int64)
        often = times[names] > 1
        level[at[often]] = names[often]
        half *= 2
    return levels


def agree_from(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from place ``a`` on equal those from ``b`` on, for each pair with a < b."""
    same = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        there = np.flatnonzero(b + same < len(level))
        x, y = level[a[there] + same[there]], level[b[there] + same[there]]
        same[there[(x == y) & (x >= 0)]] += 1 << k
    return same


def agree_before(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words just before place ``a`` equal those just before ``b``, for each pair with a < b."""
    same = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        back = same + (1 << k)
        there = np.flatnonzero(a >= back)
        x, y = levels[k][a[there] - back[there]], levels[k][b[there] - back[there]]
        same[there[(x == y) & (x >= 0)]] += 1 << k
    return same


def _candidates(level: np.ndarray, k: int, n: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the periods from 2^k to below 2^(k+1): the first grid places of stretches whose next block is the same."""
    periods = np.arange(1 << k, min(2 << k, n // times + 1))
    while len(periods):
        counts = n // periods - 1
        ends = np.cumsum(counts)
        part = max(1, int(np.searchsorted(ends, PLACES)))
        q, ends = np.repeat(periods[:part], counts[:part]), ends[:part]
        place = (np.arange(ends[-1]) - np.repeat(ends - counts[:part], counts[:part])) * q
        x = level[place]
        some = np.flatnonzero((x >= 0) & (x == level[place + q]))
        inner = place[some] + q[some] - (1 << k)
        y = level[inner]
        some = some[(y >= 0) & (y == level[inner + q[some]])]
        # A place right behind another of its period has that one's stretch.
        behind = np.zeros(len(some), bool)
        behind[1:] = (some[1:] == some[:-1] + 1) & (q[some[1:]] == q[some[:-1]])
        some = some[~behind]
        yield place[some], q[some]
        periods = periods[part:]


def runs_of(words: list[bytes], min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> np.ndarray:
    """(start, length, period) of each run as rows, by start and then period.

    A run has at least ``min_words`` words and ``min_times`` periods (3 or more, so that two blocks of its grid are whole),
    its period is its smallest, and no neighbouring word goes on with it.
    """
    if min_times < 3:
        raise ValueError("a run has its period three times at least")
    n = len(words)
    none = np.zeros((0, 3), np.int64)
    if n < min_words:
        return none
    levels = name_levels(words)
    # A run's words but its last period are a block that occurs again a period on; it has so many words at least.
    least = max(1, -(-min_words * (min_times - 1) // min_times))
    if len(levels) < least.bit_length():
        return none
    found = []
    for k, level in enumerate(levels):
        for place, q in _candidates(level, k, n, min_times):
            start = place - agree_before(levels, place, place + q)
            length = place + q + agree_from(levels, place, place + q) - start
            long = length >= np.maximum(min_words, min_times * q)
            found.append(np.stack([start, length, q], axis=1)[long])
    rows = np.concatenate([none, *found])
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    smallest = np.ones(len(rows), bool)
    smallest[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[smallest]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run has behind its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def find_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> DataFrame:
    """Per row: doc_id, runs (array of start, length, period by start and period) and collapsed, the text without repeats.

    Words are what stands between characters of ``[\\x20\\x09-\\x0D]``; starts count words from 0. ``collapsed`` has the
    words that no run contains behind its first period, joined by one space. A null or empty text has no words, no runs
    and an empty ``collapsed``. Rows are independent: repeated ids and rows each get their own, null ids stay null, an
    empty table gives no rows, and other columns are not read. A text is one task's work, in time of about n log² n and
    memory of n log n of its n words, however often it repeats itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for value in batch.column(1):
                words = (value.as_py() or b"").split()  # bytes are split at just the six ASCII characters
                found.append(runs_of(words, min_words, min_times))
                texts.append(b" ".join(kept_words(words, found[-1])))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
            runs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), runs, pa.array(texts, pa.binary())], ["doc_id", "runs", "collapsed"])

    ship_code(df.sparkSession)
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def run_rows(found: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) of each run that :func:`find_runs` returned; texts without runs give no row."""
    return found.select("doc_id", F.explode("runs").alias("run")).select("doc_id", "run.*")


def digests(found: DataFrame) -> DataFrame:
    """Per row of :func:`find_runs`: doc_id, n_runs, the run with the greatest length by period, and two digests.

    ``start``, ``length``, ``period`` and ``exponent_milli`` are null without a run; of equals the run with the smallest
    start, then period, is taken, by whole numbers. ``runs_sha256`` is over a line ``start,length,period`` of each run,
    ``collapsed_sha256`` over the collapsed text.
    """
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
