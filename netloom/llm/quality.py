"""Text quality from weak labels: heuristics vote, expectation-maximisation weighs them, a linear scorer learns the result.

Each labeller looks at one property of a text and votes good, bad or nothing. A text's votes make one string, of which
there are at most three to the power of the labellers, and a few hundred as a rule; the counts of these strings over
all documents are all that expectation-maximisation needs. It gives each labeller's accuracy, and each string of votes
the chance that its texts are good. With these as targets, a logistic scorer over hashed features of a bounded sample
of rows is trained: the steps of a text's properties, and its words, which no labeller looks at. Texts are read once:
their votes, the steps and the buckets of their words, two bytes a different word, are written out, and all else works
on these.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from netloom.storage import Store

#: Rows that the scorer is trained on; buckets of its properties, and of words, the most that a text can have.
SAMPLE, BUCKETS, WORDS = 8_000, 1 << 16, 1 << 14
#: What draws the weights of properties and of words towards 0. Words are many, so each of them is held back more.
PENALTY, WORD_PENALTY = 1e-5, 1e-4
#: A text is kept from this score.
KEEP = 0.9
_RATIO_STEPS = np.array([0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98])
_LETTERS = re.compile(r"[^\W\d_]+")
#: Properties of a text, kinds of words, and the most steps that one of them can have.
PROPERTIES, SHAPES, STEPS = 11, "adxm", 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def properties(text: str | None, words: list[str] | None = None, counts: Counter | None = None) -> dict[str, float]:
    """What the labellers look at; a null or empty text has zeros. ``words`` and their ``counts`` may be given."""
    text = text or ""
    words = text.split() if words is None else words
    counts = Counter(words) if counts is None else counts
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    return {
        "words": len(words),
        "length": sum(map(len, words)) / n,
        "letters": sum(map(len, _LETTERS.findall(text))) / max(1, chars - text.count(" ") - text.count("\n")),
        "digits": sum(map(text.count, "0123456789")) / chars,
        "top": max(counts.values(), default=0) / n,
        "distinct": len(counts) / n**0.8,
        "twice": sum(map(operator.eq, words, words[1:])) / n,
        "same_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "ends": sum(x[-1] in ".!?:\"'" for x in lines) / max(1, len(lines)),
        "upper": sum(map(str.isupper, words)) / n,
        "longest": max(map(len, counts), default=0),
    }


def votes(p: dict[str, float]) -> str:
    """A letter for each labeller: g(ood), b(ad) or - for none."""

    def vote(good: bool, bad: bool) -> str:
        return "b" if bad else "g" if good else "-"

    return "".join(
        (
            vote(p["words"] >= 30, p["words"] < 3),
            vote(3 <= p["length"] <= 9, p["length"] < 2 or p["length"] > 14),
            vote(p["letters"] > 0.92, p["letters"] < 0.8),
            vote(p["digits"] < 0.03, p["digits"] > 0.1),
            vote(p["top"] < 0.12, p["top"] > 0.25),
            vote(p["twice"] < 0.03, p["twice"] > 0.1),
            vote(p["same_lines"] < 0.2, p["same_lines"] > 0.5),
            vote(p["distinct"] > 1.4, p["distinct"] < 1.0 and p["words"] >= 30),
            vote(p["upper"] < 0.1, p["upper"] > 0.3),
            vote(p["ends"] > 0.6, p["ends"] < 0.2 and p["words"] >= 30),
        )
    )


def expectation_maximisation(counts: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """The chance of good for each string of votes, and each labeller's accuracies (votes right given good, bad).

    The start takes good texts to be the majority that hardly any labeller calls bad, and a bad text to be caught by one
    labeller in five; this keeps the two classes from changing places.
    """
    if not counts:
        return {}, np.empty((0, 2))
    strings = sorted(counts)
    n = np.array([counts[s] for s in strings], float)
    cast = np.array([[{"g": 1, "b": -1, "-": 0}[c] for c in s] for s in strings])
    right = np.tile([0.99, 0.2], (cast.shape[1], 1))
    prior = 0.7
    good = np.full(len(strings), 0.5)
    for _ in range(rounds):
        if_good = np.log(prior) + (np.where(cast == 1, np.log(right[:, 0]), 0) + np.where(cast == -1, np.log(1 - right[:, 0]), 0)).sum(1)
        if_bad = np.log(1 - prior) + (np.where(cast == -1, np.log(right[:, 1]), 0) + np.where(cast == 1, np.log(1 - right[:, 1]), 0)).sum(1)
        good = 1 / (1 + np.exp(np.clip(if_bad - if_good, -500, 500)))
        weigh = n * good, n * (1 - good)
        prior = float(np.clip(weigh[0].sum() / n.sum(), 0.02, 0.98))
        for k, sign in ((0, 1), (1, -1)):
            w = weigh[k][:, None]
            right[:, k] = np.clip(((w * (cast == sign)).sum(0) + (9.9, 2)[k]) / ((w * (cast != 0)).sum(0) + 10), (0.8, 0.02)[k], 0.995)
    return dict(zip(strings, good.tolist(), strict=True)), right


def steps_of(p: dict[str, float], counts: Counter) -> list[int]:
    """The step of each property, and of the share of each kind of word: 0 where there is none of it."""
    out = [int(np.searchsorted(_RATIO_STEPS, v)) if v <= 1 else min(STEPS - 1, 20 + int(np.log2(v + 1))) for v in p.values()]
    shapes = Counter()
    for w, n in counts.items():
        shapes["d" if w.isdigit() else "a" if w.isalpha() else "x" if w[:-1].isalpha() else "m"] += n
    total = max(1, sum(shapes.values()))
    return out + [1 + int(10 * shapes[k] / total) if shapes[k] else 0 for k in SHAPES]


def hashed(steps: np.ndarray) -> np.ndarray:
    """The buckets of rows of steps: each property alone, each two of them, and each kind of word; BUCKETS for none."""
    own = steps.astype(np.uint64) + np.arange(steps.shape[1], dtype=np.uint64) * np.uint64(STEPS)
    first, second = np.triu_indices(PROPERTIES, 1)
    names = np.concatenate([own, np.uint64(1 << 20) + own[:, first] * np.uint64(1 << 10) + own[:, second]], axis=1)
    out = ((names + np.uint64(1)) * _FACTOR >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    out[:, PROPERTIES : steps.shape[1]][steps[:, PROPERTIES:] == 0] = BUCKETS
    return out


def word_buckets(words: Iterable[str]) -> bytes:
    """The buckets of a text's different words, two bytes each, low byte first, ascending."""
    return np.unique(np.fromiter((crc32(w.encode("utf-8", "replace")) % WORDS for w in words), "<u2")).tobytes()


def word_sums(weights: np.ndarray, buckets: list[bytes]) -> np.ndarray:
    """The weights of each text's word buckets, added up and divided by the root of how many they are; 0 for none."""
    n = np.array([len(x) // 2 for x in buckets], np.int64)
    rows = np.repeat(np.arange(len(n)), n)
    return np.bincount(rows, weights[np.frombuffer(b"".join(buckets), "<u2")], len(n)) / np.sqrt(np.maximum(n, 1))


def train_scorer(rows: np.ndarray, targets: np.ndarray, buckets: list[bytes], rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of properties and of words, and the bias, of a logistic scorer for targets from 0 to 1.

    The bucket for none keeps the weight 0. A text's words together weigh as much as one of its properties.
    """
    r, c = np.repeat(np.arange(len(rows)), rows.shape[1]), rows.ravel()
    r, c = r[c < BUCKETS], c[c < BUCKETS]
    n = np.array([len(x) // 2 for x in buckets], np.int64)
    at, word = np.repeat(np.arange(len(n)), n), np.frombuffer(b"".join(buckets), "<u2")
    share = 1 / np.sqrt(np.maximum(n, 1))
    w, words, b = np.zeros(BUCKETS + 1), np.zeros(WORDS), 0.0
    sums, sums_words, sum_b = np.full(BUCKETS + 1, 1e-8), np.full(WORDS, 1e-8), 1e-8
    for _ in range(rounds if len(rows) else 0):
        total = np.bincount(r, w[c], len(rows)) + np.bincount(at, words[word], len(rows)) * share + b
        g = (1 / (1 + np.exp(-np.clip(total, -60, 60))) - targets) / len(rows)
        step = np.bincount(c, g[r], BUCKETS + 1) + PENALTY * w
        step_words = np.bincount(word, (g * share)[at], WORDS) + WORD_PENALTY * words
        sums, sums_words, sum_b = sums + step**2, sums_words + step_words**2, sum_b + g.sum() ** 2
        w, words, b = w - 0.1 * step / np.sqrt(sums), words - 0.1 * step_words / np.sqrt(sums_words), b - 0.1 * g.sum() / np.sqrt(sum_b)
    return w, words, float(b)


def _looked_at(rows: DataFrame) -> DataFrame:
    """(doc_id, draw, votes, steps, words) of rows (doc_id, draw, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cast, steps, buckets = [], [], []
            for text in batch.column(2).to_pylist():
                words = text.split()
                counts = Counter(words)
                p = properties(text, words, counts)
                cast.append(votes(p))
                steps.append(steps_of(p, counts))
                buckets.append(word_buckets(counts))
            columns = pa.array(cast, pa.string()), pa.array(steps, pa.list_(pa.int8())), pa.array(buckets, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "draw", "votes", "steps", "words"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, draw long, votes string, steps array<tinyint>, words binary")


def score_quality(df: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, quality (0 to 1) and kept (from ``KEEP``).

    No given label is used. Votes are counted over all rows; the scorer learns from ``sample`` different rows at most,
    in the order of a hash of id and text, whatever their lengths; of each it takes all different words, as ``WORDS``
    buckets at most. Null and empty texts are scored like any other, as
    bad ones. An empty table gives no rows.
    """
    store = Store(df.sparkSession)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = store.put(_looked_at(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{doc_id}`"), whole).alias("draw"), whole.alias("text"))))
    counts = {r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()}
    chance, _ = expectation_maximisation(counts)
    # Three times the sample is ample for copies; the hash is spread evenly from -2^63.
    rate = 3 * sample / max(1, sum(counts.values()))
    drawn = rows.where(F.col("draw") < int(-(2**63) + rate * 2**64)) if rate < 1 else rows
    drawn = drawn.groupBy("draw").agg(F.first("votes").alias("votes"), F.first("steps").alias("steps"), F.first("words").alias("words")).orderBy("draw").limit(sample).collect()
    targets = np.array([chance[r["votes"]] for r in drawn])
    steps = np.array([list(r["steps"]) for r in drawn], np.int64).reshape(-1, PROPERTIES + len(SHAPES))
    weights, words_weigh, bias = train_scorer(hashed(steps), targets, [bytes(r["words"]) for r in drawn])

    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for steps, buckets in batches:
            own = hashed(np.array(steps.tolist(), np.int64).reshape(-1, PROPERTIES + len(SHAPES)))
            total = weights[own].sum(1) + word_sums(words_weigh, buckets.tolist()) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(total, -60, 60))))

    scored = rows.select("doc_id", F.pandas_udf(judge, "double", PandasUDFType.SCALAR_ITER)("steps", "words").alias("quality"))
    return scored.withColumn("kept", F.col("quality") >= KEEP)
