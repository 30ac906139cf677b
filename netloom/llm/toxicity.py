"""Toxic texts by non-negative positive-unlabelled learning.

Confirmed toxic texts and all unlabelled ones train a linear classifier over the words of a text and the beginnings of
its words. The risk of calling a text clean is measured on the unlabelled texts less the share, by the class prior,
that the toxic ones among them have; where that falls below zero, as it does when the model has learnt the sample by
heart, the step goes the other way. Only features that are clearly commoner in toxic texts than in all texts take part,
so a long clean text gathers no evidence from its many neutral words. The prior and the point where a score is 0.5 come
from the labelled rows outside the held-out fifth.

The labelled rows that are learnt from are a bounded draw. Unlabelled texts are not drawn: the frequencies of features
and the unlabelled risk cover every row that is not held out. Texts become the set of their features where they are;
rows with the same set become one with a weight, and buckets of so many cells train a model each, whose mean counts. A
text that fills more than one in PARTS of all rows weighs as one row, so that copies do not pass for usage.
"""

from __future__ import annotations

import warnings
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from netloom.storage import Store

#: Labelled rows that are learnt from: confirmed toxic ones, and clean ones (for the cut alone).
POSITIVE, NEGATIVE = 2_000, 2_000
#: Features that may be looked at: those that most toxic texts have.
WIDTH = 50_000
#: Cells (a row's features, added up) of the unlabelled rows that one task trains on.
CELLS = 2_000_000
#: A text or a set of features with more than one row in PARTS, so at most PARTS of them, is frequent.
PARTS = 4_000
#: A row's weight, as a whole number, so that sums do not depend on their order.
ROW = 1 << 20
PREFIXES = (3, 4, 5, 6)
STEPS, RATE, DECAY = 400, 0.1, 1e-4
#: Beginnings of words and sets of features that a task remembers.
HEADS_KEPT, SETS_KEPT = 200_000, 50_000
_EDGE = ".,;:!?\"'()[]{}<>*_-¿¡"


def held_out(doc_id: Column) -> Column:
    """Whether a row is in the fifth that no label is learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def features_of(word: str) -> list[str]:
    """``=`` and the word without marks around it, and ``^`` and each of its beginnings."""
    word = word.strip(_EDGE)
    return [f"={word}", *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)] if word else []


class Reader:
    """The places in ``names`` of the features that a text has, as a set. Beginnings that were met are remembered."""

    def __init__(self, names: Sequence[str]) -> None:
        self.exact = {n[1:]: i for i, n in enumerate(names) if n[0] == "="}
        self.begins = {n[1:]: i for i, n in enumerate(names) if n[0] == "^"}
        self.whole = set(self.exact)
        self.seen: set[str] = set()
        self.telling: set[str] = set()
        self.places: dict[str, tuple[int, ...]] = {}

    def _learn(self, heads: set[str]) -> None:
        """What the longest beginnings of words contain."""
        self.seen |= heads
        for head in heads:
            found = (self.begins.get(head[:k]) for k in PREFIXES if len(head) >= k)
            if places := tuple(i for i in found if i is not None):
                self.telling.add(head)
                self.places[head] = places

    def __call__(self, text: str | None) -> set[int]:
        words = {w.strip(_EDGE) for w in set((text or "").lower().split())}
        heads = {w[: PREFIXES[-1]] for w in words}
        if new := heads - self.seen:
            if len(self.seen) + len(new) > HEADS_KEPT:
                self.seen, self.telling, self.places, new = set(), set(), {}, heads
            self._learn(new)
        out = set(map(self.exact.__getitem__, words & self.whole))
        for head in heads & self.telling:
            out.update(self.places[head])
        return out


@dataclass
class Model:
    """A name and a weight for each feature that takes part; the score of a text is the logistic of its sum."""

    names: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -4.0

    def sums(self, texts: list[str | None], reader: Reader) -> np.ndarray:
        """The sum of weights of each text, added up in the order of the features."""
        weights = self.weights.tolist()
        return np.array([self.bias + sum(weights[i] for i in sorted(reader(t))) for t in texts])


def _logistic(x: np.ndarray) -> np.ndarray:
    """From 0 to 1; far out, where it no longer changes, the argument is cut."""
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Risk:
    """The non-negative risk of weights and bias, over sets of features with a weight for each unlabelled one."""

    def __init__(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], weight: np.ndarray, size: int, prior: float) -> None:
        self.size, self.prior = size, prior
        self.of_p, self.p = self._cells(positive)
        self.of_u, self.u = self._cells(unlabelled)
        self.np, self.nu = len(positive), len(unlabelled)
        self.weight = weight / max(weight.sum(), 1e-300)

    @staticmethod
    def _cells(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The row and the feature of each cell."""
        return np.repeat(np.arange(len(rows)), np.array([len(x) for x in rows], np.int64)), np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)

    def parts(self, w: np.ndarray, b: float) -> tuple[float, float, np.ndarray, np.ndarray]:
        """The risk of toxic texts and that of clean ones, which may be below zero, with the scores of both samples."""
        sp = _logistic(np.bincount(self.of_p, w[self.p], self.np) + b)
        su = _logistic(np.bincount(self.of_u, w[self.u], self.nu) + b)
        toxic = -self.prior * np.log(np.maximum(sp, 1e-12)).sum() / max(1, self.np)
        clean = -(self.weight * np.log(np.maximum(1 - su, 1e-12))).sum() + self.prior * np.log(np.maximum(1 - sp, 1e-12)).sum() / max(1, self.np)
        return float(toxic), float(clean), sp, su

    def step(self, w: np.ndarray, b: float) -> np.ndarray:
        """The gradient, the bias last: of the whole risk, or, where the clean part is below zero, of it turned round."""
        _, clean, sp, su = self.parts(w, b)
        gp, gu = self.prior * (sp - 1) / max(1, self.np), self.weight * su
        back = -self.prior * sp / max(1, self.np)
        gp, gu = (-back, -gu) if clean < 0 else (gp + back, gu)
        return np.append(np.bincount(self.p, gp[self.of_p], self.size) + np.bincount(self.u, gu[self.of_u], self.size), gp.sum() + gu.sum())


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], weight: np.ndarray, size: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights, none below zero, and bias of the least risk, by Adam with a small decay of the weights."""
    risk = Risk(positive, unlabelled, weight, size, prior)
    w, b = np.zeros(size), -2.0
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        grad = risk.step(w, b) + np.append(DECAY * w, 0)
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    return w, float(b)


def best_cut(toxic: np.ndarray, clean: np.ndarray, prior: float) -> float:
    """The cut of the sums with the fewest errors on labelled rows; of equal ones, the middle of the widest gap."""
    values = np.unique(np.concatenate([toxic, clean]))
    cuts = np.concatenate([(values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    errors = np.searchsorted(np.sort(toxic), cuts) / max(1, len(toxic)) + (len(clean) - np.searchsorted(np.sort(clean), cuts)) / max(1, len(clean)) / max(prior, 0.02) * 0.5
    return float(cuts[np.lexsort((-np.append(np.diff(values), 1.0), np.round(errors, 9)))[0]])


def _told(rows: DataFrame) -> DataFrame:
    """(draw, text_key, low, high, features) of rows (draw, text_key, text): the names, and two marks of near copies.

    The marks are the least and the greatest hash of the text's word triples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = text.lower().split()
                hashes = [zlib.crc32(" ".join(words[k : k + 3]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(words) - 2))]
                names = sorted({n for w in set(words) for n in features_of(w)})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([min(hashes)], pa.int64()), pa.array([max(hashes)], pa.int64()), pa.array([names], pa.list_(pa.string()))], ["draw", "text_key", "low", "high", "features"])

    return rows.mapInArrow(run, "draw long, text_key long, low long, high long, features array<string>")


def _without_copies(told: DataFrame, most: int) -> DataFrame:
    """The first rows by (draw, text_key), ``most`` at most, of which no earlier one shares a mark."""
    first = F.min(F.struct("draw", "text_key")).alias("first")
    ids = told.groupBy("low").agg(first).select("first").join(told.groupBy("high").agg(first).select("first"), "first", "left_semi")
    ids = ids.select("first.*").distinct().orderBy("draw", "text_key").limit(most)
    return told.join(F.broadcast(ids), ["draw", "text_key"], "left_semi").groupBy("draw", "text_key").agg(F.first("features").alias("features"))


def _frequent(docs: DataFrame) -> dict[int, int]:
    """The weight of a row of each frequent text, at most PARTS, by the text's hash; all its rows weigh one together."""
    counts = docs.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"))
    least = docs.count() / PARTS
    return {r["text_key"]: max(1, ROW // r["n"]) for r in counts.where((F.col("n") > least) & (F.col("n") > 1)).collect()}


def _usage(docs: DataFrame, names: list[str], hot: dict[int, int]) -> tuple[np.ndarray, float]:
    """In how many rows each feature is, over all of ``docs`` (text_key, text), and how many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sums = Reader(names), np.zeros(len(names) + 1, np.int64)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, weight = reader(text), hot.get(key, ROW)
                sums[np.fromiter(found, np.int64, len(found))] += weight
                sums[-1] += weight
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(sums[there], pa.int64())], ["feature", "weight"])

    counts = np.zeros(len(names) + 1)
    for r in docs.mapInArrow(run, "feature int, weight long").groupBy("feature").agg(F.sum("weight").alias("weight")).collect():
        counts[r["feature"]] = r["weight"] / ROW
    return counts[:-1], float(counts[-1])


def _sets(docs: DataFrame, names: list[str], hot: dict[int, int]) -> DataFrame:
    """(places, weight) of each different set of features that rows of ``docs`` (text_key, text) have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = Reader(names), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.list_(pa.int32())), pa.array(list(held.values()), pa.int64())], ["places", "weight"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[tuple(sorted(reader(text)))] += hot.get(key, ROW)
            if len(held) > SETS_KEPT:
                yield out()
                held.clear()
        yield out()

    return docs.mapInArrow(run, "places array<int>, weight long").groupBy("places").agg(F.sum("weight").alias("weight"))


def _trained(sets: DataFrame, own: list[np.ndarray], size: int, prior: float) -> tuple[np.ndarray, float]:
    """The mean of the models of all buckets. Frequent sets are in each of them with a part of their weight."""
    cells, total = sets.agg(F.sum(F.size("places")), F.sum("weight")).head()
    buckets = max(1, -(-int(cells or 0) // CELLS))
    dealt = sets.withColumn("bucket", F.explode(F.when(F.col("weight") * PARTS > total, F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.pmod(F.xxhash64("places"), F.lit(buckets)).cast("int")))))
    share = F.when(F.col("weight") * PARTS > total, F.col("weight") / buckets).otherwise(F.col("weight").cast("double"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(order=[tuple(x) for x in rows["places"]]).sort_values("order")
        w, b = fit_nnpu(own, [np.asarray(x, np.int32) for x in rows["places"]], rows["share"].to_numpy(), size, prior)
        return pd.DataFrame({"place": np.arange(size + 1, dtype=np.int32), "value": np.append(w, b)})

    models = dealt.select("bucket", "places", share.alias("share")).groupBy("bucket").applyInPandas(run, "place int, value double")
    values = np.zeros(size + 1)
    for r in models.groupBy("place").agg(F.sort_array(F.collect_list("value")).alias("values")).collect():
        values[r["place"]] = sum(r["values"]) / len(r["values"])
    return values[:-1], float(values[-1])


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", positive: int = POSITIVE, negative: int = NEGATIVE, width: int = WIDTH) -> Model:
    """Train on ``documents`` with ``labels`` (same id, 0 or 1) of the rows that are not held out.

    At most ``positive`` confirmed toxic texts, without near copies, and ``negative`` clean ones, in the order of a
    hash of the id, are learnt from; their lengths do not matter. ``width`` bounds the features that are looked at. A
    null label is no label. The prior is the toxic share of the labelled rows. Where no toxic text is confirmed, or no
    feature tells them apart, a warning says so and the model gives every text the same low score.
    """
    store = Store(documents.sparkSession)
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = documents.where(~held_out(F.col(f"`{doc_id}`"))).select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(words).alias("text_key"), words.alias("text"))
    marks = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("label")).where(~held_out(F.col("doc_id")) & F.col("label").isin(0, 1))
    total, toxic = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).head()
    prior = min(0.9, toxic / max(1, total))
    draw = F.xxhash64("doc_id", F.lit("sample"))

    def drawn(value: int, most: int) -> DataFrame:
        """The texts of a bounded draw of labelled ids; so few ids are sent to where the texts are."""
        ids = marks.where(F.col("label") == value).select("doc_id").distinct().orderBy(draw).limit(most)
        return docs.join(F.broadcast(ids), "doc_id", "left_semi").select(draw.alias("draw"), "text_key", "text")

    def untrained(why: str) -> Model:
        warnings.warn(f"toxicity: {why}; every text gets the same low score", stacklevel=3)
        return Model()

    if not toxic:
        return untrained("no labelled row is toxic")
    own = store.put(_without_copies(store.put(_told(drawn(1, positive))), positive))
    n = own.count()
    common = own.select(F.explode("features").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(3, 0.005 * n))
    common = [(r["name"], r["n"]) for r in common.orderBy(F.desc("n"), "name").limit(width).collect()]
    if not common:
        return untrained("the confirmed texts share no words")
    plain = docs.select("text_key", "text")
    hot = _frequent(plain)
    usage, rows = _usage(plain, [x for x, _ in common], hot)
    ratio = (np.array([k for _, k in common]) / n) / ((usage + 0.5) / rows)
    names = sorted(x for (x, _), r in zip(common, ratio.tolist(), strict=True) if r >= 1 + 0.35 * (1 / max(prior, 0.02) - 1))
    if not names:
        return untrained("no word is commoner in the confirmed texts")
    place = {x: i for i, x in enumerate(names)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[place[x] for x in row if x in place] for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["draw", "text_key", "places"])

    positives = [np.array(r["places"], np.int32) for r in own.mapInArrow(placed, "draw long, text_key long, places array<int>").orderBy("draw", "text_key").collect()]
    model = Model(names, *_trained(store.put(_sets(plain, names, hot)), positives, len(names), prior))

    def sums(value: int, most: int) -> np.ndarray:
        rows = drawn(value, most).select("draw", _sums_of(F.col("text"), model).alias("total")).orderBy("draw", "total").limit(most)
        return np.array([r["total"] for r in rows.collect()])

    of_toxic, of_clean = sums(1, positive), sums(0, negative)
    if len(of_clean):
        model.bias -= best_cut(of_toxic, of_clean, prior)
    store.clear()
    return model


def _sums_of(text: Column, model: Model) -> Column:
    """The sum of weights of a text, from which its score follows."""

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(model.names)
        for texts in batches:
            yield pd.Series(model.sums(texts.tolist(), reader), dtype=float)

    return F.pandas_udf(judge, "double", PandasUDFType.SCALAR_ITER)(text)


def score_of(text: Column, model: Model) -> Column:
    """The score of a text from 0 to 1; a null or empty one has the model's score for no evidence."""
    total = F.greatest(F.least(_sums_of(text, model), F.lit(60.0)), F.lit(-60.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score_toxicity(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (1 from a score of 0.5). Every row is scored, labelled or not.

    A null text counts as empty, and an empty one gets the score of a text without features; an empty table gives no rows.
    """
    model = fit(documents, labels, doc_id, text)
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out(F.col(f"`{doc_id}`")).alias("held_out"), score_of(F.col(f"`{text}`"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that score below 0.5, with their columns; null and empty texts are judged as :func:`score_toxicity` does."""
    return documents.where(score_of(F.col(f"`{text}`"), fit(documents, labels, doc_id, text)) < 0.5)
