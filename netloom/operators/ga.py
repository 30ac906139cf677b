"""A genetic algorithm over populations (island, idx, genes) with a fitness that is maximised.

Every operator is an expression over whole populations; all islands go through a generation together. A fitness is a
function of the column of genes, built from Spark functions or a vectorised Python function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.order import numbered
from netloom.operators.rng import normal, uniform
from netloom.storage import Store

Fitness = Callable[[Column], Column]


class Crossover(Protocol):
    """Genes of a child from those of two parents; ``draw`` names the random numbers of a row."""

    def __call__(self, p1: Column, p2: Column, draw: tuple) -> Column: ...


class Mutator(Protocol):
    def __call__(self, genes: Column, draw: tuple) -> Column: ...


def uniform_crossover(p1: Column, p2: Column, draw: tuple) -> Column:
    """Each gene from either parent by a coin."""
    return F.transform(F.arrays_zip(p1.alias("a"), p2.alias("b")), lambda g, i: F.when(uniform(*draw, "cross", i) < 0.5, g["a"]).otherwise(g["b"]))


def gaussian_mutator(rate: float = 0.01, scale: float = 0.1) -> Mutator:
    """Noise of the given deviation on each gene with probability ``rate``."""

    def mutate(genes: Column, draw: tuple) -> Column:
        return F.transform(genes, lambda g, i: F.when(uniform(*draw, "mutate", i) < rate, g + scale * normal(*draw, "noise", i)).otherwise(g))

    return mutate


def evaluate(population: DataFrame, fitness: Fitness) -> DataFrame:
    """``population`` with its fitness, computed once for each row."""
    return population.withColumn("fitness", fitness(F.col("genes")))


def summary(population: DataFrame) -> DataFrame:
    """(island, n, best, avg, best_idx); of equals the first idx is best."""
    first = F.struct("fitness", -F.col("idx"))
    return population.groupBy("island").agg(F.count(F.lit(1)).alias("n"), F.max("fitness").alias("best"), F.avg("fitness").alias("avg"), F.max_by("idx", first).alias("best_idx"))


def normalised(population: DataFrame) -> DataFrame:
    """Fitness as a share of the island's largest."""
    most = population.groupBy("island").agg(F.max("fitness").alias("__most"))
    return population.join(most, "island").withColumn("normalised", F.coalesce(F.col("fitness") / F.nullif("__most", F.lit(0.0)), F.lit(0.0))).drop("__most")


def _slots(population: DataFrame) -> DataFrame:
    """(island, slot, n) of each row: generations replace rows and never change their number."""
    n = population.groupBy("island").agg(F.count(F.lit(1)).alias("n"))
    return population.select("island", F.col("idx").alias("slot")).join(n, "island")


def _drawn(population: DataFrame, seed: int | str, generation: int, purposes: Sequence[str], k: int, slots: DataFrame | None = None) -> DataFrame:
    """(island, slot, purpose, idx, genes, fitness) of the ``k`` rows that each slot draws for each purpose, with replacement."""
    slots = _slots(population) if slots is None else slots
    turns = F.explode(F.array(*[F.struct(F.lit(p).alias("purpose"), F.lit(i).alias("draw")) for p in purposes for i in range(k)]))
    draws = slots.select("island", "slot", "n", turns.alias("turn")).select("island", "slot", "n", "turn.*")
    place = F.floor(uniform(seed, generation, F.col("island"), F.col("slot"), F.col("purpose"), F.col("draw")) * F.col("n")).cast("long")
    return draws.withColumn("idx", place).join(population.withColumn("idx", F.col("idx").cast("long")), ["island", "idx"])


def _fittest(purpose: str) -> Column:
    mine = F.col("purpose") == purpose
    return F.max_by("genes", F.when(mine, F.struct("fitness", -F.col("idx"))))


def tournament(population: DataFrame, seed: int | str, generation: int, purpose: str, k: int = 3) -> DataFrame:
    """(island, slot, genes): for each slot the fittest of ``k`` drawn with replacement; the first idx of equals."""
    return _drawn(population, seed, generation, [purpose], k).groupBy("island", "slot").agg(_fittest(purpose).alias("genes"))


def next_generation(population: DataFrame, fitness: Fitness, seed: int | str, generation: int, crossover: Crossover = uniform_crossover, mutator: Mutator | None = None, k: int = 3, slots: DataFrame | None = None) -> DataFrame:
    """The children of one generation, which replace all parents. Islands number their rows from 0.

    A child's parents are drawn together, so a generation moves its rows once to where they are drawn and once to the slots.
    With ``slots``, those of any generation before, the population is read once.
    """
    mutator = mutator or gaussian_mutator()
    met = _drawn(population, seed, generation, ["first", "second"], k, slots)
    draw = (seed, generation, F.col("island"), F.col("slot"))
    child = met.groupBy("island", "slot").agg(_fittest("first").alias("p1"), _fittest("second").alias("p2")).withColumn("genes", crossover(F.col("p1"), F.col("p2"), draw))
    return evaluate(child.select("island", F.col("slot").alias("idx"), mutator(F.col("genes"), draw).alias("genes")), fitness)


def migrate(population: DataFrame) -> DataFrame:
    """Each island's last row gives way to the best of the next island in the ring, as all stood before."""
    stats = population.groupBy("island").agg(F.max("idx").alias("last"), F.max_by(F.struct("genes", "fitness"), F.struct("fitness", -F.col("idx"))).alias("best"))
    ring = Window.partitionBy(F.lit(0)).orderBy("island")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    comes = stats.select("island", "last", F.coalesce(F.lead("best").over(ring), F.first("best").over(whole)).alias("comes"))
    here = F.col("idx") == F.col("last")
    return population.join(comes, "island").select("island", "idx", F.when(here, F.col("comes.genes")).otherwise(F.col("genes")).alias("genes"), F.when(here, F.col("comes.fitness")).otherwise(F.col("fitness")).alias("fitness"))


def split_population(population: DataFrame, n: int) -> DataFrame:
    """Islands of nearly equal size, in the order of idx; the first ones are larger by one. idx starts anew in each."""
    rows, total = numbered(population, "place", "idx")
    each, more = divmod(total, n)
    place, large = F.col("place"), F.lit(more * (each + 1))
    small = F.when(place >= large, place - large)
    island = F.coalesce(more + F.floor(small / max(1, each)), F.floor(place / (each + 1)))
    return rows.select(*[c for c in population.columns if c != "idx"], island.cast("int").alias("island"), F.coalesce(small % max(1, each), place % (each + 1)).cast("int").alias("idx"))


def run(population: DataFrame, fitness: Fitness, generations: int = 100, migration_interval: int | None = None, seed: int | str = 0, crossover: Crossover = uniform_crossover, mutator: Mutator | None = None, epoch_generations: str = "interval") -> tuple[DataFrame, DataFrame]:
    """The final population and the history (island, generation, best, avg).

    With a migration interval, islands exchange their best after each epoch of so many generations; with
    ``epoch_generations="reference"`` each of the ``generations // migration_interval`` epochs is ``generations`` long.
    Each generation is written to the shared folder, so that plans stay short and a lost executor repeats one of them.
    """
    store = Store(population.sparkSession)
    interval = migration_interval or generations
    epochs = generations // interval if interval else 0
    length = generations if epoch_generations == "reference" else interval
    now = store.put(evaluate(population.select("island", "idx", "genes"), fitness))
    history = []
    for epoch in range(epochs):
        for g in range(length):
            old, now = now, store.put(next_generation(now, fitness, seed, epoch * length + g, crossover, mutator))
            store.free(old)
            history.append(summary(now).select("island", F.lit(epoch * length + g).alias("generation"), "best", "avg").collect())
        if migration_interval:
            old, now = now, store.put(migrate(now))
            store.free(old)
    rows = [tuple(r) for part in history for r in part]
    kind = f"island {now.schema['island'].dataType.simpleString()}, generation int, best double, avg double"
    return now, population.sparkSession.createDataFrame(rows, kind)


#: Generations that follow each other in one plan, between two that are written.
TOGETHER = 5


def evolve(population: DataFrame, fitness: Fitness, generations: int = 100, migration_interval: int | None = None, seed: int | str = 0, crossover: Crossover = uniform_crossover, mutator: Mutator | None = None) -> DataFrame:
    """The final population of :func:`run` with epochs of the migration interval, without its history.

    As nobody asks for the generations between, only each ``TOGETHER``-th and the last of an epoch are written to the
    shared folder; a lost executor repeats those behind the one before.
    """
    store = Store(population.sparkSession)
    interval = migration_interval or generations
    now = store.put(evaluate(population.select("island", "idx", "genes"), fitness))
    slots = store.put(_slots(now))
    for epoch in range(generations // interval if interval else 0):
        old, grown = now, now
        for g in range(interval):
            grown = next_generation(grown, fitness, seed, epoch * interval + g, crossover, mutator, slots=slots)
            if g + 1 < interval and (g + 1) % TOGETHER == 0:
                grown = store.put(grown)
                store.free(old)
                old = grown
        now = store.put(grown)
        store.free(old)
        if migration_interval:
            old, now = now, store.put(migrate(now))
            store.free(old)
    return now


def best(population: DataFrame) -> DataFrame:
    """The one row of the highest fitness over all islands."""
    top = F.struct("fitness", (-F.col("island")).alias("i"), (-F.col("idx")).alias("x"))
    return population.agg(F.max_by(F.struct("island", "idx", "genes", "fitness"), top).alias("b")).select("b.*")
