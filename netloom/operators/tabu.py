"""Tabu search from many starts (start_id, repr).

A start is one row with its current and best solution, the solutions that are tabu for some more iterations, and how
often each was visited. Starts never meet, so a row goes through many iterations in one pass: a fold over their numbers,
whose step values the neighbours and picks one. Rows are dealt to all cores before each pass and written behind it.

Moves that only rearrange items never leave the arrangements of a start's items. Where these are few, a task lists them
once with what leads from each to which others, values all of them for each start, and takes its starts through all
iterations together by these tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions.columns import fresh
from netloom.session import ship_code
from netloom.storage import Store

#: Iterations of one job.
PER_PASS = 50
#: Items of a start whose arrangements, at most 3,432 of 14, are listed; values that a task works out together.
LISTED, CELLS = 14, 1_000_000

Value = Callable[[Column], Column]


@dataclass(frozen=True)
class Neighborhood:
    """Neighbours of a solution, as an array of arrays; ``different`` gives the same set with fewer repetitions.

    ``orders`` is there if moves only rearrange items: for n items, the places that the items of each neighbour come from.
    """

    name: str
    generate: Callable[[Column], Column]
    different: Callable[[Column], Column] | None = None
    orders: Callable[[int], list[list[int]]] | None = None


def _places(x: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """The pairs (i, j) of places of an array that ``keep`` keeps, by i and then j."""
    places = F.sequence(F.lit(0), F.size(x) - 1)
    return F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: keep(i, j)), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def _same(x: Column, i: Column, j: Column) -> Column:
    return F.get(x, i).eqNullSafe(F.get(x, j))


def _swap(x: Column, pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.transform(x, lambda v, k: F.when(k == p["i"], F.get(x, p["j"])).when(k == p["j"], F.get(x, p["i"])).otherwise(v)))


def _insert(x: Column, pairs: Column) -> Column:
    n = F.size(x)

    def move(p: Column) -> Column:
        rest = F.concat(F.slice(x, F.lit(1), p["i"]), F.slice(x, p["i"] + 2, n))
        return F.concat(F.slice(rest, F.lit(1), p["j"]), F.array(F.get(x, p["i"])), F.slice(rest, p["j"] + 1, n))

    return F.transform(pairs, move)


def _or_itself(x: Column, others: Column, also: Column) -> Column:
    """``others``, and the solution itself where it is one of its neighbours."""
    return F.when(also, F.concat(others, F.array(x))).otherwise(others)


def _different_swaps(x: Column) -> Column:
    """Equal items give the solution itself, whichever they are."""
    n = F.size(x)
    pairs = _places(x, lambda i, j: (j > i) & ~_same(x, i, j))
    return _or_itself(x, _swap(x, pairs), F.size(pairs) < n * (n - 1) / 2)


def _different_inserts(x: Column) -> Column:
    """An item that goes right starts at the end of a stretch of its equals, and does not stop behind one; left likewise."""
    pairs = _places(x, lambda i, j: (i != j) & ~_same(x, i, j) & ~_same(x, i, i + F.signum(j - i).cast("int")))
    twins = F.exists(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i > 0) & _same(x, i, i - 1))
    return _or_itself(x, _insert(x, pairs), twins)


def _swap_orders(n: int) -> list[list[int]]:
    return [[j if k == i else i if k == j else k for k in range(n)] for i in range(n) for j in range(i + 1, n)]


def _insert_orders(n: int) -> list[list[int]]:
    rest = [[k for k in range(n) if k != i] for i in range(n)]
    return [[*rest[i][:j], i, *rest[i][j:]] for i in range(n) for j in range(n) if i != j]


SWAP = Neighborhood("swap", lambda x: _swap(x, _places(x, lambda i, j: j > i)), _different_swaps, _swap_orders)
INSERT = Neighborhood("insert", lambda x: _insert(x, _places(x, lambda i, j: i != j)), _different_inserts, _insert_orders)


def composite(parts: Sequence[Neighborhood]) -> Neighborhood:
    """All parts' neighbours, one part after the other."""
    orders = (lambda n: [o for p in parts for o in p.orders(n)]) if all(p.orders for p in parts) else None
    return Neighborhood("+".join(p.name for p in parts), lambda x: F.concat(*[p.generate(x) for p in parts]), lambda x: F.concat(*[(p.different or p.generate)(x) for p in parts]), orders)


def key_of(x: Column) -> Column:
    """A solution as text, for equality."""
    return F.array_join(F.transform(x, lambda v: v.cast("string")), ",")


def neighbors(solutions: DataFrame, neighborhood: Neighborhood, *given: str) -> DataFrame:
    """(start_id, pos, repr, neighborhood) of each solution's neighbours, in the order in which they are generated.

    ``given`` names columns of ``solutions`` that come along.
    """
    return solutions.select("start_id", *given, F.posexplode(neighborhood.generate(F.col("repr"))).alias("pos", "repr")).withColumn("neighborhood", F.lit(neighborhood.name))


@dataclass(frozen=True)
class Knapsack:
    """The value of the chosen items, -1 if they are too heavy; columns of arrays give each row its own items."""

    values: Sequence[float] | Column
    weights: Sequence[float] | Column
    capacity: float

    def items(self) -> tuple[Column, Column]:
        """The values and the weights as columns."""
        return tuple(of if isinstance(of, Column) else F.array(*[F.lit(float(v)) for v in of]) for of in (self.values, self.weights))

    def __call__(self, x: Column) -> Column:
        values, weights = (F.aggregate(F.zip_with(x, items, lambda taken, v: F.when(taken, v).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, v: a + v) for items in self.items())
        return F.when(weights <= self.capacity, values).otherwise(F.lit(-1.0))


def knapsack(values: Sequence[float] | Column, weights: Sequence[float] | Column, capacity: float) -> Value:
    """A :class:`Knapsack`."""
    return Knapsack(values, weights, capacity)


def rarely_visited(visits: Column, threshold: int = 3) -> Column:
    """Whether a solution was visited fewer times; one that was not is."""
    return F.coalesce(visits, F.lit(0)) < threshold


def better(value: Column, best: Column, visits: Column) -> Column:
    """Whether a tabu move is allowed all the same: better than the best."""
    return value > best


def aspired(value: Column, best: Column, visits: Column, threshold: int = 2) -> Column:
    """Whether a tabu move is allowed all the same: better than the best, or hardly visited."""
    return (value > best) | rarely_visited(visits, threshold)


def enough_iterations(done: Column, best_value: Column, best_iteration: Column) -> Column:
    """The stop rule of parallel searches: 50 iterations."""
    return done >= 50


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _visits(seen: Column, key: Column) -> Column:
    """How often the solution of a key was visited; null if never."""
    return F.get(F.filter(seen, lambda e: e["key"] == key), F.lit(0))["n"]


def search(starts: DataFrame, neighborhood: Neighborhood, value: Value, max_iterations: int = 100, tenure: int = 10, intensification: bool = False, diversification: bool = False, aspiration: Callable[[Column, Column, Column], Column] | None = better, patience: int = 20, given: Sequence[str] = (), stop: Callable[[Column, Column, Column], Column] | None = None, per_pass: int = PER_PASS) -> DataFrame:
    """(start_id, repr, value, best_iteration) of the best solution from each start.

    The next solution is the best neighbour that is not tabu or is aspired to, the first by its text of equals; it is
    tabu for ``tenure`` iterations. ``intensification`` passes over neighbours visited three times. With
    ``diversification`` a start goes on from its least visited solution after ``patience`` iterations without a new
    best. A start without an allowed neighbour stays where it is. ``given`` names columns of ``starts`` that ``value``
    reads besides a solution. ``stop`` says of iterations done, best value and best iteration when a start ends early,
    such as :func:`enough_iterations`. ``per_pass`` iterations are one job; the result does not depend on it.

    Starts of at most ``LISTED`` items without nulls go by tables if moves rearrange items, the value is a
    :class:`Knapsack` and the rules are those of this module; the others go through the fold.
    """
    known = neighborhood.orders and isinstance(value, Knapsack) and aspiration in (None, better, aspired) and stop in (None, enough_iterations)
    if known and starts.schema["repr"].dataType == T.ArrayType(T.BooleanType()):
        few, rest = _listed(Store(starts.sparkSession).put(starts.select("start_id", "repr", *given)), value)
        most = min(max_iterations, 50) if stop else max_iterations
        found = _by_tables(few, neighborhood, value, most, tenure, intensification, diversification, aspiration, patience)
        return found if rest.isEmpty() else found.union(_by_fold(rest, neighborhood, value, max_iterations, tenure, intensification, diversification, aspiration, patience, given, stop, per_pass))
    return _by_fold(starts, neighborhood, value, max_iterations, tenure, intensification, diversification, aspiration, patience, given, stop, per_pass)


def _listed(starts: DataFrame, value: Knapsack) -> tuple[DataFrame, DataFrame]:
    """The starts whose arrangements are few, and the others; items of the first have plain values and weights."""
    n = F.size("repr")
    plain = [(F.size(of) == n) & F.forall(of, lambda v: v.isNotNull() & (F.abs(v) < 1e300)) for of in value.items()]
    fits = F.coalesce(n.between(1, LISTED) & F.forall("repr", lambda x: x.isNotNull()) & plain[0] & plain[1], F.lit(False))
    return starts.where(fits), starts.where(~fits)


class Arrangements:
    """All ways to put ``ones`` chosen items to ``n`` places, by their text, and the neighbours of each."""

    def __init__(self, n: int, ones: int, orders: list[list[int]]) -> None:
        place = 1 << np.arange(n - 1, -1, -1)
        bits = (np.arange(1 << n)[:, None] & place) > 0
        self.bits = bits[bits.sum(axis=1) == ones]
        self.place, self.codes = place, self.bits @ place
        near = np.empty((len(self.codes), len(orders)), np.int64)
        for k, order in enumerate(orders):
            near[:, k] = np.searchsorted(self.codes, self.bits[:, order] @ place)
        near.sort(axis=1)
        again = np.zeros(near.shape, bool)
        again[:, 1:] = near[:, 1:] == near[:, :-1]
        count = (~again).sum(axis=1)
        #: Each neighbour once, in the order of texts; rows with fewer are filled up, and ``there`` says where they end.
        self.near = np.take_along_axis(near, np.argsort(again, axis=1, kind="stable"), axis=1)[:, : count.max(initial=0)]
        self.there = np.arange(self.near.shape[1]) < count[:, None]

    def worth(self, values: np.ndarray, weights: np.ndarray, capacity: float) -> np.ndarray:
        """The value of each arrangement for each start, summed in the order of its items."""
        value, weight = (np.zeros((len(values), len(self.codes))) for _ in range(2))
        for k in range(values.shape[1]):
            taken = self.bits[:, k]
            value[:, taken] += values[:, k : k + 1]
            weight[:, taken] += weights[:, k : k + 1]
        return np.where(weight <= capacity, value, -1.0)


def _by_tables(starts: DataFrame, neighborhood: Neighborhood, value: Knapsack, max_iterations: int, tenure: int, intensification: bool, diversification: bool, aspiration: Callable | None, patience: int) -> DataFrame:
    """:func:`search` of starts whose arrangements are few, in one pass."""
    capacity, orders, rare = value.capacity, neighborhood.orders, aspiration is aspired
    better_counts, counts = aspiration is not None, intensification or diversification or aspiration is aspired

    def follow(space: Arrangements, at: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best arrangement of each start, its value and its iteration."""
        rows = np.arange(len(at))
        best, best_value, best_at = at, worth[rows, at], np.zeros(len(at), np.int32)
        until, seen = np.zeros(worth.shape, np.int32), np.zeros(worth.shape if counts else (0, 0), np.int32)
        for i in range(1, max_iterations + 1 if space.near.shape[1] else 1):
            near = space.near[at]
            cost = np.take_along_axis(worth, near, axis=1)
            met = np.take_along_axis(seen, near, axis=1) if counts else None
            allowed = np.take_along_axis(until, near, axis=1) < i
            if better_counts:
                allowed |= cost > best_value[:, None]
            if rare:
                allowed |= met < 2
            if intensification:
                allowed &= met < 3
            allowed &= space.there[at]
            cost[~allowed] = -np.inf
            pick = cost.argmax(axis=1)
            goes = allowed[rows, pick]
            to = np.where(goes, near[rows, pick], at)
            gained = goes & (worth[rows, to] > best_value)
            best, best_at = np.where(gained, to, best), np.where(gained, np.int32(i), best_at)
            best_value = np.where(gained, worth[rows, to], best_value)
            if tenure > 0:
                until[rows[goes], to[goes]] = i + tenure
            if counts:
                seen[rows[goes], to[goes]] += 1
            at = to
            if diversification and len(stuck := np.flatnonzero(i - best_at > patience)):
                visits = np.where(seen[stuck] > 0, seen[stuck], np.iinfo(np.int32).max)
                at[stuck] = np.where(seen[stuck].any(axis=1), visits.argmin(axis=1), at[stuck])
        return best, best_value, best_at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces: dict[tuple[int, int], Arrangements] = {}
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes).tolist():
                rows = batch.take(pa.array(np.flatnonzero(sizes == n)))
                bits, values, weights = (rows.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c in (1, 2, 3))
                ones = bits.sum(axis=1)
                for k in np.unique(ones).tolist():
                    if (n, k) not in spaces:
                        spaces[n, k] = Arrangements(n, k, orders(n))
                    space = spaces[n, k]
                    mine = np.flatnonzero(ones == k)
                    step = max(1, CELLS // len(space.codes))
                    for part in (mine[f : f + step] for f in range(0, len(mine), step)):
                        at = np.searchsorted(space.codes, bits[part] @ space.place)
                        best, best_value, best_at = follow(space, at, space.worth(values[part], weights[part], capacity))
                        solutions = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(part) + 1, n), pa.int32()), pa.array(space.bits[best].ravel()))
                        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(part)), solutions, pa.array(best_value), pa.array(best_at, pa.int32())], ["start_id", "repr", "value", "best_iteration"])

    spark = starts.sparkSession
    ship_code(spark)
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    doubles = [of.cast("array<double>") for of in value.items()]
    rows = starts.select("start_id", "repr", *[c.alias(k) for c, k in zip(doubles, ("values", "weights"), strict=True)]).repartition(parts, "start_id")
    fields = [T.StructField("start_id", starts.schema["start_id"].dataType), T.StructField("repr", T.ArrayType(T.BooleanType())), T.StructField("value", T.DoubleType()), T.StructField("best_iteration", T.IntegerType())]
    return rows.mapInArrow(run, T.StructType(fields))


def _by_fold(starts: DataFrame, neighborhood: Neighborhood, value: Value, max_iterations: int, tenure: int, intensification: bool, diversification: bool, aspiration: Callable[[Column, Column, Column], Column] | None, patience: int, given: Sequence[str], stop: Callable[[Column, Column, Column], Column] | None, per_pass: int) -> DataFrame:
    """:func:`search` of any starts, by a fold over iterations."""
    spark = starts.sparkSession
    store = Store(spark)
    #: Visits are kept only where something asks for them; what a lambda says of a column tells whether it does.
    asks = intensification or diversification or (aspiration is not None and "__visits" in str(aspiration(F.col("__v"), F.col("__b"), F.col("__visits"))))

    def step(at: Column, i: Column) -> Column:
        def allowed(m: Column) -> Column:
            free = ~F.exists(at["tabu"], lambda t: t["key"] == m["key"])
            met = _visits(at["seen"], m["key"]) if asks else F.lit(None).cast("int")
            ok = free | aspiration(-m["cost"], at["best_value"], met) if aspiration else free
            return ok & rarely_visited(met) if intensification else ok

        moves = F.transform((neighborhood.different or neighborhood.generate)(at["repr"]), lambda x: F.struct((-value(x)).alias("cost"), key_of(x).alias("key"), x.alias("next")))
        new = _let(F.array_min(F.filter(moves, allowed)), lambda to: moved(at, i, to))
        return F.when(stop(i - 1, at["best_value"], at["best_iteration"]), at).otherwise(new) if stop else new

    def moved(at: Column, i: Column, to: Column) -> Column:
        goes = to.isNotNull()
        better = F.coalesce(-to["cost"] > at["best_value"], F.lit(False))
        left = F.filter(at["tabu"], lambda t: (t["until"] > i) & (~goes | (t["key"] != to["key"])))
        entry = F.array(F.struct(to["key"].alias("key"), (i + tenure).alias("until")))
        tabu = F.when(goes & F.lit(tenure > 0), F.concat(left, entry)).otherwise(left)
        again = F.coalesce(_visits(at["seen"], to["key"]), F.lit(0)) + 1
        visit = F.array(F.struct(again.alias("n"), to["key"].alias("key"), to["next"].alias("repr")))
        seen = F.when(goes, F.concat(F.filter(at["seen"], lambda e: e["key"] != to["key"]), visit)).otherwise(at["seen"]) if asks else at["seen"]
        best_at = F.when(better, i).otherwise(at["best_iteration"])
        here = F.when(goes, to["next"]).otherwise(at["repr"])
        if diversification:
            stuck = i - best_at > patience
            here = _let(F.array_min(seen), lambda least: F.when(stuck & least.isNotNull(), least["repr"]).otherwise(here))
        return F.struct(here.alias("repr"), F.when(better, to["next"]).otherwise(at["best"]).alias("best"), F.when(better, -to["cost"]).otherwise(at["best_value"]).alias("best_value"), best_at.alias("best_iteration"), tabu.alias("tabu"), seen.alias("seen"))

    no_tabu = F.slice(F.array(F.struct(F.lit("").alias("key"), F.lit(0).alias("until"))), 1, 0)
    not_seen = F.slice(F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("key"), F.col("repr").alias("repr"))), 1, 0)
    first = F.struct(F.col("repr"), F.col("repr").alias("best"), value(F.col("repr")).cast("double").alias("best_value"), F.lit(0).alias("best_iteration"), no_tabu.alias("tabu"), not_seen.alias("seen"))
    own = fresh(starts.select(*given), "start_id", "at")
    state = store.put(starts.select(F.col("start_id").alias(own[0]), first.alias(own[1]), *given))
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for done in range(0, max_iterations, per_pass):
        numbers = F.sequence(F.lit(done + 1), F.lit(min(done + per_pass, max_iterations)))
        old, state = state, store.put(state.repartition(parts, own[0]).withColumn(own[1], F.aggregate(numbers, F.col(own[1]), step)))
        store.free(old)
        if stop and state.where(~stop(F.lit(done + per_pass), F.col(own[1])["best_value"], F.col(own[1])["best_iteration"])).isEmpty():
            break
    at = F.col(own[1])
    return state.select(F.col(own[0]).alias("start_id"), at["best"].alias("repr"), at["best_value"].alias("value"), at["best_iteration"].alias("best_iteration"))


def best_of(results: DataFrame) -> DataFrame:
    """The best start's row; the first id of equals."""
    return results.agg(F.max_by(F.struct("start_id", "repr", "value"), F.struct("value", -F.col("start_id"))).alias("b")).select("b.*")
