"""User code as functions that SQL can call: a fitness over arrays of genes and neighbourhoods as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import ArrayType, LongType, StructType

from netloom.session import ship_code


def register_fitness(spark: SparkSession, name: str, fitness: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """Name a fitness for SQL, and return it as a function of columns, such as the genetic algorithm takes.

    ``fitness`` gets the genes of many rows as a matrix, rows of one length together, and gives a number for each. Rows
    come over in Arrow batches; a null gets null.
    """

    def values(genes: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=genes.index, dtype=object)
        lengths = genes.map(lambda g: -1 if g is None else len(g))
        for n in lengths.unique():
            if n >= 0:
                at = lengths == n
                out[at] = np.asarray(fitness(np.stack(genes[at].to_list()).astype(float)), dtype=float)
        return out.where(lengths >= 0, None).astype(float)

    values.__annotations__ = {"genes": pd.Series, "return": pd.Series}
    return spark.udf.register(name, F.pandas_udf(values, "double"))


def _swap_rows(x: Sequence) -> Iterator[list]:
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            y = list(x)
            y[i], y[j] = y[j], y[i]
            yield y


class SwapNeighbors:
    """The rows of each solution's swap neighbours, for a table of (id, solution) in that order, of any types.

    The result has the types of both, so it serves solutions of any kind. A solution is a row, so a query deals the rows
    to tasks as it likes, such as by ``PARTITION BY``. A null or empty solution has no neighbours.
    """

    @staticmethod
    def analyze(solutions: AnalyzeArgument) -> AnalyzeResult:
        if not solutions.isTable or len(solutions.dataType.fields) != 2 or not isinstance(solutions.dataType.fields[1].dataType, ArrayType):
            raise ValueError("swap_neighbors takes a table of an id and an array")
        key, value = solutions.dataType.fields
        return AnalyzeResult(StructType().add(key.name, key.dataType).add("pos", LongType()).add(value.name, value.dataType))

    def eval(self, solutions: Row) -> Iterator[tuple]:
        for pos, y in enumerate(_swap_rows(solutions[1] or [])):
            yield solutions[0], pos, y


def register_neighbors(spark: SparkSession) -> None:
    """Name ``swap_neighbors(TABLE(...))`` for SQL."""
    ship_code(spark)
    spark.udtf.register("swap_neighbors", F.udtf(SwapNeighbors))
