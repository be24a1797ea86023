"""Small vectors as arrays: sums and products in expressions, and tables of numbers beside all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def apart(x: Column, y: Column) -> Column:
    """The squared distance."""
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def beside(rows: DataFrame, **tables: np.ndarray) -> DataFrame:
    """rows, each with small arrays of numbers (of bounded size: parameters of a model)."""
    kind = {1: "array<double>", 2: "array<array<double>>"}
    one = rows.sparkSession.createDataFrame([tuple(t.tolist() for t in tables.values())], ", ".join(f"{k} {kind[t.ndim]}" for k, t in tables.items()))
    return rows.crossJoin(F.broadcast(one))
