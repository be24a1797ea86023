"""Ranks, cumulative counts and quantiles over all rows of a group, without sorting a group in one task.

Rows are first counted per value. The values of a group are cut at approximate quantiles; a window adds up within
a cut, and a small table of sums per cut gives what lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 64


def cumulative(rows: DataFrame, column: str, by: list[str], counters: dict[str, Column] | None = None) -> DataFrame:
    """by, column, n, and before: the rows of each value and of smaller ones; for each counter x its sum, and x_before.

    Null values of column are left out.
    """
    counters = {"n": F.count("*"), **{k: F.sum(v) for k, v in (counters or {}).items()}}
    name = lambda c: "before" if c == "n" else f"{c}_before"
    values = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(*(v.alias(k) for k, v in counters.items()))
    cuts = values.agg(F.percentile_approx(column, [i / CUTS for i in range(1, CUTS)], 10_000).alias("_cuts"))
    values = values.crossJoin(F.broadcast(cuts)).withColumn("_cut", F.size(F.filter("_cuts", lambda c: c < F.col(column)))).drop("_cuts")
    sums = values.groupBy(*by, "_cut").agg(*(F.sum(c).alias(f"_{c}") for c in counters))
    so_far = Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)  # CUTS rows a group
    starts = sums.select(*by, "_cut", *(F.coalesce(F.sum(f"_{c}").over(so_far), F.lit(0)).alias(f"_{c}") for c in counters))
    inside = Window.partitionBy(*by, "_cut").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    values = values.join(F.broadcast(starts) if not by else starts, [*by, "_cut"])
    return values.select(*by, column, *counters, *((F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name(c)) for c in counters))


def average_rank(rows: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """rows that have a value, with its rank from 1 within by; ties share the mean of their ranks."""
    placed = cumulative(rows, column, by).select(*by, column, (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    return rows.join(placed, [*by, column])


def quantiles(rows: DataFrame, column: str, by: list[str], shares: list[float]) -> DataFrame:
    """by, share, value: quantiles by linear interpolation between the two nearest values in order."""
    values = cumulative(rows, column, by)
    total = rows.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count("*").alias("_all"))
    asked = rows.sparkSession.createDataFrame([(s,) for s in shares], "share double")
    place = (F.col("_all") - 1) * F.col("share")
    asked = total.crossJoin(F.broadcast(asked)).withColumn("_place", place)
    low, high = F.floor("_place"), F.ceil("_place")
    holds = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
    near = (values.join(asked, by) if by else values.crossJoin(F.broadcast(asked))).where(holds(low) | holds(high))
    near = near.groupBy(*by, "share", "_place").agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    return near.select(*by, "share", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_place") - F.floor("_place"))).alias("value"))
