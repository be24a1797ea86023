"""Column builders for ordered windows of a security. A frame of n rows counts only when it is full."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPS = 1e-9


def by_time(key: str = "security", order: str = "session"):
    return Window.partitionBy(key).orderBy(order)


def full(aggregate, x: Column, rows: int, least: int | None = None) -> Column:
    """aggregate(x) over the last `rows` rows, null with fewer than `least` (all) values of x."""
    frame = by_time().rowsBetween(1 - rows, 0)
    return F.when(F.count(x).over(frame) >= (rows if least is None else least), aggregate(x).over(frame))


def change(x: Column, rows: int = 1) -> Column:
    """x over its value `rows` rows before, less 1; null where that is 0 or missing."""
    return F.try_divide(x, F.lag(x, rows).over(by_time())) - 1


def mean(x: Column, rows: int, least: int | None = None) -> Column:
    return full(F.avg, x, rows, least)


def deviation(x: Column, rows: int, least: int | None = None) -> Column:
    return full(F.stddev_samp, x, rows, least)


def slope(x: Column, rows: int) -> Column:
    """Least-squares slope of the last `rows` values against their number."""
    middle, weight = (rows - 1) / 2, rows * (rows * rows - 1) / 12
    terms = [F.lag(x, k).over(by_time()) * (rows - 1 - k - middle) for k in range(rows)]
    return sum(terms[1:], terms[0]) / weight


def percent_rank(x: Column, *by: str) -> Column:
    """Average rank of x within by, over the number of values: ties share the mean of their ranks."""
    own = Window.partitionBy(*by).orderBy(x)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), (F.rank().over(own) - F.count(F.when(x.isNull(), 1)).over(Window.partitionBy(*by)) + (ties - 1) / F.lit(2.0).cast("double")) / F.count(x).over(Window.partitionBy(*by)))


def rounded(digits: int, **columns: Column) -> dict[str, Column]:
    return {k: F.round(v, digits) for k, v in columns.items()}


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation of the rows that have both, as an aggregate; null where one side is constant."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
