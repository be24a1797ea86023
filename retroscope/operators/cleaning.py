"""Cleaning and admission: canonical reports, periods, holdouts, scalers, bar validation, gates, validated joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(column: str) -> Column:
    """A number from text; null where it is none, or NaN."""
    return F.nullif(F.col(column).try_cast("double"), F.lit(float("nan")))


def canonical_reports(raw: DataFrame, aliases: dict[str, list[str]], key: list[str], order: str) -> DataFrame:
    """raw with each name of aliases as the first of its columns that holds a number, rows without a key dropped, and
    of rows with one key the last by order kept."""
    values = {name: F.coalesce(*(number(c) for c in columns)) for name, columns in aliases.items()}
    rows = raw.withColumns(values)
    for c in key:
        rows = rows.where(F.col(c).isNotNull())
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))
    return rows.withColumn("_place", last).where("_place = 1").select(*key, order, *aliases)


def surprise(reported: Column, estimate: Column, given_percent: Column) -> Column:
    """Reported against the size of the estimate; the given percentage where that is missing or the estimate 0."""
    return F.coalesce(F.try_divide(reported - estimate, F.nullif(F.abs(estimate), F.lit(0.0))), given_percent / 100)


def within(rows: DataFrame, begin: str, end: str, history: int = 0) -> DataFrame:
    """Rows of the period, both ends included, and the `history` rows of each security before its first one there."""
    inside = F.col("session").between(F.lit(begin).cast("date"), F.lit(end).cast("date"))
    if not history:
        return rows.where(inside)
    first = F.min(F.when(inside, F.col("ordinal"))).over(Window.partitionBy("security"))
    return rows.withColumn("_first", first).where((F.col("ordinal") >= F.col("_first") - history) & (F.col("session") <= F.lit(end).cast("date"))).drop("_first")


def holdout(ids: DataFrame, seed: int, share: float) -> DataFrame:
    """security, held: the first max(1, round(n * share)) of the distinct ids in a hashed order are held out."""
    by = Window.orderBy(F.sha2(F.concat_ws(":", "security", F.lit(seed)), 256))  # a row per security
    n = F.count("*").over(Window.partitionBy())
    placed = ids.select("security").distinct().withColumns({"_place": F.row_number().over(by), "_n": n})
    return placed.select("security", (F.col("_place") <= F.greatest(F.lit(1), F.round(F.col("_n") * share))).alias("held"))


def scaled(rows: DataFrame, columns: list[str], fit: Column, clip: float = 5.0, floor: float = 1e-4) -> DataFrame:
    """rows with x_z and x_std for each column: by mean and population deviation of the rows of fit (at least floor),
    clipped; and by mean and sample deviation (1 where that is below 1e-6), not clipped."""
    stats = rows.where(fit).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("p", F.stddev_pop), ("s", F.stddev_samp))))
    out = rows.crossJoin(F.broadcast(stats))  # one row
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_p_{c}"), F.lit(floor))
    std = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-6, 1.0).otherwise(F.col(f"_s_{c}"))
    out = out.withColumns({f"{c}_z": F.greatest(F.lit(-clip), F.least(F.lit(clip), z(c))) for c in columns} | {f"{c}_std": std(c) for c in columns})
    return out.drop(*(f"_{n}_{c}" for c in columns for n in "mps"))


def bar_status(raw: DataFrame) -> DataFrame:
    """raw bars with fault (the first that holds, null if none) and ordering of open, high, low and close.

    ROUNDOFF_ONLY: out of order by no more than four units in the last place; then high and low are moved by the
    least that mends them. Of rows with one security and session, equal ones are exact duplicates, others conflict.
    """
    own = Window.partitionBy("security", "session")
    prices = ["open", "high", "low", "close"]
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    missing, low = F.lit(False), F.lit(False)
    for c in prices:
        missing, low = missing | bad(c), low | (F.col(c) <= 0)
    same = F.hash(*prices, "volume")
    conflict = F.min(same).over(own) != F.max(same).over(own)
    copy = F.row_number().over(own.orderBy("row")) > 1
    fault = F.when(missing, "not_finite").when(low, "not_positive").when(bad("volume") | (F.col("volume") < 0), "volume").when(conflict, "conflict").when(copy, "duplicate")
    top, bottom = F.greatest("open", "close", "low"), F.least("open", "close", "high")
    slack = 4 * 2.0**-52 * F.greatest("open", "close", "high", "low")
    over, under = top - F.col("high"), F.col("low") - bottom
    ordering = F.when(missing | low, "OTHER_INVALID").when((over <= 0) & (under <= 0), "ALREADY_VALID").when((over <= slack) & (under <= slack), "ROUNDOFF_ONLY").otherwise("MATERIAL_DISCREPANCY")
    out = raw.withColumns({"fault": fault, "ordering": ordering})
    mend = F.col("ordering") == "ROUNDOFF_ONLY"
    return out.withColumns({"mended_high": F.when(mend, F.greatest("high", top)).otherwise(F.col("high")), "mended_low": F.when(mend, F.least("low", bottom)).otherwise(F.col("low"))})


def first_failure(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate that holds, null if none does; a gate that is null doesn't."""
    return F.coalesce(*(F.when(test, F.lit(name)) for name, test in gates))


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", one_left: bool = False) -> DataFrame:
    """left joined to right, of which each key may have one row (with one_left: left too); a repeated key fails the job."""
    alone = lambda df: df.withColumn("_n", F.count("*").over(Window.partitionBy(*on))).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("a key of the join repeats"))).otherwise(F.lit(1))).where("_ok = 1").drop("_n", "_ok")
    return (alone(left) if one_left else left).join(alone(right), on, how)


def require_disjoint(features: list[str], targets: list[str], forbidden: tuple[str, ...] = ("future_", "target_", "outcome_")) -> None:
    """Fail where a feature is a target, or is named like one."""
    shared = sorted(set(features) & set(targets))
    named = sorted(f for f in features if f.startswith(forbidden))
    if shared or named:
        raise ValueError(f"features that tell the outcome: {', '.join([*shared, *named])}")


def known_columns(wanted: list[str], there: list[str]) -> list[str]:
    """The wanted columns that there are, in their order; fails where none is."""
    found = [c for c in wanted if c in there]
    if not found:
        raise ValueError("none of the wanted columns is there")
    return found
