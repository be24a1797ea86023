"""A bank of records that grows: later versions of a key replace earlier ones, and a search sees what was there at its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The last row of each key by order, which tells versions of a key apart; of rows that are equal in it, one. Columns stay as they are."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.col(order) if isinstance(order, str) else order
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(*keys, "_r.*").select(*rows.columns)


def grown(bank: DataFrame, later: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """bank and later batches, which can lack columns, as one table: the last row of each key by batch, then by order."""
    out = bank.withColumn("_batch", F.lit(0))
    for i, part in enumerate(later):
        out = out.unionByName(part.withColumn("_batch", F.lit(i + 1)), allowMissingColumns=True)
    return keep_last(out, keys, F.struct("_batch", order)).drop("_batch")


def intervals(rows: DataFrame, keys: list[str], since: str) -> DataFrame:
    """rows with until, the time from which a later row of the same key takes the place of this one (null: never).

    A row counts from `since` on (null: never) up to, not including, until. Of rows of one key and time the last by all columns
    counts; the others have until = since.
    """
    others = [c for c in rows.columns if c not in keys]
    own = Window.partitionBy(*keys).orderBy(F.col(since).asc_nulls_last(), *(c for c in others if rows.schema[c].dataType.typeName() not in ("array", "map")))
    return rows.withColumn("until", F.lead(since).over(own))


def as_of(versions: DataFrame, since: str, at: Column) -> DataFrame:
    """What of `intervals` counts at a time."""
    return versions.where((F.col(since) <= at) & (F.col("until").isNull() | (F.col("until") > at)))
