"""Tables of a folder, and the panel of daily bars that the analytics run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def missing(column: str) -> F.Column:
    """A number with NaN as null, text that is no number as null."""
    return F.nullif(F.col(column).try_cast("double"), F.lit(float("nan")))


def bars(spark: SparkSession, folder: str, once: bool = False) -> DataFrame:
    """security, session, ordinal, open, high, low, close, volume: one row per security and day of trade lines.

    close is the volume-weighted price from whole cents and units, so sums don't depend on their order. once: lines are dealt
    out by security at the start, so they are shuffled and on disk one time and not two.
    """
    lines = table(spark, folder, "lineitem")
    lines = lines.repartition("l_suppkey") if once else lines
    price = F.col("l_extendedprice") / F.col("l_quantity")
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    daily = lines.groupBy(F.col("l_suppkey").alias("security"), F.to_date("l_shipdate").alias("session")).agg(
        first.alias("first"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("units"),
    )
    by_time = Window.partitionBy("security").orderBy("session")
    return daily.select(
        "security",
        "session",
        (F.row_number().over(by_time) - 1).cast("bigint").alias("ordinal"),
        (F.col("first.l_extendedprice") / F.col("first.l_quantity")).alias("open"),
        "high",
        "low",
        (F.col("cents").cast("double") / 100 / F.col("units").cast("double")).alias("close"),
        F.col("units").cast("double").alias("volume"),
    )


def securities(spark: SparkSession, folder: str) -> DataFrame:
    """security, sector, market: supplier, nation and region."""
    s, n, r = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.col("s_suppkey").alias("security"), F.col("n_name").alias("sector"), F.col("r_name").alias("market"))


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """security, report_date, eps, revenue: irregular reports, from a customer's orders of a day."""
    orders = table(spark, folder, "orders")
    return orders.groupBy(F.col("o_custkey").alias("security"), F.to_date("o_orderdate").alias("report_date")).agg(
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).cast("double") / 100).alias("revenue"), F.count("*").cast("double").alias("eps")
    )
