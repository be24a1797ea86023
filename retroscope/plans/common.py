"""What all plans share: the registry, and pieces of the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retroscope.functions.windows import by_time, change
from retroscope.sources import panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


BARS = """
WITH bars AS (
  SELECT *, row_number() OVER (PARTITION BY security ORDER BY session) - 1 AS ordinal FROM (
    SELECT l_suppkey AS security, CAST(l_shipdate AS DATE) AS session,
      MAX(l_extendedprice / l_quantity) AS high, MIN(l_extendedprice / l_quantity) AS low,
      CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS close,
      CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume,
      MIN({'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'q': l_quantity, 'p': l_extendedprice}) AS f
    FROM lineitem GROUP BY 1, 2)),
groups AS (
  SELECT s_suppkey AS security, n_name AS sector, r_name AS market
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
W = "(PARTITION BY security ORDER BY session)"


def over(rows: int) -> str:
    return f"OVER (PARTITION BY security ORDER BY session ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def full(what: str, x: str, rows: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) {over(rows)} >= {rows if least is None else least} THEN {what}({x}) {over(rows)} END"


def rank(x: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY {by})"


#: Added before values are rounded that may lie half-way, where noise in the last place would decide.
BIAS = 3e-11


def steady_rows(df: DataFrame, keys: list[str], columns: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *(F.round(F.col(x) + BIAS, digits).alias(x) for x in columns))


def steady_sql(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({x} + {BIAS}, {digits}) AS {x}" for x in columns)


def rounded_rows(df: DataFrame, keys: list[str], columns: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *(F.round(x, digits).alias(x) for x in columns))


def round_sql(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({x}, {digits}) AS {x}" for x in columns)


def returns(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """Bars with sector, market, daily_return, momentum of 21 rows and the return of the next 21."""
    rows = panel.bars(spark, sf_dir, once).withColumns({"daily_return": change(F.col("close")), "momentum": change(F.col("close"), 21), "future": F.lead("close", 21).over(by_time()) / F.col("close") - 1})
    return rows.join(panel.securities(spark, sf_dir), "security")


RETURNS = f"{BARS}, r AS (SELECT b.*, sector, market, close / lag(close) OVER {W} - 1 AS daily_return, close / lag(close, 21) OVER {W} - 1 AS momentum, lead(close, 21) OVER {W} / close - 1 AS future FROM bars b JOIN groups USING (security))"
