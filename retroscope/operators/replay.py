"""Analyses written as bundles of checked tables, and their replay from what was stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retroscope.operators import inference, resampling
from retroscope.sources import files

TABLES = ["series", "blocks", "draws", "contrasts"]
METRICS = ["annualized_return", "sharpe"]


def contrasts(draws: DataFrame) -> DataFrame:
    """metric, observed, low, high, positive, p, p_holm of `resampling.block_pairs`."""
    return inference.holm(resampling.spread(draws.where("draw is not null"), draws.where("draw is null").drop("draw"), METRICS, []), key="metric")


def export(series: DataFrame, path: str, block: int, draws: int, seed: str) -> None:
    """Writes series (position, a, b, n), the drawn blocks, the draws' values and the contrasts, each a checked table of the folder."""
    spark = series.sparkSession
    files.write_checked(series.select("position", "a", "b", "n"), f"{path}/series")
    kept = files.read_checked(spark, f"{path}/series")
    files.write_checked(resampling.moving_blocks(kept, block, draws, seed), f"{path}/blocks")
    files.write_checked(resampling.block_pairs(kept, files.read_checked(spark, f"{path}/blocks"), block), f"{path}/draws")
    files.write_checked(contrasts(files.read_checked(spark, f"{path}/draws")), f"{path}/contrasts")


def differences(stored: DataFrame, again: DataFrame, keys: list[str], columns: list[str], tolerance: float) -> DataFrame:
    """column, compared, lacking (rows, or values, that one side alone has), not_finite (stored), beyond (the tolerance) and largest difference.

    Keys may be null; a key with several rows on a side meets each of the other's.
    """
    one = lambda df, tag: df.select(*keys, *(F.col(c).cast("double").alias(f"{tag}{c}") for c in columns), F.lit(True).alias(f"_{tag}"))
    left, right = one(stored, "s_"), one(again, "r_")
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(right[k])
    both = left.join(right, same, "full_outer").drop(*keys)
    cells = both.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"s_{c}").alias("s"), F.col(f"r_{c}").alias("r")) for c in columns))).alias("x"), (F.col("_s_").isNull() | F.col("_r_").isNull()).alias("_alone"))
    s, r = F.col("x.s"), F.col("x.r")
    off = F.isnan(s) | (F.abs(s) == float("inf"))
    gap = F.when(s == r, 0.0).otherwise(F.abs(s - r))
    beyond = s.isNotNull() & r.isNotNull() & ((gap > tolerance) | F.isnan(gap))
    return cells.groupBy("x.column").agg(
        F.count("*").alias("compared"), F.count_if(F.col("_alone") | (s.isNull() != r.isNull())).alias("lacking"), F.count_if(F.coalesce(off, F.lit(False))).alias("not_finite"),
        F.count_if(beyond).alias("beyond"), F.max(F.when(~F.isnan(gap), gap)).alias("largest"))


def replay(spark: SparkSession, path: str, block: int, tolerance: float = 1e-10) -> DataFrame:
    """rule, evaluated, violations: a bundle of `export` worked out again from its series and its blocks.

    digests: tables that are not the ones that were written; blocks: draws whose blocks don't lie in the series or don't add up to its
    length; draws, contrasts: values that lack, are not finite or differ by more than the tolerance; identity: observed
    returns that are not the stored series' difference. A table whose digest fails is still replayed.
    """
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    rules = [("digests", len(TABLES), sum(_broken(spark, path, name) for name in TABLES))]
    series = tables["series"]
    lengths = series.groupBy("n").agg(F.count("*").alias("_n"))
    sums = tables["blocks"].groupBy("draw", "n").agg(F.sum("size").alias("_m"), F.min("start").alias("_low"), F.max(F.col("start") + F.col("size")).alias("_high"))
    whole = (F.col("_m") == F.col("_n")) & (F.col("_low") >= 0) & (F.col("_high") <= F.col("_n"))
    r = sums.join(F.broadcast(lengths), "n", "left").agg(F.count("*").alias("e"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("v")).first()
    rules.append(("blocks", r.e, r.v))
    again = resampling.block_pairs(series, tables["blocks"], block)
    for name, keys, columns, fresh in (("draws", ["draw"], METRICS, again), ("contrasts", ["metric"], ["observed", "low", "high", "positive", "p", "p_holm"], contrasts(tables["draws"]))):
        r = differences(tables[name], fresh, keys, columns, tolerance).agg(F.sum("compared").alias("e"), F.sum(F.col("lacking") + F.col("not_finite") + F.col("beyond")).alias("v")).first()
        rules.append((name, r.e or 0, r.v or 0))
    seen = tables["contrasts"].where("metric = 'annualized_return'").crossJoin(F.broadcast(series.agg((F.avg(F.col("a") - F.col("b")) * 252).alias("_d"))))
    r = seen.agg(F.count("*").alias("e"), F.count_if(~F.coalesce(F.abs(F.col("observed") - F.col("_d")) <= F.greatest(F.lit(tolerance), F.abs("_d") * 1e-9), F.lit(False))).alias("v")).first()
    rules.append(("identity", r.e, r.v))
    return spark.createDataFrame([(k, int(e), int(v)) for k, e, v in rules], "rule string, evaluated bigint, violations bigint")


def _broken(spark: SparkSession, path: str, name: str) -> bool:
    try:
        files.read_checked(spark, f"{path}/{name}")
    except ValueError:
        return True
    return False
