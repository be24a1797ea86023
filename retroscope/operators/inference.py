"""Resampling of return differences by blocks, and corrections for many tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def holm(tests: DataFrame, p: str = "p", by: list[str] | None = None, key: str = "name") -> DataFrame:
    """p_holm: step-down Bonferroni, monotone and at most 1."""
    own = Window.partitionBy(*(by or []))
    order = own.orderBy(p, key)
    step = (F.count("*").over(own) - F.row_number().over(order) + 1) * F.col(p)
    rows = tests.withColumn("_s", F.least(step, F.lit(1.0)))
    return rows.withColumn("p_holm", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def benjamini_hochberg(tests: DataFrame, p: str = "p", by: list[str] | None = None, key: str = "name") -> DataFrame:
    """p_bh: p times the number of tests over its rank, made monotone from the largest down."""
    own = Window.partitionBy(*(by or []))
    order = own.orderBy(p, key)
    rows = tests.withColumn("_s", F.least(F.col(p) * F.count("*").over(own) / F.row_number().over(order), F.lit(1.0)))
    return rows.withColumn("p_bh", F.min("_s").over(order.rowsBetween(0, Window.unboundedFollowing))).drop("_s")


def weekly_statistics(returns: DataFrame, key: str) -> DataFrame:
    """Sufficient statistics of daily returns by key and week: rows, sum, sum of squares, sum of log(1 + r)."""
    week = F.to_date(F.date_trunc("week", "session"))
    r = F.col("daily_return")
    return returns.where(r.isNotNull()).groupBy(key, week.alias("week")).agg(F.count("*").alias("rows"), F.sum(r).alias("total"), F.sum(r * r).alias("squares"), F.sum(F.when(r > -1, F.log1p(r))).alias("logs"))


def block_draws(weeks: int, block: int, draws: int, spark) -> DataFrame:
    """draw, week: start weeks of blocks by a hash of draw and place, so a table of draws can be made anywhere."""
    blocks = -(-weeks // block)
    grid = spark.range(draws).withColumnRenamed("id", "draw").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    start = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", "draw", "place"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(weeks - block + 1))
    week = F.explode(F.sequence(F.lit(0), F.lit(block - 1)))
    return grid.withColumn("start", start).withColumn("k", week).where(F.col("place") * block + F.col("k") < weeks).select("draw", (F.col("start") + F.col("k")).alias("week_number"))


def block_bootstrap(weekly: DataFrame, draws: DataFrame) -> DataFrame:
    """weekly (week_number, total, rows) resampled by draws: estimate, standard error, centred 95 % interval, p.

    p is (1 + draws whose distance from the estimate is at least the estimate's from 0) / (1 + draws).
    """
    point = weekly.agg((F.sum("total") / F.sum("rows")).alias("estimate"))
    each = draws.join(weekly, "week_number").groupBy("draw").agg((F.sum("total") / F.sum("rows")).alias("value"))
    away = F.abs(F.col("value") - F.col("estimate"))
    found = each.join(F.broadcast(point)).groupBy("estimate").agg(F.count("*").alias("draws"), F.stddev_samp("value").alias("error"), F.percentile(away, 0.95).alias("half"), F.sum((away >= F.abs("estimate")).cast("int")).alias("beyond"))
    return found.select("estimate", "draws", "error", (F.col("estimate") - F.col("half")).alias("low"), (F.col("estimate") + F.col("half")).alias("high"), ((1 + F.col("beyond")) / (1 + F.col("draws"))).alias("p"))


def kaplan_meier(spells: DataFrame) -> DataFrame:
    """spells (duration, ended): at risk, events, survival and Greenwood variance at each duration with an event."""
    times = spells.groupBy("duration").agg(F.count("*").alias("leaving"), F.sum(F.col("ended").cast("int")).alias("events"))
    later = Window.orderBy(F.col("duration").desc()).rowsBetween(Window.unboundedPreceding, 0)  # a row per duration
    so_far = Window.orderBy("duration")
    rows = times.withColumn("at_risk", F.sum("leaving").over(later)).where("events > 0")
    left = F.col("at_risk") - F.col("events")
    rows = rows.withColumns({"_log": F.sum(F.when(left > 0, F.ln(left / F.col("at_risk")))).over(so_far), "_dead": F.max((left == 0).cast("int")).over(so_far), "_g": F.sum(F.try_divide(F.col("events"), F.col("at_risk") * left)).over(so_far)})
    survival = F.when(F.col("_dead") == 1, 0.0).otherwise(F.exp("_log"))
    return rows.select("duration", "at_risk", "events", survival.alias("survival"), (survival * survival * F.coalesce("_g", F.lit(0.0))).alias("variance"))


def cluster_rmst(spells: DataFrame, cluster: str, horizon: int, draws: int, seed: int) -> DataFrame:
    """One row: clusters, rmst (the mean time survived within `horizon`), and over draws of as many clusters with replacement its error and
    95 % interval. spells: duration (from 1), ended, cluster.

    Spells are counted once per cluster and duration. A draw is a weight per cluster, by a hash of draw and place, so no row
    is copied: a draw's curve comes from clusters * horizon counts at most.
    """
    last = F.least(F.col("duration"), F.lit(horizon + 1)).cast("int")
    counts = spells.groupBy(cluster, last.alias("duration")).agg(F.count("*").alias("leaving"), F.sum((F.col("ended") & (F.col("duration") <= horizon)).cast("bigint")).alias("events"))
    numbers = counts.select(cluster).distinct().withColumn("_c", (F.row_number().over(Window.orderBy(cluster)) - 1).cast("bigint"))  # a row per cluster
    counts = counts.join(F.broadcast(numbers), cluster).select("_c", "duration", "leaving", "events")
    size = numbers.agg(F.count("*").alias("_n"))
    grid = spells.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(size)).where("_n > 0").withColumn("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    pick = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "draw", "place"), 256), 1, 8), 16, 10).cast("bigint") % F.col("_n")
    weights = grid.groupBy("draw", pick.alias("_c")).agg(F.count("*").alias("w")).unionByName(numbers.select(F.lit(-1).cast("bigint").alias("draw"), "_c", F.lit(1).cast("bigint").alias("w")))
    each = weights.join(counts, "_c").groupBy("draw", "duration").agg(F.sum(F.col("w") * F.col("leaving")).alias("leaving"), F.sum(F.col("w") * F.col("events")).alias("events"))
    own = Window.partitionBy("draw")  # horizon + 1 rows
    risk = F.sum("leaving").over(own.orderBy(F.col("duration").desc()).rowsBetween(Window.unboundedPreceding, 0))
    rows = each.withColumn("_r", risk).withColumn("_h", 1 - F.col("events") / F.col("_r"))
    so_far = own.orderBy("duration").rowsBetween(Window.unboundedPreceding, 0)
    alive = F.when(F.min("_h").over(so_far) <= 0, 0.0).otherwise(F.exp(F.sum(F.when(F.col("_h") > 0, F.ln("_h"))).over(so_far)))
    width = F.coalesce(F.lead("duration").over(own.orderBy("duration")), F.lit(horizon + 1)) - F.col("duration")
    rows = rows.withColumns({"_s": alive, "_w": F.greatest(width, F.lit(0))})
    areas = rows.groupBy("draw").agg((F.min("duration") - 1 + F.sum(F.col("_s") * F.col("_w"))).alias("v"))
    drawn = F.when(F.col("draw") >= 0, F.col("v"))
    out = areas.agg(F.max(F.when(F.col("draw") < 0, F.col("v"))).alias("rmst"), F.stddev_pop(drawn).alias("error"), F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"))
    return out.crossJoin(F.broadcast(size.withColumnRenamed("_n", "clusters")))
