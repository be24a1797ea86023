"""Bootstraps from hashed draws: circular, stationary, clustered, stratified by year; overfitting and deflated ratios.

A draw is a hash of its number and place, so a table of draws is the same wherever it is made. Series have a row per
session or week and are sent to every task; what is shuffled is one row of sums per draw.
"""

from __future__ import annotations

from itertools import combinations
from math import e, sqrt
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def hashed(n: Column, *parts: str | Column) -> Column:
    """A whole number from 0 to n - 1 that the parts fix."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("bigint"), n)


def numbered(series: DataFrame, order: str) -> DataFrame:
    """series with position (from 0 by order) and n; a row per session or week."""
    return series.withColumns({"position": (F.row_number().over(Window.orderBy(order)) - 1).cast("bigint"), "n": F.count("*").over(Window.partitionBy())})


def _grid(spark: SparkSession, draws: int) -> DataFrame:
    return spark.range(draws).withColumnRenamed("id", "draw")


def circular_draws(n: DataFrame, block: int, draws: int) -> DataFrame:
    """draw, position: blocks of successive positions from hashed starts, past the end on to the begin, n in all.

    n: one row with n.
    """
    size = F.least(F.lit(block).cast("bigint"), F.col("n"))
    grid = _grid(n.sparkSession, draws).crossJoin(F.broadcast(n)).withColumn("_size", size)
    grid = grid.withColumn("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / F.col("_size")) - 1)))
    grid = grid.withColumn("_start", hashed(F.col("n"), F.lit(block), "draw", "place"))
    grid = grid.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_size") - 1))).where(F.col("place") * F.col("_size") + F.col("_k") < F.col("n"))
    return grid.select("draw", F.pmod(F.col("_start") + F.col("_k"), F.col("n")).alias("position"))


def stationary_draws(n: DataFrame, length: int, draws: int) -> DataFrame:
    """draw, position: n successive positions that begin anew at a hashed place with a chance of 1 over length each."""
    grid = _grid(n.sparkSession, draws).crossJoin(F.broadcast(n)).withColumn("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    anew = (F.col("place") == 0) | (hashed(F.lit(1_000_000), F.lit("r"), "draw", "place") < 1_000_000 // length)
    last = F.max(F.when(anew, F.col("place"))).over(Window.partitionBy("draw").orderBy("place"))
    grid = grid.withColumn("_last", last)
    return grid.select("draw", F.pmod(hashed(F.col("n"), F.lit("s"), "draw", "_last") + F.col("place") - F.col("_last"), F.col("n")).alias("position"))


def sharpe(x: str) -> Column:
    deviation = F.stddev_samp(x)
    return F.when(deviation <= 1e-12, 0.0).otherwise(F.avg(x) / deviation * 252**0.5)


def paired_deltas(series: DataFrame, by: list[str]) -> DataFrame:
    """annualized_return and sharpe of a less those of b, per group."""
    return series.groupBy(*by).agg(((F.avg("a") - F.avg("b")) * 252).alias("annualized_return"), (sharpe("a") - sharpe("b")).alias("sharpe"))


def spread(values: DataFrame, point: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """metric, observed, low and high (2.5 and 97.5 percentiles), positive (share above 0), and p of a centred test."""
    long = lambda df: df.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))).alias("x")).select(*by, "x.metric", "x.v")
    seen = long(point).withColumnRenamed("v", "observed")
    both = long(values).join(F.broadcast(seen), [*by, "metric"])
    far = F.abs(F.col("v") - F.col("observed")) >= F.abs("observed")
    return both.groupBy(*by, "metric").agg(
        F.first("observed").alias("observed"), F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"), F.avg((F.col("v") > 0).cast("double")).alias("positive"), ((1 + F.sum(far.cast("int"))) / (1 + F.count("*"))).alias("p")
    )


def cluster_draws(clusters: DataFrame, draws: int) -> DataFrame:
    """draw, value: the median of as many clusters as there are, each drawn by a hash. clusters: name, delta; a handful."""
    placed = numbered(clusters, "name").select("position", "delta", "n")
    grid = _grid(clusters.sparkSession, draws).crossJoin(F.broadcast(placed.select(F.col("position").alias("place"), "n")))
    picks = grid.withColumn("position", hashed(F.col("n"), F.lit("c"), "draw", "place")).select("draw", "position")
    return picks.join(F.broadcast(placed), "position").groupBy("draw").agg(F.median("delta").alias("value"))


def yearly_draws(weeks: DataFrame, block: int, draws: int) -> DataFrame:
    """draw, year, week_number: per year as many weeks as it has, in blocks that don't leave it; single weeks where a year
    has no more than a block. weeks: year, week_number (from 0 within the year)."""
    years = weeks.groupBy("year").agg(F.count("*").alias("n"))
    size = F.when(F.col("n") <= block, F.lit(1)).otherwise(F.lit(block)).cast("bigint")
    grid = _grid(weeks.sparkSession, draws).crossJoin(F.broadcast(years)).withColumn("_size", size)
    grid = grid.withColumn("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / F.col("_size")) - 1)))
    grid = grid.withColumn("_start", hashed(F.col("n") - F.col("_size") + 1, F.lit(block), "draw", "year", "place"))
    grid = grid.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_size") - 1))).where(F.col("place") * F.col("_size") + F.col("_k") < F.col("n"))
    return grid.select("draw", "year", (F.col("_start") + F.col("_k")).alias("week_number"))


def from_sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """mean, sharpe and annual log return from weekly rows, total, squares and logs."""
    n, s = F.sum("rows"), F.sum("total")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.sum("squares") / n - (s / n) * (s / n)))
    return rows.groupBy(*by).agg((s / n).alias("mean"), F.when(deviation > 1e-12, s / n / deviation * 252**0.5).otherwise(0.0).alias("sharpe"), (F.sum("logs") / n * 252).alias("log_return"))


def overfitting(series: DataFrame, strategies: list[str], blocks: int = 8) -> DataFrame:
    """splits and the share of them in which the strategy with the best Sharpe ratio of half the time blocks has, in the
    other half, a ratio that at most half of the strategies don't exceed. series: position, n and the strategies."""
    small, more = F.floor(F.col("n") / blocks), F.col("n") % blocks
    block = F.when(F.col("position") < more * (small + 1), F.floor(F.col("position") / (small + 1))).otherwise(more + F.floor((F.col("position") - more * (small + 1)) / small))
    long = series.withColumn("block", block.cast("int")).select("block", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(s).alias("v")) for i, s in enumerate(strategies)))).alias("x")).select("block", "x.i", "x.v")
    sums = long.groupBy("block", "i").agg(F.count("v").alias("c"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))  # blocks x strategies
    halves = list(combinations(range(blocks), blocks // 2))
    chosen = series.sparkSession.createDataFrame([(k, b, b in half) for k, half in enumerate(halves) for b in range(blocks)], "split int, block int, inside boolean")
    both = sums.join(F.broadcast(chosen), "block").groupBy("split", "inside", "i").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    deviation = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("c")) / (F.col("c") - 1)))
    ratio = F.round(F.when(deviation > 1e-12, F.col("s") / F.col("c") / deviation).otherwise(float("-inf")), 9)
    scores = both.withColumn("r", ratio)
    best = scores.where("inside").groupBy("split").agg(F.min_by("i", F.struct(-F.col("r"), F.col("i"))).alias("winner"))
    out = scores.where("not inside").join(best, "split")
    own = F.max(F.when(F.col("i") == F.col("winner"), F.col("r"))).over(Window.partitionBy("split"))
    ranks = out.withColumn("_own", own).groupBy("split").agg(F.avg((F.col("r") <= F.col("_own")).cast("double")).alias("rank"))
    return ranks.agg(F.count("*").alias("splits"), F.avg((F.col("rank") <= 0.5).cast("double")).alias("probability"), F.avg("rank").alias("mean_rank"))


def expected_best(trials: int) -> float:
    """The expected largest of so many standard normal values, about."""
    if trials <= 1:
        return 0.0
    gamma, normal = 0.5772156649, NormalDist()
    return (1 - gamma) * normal.inv_cdf(1 - 1 / trials) + gamma * normal.inv_cdf(1 - 1 / (trials * e))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution, by a polynomial whose error is below 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / sqrt(2 * 3.141592653589793) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def deflated_sharpe(returns: DataFrame, by: str, column: str, trials: int) -> DataFrame:
    """Per group: daily Sharpe ratio, unbiased skewness and kurtosis, and the chance that the ratio beats the best of so
    many trials without skill."""
    v = F.col(column)
    n = F.count(v).cast("double")
    moments = returns.groupBy(by).agg(n.alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.skewness(v).alias("g"), F.kurtosis(v).alias("k")).where("n > 3 and s > 1e-12")
    n = F.col("n")
    skew = F.sqrt(n * (n - 1)) / (n - 2) * F.col("g")
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6) + 3
    rows = moments.withColumns({"daily_sharpe": F.col("m") / F.col("s"), "skew": skew, "kurt": kurt})
    d = F.col("daily_sharpe")
    room = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * d + (F.col("kurt") - 1) / 4 * d * d))
    z = (d - expected_best(trials) / F.sqrt(n - 1)) * F.sqrt(n - 1) / room
    return rows.withColumn("statistic", z).withColumn("probability", normal_cdf(F.col("statistic")))


def block_sums(series: DataFrame, block: int, by: list[str]) -> DataFrame:
    """by, start, size, n, and sums over the `size` rows from start on of series (by, position, a, b, n): for whole blocks, and for the shorter one
    that fills up the length. A draw needs a row per block in place of one per session. series: numbered, a row per session."""
    own = Window.partitionBy(*by).orderBy("position")
    whole = F.least(F.lit(block).cast("bigint"), F.col("n"))
    rest = F.when(F.col("n") % whole == 0, whole).otherwise(F.col("n") % whole)
    size = F.explode(F.array_distinct(F.array(whole, rest)))
    parts = {"a": F.col("a"), "b": F.col("b"), "aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b")}
    so_far = series.select(*by, "position", "n", *(F.sum(x).over(own).alias(k) for k, x in parts.items()))
    none = so_far.where("position = 0").select(*by, F.lit(0).cast("bigint").alias("position"), "n", *(F.lit(0.0).alias(k) for k in parts))
    ends = so_far.select(*by, (F.col("position") + 1).alias("position"), "n", *parts).unionByName(none)
    starts = ends.withColumn("size", size).where(F.col("position") + F.col("size") <= F.col("n"))
    after = ends.select(*by, F.col("position").alias("_end"), *(F.col(k).alias(f"_{k}") for k in parts))
    both = starts.withColumn("_end", F.col("position") + F.col("size")).join(after, [*by, "_end"])
    return both.select(*by, F.col("position").alias("start"), "size", "n", *((F.col(f"_{k}") - F.col(k)).alias(k) for k in parts))


def moving_blocks(series: DataFrame, block: int, draws: int, seed: str) -> DataFrame:
    """draw, n, place, start, size: blocks of sessions that start anywhere where they fit, the last one of a draw cut to the length n.

    Series of one length have the same draws.
    """
    size = F.least(F.lit(block).cast("bigint"), F.col("n"))
    grid = _grid(series.sparkSession, draws).crossJoin(F.broadcast(series.select("n").distinct())).withColumn("_b", size).withColumn("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / F.col("_b")) - 1)))
    return grid.select("draw", "n", "place", hashed(F.col("n") - F.col("_b") + 1, F.lit(seed), "draw", "place").alias("start"), F.least(F.col("_b"), F.col("n") - F.col("place") * F.col("_b")).alias("size"))


def block_pairs(series: DataFrame, blocks: DataFrame, block: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, draw (null: the series itself), annualized_return and sharpe of a less those of b, for given `moving_blocks`."""
    by = list(by)
    drawn = blocks.join(F.broadcast(block_sums(series, block, by)), ["n", "start", "size"]).groupBy(*by, "draw").agg(F.sum("size").alias("m"), *(F.sum(c).alias(c) for c in ("a", "b", "aa", "bb")))  # rows per session
    parts = (("a", F.col("a")), ("b", F.col("b")), ("aa", F.col("a") * F.col("a")), ("bb", F.col("b") * F.col("b")))
    whole = series.groupBy(*by).agg(F.lit(None).cast("bigint").alias("draw"), F.count("*").alias("m"), *(F.sum(x).alias(k) for k, x in parts))
    m = F.col("m")
    deviation = lambda k: F.sqrt(F.greatest(F.col(k * 2) - F.col(k) * F.col(k) / m, F.lit(0.0)) / (m - 1))
    ratio = lambda k: F.when(deviation(k) <= 1e-12, 0.0).otherwise(F.col(k) / m / deviation(k) * 252**0.5)
    return drawn.unionByName(whole).select(*by, "draw", ((F.col("a") - F.col("b")) / m * 252).alias("annualized_return"), (ratio("a") - ratio("b")).alias("sharpe"))


def moving_block_pairs(series: DataFrame, block: int, draws: int, seed: str, by: tuple[str, ...] = ()) -> DataFrame:
    """`block_pairs` for drawn `moving_blocks`."""
    return block_pairs(series, moving_blocks(series, block, draws, seed), block, by)
