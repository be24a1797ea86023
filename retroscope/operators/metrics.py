"""Measures of forecasts, classifications, portfolios and retrievals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retroscope.functions.orders import average_rank, cumulative, quantiles
from retroscope.functions.windows import correlation


def regression(rows: DataFrame, predicted: str, actual: str, by: list[str]) -> DataFrame:
    """Per group: rows, mae, rmse, bias, r2, pearson, spearman, and the share of equal signs; correlations are null
    below three rows or where one side is constant."""
    whole = rows.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).select(*by, predicted, actual)
    whole = average_rank(average_rank(whole, predicted, by, "_p"), actual, by, "_a")
    gap = F.col(predicted) - F.col(actual)
    varied = (F.count("*") >= 3) & (F.min("_p") < F.max("_p")) & (F.min("_a") < F.max("_a"))
    return whole.groupBy(*by).agg(
        F.count("*").alias("rows"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(gap).alias("bias"),
        (1 - F.try_divide(F.sum(gap * gap), F.var_pop(actual) * F.count("*"))).alias("r2"), F.when(varied, correlation(predicted, actual)).alias("pearson"),
        F.when(varied, correlation("_p", "_a")).alias("spearman"), F.avg(((F.col(predicted) > 0) == (F.col(actual) > 0)).cast("double")).alias("same_sign"),
    )


def calibration(rows: DataFrame, probability: str, outcome: str, by: list[str], bins: int = 10) -> DataFrame:
    """by, error: mean over bins at quantiles of the probability of the gap between its mean and the outcome's."""
    edges = quantiles(rows, probability, by, [i / bins for i in range(1, bins)]).groupBy(*by).agg(F.collect_list("value").alias("_edges"))
    placed = (rows.join(F.broadcast(edges), by) if by else rows.crossJoin(F.broadcast(edges))).withColumn("_bin", F.size(F.filter("_edges", lambda e: e < F.col(probability))))
    gaps = placed.groupBy(*by, "_bin").agg(F.abs(F.avg(probability) - F.avg(outcome)).alias("_gap"))
    return gaps.groupBy(*by).agg(F.avg("_gap").alias("error"))


def reliability(rows: DataFrame, probability: str, outcome: str, value: str, by: list[str]) -> DataFrame:
    """Per group, for outcomes 0 or 1: Brier score and skill, log loss, area under the ROC curve, average precision,
    calibration error, and the mean of value in the upper and lower quarter of the probability."""
    p, y = F.col(probability), F.col(outcome).cast("double")
    rows = rows.where(p.isNotNull() & y.isNotNull())
    base = rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.avg(y).alias("rate"), F.avg((p - y) * (p - y)).alias("brier"),
        (-F.avg(y * F.ln(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))) + (1 - y) * F.ln(1 - F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))))).alias("log_loss"),
    )
    steps = cumulative(rows, probability, by, {"hits": F.col(outcome).cast("bigint")})
    totals = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(F.col(outcome).cast("bigint")).alias("_hits"))
    steps = steps.join(F.broadcast(totals), by) if by else steps.crossJoin(F.broadcast(totals))
    misses = F.col("_n") - F.col("_hits")
    lower = F.col("before") - F.col("hits_before")  # misses below
    above = F.col("_n") - F.col("before"), F.col("_hits") - F.col("hits_before")  # rows and hits from here up
    curves = steps.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("hits") * (lower + (F.col("n") - F.col("hits")) / 2)), F.max(F.col("_hits") * misses).cast("double")).alias("auc"),
        F.try_divide(F.sum(F.col("hits") * above[1] / above[0]), F.max("_hits").cast("double")).alias("average_precision"),
    )
    quarter = quantiles(rows, probability, by, [0.25, 0.75]).groupBy(*by).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    cut = rows.join(F.broadcast(quarter), by) if by else rows.crossJoin(F.broadcast(quarter))
    ends = cut.groupBy(*by).agg(F.avg(F.when(p >= F.col("_high"), F.col(value))).alias("top"), F.avg(F.when(p <= F.col("_low"), F.col(value))).alias("bottom"))
    out = base
    for part in (curves, ends, calibration(rows, probability, outcome, by).withColumnRenamed("error", "calibration_error")):
        out = out.join(part, by) if by else out.crossJoin(part)
    rate = F.col("rate") * (1 - F.col("rate"))
    return out.withColumns({"brier_skill": F.when(rate > 1e-12, 1 - F.col("brier") / rate).otherwise(0.0), "spread": F.col("top") - F.col("bottom")})


def portfolio(daily: DataFrame, trades: DataFrame, key: str) -> DataFrame:
    """daily: key, session, v. trades: key, net, held. Return, risk and trade measures per key; what has no rows is null."""
    own = Window.partitionBy(key).orderBy("session")
    grown = daily.withColumn("_log", F.sum(F.log1p("v")).over(own))
    peak = F.greatest(F.max("_log").over(own), F.lit(0.0))
    grown = grown.withColumns({"_down": F.exp(F.col("_log") - peak) - 1, "_last": F.last("_log").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    v = F.col("v")
    low = F.when(v < 0, v)
    ratio = lambda a, b: F.when(b > 1e-12, a / b * 252**0.5)
    out = grown.groupBy(key).agg(
        F.count("*").alias("days"), (F.exp(F.max("_last")) - 1).alias("total_return"), ratio(F.avg(v), F.stddev_samp(v)).alias("sharpe"), ratio(F.avg(v), F.stddev_samp(low)).alias("sortino"), F.min("_down").alias("max_drawdown"), F.avg((v > 0).cast("double")).alias("positive_days"),
    )
    annual = F.pow(1 + F.col("total_return"), 252.0 / F.greatest(F.col("days") - 1, F.lit(1))) - 1
    out = out.withColumn("annualized", annual).withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("annualized") / F.abs("max_drawdown")))
    net = F.col("net")
    losses = F.sum(F.when(net < 0, -net))
    made = trades.groupBy(key).agg(F.count("*").alias("trades"), F.avg((net > 0).cast("double")).alias("win_rate"), F.avg(net).alias("mean_trade"), F.when(losses > 0, F.coalesce(F.sum(F.when(net > 0, net)), F.lit(0.0)) / losses).alias("profit_factor"), F.avg("held").alias("mean_holding"))
    return out.join(made, key, "left")


def annual_sharpe(column: str) -> Column:
    deviation = F.stddev_samp(column)
    return F.when(deviation > 1e-12, F.avg(column) / deviation * 252**0.5)


def jackknife(daily: DataFrame, market: str) -> DataFrame:
    """excluded, retained, observations, sharpe, annualized of the pooled mean return without each market in turn.

    daily: market, session, v. Sums of a session are added up once, each market's part is taken from them.
    """
    total = daily.groupBy("session").agg(F.sum("v").alias("_s"), F.count("*").alias("_n"))
    markets = daily.select(F.col(market).alias("excluded")).distinct()  # a handful
    n = daily.agg(F.countDistinct(market).alias("_m"))
    grid = total.crossJoin(F.broadcast(markets)).join(daily.select(F.col(market).alias("excluded"), "session", "v"), ["excluded", "session"], "left")
    left = F.col("_n") - F.col("v").isNotNull().cast("int")
    pooled = grid.withColumn("_p", F.when(left > 0, (F.col("_s") - F.coalesce("v", F.lit(0.0))) / left)).where("_p is not null")
    out = pooled.groupBy("excluded").agg(F.count("*").alias("observations"), annual_sharpe("_p").alias("sharpe"), (F.avg("_p") * 252).alias("annualized"))
    return out.crossJoin(F.broadcast(n)).select("excluded", (F.col("_m") - 1).alias("retained"), "observations", "sharpe", "annualized")


def confusion(rows: DataFrame, actual: str, predicted: str, classes: list[int]) -> DataFrame:
    """class, support, found (predicted so), right, precision, recall, f1, and the counts of each prediction."""
    each = rows.groupBy(F.col(actual).alias("a")).pivot(predicted, classes).count().na.fill(0)
    hits = rows.where(F.col(actual) == F.col(predicted)).groupBy(F.col(actual).alias("class")).agg(F.count("*").alias("right"))
    base = rows.sparkSession.createDataFrame([(c,) for c in classes], "class int")
    support = rows.groupBy(F.col(actual).alias("class")).agg(F.count("*").alias("support"))
    found = rows.groupBy(F.col(predicted).alias("class")).agg(F.count("*").alias("found"))
    out = base
    for part in (support, found, hits, each.withColumnRenamed("a", "class")):
        out = out.join(part, "class", "left")
    out = out.na.fill(0)
    precision, recall = F.coalesce(F.try_divide(F.col("right"), F.col("found")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("right"), F.col("support")), F.lit(0.0))
    out = out.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1).withColumnsRenamed({str(c): f"as_{c}" for c in classes})


def risk_coverage(rows: DataFrame, score: str, outcome: str, thresholds: list[float]) -> DataFrame:
    """threshold, rows at least that sure, their share, positive rate, mean outcome, and rate of outcomes under -0.12."""
    at = rows.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    x = F.col(outcome)
    sure = F.col(score) >= F.col("threshold")
    out = rows.crossJoin(F.broadcast(at)).groupBy("threshold").agg(F.count("*").alias("_all"), F.sum(sure.cast("bigint")).alias("rows"), *(F.avg(F.when(sure, v)).alias(n) for n, v in (("positive_rate", (x > 0).cast("double")), ("mean_outcome", x), ("breach_rate", (x < -0.12).cast("double")))))
    return out.select("threshold", "rows", (F.col("rows") / F.col("_all")).alias("coverage"), "positive_rate", "mean_outcome", "breach_rate")


def trained_bins(rows: DataFrame, feature: str, outcome: str, train: Column, bins: int = 10) -> DataFrame:
    """bin, rows, means of feature and outcome of the rows that are not train, in bins at quantiles of those that are."""
    edges = quantiles(rows.where(train), feature, [], [i / bins for i in range(1, bins)]).agg(F.array_distinct(F.array_sort(F.collect_list("value"))).alias("_edges"))
    rest = rows.where(~train & F.col(feature).isNotNull()).crossJoin(F.broadcast(edges))
    rest = rest.withColumn("bin", F.size(F.filter("_edges", lambda e: e < F.col(feature))))
    return rest.groupBy("bin").agg(F.count("*").alias("rows"), F.avg(feature).alias("mean_feature"), F.avg(outcome).alias("mean_outcome"), F.avg((F.col(outcome) > 0).cast("double")).alias("positive_rate"))


def shift_score(rows: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """rows with shift: mean over columns of the distance from the median of train in its quartile ranges, at most 10 each."""
    out = rows
    for c in columns:
        q = quantiles(rows.where(train), c, [], [0.25, 0.5, 0.75]).agg(*(F.max(F.when(F.col("share") == s, F.col("value"))).alias(f"_{c}_{n}") for s, n in ((0.25, "a"), (0.5, "m"), (0.75, "b"))))
        out = out.crossJoin(F.broadcast(q))
    z = lambda c: F.least(F.lit(10.0), F.abs((F.col(c) - F.col(f"_{c}_m")) / F.greatest(F.col(f"_{c}_b") - F.col(f"_{c}_a"), F.lit(1e-9))))
    known = [F.when(F.col(c).isNotNull(), z(c)) for c in columns]
    n = sum((k.isNotNull().cast("int") for k in known[1:]), known[0].isNotNull().cast("int"))
    total = sum((F.coalesce(k, F.lit(0.0)) for k in known[1:]), F.coalesce(known[0], F.lit(0.0)))
    return out.withColumn("shift", F.when(n > 0, total / n).otherwise(10.0)).drop(*(f"_{c}_{n}" for c in columns for n in "amb"))


def retrieval_quality(neighbors: DataFrame, queries: DataFrame, pool: DataFrame, scale: DataFrame) -> DataFrame:
    """Per query, from the distance of outcomes over scale (one row, `_scale`): gain at its ranks against the best order,
    precision and recall of those within 1, reciprocal rank of the first, and the gain over the whole pool's mean."""
    q = queries.select("query_id", F.col("target").alias("_own"))
    away = F.abs(F.col("target") - F.col("_own")) / F.col("_scale")
    rows = neighbors.join(F.broadcast(q), "query_id").crossJoin(F.broadcast(scale)).withColumn("_d", away)
    own = Window.partitionBy("query_id")
    rows = rows.withColumns({"_gain": F.exp(-F.col("_d")), "_best": F.row_number().over(own.orderBy("_d", "record_id"))})
    at = lambda r: 1 / F.log2(F.col(r) + 1)
    near = F.col("_d") <= 1
    found = rows.groupBy("query_id").agg(
        F.count("*").alias("neighbors"), (F.sum(F.col("_gain") * at("rank")) / F.sum(F.col("_gain") * at("_best"))).alias("ndcg"), F.avg(near.cast("double")).alias("precision"), F.sum(near.cast("bigint")).alias("_hits"),
        F.coalesce(1 / F.min(F.when(near, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"), F.avg("_d").alias("_mean"),
    )
    shares = neighbors.groupBy("query_id", "security").agg(F.count("*").alias("_c")).withColumn("_s", F.col("_c") / F.sum("_c").over(own)).groupBy("query_id").agg(F.sum(F.col("_s") * F.col("_s")).alias("concentration"))
    every = pool.join(F.broadcast(q), "query_id").crossJoin(F.broadcast(scale)).withColumn("_d", away).groupBy("query_id").agg(F.sum(near.cast("bigint")).alias("_all"), F.avg("_d").alias("_random"))
    out = found.join(shares, "query_id").join(every, "query_id")
    return out.select("query_id", "neighbors", "ndcg", "precision", F.coalesce(F.try_divide(F.col("_hits"), F.col("_all")), F.lit(0.0)).alias("recall"), "reciprocal_rank", "concentration", (1 - F.try_divide(F.col("_mean"), F.col("_random"))).alias("improvement"))


def profile(neighbors: DataFrame, age: Column, edges: list[int], weight: str) -> DataFrame:
    """bucket, neighbors, share, weight_share, median_distance, securities by age; the left edge counts, empty buckets stay."""
    bucket = sum(((age >= e).cast("int") for e in edges[1:]), (age >= edges[0]).cast("int"))
    base = neighbors.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bucket"))
    total = neighbors.agg(F.count("*").alias("_n"), F.sum(weight).alias("_w"))
    by = neighbors.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("neighbors"), F.sum(weight).alias("_s"), F.median(F.sqrt("distance")).alias("median_distance"), F.countDistinct("security").alias("securities"))
    out = base.join(by, "bucket", "left").crossJoin(F.broadcast(total))
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("bucket", some("neighbors").alias("neighbors"), (some("neighbors") / F.col("_n")).alias("share"), (some("_s") / F.col("_w")).alias("weight_share"), "median_distance", some("securities").alias("securities"))


def survival_bands(curve: DataFrame, horizon: int) -> DataFrame:
    """Kaplan-Meier rows (duration, survival, variance) with log-log bounds, and the mean time lived up to horizon."""
    s = F.col("survival")
    inner = (s > 0) & (s < 1)
    half = F.when(inner, 1.96 * F.sqrt("variance") / (s * F.abs(F.ln(s))))
    order = Window.orderBy("duration")  # a row per duration
    until = F.least(F.coalesce(F.lead("duration", 1).over(order), F.lit(horizon)), F.lit(horizon))
    lived = F.greatest(F.lit(0), until - F.least(F.col("duration"), F.lit(horizon))) * s
    first = F.when(F.row_number().over(order) == 1, F.least(F.col("duration"), F.lit(horizon))).otherwise(0)
    rows = curve.withColumns({"low": F.when(inner, F.pow(s, F.exp(half))), "high": F.when(inner, F.pow(s, F.exp(-half))), "_area": lived + first})
    return rows.withColumn("restricted_mean", F.sum("_area").over(Window.partitionBy())).drop("_area")
