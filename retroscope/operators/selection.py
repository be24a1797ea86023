"""Choosing a candidate for each fold by what it did in all other folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sharpe() -> Column:
    """Of the sums that `_of` gives: the mean over the sample deviation, for 252 sessions a year; 0 below three values or without spread."""
    n, total, squares = F.col("_n"), F.col("_s"), F.col("_q")
    deviation = F.sqrt(F.greatest(squares - total * total / n, F.lit(0.0)) / (n - 1))
    return F.when((n < 3) | (deviation <= 1e-12), 0.0).otherwise(total / n / deviation * 252**0.5)


def _of(values: str) -> list[Column]:
    x = F.col(values)
    return [F.count(x).alias("_n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q")]


def runs(daily: DataFrame) -> DataFrame:
    """daily (candidate, fold, session, value): per candidate and fold total_return, max_drawdown (at most 0) and sharpe."""
    own = Window.partitionBy("candidate", "fold").orderBy("session")
    rows = daily.withColumn("_l", F.sum(F.log1p("value")).over(own)).withColumn("_d", F.exp(F.col("_l") - F.greatest(F.max("_l").over(own), F.lit(0.0))) - 1)
    out = rows.groupBy("candidate", "fold").agg(F.expm1(F.sum(F.log1p("value"))).alias("total_return"), F.least(F.min("_d"), F.lit(0.0)).alias("max_drawdown"), *_of("value"))
    return out.withColumn("sharpe", _sharpe()).drop("_n", "_s", "_q")


def leave_one_fold_out(daily: DataFrame, made: DataFrame, baseline: str, weights: tuple[float, float, float, float] = (1.0, 0.5, 1.0, 0.5)) -> DataFrame:
    """One row per fold: the candidate chosen without it, its score there, and what it did in the fold itself.

    The score of a candidate over all other folds: weights of the Sharpe ratio of their mean return per session, of the least Sharpe
    ratio of one of them, of the mean return beyond that of `baseline`, less that of the worst drawdown. A
    session's mean of the other folds is its total less the fold's own; what is kept per fold, a row per
    candidate and fold, is compared as a list. The largest score wins, then the smaller name.
    """
    base = made.where(F.col("candidate") == baseline).select("fold", F.col("total_return").alias("_base"))
    made = made.join(F.broadcast(base), "fold", "left").withColumn("excess", F.col("total_return") - F.coalesce("_base", F.lit(0.0))).drop("_base")
    folds = made.select(F.col("fold").alias("heldout")).distinct()
    total = daily.groupBy("candidate", "session").agg(F.sum("value").alias("_t"), F.count("value").alias("_c"))
    own = daily.select("candidate", "session", F.col("fold").alias("heldout"), F.col("value").alias("_v"))
    rest = total.crossJoin(F.broadcast(folds)).join(own, ["candidate", "session", "heldout"], "left")
    left = F.col("_c") - F.col("_v").isNotNull().cast("int")
    pooled = rest.where(left > 0).withColumn("_m", (F.col("_t") - F.coalesce("_v", F.lit(0.0))) / left).groupBy("candidate", "heldout").agg(*_of("_m")).withColumn("pooled", _sharpe())
    every = made.groupBy("candidate").agg(F.collect_list(F.struct("fold", "sharpe", "excess", "max_drawdown")).alias("_l"))
    listed = pooled.join(every, "candidate").withColumn("_o", F.filter("_l", lambda r: r["fold"] != F.col("heldout"))).where(F.size("_o") > 0)
    of = lambda name: F.transform("_o", lambda r: r[name])
    mean = F.aggregate(of("excess"), F.lit(0.0), lambda a, b: a + b) / F.size("_o")
    score = weights[0] * F.col("pooled") + weights[1] * F.array_min(of("sharpe")) + weights[2] * mean - weights[3] * F.abs(F.array_min(of("max_drawdown")))
    place = F.row_number().over(Window.partitionBy("heldout").orderBy(F.desc("score"), "candidate"))
    best = listed.withColumn("score", score).withColumn("_p", place).where("_p = 1").select("heldout", F.col("candidate").alias("selected"), "score")
    there = made.select(F.col("fold").alias("heldout"), F.col("candidate").alias("selected"), F.col("sharpe").alias("heldout_sharpe"), F.col("total_return").alias("heldout_return"), F.col("excess").alias("heldout_excess"))
    return best.join(there, ["heldout", "selected"], "left")
