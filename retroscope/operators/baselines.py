"""What a memory is held against: a linear head, states' means, random picks; weekly orders, and metrics of runs in nested means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retroscope.functions.stored import cut
from retroscope.functions.windows import correlation
from retroscope.operators import models


def head(rows: DataFrame, features: list[str], y: str, penalty: float = 1.0) -> np.ndarray:
    """Constant and weights of a ridge forecast of y, from sums of one pass; `models.linear` makes it a column.

    Rows that lack a feature or y are left out; with none all weights are 0.
    """
    n = len(features) + 1
    whole = rows.dropna(subset=[*features, y])
    r = whole.agg(F.count("*").alias("n"), *(c.alias(k) for k, c in (models._products(features, F.lit(1.0)) | models._moments(features, F.col(y))).items())).first()
    if not r["n"]:
        return np.zeros(n)
    return np.linalg.lstsq(models._matrix(r, n) + models._penalty(n, penalty), np.array([r[f"b{i}"] for i in range(n)]), rcond=None)[0]


def weekly_order(rows: DataFrame, week: str, key: str, scores: list[str], outcome: str, tops: tuple[int, ...], least: int = 3) -> DataFrame:
    """Per week and score: securities, spearman with the outcome, best<n> (mean outcome of the n highest scores, ties to the smaller
    key) and every (of all that have an outcome).

    A week has a row per score from `least` rows with an outcome on; a row without the score counts in every alone. With
    fewer than two scored rows spearman and best are null. A week's rows of one score, at most one per key, meet in one task.
    """
    known = rows.where(F.col(outcome).isNotNull())
    long = known.select(week, key, F.col(outcome).alias("_y"), F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("v")) for s in scores))).alias("x")).select(week, key, "_y", "x.score", "x.v")
    own = Window.partitionBy(week, "score")
    scored = F.col("v").isNotNull() & ~F.isnan("v")
    long = long.withColumns({"v": F.when(scored, F.col("v")), "_b": F.when(scored, F.col("_y"))})
    place = F.row_number().over(own.orderBy(F.col("v").desc_nulls_last(), key))
    among = lambda c: F.when(F.col("v").isNotNull(), F.rank().over(own.orderBy(F.col(c).asc_nulls_last())) + (F.count("*").over(Window.partitionBy(week, "score", c)) - 1) / 2)
    ranked = long.withColumns({"_p": place, "_r": among("v"), "_q": among("_b"), "_n": F.count("v").over(own)})
    best = {f"best{n}": F.when(F.max("_n") >= 2, F.avg(F.when(F.col("v").isNotNull() & (F.col("_p") <= n), F.col("_y")))) for n in tops}
    out = ranked.groupBy(week, "score").agg(F.count("*").alias("securities"), correlation("_r", "_q").alias("spearman"), *(c.alias(k) for k, c in best.items()), F.avg("_y").alias("every"))
    return out.where(F.col("securities") >= least)


def order_summary(weekly: DataFrame, tops: tuple[int, ...]) -> DataFrame:
    """Per score: weeks, the weeks' mean spearman, best<n> and every, and first<n>: whether its best<n> is the highest (ties to the
    first name)."""
    means = weekly.groupBy("score").agg(F.count("*").alias("weeks"), F.avg("spearman").alias("spearman"), *(F.avg(f"best{n}").alias(f"best{n}") for n in tops), F.avg("every").alias("every"))
    first = {f"first{n}": F.coalesce(F.row_number().over(Window.orderBy(F.col(f"best{n}").desc_nulls_last(), "score")) == 1, F.lit(False)) & F.col(f"best{n}").isNotNull() for n in tops}  # a row per score
    return means.withColumns(first)


def run_metrics(daily: DataFrame, by: list[str], value: str, order: str = "session") -> DataFrame:
    """Per run: sessions, sharpe (0 where returns don't vary), growth (log, a year), drawdown (at most 0) and win_rate.

    daily: a row per run and session, returns above -1. A run's sessions, which a calendar bounds, are one window.
    """
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    level = daily.where(F.col(value).isNotNull()).withColumn("_s", F.sum(F.log1p(value)).over(so_far))
    down = level.withColumn("_d", F.exp(F.col("_s") - F.max("_s").over(so_far)) - 1)
    deviation = F.stddev_pop(value)
    return down.groupBy(*by).agg(
        F.count("*").alias("sessions"), F.when(deviation > 1e-8, F.avg(value) / (deviation + 1e-9) * 252**0.5).otherwise(0.0).alias("sharpe"),
        (F.sum(F.log1p(value)) * 252 / F.count("*")).alias("growth"), F.min("_d").alias("drawdown"), F.avg((F.col(value) > 0).cast("double")).alias("win_rate"))


def nested_means(runs: DataFrame, arm: list[str], market: str, seed: str, measures: list[str], dispersed: str) -> DataFrame:
    """Per arm: realizations, markets, each measure as the mean over markets of the mean over a market's runs, and dispersion, the
    deviation over seeds of `dispersed`'s mean over the seed's runs (0 with one seed)."""
    markets = runs.groupBy(*arm, market).agg(F.count("*").alias("_n"), *(F.avg(m).alias(m) for m in measures))
    seeds = runs.groupBy(*arm, seed).agg(F.avg(dispersed).alias("_v")).groupBy(*arm).agg(F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("dispersion"))
    return markets.groupBy(*arm).agg(F.sum("_n").alias("realizations"), F.count("*").alias("markets"), *(F.avg(m).alias(m) for m in measures)).join(seeds, arm)


def picked(rows: DataFrame, by: list[str], score: Column, key: str, n: int) -> DataFrame:
    """The n rows of the highest score within by (ties to the smaller key); rows without a score are not picked."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_v").desc(), key))
    return rows.withColumn("_v", score).where(F.col("_v").isNotNull()).withColumn("_p", place).where(F.col("_p") <= n).drop("_v", "_p")


def random_trials(rows: DataFrame, session: str, key: str, n: int, trials: int, spare: int = 32) -> DataFrame:
    """rows that each trial (from 0) picks: in a session the n of the highest SHA-256 of trial:key:session.

    Of a session's hashes only those go on that are so high that about 4 n + spare of them are; a trial's session in which
    fewer than n are is picked again from all its rows, so spare decides the cost alone. A row per session (of bounded number) is sent to all tasks.
    """
    counts = rows.groupBy(F.col(session).alias("_session")).agg(F.count("*").alias("_all"))
    few = F.greatest(F.lit(0.0), 1 - (4 * n + spare) / F.col("_all"))
    counts = cut(counts.withColumn("_least", F.lpad(F.lower(F.hex(F.floor(few * 2**32).cast("bigint"))), 8, "0")))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")
    named = F.when(F.col(key).isNotNull() | F.col(session).isNotNull(), F.concat_ws(":", key, session)).alias("_name")  # once for all trials
    high = F.sha2(F.concat_ws(":", "trial", "_name"), 256)
    drawn = rows.join(F.broadcast(counts), F.col(session).eqNullSafe(F.col("_session"))).select(*rows.columns, "_least", named).select("*", numbers).where(high >= F.col("_least"))
    out = cut(picked(drawn, [session, "trial"], high, key, n).select(*rows.columns, "trial"))
    got = out.groupBy(F.col(session).alias("_s"), F.col("trial").alias("_t")).agg(F.count("*").alias("_n"))
    asked = counts.select("_session", F.least("_all", F.lit(n)).alias("_want"), numbers)
    missed = asked.join(F.broadcast(got), F.col("_session").eqNullSafe(F.col("_s")) & (F.col("trial") == F.col("_t")), "left").where(F.coalesce("_n", F.lit(0)) < F.col("_want")).select("_session", "_want", F.col("trial").alias("_trial"))
    if missed.isEmpty():
        return out
    again = F.col(session).eqNullSafe(F.col("_session"))
    whole = rows.join(F.broadcast(missed), again).select(*rows.columns, named, F.col("_trial").alias("trial"))
    kept = out.join(F.broadcast(missed), again & (F.col("trial") == F.col("_trial")), "left_anti")
    return kept.unionByName(picked(whole, [session, "trial"], high, key, n).drop("_name"))


def trial_summary(trials: DataFrame, reference: DataFrame) -> DataFrame:
    """The trial whose sharpe is nearest to the median (ties to the first), with sharpe_p05, sharpe_p95 and beating: the share of
    trials whose sharpe reaches the reference's (one row). A row per trial."""
    of = trials.agg(F.percentile("sharpe", 0.5).alias("_m"), F.percentile("sharpe", 0.05).alias("sharpe_p05"), F.percentile("sharpe", 0.95).alias("sharpe_p95"))
    one = reference.select(F.col("sharpe").alias("_r"))
    rows = trials.crossJoin(F.broadcast(of)).crossJoin(F.broadcast(one))
    beating = trials.crossJoin(F.broadcast(one)).agg(F.avg((F.col("sharpe") >= F.col("_r")).cast("double")).alias("beating"))
    nearest = rows.orderBy(F.abs(F.col("sharpe") - F.col("_m")), "trial").limit(1)
    return nearest.crossJoin(F.broadcast(beating)).drop("_m", "_r")


def reliability_frame(signals: DataFrame, keys: list[str], session: str, measures: list[str], expected: str, low: str, high: str, score: str, outcomes: DataFrame, realized: str, useful: float, passes: str | None = None) -> DataFrame:
    """A row per key over its seeds: seeds, the measures' means, <measure>_spread (deviation over seeds), width of the mean interval,
    breadth (share of the session's rows whose interval lies above 0, and that pass where `passes` is named and half its seeds do),
    dispersion (of the score in the session, 0 for one row), direction_correct, error, useful and covered, 0 or 1.

    Comparisons are made after rounding to nine digits, so the order of seeds decides nothing. Rows without an outcome have null in the last four.
    """
    parts = [*(F.avg(m).alias(m) for m in measures), *(F.coalesce(F.stddev_pop(m), F.lit(0.0)).alias(f"{m}_spread") for m in measures)]
    rows = signals.groupBy(*keys).agg(F.countDistinct("seed").alias("seeds"), *parts, *([F.avg(F.col(passes).cast("double")).alias("_pass")] if passes else []))
    fine = lambda c: F.round(c, 9)
    above = F.coalesce(fine(F.col(low)) > 0, F.lit(False)) & (F.col("_pass") >= 0.5 if passes else F.lit(True))
    own = Window.partitionBy(session)
    rows = rows.withColumns({"width": F.col(high) - F.col(low), "breadth": F.avg(above.cast("double")).over(own), "dispersion": F.coalesce(F.stddev_samp(score).over(own), F.lit(0.0))}).drop("_pass")
    r = F.col(realized)
    return rows.join(outcomes.select(*keys, realized), keys, "left").withColumns({
        "direction_correct": ((fine(F.col(expected)) >= 0) == (fine(r) >= 0)).cast("int"), "error": F.abs(F.col(expected) - r),
        "useful": (fine(r) > useful).cast("int"), "covered": ((fine(r) >= fine(F.col(low))) & (fine(r) <= fine(F.col(high)))).cast("int")})
