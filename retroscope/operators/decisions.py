"""Consensus of seeds, calibrated downsides, and scores of a session's candidates turned into allocations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retroscope.functions import frames
from retroscope.functions.orders import quantiles
from retroscope.functions.windows import percent_rank
from retroscope.operators import recursive


def _unit(x: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), F.lit(0.0))


def consensus(signals: DataFrame, vote: Column, exit_share: float = 0.35) -> DataFrame:
    """signals (seed, session, security, score): per session and security the median score, mean and spread of the seeds'
    same-date ranks, the score's spread and range, votes as a text, and a low quantile of the scores to exit by."""
    rows = signals.withColumns({"_rank": percent_rank(F.col("score"), "session", "seed"), "_vote": F.coalesce(vote, F.lit(False)).cast("int")})
    s = F.col("score")
    listed = F.array_sort(F.collect_list(F.struct("seed", "_vote")))
    return rows.groupBy("session", "security").agg(
        F.count("*").alias("seeds"), F.sum("_vote").alias("votes"), F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["seed"], x["_vote"])), ",").alias("seed_votes"), F.median(s).alias("score"),
        F.avg("_rank").alias("entry_rank"), F.stddev_pop("_rank").alias("rank_spread"), F.percentile(s, exit_share).alias("exit_raw"), F.stddev_pop(s).alias("score_spread"), (F.max(s) - F.min(s)).alias("score_range"), F.avg((s > 0).cast("double")).alias("positive_share"),
    )


def smoothed_exits(rows: DataFrame, span: int = 3) -> DataFrame:
    """rows with exit_score: the exit_raw of a security averaged with weights that fall by 1 - 2 / (span + 1) per row, from
    its first row on; and persistence, its ratio to the size of the score."""
    average = lambda x: {"exit_score": recursive.average(x["exit_raw"], span, float(x["exit_raw"][0]))}
    rows = frames.per_security(rows, average, ["exit_raw"], "exit_score double")
    return rows.withColumn("persistence", F.col("exit_score") / (F.abs("score") + 1e-6))


def downside_calibration(rows: DataFrame, share: float = 0.9, least: int = 30) -> DataFrame:
    """market, samples, correction, fallback, mean and median residual: how much larger losses were than predicted, at the
    share's quantile and at least 0; that of all markets where one has fewer than `least` rows.

    rows: market, predicted, realized (both negative for a loss).
    """
    loss = lambda c: F.greatest(F.lit(0.0), -F.coalesce(F.col(c), F.lit(0.0)))
    rows = rows.where(F.col("realized").isNotNull()).withColumn("residual", loss("realized") - loss("predicted"))
    own = quantiles(rows, "residual", ["market"], [0.5, share]).groupBy("market").agg(F.max(F.when(F.col("share") == share, F.col("value"))).alias("_own"), F.max(F.when(F.col("share") == 0.5, F.col("value"))).alias("median_residual"))
    pooled = quantiles(rows, "residual", [], [share]).select(F.col("value").alias("_all"))
    counts = rows.groupBy("market").agg(F.count("*").alias("samples"), F.avg("residual").alias("mean_residual"))
    out = counts.join(own, "market").crossJoin(F.broadcast(pooled))
    few = F.col("samples") < least
    return out.select("market", "samples", F.greatest(F.lit(0.0), F.when(few, F.col("_all")).otherwise(F.col("_own"))).alias("correction"), few.alias("fallback"), "mean_residual", "median_residual")


def opportunity_features(rows: DataFrame, ranked: dict[str, tuple[str, bool]], bounded: list[str]) -> DataFrame:
    """rows (session, security and evidence) with rank_x per session for each of ranked (a column, and whether more is
    better; else the smaller size is), bounded columns cut to 0..1, tanh ratios, and breadth and medians of the session."""
    c = F.col
    ranks = {f"rank_{n}": percent_rank(c(col) if up else -F.abs(col), "session") for n, (col, up) in ranked.items()}
    out = rows.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in ranks.items()})
    day = Window.partitionBy("session")
    ratio = lambda a, b: F.coalesce(F.tanh(F.try_divide(c(a), F.nullif(F.abs(b), F.lit(0.0)))), F.lit(0.0))
    out = out.withColumns({b: _unit(c(b)) for b in bounded} | {
        "size_share": _unit(c("effective_size") / 25), "stability": _unit(1 - c("rank_spread") / 0.20), "lcb_positive": F.coalesce((c("ci_low") > 0).cast("double"), F.lit(0.0)),
        "signal_to_noise": ratio("expected", "deviation"), "reward_risk": ratio("expected", "tail"), "balance": ratio("upside", "tail"),
    })
    return out.withColumns({"market_breadth": _unit(F.avg((c("ci_low") > 0).cast("double")).over(day)), "market_confidence": _unit(F.median("confidence").over(day)), "market_agreement": _unit(F.median("agreement").over(day)), "market_seeds": _unit(F.avg("positive_share").over(day))})


def transparent_score(f: DataFrame) -> DataFrame:
    """features with score (a fixed weighing of ranks and evidence), market_support and evidence_support."""
    c = F.col
    score = 0.25 * c("rank_lcb") + 0.20 * c("rank_expected") + 0.20 * c("rank_safety") + 0.10 * c("confidence") + 0.10 * c("agreement") + 0.10 * c("vote_share") + 0.05 * c("stability")
    mean = lambda names: _unit(sum((c(n) for n in names[1:]), c(names[0])) / len(names))
    market, evidence = ["market_breadth", "market_confidence", "market_agreement", "market_seeds"], ["confidence", "agreement", "vote_share", "stability", "size_share", "ood_pass"]
    return f.withColumns({"obvious_score": score, "market_support": mean(market), "evidence_support": mean(evidence)})


def allocations(rows: DataFrame, score: str, levels: tuple[float, ...], steps: tuple[float, ...]) -> DataFrame:
    """rows with allocation: the level after as many steps as are at most the score's same-date percent rank."""
    rank = percent_rank(F.col(score), "session")
    place = sum(((rank >= s).cast("int") for s in steps[1:]), (rank >= steps[0]).cast("int"))
    return rows.withColumn("allocation", F.coalesce(F.get(F.array(*map(F.lit, levels)), place), F.lit(0.0)))


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: list[list[float]] = []  # weight, sum, bins
    names: list = []
    for batch in batches:
        for name, mean, weight in zip(*(batch.column(c).to_pylist() for c in ("bin", "mean", "weight")), strict=True):
            names.append(name)
            blocks.append([weight, mean * weight, 1])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                weight_, sum_, bins_ = blocks.pop()
                blocks[-1] = [blocks[-1][0] + weight_, blocks[-1][1] + sum_, blocks[-1][2] + bins_]
    values = [s / w for w, s, n in blocks for _ in range(int(n))]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(values, pa.float64())], names=["bin", "value"])


def monotone_blocks(points: DataFrame) -> DataFrame:
    """bin, value: the increasing step function nearest to the means of points (bin, mean, weight), by least squares.

    Neighbouring blocks that violate the order are pooled in one pass over the bins in order. A row per bin: points are a
    table of bounded size, and one task reads it. Weights are above 0.
    """
    p = points.select(F.col("bin").cast("bigint").alias("bin"), F.col("mean").cast("double").alias("mean"), F.col("weight").cast("double").alias("weight"))
    return p.repartition(1).sortWithinPartitions("bin").mapInArrow(_pooled, "bin bigint, value double")


def daily_context(rows: DataFrame, score: str, k: int = 3) -> DataFrame:
    """One row per session: the k best securities and scores side by side, and the session's breadth, median and spread."""
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.col(score).desc(), "security"))
    ranked = rows.where(F.col(score).isNotNull()).withColumn("_p", place)
    at = lambda c, i: F.max(F.when(F.col("_p") == i, F.col(c)))
    return ranked.groupBy("session").agg(
        *(at("security", i).alias(f"security_{i}") for i in range(1, k + 1)), *(at(score, i).alias(f"score_{i}") for i in range(1, k + 1)), F.count("*").alias("candidates"), F.avg((F.col(score) > 0).cast("double")).alias("breadth"), F.median(score).alias("middle"), F.stddev_pop(score).alias("spread"),
    )


def cash_softmax(rows: DataFrame, score: str, temperature: float, cash: float = 0.0) -> DataFrame:
    """rows with share: softmax of the scores of a session and of cash, which has a score of its own; and cash_share."""
    day = Window.partitionBy("session")
    top = F.greatest(F.max(score).over(day), F.lit(cash))
    weight, rest = F.exp((F.col(score) - top) / temperature), F.exp((F.lit(cash) - top) / temperature)
    total = F.sum("_w").over(day) + F.col("_c")
    return rows.withColumns({"_w": weight, "_c": rest}).withColumns({"share": F.col("_w") / total, "cash_share": F.col("_c") / total}).drop("_w", "_c")


def event_risks(rows: DataFrame, scores: list[str], horizons: int) -> DataFrame:
    """rows with p_none, and rise_i and fall_i: chances, by softmax of class scores (none, then rises and falls per
    horizon), that a rise or a fall has come by horizon i."""
    top = F.greatest(*scores)
    out = rows.withColumns({f"_e{i}": F.exp(F.col(s) - top) for i, s in enumerate(scores)})
    total = sum((F.col(f"_e{i}") for i in range(1, len(scores))), F.col("_e0"))
    out = out.withColumn("_t", total)
    so_far = lambda first, i: sum((F.col(f"_e{first + j}") for j in range(1, i)), F.col(f"_e{first}")) / F.col("_t")
    columns = {"p_none": F.col("_e0") / F.col("_t")} | {f"rise_{i}": so_far(1, i) for i in range(1, horizons + 1)} | {f"fall_{i}": so_far(1 + horizons, i) for i in range(1, horizons + 1)}
    return out.withColumns(columns).drop("_t", *(f"_e{i}" for i in range(len(scores))))


def top_fraction(rows: DataFrame, score: str, share: float) -> DataFrame:
    """The best ceil(n * share) of each session, ties to the smaller security."""
    day = Window.partitionBy("session")
    place, n = F.row_number().over(day.orderBy(F.col(score).desc(), "security")), F.count("*").over(day)
    return rows.withColumns({"_p": place, "_n": n}).where(F.col("_p") <= F.ceil(F.col("_n") * share)).drop("_p", "_n")


def environments(daily: DataFrame, value: str, parts: int = 3) -> DataFrame:
    """daily (market, session, value) with environment: market, year, and third of the market's sessions by value."""
    third = F.ntile(parts).over(Window.partitionBy("market").orderBy(value, "session"))  # a row per market and session
    return daily.withColumn("environment", F.concat_ws("|", "market", F.year("session"), third))


def exposure(daily: DataFrame, target: float = 0.01, worst: float = 0.10, floor: float = 0.2) -> DataFrame:
    """daily (market, session, v) with exposure from what was known the session before: the target over the deviation of 20
    returns, less as the fall from the peak nears `worst`, and the share of positive returns; their product within floor..1."""
    own = Window.partitionBy("market").orderBy("session")
    frame = own.rowsBetween(-20, -1)
    deviation = F.when(F.count("v").over(frame) >= 5, F.stddev_samp("v").over(frame))
    rows = daily.withColumn("_log", F.sum(F.log1p("v")).over(own))
    rows = rows.withColumn("_down", F.exp(F.col("_log") - F.greatest(F.max("_log").over(own), F.lit(0.0))) - 1)
    calm = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(target), deviation)), F.lit(1.0))
    whole = F.coalesce(F.greatest(F.lit(0.0), 1 + F.lag("_down", 1).over(own) / worst), F.lit(1.0))
    sure = F.coalesce(F.avg((F.col("v") > 0).cast("double")).over(frame), F.lit(0.5)) + 0.5
    rows = rows.withColumns({"calm": calm, "whole": whole, "sure": sure})
    return rows.withColumn("exposure", F.greatest(F.lit(floor), F.least(F.lit(1.0), F.col("calm") * F.col("whole") * F.col("sure")))).drop("_log", "_down")


def weekly_best(rows: DataFrame, scores: list[str], outcome: str, n: int) -> DataFrame:
    """Per week and score: mean outcome of the n best securities (of each security's last row of the week), and of all."""
    week = F.to_date(F.date_trunc("week", "session"))
    last = F.row_number().over(Window.partitionBy("week", "security").orderBy(F.col("session").desc()))
    latest = rows.where(F.col(outcome).isNotNull()).withColumn("week", week).withColumn("_l", last).where("_l = 1")
    long = latest.select("week", "security", outcome, F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).alias("v")) for s in scores))).alias("x")).select("week", "security", outcome, "x.score", "x.v").where("v is not null")
    place = F.row_number().over(Window.partitionBy("week", "score").orderBy(F.col("v").desc(), "security"))
    return long.withColumn("_p", place).groupBy("week", "score").agg(F.count("*").alias("securities"), F.avg(F.when(F.col("_p") <= n, F.col(outcome))).alias("best"), F.avg(outcome).alias("every"))
