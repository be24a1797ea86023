"""Queries of consensus, calibration, ranks of a session's candidates, allocations, and mixtures of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retroscope.functions.windows import percent_rank
from retroscope.operators import confidence, decisions
from retroscope.plans.cleaning import SEEDS, seeds
from retroscope.plans.common import BIAS, RETURNS, query, rank, returns, rounded_rows, steady_rows, steady_sql

_VOTE = "score >= 0 AND confidence >= 0.4 AND abs(downside) <= 0.05"


def _consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    vote = (F.col("score") >= 0) & (F.col("confidence") >= 0.4) & (F.abs("downside") <= 0.05)
    return decisions.consensus(seeds(spark, sf_dir).withColumn("score", F.round("score", 9)), vote)


_CONSENSUS = f"""{SEEDS.replace("WITH s AS", "WITH RECURSIVE s0 AS")}, s AS (SELECT * REPLACE (round(score, 9) AS score) FROM s0), k AS (SELECT *, {rank('score', 'session, seed')} AS rk, CAST(coalesce({_VOTE}, false) AS INT) AS vote FROM s),
cs AS (SELECT session, security, count(*) AS seeds, sum(vote) AS votes, string_agg(seed || ':' || vote, ',' ORDER BY seed) AS seed_votes, median(score) AS score, avg(rk) AS entry_rank, stddev_pop(rk) AS rank_spread, quantile_cont(score, 0.35) AS exit_raw, stddev_pop(score) AS score_spread, max(score) - min(score) AS score_range, avg(CAST(score > 0 AS INT)) AS positive_share FROM k GROUP BY 1, 2)"""
_CS = ["score", "entry_rank", "rank_spread", "exit_raw", "score_spread", "score_range", "positive_share", "exit_score", "persistence"]


@query(f"""{_CONSENSUS}, nr AS (SELECT *, row_number() OVER (PARTITION BY security ORDER BY session) AS place FROM cs),
ew AS (SELECT security, session, place, exit_raw AS e FROM nr WHERE place = 1 UNION ALL SELECT n.security, n.session, n.place, 0.5::DOUBLE * ew.e + 0.5::DOUBLE * n.exit_raw FROM ew JOIN nr n ON n.security = ew.security AND n.place = ew.place + 1)
SELECT session, security, seeds, votes, seed_votes, {steady_sql(_CS[:-2])}, round(e + {BIAS}, 6) AS exit_score, round(e / (abs(score) + 1e-6) + {BIAS}, 3) AS persistence FROM nr JOIN ew USING (security, session)""")
def consensus_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decisions.smoothed_exits(_consensus(spark, sf_dir))
    rows = rows.withColumn("persistence", F.round(F.col("persistence") + BIAS, 3))
    return steady_rows(rows, ["session", "security", "seeds", "votes", "seed_votes", "persistence"], _CS[:-1])


@query(f"""{RETURNS}, {SEEDS.removeprefix("WITH ")}, p AS (SELECT market, future AS realized, -max(downside) AS predicted FROM s JOIN r USING (security, session) WHERE future IS NOT NULL GROUP BY market, security, session, future),
d AS (SELECT market, greatest(0, -realized) - greatest(0, -predicted) AS residual FROM p), a AS (SELECT quantile_cont(residual, 0.9) AS pooled FROM d)
SELECT market, count(*) AS samples, round(greatest(0, CASE WHEN count(*) < 30 THEN any_value(pooled) ELSE quantile_cont(residual, 0.9) END), 6) AS correction, count(*) < 30 AS fallback, round(avg(residual), 6) AS mean_residual, round(median(residual), 6) AS median_residual FROM d, a GROUP BY market""")
def downside_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = seeds(spark, sf_dir).groupBy("security", "session").agg((-F.max("downside")).alias("predicted"))
    rows = losses.join(returns(spark, sf_dir), ["security", "session"]).select("market", "predicted", F.col("future").alias("realized"))
    return rounded_rows(decisions.downside_calibration(rows), ["market", "samples", "fallback"], ["correction", "mean_residual", "median_residual"])


_EVIDENCE = """, evd AS (SELECT session, security, median(score) AS expected, round(stddev_pop(score), 9) AS deviation, min(score) AS ci_low, max(score) AS upside, max(downside) AS tail, round(avg(confidence), 9) AS confidence, round(abs(2 * avg(CAST(score > 0 AS INT)) - 1), 9) AS agreement, avg(CAST(score > 0 AS INT)) AS positive_share,
  CAST(sum(neighbors) AS DOUBLE) AS effective_size, round(stddev_pop(confidence) / 4, 9) AS rank_spread, round(avg(vote), 9) AS vote_share, CAST(security % 11 <> 3 AS DOUBLE) AS ood_pass FROM k GROUP BY 1, 2)"""
_RANKED = {"expected": ("expected", True), "lcb": ("ci_low", True), "upside": ("upside", True), "safety": ("tail", False), "confidence": ("confidence", True), "agreement": ("agreement", True), "size": ("effective_size", True), "calm": ("deviation", False), "votes": ("vote_share", True)}


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, vote = F.col("score"), F.coalesce((F.col("score") >= 0) & (F.col("confidence") >= 0.4) & (F.abs("downside") <= 0.05), F.lit(False))
    rows = seeds(spark, sf_dir).withColumn("score", F.round("score", 9)).withColumn("vote", vote.cast("int"))
    positive = F.avg((s > 0).cast("double"))
    ev = rows.groupBy("session", "security").agg(
        F.median(s).alias("expected"), F.round(F.stddev_pop(s), 9).alias("deviation"), F.min(s).alias("ci_low"), F.max(s).alias("upside"), F.max("downside").alias("tail"), F.round(F.avg("confidence"), 9).alias("confidence"), F.round(F.abs(2 * positive - 1), 9).alias("agreement"), positive.alias("positive_share"),
        F.sum("neighbors").cast("double").alias("effective_size"), F.round(F.stddev_pop("confidence") / 4, 9).alias("rank_spread"), F.round(F.avg("vote"), 9).alias("vote_share"), (F.col("security") % 11 != 3).cast("double").alias("ood_pass"),
    )
    return decisions.transparent_score(decisions.opportunity_features(ev, _RANKED, ["confidence", "agreement", "vote_share"]))


_F = [*(f"rank_{n}" for n in _RANKED), "size_share", "stability", "lcb_positive", "signal_to_noise", "reward_risk", "balance", "market_breadth", "market_confidence", "market_agreement", "market_seeds", "obvious_score", "market_support", "evidence_support"]
_U = "greatest(0, least(1, {}))"
_FEATURES = f"""{_CONSENSUS}{_EVIDENCE}, ft AS (SELECT *, {", ".join(f"{rank(c if up else f'-abs({c})', 'session')} AS rank_{n}" for n, (c, up) in _RANKED.items())}, {_U.format('effective_size / 25')} AS size_share, {_U.format('1 - rank_spread / 0.2')} AS stability, CAST(ci_low > 0 AS DOUBLE) AS lcb_positive,
  coalesce(tanh(expected / nullif(abs(deviation), 0)), 0) AS signal_to_noise, coalesce(tanh(expected / nullif(abs(tail), 0)), 0) AS reward_risk, coalesce(tanh(upside / nullif(abs(tail), 0)), 0) AS balance,
  avg(CAST(ci_low > 0 AS DOUBLE)) OVER (PARTITION BY session) AS market_breadth, {_U.format('median(confidence) OVER (PARTITION BY session)')} AS market_confidence, {_U.format('median(agreement) OVER (PARTITION BY session)')} AS market_agreement, avg(positive_share) OVER (PARTITION BY session) AS market_seeds FROM evd),
sf AS (SELECT *, 0.25 * rank_lcb + 0.20 * rank_expected + 0.20 * rank_safety + 0.10 * {_U.format('confidence')} + 0.10 * agreement + 0.10 * vote_share + 0.05 * stability AS obvious_score, {_U.format('(market_breadth + market_confidence + market_agreement + market_seeds) / 4')} AS market_support,
  {_U.format(f"({_U.format('confidence')} + agreement + vote_share + stability + size_share + ood_pass) / 6")} AS evidence_support FROM ft)"""


@query(f"{_FEATURES} SELECT session, security, {steady_sql(_F)} FROM sf")
def opportunity_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steady_rows(_evidence(spark, sf_dir), ["session", "security"], _F)


_LEVELS, _STEPS = (0.0, 0.25, 0.5, 0.75, 1.0), (0.3, 0.5, 0.7, 0.9)


@query(f"""{_FEATURES}, os AS (SELECT session, security, round(obvious_score, 9) AS obvious_score, tail, expected FROM sf), ar AS (SELECT *, {rank('obvious_score', 'session')} AS rk FROM os)
SELECT session, security, ([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[])[1 + CAST(rk >= 0.3 AS INT) + CAST(rk >= 0.5 AS INT) + CAST(rk >= 0.7 AS INT) + CAST(rk >= 0.9 AS INT)] AS allocation, round(expected - 0.35 * abs(tail), 6) AS utility FROM ar""")
def allocation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decisions.allocations(_evidence(spark, sf_dir).withColumn("obvious_score", F.round("obvious_score", 9)), "obvious_score", _LEVELS, _STEPS)
    return rows.select("session", "security", "allocation", F.round(F.col("expected") - 0.35 * F.abs("tail"), 6).alias("utility"))


_ENTRY = f"{RETURNS}, e AS (SELECT session, security, market, sector, momentum, volume, future, daily_return FROM r WHERE momentum IS NOT NULL)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir).where("momentum is not null")


@query(f"""{_ENTRY}, pt AS (SELECT CAST(floor(greatest(-1, least(1, momentum)) * 10) AS INT) AS bin, avg(future) AS mean, count(*) AS weight FROM e WHERE future IS NOT NULL GROUP BY 1),
ab AS (SELECT a.bin AS a, b.bin AS b, sum(p.mean * p.weight) / sum(p.weight) AS m FROM pt a JOIN pt b ON a.bin <= b.bin JOIN pt p ON p.bin BETWEEN a.bin AND b.bin GROUP BY 1, 2), lo AS (SELECT p.bin, a, min(m) AS l FROM ab JOIN pt p ON p.bin BETWEEN a AND b GROUP BY 1, 2)
SELECT p.bin, weight, round(mean, 6) AS mean, round(max(l), 6) AS value FROM pt p JOIN lo USING (bin) GROUP BY 1, 2, 3""")
def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The increasing step function of binned momentum that is nearest to the mean outcome."""
    bin_ = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("momentum"))) * 10).cast("int")
    points = _entries(spark, sf_dir).where("future is not null").groupBy(bin_.alias("bin")).agg(F.avg("future").alias("mean"), F.count("*").alias("weight"))
    return points.join(decisions.monotone_blocks(points), "bin").select("bin", "weight", F.round("mean", 6).alias("mean"), F.round("value", 6).alias("value"))


@query(f"""{_ENTRY}, p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY momentum DESC, security) AS p FROM e)
SELECT session, {", ".join(f"max(security) FILTER (p = {i}) AS security_{i}, round(max(momentum) FILTER (p = {i}), 6) AS score_{i}" for i in (1, 2, 3))}, count(*) AS candidates, round(avg(CAST(momentum > 0 AS INT)), 6) AS breadth, round(median(momentum), 6) AS middle, round(stddev_pop(momentum), 6) AS spread FROM p GROUP BY session""")
def daily_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decisions.daily_context(_entries(spark, sf_dir), "momentum")
    return rounded_rows(rows, ["session", "candidates", "security_1", "security_2", "security_3"], ["score_1", "score_2", "score_3", "breadth", "middle", "spread"])


@query(f"""{_ENTRY}, t AS (SELECT *, greatest(max(momentum) OVER (PARTITION BY session), 0) AS top FROM e), w AS (SELECT *, exp((momentum - top) / 0.25) AS w, exp(-top / 0.25) AS c FROM t), s AS (SELECT *, sum(w) OVER (PARTITION BY session) + c AS total FROM w)
SELECT session, security, round(w / total, 6) AS share, round(c / total, 6) AS cash_share FROM s""")
def cash_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_rows(decisions.cash_softmax(_entries(spark, sf_dir), "momentum", 0.25), ["session", "security"], ["share", "cash_share"])


_CLASS = ["0.0::DOUBLE", "momentum", "momentum * 0.5", "-momentum", "-momentum * 0.5"]


@query(f"""{_ENTRY}, x AS (SELECT session, security, {", ".join(f"exp({c} - greatest({', '.join(_CLASS)})) AS e{i}" for i, c in enumerate(_CLASS))} FROM e), t AS (SELECT *, e0 + e1 + e2 + e3 + e4 AS t FROM x)
SELECT session, security, round(e0 / t, 6) AS p_none, round(e1 / t, 6) AS rise_1, round((e1 + e2) / t, 6) AS rise_2, round(e3 / t, 6) AS fall_1, round((e3 + e4) / t, 6) AS fall_2 FROM t""")
def event_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("momentum")
    rows = _entries(spark, sf_dir).withColumns({"c0": F.lit(0.0), "c1": m, "c2": m * 0.5, "c3": -m, "c4": -m * 0.5})
    return rounded_rows(decisions.event_risks(rows, [f"c{i}" for i in range(5)], 2), ["session", "security"], ["p_none", "rise_1", "rise_2", "fall_1", "fall_2"])


@query(f"{_ENTRY} SELECT session, security, round(momentum, 6) AS momentum FROM e QUALIFY row_number() OVER (PARTITION BY session ORDER BY momentum DESC, security) <= ceil(count(*) OVER (PARTITION BY session) * 0.3)")
def top_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_rows(decisions.top_fraction(_entries(spark, sf_dir), "momentum", 0.3), ["session", "security"], ["momentum"])


_CL = "greatest(-0.05, least(0.05, daily_return))"
_MD = f"{RETURNS}, md AS (SELECT market, session, round(avg({_CL}), 10) AS v FROM r WHERE daily_return IS NOT NULL GROUP BY 1, 2)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.greatest(F.lit(-0.05), F.least(F.lit(0.05), F.col("daily_return")))
    return returns(spark, sf_dir).where("daily_return is not null").groupBy("market", "session").agg(F.round(F.avg(v), 10).alias("v"))


@query(f"{_MD} SELECT market, session, concat_ws('|', market, year(session), ntile(3) OVER (PARTITION BY market ORDER BY round(v, 9), session)) AS environment FROM md")
def environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.environments(_daily(spark, sf_dir).withColumn("v", F.round("v", 9)), "v").drop("v")


_MB = "(PARTITION BY market ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query(f"""{_MD}, l AS (SELECT *, sum(ln(1 + v)) OVER (PARTITION BY market ORDER BY session) AS s FROM md), d AS (SELECT *, exp(s - greatest(max(s) OVER (PARTITION BY market ORDER BY session), 0)) - 1 AS down FROM l),
p AS (SELECT market, session, coalesce(least(1, 0.01 / nullif(CASE WHEN count(v) OVER {_MB} >= 5 THEN stddev_samp(v) OVER {_MB} END, 0)), 1) AS calm, coalesce(greatest(0, 1 + lag(down) OVER (PARTITION BY market ORDER BY session) / 0.1), 1) AS whole, coalesce(avg(CAST(v > 0 AS INT)) OVER {_MB}, 0.5) + 0.5 AS sure FROM d)
SELECT market, session, {steady_sql(['calm', 'whole', 'sure'])}, round(greatest(0.2, least(1, calm * whole * sure)) + {BIAS}, 6) AS exposure FROM p""")
def exposure_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steady_rows(decisions.exposure(_daily(spark, sf_dir)), ["market", "session"], ["calm", "whole", "sure", "exposure"])


@query(f"""{_ENTRY}, w AS (SELECT date_trunc('week', session)::DATE AS week, security, future, momentum, volume, row_number() OVER (PARTITION BY date_trunc('week', session), security ORDER BY session DESC) AS l FROM e WHERE future IS NOT NULL),
g AS (SELECT week, security, future, 'momentum' AS score, momentum AS v FROM w WHERE l = 1 UNION ALL SELECT week, security, future, 'volume', volume FROM w WHERE l = 1), p AS (SELECT *, row_number() OVER (PARTITION BY week, score ORDER BY v DESC, security) AS p FROM g)
SELECT week, score, count(*) AS securities, round(avg(future) FILTER (p <= 5), 6) AS best, round(avg(future), 6) AS every FROM p GROUP BY 1, 2""")
def weekly_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_rows(decisions.weekly_best(_entries(spark, sf_dir), ["momentum", "volume"], "future", 5), ["week", "score", "securities"], ["best", "every"])


_MIX = f"{_ENTRY}, x AS (SELECT session, security, market, momentum AS base, future, CASE WHEN count(*) OVER (PARTITION BY session, market) >= 3 THEN avg(momentum) OVER (PARTITION BY session, market) END AS memory FROM e)"
_SHARES = (0.0, 0.25, 0.5, 0.75, 1.0)
_Z = "(abs(base) - 0.3) / 0.2 * 0.5 + (abs(base - memory) - 0.2) / 0.1 * -0.8 + (abs(memory) - 0.2) / 0.1 * 0.3 + 0.1"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("session", "market")
    return _entries(spark, sf_dir).withColumns({"base": F.col("momentum"), "memory": F.when(F.count("*").over(own) >= 3, F.avg("momentum").over(own))})


@query(f"""{_MIX} SELECT session, security, round(CASE WHEN memory IS NULL THEN base ELSE 0.75 * base + 0.25 * memory END, 6) AS hybrid, round(1 / (1 + exp(-({_Z}))), 6) AS trust, round(0.6 * base + 0.4 * coalesce(memory, 0), 6) AS v1, round(base - 0.35 * abs(coalesce(memory, 0)), 6) AS v2 FROM x""")
def hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base prediction mixed with a memory's where that has one, the gate's trust in it, and two fixed combinations."""
    b, m = F.col("base"), F.col("memory")
    trust = confidence.trust_gate(b, m, (0.3, 0.2, 0.2), (0.2, 0.1, 0.1), (0.5, -0.8, 0.3), 0.1)
    rows = _mixed(spark, sf_dir).withColumns({"hybrid": confidence.hybrid(b, m, 0.25), "trust": trust, "v1": 0.6 * b + 0.4 * F.coalesce(m, F.lit(0.0)), "v2": b - 0.35 * F.abs(F.coalesce(m, F.lit(0.0)))})
    return rounded_rows(rows, ["session", "security"], ["hybrid", "trust", "v1", "v2"])


@query(f"""{_MIX}, g AS (SELECT * FROM x, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS share) WHERE memory IS NOT NULL AND future IS NOT NULL), m AS (SELECT share, market, avg(((1 - share) * base + share * memory - future) ** 2) AS e FROM g GROUP BY 1, 2), s AS (SELECT share, round(avg(e), 12) AS error FROM m GROUP BY 1)
SELECT share, round(error, 6) AS error, share = (SELECT share FROM s ORDER BY error, share LIMIT 1) AS chosen FROM s""")
def mixture_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mixed(spark, sf_dir).where("memory is not null and future is not null").withColumn("actual", F.col("future"))
    return confidence.mixture(rows, list(_SHARES), "market").withColumn("error", F.round("error", 6))
