"""Queries of weekly orders, baseline suites, metrics in nested means, and the reliability of signals over seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retroscope.functions.stored import columns, cut
from retroscope.operators import baselines, models, retrieval, states
from retroscope.plans.cleaning import SEEDS, seeds
from retroscope.plans.common import RETURNS, W, query, rank, returns, rounded_rows
from retroscope.plans.states import K, STEPS, _kmeans_sql
from retroscope.sources import panel

TOPS, NEAR, WEEK = (5, 10), 25, 20
SCORES = ["cluster", "model", "retrieval"]


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first half of the vectors, and the later ones with a score by a linear head, by their state's mean outcome and by retrieval."""
    number = lambda i: F.get("x", i)
    rows = panel.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("security"), F.col("embedding").cast("array<double>").alias("x"))
    rows = cut(rows.withColumns({"y": number(0), "f0": number(8), "f1": number(9)}).crossJoin(F.broadcast(rows.agg(F.floor((F.max("vec_id") + 1) / 2).alias("_half")))))
    before, after = rows.where("vec_id < _half"), rows.where("vec_id >= _half")
    centres = states.fit(before.select("vec_id", "x"), "vec_id", K, STEPS, 1)
    means = states.assign(before, centres).groupBy("state").agg(F.avg("y").alias("cluster"))
    scored = states.assign(after, centres).join(F.broadcast(means), "state", "left")  # a row per state
    scored = scored.withColumn("model", models.linear(baselines.head(before, ["f0", "f1"], "y"), ["f0", "f1"]))
    queries = after.select(F.col("vec_id").alias("query_id"), "security", F.col("vec_id").alias("at"), F.col("x").alias("vector"))
    memory = before.select(F.col("vec_id").alias("record_id"), "security", F.col("vec_id").alias("ordinal"), (F.col("vec_id") + 63).alias("available"), F.col("x").alias("vector"), F.col("y").alias("target"))
    near = retrieval.nearest(retrieval.candidates(queries, memory, retrieval.Rules(k=NEAR, mode="allow")), NEAR).withColumn("w", 1 / F.greatest(F.sqrt("distance"), F.lit(1e-9)))
    found = near.groupBy(F.col("query_id").alias("vec_id")).agg((F.sum(F.col("w") * F.col("target")) / F.sum("w")).alias("retrieval"))
    return before, scored.join(found, "vec_id", "left").withColumn("week", F.floor(F.col("vec_id") / WEEK))


_APART = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_ORDER = f"""WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS x, CAST(embedding[1] AS DOUBLE) AS y, CAST(embedding[9] AS DOUBLE) AS f0, CAST(embedding[10] AS DOUBLE) AS f1, (SELECT (max(vec_id) + 1) // 2 FROM embeddings) AS half FROM embeddings),
v AS MATERIALIZED (SELECT * FROM e WHERE vec_id < half), {_kmeans_sql(1)}, cm AS (SELECT state, avg(y) AS cluster FROM s1 JOIN v USING (vec_id) GROUP BY 1),
ts AS (SELECT vec_id, arg_min(k, (d, k)) AS state FROM (SELECT a.vec_id, b.k, list_sum(list_transform(list_zip(a.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e a, c1 b WHERE a.vec_id >= a.half) GROUP BY 1),
mo AS (SELECT count(*) AS n, avg(f0) AS m0, avg(f1) AS m1, avg(y) AS my, var_pop(f0) * count(*) + 1 AS a, var_pop(f1) * count(*) + 1 AS b, covar_pop(f0, f1) * count(*) AS c, covar_pop(f0, y) * count(*) AS p, covar_pop(f1, y) * count(*) AS q FROM v),
nn AS (SELECT a.vec_id, b.y, 1 / greatest(sqrt({_APART}), 1e-9) AS w FROM e a JOIN v b ON b.vec_id + 63 <= a.vec_id WHERE a.vec_id >= a.half QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_APART}, b.vec_id) <= {NEAR}),
rs AS (SELECT vec_id, sum(w * y) / sum(w) AS retrieval FROM nn GROUP BY 1),
sc AS MATERIALIZED (SELECT e.vec_id, e.vec_id // {WEEK} AS week, y, cluster, my + (p * b - q * c) / (a * b - c * c) * (f0 - m0) + (q * a - p * c) / (a * b - c * c) * (f1 - m1) AS model, retrieval FROM e, mo JOIN ts ON true LEFT JOIN cm USING (state) LEFT JOIN rs ON rs.vec_id = ts.vec_id WHERE e.vec_id = ts.vec_id),
lo AS ({" UNION ALL ".join(f"SELECT week, vec_id, y, '{s}' AS score, {s} AS v FROM sc" for s in SCORES)}),
ra AS (SELECT *, row_number() OVER (PARTITION BY week, score ORDER BY v DESC NULLS LAST, vec_id) AS p, CASE WHEN v IS NOT NULL THEN {rank('v', 'week, score')} END AS r, CASE WHEN v IS NOT NULL THEN {rank('CASE WHEN v IS NOT NULL THEN y END', 'week, score')} END AS q, count(v) OVER (PARTITION BY week, score) AS n FROM lo),
wk AS MATERIALIZED (SELECT week, score, count(*) AS securities, CASE WHEN stddev_pop(r) > 0 AND stddev_pop(q) > 0 THEN covar_pop(r, q) / (stddev_pop(r) * stddev_pop(q)) END AS spearman, {", ".join(f"CASE WHEN max(n) >= 2 THEN avg(y) FILTER (v IS NOT NULL AND p <= {n}) END AS best{n}" for n in TOPS)}, avg(y) AS every FROM ra GROUP BY 1, 2 HAVING count(*) >= 3)"""
_BEST = [f"best{n}" for n in TOPS]


@query(f"{_ORDER} SELECT CAST(week AS BIGINT) AS week, score, securities, {', '.join(f'round({c}, 6) AS {c}' for c in ['spearman', *_BEST, 'every'])} FROM wk")
def opportunity_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a linear head, states' means and retrieval order the records of a week, with Spearman and the mean outcome of the best."""
    weekly = baselines.weekly_order(_vectors(spark, sf_dir)[1], "week", "vec_id", SCORES, "y", TOPS)
    return rounded_rows(weekly, ["week", "score", "securities"], ["spearman", *_BEST, "every"])


@query(f"""{_ORDER}, me AS (SELECT score, count(*) AS weeks, {', '.join(f'avg({c}) AS {c}' for c in ['spearman', *_BEST, 'every'])} FROM wk GROUP BY 1)
SELECT score, weeks, {', '.join(f'round({c}, 6) AS {c}' for c in ['spearman', *_BEST, 'every'])}, {', '.join(f"row_number() OVER (ORDER BY best{n} DESC NULLS LAST, score) = 1 AND best{n} IS NOT NULL AS first{n}" for n in TOPS)} FROM me""")
def opportunity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = baselines.weekly_order(_vectors(spark, sf_dir)[1], "week", "vec_id", SCORES, "y", TOPS)
    return rounded_rows(baselines.order_summary(weekly, TOPS), ["score", "weeks", *(f"first{n}" for n in TOPS)], ["spearman", *_BEST, "every"])


PICKS, TRIALS = 3, 21
_RUN = ["sharpe", "growth", "drawdown", "win_rate"]


def _run_sql(source: str, by: str, out: str) -> str:
    """Tables of which `out` has the metrics of each run of source (by, session, v)."""
    return f"""{out}_l AS (SELECT *, sum(ln(1 + v)) OVER (PARTITION BY {by} ORDER BY session) AS s FROM {source}), {out}_d AS (SELECT *, exp(s - max(s) OVER (PARTITION BY {by} ORDER BY session)) - 1 AS d FROM {out}_l),
{out} AS MATERIALIZED (SELECT {by}, count(*) AS sessions, CASE WHEN stddev_pop(v) > 1e-8 THEN avg(v) / (stddev_pop(v) + 1e-9) * sqrt(252) ELSE 0 END AS sharpe, sum(ln(1 + v)) * 252 / count(*) AS growth, min(d) AS drawdown, avg(CAST(v > 0 AS INT)) AS win_rate FROM {out}_d GROUP BY {by})"""


@query(f"""{RETURNS}, fo AS (SELECT *, lead(close) OVER {W} / close - 1 AS next FROM r), t AS (SELECT * FROM fo WHERE session < DATE '1996-01-01' AND momentum IS NOT NULL AND daily_return IS NOT NULL AND next IS NOT NULL),
mo AS (SELECT avg(momentum) AS m0, avg(daily_return) AS m1, avg(next) AS my, var_pop(momentum) * count(*) + 1 AS a, var_pop(daily_return) * count(*) + 1 AS b, covar_pop(momentum, daily_return) * count(*) AS c, covar_pop(momentum, next) * count(*) AS p, covar_pop(daily_return, next) * count(*) AS q FROM t),
x AS MATERIALIZED (SELECT session, security, next, momentum, my + (p * b - q * c) / (a * b - c * c) * (momentum - m0) + (q * a - p * c) / (a * b - c * c) * (daily_return - m1) AS head FROM fo, mo WHERE session >= DATE '1996-01-01' AND momentum IS NOT NULL AND daily_return IS NOT NULL AND next IS NOT NULL),
pk AS (SELECT 'buy_and_hold' AS name, 0 AS trial, session, next FROM x UNION ALL SELECT 'momentum', 0, session, next FROM x QUALIFY row_number() OVER (PARTITION BY session ORDER BY momentum DESC, security) <= {PICKS}
  UNION ALL SELECT 'model_head', 0, session, next FROM x QUALIFY row_number() OVER (PARTITION BY session ORDER BY head DESC, security) <= {PICKS}
  UNION ALL SELECT 'random', trial, session, next FROM x, range({TRIALS}) t(trial) QUALIFY row_number() OVER (PARTITION BY session, trial ORDER BY sha256(trial || ':' || security || ':' || session) DESC, security) <= {PICKS}),
da AS (SELECT name, CAST(trial AS INT) AS trial, session, avg(next) AS v FROM pk GROUP BY 1, 2, 3), {_run_sql('da', 'name, trial', 'm')},
su AS (SELECT quantile_cont(sharpe, 0.5) AS md, quantile_cont(sharpe, 0.05) AS sharpe_p05, quantile_cont(sharpe, 0.95) AS sharpe_p95, avg(CAST(sharpe >= (SELECT sharpe FROM m WHERE name = 'momentum') AS INT)) AS beating FROM m WHERE name = 'random')
SELECT name, trial, sessions, {', '.join(f'round({c}, 6) AS {c}' for c in _RUN)}, NULL AS sharpe_p05, NULL AS sharpe_p95, NULL AS beating FROM m WHERE name <> 'random'
UNION ALL (SELECT name, trial, sessions, {', '.join(f'round({c}, 6)' for c in _RUN)}, round(sharpe_p05, 6), round(sharpe_p95, 6), round(beating, 6) FROM m, su WHERE name = 'random' ORDER BY abs(sharpe - md), trial LIMIT 1)""")
def baseline_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum, a linear head, holding everything, and the median of random trials, whose spread and odds against momentum come with it."""
    start = F.lit("1996-01-01").cast("date")
    rows = returns(spark, sf_dir, once=True).withColumn("next", F.lead("close").over(Window.partitionBy("security").orderBy("session")) / F.col("close") - 1)
    rows = columns(rows.select("session", "security", "momentum", "daily_return", "next").dropna(), "suite")
    later = rows.where(F.col("session") >= start)
    head = baselines.head(rows.where(F.col("session") < start), ["momentum", "daily_return"], "next")
    named = {"buy_and_hold": later, "momentum": baselines.picked(later, ["session"], F.col("momentum"), "security", PICKS), "model_head": baselines.picked(later, ["session"], models.linear(head, ["momentum", "daily_return"]), "security", PICKS)}
    parts = [df.select(F.lit(name).alias("name"), F.lit(0).alias("trial"), "session", "next") for name, df in named.items()]
    parts.append(baselines.random_trials(later, "session", "security", PICKS, TRIALS).select(F.lit("random").alias("name"), "trial", "session", "next"))
    daily = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("name", "trial", "session").agg(F.avg("next").alias("v"))
    runs = cut(baselines.run_metrics(daily, ["name", "trial"], "v"))
    fixed = runs.where("name <> 'random'").withColumns({c: F.lit(None).cast("double") for c in ("sharpe_p05", "sharpe_p95", "beating")})
    random = baselines.trial_summary(runs.where("name = 'random'"), runs.where("name = 'momentum'"))
    return rounded_rows(fixed.unionByName(random), ["name", "trial", "sessions"], [*_RUN, "sharpe_p05", "sharpe_p95", "beating"])


@query(f"""{RETURNS}, pi AS (SELECT DISTINCT l_returnflag AS backbone, l_linestatus AS mode, CAST(l_linenumber % 3 AS INT) AS seed, l_suppkey AS security, CAST(l_shipdate AS DATE) AS session FROM lineitem),
da AS (SELECT backbone, mode, market, seed, session, avg(daily_return) AS v, count(daily_return) AS known, count(*) AS every FROM pi JOIN r USING (security, session) GROUP BY 1, 2, 3, 4, 5),
cv AS (SELECT backbone, mode, market, seed, sum(known) / sum(every) AS coverage FROM da GROUP BY 1, 2, 3, 4), dv AS (SELECT * FROM da WHERE v IS NOT NULL), {_run_sql('dv', 'backbone, mode, market, seed', 'm0')},
m AS (SELECT * FROM m0 JOIN cv USING (backbone, mode, market, seed)), mk AS (SELECT backbone, mode, market, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in [*_RUN, 'coverage'])} FROM m GROUP BY 1, 2, 3),
sd AS (SELECT backbone, mode, coalesce(stddev_samp(v), 0) AS dispersion FROM (SELECT backbone, mode, seed, avg(growth) AS v FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT backbone, mode, CAST(sum(n) AS BIGINT) AS realizations, count(*) AS markets, {', '.join(f'round(avg({c}), 6) AS {c}' for c in [*_RUN, 'coverage'])}, round(any_value(dispersion), 6) AS dispersion FROM mk JOIN sd USING (backbone, mode) GROUP BY 1, 2""")
def arm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each backbone and mode: metrics per run, means over a market's seeds, means over markets, and how far seeds differ."""
    lines = panel.table(spark, sf_dir, "lineitem")
    picks = lines.select(F.col("l_returnflag").alias("backbone"), F.col("l_linestatus").alias("mode"), (F.col("l_linenumber") % 3).cast("int").alias("seed"), F.col("l_suppkey").alias("security"), F.to_date("l_shipdate").alias("session")).distinct()
    run = ["backbone", "mode", "market", "seed"]
    daily = picks.join(returns(spark, sf_dir), ["security", "session"]).groupBy(*run, "session").agg(F.avg("daily_return").alias("v"), F.count("daily_return").alias("known"), F.count("*").alias("every"))
    daily = cut(daily)
    coverage = daily.groupBy(*run).agg((F.sum("known") / F.sum("every")).alias("coverage"))
    runs = baselines.run_metrics(daily, run, "v").join(coverage, run)
    out = baselines.nested_means(runs, ["backbone", "mode"], "market", "seed", [*_RUN, "coverage"], "growth")
    return rounded_rows(out, ["backbone", "mode", "realizations", "markets"], [*_RUN, "coverage", "dispersion"])


_MEASURES = ["score", "confidence", "low", "high"]


@query(f"""{RETURNS}, {SEEDS.removeprefix("WITH ")}, b AS (SELECT *, score - downside * 4 AS low, score + downside * 4 AS high, security % 11 <> 3 AS passes FROM s),
k AS (SELECT session, security, count(DISTINCT seed) AS seeds, {', '.join(f'avg({c}) AS {c}' for c in _MEASURES)}, stddev_pop(score) AS score_spread, stddev_pop(confidence) AS confidence_spread, avg(CAST(passes AS INT)) AS pass FROM b GROUP BY 1, 2),
f AS (SELECT k.*, high - low AS width, avg(CAST(round(low, 9) > 0 AND pass >= 0.5 AS INT)) OVER (PARTITION BY session) AS breadth, coalesce(stddev_samp(score) OVER (PARTITION BY session), 0) AS dispersion FROM k),
j AS (SELECT f.*, future, CAST((round(score, 9) >= 0) = (round(future, 9) >= 0) AS INT) AS direction_correct, abs(score - future) AS error, CAST(round(future, 9) > 0.002 AS INT) AS useful, CAST(round(future, 9) >= round(f.low, 9) AND round(future, 9) <= round(f.high, 9) AS INT) AS covered FROM f LEFT JOIN r USING (session, security))
SELECT session, count(*) AS securities, count(future) AS known, {', '.join(f'round(avg({c}) + 3e-11, 6) AS {c}' for c in ('seeds', 'score', 'score_spread', 'confidence_spread', 'width', 'breadth', 'dispersion', 'direction_correct', 'error', 'useful', 'covered'))} FROM j GROUP BY 1""")
def signal_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's signals over their seeds: spreads, intervals above zero, and how often direction and interval were right."""
    rows = seeds(spark, sf_dir).withColumns({"low": F.col("score") - F.col("downside") * 4, "high": F.col("score") + F.col("downside") * 4, "passes": F.col("security") % 11 != 3})
    frame = baselines.reliability_frame(rows, ["session", "security"], "session", _MEASURES, "score", "low", "high", "score", returns(spark, sf_dir), "future", 0.002, "passes")
    shown = ["seeds", "score", "score_spread", "confidence_spread", "width", "breadth", "dispersion", "direction_correct", "error", "useful", "covered"]
    return frame.groupBy("session").agg(F.count("*").alias("securities"), F.count("future").alias("known"), *(F.round(F.avg(c) + 3e-11, 6).alias(c) for c in shown))
