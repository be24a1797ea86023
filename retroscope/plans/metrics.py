"""Queries that measure forecasts, classifications, portfolios and retrievals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retroscope.operators import features, inference, metrics, ranking, retrieval
from retroscope.plans.common import BARS, RETURNS, W, query, rank, returns, round_sql, rounded_rows
from retroscope.plans.neighbors import FOUND, GREEDY, RULES, constrained, memory
from retroscope.sources import panel

_WHOLE = f"{RETURNS}, x AS (SELECT * FROM r WHERE momentum IS NOT NULL AND future IS NOT NULL)"


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir).where("momentum is not null and future is not null")


REGRESSION = ["mae", "rmse", "bias", "r2", "pearson", "spearman", "same_sign"]


@query(f"""{_WHOLE}, y AS (SELECT *, {rank('momentum', 'market')} AS p, {rank('future', 'market')} AS a FROM x)
SELECT market, count(*) AS rows, round(avg(abs(momentum - future)), 6) AS mae, round(sqrt(avg((momentum - future) ** 2)), 6) AS rmse, round(avg(momentum - future), 6) AS bias, round(1 - sum((momentum - future) ** 2) / (var_pop(future) * count(*)), 6) AS r2,
  round(corr(momentum, future), 6) AS pearson, round(corr(p, a), 6) AS spearman, round(avg(CAST((momentum > 0) = (future > 0) AS INT)), 6) AS same_sign FROM y GROUP BY market""")
def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_rows(metrics.regression(_whole(spark, sf_dir), "momentum", "future", ["market"]), ["market", "rows"], REGRESSION)


RELIABILITY = ["rate", "brier", "brier_skill", "log_loss", "auc", "average_precision", "calibration_error", "top", "bottom", "spread"]


@query(f"""{_WHOLE}, y AS (SELECT market, future, CAST(future > 0 AS INT) AS y, 0.5 + momentum / (2 * (1 + abs(momentum))) AS p FROM x),
b AS (SELECT market, count(*) AS rows, avg(y) AS rate, avg((p - y) ** 2) AS brier, -avg(y * ln(greatest(1e-6, least(1 - 1e-6, p))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, p)))) AS log_loss, quantile_cont(p, 0.25) AS lo, quantile_cont(p, 0.75) AS hi,
  quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM y GROUP BY market),
k AS (SELECT *, {rank('p', 'market')} * count(*) OVER (PARTITION BY market) AS rk, count(*) OVER (PARTITION BY market ORDER BY p DESC) AS above, sum(y) OVER (PARTITION BY market ORDER BY p DESC) AS hits FROM y),
c AS (SELECT market, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc, sum(y * hits / above) / sum(y) AS average_precision FROM k GROUP BY market),
e AS (SELECT market, avg(future) FILTER (p >= hi) AS top, avg(future) FILTER (p <= lo) AS bottom FROM y JOIN b USING (market) GROUP BY market),
g AS (SELECT market, avg(gap) AS calibration_error FROM (SELECT market, len(list_filter(edges, lambda v: v < p)) AS bin, abs(avg(p) - avg(y)) AS gap FROM y JOIN b USING (market) GROUP BY 1, 2) GROUP BY market),
z AS (SELECT *, 1 - brier / (rate * (1 - rate)) AS brier_skill, top - bottom AS spread FROM b JOIN c USING (market) JOIN e USING (market) JOIN g USING (market))
SELECT market, rows, {round_sql(RELIABILITY)} FROM z""")
def reliability_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _whole(spark, sf_dir).select("market", "future", (F.col("future") > 0).cast("int").alias("y"), (0.5 + F.col("momentum") / (2 * (1 + F.abs("momentum")))).alias("p"))
    return rounded_rows(metrics.reliability(rows, "p", "y", "future", ["market"]), ["market", "rows"], RELIABILITY)


_TRADES = f"""u AS (SELECT b.*, market, CAST(close > lag(close) OVER {W} AS INT) AS up FROM bars b JOIN groups USING (security)), m AS (SELECT *, CASE WHEN up = lag(up) OVER {W} THEN 0 ELSE 1 END AS n FROM u WHERE up IS NOT NULL),
q AS (SELECT *, sum(n) OVER {W} AS run FROM m), trades AS (SELECT market, arg_max(close, session) / arg_min(close, session) - 1 AS net, count(*) AS held FROM q GROUP BY market, security, run HAVING count(*) > 1)"""
PORTFOLIO = ["total_return", "annualized", "sharpe", "sortino", "max_drawdown", "calmar", "positive_days", "win_rate", "mean_trade", "profit_factor", "mean_holding"]


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.greatest(F.lit(-0.05), F.least(F.lit(0.05), F.col("daily_return"))) / 10
    return returns(spark, sf_dir).where("daily_return is not null").groupBy("market", "session").agg(F.round(F.avg(r), 10).alias("v"))


_DAILY = "daily AS (SELECT market, session, round(avg(greatest(-0.05, least(0.05, daily_return)) / 10), 10) AS v FROM r WHERE daily_return IS NOT NULL GROUP BY 1, 2)"


@query(f"""{RETURNS}, {_DAILY}, {_TRADES},
l AS (SELECT *, sum(ln(1 + v)) OVER (PARTITION BY market ORDER BY session) AS s FROM daily), d AS (SELECT *, exp(s - greatest(max(s) OVER (PARTITION BY market ORDER BY session), 0)) - 1 AS down FROM l),
e AS (SELECT market, count(*) AS days, exp(sum(ln(1 + v))) - 1 AS total_return, avg(v) / stddev_samp(v) * sqrt(252) AS sharpe, avg(v) / stddev_samp(v) FILTER (v < 0) * sqrt(252) AS sortino, min(down) AS max_drawdown, avg(CAST(v > 0 AS INT)) AS positive_days FROM d GROUP BY market),
t AS (SELECT market, count(*) AS trades, avg(CAST(net > 0 AS INT)) AS win_rate, avg(net) AS mean_trade, sum(net) FILTER (net > 0) / -sum(net) FILTER (net < 0) AS profit_factor, avg(held) AS mean_holding FROM trades GROUP BY market),
f AS (SELECT *, (1 + total_return) ** (252.0 / (days - 1)) - 1 AS annualized FROM e LEFT JOIN t USING (market)), g AS (SELECT *, annualized / abs(max_drawdown) AS calmar FROM f) SELECT market, days, trades, {round_sql(PORTFOLIO, 5)} FROM g""")
def portfolio_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = panel.bars(spark, sf_dir)
    runs = features.islands(bars).where("rows > 1")
    ends = runs.join(bars.select("security", F.col("session").alias("first"), F.col("close").alias("_a")), ["security", "first"]).join(bars.select("security", F.col("session").alias("last"), F.col("close").alias("_b")), ["security", "last"])
    trades = ends.join(panel.securities(spark, sf_dir), "security").select("market", (F.col("_b") / F.col("_a") - 1).alias("net"), F.col("rows").alias("held"))
    return rounded_rows(metrics.portfolio(_daily(spark, sf_dir), trades, "market"), ["market", "days", "trades"], PORTFOLIO, 5)


@query(f"""{RETURNS}, {_DAILY}, k AS (SELECT DISTINCT market AS excluded FROM daily), p AS (SELECT excluded, session, avg(v) AS v FROM daily JOIN k ON market <> excluded GROUP BY 1, 2)
SELECT excluded, (SELECT count(*) - 1 FROM k) AS retained, count(*) AS observations, round(avg(v) / stddev_samp(v) * sqrt(252), 6) AS sharpe, round(avg(v) * 252, 6) AS annualized FROM p GROUP BY excluded""")
def country_jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_rows(metrics.jackknife(_daily(spark, sf_dir), "market"), ["excluded", "retained", "observations"], ["sharpe", "annualized"])


def _action(x: str) -> str:
    return f"CASE WHEN {x} > 0.2 THEN 1 WHEN {x} > 0 THEN 2 WHEN {x} < -0.2 THEN 3 ELSE 0 END"


@query(f"""{_WHOLE}, y AS (SELECT {_action('future')} AS a, {_action('momentum')} AS p FROM x), c AS (SELECT unnest([0, 1, 2, 3]) AS class),
s AS (SELECT class, count(*) FILTER (a = class) AS support, count(*) FILTER (p = class) AS found, count(*) FILTER (a = class AND p = class) AS "right", {", ".join(f"count(*) FILTER (a = class AND p = {k}) AS as_{k}" for k in range(4))} FROM c, y GROUP BY class),
z AS (SELECT *, coalesce("right" / nullif(found, 0), 0) AS precision, coalesce("right" / nullif(support, 0), 0) AS recall FROM s)
SELECT class, support, found, "right", as_0, as_1, as_2, as_3, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM z""")
def action_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda c: F.when(F.col(c) > 0.2, 1).when(F.col(c) > 0, 2).when(F.col(c) < -0.2, 3).otherwise(0)
    rows = _whole(spark, sf_dir).select(kind("future").alias("a"), kind("momentum").alias("p"))
    return rounded_rows(metrics.confusion(rows, "a", "p", [0, 1, 2, 3]), ["class", "support", "found", "right", "as_0", "as_1", "as_2", "as_3"], ["precision", "recall", "f1"])


@query(f"""{_WHOLE}, t AS (SELECT unnest([-0.5, -0.2, 0.0, 0.2, 0.5]::DOUBLE[]) AS threshold)
SELECT threshold, count(*) FILTER (momentum >= threshold) AS rows, round(count(*) FILTER (momentum >= threshold) / count(*), 6) AS coverage, round(avg(CAST(future > 0 AS INT)) FILTER (momentum >= threshold), 6) AS positive_rate,
  round(avg(future) FILTER (momentum >= threshold), 6) AS mean_outcome, round(avg(CAST(future < -0.12 AS INT)) FILTER (momentum >= threshold), 6) AS breach_rate FROM x, t GROUP BY threshold""")
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.risk_coverage(_whole(spark, sf_dir), "momentum", "future", [-0.5, -0.2, 0.0, 0.2, 0.5])
    return rounded_rows(rows, ["threshold", "rows"], ["coverage", "positive_rate", "mean_outcome", "breach_rate"])


@query(f"""{_WHOLE}, e AS (SELECT quantile_cont(momentum, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM x WHERE session < DATE '1996-01-01')
SELECT CAST(len(list_filter(edges, lambda v: v < momentum)) AS INT) AS bin, count(*) AS rows, round(avg(momentum), 6) AS mean_feature, round(avg(future), 6) AS mean_outcome, round(avg(CAST(future > 0 AS INT)), 6) AS positive_rate FROM x, e WHERE session >= DATE '1996-01-01' GROUP BY 1""")
def trained_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.trained_bins(_whole(spark, sf_dir), "momentum", "future", F.col("session") < F.lit("1996-01-01").cast("date"))
    return rounded_rows(rows, ["bin", "rows"], ["mean_feature", "mean_outcome", "positive_rate"])


@query(f"""{RETURNS}, t AS (SELECT * FROM r WHERE session < DATE '1996-01-01'), s AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) AS {c}_b" for c in ("momentum", "volume"))} FROM t),
z AS (SELECT security, session, {", ".join(f"least(10, abs(({c} - {c}_m) / greatest({c}_b - {c}_a, 1e-9))) AS z_{c}" for c in ("momentum", "volume"))}, momentum IS NULL AS lacking FROM r, s)
SELECT security, session, round(CASE WHEN lacking THEN z_volume ELSE (z_momentum + z_volume) / 2 END, 6) AS shift FROM z""")
def shift_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.shift_score(returns(spark, sf_dir), ["momentum", "volume"], F.col("session") < F.lit("1996-01-01").cast("date"))
    return rounded_rows(rows, ["security", "session"], ["shift"])


QUALITY = ["ndcg", "precision", "recall", "reciprocal_rank", "concentration", "improvement"]


@query(f"""{GREEDY}, sc AS (SELECT greatest(median(abs(v - md)), 1e-6) AS scale FROM (SELECT CAST(embedding[1] AS DOUBLE) AS v, median(CAST(embedding[1] AS DOUBLE)) OVER () AS md FROM embeddings)),
o AS (SELECT vec_id AS query_id, CAST(embedding[1] AS DOUBLE) AS own FROM embeddings), d AS (SELECT k.*, abs(target - own) / scale AS d, row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) AS rank FROM k JOIN o USING (query_id), sc),
g AS (SELECT *, exp(-d) AS gain, row_number() OVER (PARTITION BY query_id ORDER BY d, record_id) AS best FROM d),
a AS (SELECT query_id, count(*) AS neighbors, sum(gain / log2(rank + 1)) / sum(gain / log2(best + 1)) AS ndcg, avg(CAST(d <= 1 AS INT)) AS precision, count(*) FILTER (d <= 1) AS hits, coalesce(1 / min(rank) FILTER (d <= 1), 0) AS reciprocal_rank, avg(d) AS mean FROM g GROUP BY query_id),
h AS (SELECT query_id, sum(s * s) AS concentration FROM (SELECT query_id, count(*) / sum(count(*)) OVER (PARTITION BY query_id) AS s FROM k GROUP BY query_id, security) GROUP BY query_id),
p AS (SELECT query_id, count(*) FILTER (abs(target - own) / scale <= 1) AS every, avg(abs(target - own) / scale) AS random FROM c JOIN o USING (query_id), sc GROUP BY query_id)
SELECT query_id, neighbors, round(ndcg, 6) AS ndcg, round(precision, 6) AS precision, round(coalesce(hits / nullif(every, 0), 0), 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(concentration, 6) AS concentration, round(1 - mean / random, 6) AS improvement FROM a JOIN h USING (query_id) JOIN p USING (query_id)""")
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = memory(spark, sf_dir)
    middle = rows.agg(F.median("target").alias("_m"))
    scale = rows.crossJoin(F.broadcast(middle)).agg(F.greatest(F.median(F.abs(F.col("target") - F.col("_m"))), F.lit(1e-6)).alias("_scale"))
    found = metrics.retrieval_quality(constrained(spark, sf_dir), queries, retrieval.candidates(queries, rows), scale)
    return rounded_rows(found, ["query_id", "neighbors"], QUALITY)


@query(f"""{GREEDY}, a AS (SELECT *, query_id - record_id AS age, 1 / greatest(sqrt(distance), 1e-9) AS w FROM k), b AS (SELECT *, CAST(age >= 100 AS INT) + CAST(age >= 200 AS INT) + CAST(age >= 300 AS INT) + CAST(age >= 450 AS INT) AS bucket FROM a)
SELECT CAST(v.bucket AS INT) AS bucket, count(b.query_id) AS neighbors, round(count(b.query_id) / (SELECT count(*) FROM b), 6) AS share, round(coalesce(sum(w), 0) / (SELECT sum(w) FROM b), 6) AS weight_share, round(median(sqrt(distance)), 6) AS median_distance, count(DISTINCT security) AS securities
FROM (SELECT unnest(range(5)) AS bucket) v LEFT JOIN b USING (bucket) GROUP BY v.bucket""")
def neighbor_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = constrained(spark, sf_dir).withColumn("w", 1 / F.greatest(F.sqrt("distance"), F.lit(1e-9)))
    return rounded_rows(metrics.profile(rows, F.col("query_id") - F.col("ordinal"), [100, 200, 300, 450], "w"), ["bucket", "neighbors", "securities"], ["share", "weight_share", "median_distance"])


@query(f"""{RETURNS}, s AS (SELECT l_returnflag AS arm, l_suppkey AS security, CAST(l_shipdate AS DATE) AS session FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT arm, market, avg(future) AS v FROM s JOIN r USING (security, session) WHERE future IS NOT NULL GROUP BY 1, 2)
SELECT arm, {", ".join(f"round(max(v) FILTER (market = '{m}'), 6) AS {c}" for m, c in (("AFRICA", "africa"), ("AMERICA", "america"), ("ASIA", "asia"), ("EUROPE", "europe"), ("MIDDLE EAST", "middle_east")))},
  count(*) FILTER (v > 0) AS positive_markets, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS dispersion FROM m GROUP BY arm""")
def arm_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean outcome of each arm's picks by market, side by side, with their mean over markets and how many are positive."""
    lines = panel.table(spark, sf_dir, "lineitem")
    picks = lines.select(F.col("l_returnflag").alias("arm"), F.col("l_suppkey").alias("security"), F.to_date("l_shipdate").alias("session")).distinct()
    means = picks.join(returns(spark, sf_dir).where("future is not null"), ["security", "session"]).groupBy("arm", "market").agg(F.avg("future").alias("v"))
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = means.groupBy("arm").pivot("market", names).agg(F.round(F.max("v"), 6)).withColumnsRenamed({n: n.lower().replace(" ", "_") for n in names})
    more = means.groupBy("arm").agg(F.sum((F.col("v") > 0).cast("bigint")).alias("positive_markets"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("dispersion"))
    return wide.join(more, "arm")


@query(f"""{BARS}, u AS (SELECT *, CAST(close > lag(close) OVER {W} AS INT) AS up FROM bars), m AS (SELECT *, CASE WHEN up = lag(up) OVER {W} THEN 0 ELSE 1 END AS n FROM u WHERE up IS NOT NULL), r AS (SELECT *, sum(n) OVER {W} AS run FROM m),
s AS (SELECT count(*) AS duration, min(up) = 1 AS ended FROM r GROUP BY security, run), t AS (SELECT duration, count(*) AS leaving, count(*) FILTER (ended) AS events FROM s GROUP BY 1),
q AS (SELECT * FROM (SELECT *, sum(leaving) OVER (ORDER BY duration DESC) AS at_risk FROM t) WHERE events > 0),
k AS (SELECT duration, exp(sum(ln(CASE WHEN at_risk > events THEN (at_risk - events) / at_risk END)) OVER (ORDER BY duration)) AS s0, max(CAST(at_risk = events AS INT)) OVER (ORDER BY duration) AS dead, coalesce(sum(events / nullif(CAST(at_risk AS DOUBLE) * (at_risk - events), 0)) OVER (ORDER BY duration), 0) AS g FROM q),
v AS (SELECT duration, CASE WHEN dead = 1 THEN 0 ELSE s0 END AS s, CASE WHEN dead = 1 THEN 0 ELSE s0 * s0 * g END AS var FROM k),
a AS (SELECT *, CASE WHEN s > 0 AND s < 1 THEN 1.96 * sqrt(var) / (s * abs(ln(s))) END AS half, greatest(0, least(coalesce(lead(duration) OVER (ORDER BY duration), 10), 10) - least(duration, 10)) * s + CASE WHEN row_number() OVER (ORDER BY duration) = 1 THEN least(duration, 10) ELSE 0 END AS area FROM v)
SELECT duration, round(s, 6) AS survival, round(CASE WHEN half IS NOT NULL THEN s ** exp(half) END, 6) AS low, round(CASE WHEN half IS NOT NULL THEN s ** exp(-half) END, 6) AS high, round(sum(area) OVER (), 6) AS restricted_mean FROM a""")
def survival_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = features.islands(panel.bars(spark, sf_dir))
    curve = inference.kaplan_meier(runs.select(F.col("rows").alias("duration"), (F.col("up") == 1).alias("ended")))
    return rounded_rows(metrics.survival_bands(curve, 10), ["duration"], ["survival", "low", "high", "restricted_mean"])


_STATE = "CASE WHEN momentum > 0.1 THEN 2 WHEN momentum < -0.1 THEN 0 ELSE 1 END"


@query(f"""{RETURNS}, s AS (SELECT security, session, ordinal, future, {_STATE} AS state FROM r WHERE momentum IS NOT NULL), k AS (SELECT unnest([1, 5, 10]) AS step),
gap AS (SELECT median(d) AS g FROM (SELECT session - lag(session) OVER {W} AS d FROM s) WHERE d IS NOT NULL),
p AS (SELECT k.step, a.state AS a, b.state AS b, b.future, b.session - a.session AS days FROM s a, k JOIN s b ON b.security = a.security AND b.ordinal = a.ordinal + k.step),
c AS (SELECT step, a, b, count(*) AS n, count(*) FILTER (future IS NOT NULL) AS known, avg(future) AS mean_outcome FROM p, gap WHERE days BETWEEN step * g * 0.5 AND step * g * 1.5 GROUP BY 1, 2, 3)
SELECT CAST(step AS INT) AS step, CAST(a AS INT) AS state, CAST(b AS INT) AS to_state, n AS count, round(n / sum(n) OVER (PARTITION BY step, a), 6) AS probability, round(mean_outcome, 6) AS mean_outcome FROM c""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of momentum states over 1, 5 and 10 rows that take about as long as usual, with outcomes at arrival."""
    m = F.col("momentum")
    rows = returns(spark, sf_dir).where(m.isNotNull()).withColumn("state", F.when(m > 0.1, 2).when(m < -0.1, 0).otherwise(1))
    return features.transitions(rows, "state", "future", (1, 5, 10), 0.5).select("step", "state", "to_state", "count", F.round("probability", 6).alias("probability"), F.round("mean_outcome", 6).alias("mean_outcome"))


@query(f"""{RETURNS}, s AS (SELECT market, {_STATE} AS state, security FROM r WHERE momentum IS NOT NULL), c AS (SELECT market, state, count(*) AS n FROM s GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY market) AS p FROM c),
t AS (SELECT market, sum(p * p) AS h FROM (SELECT market, count(*) / sum(count(*)) OVER (PARTITION BY market) AS p FROM s GROUP BY market, security) GROUP BY market)
SELECT market, round(-sum(p * ln(p)), 6) AS entropy, round(exp(-sum(p * ln(p))), 6) AS effective_states, round(max(p), 6) AS dominant_share, round(any_value(h), 6) AS security_concentration FROM p JOIN t USING (market) GROUP BY market""")
def state_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("momentum")
    rows = returns(spark, sf_dir).where(m.isNotNull()).withColumn("state", F.when(m > 0.1, 2).when(m < -0.1, 0).otherwise(1))
    own = Window.partitionBy("market")
    share = lambda by: rows.groupBy("market", by).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(own))
    entropy = -F.sum(F.col("p") * F.ln("p"))
    states = share("state").groupBy("market").agg(F.round(entropy, 6).alias("entropy"), F.round(F.exp(entropy), 6).alias("effective_states"), F.round(F.max("p"), 6).alias("dominant_share"))
    return states.join(share("security").groupBy("market").agg(F.round(F.sum(F.col("p") * F.col("p")), 6).alias("security_concentration")), "market")


@query(f"""{RETURNS}, d AS (SELECT market, session, security, momentum, volume, row_number() OVER (PARTITION BY market, session ORDER BY momentum DESC, security) AS a, row_number() OVER (PARTITION BY market, session ORDER BY volume DESC, security) AS b,
  {rank('momentum', 'market, session')} AS ra, {rank('volume', 'market, session')} AS rb FROM r WHERE momentum IS NOT NULL),
k AS (SELECT x.market, x.session, sum(sign(x.momentum - y.momentum) * sign(x.volume - y.volume)) AS s, count(*) AS pairs FROM d x JOIN d y ON x.market = y.market AND x.session = y.session AND x.security < y.security GROUP BY 1, 2),
t AS (SELECT market, session, count(*) AS assets, CASE WHEN count(*) >= 3 AND min(ra) < max(ra) AND min(rb) < max(rb) THEN corr(ra, rb) END AS spearman, max(CAST(a = 1 AND b = 1 AS INT)) AS top_hit, count(*) FILTER (a <= 3 AND b <= 3) / count(*) FILTER (a <= 3 OR b <= 3) AS top3 FROM d GROUP BY 1, 2)
SELECT market, count(*) AS sessions, round(avg(spearman), 6) AS spearman, round(avg(s / pairs), 6) AS kendall, round(avg(top_hit), 6) AS top_hit, round(avg(top3), 6) AS top3_jaccard FROM t LEFT JOIN k USING (market, session) WHERE assets >= 2 GROUP BY market""")
def decision_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two scores of a session order its securities: Spearman, Kendall (ties count 0), same first, shared first three."""
    return rounded_rows(ranking.agreement(returns(spark, sf_dir, once=True).where("momentum is not null"), "momentum", "volume"), ["market", "sessions"], ["spearman", "kendall", "top_hit", "top3_jaccard"])
