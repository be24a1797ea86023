"""Queries of selection over folds, resampled survival, growing banks, and reconciled accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retroscope.functions.windows import by_time
from retroscope.operators import audits, banks, features, inference, retrieval, selection
from retroscope.plans.common import BARS, RETURNS, W, query, returns, rounded_rows
from retroscope.plans.neighbors import DISTANCE, memory
from retroscope.sources import panel

_ARMS = {"rising": "momentum > 0", "falling": "momentum < 0", "calm": "abs(daily_return) < 0.5", "every": "true"}
_DAILY = f"""{RETURNS}, nx AS (SELECT market, session, momentum, daily_return, greatest(-0.05, least(0.05, lead(daily_return) OVER {W})) / 10 AS v FROM r),
arms AS ({" UNION ALL ".join(f"SELECT '{k}' AS candidate, market, session, v FROM nx WHERE v IS NOT NULL AND momentum IS NOT NULL AND {c}" for k, c in _ARMS.items())}),
daily AS MATERIALIZED (SELECT candidate, market AS fold, session, avg(v) AS value FROM arms GROUP BY 1, 2, 3)"""
_RATIO = "CASE WHEN count({0}) < 3 OR coalesce(stddev_samp({0}), 0) <= 1e-12 THEN 0 ELSE avg({0}) / stddev_samp({0}) * sqrt(252) END"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = returns(spark, sf_dir).withColumn("v", F.greatest(F.lit(-0.05), F.least(F.lit(0.05), F.lead("daily_return", 1).over(by_time()))) / 10).where("v is not null and momentum is not null")
    arm = F.explode(F.array_compact(F.array(*(F.when(F.expr(c), F.lit(k)) for k, c in _ARMS.items()))))
    return rows.withColumn("candidate", arm).groupBy("candidate", F.col("market").alias("fold"), "session").agg(F.avg("v").alias("value"))


@query(f"""{_DAILY}, eq AS (SELECT *, sum(ln(1 + value)) OVER (PARTITION BY candidate, fold ORDER BY session) AS l FROM daily), dd AS (SELECT *, exp(l - greatest(max(l) OVER (PARTITION BY candidate, fold ORDER BY session), 0)) - 1 AS d FROM eq),
made0 AS (SELECT candidate, fold, exp(sum(ln(1 + value))) - 1 AS ret, least(min(d), 0) AS dd, {_RATIO.format('value')} AS sharpe FROM dd GROUP BY 1, 2), made AS MATERIALIZED (SELECT m.*, m.ret - b.ret AS excess FROM made0 m JOIN made0 b ON b.fold = m.fold AND b.candidate = 'every'),
h AS (SELECT DISTINCT fold AS heldout FROM made), po AS (SELECT candidate, heldout, {_RATIO.format('m')} AS pooled FROM (SELECT candidate, heldout, session, avg(value) AS m FROM daily JOIN h ON fold <> heldout GROUP BY 1, 2, 3) GROUP BY 1, 2),
o AS (SELECT candidate, heldout, min(sharpe) AS low, avg(excess) AS excess, min(dd) AS dd FROM made JOIN h ON fold <> heldout GROUP BY 1, 2), sc AS (SELECT candidate, heldout, pooled + 0.5::DOUBLE * low + excess - 0.5::DOUBLE * abs(dd) AS score FROM po JOIN o USING (candidate, heldout)),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY heldout ORDER BY score DESC, candidate) = 1)
SELECT heldout, b.candidate AS selected, round(score, 6) AS score, round(sharpe, 6) AS heldout_sharpe, round(ret, 6) AS heldout_return, round(excess, 6) AS heldout_excess FROM best b JOIN made m ON m.fold = heldout AND m.candidate = b.candidate""")
def fold_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each market the rule that did best in all other markets, and how it does there."""
    daily = _daily(spark, sf_dir)
    rows = selection.leave_one_fold_out(daily, selection.runs(daily), "every")
    return rounded_rows(rows, ["heldout", "selected"], ["score", "heldout_sharpe", "heldout_return", "heldout_excess"])


_HORIZON, _DRAWS = 10, 200


@query(f"""{BARS}, u AS (SELECT *, CAST(close > lag(close) OVER {W} AS INT) AS up FROM bars), m AS (SELECT *, CASE WHEN up = lag(up) OVER {W} THEN 0 ELSE 1 END AS n FROM u WHERE up IS NOT NULL), ru AS (SELECT *, sum(n) OVER {W} AS run FROM m),
sp AS (SELECT sector, count(*) AS duration, min(up) = 1 AS ended FROM ru JOIN groups USING (security) GROUP BY security, sector, run),
ct AS MATERIALIZED (SELECT sector, least(duration, {_HORIZON + 1}) AS duration, count(*) AS leaving, count(*) FILTER (ended AND duration <= {_HORIZON}) AS events FROM sp GROUP BY 1, 2),
nu AS (SELECT sector, row_number() OVER (ORDER BY sector) - 1 AS c FROM (SELECT DISTINCT sector FROM ct)), nn AS (SELECT count(*) AS k FROM nu),
we AS (SELECT draw, CAST(('0x' || substr(sha256('4:' || draw || ':' || place), 1, 8)) AS BIGINT) % k AS c, count(*) AS w FROM range({_DRAWS}) d(draw), nn, LATERAL (SELECT unnest(range(k)) AS place) GROUP BY 1, 2 UNION ALL SELECT -1, c, 1 FROM nu),
ea AS (SELECT draw, duration, sum(w * leaving) AS leaving, sum(w * events) AS events FROM we JOIN nu USING (c) JOIN ct USING (sector) GROUP BY 1, 2), ri AS (SELECT *, 1 - events / sum(leaving) OVER (PARTITION BY draw ORDER BY duration DESC) AS h FROM ea),
st AS (SELECT draw, t, coalesce(CASE WHEN min(h) <= 0 THEN 0 ELSE exp(sum(ln(CASE WHEN h > 0 THEN h END))) END, 1) AS s FROM (SELECT DISTINCT draw FROM ri) JOIN range(1, {_HORIZON + 1}) x(t) ON true LEFT JOIN ri USING (draw) WHERE duration <= t GROUP BY 1, 2),
ar AS (SELECT draw, sum(s) + {_HORIZON} - count(*) AS v FROM st GROUP BY 1)
SELECT (SELECT k FROM nn) AS clusters, round(max(v) FILTER (draw < 0), 6) AS rmst, round(stddev_pop(v) FILTER (draw >= 0), 6) AS error, round(quantile_cont(v, 0.025) FILTER (draw >= 0), 6) AS low, round(quantile_cont(v, 0.975) FILTER (draw >= 0), 6) AS high FROM ar""")
def rmst_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean length of runs within a horizon, and its interval by drawing sectors."""
    runs = features.islands(panel.bars(spark, sf_dir)).join(panel.securities(spark, sf_dir), "security")
    spells = runs.select("sector", F.col("rows").alias("duration"), (F.col("up") == 1).alias("ended"))
    return rounded_rows(inference.cluster_rmst(spells, "sector", _HORIZON, _DRAWS, 4), ["clusters"], ["rmst", "error", "low", "high"])


_KEYS = 200
_VERSIONS = f"WITH ve AS (SELECT vec_id % {_KEYS} AS key, vec_id, label, embedding, vec_id + 63 AS since, lead(vec_id + 63) OVER (PARTITION BY vec_id % {_KEYS} ORDER BY vec_id) AS until FROM embeddings)"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = memory(spark, sf_dir)
    return banks.intervals(rows.withColumn("key", F.col("record_id") % _KEYS), ["key"], "available")


@query(f"{_VERSIONS} SELECT key, vec_id, since, until FROM ve")
def bank_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From when to when each record of a bank counts, whose keys come again with newer records."""
    return _versions(spark, sf_dir).select("key", F.col("record_id").alias("vec_id"), F.col("available").alias("since"), "until")


@query(f"""{_VERSIONS}, n AS (SELECT q.vec_id AS query_id, m.vec_id AS record_id, {DISTANCE} AS distance FROM ve q JOIN ve m ON m.since <= q.vec_id AND (m.until IS NULL OR m.until > q.vec_id) AND m.label <> q.label WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) AS INT) AS rank, record_id, round(distance, 6) AS distance FROM n QUALIFY rank <= 10""")
def versioned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest records of those that the bank held at a query's time: neither later ones nor those replaced by then."""
    queries, _ = memory(spark, sf_dir)
    near = retrieval.nearest(retrieval.candidates(queries, _versions(spark, sf_dir), retrieval.Rules(k=10, until="until")), 10)
    return near.select("query_id", "rank", "record_id", F.round("distance", 6).alias("distance"))


_PERMITTED = ["NO_HISTORY", "NOT_MATURE"]


def _accounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Expected accounts (year, market), their coverage, exclusions and forecasts."""
    rows = returns(spark, sf_dir).withColumn("year", F.year("session"))
    reason = F.when(F.col("momentum").isNull(), "NO_HISTORY").when(F.col("future").isNull(), "NOT_MATURE")
    rows = rows.select("year", "market", "security", F.concat_ws(":", "security", F.date_format("session", "yyyy-MM-dd")).alias("id"), F.round("momentum", 6).alias("value"), reason.alias("reason"))
    keys = ["year", "market"]
    admitted = F.col("reason").isNull()
    n = F.sum(admitted.cast("bigint"))
    coverage = rows.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count("*").alias("decisions"), n.alias("admitted"), n.alias("expected"), F.coalesce(F.sum(F.when(admitted, F.col("value"))), F.lit(0.0)).alias("stated"))
    exclusions = rows.where("reason is not null").groupBy(*keys, "reason").agg(F.count("*").alias("excluded"))
    return rows.select(*keys).distinct(), coverage, exclusions, rows.where(admitted).select(*keys, "id", "value", "security")


_ACCOUNTS = f"""{RETURNS}, ac AS MATERIALIZED (SELECT year(session) AS year, market, security, security || ':' || strftime(session, '%Y-%m-%d') AS id, round(momentum, 6) AS value, CASE WHEN momentum IS NULL THEN 'NO_HISTORY' WHEN future IS NULL THEN 'NOT_MATURE' END AS reason FROM r),
co AS MATERIALIZED (SELECT year, market, count(*) AS candidates, count(*) FILTER (reason IS NULL) AS admitted, coalesce(sum(value) FILTER (reason IS NULL), 0) AS stated FROM ac GROUP BY 1, 2)"""


@query(f"""{_ACCOUNTS}, e AS (SELECT co.*, CASE WHEN market = 'ASIA' AND year % 2 = 0 THEN 0 WHEN market = 'MIDDLE EAST' THEN 2 ELSE 1 END AS reports FROM co),
x AS (SELECT e.*, (SELECT count(*) FROM ac WHERE ac.year = e.year AND ac.market = e.market AND reason IS NOT NULL) AS excluded, (SELECT count(*) FROM ac WHERE ac.year = e.year AND ac.market = e.market AND reason = 'NOT_MATURE') AS immature,
  (SELECT count(*) FROM ac WHERE ac.year = e.year AND ac.market = e.market AND reason IS NULL AND NOT (ac.market = 'AMERICA' AND security % 10 = 0)) AS sealed, (SELECT coalesce(sum(value), 0) FROM ac WHERE ac.year = e.year AND ac.market = e.market AND reason IS NULL AND NOT (ac.market = 'AMERICA' AND security % 10 = 0)) AS total FROM e),
z AS (SELECT year, market, sealed, total, excluded, CASE WHEN market = 'EUROPE' THEN immature ELSE 0 END AS forbidden, reports, CASE WHEN reports > 0 THEN candidates ELSE 0 END AS candidates, CASE WHEN reports > 0 THEN candidates - CAST(market = 'AFRICA' AS INT) ELSE 0 END AS decisions, CASE WHEN reports > 0 THEN admitted ELSE 0 END AS admitted, CASE WHEN reports > 0 THEN stated ELSE 0 END AS stated FROM x),
v AS (SELECT year, market, unnest([{{'r': 'reports', 'f': reports, 'w': 1}}, {{'r': 'decisions', 'f': decisions, 'w': candidates}}, {{'r': 'candidates', 'f': admitted + excluded, 'w': candidates}}, {{'r': 'forbidden_reasons', 'f': forbidden, 'w': 0}}, {{'r': 'expected', 'f': admitted, 'w': admitted}}, {{'r': 'sealed', 'f': sealed, 'w': admitted}}, {{'r': 'repeated_forecasts', 'f': 0, 'w': 0}}]) AS a FROM z)
SELECT CAST(year AS INT) AS year, market, a.r AS rule, CAST(a.f AS DOUBLE) AS found, CAST(a.w AS DOUBLE) AS wanted FROM v WHERE a.f <> a.w UNION ALL SELECT CAST(year AS INT), market, 'forecast_sum', round(total, 6), round(stated, 6) FROM z WHERE abs(total - stated) > 1e-6 * (1 + abs(stated))""")
def account_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit says of accounts of which some are missing, told twice, miscounted, excluded for no good reason or lack forecasts."""
    expected, coverage, exclusions, forecasts = _accounts(spark, sf_dir)
    coverage = coverage.where("not (market = 'ASIA' and year % 2 = 0)").withColumn("decisions", F.col("decisions") - (F.col("market") == "AFRICA").cast("int"))
    coverage = coverage.unionByName(coverage.where("market = 'MIDDLE EAST'"))
    exclusions = exclusions.withColumn("reason", F.when((F.col("market") == "EUROPE") & (F.col("reason") == "NOT_MATURE"), "OTHER").otherwise(F.col("reason")))
    forecasts = forecasts.where("not (market = 'AMERICA' and security % 10 = 0)")
    found = audits.reconciled(expected, coverage, exclusions, forecasts, _PERMITTED).where("broken")
    return found.select("year", "market", "rule", F.round("found", 6).alias("found"), F.round("wanted", 6).alias("wanted"))


_RULES = ("reports", "decisions", "candidates", "forbidden_reasons", "expected", "sealed", "repeated_forecasts", "forecast_sum")


@query(f"{_ACCOUNTS} SELECT unnest([{', '.join(f'{chr(39)}{r}{chr(39)}' for r in _RULES)}]) AS rule, count(*) AS accounts, CAST(0 AS BIGINT) AS violations FROM co")
def accounts_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same audit on accounts as they are: no rule is broken."""
    return audits.reconciled(*_accounts(spark, sf_dir), _PERMITTED).groupBy("rule").agg(F.count("*").alias("accounts"), F.count_if("broken").alias("violations"))


@query(f"""{_ACCOUNTS}, pr AS (SELECT *, NOT (market = 'AMERICA' AND security % 50 = 1 AND year % 2 = 1) AND NOT (market = 'ASIA' AND year > 1996) AS done FROM ac WHERE reason IS NULL), g AS (SELECT year, market, bool_and(done) AS complete FROM pr GROUP BY 1, 2)
SELECT CAST(year AS INT) AS year, market, count(*) AS labels, round(sum(value), 6) AS total FROM pr JOIN g USING (year, market) WHERE complete GROUP BY 1, 2""")
def sealed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels per year and market, of those groups only whose predictions are all there."""
    *_, rows = _accounts(spark, sf_dir)
    made = rows.where("not (market = 'AMERICA' and security % 50 = 1 and year % 2 = 1) and not (market = 'ASIA' and year > 1996)").withColumn("prediction", F.lit(0.0))
    shown = audits.sealed(rows, rows, made, ["year", "market"])
    return shown.groupBy("year", "market").agg(F.count("*").alias("labels"), F.round(F.sum("value"), 6).alias("total"))
