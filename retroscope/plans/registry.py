"""All queries of the engine, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retroscope.functions.windows import by_time, change, rounded
from retroscope.operators import audits, calendar, features, inference, labels, ranking, recursive, retrieval, weighting
from retroscope.plans.common import BARS, ORACLE_SQL, QUERIES, W, query
from retroscope.plans.common import full as _full
from retroscope.plans.common import over as _over
from retroscope.plans.common import rank as _rank
from retroscope.plans.common import RETURNS as _RETURNS
from retroscope.plans.common import returns as _returns
from retroscope.plans.common import round_sql as _round_sql
from retroscope.plans.common import rounded_rows as _rounded
from retroscope.plans.neighbors import DISTANCE as _DISTANCE
from retroscope.plans.neighbors import GREEDY as _GREEDY
from retroscope.plans.neighbors import NEAR as _NEAR
from retroscope.plans.neighbors import constrained as _constrained
from retroscope.plans.neighbors import memory as _memory
from retroscope.sources import panel
from retroscope.streaming.windows import activity

FLAGSHIP = "technical_features"


@query(BARS + " SELECT security, session, ordinal, f.p / f.q AS open, high, low, close, volume FROM bars")
def bar_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.bars(spark, sf_dir)


TECH = ["tech_return_1", "tech_momentum_3", "tech_momentum_10", "tech_momentum_21", "tech_vol_21", "tech_avg_volume_21", "tech_volume_ratio", "tech_volume_change_1", "tech_intraday_range", "tech_drawdown", "tech_trend_slope", "tech_sma_50", "tech_sma_150", "tech_sma_200", "tech_close_vs_sma_50", "tech_close_vs_sma_150", "tech_close_vs_sma_200", "tech_sma_200_trend_20", "tech_52w_low", "tech_52w_high", "tech_pct_above_52w_low", "tech_pct_from_52w_high", "tech_up_down_volume_ratio_50"]
_CHANGES = ", ".join(f"close / lag(close, {k}) OVER {W} - 1 AS tech_momentum_{k}" for k in (3, 10, 21))
_SLOPE = " + ".join(f"lag(close, {k}) OVER {W} * ({9 - k} - 4.5)" for k in range(10))
_MEANS = ", ".join(f"{_full('avg', 'close', k)} AS tech_sma_{k}" for k in (50, 150, 200))
_VERSUS = ", ".join(f"close / (tech_sma_{k} + 1e-9) - 1 AS tech_close_vs_sma_{k}" for k in (50, 150, 200))
_TECH_SQL = f"""{BARS},
steps AS (SELECT *, close / lag(close) OVER {W} - 1 AS tech_return_1, volume / lag(volume) OVER {W} - 1 AS tech_volume_change_1,
  CASE WHEN close > lag(close) OVER {W} THEN volume ELSE 0 END AS up, CASE WHEN close < lag(close) OVER {W} THEN volume ELSE 0 END AS down FROM bars),
rolled AS (SELECT *, {_CHANGES}, {_full("stddev_samp", "tech_return_1", 21)} AS tech_vol_21, {_full("avg", "volume", 21)} AS tech_avg_volume_21,
  (high - low) / (close + 1e-9) AS tech_intraday_range, close / max(close) {_over(252)} - 1 AS tech_drawdown, ({_SLOPE}) / 82.5 AS tech_trend_slope, {_MEANS},
  {_full("min", "close", 252)} AS tech_52w_low, {_full("max", "close", 252)} AS tech_52w_high,
  {_full("sum", "up", 50, 20)} / ({_full("sum", "down", 50, 20)} + 1e-9) AS tech_up_down_volume_ratio_50 FROM steps),
more AS (SELECT *, volume / (tech_avg_volume_21 + 1e-9) AS tech_volume_ratio, {_VERSUS}, tech_sma_200 / lag(tech_sma_200, 20) OVER {W} - 1 AS tech_sma_200_trend_20,
  close / tech_52w_low - 1 AS tech_pct_above_52w_low, close / tech_52w_high - 1 AS tech_pct_from_52w_high FROM rolled),
scored AS (SELECT *, coalesce(CAST(close > tech_sma_150 AND close > tech_sma_200 AS INT), 0) + coalesce(CAST(tech_sma_150 > tech_sma_200 AS INT), 0)
  + coalesce(CAST(tech_sma_200_trend_20 > 0 AS INT), 0) + coalesce(CAST(tech_sma_50 > tech_sma_150 AND tech_sma_50 > tech_sma_200 AS INT), 0)
  + coalesce(CAST(close > tech_sma_50 AS INT), 0) + coalesce(CAST(tech_pct_above_52w_low > 0.30 AS INT), 0)
  + coalesce(CAST(tech_pct_from_52w_high > -0.25 AS INT), 0) AS tech_minervini_template_score FROM more)"""


@query(f"{_TECH_SQL} SELECT security, session, {_round_sql(TECH)}, tech_minervini_template_score, CAST(tech_minervini_template_score >= 6 AS INT) AS tech_minervini_gate FROM scored")
def technical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.technical_features(panel.bars(spark, sf_dir))
    return rows.select("security", "session", *(F.round(x, 6).alias(x) for x in TECH), "tech_minervini_template_score", "tech_minervini_gate")


OSCILLATORS = ["rsi_14", "atr_ratio_14", "bollinger_width_20", "vol_ratio_63_21", "up_down_volume_50", "trend_slope_21"]
_SLOPE21 = " + ".join(f"lag(close, {k}) OVER {W} * ({20 - k} - 10)" for k in range(21))


@query(f"""{BARS},
steps AS (SELECT *, close - lag(close) OVER {W} AS d, close / lag(close) OVER {W} - 1 AS r, lag(close) OVER {W} AS before FROM bars),
parts AS (SELECT *, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END AS gain, CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END AS loss,
  CASE WHEN d > 0 THEN volume WHEN d IS NOT NULL THEN 0 END AS up, CASE WHEN d < 0 THEN volume WHEN d IS NOT NULL THEN 0 END AS down,
  greatest(high - low, abs(high - before), abs(low - before)) AS spread FROM steps),
means AS (SELECT *, {_full("avg", "gain", 14)} AS g, {_full("avg", "loss", 14)} AS l FROM parts),
o AS (SELECT security, session, CASE WHEN g = 0 AND l = 0 THEN 0.5 ELSE g / (g + l + 1e-9) END AS rsi_14, {_full("avg", "spread", 14)} / (close + 1e-9) AS atr_ratio_14,
  4 * {_full("stddev_samp", "close", 20)} / ({_full("avg", "close", 20)} + 1e-9) AS bollinger_width_20, {_full("stddev_samp", "r", 63)} / ({_full("stddev_samp", "r", 21)} + 1e-9) AS vol_ratio_63_21,
  {_full("sum", "up", 50)} / ({_full("sum", "down", 50)} + 1e-9) AS up_down_volume_50, ({_SLOPE21}) / 770 / (close + 1e-9) AS trend_slope_21 FROM means)
SELECT security, session, {_round_sql(OSCILLATORS)} FROM o""")
def oscillator_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.oscillators(panel.bars(spark, sf_dir)), ["security", "session"], OSCILLATORS)


MACD = ["ema_12", "ema_26", "macd", "macd_signal"]


@query(f"""{BARS.replace("WITH", "WITH RECURSIVE", 1)},
e AS (SELECT security, session, ordinal, close AS ema_12, close AS ema_26, 0.0::DOUBLE AS macd_signal FROM bars WHERE ordinal = 0
  UNION ALL SELECT security, session, ordinal, f, s, g + 0.2::DOUBLE * (f - s - g) FROM (
    SELECT b.security, b.session, b.ordinal, e.ema_12 + 2::DOUBLE / 13 * (b.close - e.ema_12) AS f, e.ema_26 + 2::DOUBLE / 27 * (b.close - e.ema_26) AS s, e.macd_signal AS g
    FROM e JOIN bars b ON b.security = e.security AND b.ordinal = e.ordinal + 1))
SELECT security, session, ordinal, round(ema_12, 6) AS ema_12, round(ema_26, 6) AS ema_26, round(ema_12 - ema_26, 6) AS macd, round(macd_signal, 6) AS macd_signal FROM e""")
def ema_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recursive.macd(panel.bars(spark, sf_dir)), ["security", "session", "ordinal"], MACD)


@query(f"""{BARS}, u AS (SELECT *, CAST(close > lag(close) OVER {W} AS INT) AS up FROM bars),
m AS (SELECT *, CASE WHEN up = lag(up) OVER {W} THEN 0 ELSE 1 END AS n FROM u WHERE up IS NOT NULL), r AS (SELECT *, sum(n) OVER {W} AS run FROM m)
SELECT security, CAST(run AS BIGINT) AS run, min(session) AS first, max(session) AS last, count(*) AS rows, min(up) AS up FROM r GROUP BY security, run""")
def state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.islands(panel.bars(spark, sf_dir))


OUTCOMES = ["future_return_21", "future_return_63", "future_max_return", "future_min_return", "path_quality"]
_AHEAD = "OVER (PARTITION BY security ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING)"
_OUTCOME_SQL = f"""{BARS},
o AS (SELECT *, lead(close, 21) OVER {W} / close - 1 AS future_return_21, lead(close, 63) OVER {W} / close - 1 AS future_return_63, max(close) {_AHEAD} / close - 1 AS future_max_return,
  min(close) {_AHEAD} / close - 1 AS future_min_return, list(close) {_AHEAD} AS ahead, lead(session, 63) OVER {W} AS available FROM bars),
h AS (SELECT *, list_position(list_transform(ahead, lambda x: x / close - 1 >= 0.1), true) AS u, list_position(list_transform(ahead, lambda x: x / close - 1 <= -0.1), true) AS d,
  list_position(ahead, list_max(ahead)) AS p, list_position(ahead, list_min(ahead)) AS t FROM o),
outcomes AS (SELECT *, nullif(u, 0) AS up_offset, nullif(d, 0) AS down_offset, greatest(future_max_return, 0) / (greatest(future_max_return, 0) + greatest(-future_min_return, 0) + 1e-9) AS path_quality FROM h)"""


@query(f"""{_OUTCOME_SQL} SELECT security, session, {_round_sql(OUTCOMES)}, CAST(p AS BIGINT) AS peak_offset, CAST(t AS BIGINT) AS trough_offset, CAST(up_offset AS BIGINT) AS up_offset,
  CAST(down_offset AS BIGINT) AS down_offset, CAST(coalesce(up_offset < down_offset, up_offset IS NOT NULL) AS INT) AS upside_before_drawdown, available FROM outcomes""")
def forward_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.forward_outcomes(panel.bars(spark, sf_dir))
    return rows.select("security", "session", *(F.round(x, 6).alias(x) for x in OUTCOMES), "peak_offset", "trough_offset", F.col("up_offset").cast("bigint").alias("up_offset"), F.col("down_offset").cast("bigint").alias("down_offset"), "upside_before_drawdown", "available")


@query(f"""{_RETURNS}, x AS (SELECT security, session, market, future, CASE WHEN count(future) OVER (PARTITION BY session, market) >= 3 THEN median(future) OVER (PARTITION BY session, market) ELSE median(future) OVER (PARTITION BY session) END AS benchmark FROM r WHERE future IS NOT NULL)
SELECT security, session, market, round(benchmark, 6) AS benchmark, round(future - benchmark, 6) AS relative FROM x""")
def relative_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.relative_outcomes(_returns(spark, sf_dir).drop("sector", "market"), panel.securities(spark, sf_dir), "future")
    return _rounded(rows, ["security", "session", "market"], ["benchmark", "relative"])


_MEDIAN = "median(future) OVER (PARTITION BY session, market{})"


@query(f"""{_RETURNS}, x AS (SELECT *, {_MEDIAN.format("")} AS universe, CASE WHEN count(future) OVER (PARTITION BY session, market, sector) >= 2 THEN {_MEDIAN.format(", sector")} ELSE {_MEDIAN.format("")} END AS sm FROM r WHERE future IS NOT NULL)
SELECT market, sector, CAST(year(session) AS INT) AS year, count(*) AS rows, count(*) FILTER (sm <> universe) AS apart, round(avg(future - universe), 6) AS universe_alpha, round(avg(future - (0.5 * sm + 0.5 * universe)), 6) AS blended_alpha FROM x GROUP BY 1, 2, 3""")
def blended_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes less their market's median and less a blend with their sector's, by market, sector and year."""
    rows = labels.blended_outcomes(_returns(spark, sf_dir).drop("sector", "market"), panel.securities(spark, sf_dir), "future", 0.5, 2)
    out = rows.groupBy("market", "sector", F.year("session").alias("year")).agg(F.count("*").alias("rows"), F.count_if(F.col("sector_median") != F.col("universe")).alias("apart"), F.avg("universe_alpha").alias("universe_alpha"), F.avg("blended_alpha").alias("blended_alpha"))
    return _rounded(out, ["market", "sector", "year", "rows", "apart"], ["universe_alpha", "blended_alpha"])


@query(f"{_RETURNS}, x AS (SELECT * FROM r WHERE momentum IS NOT NULL) SELECT security, session, round({_rank('momentum', 'session')}, 6) AS rank_momentum, round({_rank('volume', 'session')}, 6) AS rank_volume FROM x")
def opportunity_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.opportunity_ranks(_returns(spark, sf_dir).where("momentum is not null"), ["momentum", "volume"])
    return _rounded(rows, ["security", "session"], ["rank_momentum", "rank_volume"])


@query(f"""{_RETURNS}, x AS (SELECT *, {_rank('momentum', 'session')} AS p FROM r WHERE momentum IS NOT NULL AND future IS NOT NULL)
SELECT CAST(least(floor(p * 10), 9) AS INT) AS decile, count(*) AS rows, round(avg(future), 6) AS mean_outcome, round(avg(CAST(future > 0 AS INT)), 6) AS share_positive FROM x GROUP BY 1""")
def decile_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.decile_diagnostics(_returns(spark, sf_dir), "momentum", "future"), ["decile", "rows"], ["mean_outcome", "share_positive"])


def _ic_sql(by: str) -> str:
    return f"""{_RETURNS}, x AS (SELECT *, CAST(date_trunc('week', session) AS DATE) AS week FROM r WHERE momentum IS NOT NULL AND future IS NOT NULL),
y AS (SELECT {by}, {_rank('momentum', by)} AS a, {_rank('future', by)} AS b FROM x)
SELECT {by}, count(*) AS assets, round(CASE WHEN count(*) >= 5 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END, 6) AS rank_ic FROM y GROUP BY {by}"""


@query(_ic_sql("session"))
def daily_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.rank_ic(_returns(spark, sf_dir), "momentum", "future"), ["session", "assets"], ["rank_ic"])


@query(_ic_sql("week"))
def weekly_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _returns(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "session")))
    return _rounded(ranking.rank_ic(rows, "momentum", "future", "week"), ["week", "assets"], ["rank_ic"])


@query(f"""{_RETURNS}, x AS (SELECT session, security, momentum, row_number() OVER (PARTITION BY session ORDER BY momentum DESC, security) AS slot FROM r WHERE momentum IS NOT NULL)
SELECT session, CAST(slot AS INT) AS slot, security, round(momentum, 6) AS momentum FROM x WHERE slot <= 3""")
def daily_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.daily_slots(_returns(spark, sf_dir), "momentum"), ["session", "slot", "security"], ["momentum"])


@query(f"""{_RETURNS}, m AS (SELECT session, market, avg(daily_return) AS v FROM r WHERE daily_return IS NOT NULL GROUP BY 1, 2)
SELECT session, count(*) AS present, round(avg(v), 6) AS pooled_present, round(sum(v) / (SELECT count(DISTINCT market) FROM r), 6) AS pooled FROM m GROUP BY session""")
def market_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.market_index(_returns(spark, sf_dir)), ["session", "present"], ["pooled_present", "pooled"])


@query(f"""{_RETURNS}, m AS (SELECT market, session, avg(daily_return) AS v FROM r WHERE daily_return IS NOT NULL GROUP BY 1, 2),
l AS (SELECT *, sum(ln(1 + v)) OVER (PARTITION BY market ORDER BY session) AS s FROM m), d AS (SELECT *, exp(s - greatest(max(s) OVER (PARTITION BY market ORDER BY session), 0)) - 1 AS down FROM l)
SELECT market, count(*) AS days, round(sum(ln(1 + v)) * 252 / count(*), 6) AS annual_log_return, round(stddev_pop(v) * sqrt(252), 6) AS volatility,
  round(CASE WHEN stddev_pop(v) > 0 THEN avg(v) / stddev_pop(v) * sqrt(252) END, 6) AS sharpe, round(min(down), 6) AS max_drawdown FROM d GROUP BY market""")
def portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _returns(spark, sf_dir).where("daily_return is not null").groupBy("market", "session").agg(F.avg("daily_return").alias("v"))
    return _rounded(ranking.portfolio_metrics(daily, "market", "v", "session"), ["market", "days"], ["annual_log_return", "volatility", "sharpe", "max_drawdown"])


@query(f"""{_RETURNS}, x AS (SELECT *, row_number() OVER (ORDER BY momentum, security, session) - 1 AS k, count(*) OVER () AS n FROM r WHERE momentum IS NOT NULL AND future IS NOT NULL)
SELECT CAST(k * 10 // n AS INT) AS decile, count(*) AS rows, round(avg(momentum), 6) AS mean_confidence, round(avg(future), 6) AS mean_outcome FROM x GROUP BY 1""")
def reliability_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.reliability_deciles(_returns(spark, sf_dir), "momentum", "future", ["security", "session"]), ["decile", "rows"], ["mean_confidence", "mean_outcome"])


@query(f"""{BARS}, v AS (SELECT security, session, close / first_value(close) OVER {W} AS rel FROM bars), days AS (SELECT DISTINCT session FROM bars),
b AS (SELECT security, min(session) AS begin FROM bars GROUP BY 1), g AS (SELECT d.session, b.security FROM days d JOIN b ON b.begin <= d.session),
a AS (SELECT g.session, v.rel FROM g ASOF JOIN v ON g.security = v.security AND g.session >= v.session)
SELECT session, round(avg(rel), 6) AS wealth FROM a GROUP BY session""")
def equal_weight_buy_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.equal_weight(panel.bars(spark, sf_dir)), ["session"], ["wealth"])


_CALENDAR = f"{BARS}, cal AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY session) - 1 AS venue_ordinal, CAST(date_trunc('week', session) AS DATE) AS week FROM (SELECT DISTINCT market, session FROM bars JOIN groups USING (security)))"


@query(f"{_CALENDAR} SELECT market, session, venue_ordinal, week, dense_rank() OVER (PARTITION BY market, year(session) ORDER BY week) AS week_number FROM cal")
def venue_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.venue_calendar(panel.bars(spark, sf_dir), panel.securities(spark, sf_dir))


@query(f"""{_CALENDAR} SELECT security, session, venue_ordinal, coalesce(venue_ordinal - lag(venue_ordinal) OVER {W} - 1, 0) AS missed,
  coalesce(venue_ordinal - lag(venue_ordinal, 20) OVER {W} = 20, false) AS window_whole FROM bars JOIN groups USING (security) JOIN cal USING (market, session)""")
def missing_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.missing_sessions(panel.bars(spark, sf_dir), panel.securities(spark, sf_dir))


@query(f"""{BARS}, acts AS (SELECT l_suppkey AS security, CAST(l_shipdate AS DATE) AS session, CASE WHEN count(*) FILTER (l_returnflag = 'R') >= 3 THEN 2.0 ELSE 1.0 END::DOUBLE AS split,
  CAST(count(*) FILTER (l_returnflag = 'A') AS DOUBLE) AS dividend FROM lineitem GROUP BY 1, 2),
g AS (SELECT security, session, split, coalesce((split * close + dividend) / lag(close) OVER {W}, 1.0) AS growth FROM bars JOIN acts USING (security, session))
SELECT security, session, round(growth, 6) AS growth, round(ln(100 * exp(sum(ln(growth)) OVER {W})), 6) AS log_tr_close, round(ln(exp(sum(ln(split)) OVER {W})), 6) AS log_cum_split FROM g""")
def total_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = panel.table(spark, sf_dir, "lineitem")
    flags = lambda x: F.count(F.when(F.col("l_returnflag") == x, 1))
    actions = lines.groupBy(F.col("l_suppkey").alias("security"), F.to_date("l_shipdate").alias("session")).agg(F.when(flags("R") >= 3, 2.0).otherwise(1.0).alias("split"), flags("A").cast("double").alias("dividend"))
    rows = calendar.total_return(panel.bars(spark, sf_dir), actions)
    return rows.select("security", "session", *rounded(6, growth=F.col("growth"), log_tr_close=F.ln("tr_close"), log_cum_split=F.ln("cum_split")).values()).toDF("security", "session", "growth", "log_tr_close", "log_cum_split")


_REPORTS = BARS + """, reps AS (SELECT o_custkey AS security, CAST(o_orderdate AS DATE) AS report_date, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS revenue, CAST(count(*) AS DOUBLE) AS eps FROM orders GROUP BY 1, 2)"""


@query(f"""{_REPORTS}, l AS (SELECT b.security, b.session, r.report_date, r.revenue FROM bars b ASOF LEFT JOIN reps r ON b.security = r.security AND b.session >= r.report_date),
n AS (SELECT b.security, b.session, r.report_date AS next_date FROM bars b ASOF LEFT JOIN reps r ON b.security = r.security AND b.session < r.report_date)
SELECT security, session, report_date, revenue, CAST(coalesce(session - report_date, 9999) AS INT) AS days_since, next_date, CAST(coalesce(next_date - session, 9999) AS INT) AS days_to_next,
  coalesce(next_date - session <= 14, false) AS imminent FROM l JOIN n USING (security, session)""")
def reports_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = panel.reports(spark, sf_dir)
    rows = calendar.asof(panel.bars(spark, sf_dir).select("security", "session"), reports, "security", "session", "report_date", ["revenue"])
    coming = reports.select("security", F.col("report_date").alias("next_date"), F.lit(1).alias("_one"))
    rows = calendar.asof(rows, coming, "security", "session", "next_date", ["_one"], forward=True).drop("_one")
    days = lambda a, b: F.coalesce(F.datediff(a, b), F.lit(9999))
    return rows.withColumns({"days_since": days("session", "report_date"), "days_to_next": days("next_date", "session"), "imminent": F.coalesce(F.datediff("next_date", "session") <= 14, F.lit(False))})


REPORTED = ["revenue_mean_2", "revenue_growth", "revenue_mean_growth", "revenue_acceleration"]
_OWN = "(PARTITION BY security ORDER BY report_date)"


@query(f"""{_REPORTS}, m AS (SELECT *, CASE WHEN count(revenue) OVER (PARTITION BY security ORDER BY report_date ROWS 1 PRECEDING) >= 2 THEN avg(revenue) OVER (PARTITION BY security ORDER BY report_date ROWS 1 PRECEDING) END AS revenue_mean_2 FROM reps),
g AS (SELECT *, (revenue - lag(revenue, 4) OVER {_OWN}) / nullif(abs(lag(revenue, 4) OVER {_OWN}), 0) AS revenue_growth,
  (revenue_mean_2 - lag(revenue_mean_2, 4) OVER {_OWN}) / nullif(abs(lag(revenue_mean_2, 4) OVER {_OWN}), 0) AS revenue_mean_growth FROM m),
a AS (SELECT *, revenue_mean_growth - lag(revenue_mean_growth) OVER {_OWN} AS revenue_acceleration FROM g) SELECT security, report_date, {_round_sql(REPORTED)} FROM a""")
def report_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(calendar.report_features(panel.reports(spark, sf_dir)), ["security", "report_date"], REPORTED)


@query(f"""{BARS}, x AS (SELECT security, session, lead(session, 63) OVER {W} AS available FROM bars), y AS (SELECT DISTINCT year(session) AS fold FROM bars),
p AS (SELECT fold, security, session, make_date(fold, 1, 1) AS d, make_date(fold - 1, 1, 1) AS e, available FROM x, y)
SELECT CAST(fold AS INT) AS fold, security, session, 'train' AS role FROM p WHERE available < e UNION ALL SELECT CAST(fold AS INT), security, session, 'validation' FROM p WHERE session >= e AND session < d AND available < d
UNION ALL SELECT CAST(fold AS INT), security, session, 'evaluation' FROM p WHERE year(session) = fold UNION ALL SELECT CAST(fold AS INT), security, session, 'bank' FROM p WHERE available < d""")
def fold_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.bars(spark, sf_dir).withColumn("available", F.lead("session", 63).over(by_time()))
    return calendar.folds(rows)


@query(f"{_NEAR} SELECT query_id, CAST(rank AS INT) AS rank, record_id, security, round(distance, 6) AS distance FROM n WHERE rank <= 25")
def knn_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(retrieval.nearest(retrieval.candidates(*_memory(spark, sf_dir), retrieval.Rules(k=25)), 25), ["query_id", "rank", "record_id", "security"], ["distance"])


@query(f"{_GREEDY} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) AS INT) AS rank, record_id, security, round(distance, 6) AS distance FROM k")
def constrained_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_constrained(spark, sf_dir), ["query_id", "rank", "record_id", "security"], ["distance"])


EVIDENCE = ["expected", "deviation", "p10", "p25", "p50", "p75", "p90", "trimmed_mean", "tail_mean", "effective_size", "agreement", "ci_low", "ci_high", "diversity"]


@query(f"""{_GREEDY}, d AS (SELECT *, greatest(sqrt(distance), 1e-9) AS dist FROM k), b AS (SELECT *, median(dist) OVER (PARTITION BY query_id) AS band FROM d),
w AS (SELECT *, exp(-0.5 * (dist / band) ** 2) AS raw, row_number() OVER (PARTITION BY query_id ORDER BY target, record_id) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM b),
v AS (SELECT *, raw / sum(raw) OVER (PARTITION BY query_id) AS wt FROM w), u AS (SELECT *, sum(wt * target) OVER (PARTITION BY query_id) AS mean FROM v),
h AS (SELECT query_id, -sum(s / t * log2(s / t)) AS h, count(*) AS m FROM (SELECT query_id, count(*) AS s, sum(count(*)) OVER (PARTITION BY query_id) AS t FROM k GROUP BY query_id, security) GROUP BY query_id),
e AS (SELECT query_id, count(*) AS neighbors, sum(wt * target) AS expected, sqrt(sum(wt * (target - mean) ** 2)) AS deviation, quantile_cont(target, 0.1) AS p10, quantile_cont(target, 0.25) AS p25, quantile_cont(target, 0.5) AS p50,
  quantile_cont(target, 0.75) AS p75, quantile_cont(target, 0.9) AS p90, avg(target) FILTER (place > floor(n * 0.1) AND place <= n - floor(n * 0.1)) AS trimmed_mean, avg(target) FILTER (place <= ceil(n * 0.25)) AS tail_mean,
  1 / sum(wt * wt) AS effective_size, abs(2 * coalesce(sum(wt) FILTER (target > 0), 0) - 1) AS agreement FROM u GROUP BY query_id),
z AS (SELECT e.*, m AS securities, expected - 1.96 * deviation / sqrt(greatest(effective_size, 1)) AS ci_low, expected + 1.96 * deviation / sqrt(greatest(effective_size, 1)) AS ci_high, CASE WHEN m > 1 THEN h / log2(m) ELSE 0 END AS diversity FROM e JOIN h USING (query_id) WHERE neighbors >= 5)
SELECT query_id, neighbors, securities, {_round_sql(EVIDENCE)} FROM z""")
def retrieval_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _constrained(spark, sf_dir)
    return _rounded(retrieval.evidence(found), ["query_id", "neighbors", "securities"], EVIDENCE)


@query(f"""{_GREEDY}, d AS (SELECT *, greatest(sqrt(distance), 1e-9) AS dist FROM k),
b AS (SELECT *, exp(-0.5 * (dist / greatest(median(dist) OVER (PARTITION BY query_id), 1e-9)) ** 2) * pow(2, -(query_id - record_id) / 126::DOUBLE) / count(*) OVER (PARTITION BY query_id, security) AS raw FROM d),
v AS (SELECT *, raw / sum(raw) OVER (PARTITION BY query_id) AS wt FROM b),
t AS (SELECT *, coalesce(sum(wt) OVER (PARTITION BY query_id ORDER BY target, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v)
SELECT query_id, count(*) AS neighbors, round(sum(wt * target), 6) AS expected, round(1 / sum(wt * wt), 6) AS effective_size, round(sum(greatest(0, least(wt, 0.25 - before)) * target) / 0.25, 6) AS tail_mean FROM t GROUP BY query_id""")
def prior_weighted_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _constrained(spark, sf_dir)
    rows = weighting.weighted_evidence(weighting.prior_weights(found, F.col("query_id") - F.col("ordinal"), 126.0))
    return _rounded(rows, ["query_id", "neighbors"], ["expected", "effective_size", "tail_mean"])


@query(f"""{_GREEDY}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) AS rank FROM k),
m AS (SELECT query_id, scale, avg(target) AS m, 1.96 * stddev_pop(target) / sqrt(count(target)) AS h FROM r, (SELECT unnest([10, 15, 25]) AS scale) WHERE rank <= scale GROUP BY 1, 2)
SELECT query_id, count(*) AS scales, round(median(m), 6) AS expected, round(abs(sum(sign(m))) / count(*), 6) AS sign_agreement, round(median(m) - 0.5 * stddev_pop(m), 6) AS penalized, round(min(m - h), 6) AS low, round(max(m + h), 6) AS high FROM m GROUP BY query_id""")
def multiscale_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weighting.multiscale(_constrained(spark, sf_dir))
    return _rounded(rows, ["query_id", "scales"], ["expected", "sign_agreement", "penalized", "low", "high"])


@query(_GREEDY.replace(_DISTANCE, "sha256(q.vec_id || ':7:' || m.vec_id)") + " SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) AS INT) AS rank, record_id, security FROM k")
def random_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weighting.shuffled(retrieval.candidates(*_memory(spark, sf_dir)), 7)
    return retrieval.constrained(found).select("query_id", "rank", "record_id", "security")


@query(f"""{_NEAR}, g AS (SELECT *, record_id - lag(record_id) OVER (PARTITION BY query_id, security ORDER BY record_id) AS gap FROM n WHERE rank <= 25)
SELECT 'maturity' AS rule, count(*) AS rows, count(*) FILTER (record_id + 63 > query_id) AS violations FROM g
UNION ALL SELECT 'own_security', count(*), count(*) FILTER (g.security = q.label) FROM g JOIN embeddings q ON q.vec_id = g.query_id
UNION ALL SELECT 'separation', count(*), count(*) FILTER (gap < 21) FROM g""")
def retrieval_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, memory = _memory(spark, sf_dir)
    return audits.retrieval_audit(retrieval.nearest(retrieval.candidates(asked, memory, retrieval.Rules(k=25)), 25), asked, memory)


@query("""WITH s AS (SELECT l_returnflag AS seed, CAST(l_shipdate AS DATE) AS session, l_suppkey AS security, avg(l_discount) - 0.05 AS score, min(l_tax) AS downside FROM lineitem GROUP BY 1, 2, 3)
SELECT session, security, round(median(score), 6) AS score, round(min(downside), 6) AS downside, round(stddev_pop(score), 6) AS dispersion, CAST(sum(CAST(score > 1e-9 AS INT)) AS BIGINT) AS votes, 2 * sum(CAST(score > 1e-9 AS INT)) > 3 AS majority FROM s GROUP BY 1, 2""")
def seed_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = panel.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("seed"), F.to_date("l_shipdate").alias("session"), F.col("l_suppkey").alias("security")).agg((F.avg("l_discount") - 0.05).alias("score"), F.min("l_tax").alias("downside"))
    signals = signals.withColumn("score", F.when(F.abs("score") <= 1e-9, 0.0).otherwise(F.col("score")))
    return retrieval.seed_consensus(signals, 3).withColumns({c: F.round(c, 6) for c in ("score", "downside", "dispersion")})


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = panel.table(spark, sf_dir, "orders")
    share = F.avg((F.col("o_orderstatus") == "F").cast("double"))
    return orders.groupBy(F.concat_ws("|", "o_orderpriority", F.year("o_orderdate")).alias("name")).agg(F.round(share / 10, 6).alias("p"))


@query("""WITH t AS (SELECT o_orderpriority || '|' || year(o_orderdate) AS name, round(avg(CAST(o_orderstatus = 'F' AS INT)) / 10, 6) AS p FROM orders GROUP BY 1),
r AS (SELECT name, p, least((count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p, 1) AS s, least(p * count(*) OVER () / row_number() OVER (ORDER BY p, name), 1) AS q FROM t)
SELECT name, p, round(max(s) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS p_holm, round(min(q) OVER (ORDER BY p, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS p_bh FROM r""")
def multiple_testing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inference.benjamini_hochberg(inference.holm(_tests(spark, sf_dir)))
    return _rounded(rows, ["name", "p"], ["p_holm", "p_bh"])


@query(f"""{_RETURNS} SELECT market, CAST(date_trunc('week', session) AS DATE) AS week, count(*) AS rows, round(sum(daily_return), 6) AS total, round(sum(daily_return * daily_return), 6) AS squares, round(sum(ln(1 + daily_return)), 6) AS logs FROM r WHERE daily_return IS NOT NULL GROUP BY 1, 2""")
def weekly_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(inference.weekly_statistics(_returns(spark, sf_dir), "market"), ["market", "week", "rows"], ["total", "squares", "logs"])


_BOOTSTRAP = f"""{_RETURNS}, w AS (SELECT row_number() OVER (ORDER BY week) - 1 AS week_number, rows, total FROM (SELECT date_trunc('week', session) AS week, count(*) AS rows, sum(daily_return) AS total FROM r WHERE daily_return IS NOT NULL GROUP BY 1)),
n AS (SELECT count(*) AS weeks, least(count(*), 4) AS block FROM w),
grid AS (SELECT d.draw, p.place, CAST(('0x' || substr(sha256(d.draw || ':' || p.place), 1, 8)) AS BIGINT) % (weeks - block + 1) AS start FROM n, (SELECT unnest(range(200)) AS draw) d, (SELECT unnest(range(CAST(ceil(weeks / block) AS BIGINT))) AS place FROM n) p),
b AS (SELECT draw, start + k AS week_number FROM grid, n, (SELECT unnest(range(4)) AS k) WHERE k < block AND place * block + k < weeks),
e AS (SELECT sum(total) / sum(rows) AS estimate FROM w), v AS (SELECT draw, sum(total) / sum(rows) AS value FROM b JOIN w USING (week_number) GROUP BY draw),
a AS (SELECT estimate, value, abs(value - estimate) AS away FROM v, e)
SELECT round(estimate, 6) AS estimate, count(*) AS draws, round(stddev_samp(value), 6) AS error, round(estimate - quantile_cont(away, 0.95), 6) AS low, round(estimate + quantile_cont(away, 0.95), 6) AS high,
  round((1 + count(*) FILTER (away >= abs(estimate))) / (1 + count(*)), 6) AS p FROM a GROUP BY estimate"""


@query(_BOOTSTRAP)
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = inference.weekly_statistics(_returns(spark, sf_dir).withColumn("all", F.lit(0)), "all")
    weekly = weekly.withColumn("week_number", (F.row_number().over(Window.orderBy("week")) - 1).cast("bigint"))  # a row per week
    weeks = weekly.count()
    found = inference.block_bootstrap(weekly, inference.block_draws(weeks, max(1, min(4, weeks)), 200, spark))
    return _rounded(found, ["draws"], ["estimate", "error", "low", "high", "p"])


@query(_BOOTSTRAP)
def block_bootstrap_all_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_bootstrap by the name that it had while that one stopped at 100 weeks."""
    return block_bootstrap(spark, sf_dir)


@query(f"""{BARS}, u AS (SELECT *, CAST(close > lag(close) OVER {W} AS INT) AS up FROM bars),
m AS (SELECT *, CASE WHEN up = lag(up) OVER {W} THEN 0 ELSE 1 END AS n FROM u WHERE up IS NOT NULL), r AS (SELECT *, sum(n) OVER {W} AS run FROM m),
s AS (SELECT count(*) AS duration, min(up) = 1 AS ended FROM r GROUP BY security, run), t AS (SELECT duration, count(*) AS leaving, count(*) FILTER (ended) AS events FROM s GROUP BY 1),
q AS (SELECT * FROM (SELECT *, sum(leaving) OVER (ORDER BY duration DESC) AS at_risk FROM t) WHERE events > 0),
k AS (SELECT duration, CAST(at_risk AS BIGINT) AS at_risk, events, exp(sum(ln(CASE WHEN at_risk > events THEN (at_risk - events) / at_risk END)) OVER (ORDER BY duration)) AS s0, max(CAST(at_risk = events AS INT)) OVER (ORDER BY duration) AS dead,
  coalesce(sum(events / nullif(CAST(at_risk AS DOUBLE) * (at_risk - events), 0)) OVER (ORDER BY duration), 0) AS g FROM q)
SELECT duration, at_risk, events, round(CASE WHEN dead = 1 THEN 0 ELSE s0 END, 6) AS survival, round(CASE WHEN dead = 1 THEN 0 ELSE s0 * s0 * g END, 9) AS variance FROM k""")
def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = features.islands(panel.bars(spark, sf_dir))
    spells = runs.select(F.col("rows").alias("duration"), (F.col("up") == 1).alias("ended"))
    return inference.kaplan_meier(spells).withColumns({"survival": F.round("survival", 6), "variance": F.round("variance", 9)})


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS rows, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS hundredths FROM events GROUP BY 1, 2""")
def event_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream of events gives once all of them have come."""
    return activity(panel.table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


from retroscope.plans import analytics, baselines, cleaning, cycles, decisions, diagnostics, evidence, metric, metrics, models, resampling, selection, states  # noqa: E402, F401  (they register their queries)
