"""Queries of resampling, folds, weights and integrity audits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retroscope.functions.windows import by_time
from retroscope.operators import audits, calendar, confidence, inference, resampling
from retroscope.plans.common import BARS, RETURNS, W, query, returns, round_sql, rounded_rows
from retroscope.plans.neighbors import GREEDY, constrained
from retroscope.sources import panel

_CLIP = "greatest(-0.05, least(0.05, daily_return))"
_PAIR = f"{RETURNS}, pair AS (SELECT session, avg({_CLIP}) AS a, avg({_CLIP}) FILTER (security % 2 = 0) AS b FROM r WHERE daily_return IS NOT NULL GROUP BY 1), ser AS (SELECT *, row_number() OVER (ORDER BY session) - 1 AS position, count(*) OVER () AS n FROM pair WHERE b IS NOT NULL)"


def _clipped() -> F.Column:
    return F.greatest(F.lit(-0.05), F.least(F.lit(0.05), F.col("daily_return")))


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = returns(spark, sf_dir).where("daily_return is not null")
    daily = rows.groupBy("session").agg(F.avg(_clipped()).alias("a"), F.avg(F.when(F.col("security") % 2 == 0, _clipped())).alias("b"))
    return resampling.numbered(daily.where("b is not null"), "session")


def _hash(n: str, *parts: str) -> str:
    return f"CAST(('0x' || substr(sha256(concat_ws(':', {', '.join(parts)})), 1, 8)) AS BIGINT) % ({n})"


_SH = "CASE WHEN stddev_samp({0}) <= 1e-12 THEN 0 ELSE avg({0}) / stddev_samp({0}) * sqrt(252) END"
_DELTA = f"(avg(a) - avg(b)) * 252 AS annualized_return, {_SH.format('a')} - {_SH.format('b')} AS sharpe"
_CI = "any_value(observed) AS observed, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high, avg(CAST(v > 0 AS INT)) AS positive, (1 + count(*) FILTER (abs(v - observed) >= abs(observed))) / (1 + count(*)) AS p"
_LONG = "SELECT {0} 'annualized_return' AS metric, annualized_return AS {1} FROM {2} UNION ALL SELECT {0} 'sharpe', sharpe FROM {2}"
_BLOCKS, _DRAWS = (5, 21, 63), 100
_CIRCULAR = " UNION ALL ".join(
    f"SELECT {k} AS block, draw, (start + k) % n AS position FROM (SELECT d.draw, p.place, n, least({k}, n) AS size, {_hash('n', str(k), 'd.draw', 'p.place')} AS start FROM nn, (SELECT unnest(range({_DRAWS})) AS draw) d, LATERAL (SELECT unnest(range(CAST(ceil(n / least({k}, n)) AS BIGINT))) AS place) p), (SELECT unnest(range({k})) AS k) WHERE k < size AND place * size + k < n"
    for k in _BLOCKS
)


@query(f"""{_PAIR}, nn AS (SELECT any_value(n) AS n FROM ser), dr AS ({_CIRCULAR}), ob AS (SELECT {_DELTA} FROM ser), vv AS (SELECT block, draw, {_DELTA} FROM dr JOIN ser USING (position) GROUP BY 1, 2),
ol AS ({_LONG.format('', 'observed', 'ob')}), vl AS ({_LONG.format('block,', 'v', 'vv')}), ci AS (SELECT block, metric, {_CI} FROM vl JOIN ol USING (metric) GROUP BY 1, 2),
pr AS (SELECT *, row_number() OVER (ORDER BY p, metric || '|' || block) AS k, count(*) OVER () AS m, metric || '|' || block AS name FROM ci)
SELECT CAST(block AS INT) AS block, metric, {round_sql(['observed', 'low', 'high', 'positive', 'p'])}, round(max(least(1, (m - k + 1) * p)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 6) AS p_holm, round(min(least(1, p * m / k)) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS p_bh FROM pr""")
def circular_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired differences of two portfolios under circular blocks of three lengths, corrected for the number of tests."""
    series = _pair(spark, sf_dir)
    n, out = series.agg(F.max("n").alias("n")), None
    point = resampling.paired_deltas(series, [])
    for block in _BLOCKS:
        drawn = resampling.circular_draws(n, block, _DRAWS).join(F.broadcast(series.drop("n")), "position")
        part = resampling.spread(resampling.paired_deltas(drawn, ["draw"]), point, ["annualized_return", "sharpe"], []).withColumn("block", F.lit(block))
        out = part if out is None else out.unionByName(part)
    tests = out.withColumn("name", F.concat_ws("|", "metric", "block"))
    rows = inference.benjamini_hochberg(inference.holm(tests))
    return rounded_rows(rows, ["block", "metric"], ["observed", "low", "high", "positive", "p", "p_holm", "p_bh"])


@query(f"""{_PAIR}, nn AS (SELECT any_value(n) AS n FROM ser), gr AS (SELECT draw, place, n, place = 0 OR {_hash('1000000', "'r'", 'draw', 'place')} < {1_000_000 // 21} AS anew FROM nn, (SELECT unnest(range({_DRAWS})) AS draw), LATERAL (SELECT unnest(range(n)) AS place)),
la AS (SELECT *, max(CASE WHEN anew THEN place END) OVER (PARTITION BY draw ORDER BY place) AS last FROM gr), dr AS (SELECT draw, ({_hash('n', "'s'", 'draw', 'last')} + place - last) % n AS position FROM la),
ob AS (SELECT avg(a - b) AS observed FROM ser), vv AS (SELECT draw, avg(a - b) AS v FROM dr JOIN ser USING (position) GROUP BY 1)
SELECT 'mean' AS metric, round(any_value(observed), 8) AS observed, round(quantile_cont(v, 0.025), 8) AS low, round(quantile_cont(v, 0.975), 8) AS high, round(avg(CAST(v > 0 AS INT)), 8) AS positive, round((1 + count(*) FILTER (abs(v - observed) >= abs(observed))) / (1 + count(*)), 8) AS p FROM vv, ob""")
def stationary_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = _pair(spark, sf_dir)
    drawn = resampling.stationary_draws(series.agg(F.max("n").alias("n")), 21, _DRAWS).join(F.broadcast(series.drop("n")), "position")
    mean = lambda df, by: df.groupBy(*by).agg(F.avg(F.col("a") - F.col("b")).alias("mean"))
    rows = resampling.spread(mean(drawn, ["draw"]), mean(series, []), ["mean"], [])
    return rounded_rows(rows, ["metric"], ["observed", "low", "high", "positive", "p"], 8)


@query(f"""{RETURNS}, m AS (SELECT market, session, avg({_CLIP}) AS a, avg({_CLIP}) FILTER (security % 2 = 0) AS b FROM r WHERE daily_return IS NOT NULL GROUP BY 1, 2),
d AS (SELECT market AS name, {_SH.format('a')} - {_SH.format('b')} AS delta FROM m WHERE b IS NOT NULL GROUP BY 1), e AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS position, count(*) OVER () AS n FROM d WHERE delta IS NOT NULL),
g AS (SELECT draw, {_hash('n', "'c'", 'draw', 'e.position')} AS position FROM e, (SELECT unnest(range({_DRAWS})) AS draw)), v AS (SELECT draw, median(delta) AS v FROM g JOIN e USING (position) GROUP BY 1), o AS (SELECT median(delta) AS observed, count(*) AS markets FROM e)
SELECT any_value(markets) AS markets, round(any_value(observed), 6) AS observed, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(avg(CAST(v > 0 AS INT)), 6) AS positive FROM v, o""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = returns(spark, sf_dir).where("daily_return is not null").groupBy("market", "session").agg(F.avg(_clipped()).alias("a"), F.avg(F.when(F.col("security") % 2 == 0, _clipped())).alias("b"))
    deltas = rows.where("b is not null").groupBy(F.col("market").alias("name")).agg((resampling.sharpe("a") - resampling.sharpe("b")).alias("delta")).where("delta is not null")
    point = deltas.agg(F.median("delta").alias("observed"), F.count("*").alias("markets"))
    draws = resampling.cluster_draws(deltas, _DRAWS).crossJoin(F.broadcast(point))
    out = draws.groupBy("markets", "observed").agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.avg((F.col("value") > 0).cast("double")).alias("positive"))
    return rounded_rows(out, ["markets"], ["observed", "low", "high", "positive"])


_WEEKS = f"""{RETURNS}, wk AS (SELECT year(session) AS year, date_trunc('week', session) AS week, count(*) AS rows, sum({_CLIP}) AS total, sum({_CLIP} * {_CLIP}) AS squares, sum(ln(1 + {_CLIP})) AS logs FROM r WHERE daily_return IS NOT NULL GROUP BY 1, 2),
wn AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY week) - 1 AS week_number, count(*) OVER (PARTITION BY year) AS n FROM wk), yy AS (SELECT year, any_value(n) AS n FROM wn GROUP BY 1)"""
_FROM_SUMS = "sum(total) / sum(rows) AS mean, CASE WHEN sqrt(greatest(0, sum(squares) / sum(rows) - (sum(total) / sum(rows)) ** 2)) > 1e-12 THEN sum(total) / sum(rows) / sqrt(greatest(0, sum(squares) / sum(rows) - (sum(total) / sum(rows)) ** 2)) * sqrt(252) ELSE 0 END AS sharpe, sum(logs) / sum(rows) * 252 AS log_return"
_YEARLY = " UNION ALL ".join(
    f"SELECT {k} AS block, draw, year, start + k AS week_number FROM (SELECT d.draw, year, p.place, n, CASE WHEN n <= {k} THEN 1 ELSE {k} END AS size, {_hash(f'n - CASE WHEN n <= {k} THEN 1 ELSE {k} END + 1', str(k), 'd.draw', 'year', 'p.place')} AS start FROM yy, (SELECT unnest(range({_DRAWS})) AS draw) d, LATERAL (SELECT unnest(range(CAST(ceil(n / CASE WHEN n <= {k} THEN 1 ELSE {k} END) AS BIGINT))) AS place) p), (SELECT unnest(range({k})) AS k) WHERE k < size AND place * size + k < n"
    for k in (2, 4, 8)
)
_LONG3 = " UNION ALL ".join("SELECT {0} '" + m + "' AS metric, " + m + " AS {1} FROM {2}" for m in ("mean", "sharpe", "log_return"))


@query(f"""{_WEEKS}, dr AS ({_YEARLY}), ob AS (SELECT {_FROM_SUMS} FROM wn), vv AS (SELECT block, draw, {_FROM_SUMS} FROM dr JOIN wn USING (year, week_number) GROUP BY 1, 2), ol AS ({_LONG3.format('', 'observed', 'ob')}), vl AS ({_LONG3.format('block,', 'v', 'vv')}),
ci AS (SELECT block, metric, {_CI} FROM vl JOIN ol USING (metric) GROUP BY 1, 2) SELECT CAST(block AS INT) AS block, metric, {round_sql(['observed', 'low', 'high', 'positive', 'p'])} FROM ci""")
def yearly_week_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks drawn in blocks of 2, 4 and 8 within their year; all measures come from weekly sums."""
    r = _clipped()
    rows = returns(spark, sf_dir).where("daily_return is not null")
    weekly = rows.groupBy(F.year("session").alias("year"), F.date_trunc("week", "session").alias("week")).agg(F.count("*").alias("rows"), F.sum(r).alias("total"), F.sum(r * r).alias("squares"), F.sum(F.log1p(r)).alias("logs"))
    weekly = weekly.withColumn("week_number", (F.row_number().over(Window.partitionBy("year").orderBy("week")) - 1).cast("bigint"))
    point, out = resampling.from_sums(weekly, []), None
    for block in (2, 4, 8):
        drawn = resampling.yearly_draws(weekly.select("year", "week_number"), block, _DRAWS).join(F.broadcast(weekly), ["year", "week_number"])
        part = resampling.spread(resampling.from_sums(drawn, ["draw"]), point, ["mean", "sharpe", "log_return"], []).withColumn("block", F.lit(block))
        out = part if out is None else out.unionByName(part)
    return rounded_rows(out, ["block", "metric"], ["observed", "low", "high", "positive", "p"])


_ARMS = [f"s{i}" for i in range(5)]
_MATRIX = f"{RETURNS}, mx AS (SELECT session, {', '.join(f'coalesce(avg({_CLIP}) FILTER (security % 5 = {i}), 0) AS s{i}' for i in range(5))} FROM r WHERE daily_return IS NOT NULL GROUP BY 1), ps AS (SELECT *, row_number() OVER (ORDER BY session) - 1 AS position, count(*) OVER () AS n FROM mx)"
_HALVES = ", ".join(f"({k}, {b}, {str(b in half).lower()})" for k, half in enumerate(combinations(range(8), 4)) for b in range(8))


@query(f"""{_MATRIX}, bl AS (SELECT CASE WHEN position < (n % 8) * (n // 8 + 1) THEN position // (n // 8 + 1) ELSE n % 8 + (position - (n % 8) * (n // 8 + 1)) // (n // 8) END AS block, {', '.join(_ARMS)} FROM ps),
lg AS ({" UNION ALL ".join(f"SELECT block, {i} AS i, s{i} AS v FROM bl" for i in range(5))}), sm AS (SELECT block, i, count(*) AS c, sum(v) AS s, sum(v * v) AS q FROM lg GROUP BY 1, 2), ch AS (SELECT * FROM (VALUES {_HALVES}) AS t(split, block, inside)),
bo AS (SELECT split, inside, i, sum(c) AS c, sum(s) AS s, sum(q) AS q FROM sm JOIN ch USING (block) GROUP BY 1, 2, 3),
sc AS (SELECT *, round(CASE WHEN sqrt(greatest(0, (q - s * s / c) / (c - 1))) > 1e-12 THEN s / c / sqrt(greatest(0, (q - s * s / c) / (c - 1))) ELSE '-inf'::DOUBLE END, 9) AS r FROM bo),
wi AS (SELECT split, i AS winner FROM sc WHERE inside QUALIFY row_number() OVER (PARTITION BY split ORDER BY r DESC, i) = 1), ow AS (SELECT sc.split, sc.r AS own FROM sc JOIN wi ON wi.split = sc.split AND wi.winner = sc.i WHERE NOT inside),
rk AS (SELECT split, avg(CAST(r <= own AS INT)) AS rank FROM sc JOIN ow USING (split) WHERE NOT inside GROUP BY 1)
SELECT count(*) AS splits, round(avg(CAST(rank <= 0.5 AS INT)), 6) AS probability, round(avg(rank), 6) AS mean_rank FROM rk""")
def backtest_overfitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = returns(spark, sf_dir).where("daily_return is not null")
    matrix = rows.groupBy("session").agg(*(F.coalesce(F.avg(F.when(F.col("security") % 5 == i, _clipped())), F.lit(0.0)).alias(s) for i, s in enumerate(_ARMS)))
    return rounded_rows(resampling.overfitting(resampling.numbered(matrix, "session"), _ARMS), ["splits"], ["probability", "mean_rank"])


_BEST = resampling.expected_best(10)
_CDF = "exp(-statistic * statistic / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))"


@query(f"""{RETURNS}, d AS (SELECT market, session, avg({_CLIP}) AS v FROM r WHERE daily_return IS NOT NULL GROUP BY 1, 2), m AS (SELECT market, count(*)::DOUBLE AS n, avg(v) AS m, stddev_samp(v) AS s, stddev_pop(v) AS p FROM d GROUP BY 1),
h AS (SELECT market, any_value(n) AS n, any_value(m / s) AS daily_sharpe, avg((v - m) ** 3) / any_value(p) ** 3 AS g, avg((v - m) ** 4) / any_value(p) ** 4 - 3 AS k FROM d JOIN m USING (market) WHERE n > 3 AND s > 1e-12 GROUP BY 1),
a AS (SELECT *, sqrt(n * (n - 1)) / (n - 2) * g AS skew, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6) + 3 AS kurt FROM h),
z AS (SELECT *, (daily_sharpe - {_BEST!r}::DOUBLE / sqrt(n - 1)) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * daily_sharpe + (kurt - 1) / 4 * daily_sharpe * daily_sharpe)) AS statistic FROM a), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(statistic)) AS t FROM z)
SELECT market, round(daily_sharpe, 6) AS daily_sharpe, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(statistic, 6) AS statistic, round(CASE WHEN statistic >= 0 THEN 1 - {_CDF} ELSE {_CDF} END, 6) AS probability FROM t""")
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = returns(spark, sf_dir).where("daily_return is not null").groupBy("market", "session").agg(F.avg(_clipped()).alias("v"))
    return rounded_rows(resampling.deflated_sharpe(daily, "market", "v", 10), ["market"], ["daily_sharpe", "skew", "kurt", "statistic", "probability"])


@query(f"""{BARS}, x AS (SELECT security, session, lead(session, 63) OVER {W} AS available, lead(session, 126) OVER {W} AS matures FROM bars), y AS (SELECT DISTINCT year(session) AS fold FROM bars),
p AS (SELECT CAST(fold AS INT) AS fold, session, available, matures, make_date(fold - 2, 1, 1) AS v, make_date(fold - 1, 1, 1) AS d, make_date(fold, 1, 1) AS e, make_date(fold + 1, 1, 1) AS f FROM x, y)
SELECT fold, count(*) FILTER (session < v AND available < v) AS train, count(*) FILTER (session >= v AND session < d AND available < d) AS validation, count(*) FILTER (session >= d AND session < e AND available < e) AS development,
  count(*) FILTER (session >= e AND session < f) AS evaluation, count(*) FILTER (session < v AND matures < v) AS bank FROM p GROUP BY fold""")
def fold_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each role in the fold of each year there is: train to three years before, validation two, development one
    year before, evaluation the year itself, and the bank of what is mature by then."""
    rows = panel.bars(spark, sf_dir).select("security", "session", F.lead("session", 63).over(by_time()).alias("available"), F.lead("session", 126).over(by_time()).alias("matures"))
    return calendar.fold_manifest(rows)


@query(f"""{BARS}, y AS (SELECT CAST(min(year(session)) AS INT) AS a, CAST(max(year(session)) AS INT) AS b FROM bars), s AS (SELECT CAST(unnest(generate_series(a, b, 1)) AS INT) AS start, b FROM y)
SELECT start AS train_from, start + 2 AS train_to, start + 3 AS validation_year, start + 4 AS test_year FROM s WHERE start + 4 <= b""")
def walk_forward_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar.walk_forward(panel.bars(spark, sf_dir), 3, 1, 1, 1)
    return rows.select("train_from", "train_to", F.col("validation_to").alias("validation_year"), F.col("test_to").alias("test_year"))


@query(f"""{RETURNS}, x AS (SELECT security, session, market, CASE WHEN future > 0.2 THEN 1 WHEN future > 0 THEN 2 WHEN future < -0.2 THEN 3 ELSE 0 END AS class, ordinal >= 20 AS seen, future IS NOT NULL AS known FROM r),
a AS (SELECT *, CASE WHEN NOT seen THEN 'short_history' WHEN NOT known AND year(session) < 1998 THEN 'no_target' END AS reason FROM x), k AS (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY market) AS nm, count(*) OVER (PARTITION BY class) AS nc FROM a WHERE reason IS NULL),
m AS (SELECT count(DISTINCT market) AS markets, count(DISTINCT class) AS classes FROM k)
SELECT market, class, count(*) AS rows, round(any_value(n / (markets * nm)), 6) AS market_weight, round(any_value(n / (classes * nc)), 6) AS class_weight FROM k, m GROUP BY market, class""")
def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the admitted rows: weights that give each market, or each class, the same total."""
    x = F.col("future")
    rows = returns(spark, sf_dir).withColumns({"class": F.when(x > 0.2, 1).when(x > 0, 2).when(x < -0.2, 3).otherwise(0), "seen": F.col("ordinal") >= 20})
    admitted = calendar.admitted(rows, F.col("seen"), x.isNotNull(), F.year("session") >= 1998).where("reason is null")
    counts = admitted.groupBy("market", "class").agg(F.count("*").alias("rows"))  # a handful
    weigh = lambda by: F.sum("rows").over(Window.partitionBy()) / (F.size(F.collect_set(by).over(Window.partitionBy())) * F.sum("rows").over(Window.partitionBy(by)))
    return counts.select("market", "class", "rows", F.round(weigh("market"), 6).alias("market_weight"), F.round(weigh("class"), 6).alias("class_weight"))


@query(f"""{RETURNS}, x AS (SELECT security, session, market, CASE WHEN ordinal < 20 THEN 'short_history' WHEN future IS NULL AND year(session) < 1998 THEN 'no_target' END AS reason FROM r)
SELECT market, coalesce(reason, 'admitted') AS reason, count(*) AS rows, min(security || '_' || session) AS first_id FROM x GROUP BY 1, 2""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar.admitted(returns(spark, sf_dir), F.col("ordinal") >= 20, F.col("future").isNotNull(), F.year("session") >= 1998)
    return rows.groupBy("market", F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count("*").alias("rows"), F.min(F.concat_ws("_", "security", "session")).alias("first_id"))


@query(f"""SELECT 'weights' AS rule, count(*) AS evaluated, count(*) FILTER (abs(s - 1) >= 1e-8 OR lowest < 0) AS violations FROM ({GREEDY}, g AS (SELECT query_id, 1 / greatest(sqrt(distance), 1e-9) AS i FROM k), w AS (SELECT query_id, i / sum(i) OVER (PARTITION BY query_id) AS w FROM g) SELECT query_id, sum(w) AS s, min(w) AS lowest FROM w GROUP BY 1)
UNION ALL SELECT 'fill_after_signal', count(*), count(*) FILTER (filled <= session) FROM ({BARS} SELECT session, lead(session) OVER {W} AS filled FROM bars QUALIFY filled IS NOT NULL)
UNION ALL SELECT 'label_maturity', count(*), count(*) FILTER (available IS NULL OR available > DATE '1996-12-31') FROM ({BARS}, l AS (SELECT session, lead(session, 21) OVER {W} AS available FROM bars) SELECT * FROM l WHERE session <= DATE '1996-12-31')
UNION ALL SELECT 'scaler_isolation', count(*), count(*) FILTER (NOT train) + count(*) FILTER (evaluated) FROM ({BARS} SELECT session, bool_or(session < DATE '1996-06-30') AS train, bool_or(session >= DATE '1996-06-15') AS evaluated FROM bars WHERE session < DATE '1996-07-05' GROUP BY session)
UNION ALL SELECT 'expected_grid', count(*), count(*) FILTER (n = 0) FROM ({RETURNS}, y AS (SELECT DISTINCT year(session) AS year FROM bars), g AS (SELECT security, year FROM (SELECT DISTINCT security FROM bars), y) SELECT g.security, g.year, count(b.session) AS n FROM g LEFT JOIN bars b ON b.security = g.security AND year(b.session) = g.year GROUP BY 1, 2)""")
def integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that don't add up, fills not after their signal, labels not known by the cut-off, scaler dates that are no
    training dates or evaluation dates, and cells of the expected grid of securities and years without a row."""
    bars = panel.bars(spark, sf_dir)
    day = lambda d: F.lit(d).cast("date")
    weights = confidence.distance_weights(constrained(spark, sf_dir)).withColumnRenamed("inverse", "weight")
    fills = bars.select("session", F.lead("session", 1).over(by_time()).alias("filled")).where("filled is not null")
    labels = bars.select("session", F.lead("session", 21).over(by_time()).alias("available")).where(F.col("session") <= day("1996-12-31"))
    sessions = bars.select("session").distinct()
    train, fitted, evaluated = sessions.where(F.col("session") < day("1996-06-30")), sessions.where(F.col("session") < day("1996-07-05")), sessions.where(F.col("session") >= day("1996-06-15"))
    cells = bars.select("security", F.year("session").alias("year")).distinct()
    grid = bars.select("security").distinct().crossJoin(F.broadcast(bars.select(F.year("session").alias("year")).distinct()))  # securities x years
    parts = [audits.weights(weights), audits.fills(fills), audits.maturity(labels, day("1996-12-31")), audits.isolation(train, fitted, evaluated), audits.grid(grid, cells)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
