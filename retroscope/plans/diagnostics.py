"""Queries of diagnostics of decisions: features with their validity, folds, classes, gates, trades, portfolios, regret and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retroscope.functions.stored import place
from retroscope.functions.windows import by_time
from retroscope.operators import confidence, diagnostics, features, labels, replay, resampling, retrieval
from retroscope.plans.common import BARS, RETURNS, W, full, over, query, rank, returns, rounded_rows
from retroscope.plans.cycles import _DETECTED, _EVENTS, _detected, walk
from retroscope.plans.neighbors import GREEDY, constrained, memory
from retroscope.plans.resampling import _PAIR, _hash, _pair
from retroscope.sources import panel

_OWN = W
_EMA = "list_reduce(list_prepend({0}[1], {0}), lambda a, x: a + (x - a) * {1}::DOUBLE)"
_MEAN = lambda k: full("avg", "close", k)
_CONTRACT_SQL = f"""{BARS}, s1 AS (SELECT *, close - lag(close) OVER {_OWN} AS d, close / lag(close) OVER {_OWN} - 1 AS r, lag(close) OVER {_OWN} AS before, list(close) OVER (PARTITION BY security ORDER BY session ROWS UNBOUNDED PRECEDING) AS cl FROM bars),
s2 AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0 END AS loss, CASE WHEN d > 0 THEN volume ELSE 0 END AS up, CASE WHEN d < 0 THEN volume ELSE 0 END AS down, greatest(high - low, coalesce(abs(high - before), 0), coalesce(abs(low - before), 0)) AS reach,
  {_EMA.format('cl', 2 / 13)} - {_EMA.format('cl', 2 / 27)} AS line FROM s1),
s3 AS (SELECT * EXCLUDE (cl), {_MEAN(200)} AS m200, list(line) OVER (PARTITION BY security ORDER BY session ROWS UNBOUNDED PRECEDING) AS ll FROM s2),
f AS (SELECT security, session, ordinal, r AS return_1, {", ".join(f"close / lag(close, {k}) OVER {_OWN} - 1 AS momentum_{k}" for k in (3, 10, 21))}, {full('stddev_samp', 'r', 21)} AS volatility_21, {full('avg', 'volume', 21)} AS volume_mean_21, volume / ({full('avg', 'volume', 21)} + 1e-9) AS volume_ratio_21,
  CASE WHEN ordinal = 0 THEN NULL WHEN lag(volume) OVER {_OWN} = 0 THEN 0 ELSE volume / lag(volume) OVER {_OWN} - 1 END AS volume_change_1, (high - low) / (close + 1e-9) AS intraday_range, (close - {full('max', 'close', 252)}) / ({full('max', 'close', 252)} + 1e-9) AS drawdown_252,
  ({" + ".join(f"lag(close, {k}) OVER {_OWN} * {10 - k}" for k in range(21))}) / 770 / (close + 1e-9) AS trend_slope_21, {", ".join(f"close / {_MEAN(k)} - 1 AS close_vs_mean_{k}" for k in (50, 150, 200))}, (m200 - lag(m200, 20) OVER {_OWN}) / (lag(m200, 20) OVER {_OWN} + 1e-9) AS mean_200_trend_20,
  (close - {full('min', 'close', 252)}) / ({full('min', 'close', 252)} + 1e-9) AS above_low_252, (close - {full('max', 'close', 252)}) / ({full('max', 'close', 252)} + 1e-9) AS from_high_252, CASE WHEN ordinal >= 50 THEN sum(up) {over(50)} / (sum(down) {over(50)} + 1e-9) END AS up_down_volume_50,
  CASE WHEN ordinal >= 14 THEN CASE WHEN sum(gain) {over(14)} = 0 AND sum(loss) {over(14)} = 0 THEN 0.5 ELSE avg(gain) {over(14)} / (avg(gain) {over(14)} + avg(loss) {over(14)} + 1e-9) END END AS rsi_14, {full('avg', 'reach', 14)} / (close + 1e-9) AS atr_ratio_14,
  CASE WHEN ordinal >= 33 THEN (line - {_EMA.format('ll', 2 / 10)}) / (close + 1e-9) END AS macd_signal_diff, 4 * {full('stddev_samp', 'close', 20)} / ({full('avg', 'close', 20)} + 1e-9) AS bollinger_width_20, {full('stddev_samp', 'r', 63)} / ({full('stddev_samp', 'r', 21)} + 1e-9) AS vol_ratio_63_21 FROM s3),
v AS (SELECT *, ordinal >= 251 AND {" AND ".join(f"coalesce(isfinite({c}), false)" for c in diagnostics.CONTRACT)} AS valid FROM f)"""


@query(f"""{_CONTRACT_SQL} SELECT security, CAST(year(session) AS INT) AS year, count(*) AS rows, count(*) FILTER (valid) AS valid, {", ".join(f"round(avg({c}), 6) AS {c}" for c in diagnostics.CONTRACT)} FROM v GROUP BY 1, 2""")
def contract_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 23 features of the second family per security and year: rows, rows with a whole warm-up, and means."""
    rows = diagnostics.contract_features(panel.bars(spark, sf_dir))
    return rows.groupBy("security", F.year("session").alias("year")).agg(F.count("*").alias("rows"), F.sum("valid").cast("bigint").alias("valid"), *(F.round(F.avg(c), 6).alias(c) for c in diagnostics.CONTRACT))


_ROLES = {"train": "session <= e3 AND known <= e3", "bank": "session <= e3 AND path <= e3", "validation": "year(session) = fold - 2 AND known <= make_date(fold - 2, 12, 31)", "development": "year(session) = fold - 1 AND known <= make_date(fold - 1, 12, 31)", "evaluation": "year(session) = fold"}


@query(f"""{BARS}, k AS (SELECT security, session, lead(session, 21) OVER {W} AS known, lead(session, 42) OVER {W} AS path FROM bars), y AS (SELECT DISTINCT year(session) AS fold FROM bars), p AS (SELECT *, make_date(fold - 3, 12, 31) AS e3 FROM k, y)
{" UNION ALL ".join(f"SELECT CAST(fold AS INT) AS fold, '{r}' AS role, count(*) AS rows, min(session) AS first, max(session) AS last FROM p WHERE {c} GROUP BY 1" for r, c in _ROLES.items())}""")
def fold_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training, validation, development, evaluation and bank rows of each year's fold."""
    rows = panel.bars(spark, sf_dir).withColumns({"available": F.lead("session", 21).over(by_time()), "available_path": F.lead("session", 42).over(by_time())})
    return diagnostics.fold_partitions(rows).groupBy("fold", "role").agg(F.count("*").alias("rows"), F.min("session").alias("first"), F.max("session").alias("last"))


_CLASS = 'CASE event WHEN \'none\' THEN 0 WHEN \'upside\' THEN 1 ELSE 4 END + CASE WHEN event = \'none\' THEN 0 ELSE CAST("offset" > 21 AS INT) + CAST("offset" > 42 AS INT) END'
_CHANCES = {f"{kind}_{i}": (first, i) for kind, first in (("rise", 1), ("fall", 4)) for i in (1, 2, 3)}


@query(f"""{_EVENTS}, e1 AS (SELECT security, session, {_CLASS} AS class, event = 'none' AND coalesce(len(ahead), 0) < 63 AS immature, CAST(volume AS BIGINT) % 3 AS lean FROM eo), e2 AS (SELECT *, coalesce(lag(class, 63) OVER {W}, 0) AS predicted FROM e1),
e3 AS (SELECT class AS actual, predicted, {", ".join(f"CASE WHEN predicted BETWEEN {a} AND {a + i - 1} THEN 0.7 ELSE 0.1 END + {0.02 * i} * (lean - 0.5) AS {n}" for n, (a, i) in _CHANCES.items())} FROM e2 WHERE NOT immature),
a AS (SELECT actual AS class, count(*) AS actual, count(*) FILTER (actual = predicted) AS hits FROM e3 GROUP BY 1), p AS (SELECT predicted AS class, count(*) AS predicted FROM e3 GROUP BY 1), q AS (SELECT hits / actual AS recall, coalesce(hits / predicted, 0) AS precision FROM a LEFT JOIN p USING (class)),
b AS (SELECT CASE WHEN actual = 0 THEN 3 WHEN actual <= 3 THEN actual - 1 ELSE actual - 4 END AS ab, CASE WHEN predicted = 0 THEN 3 WHEN predicted <= 3 THEN predicted - 1 ELSE predicted - 4 END AS pb, * FROM e3)
SELECT count(*) AS rows, round(avg(CAST(actual = predicted AS INT)), 6) AS accuracy, round(avg(CAST(actual = 0 AS INT)), 6) AS none_rate, round(avg(CAST(predicted = 0 AS INT)), 6) AS predicted_none_rate, count(DISTINCT predicted) AS predicted_classes,
  round(avg(({" + ".join(f"({n} - CAST(actual BETWEEN {a} AND {a + i - 1} AS INT)) ** 2" for n, (a, i) in _CHANCES.items())}) / 6), 6) AS brier, round(avg(({" + ".join(f"CAST({k}_{i + 1} - {k}_{i} < -1e-7 AS INT)" for k in ("rise", "fall") for i in (1, 2))}) / 2.0), 6) AS violations,
  round(avg(abs(ab - pb)) FILTER (actual <> 0), 6) AS bucket_error, (SELECT round(avg(recall), 6) FROM q) AS balanced_accuracy, (SELECT round(avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END), 6) FROM q) AS macro_f1 FROM b""")
def event_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the class of an event three months ago foretells that of today's, with chances that lean on it."""
    prices = walk(spark, sf_dir)
    rows = labels.event_labels(prices).join(prices.select("security", "session", (F.col("volume").cast("bigint") % 3).alias("lean")), ["security", "session"])
    rows = rows.withColumn("predicted", F.coalesce(F.lag("class", 63).over(by_time()), F.lit(0))).where("not immature").withColumnRenamed("class", "actual")
    rows = rows.withColumns({n: F.when(F.col("predicted").between(a, a + i - 1), 0.7).otherwise(0.1) + 0.02 * i * (F.col("lean") - 0.5) for n, (a, i) in _CHANCES.items()})
    names = ["accuracy", "none_rate", "predicted_none_rate", "brier", "violations", "bucket_error", "balanced_accuracy", "macro_f1"]
    return rounded_rows(diagnostics.class_quality(rows, 3), ["rows", "predicted_classes"], names)


_KNOWN = f"{RETURNS}, x AS (SELECT security, market, session, volume, momentum, daily_return, future FROM r WHERE momentum IS NOT NULL AND daily_return IS NOT NULL AND future IS NOT NULL)"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir).where("momentum is not null and daily_return is not null and future is not null")


@query(f"""{_KNOWN}, g AS (SELECT least(1, greatest(0, CAST(volume AS BIGINT) % 21 / 20.0::DOUBLE)) AS gate, momentum AS base, daily_return AS memory, future AS y FROM x), e AS (SELECT *, (y - base) ** 2 AS b, (y - memory) ** 2 AS m, (y - ((1 - gate) * base + gate * memory)) ** 2 AS mx FROM g)
SELECT CAST(greatest(ceil(gate * 5) - 1, 0) AS INT) AS bin, count(*) AS rows, round(avg(gate), 6) AS mean_gate, round(avg(b - m), 6) AS advantage, round(avg(CAST(b > m AS INT)), 6) AS wins, round(avg(b), 6) AS base_error, round(avg(m), 6) AS memory_error, round(avg(mx), 6) AS mixed_error FROM e GROUP BY 1""")
def gate_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared errors of two forecasts and their mixture, by how much a gate gives to the second."""
    rows = _known(spark, sf_dir).select((F.col("volume").cast("bigint") % 21 / 20.0).alias("gate"), F.col("momentum").alias("base"), F.col("daily_return").alias("memory"), F.col("future").alias("outcome"))
    return rounded_rows(diagnostics.gate_bins(rows), ["bin", "rows"], ["mean_gate", "advantage", "wins", "base_error", "memory_error", "mixed_error"])


@query(f"""{GREEDY}, w AS (SELECT k.*, 1 / greatest(sqrt(distance), 1e-9) AS weight, CASE security % 4 WHEN 0 THEN NULL WHEN 1 THEN 'EAST' WHEN 2 THEN 'WEST' ELSE 'NORTH' END AS market FROM k)
SELECT coalesce(market, 'unknown') AS market, count(*) AS neighbors, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(sum(weight) / sum(sum(weight)) OVER (), 6) AS weight_share FROM w GROUP BY 1""")
def neighbor_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From which markets retrieved records come, by number and by weight."""
    s = F.col("security") % 4
    rows = constrained(spark, sf_dir).withColumns({"weight": 1 / F.greatest(F.sqrt("distance"), F.lit(1e-9)), "market": F.when(s == 1, "EAST").when(s == 2, "WEST").when(s == 3, "NORTH")})
    return rounded_rows(diagnostics.source_markets(rows, "weight"), ["market", "neighbors"], ["share", "weight_share"])


@query(f"""{_KNOWN}, k AS (SELECT market, {rank('momentum', 'market')} AS a, {rank('future', 'market')} AS b, greatest(1e-12, least(1, abs(daily_return))) AS p FROM x)
SELECT market, count(*) AS rows, round(corr(a, b), 6) AS spearman, round(avg(-p * log2(p)), 6) AS entropy FROM k GROUP BY market""")
def signal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of a signal with what came of it, and the mean entropy term of a share, per market."""
    rows = _known(spark, sf_dir)
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1.0), F.abs("daily_return")))
    means = rows.groupBy("market").agg(F.count("*").alias("rows"), F.avg(-p * F.log2(p)).alias("entropy"))
    return rounded_rows(means.join(diagnostics.rank_correlation(rows, "momentum", "future", ["market"]), "market"), ["market", "rows"], ["spearman", "entropy"])


_WINDOW = 5


@query(f"""{_DETECTED}, o AS (SELECT security, list(end_return ORDER BY start_idx) AS l FROM found GROUP BY 1)
SELECT security, CAST(len(l) AS BIGINT) AS cycles, round({_EMA.format('l', 2 / (_WINDOW + 1))}, 6) AS ema, round(list_avg(l[greatest(len(l) - {_WINDOW - 1}, 1):]), 6) AS mean FROM o""")
def cycle_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving averages of the returns of a security's cycles."""
    found = _detected(spark, sf_dir).withColumnRenamed("end_return", "return_pct")
    return rounded_rows(diagnostics.moving_returns(found, _WINDOW), ["security", "cycles"], ["ema", "mean"])


_RUNS = f"""{BARS}, u AS (SELECT *, CAST(close > lag(close) OVER {W} AS INT) AS up FROM bars), m AS (SELECT *, CASE WHEN up = lag(up) OVER {W} THEN 0 ELSE 1 END AS n FROM u WHERE up IS NOT NULL), q AS (SELECT *, sum(n) OVER {W} AS run FROM m),
t AS MATERIALIZED (SELECT security, run, min(session) AS entry, count(*) AS held, arg_min(close, session) AS p0, arg_max(close, session) AS p1, min(up) AS up FROM q GROUP BY 1, 2)"""


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of rises or falls as trades: from a run's first close to its last."""
    bars = panel.bars(spark, sf_dir)
    runs = features.islands(bars)
    priced = lambda day, name: runs.select("security", "run", F.col(day).alias("session")).join(bars.select("security", "session", F.col("close").alias(name)), ["security", "session"]).drop("session")
    return runs.select("security", "run", F.col("first").alias("entry"), F.col("rows").alias("held"), "up").join(priced("first", "entry_price"), ["security", "run"]).join(priced("last", "exit_price"), ["security", "run"])


@query(f"""{_RUNS}, d AS (SELECT b.security, b.session, CASE WHEN CAST(b.volume AS BIGINT) % 4 = 0 THEN 'skip' ELSE 'enter' END AS decision, t.run, t.held, t.p1 / t.p0 - 1 AS realized FROM bars b LEFT JOIN t ON t.security = b.security AND t.entry = b.session AND t.run % 5 <> 0),
e AS (SELECT *, decision = 'enter' AND run IS NOT NULL AS linked FROM d)
SELECT security, decision, count(*) AS decisions, count(*) FILTER (linked) AS linked, count(*) FILTER (linked AND held >= 3) AS lasted, round(avg(realized) FILTER (linked), 6) AS realized FROM e GROUP BY 1, 2""")
def trade_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions to enter with what became of the trade that they opened; every fifth run is a rebalance and links to none."""
    trades = _trades(spark, sf_dir).select("entry", "security", "held", F.col("run").alias("trade_id"), (F.col("exit_price") / F.col("entry_price") - 1).alias("realized"), (F.col("run") % 5 == 0).alias("rebalance"))
    made = panel.bars(spark, sf_dir).select("security", "session", F.when(F.col("volume").cast("bigint") % 4 == 0, "skip").otherwise("enter").alias("decision"))
    rows = diagnostics.linked_back(made, trades, 3)
    return rows.groupBy("security", "decision").agg(F.count("*").alias("decisions"), F.count("trade_id").alias("linked"), F.count_if(F.coalesce("lasted", F.lit(False))).alias("lasted"), F.round(F.avg("realized"), 6).alias("realized"))


@query(f"""{_RUNS}, l AS (SELECT *, (p1 * 0.9995 - p0 * 1.0005) * held + CASE WHEN run % 7 = 0 THEN 0.01 ELSE 0 END AS pnl FROM t), a AS (SELECT 'trades' AS log, count(*) AS rows, count(*) FILTER (abs((p1 * 0.9995 - p0 * 1.0005) * held - pnl) > 1e-4) AS violations FROM l)
SELECT * FROM a UNION ALL SELECT 'weights', count(DISTINCT query_id), count(DISTINCT query_id) FILTER (query_id % 200 = 0) FROM ({GREEDY} SELECT query_id FROM k)""")
def replay_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged gains and weights worked out again; a seventh of the gains and every second query's weights were spoilt."""
    gain = (F.col("exit_price") * 0.9995 - F.col("entry_price") * 1.0005) * F.col("held") + F.when(F.col("run") % 7 == 0, 0.01).otherwise(0.0)
    trades = _trades(spark, sf_dir).withColumns({"shares": F.col("held"), "pnl": gain})
    near = confidence.distance_weights(constrained(spark, sf_dir)).withColumn("weight", F.col("gaussian") + F.when((F.col("query_id") % 200 == 0) & (F.col("rank") == 1), 0.001).otherwise(0.0))
    return diagnostics.trade_accounting(trades, 0.0005).withColumn("log", F.lit("trades")).unionByName(diagnostics.logged_weights(near).withColumn("log", F.lit("weights")))


_CELLS = f"""{_KNOWN}, c AS (SELECT market, CAST(year(session) AS INT) AS year, CAST(security % 3 AS INT) AS seed, avg(future) FILTER (momentum > 0) AS candidate, avg(future) FILTER (momentum <= 0) AS comparator FROM x GROUP BY 1, 2, 3),
d AS (SELECT *, candidate - comparator AS delta, row_number() OVER (ORDER BY market, year, seed) - 1 AS i FROM c WHERE candidate IS NOT NULL AND comparator IS NOT NULL), n AS (SELECT count(*) AS n FROM d)"""


@query(f"""{_CELLS}, g AS (SELECT draw, {_hash('n', "'k'", 'draw', 'place')} AS i FROM n, (SELECT unnest(range(200)) AS draw), LATERAL (SELECT unnest(range(n)) AS place)), v AS (SELECT draw, avg(delta) AS v FROM g JOIN d USING (i) GROUP BY 1), o AS (SELECT avg(delta) AS observed, median(delta) AS middle, count(*) FILTER (delta > 0) AS wins FROM d)
SELECT (SELECT n FROM n) AS pairs, any_value(wins) AS wins, round(any_value(observed), 6) AS observed, round(any_value(middle), 6) AS median, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(avg(CAST(v > 0 AS INT)), 6) AS positive FROM v, o""")
def paired_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of market, year and seed that both arms have, their differences, and the mean's interval by drawing cells."""
    arm = F.when(F.col("momentum") > 0, "candidate").otherwise("comparator")
    cells = _known(spark, sf_dir).groupBy(arm.alias("arm"), "market", F.year("session").alias("year"), (F.col("security") % 3).cast("int").alias("seed")).agg(F.avg("future").alias("delta"))
    pairs = diagnostics.paired_cells(cells, "candidate", "comparator", ["market", "year", "seed"], ["delta"])
    placed = pairs.withColumns({"position": (F.row_number().over(Window.orderBy("market", "year", "seed")) - 1).cast("bigint"), "n": F.count("*").over(Window.partitionBy())})  # a row per cell
    grid = spark.range(200).withColumnRenamed("id", "draw").crossJoin(F.broadcast(placed.select(F.col("position").alias("place"), "n")))
    drawn = grid.select("draw", resampling.hashed(F.col("n"), F.lit("k"), "draw", "place").alias("position")).join(F.broadcast(placed), "position").groupBy("draw").agg(F.avg("delta").alias("v"))
    point = placed.agg(F.count("*").alias("pairs"), F.count_if(F.col("delta") > 0).alias("wins"), F.avg("delta").alias("observed"), F.percentile("delta", 0.5).alias("median"))
    out = drawn.agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"), F.avg((F.col("v") > 0).cast("double")).alias("positive"))
    return rounded_rows(point.crossJoin(F.broadcast(out)), ["pairs", "wins"], ["observed", "median", "low", "high", "positive"])


_CL = "greatest(-0.05::DOUBLE, least(0.05::DOUBLE, daily_return)) / 10"


@query(f"""{RETURNS}, dv AS (SELECT market, session, avg({_CL}) AS v, sum(volume) AS traded, count(*) AS names FROM r WHERE daily_return IS NOT NULL GROUP BY 1, 2), eq AS (SELECT *, round(1000 * exp(sum(ln(1 + v)) OVER (PARTITION BY market ORDER BY session)), 6) AS equity FROM dv),
b AS (SELECT *, equity / coalesce(lag(equity) OVER (PARTITION BY market ORDER BY session), 1000) - 1 AS ret, greatest(1000, max(equity) OVER (PARTITION BY market ORDER BY session)) AS peak, equity * least(1, names / 10.0) AS held FROM eq)
SELECT market, count(*) AS sessions, round(exp(252 * avg(ln(1 + ret))) - 1, 6) AS annual_return, round(stddev_pop(ret) * sqrt(252), 6) AS volatility, round(avg(ret) / stddev_pop(ret) * sqrt(252), 6) AS sharpe, round(min(equity / peak - 1), 6) AS max_drawdown, round(avg(CAST(ret > 0 AS INT)), 6) AS win_rate,
  round(252.0 / count(*) * sum(abs(traded)) / (2 * avg(equity)), 4) AS turnover, round(avg(held / equity), 6) AS exposure FROM b GROUP BY market""")
def account_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return, risk, turnover and exposure of an account per market, from its initial capital on."""
    v = F.greatest(F.lit(-0.05), F.least(F.lit(0.05), F.col("daily_return"))) / 10
    days = returns(spark, sf_dir).where("daily_return is not null").groupBy("market", "session").agg(F.avg(v).alias("v"), F.sum("volume").alias("traded"), F.count("*").alias("names"))
    days = days.withColumn("equity", F.round(1000 * F.exp(F.sum(F.log1p("v")).over(Window.partitionBy("market").orderBy("session"))), 6))
    rows = diagnostics.account_metrics(days.withColumn("held", F.col("equity") * F.least(F.lit(1.0), F.col("names") / 10)), "market", 1000.0)
    return rounded_rows(rows, ["market", "sessions"], ["annual_return", "volatility", "sharpe", "max_drawdown", "win_rate", "exposure"]).join(rows.select("market", F.round("turnover", 4).alias("turnover")), "market")


_BLOCK, _DRAWS = 21, 200


@query(f"""{_PAIR}, nn AS (SELECT any_value(n) AS n, least(any_value(n), {_BLOCK}) AS k FROM ser), gr AS (SELECT draw, place, k, n, {_hash('n - k + 1', "'mb'", 'draw', 'place')} AS start FROM nn, (SELECT unnest(range({_DRAWS})) AS draw), LATERAL (SELECT unnest(range(CAST(ceil(n / k) AS BIGINT))) AS place)),
dr AS (SELECT draw, start + j AS position FROM gr, (SELECT unnest(range({_BLOCK})) AS j) WHERE j < k AND place * k + j < n), dl AS (SELECT draw, a, b FROM dr JOIN ser USING (position) UNION ALL SELECT -1, a, b FROM ser),
vv AS (SELECT draw, (avg(a) - avg(b)) * 252 AS annualized_return, avg(a) / stddev_samp(a) * sqrt(252) - avg(b) / stddev_samp(b) * sqrt(252) AS sharpe FROM dl GROUP BY 1), lo AS (SELECT draw, 'annualized_return' AS metric, annualized_return AS v FROM vv UNION ALL SELECT draw, 'sharpe', sharpe FROM vv), ob AS (SELECT metric, v AS observed FROM lo WHERE draw < 0)
SELECT metric, round(any_value(observed), 6) AS observed, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(avg(CAST(v > 0 AS INT)), 6) AS positive, round((1 + count(*) FILTER (abs(v - observed) >= abs(observed))) / (1 + count(*)), 6) AS p FROM lo JOIN ob USING (metric) WHERE draw >= 0 GROUP BY metric""")
def moving_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two portfolios with intervals by moving blocks of sessions that both share."""
    found = resampling.moving_block_pairs(_pair(spark, sf_dir), _BLOCK, _DRAWS, "mb")
    rows = resampling.spread(found.where("draw is not null"), found.where("draw is null").drop("draw"), ["annualized_return", "sharpe"], [])
    return rounded_rows(rows, ["metric"], ["observed", "low", "high", "positive", "p"])


@query(f"""{_PAIR}, nn AS (SELECT count(*) AS n FROM ser) SELECT 'digests' AS rule, CAST(4 AS BIGINT) AS evaluated, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'blocks', {_DRAWS}, 0 FROM nn WHERE n > 0
UNION ALL SELECT 'draws', 2 * ({_DRAWS} + 1), 0 FROM nn WHERE n > 0 UNION ALL SELECT 'contrasts', 12, 0 UNION ALL SELECT 'identity', 1, 0""")
def bundle_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block bootstrap, written as a bundle and worked out again from what was written."""
    path = place(spark, "bundle")
    replay.export(_pair(spark, sf_dir), path, _BLOCK, _DRAWS, "mb")
    return replay.replay(spark, path, _BLOCK)


@query(f"""{_KNOWN}, s AS (SELECT session, security, greatest(-2, least(2, round(momentum, 9))) AS s, greatest(-2, least(2, round(future, 9))) AS u FROM x), t AS (SELECT *, greatest(0, max(s) OVER (PARTITION BY session)) AS top, count(*) FILTER (u > 0.01) OVER (PARTITION BY session) AS many, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN u > 0.01 THEN u END DESC NULLS LAST, security) AS place FROM s),
e AS (SELECT *, exp((s - top) / 0.5) AS e, exp((0 - top) / 0.5) AS c, u > 0.01 AND place <= 3 AS chosen FROM t), w AS (SELECT *, e / (sum(e) OVER (PARTITION BY session) + c) AS predicted, c / (sum(e) OVER (PARTITION BY session) + c) AS cash, least(1, many / 3.0) AS wanted, CASE WHEN chosen THEN exp(u / 0.5) / sum(CASE WHEN chosen THEN exp(u / 0.5) END) OVER (PARTITION BY session) ELSE 0 END AS part FROM e),
d AS (SELECT session, any_value(1 - cash) AS exposure, any_value(wanted) AS wanted, -(any_value((1 - wanted) * ln(cash)) + sum(CASE WHEN part > 0 THEN wanted * part * ln(predicted) ELSE 0 END)) AS allocation_loss, greatest(0, sum(wanted * part * u) - sum(predicted * u)) AS regret FROM w WHERE cash > 0 GROUP BY 1)
SELECT CAST(year(session) AS INT) AS year, count(*) AS sessions, round(avg(exposure), 5) AS exposure, round(avg(wanted), 5) AS wanted, round(avg(allocation_loss), 4) AS allocation_loss, round(avg((exposure - wanted) ** 2), 5) AS coverage_error, round(avg(regret), 4) AS regret FROM d GROUP BY 1""")
def opportunity_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a softmax of scores and cash misses of each session's best outcomes, by year."""
    rows = _known(spark, sf_dir).select("session", "security", *(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.round(c, 9))).alias(n) for c, n in (("momentum", "s"), ("future", "u"))))
    days = diagnostics.regret(rows, "s", "u", 3, 0.5, 0.0, 0.01)
    mean = lambda c, digits: F.round(F.avg(c), digits).alias(c)
    return days.groupBy(F.year("session").alias("year")).agg(F.count("*").alias("sessions"), mean("exposure", 5), mean("wanted", 5), mean("allocation_loss", 4), mean("coverage_error", 5), mean("regret", 4))


@query(f"""{GREEDY}, q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0), f AS (SELECT query_id, count(*) AS n, avg(target) AS v FROM k GROUP BY 1), b AS (SELECT q.query_id, avg(CAST(m.embedding[1] AS DOUBLE)) AS bank FROM q JOIN embeddings m ON m.vec_id + 63 <= q.query_id GROUP BY 1)
SELECT query_id, coalesce(n, 0) AS neighbors, coalesce(n, 0) < 25 AS fallback, round(CASE WHEN n >= 25 THEN v ELSE bank END, 6) AS prediction FROM q LEFT JOIN f USING (query_id) LEFT JOIN b USING (query_id)""".replace("n AS (SELECT query_id, unnest(taken)", "n0 AS (SELECT query_id, unnest(taken)").replace("AS target FROM n)", "AS target FROM n0)").replace(", f AS (SELECT query_id, count", ", fo AS (SELECT query_id, count").replace("JOIN f USING", "JOIN fo USING"))
def retrieval_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean outcome of the k records that the rules leave, and that of the whole bank where there are fewer."""
    queries, rows = memory(spark, sf_dir)
    found = constrained(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n"), F.avg("target").alias("v"))
    out = queries.select("query_id").join(found, "query_id", "left").join(retrieval.prior_means(queries, rows, "target"), "query_id", "left")
    enough = F.coalesce(F.col("n") >= 25, F.lit(False))
    return out.select("query_id", F.coalesce("n", F.lit(0)).alias("neighbors"), (~enough).alias("fallback"), F.round(F.when(enough, F.col("v")).otherwise(F.col("mean")), 6).alias("prediction"))


_POLICY = " AND ".join(f"coalesce({c} >= {v!r}, false)" for c, v in diagnostics.GATES.items())
_FREE = " AND ".join(f"coalesce({c} >= {v!r}, false)" for c, v in diagnostics.NEUTRAL.items())


@query(f"""{GREEDY}, d AS (SELECT *, greatest(sqrt(distance), 1e-9) AS dist FROM k), w AS (SELECT *, exp(-0.5 * (dist / median(dist) OVER (PARTITION BY query_id)) ** 2) AS raw FROM d), ev AS (SELECT query_id, sum(raw * target) / sum(raw) AS score FROM w GROUP BY 1 HAVING count(*) >= 5),
z AS (SELECT query_id, score, greatest(score, 0) AS upside, least(score, 0) AS downside, CAST(score IS NOT NULL AS DOUBLE) AS confidence FROM ev)
SELECT query_id, round(score, 6) AS score, round(upside, 6) AS upside, round(downside, 6) AS downside, confidence, 0.5::DOUBLE AS path, 1.0::DOUBLE AS agreement, {_POLICY} AS by_policy, {_FREE} AS by_neutral FROM z""")
def central_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence collapsed to its central value, what a policy's gates let pass of it, and what neutral gates do."""
    rows = diagnostics.central_only(retrieval.evidence(constrained(spark, sf_dir)))
    rows = rows.withColumns({"by_policy": diagnostics.admitted(rows, diagnostics.GATES), "by_neutral": diagnostics.admitted(rows, diagnostics.NEUTRAL)})
    return rows.select("query_id", *(F.round(c, 6).alias(c) for c in ("score", "upside", "downside")), "confidence", "path", "agreement", "by_policy", "by_neutral")


@query(f"""{BARS}, a AS (SELECT security, count(*) AS rows FROM bars GROUP BY 1) SELECT market, count(*) AS requested, count(a.security) AS available, count(*) FILTER (a.rows < 500) AS short, count(*) FILTER (a.rows >= 500) AS used, round(coalesce(count(*) FILTER (a.rows >= 500), 0) / count(*), 6) AS share FROM groups LEFT JOIN a USING (security) GROUP BY market""")
def universe_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Securities per market: requested, with bars, excluded for a short history, and used."""
    have = panel.bars(spark, sf_dir).groupBy("security").agg(F.count("*").alias("n"))
    rows = panel.securities(spark, sf_dir).join(have, "security", "left")
    used = F.count_if(F.coalesce(F.col("n") >= 500, F.lit(False)))
    return rows.groupBy("market").agg(F.count("*").alias("requested"), F.count("n").alias("available"), F.count_if(F.coalesce(F.col("n") < 500, F.lit(False))).alias("short"), used.alias("used"), F.round(used / F.count("*"), 6).alias("share"))


#: Arms of the study: how many realizations each has, and whether costs are stressed.
ARMS = [("fixed", 7, False), ("random", 3, False), ("fitted", 24, True)]


@query(f"""{BARS}, mk AS (SELECT DISTINCT market FROM groups), yr AS (SELECT DISTINCT CAST(year(session) AS INT) AS year FROM bars), ar AS (SELECT * FROM (VALUES {", ".join(f"('{a}', {n}, {str(s).lower()})" for a, n, s in ARMS)}) t(arm, realizations, stressed)),
h AS (SELECT s.market, CAST(year(session) AS INT) AS year, count(DISTINCT security) AS securities FROM bars b JOIN groups s USING (security) GROUP BY 1, 2)
SELECT market, arm, CAST(any_value(realizations) AS INT) AS paths, CAST(sum(realizations) AS BIGINT) AS cells, CAST(any_value(CASE WHEN stressed THEN 2 * realizations ELSE 0 END) AS INT) AS stress_paths, count(h.securities) AS years_with_data, CAST(coalesce(sum(h.securities), 0) AS BIGINT) AS securities FROM mk CROSS JOIN yr CROSS JOIN ar LEFT JOIN h USING (market, year) GROUP BY market, arm""")
def configuration_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths, cells and stress paths of every market and arm over all years, held against the years that have data."""
    bars, groups = panel.bars(spark, sf_dir), panel.securities(spark, sf_dir)
    arms = F.broadcast(spark.createDataFrame(ARMS, "arm string, realizations int, stressed boolean"))
    years = bars.select(F.year("session").alias("year")).distinct()
    have = bars.join(groups, "security").groupBy("market", F.year("session").alias("year")).agg(F.countDistinct("security").alias("securities"))
    grid = groups.select("market").distinct().crossJoin(F.broadcast(years)).crossJoin(arms)  # markets * years * arms
    rows = grid.join(have, ["market", "year"], "left")
    return rows.groupBy("market", "arm").agg(F.first("realizations").alias("paths"), F.sum("realizations").alias("cells"), F.first(F.when(F.col("stressed"), 2 * F.col("realizations")).otherwise(0)).alias("stress_paths"), F.count("securities").alias("years_with_data"), F.coalesce(F.sum("securities"), F.lit(0)).alias("securities"))
