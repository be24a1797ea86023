"""Queries of cleaning, admission, calendars, reports and validated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retroscope.functions.windows import by_time, correlation, mean
from retroscope.operators import calendar, cleaning
from retroscope.plans.common import BARS, RETURNS, W, query, returns, round_sql, rounded_rows
from retroscope.sources import panel

_TEXT = "CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN 'NaN' ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) END"


@query(f"""WITH raw AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS security, CAST(o_orderdate AS DATE) AS report_date, o_orderkey, {_TEXT} AS total_revenue,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS sales, CAST(o_orderkey % 5 AS VARCHAR) AS reported_eps, CAST(o_orderkey % 3 AS VARCHAR) AS eps_estimate, CAST(o_orderkey % 17 AS VARCHAR) AS surprise_pct FROM orders),
n AS (SELECT security, report_date, o_orderkey, coalesce(nullif(try_cast(total_revenue AS DOUBLE), 'NaN'::DOUBLE), try_cast(sales AS DOUBLE)) AS revenue, try_cast(reported_eps AS DOUBLE) AS eps, try_cast(eps_estimate AS DOUBLE) AS estimate,
  try_cast(surprise_pct AS DOUBLE) AS pct FROM raw WHERE security IS NOT NULL AND report_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY security, report_date ORDER BY o_orderkey DESC) = 1)
SELECT security, report_date, o_orderkey, revenue, eps, round(coalesce((eps - estimate) / nullif(abs(estimate), 0), pct / 100), 6) AS surprise FROM n""")
def canonical_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    text = F.when(key % 7 == 0, "n/a").when(key % 11 == 0, "NaN").otherwise(cents)
    raw = panel.table(spark, sf_dir, "orders").select(
        F.when(key % 13 != 0, F.col("o_custkey")).alias("security"), F.to_date("o_orderdate").alias("report_date"), key, text.alias("total_revenue"), cents.alias("sales"),
        (key % 5).cast("string").alias("reported_eps"), (key % 3).cast("string").alias("eps_estimate"), (key % 17).cast("string").alias("surprise_pct"),
    )
    aliases = {"revenue": ["total_revenue", "sales"], "eps": ["reported_eps"], "estimate": ["eps_estimate"], "pct": ["surprise_pct"]}
    rows = cleaning.canonical_reports(raw, aliases, ["security", "report_date"], "o_orderkey")
    return rows.select("security", "report_date", "o_orderkey", "revenue", "eps", F.round(cleaning.surprise(F.col("eps"), F.col("estimate"), F.col("pct")), 6).alias("surprise"))


@query(f"""{BARS}, f AS (SELECT *, min(ordinal) FILTER (session BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') OVER (PARTITION BY security) AS first FROM bars)
SELECT security, session, ordinal, session >= DATE '1996-01-01' AS inside FROM f WHERE ordinal >= first - 60 AND session <= DATE '1996-12-31'""")
def buffered_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.within(panel.bars(spark, sf_dir), "1996-01-01", "1996-12-31", 60)
    return rows.select("security", "session", "ordinal", (F.col("session") >= F.lit("1996-01-01").cast("date")).alias("inside"))


@query(f"""{BARS}, i AS (SELECT DISTINCT security FROM bars), h AS (SELECT security, row_number() OVER (ORDER BY sha256(security || ':7')) <= greatest(1, round(count(*) OVER () * 0.2)) AS held FROM i)
SELECT security, any_value(held) AS held, count(*) AS rows, count(*) FILTER (session BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') AS rows_1996 FROM bars JOIN h USING (security) GROUP BY security""")
def entity_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = panel.bars(spark, sf_dir)
    held = cleaning.holdout(panel.securities(spark, sf_dir).join(bars.select("security").distinct(), "security", "left_semi"), 7, 0.2)
    inside = F.count(F.when(F.year("session") == 1996, 1))
    return bars.join(held, "security").groupBy("security").agg(F.first("held").alias("held"), F.count("*").alias("rows"), inside.alias("rows_1996"))


_Z = ["momentum_z", "momentum_std", "volume_z", "volume_std"]


@query(f"""{RETURNS}, x AS (SELECT * FROM r WHERE momentum IS NOT NULL), t AS (SELECT * FROM x WHERE session < DATE '1997-01-01'),
s AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS p_{c}, stddev_samp({c}) AS s_{c}" for c in ("momentum", "volume"))} FROM t),
z AS (SELECT security, session, {", ".join(f"greatest(-5, least(5, ({c} - m_{c}) / greatest(p_{c}, 1e-4))) AS {c}_z, ({c} - m_{c}) / CASE WHEN s_{c} < 1e-6 THEN 1 ELSE s_{c} END AS {c}_std" for c in ("momentum", "volume"))} FROM x, s)
SELECT security, session, {round_sql(_Z)} FROM z""")
def frozen_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar's values scaled by the numbers of the training sessions."""
    rows = cleaning.scaled(returns(spark, sf_dir).where("momentum is not null"), ["momentum", "volume"], F.col("session") < F.lit("1997-01-01").cast("date"))
    return rounded_rows(rows, ["security", "session"], _Z)


@query("""WITH m AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM (SELECT unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE vec_id < 250) GROUP BY i),
z AS (SELECT vec_id, (v - m) / CASE WHEN s < 1e-12 THEN 1 ELSE s END AS z FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) JOIN m USING (i))
SELECT vec_id, count(*) AS numbers, round(sum(z), 6) AS total, round(sqrt(sum(z * z)), 6) AS size, round(max(abs(z)), 6) AS largest FROM z GROUP BY vec_id""")
def latent_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    stats = rows.where("vec_id < 250").groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))  # a row per number of a vector
    z = (F.col("v") - F.col("m")) / F.when(F.col("s") < 1e-12, 1.0).otherwise(F.col("s"))
    sizes = rows.join(F.broadcast(stats), "i").withColumn("z", z).groupBy("vec_id")
    return sizes.agg(F.count("*").alias("numbers"), F.round(F.sum("z"), 6).alias("total"), F.round(F.sqrt(F.sum(F.col("z") * F.col("z"))), 6).alias("size"), F.round(F.max(F.abs("z")), 6).alias("largest"))


_RAW = f"""{BARS}, raw AS (SELECT security, session, ordinal, 0 AS row, f.p / f.q AS open, CASE WHEN ordinal % 97 = 5 THEN low * 0.5 WHEN ordinal % 89 = 7 THEN greatest(f.p / f.q, close) * (1 - 2e-16::DOUBLE) ELSE high END AS high,
  CASE WHEN ordinal % 61 = 3 THEN -low ELSE low END AS low, CASE WHEN ordinal % 71 = 2 THEN 'NaN'::DOUBLE ELSE close END AS close, CASE WHEN ordinal % 53 = 4 THEN -volume ELSE volume END AS volume FROM bars),
more AS (SELECT * FROM raw UNION ALL SELECT * REPLACE (1 AS row, CASE WHEN ordinal % 2 = 0 THEN volume ELSE volume + 1 END AS volume) FROM raw WHERE ordinal % 41 < 2)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, nan = F.col("ordinal"), F.lit(float("nan"))
    rows = panel.bars(spark, sf_dir).withColumns({
        "high": F.when(o % 97 == 5, F.col("low") * 0.5).when(o % 89 == 7, F.greatest("open", "close") * (1 - 2e-16)).otherwise(F.col("high")),
        "low": F.when(o % 61 == 3, -F.col("low")).otherwise(F.col("low")),
        "close": F.when(o % 71 == 2, nan).otherwise(F.col("close")),
        "volume": F.when(o % 53 == 4, -F.col("volume")).otherwise(F.col("volume")),
        "row": F.lit(0),
    })
    again = rows.where("ordinal % 41 < 2").withColumns({"row": F.lit(1), "volume": F.when(o % 2 == 0, F.col("volume")).otherwise(F.col("volume") + 1)})
    return rows.unionByName(again)


@query(f"""{_RAW}, g AS (SELECT *, isnan(open) OR isnan(high) OR isnan(low) OR isnan(close) AS missing, coalesce(open <= 0 OR high <= 0 OR low <= 0 OR close <= 0, false) AS lowest,
  count(DISTINCT hash(open, high, low, close, volume)) OVER (PARTITION BY security, session) > 1 AS conflict, row_number() OVER (PARTITION BY security, session ORDER BY row) > 1 AS copy,
  greatest(open, close, low) - high AS over, low - least(open, close, high) AS under, 4 * 2.0::DOUBLE ** -52 * greatest(open, close, high, low) AS slack FROM more),
s AS (SELECT security, session, row, CASE WHEN missing THEN 'not_finite' WHEN lowest THEN 'not_positive' WHEN volume < 0 THEN 'volume' WHEN conflict THEN 'conflict' WHEN copy THEN 'duplicate' END AS fault,
  CASE WHEN missing OR lowest THEN 'OTHER_INVALID' WHEN over <= 0 AND under <= 0 THEN 'ALREADY_VALID' WHEN over <= slack AND under <= slack THEN 'ROUNDOFF_ONLY' ELSE 'MATERIAL_DISCREPANCY' END AS ordering, over, under, high, low, open, close FROM g)
SELECT security, session, row, fault, ordering, CASE WHEN ordering = 'ROUNDOFF_ONLY' THEN greatest(high, open, close, low) ELSE high END AS mended_high, CASE WHEN ordering = 'ROUNDOFF_ONLY' THEN least(low, open, close, high) ELSE low END AS mended_low FROM s""")
def bar_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.bar_status(_raw(spark, sf_dir)).select("security", "session", "row", "fault", "ordering", "mended_high", "mended_low")


_SEEDS = """WITH s AS (SELECT l_returnflag AS seed, CAST(l_shipdate AS DATE) AS session, l_suppkey AS security, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 - 0.05 AS score, CAST(min(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / 100 AS downside,
  CAST(count(*) AS BIGINT) AS neighbors, CAST(max(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / 10 AS confidence FROM lineitem GROUP BY 1, 2, 3)"""


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seed, session, security, score, downside, neighbors, confidence: signals of three seeds, from whole hundredths."""
    whole = lambda c: F.round(F.col(c) * 100).cast("bigint")
    lines = panel.table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_returnflag").alias("seed"), F.to_date("l_shipdate").alias("session"), F.col("l_suppkey").alias("security")).agg(
        (F.sum(whole("l_discount")).cast("double") / F.count("*") / 100 - 0.05).alias("score"), (F.min(whole("l_tax")).cast("double") / 100).alias("downside"), F.count("*").alias("neighbors"), (F.max(whole("l_discount")).cast("double") / 10).alias("confidence")
    )


SEEDS = _SEEDS
_GATES = [("low_score", "score < -0.02"), ("downside", "abs(downside) > 0.06"), ("low_confidence", "confidence < 0.25"), ("insufficient_neighbors", "neighbors < 1"), ("ood", "NOT ood_pass")]


@query(f"""{_SEEDS}, g AS (SELECT *, security % 11 <> 3 AS ood_pass FROM s), d AS (SELECT *, CASE {" ".join(f"WHEN {t} THEN '{n}'" for n, t in _GATES)} END AS reason FROM g),
v AS (SELECT *, score >= 0 AND confidence >= 0.4 AND abs(downside) <= 0.05 AND ood_pass AS vote FROM d)
SELECT session, security, count(*) AS seeds, min(reason) AS reason, sum(CAST(vote AS INT)) AS votes, sum(CAST(reason IS NULL AS INT)) AS tradable, sum(CAST(vote AS INT)) >= 2 AND bool_or(reason IS NULL) AS admitted FROM v GROUP BY 1, 2""")
def tradability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First gate that rejects a signal, votes of the seeds, and what the consensus admits."""
    rows = seeds(spark, sf_dir).withColumn("ood_pass", F.col("security") % 11 != 3)
    c = F.col
    gates = [("low_score", c("score") < -0.02), ("downside", F.abs("downside") > 0.06), ("low_confidence", c("confidence") < 0.25), ("insufficient_neighbors", c("neighbors") < 1), ("ood", ~c("ood_pass"))]
    vote = F.coalesce((c("score") >= 0) & (c("confidence") >= 0.4) & (F.abs("downside") <= 0.05) & c("ood_pass"), F.lit(False))
    rows = rows.withColumns({"reason": cleaning.first_failure(gates), "vote": vote.cast("int")})
    votes, open_ = F.sum("vote"), F.sum(c("reason").isNull().cast("int"))
    return rows.groupBy("session", "security").agg(F.count("*").alias("seeds"), F.min("reason").alias("reason"), votes.alias("votes"), open_.alias("tradable"), ((votes >= 2) & (open_ > 0)).alias("admitted"))


_SCHEDULE = f"""{BARS}, spans AS (SELECT security, min(session) AS a, max(session) AS b FROM bars GROUP BY 1),
days AS (SELECT security, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS session FROM spans),
sched AS (SELECT d.security, d.session, CASE WHEN isodow(d.session) > 5 OR strftime(d.session, '%m-%d') IN ('01-01', '12-25') THEN 'CLOSED' WHEN x.session IS NOT NULL THEN 'VALID' ELSE 'MISSING' END AS status
  FROM days d LEFT JOIN bars x ON x.security = d.security AND x.session = d.session)"""


@query(f"{_SCHEDULE} SELECT security, year(session) AS year, count(*) AS days, count(*) FILTER (status = 'CLOSED') AS closed, count(*) FILTER (status = 'VALID') AS valid, count(*) FILTER (status = 'MISSING') AS missing, round(count(*) FILTER (status = 'VALID') / nullif(count(*) FILTER (status <> 'CLOSED'), 0), 6) AS coverage FROM sched GROUP BY 1, 2")
def session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda s: F.count(F.when(F.col("status") == s, 1))
    share = F.try_divide(kind("VALID").cast("double"), (kind("VALID") + kind("MISSING")).cast("double"))
    return calendar.schedule(panel.bars(spark, sf_dir)).groupBy("security", F.year("session").alias("year")).agg(F.count("*").alias("days"), kind("CLOSED").alias("closed"), kind("VALID").alias("valid"), kind("MISSING").alias("missing"), F.round(share, 6).alias("coverage"))


@query(f"""{_SCHEDULE}, o AS (SELECT security, session, status = 'VALID' AS ok FROM sched WHERE status <> 'CLOSED'),
f AS (SELECT security, session, ok, count(*) FILTER (ok) OVER (PARTITION BY security ORDER BY session ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS valid_before, ok AND count(*) OVER (PARTITION BY security ORDER BY session ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
  AND count(*) FILTER (NOT ok) OVER (PARTITION BY security ORDER BY session ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 0 AS whole FROM o)
SELECT security, session, valid_before, whole FROM f WHERE ok""")
def interval_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid sessions among the ten before, and whether the last three open sessions all have bars."""
    rows = calendar.schedule(panel.bars(spark, sf_dir)).where("status <> 'CLOSED'").withColumn("ok", F.col("status") == "VALID")
    before, last = by_time().rowsBetween(-10, -1), by_time().rowsBetween(-2, 0)
    good = F.count(F.when(F.col("ok"), 1))
    rows = rows.withColumns({"valid_before": good.over(before), "whole": F.col("ok") & (F.count("*").over(last) == 3) & (good.over(last) == 3)})
    return rows.where("ok").select("security", "session", "valid_before", "whole")


@query(f"{BARS} SELECT market, count(DISTINCT session) AS sessions, sha256(string_agg(DISTINCT strftime(session, '%Y-%m-%d'), '|' ORDER BY strftime(session, '%Y-%m-%d'))) AS digest FROM bars JOIN groups USING (security) GROUP BY market")
def calendar_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.calendar_digest(calendar.venue_calendar(panel.bars(spark, sf_dir), panel.securities(spark, sf_dir)))


_REPS = "reps AS (SELECT o_custkey AS security, CAST(o_orderdate AS DATE) AS report_date, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS revenue, CAST(count(*) AS DOUBLE) AS eps FROM orders GROUP BY 1, 2)"


@query(f"""{BARS}, {_REPS}, l AS (SELECT b.security, b.session, r.report_date, r.revenue FROM bars b ASOF LEFT JOIN reps r ON b.security = r.security AND b.session >= r.report_date)
SELECT security, session, CASE WHEN session - report_date <= 120 THEN report_date END AS report_date, CASE WHEN session - report_date <= 120 THEN revenue END AS revenue, coalesce(session - report_date <= 7, false) AS just_reported FROM l""")
def reports_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest report of at most 120 days, and whether it came in the last 7."""
    rows = calendar.asof(panel.bars(spark, sf_dir).select("security", "session"), panel.reports(spark, sf_dir), "security", "session", "report_date", ["revenue"])
    age = F.datediff("session", "report_date")
    return rows.select("security", "session", *(F.when(age <= 120, F.col(c)).alias(c) for c in ("report_date", "revenue")), F.coalesce(age <= 7, F.lit(False)).alias("just_reported"))


_SCORED = ["eps_mean_2", "eps_mean_8", "revenue_mean_8", "eps_growth", "revenue_vs_mean", "eps_vs_mean", "eps_acceleration", "revenue_acceleration", "score"]
_O = "(PARTITION BY security ORDER BY report_date)"
_ROLL = ", ".join(f"CASE WHEN count({x}) OVER (PARTITION BY security ORDER BY report_date ROWS {k - 1} PRECEDING) >= 2 THEN avg({x}) OVER (PARTITION BY security ORDER BY report_date ROWS {k - 1} PRECEDING) END AS {x}_mean_{k}" for x in ("eps", "revenue") for k in (2, 8))


@query(f"""WITH {_REPS}, m AS (SELECT *, {_ROLL} FROM reps),
g AS (SELECT *, {", ".join(f"({x} - lag({x}, 4) OVER {_O}) / nullif(abs(lag({x}, 4) OVER {_O}), 0) AS {x}_growth, {x} / nullif({x}_mean_8, 0) - 1 AS {x}_vs_mean, ({x}_mean_2 - lag({x}_mean_2, 4) OVER {_O}) / nullif(abs(lag({x}_mean_2, 4) OVER {_O}), 0) AS {x}_g" for x in ("eps", "revenue"))} FROM m),
a AS (SELECT *, {", ".join(f"{x}_g - lag({x}_g) OVER {_O} AS {x}_acceleration" for x in ("eps", "revenue"))} FROM g),
f AS (SELECT *, (coalesce(CAST(eps_growth > 0.25 AS INT), 0) + coalesce(CAST(eps_acceleration > 0 AS INT), 0) + coalesce(CAST(revenue_vs_mean > 0 AS INT), 0))::DOUBLE
  / nullif(CAST(eps_growth IS NOT NULL AS INT) + CAST(eps_acceleration IS NOT NULL AS INT) + CAST(revenue_vs_mean IS NOT NULL AS INT), 0) AS score FROM a)
SELECT security, report_date, {round_sql(_SCORED)} FROM f""")
def report_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_rows(calendar.report_scores(panel.reports(spark, sf_dir)), ["security", "report_date"], _SCORED)


@query(f"""WITH {_REPS}, y AS (SELECT security, year(report_date) AS year, count(*) AS n, max(report_date) AS d FROM reps GROUP BY 1, 2),
g AS (SELECT security, CAST(sum(n) AS BIGINT) AS reports, max(d) AS last_report, list_sort(list_filter(range(1992, 1999), lambda v: NOT list_contains(list(year), v))) AS missing, list_sort(list(year) FILTER (n < 2)) AS sparse FROM y GROUP BY 1)
SELECT security, reports, last_report, CAST(len(missing) AS INT) AS missing_years, coalesce(CAST(len(sparse) AS INT), 0) AS sparse_years, CAST(DATE '1998-12-31' - last_report AS INT) AS days_stale,
  array_to_string(list_filter([CASE WHEN len(missing) > 0 THEN 'missing_years' END, CASE WHEN len(sparse) > 0 THEN 'sparse_years' END, CASE WHEN DATE '1998-12-31' - last_report > 120 THEN 'stale' END], lambda v: v IS NOT NULL), ',') AS reasons FROM g""")
def report_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar.report_coverage(panel.reports(spark, sf_dir), 1992, 1998, "1998-12-31")
    return rows.select("security", "reports", "last_report", F.size("missing_years").alias("missing_years"), F.size("sparse_years").alias("sparse_years"), "days_stale", F.array_join("reasons", ",").alias("reasons"))


_ACTS = "acts AS (SELECT l_suppkey AS security, CAST(l_shipdate AS DATE) AS session, CASE WHEN count(*) FILTER (l_returnflag = 'R') >= 3 THEN 2.0 ELSE 1.0 END::DOUBLE AS split, CAST(count(*) FILTER (l_returnflag = 'A') AS DOUBLE) AS dividend FROM lineitem GROUP BY 1, 2)"
_TR = ["log_open", "log_high", "log_low", "log_close", "tr_volume"]
_S = "(PARTITION BY security, segment ORDER BY session)"


@query(f"""{BARS}, {_ACTS}, j AS (SELECT b.*, f.p / f.q AS open, split, dividend, coalesce(CAST(session - lag(session) OVER {W} > 30 AS INT), 0) AS gap FROM bars b JOIN acts USING (security, session)),
g AS (SELECT *, CAST(sum(gap) OVER {W} AS BIGINT) AS segment FROM j), h AS (SELECT *, lag(close) OVER {_S} AS before, coalesce((split * close + dividend) / lag(close) OVER {_S}, 1.0) AS growth FROM g),
t AS (SELECT *, 100 * exp(sum(ln(growth)) OVER {_S}) AS tr, exp(sum(ln(split)) OVER {_S}) AS cum FROM h),
u AS (SELECT security, session, segment, ln(tr) AS log_close, volume / cum AS tr_volume, {", ".join(f"ln(CASE WHEN before IS NULL THEN 100 * {c} / close ELSE lag(tr) OVER {_S} * (split * {c} + dividend) / before END) AS log_{c}" for c in ("open", "high", "low"))} FROM t)
SELECT security, session, segment, {round_sql(_TR, 5)} FROM u""")
def total_return_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = lambda x: F.count(F.when(F.col("l_returnflag") == x, 1))
    lines = panel.table(spark, sf_dir, "lineitem")
    actions = lines.groupBy(F.col("l_suppkey").alias("security"), F.to_date("l_shipdate").alias("session")).agg(F.when(flags("R") >= 3, 2.0).otherwise(1.0).alias("split"), flags("A").cast("double").alias("dividend"))
    rows = calendar.total_return_bars(panel.bars(spark, sf_dir), actions)
    return rows.select("security", "session", "segment", *(F.round(F.ln(f"tr_{c}"), 5).alias(f"log_{c}") for c in ("open", "high", "low", "close")), F.round("tr_volume", 5).alias("tr_volume"))


_HOURS = {"AFRICA": 15, "AMERICA": 21, "ASIA": 7, "EUROPE": 16, "MIDDLE EAST": 13}


@query(f"""{BARS}, d AS (SELECT DISTINCT market, session FROM bars JOIN groups USING (security)), c AS (SELECT market, session, session + CASE market {" ".join(f"WHEN '{m}' THEN INTERVAL {h} HOUR" for m, h in _HOURS.items())} END AS close_utc FROM d)
SELECT a.market, b.market AS other, count(*) AS sessions, count(*) FILTER (b.close_utc <= a.close_utc) AS visible FROM c a JOIN c b ON a.session = b.session AND a.market <> b.market GROUP BY 1, 2""")
def utc_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = calendar.venue_calendar(panel.bars(spark, sf_dir), panel.securities(spark, sf_dir)).select("market", "session")
    hours = F.create_map(*(F.lit(x) for pair in _HOURS.items() for x in pair))
    closes = days.withColumn("close_utc", F.col("session").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours[F.col("market")]))
    return calendar.utc_visible(closes, closes)


@query(f"""{RETURNS}, w AS (SELECT security, session, close, CASE WHEN ordinal % 5 = 0 THEN NULL ELSE volume END AS volume FROM r), v AS (SELECT security, session, volume, sector FROM r WHERE ordinal % 3 = 0)
SELECT w.security, w.session, w.close, coalesce(w.volume, v.volume) AS volume, v.sector, v.security IS NOT NULL AS matched FROM w LEFT JOIN v USING (security, session)""")
def coalesced_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join on unique keys whose shared column takes the right side's value where the left has none."""
    rows = returns(spark, sf_dir)
    left = rows.select("security", "session", "close", F.when(F.col("ordinal") % 5 != 0, F.col("volume")).alias("volume"))
    right = rows.where("ordinal % 3 = 0").select("security", "session", F.col("volume").alias("_volume"), "sector", F.lit(True).alias("_there"))
    both = cleaning.checked_join(left, right, ["security", "session"], "left", one_left=True)
    return both.select("security", "session", "close", F.coalesce("volume", "_volume").alias("volume"), "sector", F.coalesce("_there", F.lit(False)).alias("matched"))


@query(f"""{RETURNS}, m AS (SELECT market, session, avg(daily_return) AS v FROM r WHERE daily_return IS NOT NULL GROUP BY 1, 2), p AS (SELECT DISTINCT a.market AS a, b.market AS b FROM m a, m b WHERE a.market < b.market),
j AS (SELECT p.a, p.b, x.session, x.v AS left_v, y.v AS right_v FROM p JOIN m x ON x.market = p.a JOIN m y ON y.market = p.b AND y.session = x.session),
o AS (SELECT p.a, p.b, count(DISTINCT m.session) AS either FROM p JOIN m ON m.market IN (p.a, p.b) GROUP BY 1, 2)
SELECT a AS market, b AS other, any_value(either) AS either, count(*) AS common, round(avg(left_v - right_v), 6) AS mean_difference, round(corr(left_v, right_v), 6) AS correlation FROM j JOIN o USING (a, b) GROUP BY 1, 2""")
def aligned_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pair of markets: sessions of either, sessions of both, and how the returns of the common ones compare."""
    daily = returns(spark, sf_dir).where("daily_return is not null").groupBy("market", "session").agg(F.avg("daily_return").alias("v"))
    markets = panel.securities(spark, sf_dir).select("market").distinct()  # a handful
    other = daily.select(F.col("market").alias("other"), "session", F.col("v").alias("w"))
    pairs = F.broadcast(markets.crossJoin(markets.withColumnRenamed("market", "other")).where("market < other"))
    left = daily.join(pairs, "market")
    right = other.join(pairs, "other")
    both = left.join(right, ["market", "other", "session"], "full_outer")
    return both.groupBy("market", "other").agg(F.count("*").alias("either"), F.count(F.when(F.col("v").isNotNull() & F.col("w").isNotNull(), 1)).alias("common"), F.round(F.avg(F.col("v") - F.col("w")), 6).alias("mean_difference"), F.round(correlation("v", "w"), 6).alias("correlation")).where("common > 0")


@query("""WITH s AS (SELECT s_nationkey AS nation, sha256(concat_ws('|', s_suppkey, s_name, CAST(round(s_acctbal * 100) AS BIGINT))) AS h FROM supplier) SELECT nation, count(*) AS rows, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM s GROUP BY 1""")
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each nation's suppliers that no order of rows changes."""
    line = F.sha2(F.concat_ws("|", "s_suppkey", "s_name", F.round(F.col("s_acctbal") * 100).cast("bigint")), 256)
    return panel.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("digest"))


@query(f"""{RETURNS}, b AS (SELECT security, session, last_value(daily_return IGNORE NULLS) OVER (PARTITION BY security ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled, momentum IS NULL AS lacking,
  coalesce(CASE WHEN count(daily_return) OVER (PARTITION BY security ORDER BY session ROWS 20 PRECEDING) >= 7 THEN stddev_samp(daily_return) OVER (PARTITION BY security ORDER BY session ROWS 20 PRECEDING) END, stddev_samp(daily_return) OVER (PARTITION BY security)) AS volatility,
  coalesce(CASE WHEN count(daily_return) OVER (PARTITION BY security ORDER BY session ROWS 20 PRECEDING) >= 7 THEN avg(abs(daily_return)) OVER (PARTITION BY security ORDER BY session ROWS 20 PRECEDING) END, avg(daily_return) OVER (PARTITION BY security)) AS moves,
  greatest(0.05, least(0.6, CASE WHEN count(daily_return) OVER (PARTITION BY security ORDER BY session ROWS 20 PRECEDING) >= 5 THEN stddev_samp(daily_return) OVER (PARTITION BY security ORDER BY session ROWS 20 PRECEDING) ELSE 0.2 END)) AS clipped FROM r)
SELECT security, session, round(filled, 6) AS filled, lacking, round(volatility, 6) AS volatility, round(moves, 6) AS moves, round(clipped, 6) AS clipped FROM b""")
def volatility_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling deviations and mean moves of at least seven returns, else those of all of the security's; and clipped ones."""
    x, frame, own = F.col("daily_return"), by_time().rowsBetween(-20, 0), Window.partitionBy("security")
    deviation = lambda least: F.when(F.count(x).over(frame) >= least, F.stddev_samp(x).over(frame))
    rows = returns(spark, sf_dir).withColumns({
        "filled": F.last(x, ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0)), "lacking": F.col("momentum").isNull(),
        "volatility": F.coalesce(deviation(7), F.stddev_samp(x).over(own)), "moves": F.coalesce(mean(F.abs(x), 21, 7), F.avg(x).over(own)),
        "clipped": F.greatest(F.lit(0.05), F.least(F.lit(0.6), F.coalesce(deviation(5), F.lit(0.2)))),
    })
    return rounded_rows(rows, ["security", "session", "lacking"], ["filled", "volatility", "moves", "clipped"])
