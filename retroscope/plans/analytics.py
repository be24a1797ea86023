"""Queries of diagnostics: representations, occlusion and swaps, tests, ridge, alignment, equity and claims."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retroscope.functions.windows import correlation
from retroscope.operators import analytics, confidence, features, retrieval
from retroscope.operators.calendar import asof
from retroscope.plans.common import BARS, RETURNS, W, query, rank, returns, rounded_rows
from retroscope.plans.neighbors import GREEDY, RULES, constrained, memory, searched
from retroscope.sources import panel

_WHOLE = f"{RETURNS}, x AS (SELECT * FROM r WHERE momentum IS NOT NULL AND future IS NOT NULL)"


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir).where("momentum is not null and future is not null")


@query(f"""{BARS}, h AS (SELECT security, session, list(close) OVER (PARTITION BY security ORDER BY session ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS h FROM bars)
SELECT security, session, {", ".join(f"round(list_sum(h[{6 * i + 1}:{6 * i + 6}]) / 6, 6) AS p{i}" for i in range(4))} FROM h WHERE len(h) = 24""")
def patch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.patches(panel.bars(spark, sf_dir), "close", 24, 6).where("patches is not null")
    return rows.select("security", "session", *(F.round(F.get("patches", i), 6).alias(f"p{i}") for i in range(4)))


@query(f"""{BARS}, k AS (SELECT security, session, row_number() OVER {W} AS n, lead(session, 21) OVER {W} AS known FROM bars) SELECT security, count(*) AS windows, min(session) AS first, max(session) AS last, max(known) AS known FROM k WHERE n >= 40 AND known <= DATE '1998-06-30' GROUP BY security""")
def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.windows_within(panel.bars(spark, sf_dir), 40, 21, F.lit("1998-06-30").cast("date"))
    return rows.groupBy("security").agg(F.count("*").alias("windows"), F.min("session").alias("first"), F.max("session").alias("last"), F.max("known").alias("known"))


_DOT = "list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * CASE WHEN ascii(sha256('5:{d}:' || (i - 1))) % 2 = 0 THEN 1.0 ELSE -1.0 END))"


@query(f"""WITH p AS (SELECT vec_id, {", ".join(f"{_DOT.format(d=d)} AS d{d}" for d in range(4))} FROM embeddings), s AS (SELECT *, sqrt(d0 * d0 + d1 * d1 + d2 * d2 + d3 * d3) AS s FROM p) SELECT vec_id, {", ".join(f"round(d{d} / s, 6) AS d{d}" for d in range(4))} FROM s""")
def random_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.project(panel.table(spark, sf_dir, "embeddings"), "embedding", 4, 5)
    return rows.select("vec_id", *(F.round(F.get("projected", d), 6).alias(f"d{d}") for d in range(4)))


_SM = f"{GREEDY}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) AS rank, greatest(sqrt(distance), 1e-9) AS dist FROM k), g AS (SELECT *, exp(-0.5 * (dist / greatest(median(dist) OVER (PARTITION BY query_id), 1e-9)) ** 2) AS w FROM d)"


@query(f"""{_SM}, o AS (SELECT query_id, sum(w * target) / sum(w) AS whole, sum(w * target) FILTER (rank > 3) / sum(w) FILTER (rank > 3) AS without, sum(w) FILTER (rank <= 3) / sum(w) AS dropped_weight FROM g GROUP BY 1)
SELECT query_id, round(whole, 6) AS whole, round(without, 6) AS without, round(dropped_weight, 6) AS dropped_weight, round(without - whole, 6) AS change FROM o""")
def evidence_occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.occlusion(confidence.distance_weights(constrained(spark, sf_dir)), "gaussian", "target")
    return rounded_rows(rows, ["query_id"], ["whole", "without", "dropped_weight", "change"])


@query(f"""{_WHOLE}, s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY session) > 1 THEN coalesce(lead(momentum) OVER (PARTITION BY session ORDER BY security), first_value(momentum) OVER (PARTITION BY session ORDER BY security)) END AS swapped FROM x)
SELECT market, count(*) AS rows, round(corr(momentum, future), 6) AS own, round(corr(swapped, future), 6) AS swapped FROM s WHERE swapped IS NOT NULL GROUP BY market""")
def evidence_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.derangement(_whole(spark, sf_dir), "session", "security", "momentum").where("swapped is not null")
    return rows.groupBy("market").agg(F.count("*").alias("rows"), F.round(correlation("momentum", "future"), 6).alias("own"), F.round(correlation("swapped", "future"), 6).alias("swapped"))


_REPL = tuple(range(5))
_RANDOM = " UNION ALL ".join(f"SELECT {s} AS seed, query_id, avg(target) AS v FROM ({searched(distance=f_)} SELECT query_id, target FROM k) GROUP BY query_id" for s, f_ in ((s, f"sha256(q.vec_id || ':{100 + s}:' || m.vec_id)") for s in _REPL))


@query(f"""SELECT n.query_id, round(n.v, 6) AS nearest, round(avg(r.v), 6) AS random, round(stddev_samp(r.v), 6) AS spread, round(avg(CAST(r.v < n.v AS INT)), 6) AS beaten FROM ({GREEDY} SELECT query_id, avg(target) AS v FROM k GROUP BY 1) n JOIN ({_RANDOM}) r USING (query_id) GROUP BY n.query_id, n.v""")
def matched_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest records' mean outcome against means of random records under the same rules."""
    mean = lambda df: df.groupBy("query_id").agg(F.avg("target").alias("v"))
    parts = [mean(retrieval.constrained(retrieval.candidates(*memory(spark, sf_dir), replace(RULES, seed=100 + s)))) for s in _REPL]
    random = parts[0]
    for part in parts[1:]:
        random = random.unionByName(part)
    near = mean(constrained(spark, sf_dir)).withColumnRenamed("v", "nearest")
    both = near.join(random, "query_id").groupBy("query_id", "nearest").agg(F.avg("v").alias("random"), F.stddev_samp("v").alias("spread"), F.avg((F.col("v") < F.col("nearest")).cast("double")).alias("beaten"))
    return rounded_rows(both, ["query_id"], ["nearest", "random", "spread", "beaten"])


@query(f"""{_WHOLE}, k AS (SELECT market, momentum > 0 AS g, future, {rank('future', 'market')} * count(future) OVER (PARTITION BY market) AS rk FROM x), s AS (SELECT market, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, avg(future) FILTER (g) AS mean1, avg(future) FILTER (NOT g) AS mean2, sum(rk) FILTER (g) AS rs FROM k GROUP BY 1), u AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS u FROM s)
SELECT market, n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, round(u, 1) AS u, round((u - n1 * n2 / 2) / sqrt(CAST(n1 AS DOUBLE) * n2 * (n1 + n2 + 1) / 12), 6) AS deviate FROM u""")
def rank_sum_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.mann_whitney(_whole(spark, sf_dir).withColumn("g", F.col("momentum") > 0), "future", "g", ["market"])
    return rows.select("market", "n1", "n2", F.round("mean1", 6).alias("mean1"), F.round("mean2", 6).alias("mean2"), F.round("u", 1).alias("u"), F.round("deviate", 6).alias("deviate"))


@query(f"""{_WHOLE}, f AS (SELECT momentum AS a, daily_return AS b, future AS t, 1.0 / count(*) OVER (PARTITION BY market) AS w FROM x), s AS (SELECT count(*) AS rows, sum(w * a * a) + 0.1 AS aa, sum(w * b * b) + 0.1 AS bb, sum(w * a * b) AS ab, sum(w * a * t) AS ta, sum(w * b * t) AS tb FROM f)
SELECT rows, round((bb * ta - ab * tb) / (aa * bb - ab * ab), 6) AS b0, round((aa * tb - ab * ta) / (aa * bb - ab * ab), 6) AS b1 FROM s""")
def weighted_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _whole(spark, sf_dir)
    sizes = rows.groupBy("market").agg((1 / F.count("*")).alias("w"))
    return rounded_rows(analytics.ridge(rows.join(F.broadcast(sizes), "market"), ("momentum", "daily_return"), "future", "w", 0.1), ["rows"], ["b0", "b1"])


def _cross(a: str, b: str) -> str:
    side = lambda s, n: f"(SELECT vec_id, unnest(range(32)) AS {n}, CAST(unnest({'embedding[1:32]' if s == 'a' else 'embedding[33:64]'}) AS DOUBLE) AS v{n} FROM embeddings)"
    return f"(SELECT sum((xy - sx * sy / n) ** 2) AS s FROM (SELECT i, j, sum(vi * vj) AS xy, sum(vi) AS sx, sum(vj) AS sy, count(*) AS n FROM {side(a, 'i')} JOIN {side(b, 'j')} USING (vec_id) GROUP BY 1, 2))"


@query(f"SELECT round(ab.s / sqrt(aa.s * bb.s), 6) AS alignment FROM {_cross('a', 'b')} ab, {_cross('a', 'a')} aa, {_cross('b', 'b')} bb")
def kernel_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = panel.table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return rounded_rows(analytics.alignment(vectors, "vec_id", "a", "b"), [], ["alignment"])


@query(f"""{GREEDY}, g AS (SELECT vec_id, CASE WHEN label % 5 < 4 THEN label % 3 END AS sector FROM embeddings), p AS (SELECT sector, count(*) / sum(count(*)) OVER () AS expected FROM g WHERE sector IS NOT NULL GROUP BY 1),
o AS (SELECT k.query_id, q.sector, avg(coalesce(CAST(m.sector = q.sector AS INT), 0)) AS observed FROM k JOIN g q ON q.vec_id = k.query_id JOIN g m ON m.vec_id = k.record_id WHERE q.sector IS NOT NULL GROUP BY 1, 2)
SELECT query_id, round(observed, 6) AS observed, round(expected, 6) AS expected, round(observed / expected, 6) AS ratio FROM o JOIN p USING (sector)""")
def sector_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = memory(spark, sf_dir)
    return rounded_rows(analytics.enrichment(constrained(spark, sf_dir, ("sector",)), queries, rows, "sector"), ["query_id"], ["observed", "expected", "ratio"])


_CL = "greatest(-0.05, least(0.05, daily_return)) / 10"
_CURVE = f"{RETURNS}, md AS (SELECT market AS key, session, round(avg({_CL}), 10) AS daily FROM r WHERE daily_return IS NOT NULL GROUP BY 1, 2), cv AS (SELECT *, CASE WHEN day(session) = 13 THEN 1.001 ELSE 1 END * 100 * exp(sum(ln(1 + daily)) OVER (PARTITION BY key ORDER BY session)) AS equity FROM md)"


@query(f"""{_CURVE}, b AS (SELECT *, coalesce(lag(equity) OVER (PARTITION BY key ORDER BY session), 100) AS before, last_value(equity) OVER (PARTITION BY key ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, count(*) OVER (PARTITION BY key, session) > 1 AS again FROM cv)
SELECT key, count(*) AS rows, count(*) FILTER (again) AS repeated, count(*) FILTER (equity <= 0) AS not_positive, count(*) FILTER (abs(equity / before - 1 - daily) > 1e-6) AS unexplained, abs(any_value(last) / (100 * exp(sum(ln(1 + daily)))) - 1) <= 1e-6 AS reconciled FROM b GROUP BY key""")
def equity_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity curves with a planted step on each thirteenth of a month, held against their returns."""
    v = F.greatest(F.lit(-0.05), F.least(F.lit(0.05), F.col("daily_return"))) / 10
    daily = returns(spark, sf_dir).where("daily_return is not null").groupBy(F.col("market").alias("key"), "session").agg(F.round(F.avg(v), 10).alias("daily"))
    grown = 100 * F.exp(F.sum(F.log1p("daily")).over(Window.partitionBy("key").orderBy("session")))
    curve = daily.withColumn("equity", F.when(F.dayofmonth("session") == 13, 1.001).otherwise(1.0) * grown)
    return analytics.equity_checks(curve, 100.0, 1e-6)


@query(f"""{BARS}, u AS (SELECT b.*, market, CAST(close > lag(close) OVER {W} AS INT) AS up FROM bars b JOIN groups USING (security)), m AS (SELECT *, CASE WHEN up = lag(up) OVER {W} THEN 0 ELSE 1 END AS n FROM u WHERE up IS NOT NULL), q AS (SELECT *, sum(n) OVER {W} AS run FROM m),
t AS (SELECT market, min(session) AS entry, CAST(max(session) - min(session) AS INT) AS held, min(up) = 1 AS up FROM q GROUP BY market, security, run), l AS (SELECT max(session) AS last FROM bars)
SELECT market, count(*) AS trades, count(*) FILTER (entry + 7 <= last) AS eligible, count(*) FILTER (entry + 7 <= last AND held <= 7 AND up) AS rises, count(*) FILTER (entry + 7 <= last AND held <= 7 AND NOT up) AS falls, count(*) FILTER (entry + 7 <= last AND held > 7) AS lasted FROM t, l GROUP BY market""")
def competing_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = panel.bars(spark, sf_dir)
    runs = features.islands(bars).join(panel.securities(spark, sf_dir), "security")
    last = bars.agg(F.max("session").alias("last"))
    trades = runs.select("market", F.col("first").alias("entry"), F.datediff("last", "first").alias("held"), (F.col("up") == 1).alias("up")).crossJoin(F.broadcast(last))
    return analytics.exits(trades, 7, F.col("last"))


@query(f"""{_WHOLE}, f AS (SELECT 'momentum' AS feature, momentum AS x, future AS y FROM x UNION ALL SELECT 'daily_return', daily_return, future FROM x), c AS (SELECT feature, x > 0 AS a, y > 0 AS b, count(*) AS n FROM f GROUP BY 1, 2, 3),
m AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) * log2(n * sum(n) OVER (PARTITION BY feature) / (sum(n) OVER (PARTITION BY feature, a) * sum(n) OVER (PARTITION BY feature, b))) AS m FROM c)
SELECT feature, any_value(rows) AS rows, round(any_value(pearson), 6) AS pearson, round(sum(m), 6) AS information FROM m JOIN (SELECT feature, count(*) AS rows, corr(x, y) AS pearson FROM f GROUP BY 1) USING (feature) GROUP BY feature""")
def feature_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_rows(analytics.associations(_whole(spark, sf_dir), ["momentum", "daily_return"], "future"), ["feature", "rows"], ["pearson", "information"])


@query(f"""{RETURNS}, p AS (SELECT session, security, momentum, CAST(('0x' || substr(sha256('9:' || security || ':' || strftime(session, '%Y-%m-%d')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS random FROM r WHERE momentum IS NOT NULL)
SELECT session, security, round(momentum, 6) AS momentum, round(random, 6) AS random, CAST(rank() OVER (PARTITION BY session ORDER BY random DESC, security) AS INT) AS random_rank FROM p""")
def baseline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum, and a random score that security and session fix, with its rank of the day."""
    number = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(9), "security", F.date_format("session", "yyyy-MM-dd")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = returns(spark, sf_dir).where("momentum is not null").withColumn("random", number)
    place = F.rank().over(Window.partitionBy("session").orderBy(F.col("random").desc(), "security"))
    return rows.withColumn("random_rank", place).select("session", "security", F.round("momentum", 6).alias("momentum"), F.round("random", 6).alias("random"), "random_rank")


@query(f"""{_SM}, w AS (SELECT *, w / sum(w) OVER (PARTITION BY query_id) AS share FROM g) SELECT query_id, count(*) AS precedents, round(sum(share * target), 6) AS weighted_mean, round(sum(share) FILTER (rank <= 5), 6) AS top5_share, round(avg(query_id - record_id), 6) AS mean_age, round(avg(CAST(target > 0 AS INT)), 6) AS positive_share, count(DISTINCT security) AS securities FROM w GROUP BY 1""")
def precedent_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = confidence.distance_weights(constrained(spark, sf_dir))
    out = rows.groupBy("query_id").agg(
        F.count("*").alias("precedents"), F.sum(F.col("gaussian") * F.col("target")).alias("weighted_mean"), F.sum(F.when(F.col("rank") <= 5, F.col("gaussian"))).alias("top5_share"), F.avg(F.col("query_id") - F.col("record_id")).alias("mean_age"), F.avg((F.col("target") > 0).cast("double")).alias("positive_share"), F.countDistinct("security").alias("securities"),
    )
    return rounded_rows(out, ["query_id", "precedents", "securities"], ["weighted_mean", "top5_share", "mean_age", "positive_share"])


@query(f"""{RETURNS}, c AS (SELECT market, count(*) AS rows, avg(CAST(daily_return > 0 AS INT)) AS rate, round(avg(CAST(daily_return > 0 AS INT)), 2) AS stated FROM r WHERE daily_return IS NOT NULL GROUP BY 1) SELECT market, rows, stated, abs(rate - stated) <= 0.003 AS confirmed FROM c""")
def claim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates stated in hundredths, computed again."""
    rate = F.avg((F.col("daily_return") > 0).cast("double"))
    rows = returns(spark, sf_dir).where("daily_return is not null").groupBy("market").agg(F.count("*").alias("rows"), rate.alias("rate")).withColumn("stated", F.round("rate", 2))
    return rows.select("market", "rows", "stated", (F.abs(F.col("rate") - F.col("stated")) <= 0.003).alias("confirmed"))


@query(f"""{RETURNS}, a AS (SELECT security, market, count(*) AS rows, count(future) AS known, avg(CAST(future > 0.1 AS INT)) AS up_rate, avg(CAST(future < -0.1 AS INT)) AS down_rate, min(session) AS first, max(session) AS last FROM r GROUP BY 1, 2)
SELECT security, market, rows, known, rows - known AS unknown, round(up_rate, 6) AS up_rate, round(down_rate, 6) AS down_rate, first, last FROM a""")
def security_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("future")
    rows = returns(spark, sf_dir).groupBy("security", "market").agg(F.count("*").alias("rows"), F.count(x).alias("known"), F.round(F.avg((x > 0.1).cast("double")), 6).alias("up_rate"), F.round(F.avg((x < -0.1).cast("double")), 6).alias("down_rate"), F.min("session").alias("first"), F.max("session").alias("last"))
    return rows.withColumn("unknown", F.col("rows") - F.col("known"))


@query(f"""{_WHOLE}, a AS (SELECT market, year(session) AS year, avg(future) FILTER (momentum > 0) AS candidate, avg(future) AS baseline FROM x GROUP BY 1, 2) SELECT market, count(*) AS cells, round(avg(candidate - baseline), 6) AS mean_delta, round(median(candidate - baseline), 6) AS median_delta, count(*) FILTER (candidate > baseline) AS wins FROM a WHERE candidate IS NOT NULL GROUP BY market""")
def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _whole(spark, sf_dir).groupBy("market", F.year("session").alias("year")).agg((F.avg(F.when(F.col("momentum") > 0, F.col("future"))) - F.avg("future")).alias("d")).where("d is not null")
    return cells.groupBy("market").agg(F.count("*").alias("cells"), F.round(F.avg("d"), 6).alias("mean_delta"), F.round(F.median("d"), 6).alias("median_delta"), F.sum((F.col("d") > 0).cast("bigint")).alias("wins"))


@query(f"""{RETURNS}, d AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1999-12-31', INTERVAL 7 DAY)) AS DATE) AS day), c AS (SELECT security, session, momentum FROM r WHERE momentum IS NOT NULL), g AS (SELECT s.security, d.day FROM (SELECT DISTINCT security FROM c) s, d),
f AS (SELECT g.security, g.day, c.session, c.momentum FROM g ASOF JOIN c ON g.security = c.security AND g.day >= c.session) SELECT security, day, session, round(momentum, 6) AS momentum FROM f""")
def momentum_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum on a weekly calendar, as of its last value."""
    known = returns(spark, sf_dir).where("momentum is not null").select("security", "session", "momentum")
    day = lambda d: F.lit(d).cast("date")
    grid = known.select("security").distinct().select("security", F.explode(F.sequence(day("1995-01-01"), day("1999-12-31"), F.make_interval(days=F.lit(7)))).alias("day"))
    rows = asof(grid, known, "security", "day", "session", ["momentum"]).where("session is not null")
    return rows.select("security", "day", "session", F.round("momentum", 6).alias("momentum"))
