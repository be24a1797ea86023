"""Queries of states by clustering: quality, profiles, members, a permutation test, and how outcomes agree among neighbors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retroscope.functions.stored import cut
from retroscope.functions.windows import correlation
from retroscope.operators import retrieval, states
from retroscope.plans.common import query, rounded_rows
from retroscope.plans.neighbors import DISTANCE, memory
from retroscope.sources import panel

K, STEPS = 8, 5


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the outcomes that retrieval uses too."""
    value = lambda i: F.get("x", i)
    rows = panel.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rows.select("vec_id", "x", value(0).alias("rise"), (-F.abs(value(1))).alias("fall"), (value(2) > 0).alias("hit"))


def _fitted(spark: SparkSession, sf_dir: str, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    rows = cut(_rows(spark, sf_dir))
    centres = states.fit(rows, "vec_id", K, STEPS, seed)
    return states.assign(rows, centres), centres


def _kmeans_sql(seed: int) -> str:
    """Tables of which s{seed} (vec_id, state, apart) and c{seed} (k, c) come last."""
    name = lambda r: f"s{seed}" if r == STEPS else f"a{seed}_{r}"
    centre = lambda r: f"c{seed}" if r == STEPS else f"c{seed}_{r}"
    out = [f"{centre(0)} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), vec_id) - 1 AS k, x AS c FROM v ORDER BY k LIMIT {K})"]
    for r in range(STEPS + 1):
        pairs = f"SELECT vec_id, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, {centre(r)}"
        out.append(f"{name(r)} AS MATERIALIZED (SELECT vec_id, CAST(arg_min(k, (d, k)) AS INT) AS state, min(d) AS apart FROM ({pairs}) GROUP BY vec_id)")
        if r < STEPS:
            means = f"SELECT state AS k, list(m ORDER BY i) AS m FROM (SELECT state, i, avg(x[i]) AS m FROM {name(r)} JOIN v USING (vec_id), range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1"
            out.append(f"{centre(r + 1)} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM {centre(r)} LEFT JOIN ({means}) USING (k))")
    return ", ".join(out)


_V = "WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x, CAST(embedding[1] AS DOUBLE) AS rise, -abs(CAST(embedding[2] AS DOUBLE)) AS fall, embedding[3] > 0 AS hit FROM embeddings)"
_S = f"{_V}, {_kmeans_sql(1)}, s AS MATERIALIZED (SELECT v.*, state, apart FROM s1 JOIN v USING (vec_id))"
_PAIR = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_CHOOSE = "sum(n * (n - 1) / 2)"


@query(f"""{_S}, {_kmeans_sql(2)}, sizes AS (SELECT state, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.vec_id, a.state AS own, b.state, sum({_PAIR}) AS d FROM s a, s b GROUP BY 1, 2, 3),
ab AS (SELECT vec_id, own, max(d / (n - 1)) FILTER (state = own AND n > 1) AS a, min(d / n) FILTER (state <> own) AS b FROM pairs JOIN sizes USING (state) GROUP BY 1, 2),
m AS (SELECT state, list(m ORDER BY i) AS m, any_value(n) AS n FROM (SELECT state, i, avg(x[i]) AS m, count(*) AS n FROM s, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT list(m ORDER BY i) AS x FROM (SELECT i, avg(x[i]) AS m FROM s, range(1, 65) t(i) GROUP BY 1)),
w AS (SELECT sum({_PAIR.replace('b.x', 'm')}) AS within, count(*) AS n FROM s a JOIN m USING (state)),
o AS (SELECT sum(m.n * {_PAIR.replace('a.x', 'm.m').replace('b.x', 'g.x')}) AS between, count(*) AS k FROM m, g),
sp AS (SELECT state, avg(sqrt({_PAIR.replace('b.x', 'm')})) AS r FROM s a JOIN m USING (state) GROUP BY 1),
db AS (SELECT avg(r) AS davies_bouldin FROM (SELECT x.state, max((x.r + y.r) / sqrt({_PAIR.replace('a.x', 'p.m').replace('b.x', 'q.m')})) AS r FROM sp x JOIN m p ON p.state = x.state JOIN sp y ON y.state <> x.state JOIN m q ON q.state = y.state GROUP BY 1)),
y AS (SELECT state, count(*) AS n, avg(rise) AS m, sum((rise - (SELECT avg(rise) FROM s)) ** 2) AS ss FROM s GROUP BY 1),
e AS (SELECT sum(n * (m - (SELECT avg(rise) FROM s)) ** 2) AS sb, sum(ss) AS st, count(*) AS k, sum(n) AS n FROM y),
cells AS (SELECT s1.state AS a, s2.state AS b, count(*) AS n FROM s1 JOIN s2 USING (vec_id) GROUP BY 1, 2),
ri AS (SELECT (SELECT {_CHOOSE} FROM cells) AS i, (SELECT {_CHOOSE} FROM (SELECT sum(n) AS n FROM cells GROUP BY a)) AS x, (SELECT {_CHOOSE} FROM (SELECT sum(n) AS n FROM cells GROUP BY b)) AS y, (SELECT {_CHOOSE} FROM (SELECT sum(n) AS n FROM cells)) AS every)
SELECT round((SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) FROM ab), 6) AS silhouette, round(between / (o.k - 1) / (within / (w.n - o.k)), 6) AS calinski_harabasz, round(davies_bouldin, 6) AS davies_bouldin,
  round(sb / st, 6) AS eta_squared, round(sb / (e.k - 1) / ((st - sb) / (e.n - e.k)), 6) AS anova_f, round((i - ri.x * ri.y / every) / ((ri.x + ri.y) / 2 - ri.x * ri.y / every), 6) AS adjusted_rand FROM w, o, db, e, ri""")
def state_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well states are told apart, what they say about an outcome, and how far a second start agrees."""
    rows, centres = _fitted(spark, sf_dir)
    other = states.assign(rows.select("vec_id", "x"), states.fit(rows, "vec_id", K, STEPS, 2))
    out = states.quality(rows, centres, "rise").crossJoin(F.broadcast(states.adjusted_rand(rows, other, "vec_id")))
    return rounded_rows(out, [], ["silhouette", "calinski_harabasz", "davies_bouldin", "eta_squared", "anova_f", "adjusted_rand"])


@query(f"""{_S} SELECT state, count(*) AS rows, round(count(*) / (SELECT count(*) FROM s), 6) AS share, round(avg(rise), 6) AS rise_mean, round(median(rise), 6) AS rise_median, round(avg(fall), 6) AS fall_mean, round(median(fall), 6) AS fall_median,
  round(avg(CAST(hit AS INT)), 6) AS hit_rate, round(avg(CAST(fall <= -0.1 AS INT)), 6) AS bad_rate, round(coalesce(avg(fall) FILTER (fall <= -0.1), 0), 6) AS severity FROM s GROUP BY state""")
def state_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _fitted(spark, sf_dir)
    return rounded_rows(states.profiles(cut(rows), "rise", "fall", F.col("hit"), -0.1), ["state", "rows"], ["share", "rise_mean", "rise_median", "fall_mean", "fall_median", "hit_rate", "bad_rate", "severity"])


@query(f"""{_S}, m AS (SELECT state, list(m ORDER BY i) AS m FROM (SELECT state, i, avg(x[i]) AS m FROM s, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1), d AS (SELECT state, vec_id, sqrt({_PAIR.replace('b.x', 'm')}) AS distance FROM s a JOIN m USING (state))
SELECT state, CAST(row_number() OVER (PARTITION BY state ORDER BY distance, vec_id) AS INT) AS place, vec_id, round(distance, 6) AS distance FROM d QUALIFY place <= 5""")
def state_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _fitted(spark, sf_dir)
    return rounded_rows(states.members(rows, "vec_id", 5), ["state", "place", "vec_id"], ["distance"])


_DRAWS = 1000


@query(f"""{_S}, g AS (SELECT *, rise + fall + CASE WHEN hit THEN 0.1 ELSE 0.0 END AS score FROM s), b AS (SELECT state, count(*) AS n, avg(score) AS score FROM g GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 1),
h AS (SELECT draw, score, row_number() OVER (PARTITION BY draw ORDER BY substr(sha256('7:' || draw || ':' || vec_id), 1, 8), vec_id) AS place FROM g, range({_DRAWS}) t(draw)),
d AS (SELECT draw, avg(h.score) AS mean FROM h, b WHERE place <= b.n GROUP BY 1)
SELECT b.state, b.n AS rows, round(b.score, 6) AS score, round(avg(mean), 6) AS random_mean, round(stddev_pop(mean), 6) AS random_deviation, round(avg(CAST(mean >= b.score AS INT)), 6) AS p FROM d, b GROUP BY 1, 2, b.score""")
def state_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the best state's outcomes are better than those of as many rows taken at random, a thousand times."""
    rows, _ = _fitted(spark, sf_dir)
    score = F.col("rise") + F.col("fall") + F.when(F.col("hit"), 0.1).otherwise(0.0)
    return rounded_rows(states.best_state_test(rows, "vec_id", score, _DRAWS, 7), ["state", "rows"], ["score", "random_mean", "random_deviation", "p"])


_NEAR = f"SELECT q.vec_id AS query_id, m.vec_id AS record_id, CAST(q.embedding[1] AS DOUBLE) AS own, CAST(m.embedding[1] AS DOUBLE) AS target, {{}} AS distance FROM embeddings q JOIN embeddings m ON m.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) <= {{}}"


def _others(spark: SparkSession, sf_dir: str, k: int, seed: int | None = None) -> DataFrame:
    """The k nearest records of each query among all others (or, with a seed, k of them by hash), and own, the query's outcome."""
    queries, rows = memory(spark, sf_dir)
    every = rows.withColumn("available", F.lit(-1).cast("bigint"))
    asked = queries.withColumn("at", F.lit(0).cast("bigint"))
    found = retrieval.candidates(asked, every, retrieval.Rules(k=k + 1, mode="allow", seed=seed)).where("query_id <> record_id")
    near = retrieval.nearest(found, k)
    return near.join(queries.select("query_id", F.col("target").alias("own")), "query_id")


@query(f"""{_S}, m AS (SELECT var_pop(m) AS between_variance FROM (SELECT avg(rise) AS m FROM s GROUP BY state HAVING count(*) >= 2)), n AS ({_NEAR.format(DISTANCE, 15)}), w AS (SELECT median(v) AS within_variance FROM (SELECT var_pop(target) AS v FROM n GROUP BY query_id))
SELECT round(between_variance, 9) AS between_variance, round(within_variance, 9) AS within_variance, round(between_variance / (within_variance + 1e-9), 6) AS ratio FROM m, w""")
def retrieval_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of the states' mean outcomes over the median variance of outcomes among fifteen neighbors."""
    rows, _ = _fitted(spark, sf_dir)
    means = rows.groupBy("state").agg(F.avg("rise").alias("m"), F.count("*").alias("n")).where("n >= 2").agg(F.var_pop("m").alias("between_variance"))
    within = _others(spark, sf_dir, 15).groupBy("query_id").agg(F.var_pop("target").alias("v")).agg(F.median("v").alias("within_variance"))
    out = means.crossJoin(F.broadcast(within)).withColumn("ratio", F.col("between_variance") / (F.col("within_variance") + 1e-9))
    return out.select(F.round("between_variance", 9).alias("between_variance"), F.round("within_variance", 9).alias("within_variance"), F.round("ratio", 6).alias("ratio"))


_SEEDS = (7, 17, 27)
_AGREE = "SELECT {} AS seed, corr(own, m) AS c, avg(a) AS d FROM (SELECT query_id, any_value(own) AS own, avg(target) AS m, avg(abs(target - own)) AS a FROM ({}) GROUP BY 1)"


@query(f"""WITH k AS ({_AGREE.format(0, _NEAR.format(DISTANCE, 10))}), r AS ({" UNION ALL ".join(_AGREE.format(s, _NEAR.format(f"sha256(q.vec_id || ':{s}:' || m.vec_id)", 10)) for s in _SEEDS)})
SELECT r.seed, round(k.c, 6) AS near_correlation, round(r.c, 6) AS random_correlation, round(k.d, 6) AS near_distance, round(r.d, 6) AS random_distance FROM r, k""")
def neighbor_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of a query's outcome with its ten neighbors' mean, and mean absolute difference; and of ten random records."""

    def agree(near: DataFrame) -> DataFrame:
        each = near.groupBy("query_id").agg(F.first("own").alias("own"), F.avg("target").alias("m"), F.avg(F.abs(F.col("target") - F.col("own"))).alias("a"))
        return each.agg(correlation("own", "m").alias("c"), F.avg("a").alias("d"))

    near = agree(_others(spark, sf_dir, 10)).select(F.col("c").alias("near_correlation"), F.col("d").alias("near_distance"))
    parts = [agree(_others(spark, sf_dir, 10, s)).select(F.lit(s).alias("seed"), F.col("c").alias("random_correlation"), F.col("d").alias("random_distance")) for s in _SEEDS]
    random = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded_rows(random.crossJoin(F.broadcast(near)), ["seed"], ["near_correlation", "random_correlation", "near_distance", "random_distance"])
