"""Queries of the fitted retrieval metric and of learned weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retroscope.functions.stored import cut
from retroscope.operators import metric, models, retrieval
from retroscope.plans.common import query, rounded_rows
from retroscope.plans.neighbors import DISTANCE, GREEDY, constrained, memory
from retroscope.sources import panel

SIZE, NEAR, FIT_STEPS, TEMPERATURE, PRESERVE, RATE = 64, 32, 5, 0.5, 0.1, 0.05
OUTCOMES = ["target", "downside", "path"]


def _standard(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries and records with standardised vectors, and outcomes in units of their median deviation."""
    queries, rows = memory(spark, sf_dir)
    rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    middle = models.spreads(rows, OUTCOMES, (0.5,))
    away = models.spreads(rows.select(*(F.abs(F.col(o) - middle[o][0]).alias(o) for o in OUTCOMES)), OUTCOMES, (0.5,))
    rows = rows.withColumns({o: (F.col(o) - middle[o][0]) / (away[o][0] if away[o][0] > 1e-6 else 1.0) for o in OUTCOMES})
    rows = cut(metric.transformed(rows, "vector", *metric.scales(rows, "vector", SIZE)))
    asked = queries.select("query_id", "at", "security").join(rows.select(F.col("record_id").alias("query_id"), "vector", *OUTCOMES), "query_id")
    return cut(asked), rows


def _found(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    return retrieval.nearest(retrieval.candidates(queries, rows, retrieval.Rules(k=k)), k)


def _even(part: int) -> F.Column:
    return F.col("query_id") / 100 % 2 == part


def _fitted(queries: DataFrame, rows: DataFrame) -> metric.Fitted:
    fit = queries.where(_even(0))
    return metric.fit_diagonal(cut(metric.examples(_found(fit, rows, NEAR), fit, rows, OUTCOMES)), SIZE, FIT_STEPS, RATE, TEMPERATURE, PRESERVE)


_Y = {"target": "CAST(embedding[1] AS DOUBLE)", "downside": "-abs(CAST(embedding[2] AS DOUBLE))", "path": "least(abs(CAST(embedding[3] AS DOUBLE)), 1)"}
_STANDARD = f"""WITH y0 AS MATERIALIZED (SELECT vec_id, label, embedding, {', '.join(f'{v} AS {k}' for k, v in _Y.items())} FROM embeddings), ym AS (SELECT {', '.join(f'median({k}) AS m_{k}' for k in _Y)} FROM y0),
ya AS (SELECT {', '.join(f'median(abs({k} - m_{k})) AS s_{k}' for k in _Y)} FROM y0, ym), sc AS (SELECT list(m ORDER BY i) AS m, list(CASE WHEN s > 1e-6 THEN s ELSE 1 END ORDER BY i) AS s FROM (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m, stddev_pop(CAST(embedding[i] AS DOUBLE)) AS s FROM y0, range(1, {SIZE + 1}) t(i) GROUP BY 1)),
v AS MATERIALIZED (SELECT vec_id, label, list_transform(list_zip(embedding, m, s), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) / z[3]) AS embedding, {', '.join(f'({k} - m_{k}) / CASE WHEN s_{k} > 1e-6 THEN s_{k} ELSE 1 END AS {k}' for k in _Y)} FROM y0, ym, ya, sc)"""


def _fit_sql() -> str:
    apart = "list_transform(list_zip(q.embedding, m.embedding), lambda z: (z[1] - z[2]) * (z[1] - z[2]))"
    parts = [f"fp AS MATERIALIZED (SELECT q.vec_id AS q, m.vec_id AS r, {apart} AS d, {', '.join(f'm.{k} AS y_{k}, q.{k} AS o_{k}' for k in _Y)} FROM v q JOIN v m ON m.vec_id + 63 <= q.vec_id AND m.label <> q.label WHERE q.vec_id % 200 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum({apart}), m.vec_id) <= {NEAR})",
             f"ft AS MATERIALIZED (SELECT *, exp(-sqrt(list_sum(d)) / {TEMPERATURE}::DOUBLE) / sum(exp(-sqrt(list_sum(d)) / {TEMPERATURE}::DOUBLE)) OVER (PARTITION BY q) AS t FROM fp)",
             f"p0 AS (SELECT i, CAST(0 AS DOUBLE) AS th, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v FROM range(1, {SIZE + 1}) t(i))"]
    for s in range(FIT_STEPS):
        parts += [
            f"s{s} AS MATERIALIZED (SELECT *, s / avg(s) OVER () AS w, avg(s) OVER () AS mean FROM (SELECT *, ln(1 + exp(th)) + 1e-4 AS s FROM p{s}))",
            f"e{s} AS MATERIALIZED (SELECT ft.*, sqrt(list_sum(list_transform(list_zip(d, wl), lambda z: z[1] * z[2]))) AS away FROM ft, (SELECT list(w ORDER BY i) AS wl FROM s{s}))",
            f"x{s} AS MATERIALIZED (SELECT *, exp(-away / {TEMPERATURE}::DOUBLE) / sum(exp(-away / {TEMPERATURE}::DOUBLE)) OVER (PARTITION BY q) AS s FROM e{s})",
            f"h{s} AS (SELECT q, {', '.join(f'sum(s * y_{k}) AS p_{k}, greatest(-1, least(1, sum(s * y_{k}) - any_value(o_{k}))) AS g_{k}' for k in _Y)} FROM x{s} GROUP BY 1)",
            f"c{s} AS MATERIALIZED (SELECT x.d, -(s * ({' + '.join(f'(y_{k} - p_{k}) * g_{k}' for k in _Y)}) / 3 + {PRESERVE}::DOUBLE * (s - t)) / (2 * {TEMPERATURE}::DOUBLE * away) AS c FROM x{s} x JOIN h{s} USING (q))",
            f"g{s} AS (SELECT i, sum(c * d[i]) / (SELECT count(*) FROM h{s}) AS g FROM c{s}, range(1, {SIZE + 1}) t(i) GROUP BY 1)",
            f"n{s} AS (SELECT i, th, m, v, (g / mean - sum(g * s) OVER () / (mean * mean * {SIZE})) / (1 + exp(-th)) AS g FROM s{s} JOIN g{s} USING (i))",
            f"k{s} AS (SELECT i, th, m, v, g * least(1, 5.0::DOUBLE / (sqrt(sum(g * g) OVER ()) + 1e-6)) AS g FROM n{s})",
            f"a{s} AS (SELECT i, th, 0.9::DOUBLE * m + 0.1::DOUBLE * g AS m, 0.999::DOUBLE * v + 0.001::DOUBLE * g * g AS v FROM k{s})",
            f"p{s + 1} AS MATERIALIZED (SELECT i, th - {RATE}::DOUBLE * (m / {1 - 0.9 ** (s + 1)!r}::DOUBLE) / (sqrt(v / {1 - 0.999 ** (s + 1)!r}::DOUBLE) + 1e-8) AS th, m, v FROM a{s})",
        ]
    return ", ".join(parts) + f", fw AS MATERIALIZED (SELECT i, s / avg(s) OVER () AS w FROM (SELECT i, ln(1 + exp(th)) + 1e-4 AS s FROM p{FIT_STEPS}))"


@query(f"{_STANDARD}, {_fit_sql()} SELECT CAST(i - 1 AS INT) AS number, round(w, 6) AS weight FROM fw")
def fitted_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a diagonal metric that makes near records have near outcomes, after some steps on every second query."""
    fitted = _fitted(*_standard(spark, sf_dir))
    return rounded_rows(spark.createDataFrame([(i, float(w)) for i, w in enumerate(fitted.weights)], "number int, weight double"), ["number"], ["weight"])


_CHECKED = "SELECT '{name}' AS metric, count(*) AS queries, round(avg(e), 6) AS error FROM (SELECT q, ({errors}) / 3 AS e FROM (SELECT *, exp(-0.5 * (away / greatest(median(away) OVER (PARTITION BY q), 1e-6)) ** 2) AS w FROM (SELECT q.vec_id AS q, sqrt({distance}) AS away, {columns} FROM {source} q JOIN {source} m ON m.vec_id + 63 <= q.vec_id AND m.label <> q.label WHERE q.vec_id % 200 = 100 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {distance}, m.vec_id) <= 25)) GROUP BY q)"
_ERRORS = " + ".join(f"abs(sum(w * y_{k}) / sum(w) - any_value(o_{k}))" for k in _Y)
_COLUMNS = ", ".join(f"m.{k} AS y_{k}, q.{k} AS o_{k}" for k in _Y)


@query(f"{_STANDARD}, {_fit_sql()}, u AS MATERIALIZED (SELECT v.* REPLACE (list_transform(list_zip(embedding, wl), lambda z: z[1] * sqrt(z[2])) AS embedding) FROM v, (SELECT list(greatest(w, 1e-8) ORDER BY i) AS wl FROM fw)) {_CHECKED.format(name='plain', errors=_ERRORS, distance=DISTANCE, columns=_COLUMNS, source='v')} UNION ALL {_CHECKED.format(name='fitted', errors=_ERRORS, distance=DISTANCE, columns=_COLUMNS, source='u')}")
def metric_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other queries' error with 25 neighbors by the plain and by the fitted metric, whose transformed vectors feed the search."""
    queries, rows = _standard(spark, sf_dir)
    weights = _fitted(queries, rows).weights
    none, one = np.zeros(SIZE), np.ones(SIZE)
    held, parts = queries.where(_even(1)), []
    for name, w in (("plain", None), ("fitted", weights)):
        asked, bank = (metric.transformed(df, "vector", none, one, w) for df in (held, rows))
        near = _found(asked, bank, 25).select("query_id", "record_id", "distance").join(rows.select("record_id", *OUTCOMES), "record_id")
        near = near.join(held.select("query_id", *(F.col(o).alias(f"own_{o}") for o in OUTCOMES)), "query_id")
        parts.append(metric.kernel_error(near, OUTCOMES).withColumn("metric", F.lit(name)))
    return rounded_rows(parts[0].unionByName(parts[1]), ["metric", "queries"], ["error"])


RANK, RANK_STEPS, RANKED = 4, 3, 0.1


def _start() -> np.ndarray:
    """Signs by a fixed rule, over the root of the size: a start that SQL can write too."""
    i, k = np.mgrid[0:SIZE, 0:RANK]
    return np.where((i * (2 * k + 3) + k) % 7 < 4, 1.0, -1.0) / 8


def _low_rank_sql() -> str:
    z = "list_transform(pl, lambda p: list_dot_product(embedding, p))"
    soft = "exp(-({x}) / {t}::DOUBLE) / sum(exp(-({x}) / {t}::DOUBLE)) OVER (PARTITION BY q)"
    outcome = " + ".join(f"{share}::DOUBLE * abs(m.{k} - q.{k})" for k, share in zip(_Y, metric.OUTCOME_SHARES, strict=True))
    apart = "list_sum(list_transform(list_zip(q.embedding, m.embedding), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [f"lp AS MATERIALIZED (SELECT q.vec_id AS q, m.vec_id AS r, sqrt({apart}) AS plain, {outcome} AS seen, {', '.join(f'm.{k} AS y_{k}, q.{k} AS o_{k}' for k in _Y)} FROM v q JOIN v m ON m.vec_id + 63 <= q.vec_id AND m.label <> q.label WHERE q.vec_id % 200 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {apart}, m.vec_id) <= {NEAR})",
             f"lt AS MATERIALIZED (SELECT *, {soft.format(x='plain', t=TEMPERATURE)} AS t, {soft.format(x='seen', t=TEMPERATURE)} AS o FROM lp)",
             f"w0 AS (SELECT i, k, CASE WHEN (i * (2 * k + 3) + k) % 7 < 4 THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END AS th, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v FROM range({SIZE}) a(i), range({RANK}) b(k))"]
    for s in range(RANK_STEPS):
        error = "(y_{0} - p_{0}) * g_{0}"
        parts += [
            f"b{s} AS MATERIALIZED (SELECT list(p ORDER BY k) AS pl FROM (SELECT k, list(th ORDER BY i) AS p FROM w{s} GROUP BY k))",
            f"u{s} AS MATERIALIZED (SELECT vec_id, embedding, z, greatest(sqrt(list_dot_product(z, z)), 1e-4) AS len FROM (SELECT vec_id, embedding, {z} AS z FROM v, b{s}))",
            f"z{s} AS MATERIALIZED (SELECT vec_id, embedding, len, list_transform(z, lambda x: x / len) AS z FROM u{s})",
            f"e{s} AS MATERIALIZED (SELECT lt.*, list_transform(list_zip(a.z, b.z), lambda z: z[1] - z[2]) AS gap FROM lt JOIN z{s} a ON a.vec_id = q JOIN z{s} b ON b.vec_id = r)",
            f"f{s} AS MATERIALIZED (SELECT *, sqrt(greatest(list_dot_product(gap, gap), 1e-24)) AS away FROM e{s})",
            f"x{s} AS MATERIALIZED (SELECT *, {soft.format(x='away', t=TEMPERATURE)} AS s FROM f{s})",
            f"h{s} AS (SELECT q, {', '.join(f'sum(s * y_{k}) AS p_{k}, greatest(-1, least(1, sum(s * y_{k}) - any_value(o_{k}))) AS g_{k}' for k in _Y)} FROM x{s} GROUP BY 1)",
            f"c{s} AS MATERIALIZED (SELECT x.q, x.r, x.gap, -(s * ({' + '.join(error.format(k) for k in _Y)}) / 3 + {PRESERVE}::DOUBLE * (s - t) + {RANKED}::DOUBLE * (s - o)) / ({TEMPERATURE}::DOUBLE * away) AS c FROM x{s} x JOIN h{s} USING (q))",
            f"d{s} AS MATERIALIZED (SELECT vec_id, k, sum(d) AS d FROM (SELECT q AS vec_id, k, c * gap[k + 1] AS d FROM c{s}, range({RANK}) t(k) UNION ALL SELECT r, k, -c * gap[k + 1] FROM c{s}, range({RANK}) t(k)) GROUP BY 1, 2)",
            f"l{s} AS MATERIALIZED (SELECT d.vec_id, k, (d - z[k + 1] * sum(d * z[k + 1]) OVER (PARTITION BY d.vec_id)) / len AS d, embedding FROM d{s} d JOIN z{s} z USING (vec_id))",
            f"g{s} AS (SELECT i, k, sum(embedding[i + 1] * d) / (SELECT count(*) FROM h{s}) AS g FROM l{s}, range({SIZE}) t(i) GROUP BY 1, 2)",
            f"k{s} AS (SELECT i, k, th, m, v, g * least(1, 5.0::DOUBLE / (sqrt(sum(g * g) OVER ()) + 1e-6)) AS g FROM w{s} JOIN g{s} USING (i, k))",
            f"a{s} AS (SELECT i, k, th, 0.9::DOUBLE * m + 0.1::DOUBLE * g AS m, 0.999::DOUBLE * v + 0.001::DOUBLE * g * g AS v FROM k{s})",
            f"w{s + 1} AS MATERIALIZED (SELECT i, k, th - {RATE}::DOUBLE * (m / {1 - 0.9 ** (s + 1)!r}::DOUBLE) / (sqrt(v / {1 - 0.999 ** (s + 1)!r}::DOUBLE) + 1e-8) AS th, m, v FROM a{s})",
        ]
    return ", ".join(parts)


def _low_rank(queries: DataFrame, rows: DataFrame, start: np.ndarray) -> metric.Fitted:
    fit = queries.where(_even(0))
    return metric.fit_low_rank(cut(metric.vectors(_found(fit, rows, NEAR), fit, rows, OUTCOMES)), start, RANK_STEPS, RATE, TEMPERATURE, PRESERVE, RANKED)


@query(f"{_STANDARD}, {_low_rank_sql()} SELECT CAST(i AS INT) AS number, CAST(k AS INT) AS direction, round(th, 6) AS weight FROM w{RANK_STEPS}")
def low_rank_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection to few numbers in which near records have near outcomes, after some steps from fixed signs on every second query."""
    fitted = _low_rank(*_standard(spark, sf_dir), _start())
    cells = [(i, k, float(w)) for i, row in enumerate(fitted.weights) for k, w in enumerate(row)]
    return rounded_rows(spark.createDataFrame(cells, "number int, direction int, weight double"), ["number", "direction"], ["weight"])


@query()
def low_rank_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other queries' error with 25 neighbors by plain distances, by the largest principal directions, and by the projection fitted from them."""
    queries, rows = _standard(spark, sf_dir)
    first = metric.principal(rows, "vector", SIZE, RANK)
    fitted = _low_rank(queries, rows, first).weights
    none, one = np.zeros(SIZE), np.ones(SIZE)
    held, parts = queries.where(_even(1)), []
    for name, projection in (("plain", None), ("principal", first), ("fitted", fitted)):
        asked, bank = (metric.transformed(df, "vector", none, one, projection=projection) for df in (held, rows))
        near = _found(asked, bank, 25).select("query_id", "record_id", "distance").join(rows.select("record_id", *OUTCOMES), "record_id")
        near = near.join(held.select("query_id", *(F.col(o).alias(f"own_{o}") for o in OUTCOMES)), "query_id")
        parts.append(metric.kernel_error(near, OUTCOMES).withColumn("metric", F.lit(name)))
    return rounded_rows(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["metric", "queries"], ["error"])


_UNITS = 16
_ERF = "(((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-x * x / 2))"


@query(f"""{GREEDY}, nb AS MATERIALIZED (SELECT query_id, record_id, target, 1 - distance / 2 AS similarity, sqrt(distance) AS away, ln(1 + CAST(query_id - record_id AS DOUBLE)) AS log_age FROM k),
h AS (SELECT vec_id AS unit, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS w{i}' for i in range(5))} FROM embeddings ORDER BY vec_id LIMIT {_UNITS}),
x AS (SELECT query_id, record_id, w4, w0 * similarity + w1 * away + w2 * log_age + w3 AS x FROM nb, h), y AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * (abs(x) / sqrt(2))) AS t FROM x),
o AS (SELECT query_id, record_id, sum(w4 * x * CASE WHEN x >= 0 THEN 1 - {_ERF} / 2 ELSE {_ERF} / 2 END) AS moved FROM y GROUP BY 1, 2), l AS (SELECT nb.*, similarity / 0.08::DOUBLE AS a, similarity / 0.08::DOUBLE + moved AS b FROM nb JOIN o USING (query_id, record_id)),
w AS (SELECT *, exp(a - max(a) OVER (PARTITION BY query_id)) AS fa, exp(b - max(b) OVER (PARTITION BY query_id)) AS fb FROM l)
SELECT query_id, count(*) AS neighbors, round(sum(fa * target) / sum(fa), 6) AS fixed_mean, round(sum(fb * target) / sum(fb), 6) AS learned_mean, round(max(fb) / sum(fb), 6) AS largest, round(1 / sum((fb / s) ** 2), 6) AS effective FROM (SELECT *, sum(fb) OVER (PARTITION BY query_id) AS s FROM w) GROUP BY query_id""")
def learned_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of retrieved outcomes by fixed and by learned weights; the network's parameters are read from a table."""
    near = constrained(spark, sf_dir).withColumns({"similarity": 1 - F.col("distance") / 2, "log_age": F.log1p((F.col("query_id") - F.col("record_id")).cast("double"))}).withColumn("distance", F.sqrt("distance"))
    number = lambda i: F.get("embedding", i).cast("double")
    hidden = panel.table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(_UNITS).select(*(number(i).alias(n) for i, n in enumerate(("w_similarity", "w_distance", "w_age", "bias", "out"))))
    rows = metric.learned_weights(near, hidden)
    mean = lambda w: F.sum(F.col(w) * F.col("target"))
    out = rows.groupBy("query_id").agg(F.count("*").alias("neighbors"), mean("fixed").alias("fixed_mean"), mean("learned").alias("learned_mean"), F.max("learned").alias("largest"), (1 / F.sum(F.col("learned") * F.col("learned"))).alias("effective"))
    return rounded_rows(out, ["query_id", "neighbors"], ["fixed_mean", "learned_mean", "largest", "effective"])
