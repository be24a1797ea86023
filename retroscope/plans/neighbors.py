"""Queries and memory of the retrieval plans, and the SQL of their neighbors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retroscope.operators import retrieval
from retroscope.sources import panel


def memory(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth vector as a query, all of them as records; outcomes are numbers of the vectors."""
    value = lambda i: F.get("embedding", i).cast("double")
    rows = panel.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("record_id"), F.col("label").alias("security"), F.col("vec_id").alias("ordinal"), (F.col("vec_id") + 63).alias("available"), value(0).alias("target"),
        F.col("embedding").alias("vector"), (-F.abs(value(1))).alias("downside"), F.least(F.abs(value(2)), F.lit(1.0)).alias("path"), F.when(F.col("label") % 5 < 4, F.col("label") % 3).alias("sector"),
    )
    queries = rows.where("record_id % 100 = 0").select(F.col("record_id").alias("query_id"), "security", F.col("ordinal").alias("at"), "vector", "sector", "target")
    return queries, rows


RULES = retrieval.Rules(k=25, cap=3, spacing=21)


def constrained(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    queries, rows = memory(spark, sf_dir)
    found = retrieval.constrained(retrieval.candidates(queries, rows, RULES))
    return found.join(rows.select("record_id", *carry), "record_id") if carry else found


DISTANCE = "list_sum(list_transform(generate_series(1, len(m.embedding)), lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(m.embedding[i] AS DOUBLE)) * (CAST(q.embedding[i] AS DOUBLE) - CAST(m.embedding[i] AS DOUBLE))))"
FOUND = f"""WITH c AS (SELECT q.vec_id AS query_id, m.vec_id AS record_id, m.label AS security, CAST(m.embedding[1] AS DOUBLE) AS target,
  {DISTANCE} AS distance
  FROM embeddings q JOIN embeddings m ON m.vec_id + 63 <= q.vec_id AND m.label <> q.label WHERE q.vec_id % 100 = 0)"""
NEAR = f"{FOUND}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) AS rank FROM c)"

GREEDY = f"""{FOUND}, s AS (SELECT query_id, list([{{'d': distance, 'id': record_id, 's': security, 't': target}}] ORDER BY distance, record_id) AS c FROM c GROUP BY query_id),
f AS (SELECT query_id, list_reduce(list_prepend(c[1][1:0], c), lambda acc, x: CASE WHEN len(acc) >= 25 OR len(list_filter(acc, lambda y: y.s = x[1].s)) >= 3
  OR len(list_filter(acc, lambda y: y.s = x[1].s AND abs(y.id - x[1].id) < 21)) > 0 THEN acc ELSE list_concat(acc, x) END) AS taken FROM s),
n AS (SELECT query_id, unnest(taken) AS x FROM f), k AS (SELECT query_id, x.id AS record_id, x.s AS security, x.d AS distance, x.t AS target FROM n)"""


def searched(distance: str = DISTANCE, rule: str = "m.vec_id + 63 <= q.vec_id AND m.label <> q.label", source: str = "embeddings") -> str:
    """GREEDY with another distance, other admissible records or other vectors."""
    return GREEDY.replace(DISTANCE, distance).replace("m.vec_id + 63 <= q.vec_id AND m.label <> q.label", rule).replace("embeddings", source)
