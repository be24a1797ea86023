"""The text operators as queries over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retroscope.llm import classifier
from retroscope.llm._common import table
from retroscope.llm.centroids import cluster
from retroscope.llm.chat import canonical, parse_transcripts
from retroscope.llm.chunk_dedup import copied_spans
from retroscope.llm.decontamination import contaminated
from retroscope.llm.filter_audit import audit
from retroscope.llm.html_text import extract_text
from retroscope.llm.minhash_dedup import near_duplicates
from retroscope.llm.ngram_join import similar_sets
from retroscope.llm.packing import pack
from retroscope.llm.quality_rules import quality_rules
from retroscope.llm.suffix_dedup import cut_repeats
from retroscope.llm.tokens import count_tokens


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As its contract says, and in n_passage_bytes what repeated strings of 200 bytes cover: fifty short words."""
    return cut_repeats(table(spark, sf_dir, "documents"), keep=None, passage=200)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(parse_transcripts(table(spark, sf_dir, "conversations")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copied_spans(table(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_token_counts, op3_html_extraction, op4_suffix_dedup, op5_quality_rules, op6_chat_formatting, op7_quality_classifier, op8_decontamination, op9_minhash_dedup, op10_chunk_dedup, op11_ngram_join, op12_centroid_clustering, op13_filter_audit)
}

WORDS = r"'[^\x20\x09-\x0D]+'"


def _classes_sql(words: int, percent: int) -> str:
    """doc_id, n_shingles and component_id by all pairs that share a shingle, in DuckDB."""
    gram = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(words))
    return f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words} + 2), lambda i: {gram}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reached(doc_id, top) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, top FROM reached JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) ON doc_id = a)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(top) AS component_id"""


_FROM_CLASSES = " FROM reached r LEFT JOIN sizes s ON r.doc_id = s.doc_id GROUP BY r.doc_id"


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """The clusters by comparing every vector with every centroid, in DuckDB."""
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, x AS c FROM v ORDER BY k LIMIT {k})",
    ]
    for r in range(rounds + 1):
        pairs = f"SELECT vec_id, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{r}"
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM ({pairs}) GROUP BY vec_id)")
        if r < rounds:
            means = f"SELECT k, list(m ORDER BY i) AS m FROM (SELECT k, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{r} JOIN v USING (vec_id), range(1, 65) t(i) GROUP BY k, i) GROUP BY k"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{r} LEFT JOIN ({means}) USING (k))")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


#: Every order is played through on the counts of each set of failed filters.
_AUDIT_SQL = f"""
WITH RECURSIVE orders(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t(f) WHERE NOT contains(filter_order, f)),
first AS (SELECT coalesce(text, '') AS t, min(doc_id) AS lo FROM documents GROUP BY 1),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, t, lo, regexp_extract_all(t, {WORDS}) AS w FROM (SELECT *, coalesce(text, '') AS t FROM documents) JOIN first USING (t)),
failed AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > lo THEN 'E' ELSE '' END AS fails FROM texts),
cells AS MATERIALIZED (SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM failed LEFT JOIN labels USING (doc_id) GROUP BY 1, 2),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, filter_order[:step - 1] AS before FROM orders, range(1, 6) t(step) WHERE length(filter_order) = 5),
played AS (SELECT *, contains(fails, own) AS fails_own, step > 1 AND regexp_matches(fails, '[' || before || '_]') AS gone FROM steps, cells),
counts AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails_own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails_own AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails_own AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails, coalesce(sum(good) FILTER (fails_own AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails_own AND NOT gone), 0) AS toxic_lost FROM played GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counts"""

ORACLE_SQL: dict[str, str] = {
    "op9_minhash_dedup": _classes_sql(5, 75) + ", r.doc_id = min(top) AS kept" + _FROM_CLASSES,
    "op11_ngram_join": _classes_sql(3, 90) + _FROM_CLASSES,
    "op12_centroid_clustering": _clusters_sql(),
    "op13_filter_audit": _AUDIT_SQL,
}
