"""Queries of cycles, spans, and labels of what became of an origin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retroscope.functions.windows import by_time
from retroscope.operators import cycles, labels
from retroscope.plans.common import BARS, RETURNS, W, query, rank, returns, round_sql, rounded_rows
from retroscope.sources import panel

#: A price that moves by whole steps, so that both engines see the same one.
WALK = f"{BARS}, walk AS (SELECT security, session, ordinal, volume, close, 100 * exp(0.004::DOUBLE * sum(CAST(volume AS BIGINT) % 7 - 3) OVER {W}) AS price FROM bars)"


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.sum(F.col("volume").cast("bigint") % 7 - 3).over(by_time())
    return panel.bars(spark, sf_dir).withColumn("price", 100 * F.exp(F.lit(0.004).cast("double") * steps))


_FRAME = "OVER (PARTITION BY security ORDER BY session ROWS 20 PRECEDING)"
_ALL = "OVER (PARTITION BY security)"


def _candidates_sql(least: float) -> str:
    return f"""{WALK}, ret AS (SELECT *, price / lag(price) OVER {W} - 1 AS ret, count(*) {_ALL} AS n FROM walk),
ctx AS (SELECT *, coalesce(CASE WHEN count(ret) {_FRAME} >= 7 THEN stddev_samp(ret) {_FRAME} END, CASE WHEN stddev_samp(ret) {_ALL} > 0 THEN stddev_samp(ret) {_ALL} ELSE 0.02 END) AS vol,
  coalesce(CASE WHEN count(ret) {_FRAME} >= 7 THEN avg(abs(ret)) {_FRAME} END, CASE WHEN avg(abs(ret)) {_ALL} > 0 THEN avg(abs(ret)) {_ALL} ELSE 0.01 END) AS size FROM ret),
pairs AS (SELECT a.security, a.ordinal AS s, b.ordinal AS p, b.price / a.price AS ahead, a.vol, a.size, a.price AS p0, a.n FROM ctx a JOIN walk b ON b.security = a.security AND b.ordinal BETWEEN a.ordinal AND a.ordinal + 252 WHERE a.ordinal < a.n - 21),
win AS (SELECT *, coalesce(max(CASE WHEN p - s >= 21 THEN ahead END) OVER (PARTITION BY security, s ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS top, min(ahead) OVER (PARTITION BY security, s ORDER BY p ROWS UNBOUNDED PRECEDING) - 1 AS fall,
  greatest(greatest({least}, 0.10), size * 1.5 * sqrt(p - s) + vol * 0.75 * sqrt(p - s)) AS required, greatest(0.05, 2 * vol) AS soft, greatest(0.12, greatest(0.05, 2 * vol) * 1.75) AS hard, greatest(0.12, 2 * vol) AS lim FROM pairs),
ok AS (SELECT * FROM win WHERE p - s >= 21 AND ahead >= greatest(top, 1) AND ahead - 1 >= required AND fall >= -hard),
ends AS (SELECT o.security, o.s, o.p, min(w.ordinal) AS e FROM ok o JOIN walk w ON w.security = o.security AND w.ordinal > o.p AND w.ordinal <= o.s + 252 AND (w.price / o.p0) / o.ahead - 1 <= -o.lim GROUP BY 1, 2, 3),
cand AS (SELECT o.security, o.s AS start_idx, o.p AS peak_idx, coalesce(e, o.p) AS end_idx, ahead - 1 AS peak_return, w.price / p0 - 1 AS end_return, required, fall AS drawdown, vol AS volatility,
  0.40 * greatest(0, least(1, (ahead - 1) / (2 * required))) + 0.24 * CASE WHEN fall >= -soft THEN 1 ELSE greatest(0, least(1, 1 - (-fall - soft) / (hard - soft))) END
  + 0.12 * greatest(0, least(1, ((w.price / p0) / ahead - 0.75) / 0.25)) + 0.08 * greatest(0, least(1, (o.p - o.s) / 252.0::DOUBLE)) + 0.08 AS score
  FROM ok o LEFT JOIN ends x ON x.security = o.security AND x.s = o.s AND x.p = o.p JOIN walk w ON w.security = o.security AND w.ordinal = coalesce(e, o.p))"""


_NUMBERS = ["peak_return", "end_return", "required", "drawdown", "volatility", "score"]
_KEYS = ["security", "start_idx", "peak_idx", "end_idx"]
_DETECTED = _candidates_sql(0.10).replace("WITH bars", "WITH RECURSIVE bars", 1) + """, best AS (SELECT * FROM cand WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY security, start_idx ORDER BY peak_idx DESC) = 1),
found AS (SELECT * FROM (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY security ORDER BY start_idx) = 1)
  UNION ALL SELECT * FROM (SELECT b.* FROM found f JOIN best b ON b.security = f.security AND b.start_idx > f.end_idx QUALIFY row_number() OVER (PARTITION BY b.security ORDER BY b.start_idx) = 1))"""


@query(f"{_candidates_sql(0.10)} SELECT {', '.join(_KEYS)}, {round_sql(_NUMBERS)} FROM cand")
def cycle_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_rows(cycles.candidates(walk(spark, sf_dir), least_return=0.10), _KEYS, _NUMBERS)


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.detect(walk(spark, sf_dir), least_return=0.10, least_score=0.5)


@query(f"{_DETECTED} SELECT {', '.join(_KEYS)}, {round_sql(_NUMBERS)} FROM found")
def cycle_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_rows(_detected(spark, sf_dir), _KEYS, _NUMBERS)


_TOP = _candidates_sql(0.10) + ", top AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY security, start_idx ORDER BY round(score, 9) DESC, peak_idx) = 1)"


@query(f"{_TOP.replace(', top AS', ', top0 AS')} SELECT {', '.join(_KEYS)}, {round_sql(_NUMBERS)} FROM top0")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_rows(cycles.best_per_start(cycles.candidates(walk(spark, sf_dir), least_return=0.10)), _KEYS, _NUMBERS)


@query(f"""{_TOP.replace(', top AS', ', top0 AS')}, l AS (SELECT security, list([{{'k': -round(score, 9), 's': start_idx, 'e': end_idx}}] ORDER BY -round(score, 9), start_idx, end_idx) AS c FROM top0 GROUP BY security),
f AS (SELECT security, unnest(list_reduce(list_prepend(c[1][1:0], c), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s <= x[1].e AND x[1].s <= y.e)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS x FROM l)
SELECT security, x.s AS start_idx, x.e AS end_idx, round(-x.k, 6) AS score FROM f""")
def selected_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cycles.best_per_start(cycles.candidates(walk(spark, sf_dir), least_return=0.10))
    return rounded_rows(cycles.without_overlap(found), ["security", "start_idx", "end_idx"], ["score"])


#: The scorer's inputs, and its layers' sizes; parameters are numbers of the first vectors.
_INPUTS = ["peak_return", "end_return", "required", "drawdown", "volatility", "score"]
_SIZES = (8, 4, 1)
_GELU = "{x} * CASE WHEN {x} >= 0 THEN 1 - ({p}) / 2 ELSE ({p}) / 2 END"
_TAIL = "((((1.061405429::DOUBLE * {t} - 1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} - 0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t} * exp(-{x} * {x} / 2)"


def _layer_sql(layer: int, size: int, width: int, skip: int, last: bool) -> str:
    """Outputs o{layer} of a layer from the lists in o{layer - 1}; its units are the vectors from number skip on."""
    t = "(1 / (1 + 0.3275911::DOUBLE * abs(x) / sqrt(2)))"
    value = "x" if last else _GELU.format(x="x", p=_TAIL.format(x="x", t=t))
    units = f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS unit, list_transform(embedding[1:{width}], lambda z: CAST(z AS DOUBLE)) AS w, CAST(embedding[{width + 1}] AS DOUBLE) AS b FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT {size} OFFSET {skip})"
    return f"o{layer} AS MATERIALIZED (SELECT security, start_idx, peak_idx, list({value} ORDER BY unit) AS x FROM (SELECT o.security, o.start_idx, o.peak_idx, unit, list_dot_product(o.x, w) + b AS x FROM o{layer - 1} o, ({units})) GROUP BY 1, 2, 3)"


def _learned_sql() -> str:
    out, skip, width = [f"o0 AS MATERIALIZED (SELECT security, start_idx, peak_idx, list_value({', '.join(_INPUTS)}) AS x FROM cand)"], 0, len(_INPUTS)
    for i, size in enumerate(_SIZES, 1):
        out.append(_layer_sql(i, size, width, skip, i == len(_SIZES)))
        skip, width = skip + size, size
    return ", ".join(out) + f", top0 AS MATERIALIZED (SELECT c.* EXCLUDE (score), round(1 / (1 + exp(-o.x[1])), 9) AS score FROM cand c JOIN o{len(_SIZES)} o USING (security, start_idx, peak_idx))"


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = panel.table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(sum(_SIZES)).withColumn("_n", F.row_number().over(Window.orderBy("vec_id")) - 1)  # a row per unit
    parts, skip, width = [], 0, len(_INPUTS)
    for i, size in enumerate(_SIZES):
        own = vectors.where((F.col("_n") >= skip) & (F.col("_n") < skip + size))
        parts.append(own.select(F.lit(i).alias("layer"), (F.col("_n") - skip).alias("unit"), F.slice("embedding", 1, width).cast("array<double>").alias("weights"), F.get("embedding", width).cast("double").alias("bias")))
        skip, width = skip + size, size
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""{_candidates_sql(0.10)}, {_learned_sql()}, l AS (SELECT security, list([{{'k': -score, 's': start_idx, 'e': end_idx}}] ORDER BY -score, start_idx, end_idx) AS c FROM top0 GROUP BY security),
f AS (SELECT security, unnest(list_reduce(list_prepend(c[1][1:0], c), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s <= x[1].e AND x[1].s <= y.e)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS x FROM l)
SELECT security, x.s AS start_idx, x.e AS end_idx, round(-x.k, 6) AS score FROM f""")
def learned_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates scored by a small network whose parameters are read from a table, taken from the best down where they meet none taken before."""
    found = cycles.candidates(walk(spark, sf_dir), least_return=0.10)
    scored = cycles.learned_scores(found, [F.col(c) for c in _INPUTS], _layers(spark, sf_dir))
    return rounded_rows(cycles.without_overlap(cycles.undominated(scored)), ["security", "start_idx", "end_idx"], ["score"])


@query(f"""{_DETECTED}, i AS (SELECT *, row_number() OVER (PARTITION BY security ORDER BY start_idx) - 1 AS id FROM found)
SELECT w.security, w.ordinal, CAST(coalesce(id, -1) AS INT) AS cycle, CASE WHEN id IS NULL THEN 0 WHEN w.ordinal = start_idx THEN 1 WHEN w.ordinal = end_idx THEN 3 ELSE 2 END AS action,
  round(CASE WHEN id IS NULL OR start_idx = end_idx THEN 0 ELSE (w.ordinal - start_idx) / (end_idx - start_idx) END, 6) AS progress, peak_idx - w.ordinal AS lead_to_peak
FROM walk w LEFT JOIN i ON i.security = w.security AND w.ordinal BETWEEN start_idx AND end_idx""")
def cycle_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cycles.annotate(walk(spark, sf_dir).select("security", "ordinal"), _detected(spark, sf_dir))
    return rows.withColumn("progress", F.round("progress", 6))


_ACTIONS = f"{WALK.replace('WITH bars', 'WITH RECURSIVE bars', 1)}, acts AS (SELECT security, ordinal, CAST(volume AS BIGINT) % 9 AS action, coalesce(price >= lag(price) OVER {W}, false) AS gate, max(ordinal) {_ALL} AS last FROM walk)"
_ACTION_SPANS = f"""{_ACTIONS}, st AS (SELECT security, ordinal, CASE WHEN action = 1 AND gate THEN ordinal END AS opened, NULL::BIGINT AS s, NULL::BIGINT AS e, last FROM acts WHERE ordinal = 0
  UNION ALL SELECT a.security, a.ordinal, CASE WHEN st.opened IS NULL THEN CASE WHEN action = 1 AND gate THEN a.ordinal END WHEN action = 3 THEN NULL ELSE st.opened END, CASE WHEN st.opened IS NOT NULL AND action = 3 THEN st.opened END, CASE WHEN st.opened IS NOT NULL AND action = 3 THEN a.ordinal END, st.last
  FROM st JOIN acts a ON a.security = st.security AND a.ordinal = st.ordinal + 1),
aspans AS (SELECT security, s AS start_idx, e AS end_idx FROM st WHERE s IS NOT NULL UNION ALL SELECT security, opened, last FROM st WHERE ordinal = last AND opened IS NOT NULL)"""


def _action_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = walk(spark, sf_dir)
    gate = F.coalesce(F.col("price") >= F.lag("price", 1).over(by_time()), F.lit(False))
    return cycles.action_spans(rows.select("security", "ordinal", (F.col("volume").cast("bigint") % 9).alias("action"), gate.alias("gate")))


@query(f"{_ACTION_SPANS} SELECT security, start_idx, end_idx FROM aspans")
def action_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _action_spans(spark, sf_dir)


_RETURN_SPANS = """preds AS (SELECT security, ordinal, (CAST(volume AS BIGINT) % 40) / 100.0::DOUBLE AS up, -(CAST(volume AS BIGINT) % 13) / 100.0::DOUBLE AS down FROM walk),
sr AS (SELECT security, ordinal, CASE WHEN up >= 0.2 AND down >= -0.1 THEN ordinal END AS opened, 0 AS bad, -10000::BIGINT AS closed, NULL::BIGINT AS s, NULL::BIGINT AS e FROM preds WHERE ordinal = 0
  UNION ALL SELECT security, ordinal, CASE WHEN opened IS NULL THEN CASE WHEN ordinal - closed > 2 AND up >= 0.2 AND down >= -0.1 THEN ordinal END WHEN b >= 3 THEN NULL ELSE opened END, CASE WHEN b >= 3 THEN 0 ELSE b END, CASE WHEN b >= 3 THEN ordinal ELSE closed END, CASE WHEN b >= 3 THEN opened END, CASE WHEN b >= 3 THEN ordinal END
  FROM (SELECT p.security, p.ordinal, up, down, opened, closed, CASE WHEN opened IS NOT NULL AND (up < 0.1 OR down < -0.1) THEN bad + 1 ELSE 0 END AS b FROM sr JOIN preds p ON p.security = sr.security AND p.ordinal = sr.ordinal + 1)),
rspans AS (SELECT security, s AS start_idx, e AS end_idx FROM sr WHERE s IS NOT NULL UNION ALL SELECT security, opened, ordinal FROM sr WHERE opened IS NOT NULL QUALIFY ordinal = max(ordinal) OVER (PARTITION BY security))"""
_RETURN_SPANS = _RETURN_SPANS.replace("UNION ALL SELECT security, opened, ordinal FROM sr WHERE opened IS NOT NULL QUALIFY ordinal = max(ordinal) OVER (PARTITION BY security))", "UNION ALL SELECT security, opened, ordinal FROM (SELECT *, max(ordinal) OVER (PARTITION BY security) AS last FROM sr) WHERE ordinal = last AND opened IS NOT NULL)")


def _return_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("volume").cast("bigint")
    rows = walk(spark, sf_dir).select("security", "ordinal", ((v % 40) / F.lit(100.0).cast("double")).alias("up"), (-(v % 13) / F.lit(100.0).cast("double")).alias("down"))
    return cycles.return_spans(rows, cooldown=2)


@query(f"{WALK.replace('WITH bars', 'WITH RECURSIVE bars', 1)}, {_RETURN_SPANS} SELECT security, start_idx, end_idx FROM rspans")
def return_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _return_spans(spark, sf_dir)


_MATCHED = f"""{_ACTION_SPANS}, {_RETURN_SPANS}, ov AS (SELECT p.security, p.start_idx AS ps, p.end_idx AS pe, t.start_idx AS ts, t.end_idx AS te, least(p.end_idx, t.end_idx) - greatest(p.start_idx, t.start_idx) + 1 AS overlap,
  round((least(p.end_idx, t.end_idx) - greatest(p.start_idx, t.start_idx) + 1) / (greatest(p.end_idx, t.end_idx) - least(p.start_idx, t.start_idx) + 1), 9) AS iou FROM rspans p JOIN aspans t ON t.security = p.security AND p.start_idx <= t.end_idx AND t.start_idx <= p.end_idx),
li AS (SELECT security, list([{{'o': overlap, 'i': iou, 'ps': ps, 'pe': pe, 'ts': ts, 'te': te}}] ORDER BY overlap DESC, iou DESC, ps DESC, ts DESC) AS c FROM ov GROUP BY security),
mt AS (SELECT security, unnest(list_reduce(list_prepend(c[1][1:0], c), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.ps = x[1].ps OR y.ts = x[1].ts)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS x FROM li)"""


@query(f"{_MATCHED} SELECT security, x.ps AS p_start, x.pe AS p_end, x.ts AS t_start, x.te AS t_end, x.o AS overlap, round(x.i, 6) AS iou FROM mt")
def span_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cycles.match(_return_spans(spark, sf_dir), _action_spans(spark, sf_dir))
    return rounded_rows(rows, ["security", "p_start", "p_end", "t_start", "t_end", "overlap"], ["iou"])


@query(f"""{_MATCHED}, a AS (SELECT security, count(*) AS predicted FROM rspans GROUP BY 1), b AS (SELECT security, count(*) AS true_spans FROM aspans GROUP BY 1),
m AS (SELECT security, count(*) AS matched, avg(x.te - x.ps) AS mean_lead, avg(least(1, abs(x.pe - x.te) / (x.te - x.ts + 1) * CASE WHEN x.pe > x.te THEN 1.5 ELSE 1 END)) AS exit_error FROM mt GROUP BY 1),
j AS (SELECT coalesce(a.security, b.security) AS security, coalesce(predicted, 0) AS predicted, coalesce(true_spans, 0) AS true_spans FROM a FULL JOIN b ON a.security = b.security),
z AS (SELECT j.*, coalesce(matched, 0) AS matched, mean_lead, coalesce(exit_error, 1) AS exit_error, coalesce(matched, 0) / nullif(predicted, 0) AS p, coalesce(matched, 0) / nullif(true_spans, 0) AS r FROM j LEFT JOIN m USING (security))
SELECT security, predicted, true_spans, matched, round(coalesce(p, 0), 6) AS precision, round(coalesce(r, 0), 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(mean_lead, 6) AS mean_lead, round(exit_error, 6) AS exit_error FROM z""")
def cycle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted, true = _return_spans(spark, sf_dir), _action_spans(spark, sf_dir)
    rows = cycles.match_quality(predicted, true, cycles.match(predicted, true))
    return rounded_rows(rows, ["security", "predicted", "true_spans", "matched"], ["precision", "recall", "f1", "mean_lead", "exit_error"])


_EVENTS = f"""{WALK}, lr AS (SELECT *, ln(price / lag(price) OVER {W}) AS step FROM walk),
br AS (SELECT *, CASE WHEN count(step) OVER (PARTITION BY security ORDER BY session ROWS 62 PRECEDING) > 1 THEN stddev_samp(step) OVER (PARTITION BY security ORDER BY session ROWS 62 PRECEDING) ELSE 0 END * sqrt(21) AS spread,
  list(price) OVER (PARTITION BY security ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING) AS ahead FROM lr),
bb AS (SELECT *, greatest(0.02, spread) AS upside, greatest(0.02, spread) AS downside FROM br),
ht AS (SELECT *, nullif(coalesce(list_position(list_transform(ahead, lambda x: x / price - 1 >= upside), true), 0), 0) AS u, nullif(coalesce(list_position(list_transform(ahead, lambda x: x / price - 1 <= -downside), true), 0), 0) AS d FROM bb),
ev AS (SELECT *, CASE WHEN u IS NULL AND d IS NULL THEN 'none' WHEN u IS NOT NULL AND coalesce(u < d, true) THEN 'upside' ELSE 'drawdown' END AS event FROM ht),
eo AS (SELECT *, CAST(CASE event WHEN 'none' THEN 0 WHEN 'upside' THEN u ELSE d END AS INT) AS "offset" FROM ev)"""


@query(f"""{_EVENTS} SELECT security, session, round(upside, 6) AS upside, round(downside, 6) AS downside, event, "offset", CASE event WHEN 'none' THEN 0 WHEN 'upside' THEN 1 ELSE 4 END + CASE WHEN event = 'none' THEN 0 ELSE CAST("offset" > 21 AS INT) + CAST("offset" > 42 AS INT) END AS class,
  event = 'none' AND coalesce(len(ahead), 0) < 63 AS immature FROM eo""")
def event_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.event_labels(walk(spark, sf_dir))
    return rows.select("security", "session", F.round("upside", 6).alias("upside"), F.round("downside", 6).alias("downside"), "event", "offset", "class", "immature")


_EXITS = f"""{WALK}, sc AS (SELECT *, (CAST(volume AS BIGINT) % 23) / 10.0::DOUBLE - 0.5 AS score FROM walk), ah AS (SELECT *, greatest(0, score * 0.5) AS lim, list({{'p': price, 's': score}}) OVER (PARTITION BY security ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING) AS ahead FROM sc),
ps AS (SELECT *, coalesce(len(ahead), 0) AS n, list_position(list_transform(ahead, lambda x, i: i >= 5 AND x.p / price - 1 <= -0.12), true) AS a, list_position(list_transform(ahead, lambda x, i: i >= 5 AND x.s <= lim), true) AS b FROM ah),
ex AS (SELECT *, nullif(coalesce(a, 0), 0) AS st, nullif(coalesce(b, 0), 0) AS fa FROM ps), hd AS (SELECT *, CASE WHEN st IS NOT NULL AND coalesce(st <= fa, true) THEN 'stop_loss' WHEN fa IS NOT NULL THEN 'score_exit' ELSE 'max_hold' END AS exit_reason FROM ex),
ho AS (SELECT *, CAST(greatest(1, CASE exit_reason WHEN 'stop_loss' THEN st WHEN 'score_exit' THEN fa ELSE n END) AS INT) AS holding FROM hd), rt AS (SELECT *, coalesce(ahead[holding].p / price - 1, 0) AS exit_return FROM ho)"""


def _exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = (F.col("volume").cast("bigint") % 23) / F.lit(10.0).cast("double") - 0.5
    return labels.score_exits(walk(spark, sf_dir).withColumn("score", score))


@query(f"{_EXITS} SELECT security, session, exit_reason, holding, round(exit_return, 6) AS exit_return FROM rt")
def score_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_rows(_exits(spark, sf_dir), ["security", "session", "exit_reason", "holding"], ["exit_return"])


@query(f"""{_EXITS}, mn AS (SELECT *, median(exit_return) OVER (PARTITION BY session) AS benchmark, coalesce(list_min(list_transform(ahead, lambda x: x.p / price - 1)), 0) AS adverse FROM rt),
na AS (SELECT *, exit_return - benchmark - 0.002 AS net_alpha FROM mn), ut AS (SELECT *, round(net_alpha - 0.35 * abs(adverse) - 0.0001 * holding, 9) AS utility FROM na)
SELECT security, session, round(net_alpha, 6) AS net_alpha, utility, round({rank('utility', 'session')}, 6) AS same_date_rank, n >= 63 AS mature FROM ut""")
def decision_utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = by_time().rowsBetween(1, 63)
    rows = _exits(spark, sf_dir).withColumns({"adverse": F.coalesce(F.min("price").over(ahead) / F.col("price") - 1, F.lit(0.0)), "mature": F.count("*").over(ahead) >= 63})
    rows = rows.withColumn("benchmark", F.median("exit_return").over(Window.partitionBy("session")))
    rows = labels.utilities(rows, "exit_return", "benchmark", "adverse", "holding")
    rows = rows.withColumn("utility", F.round("utility", 9))
    rows = rows.withColumn("same_date_rank", labels.percent_rank(F.col("utility"), "session"))
    return rounded_rows(rows, ["security", "session", "mature", "utility"], ["net_alpha", "same_date_rank"])


@query(f"""{WALK}, g AS (SELECT *, volume > 20 AS ok, coalesce(CAST(session - lag(session) OVER {W} > 20 AS INT), 0) AS gap FROM walk), s AS (SELECT *, sum(gap) OVER {W} AS segment FROM g),
v AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY security ORDER BY session ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) = 4 AND lead(segment, 3) OVER {W} = segment AS a, sum(CAST(ok AS INT)) OVER (PARTITION BY security ORDER BY session ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) = 7 AND lead(segment, 6) OVER {W} = segment AS b,
  lead(close, 3) OVER {W} / close - 1 AS t, lead(session, 6) OVER {W} AS m FROM s)
SELECT security, session, coalesce(a, false) AS valid_target, coalesce(b, false) AS valid_maturity, round(CASE WHEN a THEN t END, 6) AS target, CASE WHEN b THEN m END AS matures FROM v""")
def path_valid_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.coalesce((F.datediff("session", F.lag("session", 1).over(by_time())) > 20).cast("int"), F.lit(0))
    rows = walk(spark, sf_dir).withColumn("_gap", gap).withColumn("segment", F.sum("_gap").over(by_time()))
    rows = labels.path_valid_targets(rows, F.col("volume") > 20, "segment", 3, 6)
    return rows.select("security", "session", "valid_target", "valid_maturity", F.round("target", 6).alias("target"), "matures")


_QS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
_QN = [f"q{round(q * 100):02d}" for q in _QS]


@query(f"""{RETURNS} SELECT security, count(future) AS rows, round(avg(future), 6) AS mean, round(stddev_samp(future), 6) AS deviation, round(min(future), 6) AS lowest, round(max(future), 6) AS highest, round(avg(CAST(future > 0 AS INT)), 6) AS positive_rate,
  {", ".join(f"round(quantile_cont(future, {q}), 6) AS {n}" for q, n in zip(_QS, _QN, strict=True))} FROM r WHERE future IS NOT NULL GROUP BY security""")
def target_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("future")
    parts = {"mean": F.avg(x), "deviation": F.stddev_samp(x), "lowest": F.min(x), "highest": F.max(x), "positive_rate": F.avg((x > 0).cast("double"))} | {n: F.percentile(x, q) for q, n in zip(_QS, _QN, strict=True)}
    return returns(spark, sf_dir).where(x.isNotNull()).groupBy("security").agg(F.count("*").alias("rows"), *(F.round(v, 6).alias(k) for k, v in parts.items()))


_LONG = ["future_return_126", "future_return_252", "future_max_252", "goodness", "min_drawdown_63", "peak_share", "trough_share"]


@query(f"""{WALK}, o AS (SELECT *, {", ".join(f"lead(price, {h}) OVER {W} / price - 1 AS r{h}" for h in (21, 63, 126, 252))}, max(price) OVER (PARTITION BY security ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 252 FOLLOWING) / price - 1 AS m252,
  max(price) OVER (PARTITION BY security ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING) / price - 1 AS m63, min(price) OVER (PARTITION BY security ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING) / price - 1 AS n63, count(*) OVER (PARTITION BY security ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING) AS n,
  list(price) OVER (PARTITION BY security ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING) AS ahead FROM walk)
SELECT security, session, round(r126, 6) AS future_return_126, round(r252, 6) AS future_return_252, round(m252, 6) AS future_max_252, round(greatest(0, coalesce(greatest(r21, r63, r126, r252), 0)), 6) AS goodness, round(CASE WHEN n >= 21 THEN n63 END, 6) AS min_drawdown_63,
  round(list_position(ahead, list_max(ahead)) / 63, 6) AS peak_share, round(list_position(ahead, list_min(ahead)) / 63, 6) AS trough_share, coalesce(n63 <= -0.1 AND m63 < 0.3, false) AS hard_negative FROM o""")
def long_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, near, far = F.col("price"), by_time().rowsBetween(1, 63), by_time().rowsBetween(1, 252)
    rows = walk(spark, sf_dir).withColumns({f"_r{h}": F.lead(p, h).over(by_time()) / p - 1 for h in (21, 63, 126, 252)})
    lowest, highest, o = F.min(p).over(near) / p - 1, F.max(p).over(near) / p - 1, F.col("ordinal")
    rows = rows.withColumns({
        "future_return_126": F.col("_r126"), "future_return_252": F.col("_r252"), "future_max_252": F.max(p).over(far) / p - 1,
        "goodness": F.greatest(F.lit(0.0), F.coalesce(F.greatest("_r21", "_r63", "_r126", "_r252"), F.lit(0.0))), "min_drawdown_63": F.when(F.count("*").over(near) >= 21, lowest),
        "peak_share": (F.max_by(o, F.struct(p, -o)).over(near) - o) / 63, "trough_share": (F.min_by(o, F.struct(p, o)).over(near) - o) / 63,
        "hard_negative": F.coalesce((lowest <= -0.1) & (highest < 0.3), F.lit(False)),
    })
    return rounded_rows(rows, ["security", "session", "hard_negative"], _LONG)


_BLANK = "CASE WHEN cycle % 2 = 0 OR ordinal % 3 > 0 THEN -1 ELSE {} END AS {}"


@query(f"""{_DETECTED}, i AS (SELECT *, row_number() OVER (PARTITION BY security ORDER BY start_idx) - 1 AS cycle FROM found),
m AS (SELECT w.security, w.ordinal, w.price, i.cycle, i.start_idx AS s, i.end_idx AS e, i.peak_idx AS p FROM walk w JOIN i ON i.security = w.security AND w.ordinal BETWEEN i.start_idx AND i.end_idx),
b AS (SELECT security, ordinal, price, cycle, {", ".join(_BLANK.format(a, n) for a, n in (("s", "start_idx"), ("e", "end_idx"), ("p", "peak_idx")))} FROM m),
g AS (SELECT security, cycle, count(*) AS rows, coalesce(arg_min(start_idx, ordinal) FILTER (start_idx >= 0), min(ordinal)) AS start_idx, coalesce(arg_min(end_idx, ordinal) FILTER (end_idx >= 0), max(ordinal)) AS end_idx, coalesce(arg_min(peak_idx, ordinal) FILTER (peak_idx >= 0), arg_min(ordinal, (-price, ordinal))) AS peak_idx, sum(ordinal) AS o FROM b GROUP BY 1, 2)
SELECT security, CAST(cycle AS INT) AS cycle, rows, start_idx, end_idx, peak_idx, greatest(end_idx - start_idx + 1, 1) AS duration, CAST(rows * peak_idx - o AS BIGINT) AS lead, round(CASE WHEN rows > 1 THEN rows / 2.0 ELSE 0 END, 6) AS progress FROM g""")
def cycle_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of detected cycles, of which two rows in three and every second cycle lost theirs, filled in again."""
    prices, found = walk(spark, sf_dir), _detected(spark, sf_dir)
    rows = cycles.annotate(prices.select("security", "ordinal"), found).where("cycle >= 0").join(prices.select("security", "ordinal", "price"), ["security", "ordinal"])
    numbered = found.select("security", *_KEYS[1:], (F.row_number().over(Window.partitionBy("security").orderBy("start_idx")) - 1).alias("cycle"))
    blank = (F.col("cycle") % 2 == 0) | (F.col("ordinal") % 3 > 0)
    rows = rows.join(numbered, ["security", "cycle"]).withColumns({c: F.when(blank, -1).otherwise(F.col(c)) for c in _KEYS[1:]})
    filled = cycles.backfill(rows)
    one = lambda c: F.first(c).alias(c)
    return filled.groupBy("security", "cycle").agg(F.count("*").alias("rows"), *map(one, _KEYS[1:]), one("duration"), F.sum("lead_to_peak").alias("lead"), F.round(F.sum("progress"), 6).alias("progress"))
