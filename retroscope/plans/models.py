"""Queries of models fitted from sums: reliability, domain shift, decodability, added fit and boosted trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retroscope.functions.orders import cumulative
from retroscope.functions.stored import cut
from retroscope.functions.windows import percent_rank
from retroscope.operators import decisions, diagnostics, models
from retroscope.plans.cleaning import SEEDS, seeds
from retroscope.plans.common import RETURNS, query, rank, returns, rounded_rows

FEATURES = ["momentum", "daily_return", "spread"]
ALL = [*FEATURES, "shift"]
FIT_SHARE, EMBARGO, STEPS, CLASSIFIER_PENALTY, ERROR_PENALTY, EPSILON = 0.7, 63, 8, 10.0, 1.0, 1.35


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a known outcome, features that can be missing, and error, how far the outcome is from what momentum says."""
    rows = returns(spark, sf_dir).where("future is not null").withColumn("spread", F.col("high") / F.col("low") - 1)
    return rows.select("security", "market", "session", *FEATURES, "future", F.abs(F.col("future") - F.coalesce("momentum", F.lit(0.0))).alias("error"))


def _periods(rows: DataFrame) -> DataFrame:
    """rows with fit (up to a share of the sessions) and calibrate (from an embargo after it on)."""
    days = rows.select("session").distinct().withColumns({"_i": F.row_number().over(Window.orderBy("session")) - 1, "_n": F.count("*").over(Window.partitionBy())})  # a row per session
    cut_at = F.least(F.greatest(F.floor(F.col("_n") * FIT_SHARE), F.lit(1)), F.col("_n") - 2)
    ends = days.agg(F.max(F.when(F.col("_i") == cut_at - 1, F.col("session"))).alias("_end"), F.max(F.when(F.col("_i") == F.least(cut_at + EMBARGO, F.col("_n") - 1), F.col("session"))).alias("_start"))
    return rows.crossJoin(F.broadcast(ends)).withColumns({"fit": F.col("session") <= F.col("_end"), "calibrate": F.col("session") >= F.col("_start")}).drop("_end", "_start")


_X = f"""{RETURNS}, x AS MATERIALIZED (SELECT security, market, session, momentum, daily_return, high / low - 1 AS spread, future, abs(future - coalesce(momentum, 0)) AS error FROM r WHERE future IS NOT NULL),
days AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT session FROM x)),
ends AS (SELECT max(session) FILTER (i = s - 1) AS fit_end, max(session) FILTER (i = least(s + {EMBARGO}, n - 1)) AS start FROM (SELECT *, least(greatest(CAST(floor(n * {FIT_SHARE}::DOUBLE) AS INT), 1), n - 2) AS s FROM days)),
raw AS MATERIALIZED (SELECT x.*, session <= fit_end AS fit, session >= start AS calibrate FROM x, ends)"""


def _stats_sql(source: str, columns: list[str], keep: str = "fit") -> str:
    """The median m_ and scale s_ of each column over the rows that count."""
    one = lambda c: f"median({c}) FILTER ({keep}) AS m_{c}, quantile_cont({c}, 0.75) FILTER ({keep}) - quantile_cont({c}, 0.25) FILTER ({keep}) AS w_{c}"
    return f"SELECT {', '.join(f'm_{c}, CASE WHEN w_{c} > 1e-9 THEN w_{c} ELSE 1 END AS s_{c}' for c in columns)} FROM (SELECT {', '.join(map(one, columns))} FROM {source})"


_Z = lambda c: f"CASE WHEN {c} IS NOT NULL THEN least(abs({c} - m_{c}) / s_{c}, 10) END"
_READY = f"""{_X}, q1 AS ({_stats_sql('raw', FEATURES)}),
moved AS (SELECT raw.* EXCLUDE ({', '.join(FEATURES)}), coalesce(({' + '.join(f'coalesce({_Z(c)}, 0)' for c in FEATURES)}) / nullif({' + '.join(f'CAST({c} IS NOT NULL AS INT)' for c in FEATURES)}, 0), 10) AS shift, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in FEATURES)} FROM raw, q1),
q2 AS ({_stats_sql('moved', ALL)}), z AS MATERIALIZED (SELECT * EXCLUDE ({', '.join(ALL)}), CAST(1 AS DOUBLE) AS f0, {', '.join(f'({c} - m_{c}) / s_{c} AS f{i + 1}' for i, c in enumerate(ALL))} FROM moved, q2)"""


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(_periods(_known(spark, sf_dir)))
    fitted = models.spreads(rows.where("fit"), FEATURES)
    rows = models.imputed(rows.withColumn("shift", models.shift_score(FEATURES, fitted)), FEATURES, fitted)
    return cut(models.scaled(rows, ALL, models.spreads(rows.where("fit"), ALL)))


def _sums_sql(n: int, weight: str, right: str) -> str:
    pairs = ", ".join(f"sum({weight} * f{i} * f{j}) AS a{i}_{j}, a{i}_{j} AS a{j}_{i}" if i != j else f"sum({weight} * f{i} * f{i}) AS a{i}_{i}" for i in range(n) for j in range(i + 1))
    return pairs + ", " + ", ".join(f"sum({right} * f{i}) AS c{i}" for i in range(n))


def _solved_sql(name: str, source: str, n: int, carry: str, ridge: str = "0", less: str = "") -> list[str]:
    """Tables that end in `name` with d0.., the solution of the equations a, c of source; ridge is added off the constant. less:
    a prefix of columns of which ridge times the value is taken from the right side."""
    cells = ", ".join(f"a{i}_{j}" + (f" + {ridge}" if i == j and i else "") + f" AS a{i}_{j}" for i in range(n) for j in range(n))
    sides = ", ".join(f"c{i}" + (f" - {ridge} * {less}{i}" if less and i else "") + f" AS c{i}" for i in range(n))
    out = [f"{name}_0 AS (SELECT {cells}, {sides}{carry} FROM {source})"]
    for k in range(n):
        row = lambda i, x, k=k: f"{x(k)} / a{k}_{k}" if i == k else f"{x(i)} - a{i}_{k} * {x(k)} / a{k}_{k}"
        parts = [f"{row(i, lambda r, j=j: f'a{r}_{j}')} AS a{i}_{j}" for i in range(n) for j in range(n)] + [f"{row(i, lambda r: f'c{r}')} AS c{i}" for i in range(n)]
        out.append(f"{name}_{k + 1} AS (SELECT {', '.join(parts)}{carry} FROM {name}_{k})")
    out.append(f"{name} AS MATERIALIZED (SELECT {', '.join(f'c{i} AS d{i}' for i in range(n))}{carry} FROM {name}_{n})")
    return out


def _line(b: str, n: int) -> str:
    return " + ".join(f"{b}{i} * f{i}" for i in range(n))


def _logistic_sql(name: str, source: str, n: int, label: str, weight: str, penalty: float, steps: int = STEPS) -> str:
    """Tables that end in `name` with b0.., from source with f0.. ."""
    bs = ", ".join(f"b{i}" for i in range(n))
    parts = [f"{name}b0 AS (SELECT {', '.join(f'CAST(0 AS DOUBLE) AS b{i}' for i in range(n))})"]
    for s in range(steps):
        after = name if s == steps - 1 else f"{name}b{s + 1}"
        parts.append(f"{name}s{s} AS MATERIALIZED (SELECT {_sums_sql(n, 'w * p * (1 - p)', 'w * (y - p)')}, {', '.join(f'any_value(b{i}) AS b{i}' for i in range(n))} FROM (SELECT {', '.join(f'f{i}' for i in range(n))}, {bs}, CAST({label} AS INT) AS y, {weight} AS w, 1 / (1 + exp(-({_line('b', n)}))) AS p FROM {source}, {name}b{s}))")
        parts += _solved_sql(f"{name}d{s}", f"{name}s{s}", n, f", {bs}", str(penalty), "b")
        parts.append(f"{after} AS MATERIALIZED (SELECT {', '.join(f'b{i} + d{i} AS b{i}' for i in range(n))} FROM {name}d{s})")
    return ", ".join(parts)


_HUBER_STEPS = 12


def _huber_sql(n: int = 5) -> str:
    bs = ", ".join(f"b{i}" for i in range(n))
    parts = [f"hs0 AS MATERIALIZED (SELECT {_sums_sql(n, '1', 'error')}, sum(error * error) AS yy, count(*) AS n FROM z WHERE fit)"]
    parts += _solved_sql("hd0", "hs0", n, "")
    left = " + ".join(f"d{i} * d{j} * a{i}_{j}" for i in range(n) for j in range(n))
    parts.append(f"h0 AS MATERIALIZED (SELECT {', '.join(f'd{i} AS b{i}' for i in range(n))}, sqrt((yy - 2 * ({' + '.join(f'd{i} * c{i}' for i in range(n))}) + {left}) / n) AS scale FROM hd0, hs0)")
    for s in range(_HUBER_STEPS):
        rows = f"SELECT z.*, h{s}.*, error - ({_line('b', n)}) AS e FROM z, h{s} WHERE fit"
        weighed = f"SELECT *, CASE WHEN abs(e) <= {EPSILON}::DOUBLE * scale THEN 1 ELSE {EPSILON}::DOUBLE * scale / abs(e) END AS w FROM ({rows})"
        parts.append(f"hs{s + 1} AS MATERIALIZED (SELECT {_sums_sql(n, 'w', 'w * error')}, any_value(scale) AS old, count(*) AS n, count(*) FILTER (abs(e) > {EPSILON}::DOUBLE * scale) AS out, sum(e * e) FILTER (abs(e) <= {EPSILON}::DOUBLE * scale) AS squares FROM ({weighed}))")
        parts += _solved_sql(f"hd{s + 1}", f"hs{s + 1}", n, ", old, n, out, squares", f"({ERROR_PENALTY} * old)")
        parts.append(f"h{s + 1} AS MATERIALIZED (SELECT {', '.join(f'd{i} AS b{i}' for i in range(n))}, sqrt(squares / greatest(n - {EPSILON}::DOUBLE ** 2 * out, 1)) AS scale FROM hd{s + 1})")
    return ", ".join(parts)


_USEFUL = "CASE WHEN future > 0 THEN nr / (2 * np) ELSE nr / (2 * (nr - np)) END"
_CLASSIFIER = f"zf AS (SELECT z.*, nr, np FROM z, (SELECT CAST(count(*) AS DOUBLE) AS nr, CAST(count(*) FILTER (future > 0) AS DOUBLE) AS np FROM z WHERE fit) WHERE fit), {_logistic_sql('g', 'zf', 5, 'future > 0', _USEFUL, CLASSIFIER_PENALTY)}"


def _classifier(rows: DataFrame) -> np.ndarray:
    """Whether a trade gains, both classes weighed alike."""
    useful = F.col("future") > 0
    n, p = rows.agg(F.count("*"), F.sum(useful.cast("double"))).first()
    balanced = F.when(useful, n / (2 * p)).otherwise(n / (2 * (n - p)))
    return models.logistic(rows, ALL, useful, balanced, CLASSIFIER_PENALTY, STEPS)


_TERMS = ["constant", *ALL]


@query(f"""{_READY}, {_CLASSIFIER}, {_huber_sql()} SELECT term, round(useful, 6) AS useful, round(error, 6) AS error FROM (SELECT {', '.join(f"'{t}' AS t{i}" for i, t in enumerate(_TERMS))}, g.*, {', '.join(f'h{_HUBER_STEPS}.b{i} AS e{i}' for i in range(5))}, scale FROM g, h{_HUBER_STEPS}),
LATERAL (SELECT unnest([{', '.join(f'{{"term": t{i}, "useful": b{i}, "error": e{i}}}' for i in range(5))}, {{"term": 'scale', "useful": CAST(NULL AS DOUBLE), "error": scale}}], recursive := true))""".replace('"term"', "'term'").replace('"useful"', "'useful'").replace('"error"', "'error'"))
def reliability_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of whether a trade gains (logistic) and of how wrong its forecast is (Huber), fitted on the early sessions."""
    rows = _ready(spark, sf_dir).where("fit")
    useful = _classifier(rows)
    error, scale = models.huber(rows, ALL, "error", ERROR_PENALTY, EPSILON, _HUBER_STEPS)
    table = [*((t, float(a), float(b)) for t, a, b in zip(_TERMS, useful, error, strict=True)), ("scale", None, float(scale))]
    return rounded_rows(spark.createDataFrame(table, "term string, useful double, error double"), ["term"], ["useful", "error"])


_BINS = 40


@query(f"""{_READY}, {_CLASSIFIER}, sc AS MATERIALIZED (SELECT round(1 / (1 + exp(-({_line('b', 5)}))), 9) AS p, future > 0 AS useful FROM z, g WHERE calibrate), pl AS (SELECT *, CAST(floor(CAST((rank() OVER (ORDER BY p) - 1) * {_BINS} AS DOUBLE) / count(*) OVER ()) AS BIGINT) AS bin FROM sc),
pt AS MATERIALIZED (SELECT bin, count(*) AS rows, avg(p) AS score, avg(CAST(useful AS INT)) AS rate FROM pl GROUP BY 1),
ab AS (SELECT a.bin AS a, b.bin AS b, sum(p.rate * p.rows) / sum(p.rows) AS m FROM pt a JOIN pt b ON a.bin <= b.bin JOIN pt p ON p.bin BETWEEN a.bin AND b.bin GROUP BY 1, 2), lo AS (SELECT p.bin, a, min(m) AS l FROM ab JOIN pt p ON p.bin BETWEEN a AND b GROUP BY 1, 2)
SELECT bin, rows, round(score, 6) AS score, round(rate, 6) AS rate, round(max(l), 6) AS calibrated FROM pt JOIN lo USING (bin) GROUP BY ALL""")
def reliability_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the late sessions in bins of about equal size, and the increasing chances of gain that fit them best."""
    rows = _ready(spark, sf_dir)
    weights = _classifier(rows.where("fit"))
    scored = rows.where("calibrate").select(F.round(1 / (1 + F.exp(-models.linear(weights, ALL))), 9).alias("p"), (F.col("future") > 0).cast("int").alias("useful"))
    values = cumulative(scored, "p", [], {"useful": F.col("useful")}).crossJoin(F.broadcast(scored.agg(F.count("*").alias("_all"))))
    n = F.col("n")
    bins = values.groupBy(F.floor((F.col("before") * _BINS).cast("double") / F.col("_all")).cast("bigint").alias("bin")).agg(F.sum("n").alias("rows"), (F.sum(n * F.col("p")) / F.sum("n")).alias("score"), (F.sum("useful") / F.sum("n")).alias("rate"))
    bins = cut(bins)
    steps = decisions.monotone_blocks(bins.select("bin", F.col("rate").alias("mean"), F.col("rows").alias("weight")))
    return rounded_rows(bins.join(steps.withColumnRenamed("value", "calibrated"), "bin"), ["bin", "rows"], ["score", "rate", "calibrated"])


_TESTED = "CAST(('0x' || substr(sha256('7:' || security || ':' || strftime(session, '%Y-%m-%d')), 1, 8)) AS BIGINT)"


def _hashed(seed: int) -> F.Column:
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "security", F.date_format("session", "yyyy-MM-dd")), 256), 1, 8), 16, 10).cast("bigint")


@query(f"""{_X}, k AS MATERIALIZED (SELECT *, NOT fit AS late, {_TESTED} < 1288490188 AS test FROM raw), qd AS ({_stats_sql('k', FEATURES, 'NOT test')}),
ki AS (SELECT k.* EXCLUDE ({', '.join(FEATURES)}), {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in FEATURES)} FROM k, qd), qe AS ({_stats_sql('ki', FEATURES, 'NOT test')}),
kz AS MATERIALIZED (SELECT late, test, CAST(1 AS DOUBLE) AS f0, {', '.join(f'({c} - m_{c}) / s_{c} AS f{i + 1}' for i, c in enumerate(FEATURES))} FROM ki, qe), kt AS (SELECT * FROM kz WHERE NOT test), {_logistic_sql('g', 'kt', 4, 'late', '1', 10.0)},
ks AS (SELECT late, 1 / (1 + exp(-({_line('b', 4)}))) AS p FROM kz, g WHERE test), kr AS (SELECT late, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM ks)
SELECT count(*) AS rows, count(*) FILTER (late) AS positives, round((sum(r) FILTER (late) - CAST(count(*) FILTER (late) AS DOUBLE) * (count(*) FILTER (late) + 1) / 2) / (CAST(count(*) FILTER (late) AS DOUBLE) * count(*) FILTER (NOT late)), 6) AS auc FROM kr""")
def domain_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether late sessions can be told from early ones: the AUC of a logistic model on rows held out by hash."""
    rows = cut(_periods(_known(spark, sf_dir)).withColumns({"late": ~F.col("fit"), "test": _hashed(7) < 1288490188}))
    spread = models.spreads(rows.where("not test"), FEATURES)
    rows = models.imputed(rows, FEATURES, spread)
    rows = cut(models.scaled(rows, FEATURES, models.spreads(rows.where("not test"), FEATURES)))
    weights = models.logistic(rows.where("not test"), FEATURES, F.col("late"), None, 10.0, STEPS)
    held = rows.where("test").withColumn("p", 1 / (1 + F.exp(-models.linear(weights, FEATURES))))
    return rounded_rows(models.auc(held, "p", F.col("late"), []), ["rows", "positives"], ["auc"])


_FOLDS = 5
_WHOLE = f"{RETURNS}, x AS MATERIALIZED (SELECT market, CAST(('0x' || substr(sha256('3:' || security || ':' || strftime(session, '%Y-%m-%d')), 1, 8)) AS BIGINT) % {_FOLDS} AS fold, CAST(1 AS DOUBLE) AS f0, daily_return AS f1, high / low - 1 AS f2, momentum AS f3, future FROM r WHERE momentum IS NOT NULL AND daily_return IS NOT NULL AND future IS NOT NULL)"


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir).where("momentum is not null and daily_return is not null").withColumn("fold", (_hashed(3) % _FOLDS).cast("int"))


@query(f"""{_WHOLE}, mk AS (SELECT DISTINCT market AS target FROM x), fo AS (SELECT DISTINCT fold FROM x),
sm AS MATERIALIZED (SELECT fo.fold, target, {_sums_sql(4, '1', 'CAST(market = target AS INT)')} FROM fo JOIN x ON x.fold <> fo.fold, mk GROUP BY 1, 2), {', '.join(_solved_sql('w', 'sm', 4, ', fold, target', '1.0'))},
sc AS (SELECT w.fold, target, market = target AS y, {_line('d', 4)} AS p FROM x JOIN w ON x.fold = w.fold), rk AS (SELECT *, rank() OVER (PARTITION BY fold, target ORDER BY p) + (count(*) OVER (PARTITION BY fold, target, p) - 1) / 2.0::DOUBLE AS r FROM sc)
SELECT CAST(fold AS INT) AS fold, target AS market, count(*) AS rows, count(*) FILTER (y) AS positives, round((sum(r) FILTER (y) - CAST(count(*) FILTER (y) AS DOUBLE) * (count(*) FILTER (y) + 1) / 2) / (CAST(count(*) FILTER (y) AS DOUBLE) * count(*) FILTER (NOT y)), 6) AS auc FROM rk GROUP BY 1, 2""")
def decodability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How easily a row's market can be read from its features: AUC per fold and market of weights from all other folds."""
    rows = cut(_whole(spark, sf_dir))
    markets = sorted(r.market for r in rows.select("market").distinct().collect())  # a handful
    scored = models.fold_scores(rows, ["daily_return", "spread", "momentum"], {m: F.col("market") == m for m in markets}, "fold", 1.0)
    one = F.explode(F.arrays_zip(F.array(*map(F.lit, markets)).alias("market"), F.col("scores").alias("p")))
    long = scored.select("fold", F.col("market").alias("_own"), one.alias("s")).select("fold", "_own", F.col("s.market").alias("market"), F.col("s.p").alias("p"))
    return rounded_rows(models.auc(long, "p", F.col("_own") == F.col("market"), ["fold", "market"]), ["fold", "market", "rows", "positives"], ["auc"])


def _explained(n: int) -> str:
    left = " + ".join(f"d{i} * d{j} * a{i}_{j}" for i in range(n) for j in range(n))
    return f"1 - (yy - 2 * ({' + '.join(f'd{i} * c{i}' for i in range(n))}) + {left}) / (yy - c0 * c0 / a0_0)"


@query(f"""{_WHOLE}, sm AS MATERIALIZED (SELECT market, {_sums_sql(4, '1', 'future')}, sum(future * future) AS yy FROM x GROUP BY 1), {', '.join(_solved_sql('u', 'sm', 3, ', market', '1.0'))}, {', '.join(_solved_sql('w', 'sm', 4, ', market', '1.0'))},
f AS (SELECT sm.market, CAST(a0_0 AS BIGINT) AS rows, {_explained(3)} AS low FROM sm JOIN u USING (market)), g AS (SELECT sm.market, {_explained(4)} AS high FROM sm JOIN w USING (market))
SELECT market, rows, round(low, 6) AS base_r2, round(high, 6) AS full_r2, round(greatest(0, high - low), 6) AS added_r2 FROM f JOIN g USING (market)""")
def added_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What momentum adds to two confounders in explaining outcomes, per market."""
    rows = models.added_fit(_whole(spark, sf_dir), "market", ["daily_return", "spread"], "momentum", "future", 1.0)
    return rounded_rows(rows, ["market", "rows"], ["base_r2", "full_r2", "added_r2"])


_TREES, _EDGES, _LEAST, _RATE = 3, 16, 20, 0.1
_CELL = ", ".join(f"{{'f': {i}, 'b': b{i}}}" for i in range(3))
_BIN = lambda f: f"CASE {f} WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END"


def _trees_sql() -> str:
    edges = lambda c: f"quantile_cont({c}, [{', '.join(f'{i / _EDGES}::DOUBLE' for i in range(1, _EDGES))}]) AS e_{c}"
    place = lambda i, c: f"CASE WHEN {c} IS NULL THEN 0 ELSE len(list_filter(e_{c}, lambda e: e < {c})) END AS b{i}"
    parts = [f"ed AS (SELECT {', '.join(map(edges, FEATURES))}, avg(future) AS y0 FROM x)", f"k0 AS MATERIALIZED (SELECT future AS y, y0 AS pred, {', '.join(place(i, c) for i, c in enumerate(FEATURES))} FROM x, ed)"]
    for t in range(_TREES):
        parts.append(f"g{t}_0 AS MATERIALIZED (SELECT *, 0 AS node FROM k{t})")
        for level in range(2):
            cells = f"SELECT node, c.f AS f, c.b AS b, count(*) AS n, sum(res) AS s FROM (SELECT node, y - pred AS res, unnest([{_CELL}]) AS c FROM g{t}_{level}) GROUP BY 1, 2, 3"
            sums = f"SELECT *, sum(n) OVER (PARTITION BY node, f ORDER BY b) AS nl, sum(s) OVER (PARTITION BY node, f ORDER BY b) AS sl, sum(n) OVER (PARTITION BY node, f) AS nn, sum(s) OVER (PARTITION BY node, f) AS ss FROM ({cells})"
            gains = f"SELECT node, f, b, sl * sl / (nl + 1) + (ss - sl) * (ss - sl) / (nn - nl + 1) - ss * ss / (nn + 1) AS gain FROM ({sums}) WHERE nl >= {_LEAST} AND nn - nl >= {_LEAST}"
            parts.append(f"s{t}_{level} AS MATERIALIZED (SELECT * FROM ({gains}) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1)")
            parts.append(f"g{t}_{level + 1} AS MATERIALIZED (SELECT g.* EXCLUDE (node), g.node * 2 + CASE WHEN {_BIN('s.f')} > s.b THEN 1 ELSE 0 END AS node FROM g{t}_{level} g LEFT JOIN s{t}_{level} s USING (node))")
        parts.append(f"l{t} AS MATERIALIZED (SELECT node, count(*) AS n, {_RATE}::DOUBLE * sum(y - pred) / (count(*) + 1) AS value FROM g{t}_2 GROUP BY 1)")
        parts.append(f"k{t + 1} AS MATERIALIZED (SELECT g.* EXCLUDE (node, pred), pred + value AS pred FROM g{t}_2 g JOIN l{t} USING (node))")
    return ", ".join(parts)


_TREE_ROWS = " UNION ALL ".join(f"SELECT {t} AS tree, CAST(l.node AS INT) AS leaf, l.n AS rows, round(value, 9) AS value, CAST(a.f AS INT) AS root_feature, CAST(a.b AS INT) AS root_bin, CAST(b.f AS INT) AS feature, CAST(b.b AS INT) AS bin FROM l{t} l LEFT JOIN s{t}_0 a ON a.node = 0 LEFT JOIN s{t}_1 b ON b.node = l.node // 2" for t in range(_TREES))


def _grown(spark: SparkSession, sf_dir: str) -> tuple[list[dict], DataFrame]:
    return models.boosted(_known(spark, sf_dir), FEATURES, "future", _TREES, 2, _EDGES, _RATE, _LEAST, 1.0)


@query(f"{_X}, {_trees_sql()} {_TREE_ROWS}")
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three trees of two levels, one row per leaf with the cuts above it."""
    made, _ = _grown(spark, sf_dir)
    at = lambda tree, level, node: (tree["splits"].get((level, node)) or (None, None, None))[1:]
    rows = [(t, node, n, round(float(v), 9), *at(tree, 0, 0), *at(tree, 1, node // 2)) for t, tree in enumerate(made) for node, (n, v) in tree["leaves"].items()]
    return spark.createDataFrame(rows, "tree int, leaf int, rows bigint, value double, root_feature int, root_bin int, feature int, bin int")


@query(f"""{_X}, {_trees_sql()}, p AS MATERIALIZED (SELECT y, round(pred, 9) AS score FROM k{_TREES}), q AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM p),
d AS MATERIALIZED (SELECT CAST(least(floor(r * 10 / (SELECT count(*) FROM p)), 9) AS INT) AS decile, count(*) AS rows, avg(y) AS m, avg(CAST(y > 0 AS INT)) AS up FROM q GROUP BY 1),
e AS (SELECT *, row_number() OVER (ORDER BY decile) AS i, {rank('m', '1').replace('PARTITION BY 1 ORDER', 'ORDER').replace('PARTITION BY 1, ', 'PARTITION BY ').replace('OVER (PARTITION BY 1)', 'OVER ()')} AS rm FROM d)
SELECT count(*) AS deciles, CAST(sum(rows) AS BIGINT) AS rows, (SELECT round(corr(r, ry), 6) FROM q) AS spearman, round(arg_max(m, decile) - (SELECT avg(y) FROM p), 6) AS top_lift, round(arg_max(m, decile) - arg_min(m, decile), 6) AS top_less_bottom, round(corr(decile, rm), 6) AS monotonicity, round(arg_max(up, decile), 6) AS top_positive FROM e""")
def boosted_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the trees' scores order outcomes: rank correlation, lift of the top decile, its lead over the bottom, monotonicity."""
    _, rows = _grown(spark, sf_dir)
    scored = cut(rows.select(F.round("prediction", 9).alias("score"), F.col("future").alias("y")))
    return models.ordering(scored, "score", "y")


_GATE_STEPS = 10
_Z3 = ("abs(base)", "abs(base - memory)", "abs(memory)")


def _gate_sql() -> str:
    parts = [f"gz AS MATERIALIZED (SELECT base, memory, y, w, {', '.join(f'({z} - avg({z}) OVER ()) / CASE WHEN stddev_pop({z}) OVER () > 1e-12 THEN stddev_pop({z}) OVER () ELSE 1 END AS z{i}' for i, z in enumerate(_Z3))} FROM gr)", "gt0 AS (SELECT " + ", ".join(f"CAST(0 AS DOUBLE) AS {n}{i}" for n in "tmv" for i in range(4)) + ")"]
    for s in range(_GATE_STEPS):
        parts.append(f"gg{s} AS (SELECT *, 1 / (1 + exp(-(t0 * z0 + t1 * z1 + t2 * z2 + t3))) AS g FROM gz, gt{s})")
        parts.append(f"ge{s} AS (SELECT *, 2 * w * (base + g * (memory - base) - y) * (memory - base) * g * (1 - g) AS d FROM gg{s})")
        sums = ", ".join(f"sum(d{f' * z{i}' if i < 3 else ''}) / sum(w) + 0.001::DOUBLE * any_value(t{i}) AS g{i}, any_value(t{i}) AS t{i}, any_value(m{i}) AS m{i}, any_value(v{i}) AS v{i}" for i in range(4))
        parts.append(f"gs{s} AS MATERIALIZED (SELECT {sums} FROM ge{s})")
        parts.append(f"ga{s} AS (SELECT {', '.join(f't{i}, 0.9::DOUBLE * m{i} + 0.1::DOUBLE * g{i} AS m{i}, 0.999::DOUBLE * v{i} + 0.001::DOUBLE * g{i} * g{i} AS v{i}' for i in range(4))} FROM gs{s})")
        parts.append(f"gt{s + 1} AS MATERIALIZED (SELECT {', '.join(f't{i} - 0.05::DOUBLE * (m{i} / {1 - 0.9 ** (s + 1)!r}::DOUBLE) / (sqrt(v{i} / {1 - 0.999 ** (s + 1)!r}::DOUBLE) + 1e-8) AS t{i}, m{i}, v{i}' for i in range(4))} FROM ga{s})")
    return ", ".join(parts)


@query(f"""{_WHOLE}, gr AS (SELECT greatest(-1, least(1, f3)) AS base, greatest(-1, least(1, f1)) AS memory, greatest(-1, least(1, future)) AS y, 1.0::DOUBLE / count(*) OVER (PARTITION BY market) AS w FROM x), {_gate_sql()},
mx AS (SELECT base, memory, y, w, 1 / (1 + exp(-(t0 * z0 + t1 * z1 + t2 * z2 + t3))) AS g FROM gz, gt{_GATE_STEPS})
SELECT count(*) AS rows, round(any_value(t0), 6) AS a_base, round(any_value(t1), 6) AS a_gap, round(any_value(t2), 6) AS a_memory, round(any_value(t3), 6) AS bias, round(avg(g), 6) AS mean_gate, round(sum(w * (base - y) ** 2) / sum(w), 6) AS base_error, round(sum(w * (base + g * (memory - base) - y) ** 2) / sum(w), 6) AS mixed_error FROM mx, gt{_GATE_STEPS}""")
def trust_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate between two forecasts after some steps, all markets weighed alike, and what mixing by it gains."""
    unit = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c)))
    rows = _whole(spark, sf_dir)
    sizes = rows.groupBy("market").agg((1 / F.count("*")).alias("w"))
    rows = cut(rows.join(F.broadcast(sizes), "market").select(unit("momentum").alias("base"), unit("daily_return").alias("memory"), unit("future").alias("y"), "w"))
    gate = models.fit_gate(rows, "base", "memory", "y", "w", _GATE_STEPS)
    rows = rows.withColumn("g", models.gate_value(gate, "base", "memory"))
    error = lambda g: F.sum(F.col("w") * F.pow(F.col("base") + g * (F.col("memory") - F.col("base")) - F.col("y"), F.lit(2))) / F.sum("w")
    out = rows.agg(F.count("*").alias("rows"), *(F.lit(float(v)).alias(n) for n, v in zip(("a_base", "a_gap", "a_memory", "bias"), [*gate["a"], gate["b"]], strict=True)), F.avg("g").alias("mean_gate"), error(F.lit(0.0)).alias("base_error"), error(F.col("g")).alias("mixed_error"))
    return rounded_rows(out, ["rows"], ["a_base", "a_gap", "a_memory", "bias", "mean_gate", "base_error", "mixed_error"])


_SHARES = [0.75, 0.5, 0.25]


@query(f"""{_X}, th AS (SELECT unnest([{', '.join(f'{s}::DOUBLE' for s in _SHARES)}]) AS share), tv AS (SELECT share, (SELECT quantile_cont(daily_return, [{', '.join(f'{1 - s}::DOUBLE' for s in _SHARES)}]) FROM raw WHERE fit)[CASE share {' '.join(f'WHEN {s} THEN {i + 1}' for i, s in enumerate(_SHARES))} END] AS threshold FROM th)
SELECT share, round(threshold, 6) AS threshold, count(*) AS rows, count(*) FILTER (daily_return >= threshold) AS passed, round(avg(CAST(coalesce(daily_return >= threshold, false) AS INT)), 6) AS covered, round(avg(future) FILTER (daily_return >= threshold), 6) AS mean FROM tv, raw WHERE NOT fit GROUP BY share, threshold""")
def locked_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds set on the early sessions, and what share of the later rows reaches them, with the outcomes of these."""
    rows = cut(_periods(_known(spark, sf_dir)))
    return rounded_rows(models.coverage(rows, "daily_return", "future", F.col("fit"), _SHARES), ["share", "rows", "passed"], ["threshold", "covered", "mean"])


@query(f"""{SEEDS.replace('WITH s AS', 'WITH s0 AS')}, s AS (SELECT s0.*, round(score, 9) AS sc FROM s0), rk AS (SELECT seed, session, security, {rank('sc', 'session, seed')} AS r FROM s),
{RETURNS.replace('WITH bars AS', 'bars AS', 1)}, j AS (SELECT rk.*, future FROM rk JOIN r USING (session, security) WHERE future IS NOT NULL), m AS (SELECT session, security, count(*) AS seeds, avg(r) AS r, stddev_pop(r) AS spread, any_value(future) AS future FROM j GROUP BY 1, 2),
one AS (SELECT seed, corr(x, y) AS v FROM (SELECT seed, {rank('r', 'seed')} AS x, {rank('future', 'seed')} AS y FROM j) GROUP BY 1), al AS (SELECT corr(x, y) AS v, count(*) AS rows FROM (SELECT rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY future) + (count(*) OVER (PARTITION BY future) - 1) / 2.0::DOUBLE AS y FROM (SELECT round(r, 9) AS r, future FROM m)))
SELECT al.rows, (SELECT count(*) FROM one) AS seeds, round((SELECT avg(spread) FROM m), 6) AS rank_spread, round(al.v, 6) AS ensemble, round((SELECT avg(v) FROM one), 6) AS seed_mean, round(al.v - (SELECT avg(v) FROM one), 6) AS lift FROM al""")
def rank_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation with outcomes of the mean of the seeds' same-date ranks, against that of a seed alone."""
    ranked = seeds(spark, sf_dir).withColumn("r", percent_rank(F.round("score", 9), "session", "seed")).select("seed", "session", "security", "r")
    rows = cut(ranked.join(returns(spark, sf_dir).where("future is not null").select("session", "security", "future"), ["session", "security"]))
    mean = rows.groupBy("session", "security").agg(F.round(F.avg("r"), 9).alias("r"), F.stddev_pop("r").alias("spread"), F.first("future").alias("future"))
    one = diagnostics.rank_correlation(rows, "r", "future", ["seed"]).agg(F.count("*").alias("seeds"), F.avg("spearman").alias("seed_mean"))
    every = diagnostics.rank_correlation(mean, "r", "future", []).select(F.col("spearman").alias("ensemble"))
    out = mean.agg(F.count("*").alias("rows"), F.avg("spread").alias("rank_spread")).crossJoin(F.broadcast(one)).crossJoin(F.broadcast(every)).withColumn("lift", F.col("ensemble") - F.col("seed_mean"))
    return rounded_rows(out, ["rows", "seeds"], ["rank_spread", "ensemble", "seed_mean", "lift"])
