"""Models fitted from sums: logistic and Huber regression by Newton steps, ridge over folds, boosted trees from histograms.

A step is one aggregate: rows are summed where they are, the driver gets a table whose size depends on the number of features
(and bins, nodes, folds) alone, solves it, and the new parameters go into the next step's expressions. Rows that
several steps read should be stored first (`functions.stored.cut`).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retroscope.functions.arrays import beside, dot
from retroscope.functions.orders import average_rank, quantiles
from retroscope.functions.stored import cut


def spreads(rows: DataFrame, features: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> dict[str, list[float]]:
    """Quantiles of each feature, nulls left out, by linear interpolation; from counts per value, in one pass for all."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("s")).select("s.*")
    found = {(r.feature, r.share): r.value for r in quantiles(long, "x", ["feature"], list(shares)).collect()}
    return {f: [found.get((f, s), float("nan")) for s in shares] for f in features}


def _scale(low: float, high: float) -> float:
    return high - low if high - low > 1e-9 else 1.0


def shift_score(features: list[str], spread: dict[str, list[float]], most: float = 10.0) -> Column:
    """How far a row lies from where rows were fitted: the mean over its features of the distance to the median in units of the
    quartiles' distance, at most `most` each; that too where all features are missing."""
    z = {f: F.when(F.col(f).isNotNull(), F.least(F.abs(F.col(f) - m) / _scale(a, b), F.lit(most))) for f, (a, m, b) in spread.items()}
    count = sum((F.col(f).isNotNull().cast("int") for f in features[1:]), F.col(features[0]).isNotNull().cast("int"))
    return F.coalesce(F.try_divide(sum((F.coalesce(z[f], F.lit(0.0)) for f in features[1:]), F.coalesce(z[features[0]], F.lit(0.0))), count), F.lit(most))


def imputed(rows: DataFrame, features: list[str], spread: dict[str, list[float]]) -> DataFrame:
    return rows.withColumns({f: F.coalesce(F.col(f), F.lit(spread[f][1])) for f in features})


def scaled(rows: DataFrame, features: list[str], spread: dict[str, list[float]]) -> DataFrame:
    """Features less their median, in units of the quartiles' distance (1 where that is 0)."""
    return rows.withColumns({f: (F.col(f) - m) / _scale(a, b) for f, (a, m, b) in ((f, spread[f]) for f in features)})


def linear(weights: np.ndarray, features: list[str]) -> Column:
    return sum((F.col(f) * float(w) for f, w in zip(features, weights[1:], strict=True)), F.lit(float(weights[0])))


def _products(features: list[str], weight: Column) -> dict[str, Column]:
    """Sums of products of each two of the features and a constant 1, lower triangle."""
    x = [F.lit(1.0), *map(F.col, features)]
    return {f"a{i}_{j}": F.sum(weight * x[i] * x[j]) for i in range(len(x)) for j in range(i + 1)}


def _moments(features: list[str], value: Column, name: str = "b") -> dict[str, Column]:
    x = [F.lit(1.0), *map(F.col, features)]
    return {f"{name}{i}": F.sum(value * x[i]) for i in range(len(x))}


def _matrix(row, n: int) -> np.ndarray:
    out = np.empty((n, n))
    for i in range(n):
        for j in range(i + 1):
            out[i, j] = out[j, i] = row[f"a{i}_{j}"]
    return out


def _penalty(n: int, size: float) -> np.ndarray:
    """Nothing on the constant."""
    return np.diag([0.0, *[size] * (n - 1)])


def logistic(rows: DataFrame, features: list[str], label: Column, weight: Column | None = None, penalty: float = 1.0, steps: int = 8) -> np.ndarray:
    """Constant and weights that minimise the weighted log loss plus penalty / 2 times the squared weights, by Newton steps from 0.

    label: 1 or 0. Each step is one aggregate.
    """
    n, weight = len(features) + 1, F.lit(1.0) if weight is None else weight
    now, ridge = np.zeros(n), _penalty(n, penalty)
    for _ in range(steps):
        p = 1 / (1 + F.exp(-linear(now, features)))
        sums = rows.withColumns({"_p": p, "_y": label.cast("double"), "_w": weight})
        r = sums.agg(*(c.alias(k) for k, c in (_products(features, F.col("_w") * F.col("_p") * (1 - F.col("_p"))) | _moments(features, F.col("_w") * (F.col("_y") - F.col("_p")))).items())).first()
        now = now + np.linalg.solve(_matrix(r, n) + ridge, np.array([r[f"b{i}"] for i in range(n)]) - ridge @ now)
    return now


def huber(rows: DataFrame, features: list[str], y: str, penalty: float = 1.0, epsilon: float = 1.35, steps: int = 12) -> tuple[np.ndarray, float]:
    """Constant and weights, and the scale, of Huber regression with a scale of its own, by reweighted steps from least squares.

    A residual beyond epsilon times the scale counts linearly. Each step solves the weighted equations of the last
    scale and takes the scale at which the loss of the last residuals is least.
    """
    n = len(features) + 1
    now, scale = np.zeros(n), 0.0
    for step in range(steps + 1):
        r = F.col(y) - linear(now, features)
        inside = F.abs(r) <= epsilon * scale
        w = F.when(inside, 1.0).otherwise(F.lit(epsilon * scale) / F.abs(r)) if step else F.lit(1.0)
        held = rows.withColumns({"_r": r, "_w": w, "_in": inside if step else F.lit(True)})
        sums = _products(features, F.col("_w")) | _moments(features, F.col("_w") * F.col(y)) | {"n": F.count("*"), "out": F.sum((~F.col("_in")).cast("double")), "squares": F.sum(F.when(F.col("_in"), F.col("_r") * F.col("_r")).otherwise(0.0)), "yy": F.sum(F.col(y) * F.col(y))}
        s = held.agg(*(c.alias(k) for k, c in sums.items())).first()
        a, b = _matrix(s, n), np.array([s[f"b{i}"] for i in range(n)])
        now = np.linalg.solve(a + _penalty(n, penalty * scale), b)
        scale = float(np.sqrt(s["squares"] / max(s["n"] - epsilon**2 * s["out"], 1.0))) if step else float(np.sqrt((s["yy"] - 2 * now @ b + now @ a @ now) / s["n"]))
    return now, scale


def auc(rows: DataFrame, score: str, label: Column, by: list[str]) -> DataFrame:
    """by, rows, positives, auc: the chance that a positive row has the higher score, ties half, from ranks."""
    ranked = average_rank(rows.withColumn("_y", label), score, by, "_r")
    out = ranked.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(F.col("_y").cast("bigint")).alias("positives"), F.sum(F.when(F.col("_y"), F.col("_r"))).alias("_s"))
    a, n = F.col("positives").cast("double"), F.col("rows").cast("double")
    return out.withColumn("auc", F.try_divide(F.col("_s") - a * (a + 1) / 2, a * (n - a))).drop("_s")


def fold_scores(rows: DataFrame, features: list[str], targets: dict[str, Column], fold: str, penalty: float) -> DataFrame:
    """rows (with fold, from 0) and scores: one ridge score per target, by weights from all other folds.

    One aggregate gives the sums of each fold; those of all others are the total less the fold's own.
    """
    n = len(features) + 1
    sums = _products(features, F.lit(1.0))
    for k, t in enumerate(targets.values()):
        sums |= _moments(features, t.cast("double"), f"t{k}_")
    parts = {r[fold]: r for r in rows.groupBy(fold).agg(*(c.alias(k) for k, c in sums.items())).collect()}
    gram = {f: _matrix(r, n) for f, r in parts.items()}
    right = {f: np.array([[r[f"t{k}_{i}"] for i in range(n)] for k in range(len(targets))]) for f, r in parts.items()}
    weights = np.zeros((max(parts, default=-1) + 1, len(targets) * n))
    for f in parts:
        rest = sum((gram[g] for g in parts if g != f), np.zeros((n, n))), sum((right[g] for g in parts if g != f), np.zeros((len(targets), n)))
        weights[f] = np.linalg.lstsq(rest[0] + _penalty(n, penalty), rest[1].T, rcond=None)[0].T.ravel()
    x = F.array(F.lit(1.0), *map(F.col, features))
    own = F.get("_weights", F.col(fold))
    scores = F.transform(F.sequence(F.lit(0), F.lit(len(targets) - 1)), lambda k: dot(x, F.slice(own, k * n + 1, n)))
    return beside(rows, _weights=weights).withColumn("scores", scores).drop("_weights")


def added_fit(rows: DataFrame, by: str, base: list[str], added: str, y: str, penalty: float) -> DataFrame:
    """by, rows, base_r2, full_r2 and added_r2 (at least 0): how much of y a ridge explains without and with one more feature.

    Sums come in one pass; by has few values.
    """
    every, yy = [*base, added], F.col(y)
    sums = _products(every, F.lit(1.0)) | _moments(every, yy) | {"n": F.count("*"), "yy": F.sum(yy * yy)}
    out = []
    for r in rows.groupBy(by).agg(*(c.alias(k) for k, c in sums.items())).collect():
        a, b = _matrix(r, len(every) + 1), np.array([r[f"b{i}"] for i in range(len(every) + 1)])
        all_ = r["yy"] - b[0] ** 2 / r["n"]

        def r2(n: int) -> float:
            w = np.linalg.solve(a[:n, :n] + _penalty(n, penalty), b[:n])
            return float(1 - (r["yy"] - 2 * w @ b[:n] + w @ a[:n, :n] @ w) / all_)  # noqa: B023

        low, high = r2(len(base) + 1), r2(len(every) + 1)
        out.append((r[by], r["n"], low, high, max(0.0, high - low)))
    return rows.sparkSession.createDataFrame(out, f"{by} {rows.schema[by].dataType.simpleString()}, rows bigint, base_r2 double, full_r2 double, added_r2 double")


def binned(rows: DataFrame, features: list[str], bins: int) -> tuple[DataFrame, np.ndarray]:
    """rows with _bins, how many of bins - 1 quantiles of each feature lie below its value (missing: 0), and the quantiles."""
    edges = spreads(rows, features, tuple(i / bins for i in range(1, bins)))
    table = np.array([edges[f] for f in features])
    below = lambda i, f: F.size(F.filter(F.get("_edges", i), lambda e: e < F.col(f)))
    place = F.array(*(F.when(F.col(f).isNull(), 0).otherwise(below(i, f)) for i, f in enumerate(features)))
    return beside(rows, _edges=table).withColumn("_bins", place).drop("_edges"), table


def _split(cells: list, least: int, ridge: float) -> tuple | None:
    """(gain, feature, bin) of the best cut of a node whose cells are (feature, bin, n, sum); None where no cut leaves enough rows."""
    best = None
    for f in sorted({c[0] for c in cells}):
        own = sorted(c[1:] for c in cells if c[0] == f)
        n, s = sum(c[1] for c in own), sum(c[2] for c in own)
        left, total = 0, 0.0
        for b, count, part in own:
            left, total = left + count, total + part
            if left < least or n - left < least:
                continue
            gain = total**2 / (left + ridge) + (s - total) ** 2 / (n - left + ridge) - s**2 / (n + ridge)
            if gain > 0 and (best is None or gain > best[0]):
                best = gain, f, b
    return best


def boosted(rows: DataFrame, features: list[str], y: str, trees: int, depth: int, bins: int = 16, rate: float = 0.1, least: int = 20, ridge: float = 1.0, store_every: int = 8) -> tuple[list[dict], DataFrame]:
    """Gradient boosting for squared error on binned features: the trees, and rows with prediction.

    All nodes of a level get their gradient histograms in one aggregate by node, feature and bin, so no more than
    2^depth * features * bins rows reach the driver. Cuts are the best of a node (ties to the first feature and bin) that leave at
    least `least` rows on each side; leaves are rate * sum / (rows + ridge). Missing values lie below all others.
    A tree is {"splits": {(level, node): (gain, feature, bin)}, "leaves": {node: (rows, value)}}.
    """
    rows, _ = binned(rows, features, bins)
    first = rows.agg(F.avg(y)).first()[0] or 0.0
    rows, made = cut(rows.withColumn("prediction", F.lit(float(first)))), []
    for t in range(trees):
        grown = rows.withColumns({"_node": F.lit(0), "_r": F.col(y) - F.col("prediction")})
        splits: dict[tuple[int, int], tuple] = {}
        for level in range(depth):
            cell = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.get("_bins", i).alias("b")) for i in range(len(features)))))
            found = grown.select("_node", "_r", cell.alias("c")).groupBy("_node", "c.f", "c.b").agg(F.count("*").alias("n"), F.sum("_r").alias("s")).collect()
            for node in range(2**level):
                best = _split([(r.f, r.b, r.n, r.s) for r in found if r["_node"] == node], least, ridge)
                if best:
                    splits[level, node] = best
            right = F.lit(0)
            for (at, node), (_, f, b) in splits.items():
                right = F.when((F.col("_node") == node) & (F.get("_bins", f) > b), 1).otherwise(right) if at == level else right
            grown = grown.withColumn("_node", F.col("_node") * 2 + right)
        sums = grown.groupBy("_node").agg(F.count("*").alias("n"), F.sum("_r").alias("s")).collect()
        leaves = {r["_node"]: (r.n, rate * r.s / (r.n + ridge)) for r in sums}
        value = F.lit(0.0)
        for node, (_, v) in leaves.items():
            value = F.when(F.col("_node") == node, F.lit(float(v))).otherwise(value)
        made.append({"splits": splits, "leaves": leaves})
        rows = grown.withColumn("prediction", F.col("prediction") + value).drop("_node", "_r")
        rows = cut(rows) if (t + 1) % store_every == 0 else rows
    return made, rows.drop("_bins")


def ordering(rows: DataFrame, score: str, outcome: str) -> DataFrame:
    """One row: deciles (that hold a row), rows, spearman of score and outcome, the top decile's mean outcome less all rows' (top_lift)
    and less the bottom's (top_less_bottom), the correlation of a decile's number with the rank of its mean, and the share of
    positive outcomes in the top decile. Ranks come from counts per value; ties share a rank, so a decile."""
    known = rows.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).select(F.col(score).alias("s"), F.col(outcome).alias("y"))
    every = known.agg(F.count("*").alias("_n"), F.avg("y").alias("_mean"))
    ranked = average_rank(average_rank(known, "s", [], "_r"), "y", [], "_q").crossJoin(F.broadcast(every))
    decile = F.least(F.floor(F.col("_r") * 10 / F.col("_n")), F.lit(9)).cast("int")
    parts = ranked.withColumn("decile", decile).groupBy("decile").agg(
        F.count("*").alias("n"), F.avg("y").alias("m"), F.avg((F.col("y") > 0).cast("double")).alias("up"), F.max("_mean").alias("_mean"),
        F.sum("_r").alias("r"), F.sum("_q").alias("q"), F.sum(F.col("_r") * F.col("_q")).alias("rq"), F.sum(F.col("_r") * F.col("_r")).alias("rr"), F.sum(F.col("_q") * F.col("_q")).alias("qq"))
    place = F.rank().over(Window.orderBy("m")) + (F.count("*").over(Window.partitionBy("m")) - 1) / 2  # ten rows
    cov = lambda a, b, ab: F.sum(ab) - F.sum(a) * F.sum(b) / F.sum("n")
    top, bottom = F.max_by("m", "decile"), F.min_by("m", "decile")
    return parts.withColumn("_p", place).agg(
        F.count("*").alias("deciles"), F.sum("n").alias("rows"), F.round(F.try_divide(cov("r", "q", "rq"), F.sqrt(cov("r", "r", "rr") * cov("q", "q", "qq"))), 6).alias("spearman"),
        F.round(top - F.max("_mean"), 6).alias("top_lift"), F.round(top - bottom, 6).alias("top_less_bottom"), F.round(F.try_divide(F.covar_pop("decile", "_p"), F.stddev_pop("decile") * F.stddev_pop("_p")), 6).alias("monotonicity"), F.round(F.max_by("up", "decile"), 6).alias("top_positive"))


def fit_gate(rows: DataFrame, base: str, memory: str, outcome: str, weight: str, steps: int, rate: float = 0.05, decay: float = 0.001) -> dict:
    """A gate sigmoid(a.z + b) between two forecasts, fitted by Adam on the weighted squared error of (1 - g) base + g memory.

    z: sizes of base, of base less memory, and of memory, each less its mean over its deviation (1 where it does not vary).
    Starts at a = 0, b = 0. Each step is one aggregate of five sums. Gives mean, deviation, a, b and the loss before each step.
    """
    x, m = F.col(base), F.col(memory)
    z = [F.abs(x), F.abs(x - m), F.abs(m)]
    r = rows.agg(*(F.avg(v).alias(f"m{i}") for i, v in enumerate(z)), *(F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(z)), F.sum(weight).alias("w")).first()
    mean = [r[f"m{i}"] or 0.0 for i in range(3)]
    deviation = [r[f"s{i}"] if r[f"s{i}"] and r[f"s{i}"] > 1e-12 else 1.0 for i in range(3)]
    own = rows.select(x.alias("_x"), m.alias("_m"), F.col(outcome).alias("_y"), F.col(weight).alias("_w"), *(((v - mean[i]) / deviation[i]).alias(f"_z{i}") for i, v in enumerate(z)))
    theta, first, second, losses = np.zeros(4), np.zeros(4), np.zeros(4), []
    for step in range(1, steps + 1 if r["w"] else 1):
        gate = 1 / (1 + F.exp(-linear(np.array([theta[3], *theta[:3]]), ["_z0", "_z1", "_z2"])))
        held = own.withColumn("_g", gate).withColumn("_e", F.col("_x") + F.col("_g") * (F.col("_m") - F.col("_x")) - F.col("_y"))
        slope = 2 * F.col("_w") * F.col("_e") * (F.col("_m") - F.col("_x")) * F.col("_g") * (1 - F.col("_g"))
        s = held.withColumn("_d", slope).agg(*(F.sum(F.col("_d") * F.col(f"_z{i}")).alias(f"g{i}") for i in range(3)), F.sum("_d").alias("g3"), F.sum(F.col("_w") * F.col("_e") * F.col("_e")).alias("loss")).first()
        losses.append(s.loss / r["w"])
        g = np.array([s[f"g{i}"] for i in range(4)]) / r["w"] + decay * theta
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return {"mean": mean, "deviation": deviation, "a": theta[:3].tolist(), "b": float(theta[3]), "losses": losses}


def gate_value(gate: dict, base: str, memory: str) -> Column:
    """The fitted gate of two forecasts."""
    z = [F.abs(F.col(base)), F.abs(F.col(base) - F.col(memory)), F.abs(F.col(memory))]
    terms = [a * (v - m) / s for a, v, m, s in zip(gate["a"], z, gate["mean"], gate["deviation"], strict=True)]
    return 1 / (1 + F.exp(-(sum(terms[1:], terms[0]) + gate["b"])))


def coverage(rows: DataFrame, score: str, outcome: str, fitted: Column, shares: list[float]) -> DataFrame:
    """share, threshold, rows, passed, covered and mean: for each share the score that it of the fitted rows reach, how many of the other rows
    reach it, their share, and their mean outcome. Rows without a score reach none."""
    edges = quantiles(rows.where(fitted), score, [], [1 - s for s in shares]).select((1 - F.col("share")).alias("share"), F.col("value").alias("threshold"))
    others = rows.where(~fitted).crossJoin(F.broadcast(edges))  # a row per share
    reach = F.coalesce(F.col(score) >= F.col("threshold"), F.lit(False))
    return others.groupBy("share", "threshold").agg(F.count("*").alias("rows"), F.count_if(reach).alias("passed"), F.avg(reach.cast("double")).alias("covered"), F.avg(F.when(reach, F.col(outcome))).alias("mean"))
