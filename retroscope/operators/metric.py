"""A retrieval metric fitted to outcomes, and learned weights of what was retrieved.

Queries are held with their candidates, a bounded number each: squared differences per number of the vector, and outcomes.
A step adds up the gradients of all queries in one aggregate; the driver holds one number per number of the vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retroscope.functions.arrays import beside, dot, total


def scales(rows: DataFrame, column: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each number of the vectors; 1 where it does not vary."""
    r = rows.agg(F.array(*(F.avg(F.get(column, i)) for i in range(size))).alias("m"), F.array(*(F.stddev_pop(F.get(column, i)) for i in range(size))).alias("s")).first()
    s = np.array([x if x is not None and np.isfinite(x) and x > 1e-6 else 1.0 for x in r.s])
    return np.array([x or 0.0 for x in r.m]), s


def transformed(rows: DataFrame, column: str, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray | None = None, projection: np.ndarray | None = None) -> DataFrame:
    """rows whose vectors are standardised, then weighed by the root of a number's weight, or projected and set to length 1."""
    factor = np.sqrt(np.maximum(weights, 1e-8)) if weights is not None else np.ones_like(scale)
    own = beside(rows, _mean=mean, _factor=factor / scale)
    x = F.zip_with(F.zip_with(F.col(column).cast("array<double>"), "_mean", lambda a, b: a - b), "_factor", lambda a, b: a * b)
    if projection is None:
        return own.withColumn(column, x).drop("_mean", "_factor")
    own = beside(own.withColumn(column, x), _p=projection.T).withColumn(column, F.transform("_p", lambda p: dot(F.col(column), p)))
    length = F.greatest(F.sqrt(dot(F.col(column), F.col(column))), F.lit(1e-4))
    return own.withColumn("_l", length).withColumn(column, F.transform(column, lambda v: v / F.col("_l"))).drop("_p", "_l", "_mean", "_factor")


def examples(found: DataFrame, queries: DataFrame, memory: DataFrame, outcomes: list[str]) -> DataFrame:
    """One row per query with a candidate: query_id, own (its outcomes), apart and theirs (per candidate, by id: squared
    differences, outcomes). found: query_id, record_id, a bounded number of records a query."""
    mine = queries.select("query_id", F.col("vector").alias("_q"), F.array(*outcomes).alias("own"))
    other = memory.select("record_id", F.col("vector").alias("_m"), F.array(*outcomes).alias("theirs"))
    rows = found.select("query_id", "record_id").join(other, "record_id").join(mine, "query_id")
    one = F.struct("record_id", F.zip_with("_q", "_m", lambda a, b: (a - b) * (a - b)).alias("apart"), "theirs")
    rows = rows.groupBy("query_id", "own").agg(F.array_sort(F.collect_list(one)).alias("_c"))
    return rows.select("query_id", "own", F.transform("_c", lambda c: c["apart"]).alias("apart"), F.transform("_c", lambda c: c["theirs"]).alias("theirs"))


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _gradient(weights: np.ndarray, temperature: float, preserve: float) -> Callable:
    """Sums over queries of the loss and its gradient by the weights."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad, n = 0.0, np.zeros(weights.size), 0
        for batch in batches:
            for own, apart, theirs in zip(batch.column("own"), batch.column("apart"), batch.column("theirs"), strict=True):
                d = pc.list_flatten(apart.values).to_numpy().reshape(-1, weights.size)
                y = pc.list_flatten(theirs.values).to_numpy().reshape(len(d), -1)
                away = np.sqrt(np.maximum(d @ weights, 1e-24))
                s, t = _soft(-away / temperature), _soft(-np.sqrt(d.sum(axis=1)) / temperature)
                said = s @ y
                e = said - own.values.to_numpy()
                loss += np.where(np.abs(e) < 1, 0.5 * e * e, np.abs(e) - 0.5).mean() + preserve * (t * np.log(t / s)).sum()
                by_score = s * ((y - said) @ np.clip(e, -1, 1)) / e.size + preserve * (s - t)
                grad -= (by_score / (2 * temperature * away)) @ d
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([grad.tolist()], pa.list_(pa.float64()))], names=["n", "loss", "grad"])

    return of


@dataclass
class Fitted:
    weights: np.ndarray  # per number of the vector, or a projection
    losses: list[float]


def fit_diagonal(rows: DataFrame, size: int, steps: int, rate: float = 0.05, temperature: float = 0.5, preserve: float = 0.1, decay: float = 0.0, clip: float = 5.0) -> Fitted:
    """Weights of a diagonal metric by Adam on all `examples` at once.

    The loss of a query: the smooth absolute error of the mean outcome of its candidates, weighed by a softmax of their
    distances, and preserve times the divergence from the softmax of plain distances. Weights are softplus of the
    parameters plus 1e-4, over their mean. With no query the weights are all 1.
    """
    theta, m, v, losses = np.zeros(size), np.zeros(size), np.zeros(size), []
    weigh = lambda p: np.log1p(np.exp(p)) + 1e-4
    for step in range(1, steps + 1):
        s = weigh(theta)
        w = s / s.mean()
        sums = rows.mapInArrow(_gradient(w, temperature, preserve), "n bigint, loss double, grad array<double>").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.array(*(F.sum(F.get("grad", i)) for i in range(size))).alias("grad")).first()
        if not sums.n:
            break
        g = np.array(sums.grad) / sums.n
        losses.append(sums.loss / sums.n)
        g = (g / s.mean() - (g @ s) / (s.mean() ** 2 * size)) / (1 + np.exp(-theta))
        g *= min(1.0, clip / (np.linalg.norm(g) + 1e-6))
        g += decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    s = weigh(theta)
    return Fitted(s / s.mean(), losses)


def principal(rows: DataFrame, column: str, size: int, rank: int) -> np.ndarray:
    """The rank directions (size x rank) in which the vectors' squares sum up most, the largest number of each positive.

    The sums of products of each two numbers come from one pass; the driver gets size * (size + 1) / 2 of them.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((size, size))
        for batch in batches:
            x = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).reshape(-1, size)
            held += x.T @ x
        i, j = np.tril_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i * size + j, pa.int64()), pa.array(held[i, j])], names=["place", "value"])

    gram = np.zeros((size, size))
    for r in rows.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>")).mapInArrow(products, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        gram[divmod(r.place, size)] = gram[divmod(r.place, size)[::-1]] = r.value
    found = np.linalg.eigh(gram)[1][:, ::-1][:, :rank]
    return found * np.where(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])] < 0, -1.0, 1.0)


def vectors(found: DataFrame, queries: DataFrame, memory: DataFrame, outcomes: list[str]) -> DataFrame:
    """As `examples`, with the vectors themselves: query_id, vector, own, near (the candidates' vectors), theirs."""
    mine = queries.select("query_id", "vector", F.array(*outcomes).alias("own"))
    other = memory.select("record_id", F.col("vector").alias("_m"), F.array(*outcomes).alias("theirs"))
    listed = found.select("query_id", "record_id").join(other, "record_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("record_id", "_m", "theirs"))).alias("_c"))
    return listed.join(mine, "query_id").select("query_id", "vector", "own", F.transform("_c", lambda c: c["_m"]).alias("near"), F.transform("_c", lambda c: c["theirs"]).alias("theirs"))


#: How much each outcome's difference counts in the distance of two records' outcomes.
OUTCOME_SHARES = (1.0, 0.5, 0.25)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-4)
    return x / length, length


def low_rank_loss(projection: np.ndarray, vector: np.ndarray, own: np.ndarray, near: np.ndarray, theirs: np.ndarray, temperature: float, preserve: float, ranked: float) -> tuple[float, np.ndarray]:
    """Loss of one query and its gradient by the projection."""
    (zq, lq), (zm, lm) = _unit(vector @ projection), _unit(near @ projection)
    gap, plain = zq - zm, vector - near
    away = np.sqrt(np.maximum((gap * gap).sum(axis=1), 1e-24))
    s, t = _soft(-away / temperature), _soft(-np.sqrt((plain * plain).sum(axis=1)) / temperature)
    o = _soft(-(np.abs(theirs - own) * np.array(OUTCOME_SHARES[: own.size])).sum(axis=1) / temperature)
    said = s @ theirs
    e = said - own
    loss = np.where(np.abs(e) < 1, 0.5 * e * e, np.abs(e) - 0.5).mean()
    loss += preserve * (t * np.log(np.maximum(t, 1e-300) / np.maximum(s, 1e-300))).sum() + ranked * (o * np.log(np.maximum(o, 1e-300) / np.maximum(s, 1e-300))).sum()
    by_score = s * ((theirs - said) @ np.clip(e, -1, 1)) / e.size + preserve * (s - t) + ranked * (s - o)
    by_gap = (-by_score / (temperature * away))[:, None] * gap

    def back(d: np.ndarray, z: np.ndarray, length: np.ndarray) -> np.ndarray:
        """From the unit vector to what was divided by its length; a shorter one was divided by 1e-4."""
        return np.where(length > 1e-4, d - z * (z * d).sum(axis=-1, keepdims=True), d) / length

    grad = np.outer(vector, back(by_gap.sum(axis=0), zq, lq)) + near.T @ back(-by_gap, zm, lm)
    return float(loss), grad


def fit_low_rank(rows: DataFrame, start: np.ndarray, steps: int, rate: float = 0.05, temperature: float = 0.5, preserve: float = 0.1, ranked: float = 0.1, decay: float = 0.0, clip: float = 5.0) -> Fitted:
    """A projection (size x rank) for `transformed`, by Adam from `start` on all rows of `vectors` at once.

    The loss of a query is that of `fit_diagonal`, with distances of projected vectors of length 1, and ranked times the
    divergence from the softmax of the outcomes' distances. A partition adds up its gradients; size * rank sums reach
    the driver a step, and the projection goes with the next step's tasks. With no query it stays as it was.
    """
    theta = np.array(start, float)
    size, rank = theta.shape
    m, v, losses = np.zeros_like(theta), np.zeros_like(theta), []

    def sums(now: np.ndarray) -> Callable:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, loss, grad = 0, 0.0, np.zeros_like(now)
            for batch in batches:
                for vector, own, near, theirs in zip(*(batch.column(c) for c in ("vector", "own", "near", "theirs")), strict=True):
                    x = pc.list_flatten(near.values).to_numpy().reshape(-1, size)
                    y = pc.list_flatten(theirs.values).to_numpy().reshape(len(x), -1)
                    one, slope = low_rank_loss(now, vector.values.to_numpy(), own.values.to_numpy(), x, y, temperature, preserve, ranked)
                    n, loss, grad = n + 1, loss + one, grad + slope
            yield pa.RecordBatch.from_arrays([pa.array(range(-2, grad.size), pa.int64()), pa.array([float(n), loss, *grad.ravel()])], names=["place", "value"])

        return of

    for step in range(1, steps + 1):
        got = {r.place: r.value for r in rows.mapInArrow(sums(theta), "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()}
        if not got.get(-2):
            break
        losses.append(got[-1] / got[-2])
        g = np.array([got[i] for i in range(theta.size)]).reshape(size, rank) / got[-2]
        g *= min(1.0, clip / (np.linalg.norm(g) + 1e-6))
        g += decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Fitted(theta, losses)


def kernel_error(near: DataFrame, outcomes: list[str]) -> DataFrame:
    """queries, error: mean absolute error of the outcomes' means among `near` (query_id, distance, the outcomes, and own_ of each),
    weighed by a Gaussian of the distance in units of the query's median distance."""
    band = F.greatest(F.col("_b"), F.lit(1e-6))
    listed = near.groupBy("query_id").agg(F.median(F.sqrt("distance")).alias("_b"), F.collect_list(F.struct(F.sqrt("distance").alias("d"), *outcomes)).alias("_l"), *(F.first(f"own_{o}").alias(f"own_{o}") for o in outcomes))
    w = F.transform("_l", lambda r: F.exp(-0.5 * (r["d"] / band) * (r["d"] / band)))
    rows = listed.withColumn("_w", w)
    off = [_miss(o) for o in outcomes]
    return rows.agg(F.count("*").alias("queries"), F.avg(sum(off[1:], off[0]) / len(off)).alias("error"))


def _miss(outcome: str) -> Column:
    return F.abs(dot(F.col("_w"), F.transform("_l", lambda r: r[outcome])) / total(F.col("_w")) - F.col(f"own_{outcome}"))


def normal_share(x: Column) -> Column:
    """The normal distribution function, within 1e-7 (a fixed rational approximation of the error function)."""
    z = F.abs(x) / 2.0**0.5
    t = 1 / (1 + 0.3275911 * z)
    rest = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z)
    return F.when(x >= 0, 1 - rest / 2).otherwise(rest / 2)


def learned_weights(neighbors: DataFrame, hidden: DataFrame, temperature: float = 0.08) -> DataFrame:
    """neighbors (query_id, record_id, similarity, distance, log_age) with fixed and learned: softmax weights of the similarity over a
    temperature, without and with the output of a small network of the three.

    hidden: one row per hidden unit (w_similarity, w_distance, w_age, bias, out); the units' outputs x * P(normal < x) are added
    up by out. A table of a bounded number of units, sent to all rows as one array.
    """
    one = hidden.agg(F.collect_list(F.struct("w_similarity", "w_distance", "w_age", "bias", "out")).alias("_units"))
    rows = neighbors.crossJoin(F.broadcast(one))
    value = lambda u: u["w_similarity"] * F.col("similarity") + u["w_distance"] * F.col("distance") + u["w_age"] * F.col("log_age") + u["bias"]
    moved = total(F.transform(F.transform("_units", lambda u: F.struct(value(u).alias("x"), u["out"].alias("out"))), lambda e: e["x"] * normal_share(e["x"]) * e["out"]))
    rows = rows.withColumns({"_fixed": F.col("similarity") / temperature, "_learned": F.col("similarity") / temperature + moved}).drop("_units")
    top = rows.groupBy("query_id").agg(F.max("_fixed").alias("_tf"), F.max("_learned").alias("_tl"))
    rows = rows.join(top, "query_id").withColumns({"_f": F.exp(F.col("_fixed") - F.col("_tf")), "_l": F.exp(F.col("_learned") - F.col("_tl"))})
    sums = rows.groupBy("query_id").agg(F.sum("_f").alias("_sf"), F.sum("_l").alias("_sl"))
    return rows.join(sums, "query_id").withColumns({"fixed": F.col("_f") / F.col("_sf"), "learned": F.col("_l") / F.col("_sl")}).drop("_fixed", "_learned", "_tf", "_tl", "_f", "_l", "_sf", "_sl")
