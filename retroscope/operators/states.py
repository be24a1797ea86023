"""States by clustering: k-means from sums, its quality without pairs of rows, profiles, members, and a permutation test.

Rows have a key and an array x of doubles of one length p. What a step needs of them are sums per state: k rows of p + 2
numbers, which the driver turns into centres that are sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retroscope.functions.arrays import apart, beside, dot
from retroscope.functions.orders import quantiles


def assign(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows with state, the number of the nearest centre (of several, the smallest), and apart, the squared distance to it."""
    all_of_them = F.transform("_c", lambda c: apart(F.col("x"), c))
    near = beside(rows, _c=centres).withColumn("_d", all_of_them)
    return near.withColumns({"apart": F.array_min("_d"), "state": (F.array_position("_d", F.array_min("_d")) - 1).cast("int")}).drop("_c", "_d")


def fit(rows: DataFrame, key: str, k: int, steps: int, seed: int) -> np.ndarray:
    """Centres after some steps of Lloyd's, from the k rows whose `seed:key` has the smallest SHA-256. Centres without rows stay."""
    first = F.sha2(F.concat_ws(":", F.lit(seed), key), 256)
    centres = np.array([r.x for r in rows.select(first.alias("_h"), key, "x").orderBy("_h", key).limit(k).collect()], float)
    for _ in range(steps if centres.size else 0):
        means = assign(rows, centres).groupBy("state").agg(F.array(*(F.avg(F.get("x", i)) for i in range(centres.shape[1]))).alias("m"))
        for r in means.collect():  # k rows
            centres[r.state] = r.m
    return centres


@dataclass
class Sums:
    """Rows, sum of vectors and sum of squared lengths of each state."""

    n: np.ndarray
    total: np.ndarray
    squares: np.ndarray

    @staticmethod
    def of(states: DataFrame, k: int, p: int) -> Sums:
        x = F.col("x")
        rows = states.groupBy("state").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("x", i)) for i in range(p))).alias("t"), F.sum(dot(x, x)).alias("q"))
        out = Sums(np.zeros(k), np.zeros((k, p)), np.zeros(k))
        for r in rows.collect():
            out.n[r.state], out.total[r.state], out.squares[r.state] = r.n, r.t, r.q
        return out


def silhouette(states: DataFrame, sums: Sums) -> DataFrame:
    """states with silhouette by squared distances: the mean over a state of |x - y|^2 is |x|^2 + Q/n - 2 x.S/n. 0 where a row is alone."""
    some = np.flatnonzero(sums.n)
    rows = beside(states, _n=sums.n[some], _k=some.astype(float), _s=sums.total[some] / sums.n[some, None], _q=sums.squares[some] / sums.n[some])
    x = F.col("x")
    mean = F.transform("_k", lambda k, i: F.struct(k.alias("k"), F.get("_n", i).alias("n"), (dot(x, x) + F.get("_q", i) - 2 * dot(x, F.get("_s", i))).alias("d")))
    rows = rows.withColumn("_m", mean)
    own = F.filter("_m", lambda e: e["k"] == F.col("state"))[0]
    a, b = own["d"] * own["n"] / (own["n"] - 1), F.array_min(F.transform(F.filter("_m", lambda e: e["k"] != F.col("state")), lambda e: e["d"]))
    value = F.when(own["n"] > 1, F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))).otherwise(0.0)
    return rows.withColumn("silhouette", value).drop("_n", "_k", "_s", "_q", "_m")


def quality(states: DataFrame, centres: np.ndarray, outcome: str) -> DataFrame:
    """One row: silhouette, calinski_harabasz and davies_bouldin of the states, eta_squared and anova_f of an outcome by state."""
    k, p = centres.shape
    sums = Sums.of(states, k, p)
    some = sums.n > 0
    middle = sums.total[some] / sums.n[some, None]
    n, used = sums.n.sum(), int(some.sum())
    within = sums.squares.sum() - (sums.n[some] * (middle**2).sum(axis=1)).sum()
    between = (sums.n[some] * (middle**2).sum(axis=1)).sum() - (sums.total.sum(axis=0) ** 2).sum() / n
    wide = np.full((k, p), np.nan)
    wide[some] = middle
    spread = {r.state: r.s for r in beside(states, _c=np.nan_to_num(wide)).groupBy("state").agg(F.avg(F.sqrt(apart(F.col("x"), F.element_at("_c", F.col("state") + 1)))).alias("s")).collect()}
    ids = np.flatnonzero(some)
    ratio = [max((spread[i] + spread[j]) / max(np.sqrt(((wide[i] - wide[j]) ** 2).sum()), 1e-300) for j in ids if j != i) for i in ids] if used > 1 else [float("nan")]
    y = F.col(outcome)
    groups = states.where(y.isNotNull()).groupBy("state").agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q")).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")).alias("all"), (F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")).alias("between"))
    rest = F.col("all") - F.col("between")
    tests = groups.select(F.try_divide("between", "all").alias("eta_squared"), F.try_divide(F.col("between") / (F.col("k") - 1), rest / (F.col("n") - F.col("k"))).alias("anova_f"))
    mean = silhouette(states, sums).agg(F.avg("silhouette").alias("silhouette"))
    fixed = {"calinski_harabasz": float(between / (used - 1) / (within / (n - used))) if 1 < used < n else None, "davies_bouldin": float(np.mean(ratio)) if used > 1 else None}
    return mean.crossJoin(F.broadcast(tests)).withColumns({name: F.lit(v).cast("double") for name, v in fixed.items()})


def adjusted_rand(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row, adjusted_rand: how far two assignments (key, state) of the same rows agree, from their contingency table."""
    cells = a.select(key, F.col("state").alias("a")).join(b.select(key, F.col("state").alias("b")), key).groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    pairs = lambda df: df.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("v")).select("v")
    of = lambda by, name: pairs(cells.groupBy(by).agg(F.sum("n").alias("n"))).withColumnRenamed("v", name)
    rows = pairs(cells).withColumnRenamed("v", "i").crossJoin(of("a", "x")).crossJoin(of("b", "y")).crossJoin(pairs(cells.agg(F.sum("n").alias("n"))).withColumnRenamed("v", "all"))  # single rows
    chance = F.col("x") * F.col("y") / F.col("all")
    return rows.select(F.coalesce(F.try_divide(F.col("i") - chance, (F.col("x") + F.col("y")) / 2 - chance), F.lit(1.0)).alias("adjusted_rand"))


def profiles(states: DataFrame, rise: str, fall: str, hit: Column, bad: float) -> DataFrame:
    """Per state: rows, their share, mean and median of the outcomes rise and fall, how often hit holds, how often fall is at
    most bad, and its mean there (0 if never). Medians come from counts per value, so no state is gathered in one task."""
    low = F.col(fall) <= bad
    out = states.groupBy("state").agg(
        F.count("*").alias("rows"), F.avg(rise).alias("rise_mean"), F.avg(fall).alias("fall_mean"), F.avg(hit.cast("double")).alias("hit_rate"),
        F.avg(low.cast("double")).alias("bad_rate"), F.coalesce(F.avg(F.when(low, F.col(fall))), F.lit(0.0)).alias("severity"))
    for column, name in ((rise, "rise_median"), (fall, "fall_median")):
        out = out.join(quantiles(states, column, ["state"], [0.5]).select("state", F.col("value").alias(name)), "state", "left")
    return out.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))  # a row per state


def members(states: DataFrame, key: str, count: int) -> DataFrame:
    """The `count` rows of each state that lie nearest to its mean: state, place, key, distance. A partition sends no more than that."""
    p = F.size("x")
    means = states.select("state", F.posexplode("x").alias("i", "v")).groupBy("state", "i").agg(F.avg("v").alias("v")).groupBy("state").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("_m"))
    rows = states.where(p > 0).join(F.broadcast(means), "state").withColumn("distance", F.sqrt(apart(F.col("x"), F.col("_m"))))
    place = F.row_number().over(Window.partitionBy("state").orderBy("distance", key))
    return rows.withColumn("place", place).where(F.col("place") <= count).select("state", "place", key, "distance")


def smallest_draws(rows: DataFrame, key: str, value: str, n: int, draws: int, seed: int, bits: int = 10, width: float = 8.0) -> DataFrame:
    """(draw, mean): for each draw the mean value of the n rows with the smallest hash of draw and key, without replacement.

    Hashes have 32 bits. The n-th of N lies near the share n / N of them: what is surely smaller is summed where it is, and
    only hashes within `width` deviations of that share are shuffled and put in order. A draw whose n-th hash lies elsewhere
    is done again from counts of all its hashes, so the width decides the cost alone. The driver gets a number per draw.
    """
    spark, count = rows.sparkSession, rows.count()
    if not 0 < n <= count:
        return spark.createDataFrame([], "draw int, mean double")
    apart = width * (n * (1 - n / count)) ** 0.5 / count
    low, high = (int(min(max(x, 0.0), 1.0) * 2**32) for x in (n / count - apart, n / count + apart))
    each = _hashed(rows, key, value, range(draws), seed, count).where(F.col("h") < f"{high:08x}" if high < 2**32 else F.lit(True))
    inside = F.col("h") >= f"{low:08x}"
    only = lambda c: F.when(inside, F.col(c)).alias(c)
    sums = each.groupBy("draw", inside.alias("inside"), only("h"), only("key"), F.when(inside, F.col("v")).alias("one")).agg(F.count("*").alias("c"), F.sum("v").alias("s"))
    before = Window.partitionBy("draw").orderBy("inside", "h", "key", "one").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.greatest(F.lit(0), F.least(F.col("c"), F.lit(n) - F.coalesce(F.sum("c").over(before), F.lit(0))))
    found = sums.withColumn("t", taken).groupBy("draw").agg(
        (F.sum(F.when(F.col("inside"), F.col("one") * F.col("t")).otherwise(F.col("s"))) / n).alias("mean"), F.sum("t").alias("t"), F.bool_and(F.col("inside") | (F.col("c") == F.col("t"))).alias("whole"))
    done = {r.draw: r["mean"] for r in found.where((F.col("t") == n) & F.col("whole")).collect()}
    out = spark.createDataFrame(list(done.items()), "draw int, mean double")
    again = [d for d in range(draws) if d not in done]
    return out.unionByName(_draws_by_cells(_hashed(rows, key, value, again, seed, count), n, bits)) if again else out


def _hashed(rows: DataFrame, key: str, value: str, draws: Iterable[int], seed: int, count: int) -> DataFrame:
    """(key, v, draw, h) of all rows and draws; h is the hash's first 32 bits as hexadecimal digits. About a million to a task."""
    numbers = list(draws)
    every = F.array(*map(F.lit, numbers)) if numbers != [*range(len(numbers))] else F.sequence(F.lit(0), F.lit(len(numbers) - 1))
    narrow = rows.select(F.col(key).alias("key"), F.col(value).alias("v")).repartition(max(rows.sparkSession.sparkContext.defaultParallelism, count * len(numbers) >> 20))
    each = narrow.select("key", "v", F.explode(every).alias("draw"))
    return each.withColumn("h", F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "draw", "key"), 256), 1, 8))


def _draws_by_cells(each: DataFrame, n: int, bits: int) -> DataFrame:
    """(draw, mean) from rows and sums per leading bits of the hash; only the rows of the one cell with the n-th are put in order."""
    each = each.withColumn("cell", F.shiftright(F.conv("h", 16, 10).cast("bigint"), 32 - bits))
    cells = each.groupBy("draw", "cell").agg(F.count("*").alias("c"), F.sum("v").alias("s"))
    before = Window.partitionBy("draw").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # 2^bits rows
    cells = cells.withColumns({"_n": F.coalesce(F.sum("c").over(before), F.lit(0)), "_s": F.coalesce(F.sum("s").over(before), F.lit(0.0))})
    edge = cells.where((F.col("_n") < n) & (F.col("_n") + F.col("c") >= n)).select("draw", "cell", "_n", "_s")  # a row per draw
    order = Window.partitionBy("draw").orderBy("h", "key")
    last = each.join(F.broadcast(edge), ["draw", "cell"]).withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= n - F.col("_n"))
    return last.groupBy("draw", "_s").agg(F.sum("v").alias("v")).select("draw", ((F.col("_s") + F.col("v")) / n).alias("mean"))


def best_state_test(states: DataFrame, key: str, score: Column, draws: int, seed: int) -> DataFrame:
    """One row: the state of the highest mean score (of several, the smallest), its rows and score, the mean and deviation of as
    many rows drawn without replacement, and p, the share of draws that reach the score."""
    rows = states.withColumn("_v", score).where("_v is not null")
    best = rows.groupBy("state").agg(F.count("*").alias("rows"), F.avg("_v").alias("score")).orderBy(F.desc("score"), "state").first()
    if best is None:
        return states.sparkSession.createDataFrame([], "state int, rows bigint, score double, random_mean double, random_deviation double, p double")
    drawn = smallest_draws(rows, key, "_v", best.rows, draws, seed)
    beats = (F.col("mean") >= F.lit(best.score)).cast("double")
    return drawn.agg(F.lit(best.state).alias("state"), F.lit(best.rows).cast("bigint").alias("rows"), F.lit(best.score).alias("score"), F.avg("mean").alias("random_mean"), F.stddev_pop("mean").alias("random_deviation"), F.avg(beats).alias("p"))
