"""Diagnostics of retrievals, trades, signals and representations: occlusion, swaps, tests, ridge, alignment, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retroscope.functions.orders import average_rank
from retroscope.functions.windows import by_time, correlation


def patches(rows: DataFrame, column: str, history: int, size: int) -> DataFrame:
    """rows with patches: means of `size` successive values over the `history` rows before; null where there are fewer."""
    frame = by_time().rowsBetween(-history, -1)
    listed = F.collect_list(column).over(frame)
    means = F.transform(F.sequence(F.lit(0), F.lit(history // size - 1)), lambda i: F.aggregate(F.slice("_h", i * size + 1, size), F.lit(0.0), lambda a, x: a + x) / size)
    return rows.withColumn("_h", listed).withColumn("patches", F.when(F.size("_h") == history, means)).drop("_h")


def windows_within(rows: DataFrame, length: int, horizon: int, end: Column) -> DataFrame:
    """Rows whose window of `length` rows is whole and whose outcome, `horizon` rows on, is known by end."""
    known = F.lead("session", horizon).over(by_time())
    return rows.withColumns({"_n": F.row_number().over(by_time()), "known": known}).where((F.col("_n") >= length) & (F.col("known") <= end)).drop("_n")


def project(vectors: DataFrame, column: str, dims: int, seed: int) -> DataFrame:
    """vectors with a random projection of fixed hashed signs, over its length."""
    sign = lambda i, d: F.when(F.ascii(F.sha2(F.concat_ws(":", F.lit(seed), d, i), 256)) % 2 == 0, 1.0).otherwise(-1.0)
    dot = lambda d: F.aggregate(F.transform(F.col(column), lambda x, i: x.cast("double") * sign(i, d)), F.lit(0.0), lambda a, x: a + x)
    out = vectors.withColumn("_p", F.array(*(dot(F.lit(d)) for d in range(dims))))
    size = F.sqrt(F.aggregate("_p", F.lit(0.0), lambda a, x: a + x * x))
    return out.withColumn("projected", F.transform("_p", lambda x: x / F.when(size == 0, 1.0).otherwise(size))).drop("_p")


def occlusion(neighbors: DataFrame, weight: str, value: str, drop: int = 3) -> DataFrame:
    """Per query: the weighted mean, that without the first `drop` records (weights made to add up again), and the change."""
    w, v = F.col(weight), F.col(value)
    rest = F.when(F.col("rank") > drop, w)
    out = neighbors.groupBy("query_id").agg((F.sum(w * v) / F.sum(w)).alias("whole"), F.try_divide(F.sum(rest * v), F.sum(rest)).alias("without"), (F.sum(F.when(F.col("rank") <= drop, w)) / F.sum(w)).alias("dropped_weight"))
    return out.withColumn("change", F.col("without") - F.col("whole"))


def derangement(rows: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """rows with swapped: the value of the next row by key of the same group, the first one's for the last; null where a
    group has one row."""
    own = Window.partitionBy(by).orderBy(key)
    first = F.first(value).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    n = F.count("*").over(Window.partitionBy(by))
    return rows.withColumn("swapped", F.when(n > 1, F.coalesce(F.lead(value, 1).over(own), first)))


def mann_whitney(rows: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """Per by: sizes of the two groups (group true or false), means, U of the first, and its normal deviate (no tie correction)."""
    ranked = average_rank(rows.where(F.col(value).isNotNull()), value, by, "_r")
    g = F.col(group)
    a, b = F.sum(g.cast("bigint")), F.sum((~g).cast("bigint"))
    out = ranked.groupBy(*by).agg(a.alias("n1"), b.alias("n2"), F.avg(F.when(g, F.col(value))).alias("mean1"), F.avg(F.when(~g, F.col(value))).alias("mean2"), F.sum(F.when(g, F.col("_r"))).alias("_s"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    out = out.withColumn("u", F.col("_s") - n1 * (n1 + 1) / 2).drop("_s")
    return out.withColumn("deviate", F.try_divide(F.col("u") - n1 * n2 / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)))


def ridge(rows: DataFrame, x: tuple[str, str], y: str, weight: str, penalty: float) -> DataFrame:
    """Weighted ridge of y on two features without intercept, in closed form from sums: one row with b0, b1, rows."""
    a, b, t, w = F.col(x[0]), F.col(x[1]), F.col(y), F.col(weight)
    s = rows.agg(F.count("*").alias("rows"), *(F.sum(w * v).alias(n) for n, v in (("aa", a * a), ("bb", b * b), ("ab", a * b), ("at", a * t), ("bt", b * t))))
    det = (F.col("aa") + penalty) * (F.col("bb") + penalty) - F.col("ab") * F.col("ab")
    return s.select("rows", (((F.col("bb") + penalty) * F.col("at") - F.col("ab") * F.col("bt")) / det).alias("b0"), (((F.col("aa") + penalty) * F.col("bt") - F.col("ab") * F.col("at")) / det).alias("b1"))


def alignment(vectors: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Linear centred kernel alignment of two sets of vectors of the same rows, which key tells apart: one row. The cross products, a row per pair
    of numbers, are summed where the rows are."""
    long = vectors.select(F.col(key).alias("_r"), a, b)
    left = long.select("_r", F.posexplode(F.col(a).cast("array<double>")).alias("i", "x"))
    right = long.select("_r", F.posexplode(F.col(b).cast("array<double>")).alias("j", "y"))
    n = vectors.agg(F.count("*").alias("n"))

    def squares(p: DataFrame, q: DataFrame) -> DataFrame:
        """Sum of the squares of the centred cross products."""
        sums = p.join(q, "_r").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
        return sums.crossJoin(F.broadcast(n)).agg(F.sum(F.pow(F.col("xy") - F.col("sx") * F.col("sy") / F.col("n"), F.lit(2))).alias("s"))

    twin = lambda df, i, x: df.select("_r", F.col(i).alias("j"), F.col(x).alias("y"))
    same = lambda df, i, x: df.select("_r", F.col(i).alias("i"), F.col(x).alias("x"))
    ab, aa, bb = squares(left, right), squares(left, twin(left, "i", "x")), squares(same(right, "j", "y"), right)
    return ab.crossJoin(aa.select(F.col("s").alias("_a"))).crossJoin(bb.select(F.col("s").alias("_b"))).select((F.col("s") / F.sqrt(F.col("_a") * F.col("_b"))).alias("alignment"))


def enrichment(neighbors: DataFrame, own: DataFrame, population: DataFrame, group: str) -> DataFrame:
    """Per query: share of its neighbors of its own group, that group's share of the population, and their ratio."""
    all_rows = population.where(F.col(group).isNotNull())
    share = all_rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_c")).withColumn("expected", F.col("_c") / F.sum("_c").over(Window.partitionBy()))  # a handful of groups
    rows = neighbors.join(own.select("query_id", F.col(group).alias("_g")), "query_id").where("_g is not null")
    found = rows.groupBy("query_id", "_g").agg(F.avg(F.coalesce((F.col(group) == F.col("_g")).cast("double"), F.lit(0.0))).alias("observed"))
    return found.join(F.broadcast(share), "_g").select("query_id", "observed", "expected", (F.col("observed") / F.col("expected")).alias("ratio"))


def equity_checks(curve: DataFrame, start: float, tolerance: float) -> DataFrame:
    """curve (key, session, equity, daily): rows, days that don't increase, values not above 0, steps that daily doesn't
    explain, and the last value against what all steps give."""
    own = Window.partitionBy("key").orderBy("session")
    before = F.coalesce(F.lag("equity", 1).over(own), F.lit(start))
    rows = curve.withColumns({"_off": F.abs(F.col("equity") / before - 1 - F.col("daily")) > tolerance, "_last": F.last("equity").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_again": F.count("*").over(Window.partitionBy("key", "session")) > 1})
    count = lambda c: F.sum(c.cast("bigint"))
    return rows.groupBy("key").agg(F.count("*").alias("rows"), count(F.col("_again")).alias("repeated"), count(F.col("equity") <= 0).alias("not_positive"), count(F.col("_off")).alias("unexplained"), (F.abs(F.max("_last") / (start * F.exp(F.sum(F.log1p("daily")))) - 1) <= tolerance).alias("reconciled"))


def exits(trades: DataFrame, horizon: int, last: Column) -> DataFrame:
    """trades (market, entry, held, up): how many could be followed for `horizon` days, and of those how many ended within it,
    by a rise or a fall, and how many lasted."""
    rows = trades.withColumn("_ok", F.date_add("entry", horizon) <= last)
    done = F.col("_ok") & (F.col("held") <= horizon)
    count = lambda c: F.sum(c.cast("bigint"))
    return rows.groupBy("market").agg(F.count("*").alias("trades"), count(F.col("_ok")).alias("eligible"), count(done & F.col("up")).alias("rises"), count(done & ~F.col("up")).alias("falls"), count(F.col("_ok") & (F.col("held") > horizon)).alias("lasted"))


def associations(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, rows, pearson with the target, and the mutual information of the signs in bits."""
    long = rows.where(F.col(target).isNotNull()).select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features))).alias("s"), F.col(target).alias("y")).select("s.feature", "s.x", "y").where("x is not null")
    linear = long.groupBy("feature").agg(F.count("*").alias("rows"), correlation("x", "y").alias("pearson"))
    cells = long.groupBy("feature", (F.col("x") > 0).alias("a"), (F.col("y") > 0).alias("b")).agg(F.count("*").alias("n"))
    of = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))
    info = cells.withColumn("m", F.col("n") / of() * F.log2(F.col("n") * of() / (of("a") * of("b")))).groupBy("feature").agg(F.sum("m").alias("information"))
    return linear.join(info, "feature")
