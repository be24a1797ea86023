"""Cross-sectional ranks of a date, deciles, rank correlation with outcomes, and portfolios of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retroscope.functions.orders import cumulative
from retroscope.functions.windows import correlation, percent_rank


def opportunity_ranks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rank_x for each column: its average-tie percent rank within the session."""
    return rows.withColumns({f"rank_{x}": percent_rank(F.col(x), "session") for x in columns})


def decile_diagnostics(rows: DataFrame, score: str, outcome: str) -> DataFrame:
    """decile (0 to 9 by same-date percent rank of score), rows, mean outcome, share of outcomes above 0."""
    ranked = rows.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).withColumn("_p", percent_rank(F.col(score), "session"))
    decile = F.least(F.floor(F.col("_p") * 10), F.lit(9)).cast("int")
    return ranked.groupBy(decile.alias("decile")).agg(F.count("*").alias("rows"), F.avg(outcome).alias("mean_outcome"), F.avg((F.col(outcome) > 0).cast("double")).alias("share_positive"))


def rank_ic(rows: DataFrame, score: str, outcome: str, by: str = "session", least: int = 5) -> DataFrame:
    """Spearman correlation of score and outcome within `by`; null below `least` rows or if one is constant."""
    whole = rows.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    ranked = whole.withColumns({"_a": percent_rank(F.col(score), by), "_b": percent_rank(F.col(outcome), by)})
    varied = (F.count("*") >= least) & (F.min("_a") < F.max("_a")) & (F.min("_b") < F.max("_b"))
    return ranked.groupBy(by).agg(F.count("*").alias("assets"), F.when(varied, correlation("_a", "_b")).alias("rank_ic"))


def daily_slots(rows: DataFrame, score: str, k: int = 3) -> DataFrame:
    """The k best securities of each session, ties to the smaller id."""
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.col(score).desc(), "security"))
    return rows.where(F.col(score).isNotNull()).withColumn("slot", place).where(F.col("slot") <= k).select("session", "slot", "security", score)


def market_index(returns: DataFrame) -> DataFrame:
    """session, market, mean return of its securities, and the mean over markets, a market without rows as 0."""
    by_market = returns.where("daily_return is not null").groupBy("session", "market").agg(F.avg("daily_return").alias("market_return"))
    markets = returns.select("market").distinct().agg(F.count("*").alias("markets"))
    pooled = by_market.groupBy("session").agg(F.sum("market_return").alias("s"), F.avg("market_return").alias("pooled_present"), F.count("*").alias("present"))
    return pooled.join(F.broadcast(markets)).select("session", "present", "pooled_present", (F.col("s") / F.col("markets")).alias("pooled"))


def reliability_deciles(rows: DataFrame, confidence: str, outcome: str, key: list[str]) -> DataFrame:
    """Mean confidence and outcome in tenths of all rows by confidence, ties by key.

    Places come from counts of values, so that no task has to sort all rows; only equal values are numbered together.
    """
    whole = rows.where(F.col(confidence).isNotNull() & F.col(outcome).isNotNull())
    starts = cumulative(whole, confidence, []).select(confidence, "before")
    total = whole.agg(F.count("*").alias("_all"))
    placed = whole.join(starts, confidence).crossJoin(F.broadcast(total))
    place = F.row_number().over(Window.partitionBy(confidence).orderBy(*key)) - 1 + F.col("before")
    tenth = F.floor(place * 10 / F.col("_all")).cast("int")
    return placed.withColumn("decile", tenth).groupBy("decile").agg(F.count("*").alias("rows"), F.avg(confidence).alias("mean_confidence"), F.avg(outcome).alias("mean_outcome"))


def equal_weight(bars: DataFrame) -> DataFrame:
    """Wealth of one unit in each security since its first bar, carried over missing sessions: session, wealth.

    Weighted by nothing but time: the mean over all securities that have begun.
    """
    own = Window.partitionBy("security")
    relative = bars.withColumn("relative", F.col("close") / F.first("close").over(own.orderBy("session")))
    days = bars.select("session").distinct()
    begun = bars.groupBy("security").agg(F.min("session").alias("begin"))
    # a security stands in each later session: its steps are added up over sessions instead
    step = relative.withColumn("step", F.col("relative") - F.coalesce(F.lag("relative", 1).over(own.orderBy("session")), F.lit(0.0)))
    added = step.groupBy("session").agg(F.sum("step").alias("step"))
    count = begun.groupBy(F.col("begin").alias("session")).agg(F.count("*").alias("new"))
    both = days.join(added, "session", "left").join(count, "session", "left")
    so_far = Window.orderBy("session")  # a row per session
    return both.select("session", (F.sum(F.coalesce("step", F.lit(0.0))).over(so_far) / F.sum(F.coalesce("new", F.lit(0))).over(so_far)).alias("wealth"))


def portfolio_metrics(returns: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Per key: rows, log-annualized return, population volatility, Sharpe ratio, largest drawdown from 1."""
    own = Window.partitionBy(key).orderBy(order)
    rows = returns.where(F.col(value) > -1).withColumn("_log", F.sum(F.log1p(value)).over(own))
    peak = F.greatest(F.max("_log").over(own), F.lit(0.0))
    rows = rows.withColumn("_down", F.exp(F.col("_log") - peak) - 1)
    mean, vol = F.avg(value), F.stddev_pop(value)
    return rows.groupBy(key).agg(
        F.count("*").alias("days"),
        (F.sum(F.log1p(value)) * 252 / F.count("*")).alias("annual_log_return"),
        (vol * F.sqrt(F.lit(252.0))).alias("volatility"),
        F.when(vol > 0, mean / vol * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.min("_down").alias("max_drawdown"),
    )


def _concord(offsets: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each list (offsets into x and y) the sum of sign(x - x') sign(y - y') over its pairs, NaN where a number isn't finite.

    Pairs in order less those out of order, from sorts: with rows by x, then y, the latter are the inversions of y, counted
    bit by bit of its rank. Time grows as n log n of a list.
    """
    n = np.diff(offsets)
    g = np.repeat(np.arange(n.size), n)
    pairs = lambda c: c * (c - 1) // 2
    count = lambda at, w: np.bincount(at, weights=w, minlength=n.size)  # noqa: E731  below 2^53

    def ties(*by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order by those columns, the number of each place's run of equal rows, and pairs of equal rows in each list."""
        order = np.lexsort((*by[::-1], g))
        new = np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in (g, *by)], axis=0)])[: g.size]
        starts = np.flatnonzero(new)
        return order, np.cumsum(new) - 1, count(g[order][starts], pairs(np.diff(np.append(starts, g.size))))

    finite = count(g, ~(np.isfinite(x) & np.isfinite(y))) == 0
    x, y = (np.where(np.isfinite(v), v, 0.0) + 0.0 for v in (x, y))
    by_y, run, ty = ties(y)
    rank = np.empty(g.size, np.int64)
    rank[by_y] = run
    lowest = np.full(n.size, np.iinfo(np.int64).max)
    np.minimum.at(lowest, g, rank)
    _, _, tx = ties(x)
    order, _, txy = ties(x, y)
    rank = (rank - lowest[g])[order] if g.size else rank
    bits = int(rank.max(initial=0)).bit_length()
    at, turned = (g[order] << bits) | rank, np.zeros(n.size)
    for b in range(bits - 1, -1, -1):  # rows lie by all higher bits, and else as before
        ones = (at >> b) & 1
        before = np.cumsum(ones) - ones
        block = at >> (b + 1)
        first = np.searchsorted(block, block)
        turned += count(at >> bits, np.where(ones == 0, before - before[first], 0))
        at = at[np.argsort(at >> b, kind="stable")]
    return np.where(finite, pairs(n) - tx - ty + txy - 2 * turned, np.nan)


def _kendall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("_l")
        offsets, rows = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
        x, y = (rows.field(c).cast(pa.float64()) for c in ("x", "y"))
        n = np.diff(offsets)
        sums = _concord(offsets, *(c.to_numpy(zero_copy_only=False) for c in (x, y)))
        lacking = np.bincount(np.repeat(np.arange(n.size), n), weights=np.asarray(x.is_null()) | np.asarray(y.is_null()), minlength=n.size) > 0
        rest = batch.select([c for c in batch.schema.names if c != "_l"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(2 * sums / (n * (n - 1.0)), mask=lacking)], names=[*rest.schema.names, "kendall"])


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Per market, means over its sessions of at least two securities: Spearman, Kendall, same first, Jaccard of first three."""
    day = Window.partitionBy("market", "session")
    place = lambda c: F.row_number().over(day.orderBy(F.col(c).desc(), "security"))
    ranked = rows.withColumns({"_a": place(a), "_b": place(b), "_ra": percent_rank(F.col(a), "market", "session"), "_rb": percent_rank(F.col(b), "market", "session")})
    listed = F.collect_list(F.struct(F.col(a).alias("x"), F.col(b).alias("y")))
    varied = (F.count("*") >= 3) & (F.min("_ra") < F.max("_ra")) & (F.min("_rb") < F.max("_rb"))
    both, either = (F.col("_a") <= 3) & (F.col("_b") <= 3), (F.col("_a") <= 3) | (F.col("_b") <= 3)
    daily = ranked.groupBy("market", "session").agg(
        F.count("*").alias("_n"), F.when(varied, correlation("_ra", "_rb")).alias("spearman"), F.max(((F.col("_a") == 1) & (F.col("_b") == 1)).cast("int")).alias("top_hit"),
        (F.sum(both.cast("int")) / F.sum(either.cast("int"))).alias("top3"), listed.alias("_l"),
    ).where("_n >= 2")
    daily = daily.select("market", "spearman", "top_hit", "top3", "_l").mapInArrow(_kendall, f"market {rows.schema['market'].dataType.simpleString()}, spearman double, top_hit int, top3 double, kendall double")
    return daily.groupBy("market").agg(F.count("*").alias("sessions"), F.avg("spearman").alias("spearman"), F.avg("kendall").alias("kendall"), F.avg("top_hit").alias("top_hit"), F.avg("top3").alias("top3_jaccard"))
