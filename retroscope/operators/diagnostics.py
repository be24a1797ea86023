"""Diagnostics of decisions: classes of events, gates, signals, trades, portfolios, regret, and checks of what was logged."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retroscope.functions import frames
from retroscope.functions.orders import average_rank
from retroscope.functions.windows import EPS, correlation
from retroscope.operators.recursive import average

CONTRACT = [
    "return_1", "momentum_3", "momentum_10", "momentum_21", "volatility_21", "volume_mean_21", "volume_ratio_21", "volume_change_1", "intraday_range", "drawdown_252", "trend_slope_21", "close_vs_mean_50",
    "close_vs_mean_150", "close_vs_mean_200", "mean_200_trend_20", "above_low_252", "from_high_252", "up_down_volume_50", "rsi_14", "atr_ratio_14", "macd_signal_diff", "bollinger_width_20", "vol_ratio_63_21",
]
WARM_UP = 252


def _contract(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    c, v = x["close"], x["volume"]
    n, before = c.size, frames.before(c)
    r, move = c / before - 1, c - before
    at_least = lambda values, rows: np.where(np.arange(n) >= rows - 1, values, np.nan)
    total = lambda values, rows: frames.full(np.nan_to_num(values), rows, lambda w: w.sum(axis=1))
    low, high = (frames.full(c, 252, lambda w, f=f: f(w, axis=1)) for f in (np.min, np.max))
    sma = {k: frames.mean(c, k) for k in (50, 150, 200)}
    volume, last = frames.mean(v, 21), frames.before(v)
    gain, loss = (at_least(total(np.where(s * move > 0, s * move, 0.0), 14), 15) / 14 for s in (1, -1))
    up, down = (at_least(total(np.where(s * move > 0, v, 0.0), 50), 51) for s in (1, -1))
    reach = np.fmax(x["high"] - x["low"], np.fmax(np.abs(x["high"] - before), np.abs(x["low"] - before)))
    line = average(c, 12, c[0]) - average(c, 26, c[0])
    with np.errstate(divide="ignore", invalid="ignore"):
        out = {
            "return_1": r, **{f"momentum_{k}": c / frames.before(c, k) - 1 for k in (3, 10, 21)}, "volatility_21": frames.deviation(r, 21), "volume_mean_21": volume, "volume_ratio_21": v / (volume + EPS),
            "volume_change_1": np.where(last == 0, 0.0, v / last - 1), "intraday_range": (x["high"] - x["low"]) / (c + EPS), "drawdown_252": (c - high) / (high + EPS),
            "trend_slope_21": frames.full(c, 21, lambda w: w @ (np.arange(21) - 10.0)) / 770 / (c + EPS), **{f"close_vs_mean_{k}": c / m - 1 for k, m in sma.items()},
            "mean_200_trend_20": (sma[200] - frames.before(sma[200], 20)) / (frames.before(sma[200], 20) + EPS), "above_low_252": (c - low) / (low + EPS), "from_high_252": (c - high) / (high + EPS),
            "up_down_volume_50": up / (down + EPS), "rsi_14": np.where((gain == 0) & (loss == 0), 0.5, gain / (gain + loss + EPS)), "atr_ratio_14": frames.mean(reach, 14) / (c + EPS),
            "macd_signal_diff": at_least((line - average(line, 9, line[0])) / (c + EPS), 34), "bollinger_width_20": 4 * frames.deviation(c, 20) / (frames.mean(c, 20) + EPS), "vol_ratio_63_21": frames.deviation(r, 63) / (frames.deviation(r, 21) + EPS),
        }
    valid = (np.arange(n) >= WARM_UP - 1) & np.isfinite(np.column_stack([out[k] for k in CONTRACT])).all(axis=1)
    return {**out, "valid": valid.astype(np.int32)}


def contract_features(bars: DataFrame, key: str = "security") -> DataFrame:
    """bars (key, session, high, low, close, volume) with 23 features, each null before its frame is full, and valid: 1 from the 252nd
    row of the key on, where all are finite. key can name a segment between breaks, so nothing reaches across one."""
    added = ", ".join([*(f"{c} double" for c in CONTRACT), "valid int"])
    return frames.per_security(bars, _contract, ["high", "low", "close", "volume"], added, key=key)


def fold_partitions(rows: DataFrame, years: list[int] | None = None) -> DataFrame:
    """fold, role, security, session of rows (security, session, available, available_path) that have a role for a fold's year y.

    An origin up to the end of y - 3 trains, one in y - 2 validates, one in y - 1 develops, if its outcome is known by the end of
    the same period; all of y is evaluated. The bank holds origins up to the end of y - 3 whose whole path is known
    by then. Years are those of the rows, or as given.
    """
    folds = rows.select(F.year("session").alias("fold")).distinct() if years is None else rows.sparkSession.createDataFrame([(y,) for y in years], "fold int")
    end = lambda back: F.make_date(F.col("fold") - back, F.lit(12), F.lit(31))
    s, year = F.col("session"), F.year("session")
    tests = {"train": (s <= end(3)) & (F.col("available") <= end(3)), "bank": (s <= end(3)) & (F.col("available_path") <= end(3)), "evaluation": year == F.col("fold")}
    tests |= {role: (year == F.col("fold") - back) & (F.col("available") <= end(back)) for role, back in (("validation", 2), ("development", 1))}
    listed = F.array_compact(F.array(*(F.when(t, F.lit(role)) for role, t in tests.items())))
    return rows.join(F.broadcast(folds)).select("fold", F.explode(listed).alias("role"), "security", "session")  # a row per year


def class_quality(rows: DataFrame, horizons: int) -> DataFrame:
    """One row from rows (actual, predicted: 0 none, then rises and falls per horizon; rise_i and fall_i: chances by horizon i).

    accuracy, balanced accuracy and macro F1 over the actual classes, how often none comes and is predicted, the Brier score over
    all horizons, how often chances fall from one horizon to the next, and the mean distance of horizons where something came.
    """
    known = rows.where(F.col("actual").isNotNull())
    cells = known.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    hits = lambda by: cells.groupBy(F.col(by).alias("class")).agg(F.sum("n").alias(by), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    each = hits("actual").join(hits("predicted").drop("hits"), "class", "left").withColumns({"recall": F.col("hits") / F.col("actual"), "precision": F.coalesce(F.try_divide("hits", F.col("predicted")), F.lit(0.0))})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    scores = each.agg(F.avg("recall").alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))
    a, p, h = F.col("actual"), F.col("predicted"), horizons
    came = {f"{kind}_{i}": a.between(first, first + i - 1).cast("double") for kind, first in (("rise", 1), ("fall", 1 + h)) for i in range(1, h + 1)}
    off = [(F.col(k) - v) * (F.col(k) - v) for k, v in came.items()]
    breaks = [(F.col(f"{kind}_{i + 1}") - F.col(f"{kind}_{i}") < -1e-7).cast("double") for kind in ("rise", "fall") for i in range(1, h)]
    bucket = lambda c: F.when(c == 0, h).when(c <= h, c - 1).otherwise(c - 1 - h)
    plain = known.agg(
        F.count("*").alias("rows"), F.avg((a == p).cast("double")).alias("accuracy"), F.avg((a == 0).cast("double")).alias("none_rate"), F.avg((p == 0).cast("double")).alias("predicted_none_rate"), F.countDistinct("predicted").alias("predicted_classes"),
        F.avg(sum(off[1:], off[0]) / len(off)).alias("brier"), (F.avg(sum(breaks[1:], breaks[0])) / max(h - 1, 1) if breaks else F.lit(0.0)).alias("violations"), F.avg(F.when(a != 0, F.abs(bucket(a) - bucket(p)))).alias("bucket_error"))
    return plain.crossJoin(F.broadcast(scores))


def gate_bins(rows: DataFrame, bins: int = 5) -> DataFrame:
    """rows (gate within 0..1, base, memory, outcome) by gate in equal bins, the right edge counting: rows, mean gate, mean advantage (how much
    smaller the memory's squared error is), how often there is one, and squared errors of base, memory and their mixture by the gate."""
    y, g = F.col("outcome"), F.col("gate")
    square = lambda c: (y - c) * (y - c)
    errors = rows.withColumns({"_b": square(F.col("base")), "_m": square(F.col("memory")), "_g": square((1 - g) * F.col("base") + g * F.col("memory"))})
    bin_ = F.greatest(F.ceil(g * bins) - 1, F.lit(0)).cast("int")
    gain = F.col("_b") - F.col("_m")
    return errors.where(g.between(0, 1) & y.isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("rows"), F.avg(g).alias("mean_gate"), F.avg(gain).alias("advantage"), F.avg((gain > 0).cast("double")).alias("wins"), F.avg("_b").alias("base_error"), F.avg("_m").alias("memory_error"), F.avg("_g").alias("mixed_error"))


def rank_correlation(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by, spearman of the rows that have both; ties share their mean rank; ranks come from counts per value."""
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).alias("_a"), F.col(b).alias("_b"))
    ranked = average_rank(average_rank(known, "_a", by, "_x"), "_b", by, "_y")
    return ranked.groupBy(*by).agg(correlation("_x", "_y").alias("spearman"))


def source_markets(neighbors: DataFrame, weight: str) -> DataFrame:
    """neighbors (market, null: unknown; weight) per market: neighbors, their share, and their share of the weight (0 without any)."""
    rows = neighbors.groupBy(F.coalesce("market", F.lit("unknown")).alias("market")).agg(F.count("*").alias("neighbors"), F.sum(F.coalesce(weight, F.lit(0.0))).alias("_w"))
    every = Window.partitionBy()  # a row per market
    return rows.select("market", "neighbors", (F.col("neighbors") / F.sum("neighbors").over(every)).alias("share"), F.coalesce(F.try_divide(F.col("_w"), F.sum("_w").over(every)), F.lit(0.0)).alias("weight_share"))


def moving_returns(cycles: DataFrame, window: int) -> DataFrame:
    """security, cycles, ema and mean of the last `window` returns of cycles (security, start_idx, return_pct) in order; the average is seeded by the first."""
    rows = cycles.select("security", "start_idx", "return_pct")
    out = frames.per_security(rows, lambda x: {"ema": average(x["return_pct"], window, float(x["return_pct"][0]))}, ["return_pct"], "ema double", order="start_idx")
    back = F.row_number().over(Window.partitionBy("security").orderBy(F.desc("start_idx")))
    out = out.withColumn("_p", back)
    return out.groupBy("security").agg(F.count("*").alias("cycles"), F.max(F.when(F.col("_p") == 1, F.col("ema"))).alias("ema"), F.avg(F.when(F.col("_p") <= window, F.col("return_pct"))).alias("mean"))


def linked_back(decisions: DataFrame, trades: DataFrame, lasting: int) -> DataFrame:
    """decisions (session, security, decision) with trade_id, held, realized and lasted of the trade that an entry opened.

    trades: trade_id, entry, security, held, realized, rebalance. Of several trades of a day and security the last by id counts;
    rebalances do not. Decisions other than "enter", and entries that opened none, have nulls.
    """
    own = trades.where(~F.col("rebalance")).groupBy(F.col("entry").alias("session"), "security").agg(F.max_by(F.struct("trade_id", "held", "realized"), "trade_id").alias("_t"))
    rows = decisions.join(own, ["session", "security"], "left")
    t = F.when(F.col("decision") == "enter", F.col("_t"))
    return rows.withColumns({"trade_id": t["trade_id"], "held": t["held"], "realized": t["realized"]}).withColumn("lasted", F.col("held") >= lasting).drop("_t")


def trade_accounting(trades: DataFrame, slippage: float, tolerance: float = 1e-4) -> DataFrame:
    """One row: trades (entry_price, exit_price, shares, pnl), and how many state a gain that prices after costs on both sides don't give."""
    real = (F.col("exit_price") * (1 - slippage) - F.col("entry_price") * (1 + slippage)) * F.col("shares")
    return trades.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.abs(real - F.col("pnl")) > tolerance, F.lit(True))).alias("violations"))


def logged_weights(neighbors: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: queries, and how many have a logged weight (weight) that is not the Gaussian of its distance over the query's median distance."""
    own = Window.partitionBy("query_id")
    rows = neighbors.withColumn("_d", F.greatest(F.sqrt("distance"), F.lit(1e-9)))
    rows = rows.withColumn("_w", F.exp(-0.5 * F.pow(F.col("_d") / F.greatest(F.median("_d").over(own), F.lit(1e-9)), F.lit(2))))
    off = F.abs(F.col("_w") / F.sum("_w").over(own) - F.coalesce("weight", F.lit(-1.0)))
    return rows.withColumn("_off", off).groupBy("query_id").agg(F.max("_off").alias("_off")).agg(F.count("*").alias("rows"), F.count_if(F.col("_off") > tolerance).alias("violations"))


def account_metrics(days: DataFrame, key: str, capital: float) -> DataFrame:
    """days (key, session, equity, traded, held) per key: annual return, volatility and Sharpe ratio of returns from the initial capital on,
    largest fall from a peak (capital counts), share of rising days, turnover a year and mean exposure; null where equity is not above 0 at some time."""
    own = Window.partitionBy(key).orderBy("session")
    back = F.coalesce(F.lag("equity").over(own), F.lit(float(capital)))
    rows = days.withColumns({"_r": F.col("equity") / back - 1, "_peak": F.greatest(F.max("equity").over(own), F.lit(float(capital)))})
    n, vol, e = F.count("*"), F.stddev_pop("_r"), F.col("equity")
    out = rows.groupBy(key).agg(
        n.alias("sessions"), F.min("equity").alias("_low"), F.expm1(252 * F.avg(F.when(F.col("_r") > -1, F.log1p("_r")))).alias("annual_return"), (vol * 252**0.5).alias("volatility"), F.when(vol <= 1e-8, 0.0).otherwise(F.avg("_r") / vol * 252**0.5).alias("sharpe"),
        F.min(e / F.col("_peak") - 1).alias("max_drawdown"), F.avg((F.col("_r") > 0).cast("double")).alias("win_rate"), (252 / n * F.sum(F.abs("traded")) / (2 * F.avg(e))).alias("turnover"), F.avg(F.col("held") / e).alias("exposure"))
    names = ["annual_return", "volatility", "sharpe", "max_drawdown", "win_rate", "turnover", "exposure"]
    return out.select(key, "sessions", *(F.when(F.col("_low") > 0, F.col(c)).alias(c) for c in names))


def regret(rows: DataFrame, score: str, utility: str, k: int, temperature: float, cash: float = 0.0, least: float = 0.0) -> DataFrame:
    """Per session: exposure of a softmax of scores and cash, exposure that the utilities above `least` call for (their number over k, at most 1),
    the squared difference (coverage_error), the cross entropy to the best k by utility (allocation_loss), and regret, what these would
    have given beyond the softmax, at least 0. Rows without a utility are left out; of equal utilities the smaller security comes first."""
    day = Window.partitionBy("session")
    u = F.col(utility)
    rows = rows.where(u.isNotNull()).select("session", "security", F.col(score).alias("_s"), u.alias("_u"))
    place = F.row_number().over(day.orderBy(F.when(F.col("_u") > least, F.col("_u")).desc_nulls_last(), "security"))
    rows = rows.withColumns({"_place": place, "_top": F.greatest(F.max("_s").over(day), F.lit(cash)), "_many": F.count_if(F.col("_u") > least).over(day)})
    chosen = (F.col("_u") > least) & (F.col("_place") <= k)
    rows = rows.withColumns({"_e": F.exp((F.col("_s") - F.col("_top")) / temperature), "_c": F.exp((F.lit(cash) - F.col("_top")) / temperature), "_best": F.max("_u").over(day)})
    rows = rows.withColumn("_t", F.when(chosen, F.exp((F.col("_u") - F.col("_best")) / temperature)).otherwise(0.0))
    sums = rows.groupBy("session").agg(*(F.sum(x).alias(n) for n, x in {"_E": F.col("_e"), "_T": F.col("_t"), "_eu": F.col("_e") * F.col("_u"), "_tu": F.col("_t") * F.col("_u"), "_ts": F.col("_t") * (F.col("_s") - F.col("_top")) / temperature}.items()), F.max("_c").alias("_c"), F.max("_many").alias("_many"), F.max("_top").alias("_top"))
    want = F.least(F.lit(1.0), F.col("_many") / k)
    all_ = F.col("_E") + F.col("_c")
    chosen_mean = lambda c: F.when(F.col("_T") > 0, F.col(c) / F.col("_T")).otherwise(0.0)
    loss = -((1 - want) * ((F.lit(cash) - F.col("_top")) / temperature - F.ln(all_)) + want * (chosen_mean("_ts") - F.ln(all_)))
    exposure = 1 - F.col("_c") / all_
    return sums.select("session", exposure.alias("exposure"), want.alias("wanted"), loss.alias("allocation_loss"), ((exposure - want) * (exposure - want)).alias("coverage_error"), F.greatest(F.lit(0.0), want * chosen_mean("_tu") - F.col("_eu") / all_).alias("regret"))


def central_only(evidence: DataFrame) -> DataFrame:
    """evidence (expected) collapsed to its central value: that as the score, its upside and downside parts, and neutral values of everything else."""
    x = F.col("expected")
    return evidence.select("query_id", x.alias("score"), F.greatest(x, F.lit(0.0)).alias("upside"), F.least(x, F.lit(0.0)).alias("downside"), x.isNotNull().cast("double").alias("confidence"), F.lit(0.5).alias("path"), F.lit(0.0).alias("tail"), F.lit(1.0).alias("agreement"), F.lit(0.0).alias("disagreement"))


#: Gates of a policy that compares scored rows with limits, and those that keep its trading rules but let all evidence pass.
GATES = {"score": 0.0, "upside": 0.02, "downside": -0.08, "confidence": 0.4}
NEUTRAL = {"score": 0.0, "upside": 0.0, "downside": -1e6, "confidence": 0.0}


def admitted(rows: DataFrame, gates: dict[str, float]) -> Column:
    """Whether a row reaches every gate; a missing value does not."""
    tests = [F.coalesce(F.col(c) >= v, F.lit(False)) for c, v in gates.items()]
    return sum((t.cast("int") for t in tests[1:]), tests[0].cast("int")) == len(tests)


def paired_cells(cells: DataFrame, candidate: str, comparator: str, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys and the differences of the metrics of candidate less comparator, for keys that both arms have. cells: arm, keys, metrics."""
    side = lambda arm, suffix: cells.where(F.col("arm") == arm).select(*keys, *(F.col(m).alias(f"{m}{suffix}") for m in metrics))
    both = side(candidate, "_a").join(side(comparator, "_b"), keys)
    return both.select(*keys, *((F.col(f"{m}_a") - F.col(f"{m}_b")).alias(m) for m in metrics))
