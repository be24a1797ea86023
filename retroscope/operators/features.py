"""Rolling features of daily bars: trend, momentum, volume and volatility of each security."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retroscope.functions import frames
from retroscope.functions.windows import EPS, by_time, change, deviation, full, mean, slope


_TECH = ["return_1", "momentum_3", "momentum_10", "momentum_21", "vol_21", "avg_volume_21", "volume_change_1", "intraday_range", "drawdown", "trend_slope", "sma_50", "sma_150", "sma_200", "52w_low", "52w_high", "up_down_volume_ratio_50", "volume_ratio", "close_vs_sma_50", "close_vs_sma_150", "close_vs_sma_200", "sma_200_trend_20", "pct_above_52w_low", "pct_from_52w_high"]
_SCORES = ["minervini_template_score", "minervini_gate"]


def _technical(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    c, v = x["close"], x["volume"]
    r, move = frames.change(c), c - frames.before(c)
    low, high = (frames.full(c, 252, lambda w, f=f: f(w, axis=1)) for f in (np.min, np.max))
    sma = {k: frames.mean(c, k) for k in (50, 150, 200)}
    volume = frames.total(v, 21, 21) / 21
    weights = (np.arange(10) - 4.5) / 82.5
    trend = sma[200] / frames.before(sma[200], 20) - 1
    out = {
        "return_1": r, **{f"momentum_{k}": frames.change(c, k) for k in (3, 10, 21)}, "vol_21": frames.deviation(r, 21), "avg_volume_21": volume, "volume_change_1": frames.change(v),
        "intraday_range": (x["high"] - x["low"]) / (c + EPS), "drawdown": c / frames.highest(c, 252) - 1, "trend_slope": frames.full(c, 10, lambda w: w @ weights),
        **{f"sma_{k}": m for k, m in sma.items()}, "52w_low": low, "52w_high": high,
        "up_down_volume_ratio_50": frames.total(np.where(move > 0, v, 0.0), 50, 20) / (frames.total(np.where(move < 0, v, 0.0), 50, 20) + EPS),
        "volume_ratio": v / (volume + EPS), **{f"close_vs_sma_{k}": c / (m + EPS) - 1 for k, m in sma.items()}, "sma_200_trend_20": trend, "pct_above_52w_low": c / low - 1, "pct_from_52w_high": c / high - 1,
    }
    tests = [(c > sma[150]) & (c > sma[200]), sma[150] > sma[200], trend > 0, (sma[50] > sma[150]) & (sma[50] > sma[200]), c > sma[50], out["pct_above_52w_low"] > 0.3, out["pct_from_52w_high"] > -0.25]
    score = np.sum(tests, axis=0).astype(np.int32)
    out |= {"minervini_template_score": score, "minervini_gate": (score >= 6).astype(np.int32)}
    return {f"tech_{k}": value for k, value in out.items()}


def technical_features(bars: DataFrame) -> DataFrame:
    """bars (security, session, open, high, low, close, volume) with the tech_ columns.

    Frames are full but for tech_drawdown (from the first row) and the up-down volume ratio (20 rows of 50).
    """
    added = ", ".join([*(f"`tech_{c}` double" for c in _TECH), *(f"tech_{c} int" for c in _SCORES)])
    return frames.per_security(bars, _technical, ["high", "low", "close", "volume"], added)


def oscillators(bars: DataFrame) -> DataFrame:
    """rsi_14, atr_ratio_14, bollinger_width_20, vol_ratio_63_21, up_down_volume_50, trend_slope_21 of full frames."""
    c, v = F.col("close"), F.col("volume")
    before = F.lag(c, 1).over(by_time())
    diff = c - before
    bars = bars.withColumns({
        "_r": change(c),
        "_gain": F.when(diff > 0, diff).when(diff.isNotNull(), 0.0),
        "_loss": F.when(diff < 0, -diff).when(diff.isNotNull(), 0.0),
        "_up": F.when(diff > 0, v).when(diff.isNotNull(), 0.0),
        "_down": F.when(diff < 0, v).when(diff.isNotNull(), 0.0),
        "_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
    })
    gain, loss = mean(F.col("_gain"), 14), mean(F.col("_loss"), 14)
    return bars.withColumns({
        "rsi_14": F.when((gain == 0) & (loss == 0), 0.5).otherwise(gain / (gain + loss + EPS)),
        "atr_ratio_14": mean(F.col("_range"), 14) / (c + EPS),
        "bollinger_width_20": 4 * deviation(c, 20) / (mean(c, 20) + EPS),
        "vol_ratio_63_21": deviation(F.col("_r"), 63) / (deviation(F.col("_r"), 21) + EPS),
        "up_down_volume_50": full(F.sum, F.col("_up"), 50) / (full(F.sum, F.col("_down"), 50) + EPS),
        "trend_slope_21": slope(c, 21) / (c + EPS),
    }).drop("_r", "_gain", "_loss", "_up", "_down", "_range")


def islands(bars: DataFrame) -> DataFrame:
    """Runs of sessions that close up, or don't: security, first, last, rows, up."""
    c = F.col("close")
    up = (c > F.lag(c, 1).over(by_time())).cast("int")
    rows = bars.withColumn("up", up).where("up is not null")
    rows = rows.withColumn("_new", F.coalesce((F.col("up") != F.lag("up", 1).over(by_time())).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("_new").over(by_time()))
    return rows.groupBy("security", "run").agg(F.min("session").alias("first"), F.max("session").alias("last"), F.count("*").alias("rows"), F.min("up").alias("up"))


def transitions(rows: DataFrame, state: str, outcome: str, steps: tuple[int, ...], tolerance: float) -> DataFrame:
    """step, state, to_state, count, probability, mean_outcome (at arrival) of states that many rows apart; pairs whose
    days differ by more than tolerance from step times the median gap of rows are left out."""
    gap = F.datediff("session", F.lag("session", 1).over(by_time()))
    usual = rows.withColumn("_g", gap).groupBy("_g").agg(F.count("*").alias("_n")).where("_g is not null")  # a row per gap
    usual = usual.agg(F.percentile("_g", 0.5, F.col("_n")).alias("_usual"))
    later = F.array(*(F.struct(F.lit(k).alias("step"), F.lead(state, k).over(by_time()).alias("to_state"), F.lead(outcome, k).over(by_time()).alias("_o"), F.datediff(F.lead("session", k).over(by_time()), "session").alias("_days"), (F.lead("ordinal", k).over(by_time()) - F.col("ordinal")).alias("_rows")) for k in steps))
    pairs = rows.withColumn("_p", later).select(F.col(state).alias("state"), F.explode("_p").alias("p")).select("state", "p.*").where(F.col("_rows") == F.col("step"))
    span = F.col("step") * F.col("_usual")
    kept = pairs.crossJoin(F.broadcast(usual)).where(F.col("_days").between(span * (1 - tolerance), span * (1 + tolerance)))
    counts = kept.groupBy("step", "state", "to_state").agg(F.count("*").alias("count"), F.avg("_o").alias("mean_outcome"))
    return counts.withColumn("probability", F.col("count") / F.sum("count").over(Window.partitionBy("step", "state")))
