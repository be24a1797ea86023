"""Recursive averages: the one family of features that no window frame gives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from retroscope.functions import frames

EMA = "ema_12 double, ema_26 double, macd double, macd_signal double"


def average(x: np.ndarray, span: int, first: float) -> np.ndarray:
    """Exponential average of that span, each value a step of 2 / (span + 1) from the one before, which is first at first."""
    out, now, step = np.empty(x.size), first, 2 / (span + 1)
    for i, value in enumerate(x.tolist()):
        now += step * (value - now)
        out[i] = now
    return out


def _macd(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    close = x["close"]
    fast, slow = average(close, 12, close[0]), average(close, 26, close[0])
    return {"ema_12": fast, "ema_26": slow, "macd": fast - slow, "macd_signal": average(fast - slow, 9, 0.0)}


def macd(bars: DataFrame) -> DataFrame:
    """Exponential averages of spans 12 and 26, seeded by the first close, their difference and its span-9 average."""
    return frames.per_security(bars.select("security", "session", "ordinal", "close"), _macd, ["close"], EMA).drop("close")
