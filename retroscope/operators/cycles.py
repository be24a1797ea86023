"""Rises of a price from a start to a peak and a breakdown: candidates, selections, rows annotated, decoders, matching.

A security's rows, which a calendar bounds, are one group; within it numpy compares whole stretches at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retroscope.functions.arrays import dot
from retroscope.operators.metric import normal_share

CANDIDATES = "security bigint, start_idx bigint, peak_idx bigint, end_idx bigint, peak_return double, end_return double, required double, drawdown double, volatility double, score double"
#: Starts, or candidates, whose ways ahead are compared at once.
_BLOCK = 256


def _context(price: np.ndarray, window: int = 21) -> tuple[np.ndarray, np.ndarray]:
    """Rolling deviation and mean size of the returns, with those of all of them where fewer than a third are there."""
    returns = pd.Series(price).pct_change()
    least = max(5, window // 3)
    spread, size = returns.rolling(window, min_periods=least).std(), returns.abs().rolling(window, min_periods=least).mean()
    all_spread, all_size = returns.std(), returns.abs().mean()
    good = lambda x, other: x if np.isfinite(x) and x > 0 else other
    return spread.fillna(good(all_spread, 0.02)).to_numpy(), size.fillna(good(all_size, 0.01)).to_numpy()


def _of_starts(price: np.ndarray, spread: np.ndarray, size: np.ndarray, starts: np.ndarray, shortest: int, longest: int, least_return: float) -> pd.DataFrame:
    """All candidates that begin at a block of starts: peaks not below any price from the shortest duration on, high enough for
    how the price moves, without too deep a fall before, each with the end of the first breakdown after it."""
    ahead = np.lib.stride_tricks.sliding_window_view(np.append(price, np.full(longest, np.nan)), longest + 1)[starts] / price[starts, None]  # a row per start
    spread, size, peaks = spread[starts], size[starts], np.arange(shortest, longest + 1)
    top = np.maximum.accumulate(np.hstack((np.ones((starts.size, 1)), ahead[:, shortest:-1])), axis=1)
    row, i = np.nonzero(ahead[:, shortest:] >= top)
    gain, fall, root = ahead[row, i + shortest] - 1, np.minimum.accumulate(ahead, axis=1)[row, i + shortest] - 1, np.sqrt(peaks[i])
    required = np.maximum(max(least_return, 0.10), size[row] * 1.5 * root + spread[row] * 0.75 * root)
    soft = np.maximum(0.05, 2 * spread[row])
    hard = np.maximum(0.12, soft * 1.75)
    ok = np.flatnonzero((gain >= required) & (fall >= -hard))
    row, peak, gain, fall, required, soft, hard = row[ok], peaks[i[ok]], gain[ok], fall[ok], required[ok], soft[ok], hard[ok]
    high, limit, end = ahead[row, peak], np.maximum(0.12, 2 * spread[row]), peak.copy()
    for a in range(0, row.size, _BLOCK):
        part = slice(a, a + _BLOCK)
        broken = (ahead[row[part]] / high[part, None] - 1 <= -limit[part, None]) & (np.arange(longest + 1) > peak[part, None])
        first = broken.argmax(axis=1)
        end[part] = np.where(first > 0, first, peak[part])
    last = ahead[row, end]
    calm = np.where(fall >= -soft, 1.0, np.clip(1 - (-fall - soft) / (hard - soft), 0, 1))
    held = np.clip((last / high - 0.75) / 0.25, 0, 1)
    score = 0.40 * np.clip(gain / (2 * required), 0, 1) + 0.24 * calm + 0.12 * held + 0.08 * np.clip(peak / longest, 0, 1) + 0.16 * 0.5
    s = starts[row]
    return pd.DataFrame({"start_idx": s, "peak_idx": s + peak, "end_idx": s + end, "peak_return": gain, "end_return": last - 1, "required": required, "drawdown": fall, "volatility": spread[row], "score": score})


def _each(shortest: int, longest: int, least_return: float, pick: Callable[[pd.DataFrame], pd.DataFrame] = lambda found: found):
    """What pick leaves of a security's candidates, which come by start and peak."""
    names = [c.split()[0] for c in CANDIDATES.split(", ")]

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        price = rows.sort_values("ordinal")["price"].to_numpy(float)
        spread, size = _context(price)
        starts = np.arange(max(price.size - shortest, 0))
        blocks = [starts[a : a + _BLOCK] for a in range(0, max(starts.size, 1), _BLOCK)]
        found = pd.concat([_of_starts(price, spread, size, b, shortest, longest, least_return) for b in blocks])
        return pick(found).assign(security=rows["security"].iloc[0])[names]

    return of


def candidates(prices: DataFrame, shortest: int = 21, longest: int = 252, least_return: float = 0.0) -> DataFrame:
    """prices (security, ordinal, price): every candidate cycle of every start, without thresholds on score."""
    return prices.groupBy("security").applyInPandas(_each(shortest, longest, least_return), CANDIDATES)


def detect(prices: DataFrame, shortest: int = 21, longest: int = 252, least_return: float = 0.30, least_score: float = 0.58) -> DataFrame:
    """Cycles from left to right: the candidate of the latest peak that scores enough is taken, and the scan goes on
    after its end; where a start has none, at the next row."""

    def pick(found):
        found = found[found["score"] >= least_score].drop_duplicates("start_idx", keep="last")
        taken, s = [], 0
        for i, (start, end) in enumerate(zip(found["start_idx"], found["end_idx"], strict=True)):
            if start >= s:
                taken.append(i)
                s = end + 1
        return found.iloc[taken]

    return prices.groupBy("security").applyInPandas(_each(shortest, longest, least_return, pick), CANDIDATES)


def best_per_start(found: DataFrame) -> DataFrame:
    """The best-scored candidate of each start, the earlier peak on ties."""
    columns = [c for c in found.columns if c not in ("security", "start_idx")]
    top = F.min_by(F.struct(*columns), F.struct(-F.round("score", 9), F.col("peak_idx")))
    return found.groupBy("security", "start_idx").agg(top.alias("c")).select("security", "start_idx", "c.*")


def learned_scores(found: DataFrame, features: list[Column], layers: DataFrame) -> DataFrame:
    """found with score, from 0 to 1, by a small network of the features.

    layers: layer (from 0), unit, weights (one per input) and bias; between layers the outputs are x * P(normal < x), and the
    last layer has one unit, whose sigmoid is the score. A table of a bounded number of units, sent to all rows as one array.
    Missing features count as 0.
    """
    one = layers.agg(F.array_sort(F.collect_list(F.struct("layer", "unit", "weights", "bias"))).alias("_units"))
    depth = layers.agg(F.max("layer")).first()[0]
    if depth is None:
        raise ValueError("no layers")
    x = F.array(*(F.coalesce(f.cast("double"), F.lit(0.0)) for f in features))
    for layer in range(depth + 1):

        def through(inputs: Column, layer: int = layer) -> Column:
            out = F.transform(F.filter("_units", lambda u: u["layer"] == layer), lambda u: dot(inputs, u["weights"]) + u["bias"])
            return F.transform(out, lambda v: v * normal_share(v)) if layer < depth else out

        x = F.get(F.transform(F.array(x), lambda inputs: through(inputs)), 0)  # noqa: B023  (bound once, not worked out per unit)
    return found.crossJoin(F.broadcast(one)).withColumn("score", 1 / (1 + F.exp(-F.get(x, 0)))).drop("_units")


def undominated(spans: DataFrame) -> DataFrame:
    """Spans (security, start_idx, end_idx, score) that `without_overlap` can take: of a start, those that score higher than every shorter one.

    Nothing is lost: what meets the shorter, better span meets the longer one too, so when the longer one's turn comes
    either the shorter one or what kept it out is in its way. A start has a row per length at most.
    """
    one = spans.groupBy("security", "start_idx", "end_idx").agg(F.max("score").alias("score"))
    shorter = Window.partitionBy("security", "start_idx").orderBy("end_idx").rowsBetween(Window.unboundedPreceding, -1)
    score = F.round("score", 9)
    return one.withColumn("_b", F.max(score).over(shorter)).where(F.col("_b").isNull() | (score > F.col("_b"))).drop("_b")


def without_overlap(spans: DataFrame) -> DataFrame:
    """Spans (security, start_idx, end_idx, score) taken from the best score down, each where it meets none taken before."""
    listed = F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("k"), "start_idx", "end_idx")))

    def step(taken, x):
        meets = F.exists(taken, lambda y: (y["start_idx"] <= x["end_idx"]) & (x["start_idx"] <= y["end_idx"]))
        return F.when(meets, taken).otherwise(F.array_append(taken, x))

    rows = spans.groupBy("security").agg(listed.alias("_l"))
    taken = F.aggregate("_l", F.filter("_l", lambda x: F.lit(False)), step)
    return rows.select("security", F.explode(taken).alias("x")).select("security", "x.start_idx", "x.end_idx", (-F.col("x.k")).alias("score"))


def annotate(prices: DataFrame, cycles: DataFrame) -> DataFrame:
    """Each row with its cycle: id (from 0 by start, -1 outside), action (1 first row, 2 between, 3 last, 0 outside),
    progress from 0 to 1, and rows to the peak. Cycles of a security do not meet."""
    listed = cycles.groupBy("security").agg(F.array_sort(F.collect_list(F.struct("start_idx", "end_idx", "peak_idx"))).alias("_c"))
    rows = prices.join(listed, "security", "left")
    o = F.col("ordinal")
    inside = F.transform("_c", lambda c: (c["start_idx"] <= o) & (o <= c["end_idx"]))
    number = F.coalesce(F.array_position(inside, True) - 1, F.lit(-1))
    rows = rows.withColumn("cycle", number.cast("int")).withColumn("_x", F.when(F.col("cycle") >= 0, F.get("_c", F.greatest(F.col("cycle"), F.lit(0)))))
    first, last = F.col("_x.start_idx"), F.col("_x.end_idx")
    action = F.when(first.isNull(), 0).when(o == first, 1).when(o == last, 3).otherwise(2)
    progress = F.when(first.isNull() | (first == last), 0.0).otherwise((o - first) / F.nullif(last - first, F.lit(0)))
    return rows.select("security", "ordinal", "cycle", action.alias("action"), progress.alias("progress"), (F.col("_x.peak_idx") - o).alias("lead_to_peak"))


def _fold(rows: DataFrame, columns: list[str], start: F.Column, step, taken: str) -> DataFrame:
    """A fold over each security's rows in order of ordinal; state is a struct that holds the spans found so far."""
    listed = F.array_sort(F.collect_list(F.struct("ordinal", *columns)))
    return rows.groupBy("security").agg(listed.alias("_l")).withColumn("_s", F.aggregate("_l", start, step)).withColumn("_end", F.element_at("_l", -1)["ordinal"]).select("security", "_s", "_end")


_SPANS = "array<struct<start_idx:bigint,end_idx:bigint>>"


def action_spans(rows: DataFrame) -> DataFrame:
    """rows (security, ordinal, action, gate): spans from an ENTER (1) whose gate holds to the next EXIT (3); one that is
    open at the end closes there."""
    start = F.struct(F.lit(None).cast("bigint").alias("open"), F.array().cast(_SPANS).alias("spans"))

    def step(s, x):
        opens = s["open"].isNull() & (x["action"] == 1) & x["gate"]
        closes = s["open"].isNotNull() & (x["action"] == 3)
        spans = F.when(closes, F.array_append(s["spans"], F.struct(s["open"].alias("start_idx"), x["ordinal"].alias("end_idx")))).otherwise(s["spans"])
        return F.struct(F.when(opens, x["ordinal"]).when(~closes, s["open"]).alias("open"), spans.alias("spans"))

    return _closed(_fold(rows, ["action", "gate"], start, step, "spans"))


def _closed(folded: DataFrame) -> DataFrame:
    rest = F.when(F.col("_s.open").isNotNull(), F.array(F.struct(F.col("_s.open").alias("start_idx"), F.col("_end").alias("end_idx")))).otherwise(F.array().cast(_SPANS))
    return folded.select("security", F.explode(F.concat("_s.spans", rest)).alias("x")).select("security", "x.*")


def return_spans(rows: DataFrame, enter: float = 0.20, risk: float = 0.10, leave: float = 0.10, patience: int = 3, cooldown: int = 0) -> DataFrame:
    """rows (security, ordinal, up, down: predicted extremes): spans that begin where up is at least enter and down not
    under -risk, and end where up under leave, or down under -risk, has lasted `patience` rows; the next begins more than
    cooldown rows later. One that is open at the end closes there."""
    start = F.struct(F.lit(None).cast("bigint").alias("open"), F.lit(0).alias("bad"), F.lit(-10_000).cast("bigint").alias("closed"), F.array().cast(_SPANS).alias("spans"))

    def step(s, x):
        up, down = F.coalesce(x["up"], F.lit(float("-inf"))), F.coalesce(x["down"], F.lit(float("inf")))
        was = s["open"].isNotNull()
        opens = ~was & (x["ordinal"] - s["closed"] > cooldown) & (up >= enter) & (down >= -risk)
        bad = F.when(was & ((up < leave) | (down < -risk)), s["bad"] + 1).otherwise(0)
        closes = was & (bad >= max(1, patience))
        spans = F.when(closes, F.array_append(s["spans"], F.struct(s["open"].alias("start_idx"), x["ordinal"].alias("end_idx")))).otherwise(s["spans"])
        return F.struct(F.when(opens, x["ordinal"]).when(~closes, s["open"]).alias("open"), F.when(closes, 0).otherwise(bad).alias("bad"), F.when(closes, x["ordinal"]).otherwise(s["closed"]).alias("closed"), spans.alias("spans"))

    return _closed(_fold(rows, ["up", "down"], start, step, "spans"))


def match(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """Pairs of spans of a security that overlap, one to one: by longest overlap, then its share of the union, then the
    later spans. Both: security, start_idx, end_idx."""
    p = predicted.select("security", F.col("start_idx").alias("p_start"), F.col("end_idx").alias("p_end"))
    t = true.select("security", F.col("start_idx").alias("t_start"), F.col("end_idx").alias("t_end"))
    both = p.join(t, "security").where("p_start <= t_end and t_start <= p_end")
    overlap = F.least("p_end", "t_end") - F.greatest("p_start", "t_start") + 1
    union = F.greatest("p_end", "t_end") - F.least("p_start", "t_start") + 1
    pair = F.struct((-overlap).alias("a"), (-F.round(overlap / union, 9)).alias("b"), (-F.col("p_start")).alias("c"), (-F.col("t_start")).alias("d"), "p_end", "t_end")

    def step(taken, x):
        return F.when(F.exists(taken, lambda y: (y["c"] == x["c"]) | (y["d"] == x["d"])), taken).otherwise(F.array_append(taken, x))

    rows = both.groupBy("security").agg(F.array_sort(F.collect_list(pair)).alias("_l"))
    taken = rows.select("security", F.explode(F.aggregate("_l", F.filter("_l", lambda x: F.lit(False)), step)).alias("x"))
    return taken.select("security", (-F.col("x.c")).alias("p_start"), F.col("x.p_end").alias("p_end"), (-F.col("x.d")).alias("t_start"), F.col("x.t_end").alias("t_end"), (-F.col("x.a")).alias("overlap"), (-F.col("x.b")).alias("iou"))


def match_quality(predicted: DataFrame, true: DataFrame, pairs: DataFrame, late: float = 1.5) -> DataFrame:
    """Per security: spans predicted and true, matched, precision, recall, f1, mean lead (rows from the predicted start to
    the true end) and exit error (rows over the true length, late ones weighed by `late`, at most 1; 1 without a match)."""
    count = lambda df, n: df.groupBy("security").agg(F.count("*").alias(n))
    off = F.col("p_end") - F.col("t_end")
    error = F.least(F.lit(1.0), F.abs(off) / (F.col("t_end") - F.col("t_start") + 1) * F.when(off > 0, late).otherwise(1.0))
    made = pairs.groupBy("security").agg(F.count("*").alias("matched"), F.avg(F.col("t_end") - F.col("p_start")).alias("mean_lead"), F.avg(error).alias("exit_error"))
    out = count(predicted, "predicted").join(count(true, "true_spans"), "security", "full_outer").join(made, "security", "left").na.fill(0, ["predicted", "true_spans", "matched"])
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    out = out.withColumns({"precision": part("matched", "predicted"), "recall": part("matched", "true_spans"), "exit_error": F.coalesce("exit_error", F.lit(1.0))})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def backfill(rows: DataFrame) -> DataFrame:
    """rows (security, ordinal, price, cycle, action, start_idx, end_idx, peak_idx) with every row's metadata filled in.

    A cycle's start, end and peak are the first that one of its rows states (null and below 0: not stated); else its first row, its
    last, and the first row of its highest price. duration, entry, exit, progress (even steps from 0 to 1 over
    its rows) and lead_to_peak follow. Rows outside of cycles (cycle below 0 or null) keep -1, 0 and null. Rows of a cycle meet
    once, whichever way a gap is filled.
    """
    own = Window.partitionBy("security", "cycle")
    inside = F.coalesce(F.col("cycle") >= 0, F.lit(False))
    stated = lambda c: F.min_by(c, F.when(F.col(c) >= 0, F.col("ordinal"))).over(own)
    highest = F.min_by("ordinal", F.struct(-F.col("price"), F.col("ordinal"))).over(own)
    found = {"start_idx": F.coalesce(stated("start_idx"), F.min("ordinal").over(own)), "end_idx": F.coalesce(stated("end_idx"), F.max("ordinal").over(own)), "peak_idx": F.coalesce(stated("peak_idx"), highest)}
    filled = {k: F.when(inside, v).otherwise(-1) for k, v in found.items()}
    place, count = F.row_number().over(own.orderBy("ordinal")) - 1, F.count("*").over(own)
    filled["progress"] = F.when(inside & (count > 1), place / (count - 1)).otherwise(0.0)
    rows = rows.withColumns(filled)
    return rows.withColumns({
        "duration": F.when(inside, F.greatest(F.col("end_idx") - F.col("start_idx") + 1, F.lit(1))).otherwise(0),
        "lead_to_peak": F.when(inside, F.col("peak_idx") - F.col("ordinal")), "entry": F.coalesce(F.col("action") == 1, F.lit(False)), "exit": F.coalesce(F.col("action") == 3, F.lit(False)),
    })
