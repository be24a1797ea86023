"""What became of each origin: forward returns, extremes, first hits, and when all of it was known."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retroscope.functions import frames
from retroscope.functions.windows import by_time, percent_rank


def forward_outcomes(bars: DataFrame, horizons: tuple[int, ...] = (21, 63), upside: float = 0.1, downside: float = -0.1) -> DataFrame:
    """future_return_h, and over the next rows (fewer at the end): extremes, offsets of peak and first hits.

    available: the session at which the longest horizon is over, null before that has come.
    """
    far = max(horizons)

    def of(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        c = x["close"]
        paths = frames.ahead(c, far)
        some = ~np.isnan(paths[:, 0])
        gains = paths / c[:, None] - 1
        top, bottom = (np.where(some, g.max(axis=1), np.nan) for g in (np.where(np.isnan(gains), -np.inf, gains), -np.where(np.isnan(gains), np.inf, gains)))
        bottom = -bottom
        place = lambda found, at: np.where(found, at + 1.0, np.nan)
        hit = lambda test: place(test.any(axis=1), test.argmax(axis=1))
        up, down = hit(gains >= upside), hit(gains <= downside)
        rise, fall = np.where(top > 0, top, 0.0), np.where(bottom < 0, -bottom, 0.0)
        out = {f"future_return_{h}": gains[:, h - 1] for h in horizons}
        return out | {
            "future_max_return": top, "future_min_return": bottom, "_peak": place(some, np.where(np.isnan(paths), -np.inf, paths).argmax(axis=1)), "_trough": place(some, np.where(np.isnan(paths), np.inf, paths).argmin(axis=1)),
            "_up": up, "_down": down, "upside_before_drawdown": np.where(np.isnan(up) | np.isnan(down), ~np.isnan(up), up < down).astype(np.int32), "path_quality": rise / (rise + fall + 1e-9),
        }

    added = ", ".join([*(f"future_return_{h} double" for h in horizons), *(f"{n} double" for n in ("future_max_return", "future_min_return", "_peak", "_trough", "_up", "_down")), "upside_before_drawdown int", "path_quality double"])
    out = frames.per_security(bars.withColumn("available", F.lead("session", far).over(by_time())), of, ["close"], added)
    offsets = {"peak_offset": "_peak", "trough_offset": "_trough", "up_offset": "_up", "down_offset": "_down"}
    return out.withColumns({k: F.col(v).cast("bigint") for k, v in offsets.items()}).drop(*offsets.values())


def relative_outcomes(outcomes: DataFrame, groups: DataFrame, column: str, least: int = 3) -> DataFrame:
    """column less the median of the same session in the same market, or of all where the market has fewer than least.

    A session is one group, of at most a row per security; passes over counts per value took four times as long.
    """
    rows = outcomes.join(groups, "security").where(F.col(column).isNotNull())
    market, everyone = Window.partitionBy("session", "market"), Window.partitionBy("session")
    own = F.when(F.count(column).over(market) >= least, F.median(column).over(market))
    benchmark = F.coalesce(own, F.median(column).over(everyone))
    return rows.withColumns({"benchmark": benchmark, "relative": F.col(column) - benchmark})


def _medians(rows: DataFrame, column: str, by: list[str], name: str, least: int = 1) -> DataFrame:
    """by, name: the median of column in groups of at least `least` values.

    An aggregate: values are counted where they are, and a group's counts meet, at most one per security of a session.
    """
    return rows.groupBy(*by).agg(F.count(column).alias("_n"), F.median(column).alias(name)).where(F.col("_n") >= least).drop("_n")


def blended_outcomes(outcomes: DataFrame, groups: DataFrame, column: str, weight: float = 0.5, least: int = 3) -> DataFrame:
    """column less the median of the same session and market (universe), and less a blend of that with the sector's there.

    Adds universe, sector_median (the universe's where the sector has fewer than least values), universe_alpha and
    blended_alpha. A row without a market or sector counts as "Unknown"; without a value it is left out.
    """
    rows = outcomes.join(groups, "security").where(F.col(column).isNotNull()).withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in ("market", "sector")})
    universe = _medians(rows, column, ["session", "market"], "universe")
    sector = _medians(rows, column, ["session", "market", "sector"], "_sector", least)
    rows = rows.join(universe, ["session", "market"]).join(sector, ["session", "market", "sector"], "left").withColumn("sector_median", F.coalesce("_sector", "universe")).drop("_sector")
    blend = weight * F.col("sector_median") + (1 - weight) * F.col("universe")
    return rows.withColumns({"universe_alpha": F.col(column) - F.col("universe"), "blended_alpha": F.col(column) - blend})


def event_labels(prices: DataFrame, horizons: tuple[int, ...] = (21, 42, 63), look_back: int = 63, floors: tuple[float, float] = (0.02, 0.02), times: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """prices (security, session, ordinal, price): upside and downside barriers from the deviation of the last log returns
    over the first horizon's root (at least floors), the first barrier hit, its offset, and its class: 0 none, then one
    class per horizon for rises, then for falls. immature where the last horizon is not over and nothing was hit."""
    step = F.ln(F.col("price") / F.lag("price", 1).over(by_time()))
    rows = prices.withColumn("_step", step)
    frame = by_time().rowsBetween(1 - look_back, 0)
    spread = F.when(F.count("_step").over(frame) > 1, F.stddev_samp("_step").over(frame)).otherwise(0.0) * horizons[0] ** 0.5
    rows = rows.withColumns({"upside": F.greatest(F.lit(floors[0]), times[0] * spread), "downside": F.greatest(F.lit(floors[1]), times[1] * spread), "_ahead": F.collect_list("price").over(by_time().rowsBetween(1, horizons[-1]))})
    p = F.col("price")
    first = lambda test: F.nullif(F.array_position(F.transform("_ahead", test), True), F.lit(0))
    rows = rows.withColumns({"_up": first(lambda x: x / p - 1 >= F.col("upside")), "_down": first(lambda x: x / p - 1 <= -F.col("downside"))})
    rises = F.col("_up").isNotNull() & F.coalesce(F.col("_up") < F.col("_down"), F.lit(True))
    event = F.when(F.col("_up").isNull() & F.col("_down").isNull(), "none").when(rises, "upside").otherwise("drawdown")
    offset = F.coalesce(F.when(rises, F.col("_up")).otherwise(F.col("_down")), F.lit(0)).cast("int")
    rows = rows.withColumns({"event": event, "offset": offset})
    bucket = sum(((F.col("offset") > h).cast("int") for h in horizons[1:]), (F.col("offset") > horizons[0]).cast("int"))
    kind = F.when(F.col("event") == "none", 0).when(F.col("event") == "upside", 1 + bucket).otherwise(1 + len(horizons) + bucket)
    immature = (F.col("event") == "none") & (F.size("_ahead") < horizons[-1])
    return rows.withColumns({"class": kind, "immature": immature}).drop("_ahead", "_up", "_down", "_step")


def score_exits(rows: DataFrame, hold: int = 63, least_hold: int = 5, fraction: float = 0.5, least_score: float = 0.0, stop: float = 0.12) -> DataFrame:
    """rows (security, session, ordinal, price, score): how long a position of each row is held: until the price has lost
    `stop`, or the score has fallen to a fraction of its first value (at least least_score), looked at from least_hold
    rows on, or `hold` rows have passed. Adds holding, exit_reason, exit_return."""
    ahead = F.collect_list(F.struct("price", "score")).over(by_time().rowsBetween(1, hold))
    limit = F.greatest(F.lit(least_score), F.col("score") * fraction)
    rows = rows.withColumns({"_ahead": ahead, "_limit": F.coalesce(limit, F.lit(least_score))})
    p = F.col("price")
    later = lambda i: i + 1 >= least_hold
    stopped = F.transform("_ahead", lambda x, i: later(i) & (x["price"] / p - 1 <= -stop))
    faded = F.transform("_ahead", lambda x, i: later(i) & F.coalesce(x["score"] <= F.col("_limit"), F.lit(False)))
    place = lambda flags: F.nullif(F.array_position(flags, True), F.lit(0))
    rows = rows.withColumns({"_s": place(stopped), "_f": place(faded)})
    by_stop = F.col("_s").isNotNull() & F.coalesce(F.col("_s") <= F.col("_f"), F.lit(True))
    reason = F.when(by_stop, "stop_loss").when(F.col("_f").isNotNull(), "score_exit").otherwise("max_hold")
    holding = F.greatest(F.lit(1), F.coalesce(F.when(by_stop, F.col("_s")).otherwise(F.col("_f")), F.size("_ahead").cast("bigint"))).cast("int")
    rows = rows.withColumns({"exit_reason": reason, "holding": holding})
    end = F.get("_ahead", F.col("holding") - 1)["price"]
    return rows.withColumn("exit_return", F.coalesce(end / p - 1, F.lit(0.0))).drop("_ahead", "_limit", "_s", "_f")


def utilities(rows: DataFrame, realized: str, benchmark: str, adverse: str, holding: str, cost: float = 0.002, weight: float = 0.35, per_session: float = 0.0001) -> DataFrame:
    """rows with net_alpha (realized less benchmark and costs), utility (less a part of the adverse excursion and a cost per
    session held), and same_date_rank: its average-tie percent rank within the session."""
    rows = rows.withColumn("net_alpha", F.col(realized) - F.col(benchmark) - cost)
    rows = rows.withColumn("utility", F.col("net_alpha") - weight * F.abs(adverse) - per_session * F.col(holding))
    return rows.withColumn("same_date_rank", percent_rank(F.col("utility"), "session"))


def path_valid_targets(bars: DataFrame, valid: F.Column, segment: str, horizon: int = 21, maturity: int = 42) -> DataFrame:
    """The return over `horizon` rows and the session `maturity` rows ahead, where every row up to there is valid and of the
    same segment; null elsewhere."""
    rows = bars.withColumn("_v", valid.cast("int"))

    def open_path(k: int):
        whole = F.sum("_v").over(by_time().rowsBetween(0, k)) == k + 1
        return F.coalesce(whole & (F.lead(segment, k).over(by_time()) == F.col(segment)), F.lit(False))

    rows = rows.withColumns({"valid_target": open_path(horizon), "valid_maturity": open_path(maturity)})
    target = F.when(F.col("valid_target"), F.lead("close", horizon).over(by_time()) / F.col("close") - 1)
    return rows.withColumns({"target": target, "matures": F.when(F.col("valid_maturity"), F.lead("session", maturity).over(by_time()))}).drop("_v")
