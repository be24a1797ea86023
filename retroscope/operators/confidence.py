"""Evidence summaries: weights of neighbors, confidence, scores, rejections, and what predictions are mixed of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _own():
    return Window.partitionBy("query_id")


def distance_weights(neighbors: DataFrame) -> DataFrame:
    """neighbors with gaussian, inverse and uniform: weights of the distance that add up to 1 per query."""
    rows = neighbors.withColumn("_d", F.greatest(F.sqrt("distance"), F.lit(1e-9)))
    band = F.greatest(F.median("_d").over(_own()), F.lit(1e-9))
    rows = rows.withColumns({"_g": F.exp(-0.5 * F.pow(F.col("_d") / band, F.lit(2))), "_i": 1 / F.col("_d")})
    share = lambda c: F.col(c) / F.sum(c).over(_own())
    return rows.withColumns({"gaussian": share("_g"), "inverse": share("_i"), "uniform": 1 / F.count("*").over(_own())}).drop("_d", "_g", "_i")


def _entropy(p: str, n: Column) -> Column:
    return F.when(n > 1, -F.sum(F.when(F.col(p) > 0, F.col(p) * F.log2(p)).otherwise(0.0)) / F.log2(n)).otherwise(0.0)


def summaries(weighted: DataFrame, weight: str = "gaussian", least_size: float = 5.0) -> DataFrame:
    """Per query, of neighbors (query_id, record_id, security, distance, upside, downside, path, the weight): weighted
    means, deviations, interval, tails, and a confidence from agreement, density, diversity and effective size."""
    w = F.col(weight)
    mean = lambda c: F.sum(w * F.col(c))
    own = _own()
    rows = weighted.withColumns({"_m": F.sum(w * F.col("upside")).over(own), "_n": F.count("*").over(own), "_up": F.row_number().over(own.orderBy("downside", "record_id"))})
    labels = weighted.groupBy("query_id", "security").agg(F.count("*").alias("_c")).withColumn("_p", F.col("_c") / F.sum("_c").over(own))
    labels = labels.groupBy("query_id").agg(_entropy("_p", F.count("*")).alias("diversity"))
    out = rows.groupBy("query_id").agg(
        F.count("*").alias("neighbors"),
        mean("upside").alias("expected"),
        mean("downside").alias("expected_downside"),
        mean("path").alias("expected_path"),
        F.sqrt(F.sum(w * F.pow(F.col("upside") - F.col("_m"), F.lit(2)))).alias("deviation"),
        (1 / F.sum(w * w)).alias("effective_size"),
        F.percentile("upside", 0.1).alias("p10"),
        F.avg(F.when(F.col("_up") <= F.ceil(F.col("_n") * 0.25), F.col("downside"))).alias("tail"),
        F.abs(2 * F.sum(F.when(F.col("upside") > 0, w).otherwise(0.0)) - 1).alias("agreement"),
        F.median(F.sqrt("distance")).alias("median_distance"),
        _entropy(weight, F.count(F.when(w > 0, 1))).alias("weight_entropy"),
    ).join(labels, "query_id")
    size = F.least(F.lit(1.0), F.col("effective_size") / least_size)
    density = 1 / (1 + F.col("median_distance"))
    confidence = 0.35 * F.col("agreement") + 0.25 * density + 0.20 * F.col("diversity") + 0.20 * size
    low = F.col("expected") - 1.96 * F.col("deviation") / F.sqrt(F.greatest("effective_size", F.lit(1.0)))
    return out.withColumns({"disagreement": 1 - F.col("agreement"), "density": density, "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), "ci_low": low})


def scores(found: DataFrame) -> DataFrame:
    """summaries with the opportunity's quality and the three score modes."""
    c = F.col
    loss = F.abs(F.coalesce(F.nullif(c("tail"), F.lit(0.0)), c("expected_downside")))
    return found.withColumns({
        "quality": (c("expected") - F.abs("expected_downside")) * (0.5 + 0.5 * c("confidence")) + 0.05 * c("expected_path"),
        "legacy": c("expected") + 0.10 * c("expected_path") - 0.80 * F.abs("expected_downside") - 0.20 * c("deviation") + 0.10 * c("confidence") - 0.10 * c("disagreement"),
        "alpha_lcb": c("expected") + 0.50 * c("ci_low") - 0.50 * loss - 0.25 * c("deviation") + 0.01 * c("expected_path"),
        "alpha_predictive_tail": 0.50 * c("expected") + 0.50 * c("p10") - 0.35 * loss - 0.15 * c("deviation") + 0.01 * c("expected_path"),
    })


def with_rejections(queries: DataFrame, found: DataFrame, least: int, limit: float) -> DataFrame:
    """One row per query: its evidence, or nulls and why: fewer than `least` neighbors, or a median distance over limit."""
    rows = queries.select("query_id").join(found, "query_id", "left")
    few = F.coalesce(F.col("neighbors"), F.lit(0)) < least
    status = F.when(few, "insufficient_neighbors").when(F.col("median_distance") > limit, "out_of_distribution").otherwise("ok")
    rows = rows.withColumn("status", status).withColumn("neighbors", F.coalesce(F.col("neighbors"), F.lit(0)))
    kept = {c: F.when(F.col("status") == "ok", F.col(c)) for c in rows.columns if c not in ("query_id", "status", "neighbors")}
    return rows.withColumns(kept)


def softmax_weights(neighbors: DataFrame, similarity: Column, temperature: float) -> DataFrame:
    """neighbors with `softmax`, of similarity over temperature, per query."""
    rows = neighbors.withColumn("_s", similarity)
    rows = rows.withColumn("_e", F.exp((F.col("_s") - F.max("_s").over(_own())) / temperature))
    return rows.withColumn("softmax", F.col("_e") / (F.sum("_e").over(_own()) + 1e-12)).drop("_s", "_e")


def hybrid(base: Column, memory: Column, share: float) -> Column:
    """(1 - share) of base and share of memory; base alone where memory has nothing."""
    return F.when(memory.isNull(), base).otherwise((1 - share) * base + share * memory)


def trust_gate(base: Column, memory: Column, centre: tuple[float, float, float], scale: tuple[float, float, float], slope: tuple[float, float, float], shift: float) -> Column:
    """Logistic trust in memory, from the standardized sizes of base, of their difference and of memory."""
    sizes = F.abs(base), F.abs(base - memory), F.abs(memory)
    total = sum(((x - c) / s * a for x, c, s, a in zip(sizes, centre, scale, slope, strict=True)), F.lit(shift))
    return 1 / (1 + F.exp(-total))


def mixture(rows: DataFrame, shares: list[float], market: str) -> DataFrame:
    """share, error (mean over markets of the mean squared error of the hybrid), chosen: the least error, then share.

    rows: base, memory, actual and the market column.
    """
    grid = rows.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    error = F.pow((1 - F.col("share")) * F.col("base") + F.col("share") * F.col("memory") - F.col("actual"), F.lit(2))
    by = grid.groupBy("share", market).agg(F.avg(error).alias("e")).groupBy("share").agg(F.round(F.avg("e"), 12).alias("error"))
    best = by.agg(F.min(F.struct("error", "share")).alias("b"))
    return by.crossJoin(F.broadcast(best)).select("share", "error", (F.col("share") == F.col("b.share")).alias("chosen"))
