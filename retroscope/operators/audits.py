"""Counts of rows that break the rules of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval_audit(neighbors: DataFrame, queries: DataFrame, memory: DataFrame, spacing: int = 21) -> DataFrame:
    """rule, rows, violations: records known only after the query, records of its own security (blanks and case
    aside), records of a security less than `spacing` ordinals after another.

    neighbors: query_id, record_id, security. A record without an availability counts as immature.
    """
    own = queries.select("query_id", F.col("security").alias("_own"), "at")
    known = memory.select("record_id", "ordinal", "available")
    rows = neighbors.select("query_id", "record_id", "security").join(own, "query_id").join(known, "record_id")
    name = lambda x: F.upper(F.trim(F.col(x).cast("string")))
    gap = F.col("ordinal") - F.lag("ordinal", 1).over(Window.partitionBy("query_id", "security").orderBy("ordinal", "record_id"))
    rows = rows.withColumn("_gap", gap)
    rules = {"maturity": F.coalesce(F.col("available") > F.col("at"), F.lit(True)), "own_security": name("security") == name("_own"), "separation": F.coalesce(F.col("_gap") < spacing, F.lit(False))}
    judged = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), test.alias("broken")) for k, test in rules.items()))).alias("x"))
    return judged.groupBy("x.rule").agg(F.count("*").alias("rows"), F.count_if("x.broken").alias("violations"))


def _rule(name: str, rows: DataFrame, broken: F.Column) -> DataFrame:
    return rows.agg(F.lit(name).alias("rule"), F.count("*").alias("evaluated"), F.coalesce(F.sum(F.coalesce(broken, F.lit(False)).cast("bigint")), F.lit(0)).alias("violations"))


def weights(neighbors: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Queries whose weights are negative, not finite, or don't add up to 1."""
    sums = neighbors.groupBy("query_id").agg(F.sum("weight").alias("_s"), F.min("weight").alias("_low"))
    return _rule("weights", sums, F.col("_s").isNull() | F.isnan("_s") | (F.abs(F.col("_s") - 1) >= tolerance) | (F.col("_low") < 0))


def fills(rows: DataFrame) -> DataFrame:
    """Fills (filled) that are not after their signal (session)."""
    return _rule("fill_after_signal", rows, F.col("filled") <= F.col("session"))


def maturity(rows: DataFrame, cutoff: F.Column) -> DataFrame:
    """Labels that are not known (available) by the cut-off."""
    return _rule("label_maturity", rows, F.col("available").isNull() | (F.col("available") > cutoff))


def isolation(train: DataFrame, fitted: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Sessions that a scaler was fitted on and that are no training sessions, or that are evaluated."""
    outside = fitted.join(train, "session", "left_anti").agg(F.count("*").alias("_a"))
    shared = fitted.join(evaluated, "session", "left_semi").agg(F.count("*").alias("_b"))
    total = fitted.agg(F.count("*").alias("evaluated"))
    return total.crossJoin(outside).crossJoin(shared).select(F.lit("scaler_isolation").alias("rule"), "evaluated", (F.col("_a") + F.col("_b")).alias("violations"))


def grid(expected: DataFrame, there: DataFrame) -> DataFrame:
    """Expected cells without a row."""
    keys = expected.columns
    rows = expected.join(there.select(*keys).distinct().withColumn("_there", F.lit(True)), keys, "left")
    return _rule("expected_grid", rows, F.col("_there").isNull())


def reconciled(expected: DataFrame, coverage: DataFrame, exclusions: DataFrame, forecasts: DataFrame, permitted: list[str]) -> DataFrame:
    """rule, the keys of expected, found, wanted, broken: every rule of every account that is expected or reported.

    expected: the accounts' keys. coverage: keys, candidates, decisions, admitted, expected, stated (the sum of its forecasts).
    exclusions: keys, reason, excluded. forecasts: keys, id, value. An account is reported once and only where expected; it decides
    on every candidate; candidates are admitted or excluded for a permitted reason; forecasts are expected for what is
    admitted, there once each, and add up to what is stated. Both sides are counted apart and compared in one
    full outer join.
    """
    keys = expected.columns
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    told = coverage.groupBy(*keys).agg(F.count("*").alias("_reports"), *(F.max(c).alias(c) for c in ("candidates", "decisions", "admitted", "expected", "stated")))
    left_out = exclusions.groupBy(*keys).agg(F.sum("excluded").alias("_excluded"), F.coalesce(F.sum(F.when(~F.col("reason").isin(permitted) | F.col("reason").isNull(), F.col("excluded"))), F.lit(0)).alias("_forbidden"))
    made = forecasts.groupBy(*keys, "id").agg(F.count("*").alias("_n"), F.max("value").alias("value")).groupBy(*keys).agg(F.count("*").alias("_sealed"), F.sum(F.col("_n") - 1).alias("_again"), F.sum("value").alias("_sum"))
    rows = expected.distinct().withColumn("_wanted", F.lit(1)).join(told, keys, "full").join(left_out, keys, "full").join(made, keys, "full")
    near = F.abs(F.coalesce("_sum", F.lit(0.0)) - F.coalesce("stated", F.lit(0.0))) <= 1e-6 * (1 + F.abs(F.coalesce("stated", F.lit(0.0))))
    number = lambda c: c.cast("double")
    rules = [
        ("reports", zero("_reports"), zero("_wanted"), None), ("decisions", zero("decisions"), zero("candidates"), None), ("candidates", zero("admitted") + zero("_excluded"), zero("candidates"), None), ("forbidden_reasons", zero("_forbidden"), F.lit(0), None),
        ("expected", zero("expected"), zero("admitted"), None), ("sealed", zero("_sealed"), zero("expected"), None), ("repeated_forecasts", zero("_again"), F.lit(0), None), ("forecast_sum", F.coalesce("_sum", F.lit(0.0)), F.coalesce("stated", F.lit(0.0)), ~near),
    ]
    judged = F.array(*(F.struct(F.lit(name).alias("rule"), number(a).alias("found"), number(b).alias("wanted"), (a != b if broken is None else broken).alias("broken")) for name, a, b, broken in rules))
    return rows.select(*keys, F.explode(judged).alias("x")).select("x.rule", *keys, "x.found", "x.wanted", "x.broken")


def sealed(labels: DataFrame, expected: DataFrame, predictions: DataFrame, keys: list[str], key: str = "id") -> DataFrame:
    """The labels of those groups (keys) in which every expected id has a prediction; no row of any other group.

    labels, expected and predictions hold keys and the id. What is missing is found by an anti-join, so no list of ids is
    gathered; a group without expected ids stays sealed.
    """
    missing = expected.select(*keys, key).distinct().join(predictions.where("prediction is not null").select(*keys, key).distinct(), [*keys, key], "left_anti").select(*keys).distinct()
    complete = expected.select(*keys).distinct().join(missing, keys, "left_anti")
    return labels.join(complete, keys, "left_semi")
