"""Diagnostics against plain Python on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from retroscope.operators import diagnostics, resampling


def test_regret_of_a_session(spark):
    rows = [("d", 1, 0.3, 0.5), ("d", 2, -0.2, 0.9), ("d", 3, 0.1, None), ("d", 4, 0.0, -0.4), ("d", 5, 0.2, 0.5), ("e", 1, 1.0, -0.1)]
    got = {r.session: r for r in diagnostics.regret(spark.createDataFrame(rows, "session string, security int, s double, u double"), "s", "u", 2, 0.5, 0.05).collect()}

    def one(pairs, k=2, t=0.5, cash=0.05):
        e = [math.exp(x / t) for x in [cash, *(s for s, _ in pairs)]]
        p = [x / sum(e) for x in e]
        best = sorted((i for i, (_, u) in enumerate(pairs) if u > 0), key=lambda i: -pairs[i][1])[:k]
        want = min(1.0, sum(u > 0 for _, u in pairs) / k)
        w = [math.exp(pairs[i][1] / t) for i in best]
        target = [1 - want] + [0.0] * len(pairs)
        for i, x in zip(best, w, strict=True):
            target[i + 1] = want * x / sum(w)
        loss = -sum(a * math.log(b) for a, b in zip(target, p, strict=True))
        return 1 - p[0], want, loss, (1 - p[0] - want) ** 2, max(0.0, sum((a - b) * u for a, b, (_, u) in zip(target[1:], p[1:], pairs, strict=True)))

    for d, pairs in {"d": [(0.3, 0.5), (-0.2, 0.9), (0.0, -0.4), (0.2, 0.5)], "e": [(1.0, -0.1)]}.items():
        r = got[d]
        assert np.allclose([r.exposure, r.wanted, r.allocation_loss, r.coverage_error, r.regret], one(pairs))


@pytest.mark.parametrize("n, block", [(10, 3), (12, 4), (5, 9), (7, 1)])
def test_blocks_by_sums_equal_blocks_of_rows(spark, n, block):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(2, n))
    series = spark.createDataFrame([(i, float(x), float(y), n) for i, (x, y) in enumerate(zip(a, b, strict=True))], "position bigint, a double, b double, n bigint")
    size = min(block, n)
    starts = {(r.draw, r.place): r.s for r in spark.range(8).withColumnRenamed("id", "draw").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(-(-n // size) - 1)))).withColumn("s", resampling.hashed(F.lit(n - size + 1), F.lit("z"), "draw", "place")).collect()}
    sharpe = lambda v: np.mean(v) / np.std(v, ddof=1) * 252**0.5
    for r in resampling.moving_block_pairs(series, block, 8, "z").collect():
        at = np.arange(n) if r.draw is None else np.concatenate([starts[r.draw, p] + np.arange(size) for p in range(-(-n // size))])[:n]
        want = sharpe(a[at]) - sharpe(b[at]) if np.std(a[at]) > 1e-9 and np.std(b[at]) > 1e-9 else None
        assert np.isclose(r.annualized_return, (a[at].mean() - b[at].mean()) * 252)
        assert want is None or np.isclose(r.sharpe, want)


def test_account_metrics_count_the_initial_capital(spark):
    days = [("x", 1, 90.0, 50.0, 45.0), ("x", 2, 99.0, -20.0, 0.0), ("y", 1, 10.0, 0.0, 0.0), ("y", 2, -1.0, 0.0, 0.0)]
    got = {r.k: r for r in diagnostics.account_metrics(spark.createDataFrame(days, "k string, session int, equity double, traded double, held double"), "k", 100.0).collect()}
    r = np.array([-0.1, 0.1])
    x = got["x"]
    assert np.allclose([x.annual_return, x.volatility, x.sharpe, x.max_drawdown, x.win_rate, x.turnover, x.exposure], [np.expm1(252 * np.log1p(r).mean()), r.std() * 252**0.5, r.mean() / r.std() * 252**0.5, -0.1, 0.5, 252 / 2 * 70 / (2 * 94.5), 0.25])
    assert got["y"].sharpe is None and got["y"].sessions == 2


def test_short_histories_have_no_valid_rows(spark):
    rng = np.random.default_rng(1)
    bars = [(s, i, *(float(x) for x in (p + 1, p - 1, p)), float(v)) for s, n in ((1, 300), (2, 100), (3, 1)) for i, (p, v) in enumerate(zip(50 + rng.random(n), rng.integers(0, 3, n), strict=True))]
    rows = diagnostics.contract_features(spark.createDataFrame(bars, "security bigint, session int, high double, low double, close double, volume double"))
    got = {r.security: (r.v, r.n) for r in rows.groupBy("security").agg(F.sum("valid").alias("v"), F.count("return_1").alias("n")).collect()}
    assert got == {1: (49, 299), 2: (0, 99), 3: (0, 0)}
    again = rows.where("security = 1 and volume_change_1 is null").count()
    assert again == 1  # a volume of 0 before gives 0


def test_classes_without_predictions_count_as_missed(spark):
    rows = spark.createDataFrame([(0, 0, 0.1, 0.2), (1, 0, 0.2, 0.1), (1, 1, 0.9, 0.0), (2, 1, 0.3, 0.3), (None, 2, 0.0, 0.0)], "actual int, predicted int, rise_1 double, fall_1 double")
    r = diagnostics.class_quality(rows, 1).first()
    recall, f1 = [1, 0.5, 0], [2 * 0.5 / 1.5, 0.5, 0]
    brier = np.mean([(0.1**2 + 0.2**2) / 2, (0.8**2 + 0.1**2) / 2, (0.1**2 + 0) / 2, (0.3**2 + 0.7**2) / 2])
    assert r.rows == 4 and np.allclose([r.accuracy, r.balanced_accuracy, r.macro_f1, r.brier, r.violations, r.bucket_error], [0.5, np.mean(recall), np.mean(f1), brier, 0, np.mean([1, 0, 0])])


def test_gates_and_central_values(spark):
    rows = diagnostics.central_only(spark.createDataFrame([(1, 0.05), (2, -0.2), (3, None)], "query_id int, expected double"))
    got = rows.withColumns({"p": diagnostics.admitted(rows, diagnostics.GATES), "n": diagnostics.admitted(rows, diagnostics.NEUTRAL)}).orderBy("query_id").collect()
    assert [(r.upside, r.downside, r.p, r.n) for r in got[:2]] == [(0.05, 0.0, True, True), (0.0, -0.2, False, False)]
    assert not got[2].p and not got[2].n


def test_entries_link_to_the_last_trade_of_the_day(spark):
    made = spark.createDataFrame([(1, "a", "enter"), (1, "b", "skip"), (2, "a", "enter")], "session int, security string, decision string")
    trades = spark.createDataFrame([(7, 1, "a", 5, 0.1, False), (8, 1, "a", 2, 0.2, False), (9, 1, "a", 2, 0.3, True), (4, 1, "b", 2, 0.2, False)], "trade_id int, entry int, security string, held int, realized double, rebalance boolean")
    got = {(r.session, r.security): (r.trade_id, r.lasted) for r in diagnostics.linked_back(made, trades, 3).collect()}
    assert got == {(1, "a"): (8, False), (1, "b"): (None, None), (2, "a"): (None, None)}
