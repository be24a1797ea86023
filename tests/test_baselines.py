"""Weekly orders, metrics of runs, nested means, trials and reliability over seeds against pandas and numpy."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retroscope.operators import baselines


@pytest.fixture(scope="module")
def weeks(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"week": np.repeat(range(6), 9), "key": list(range(9)) * 6, "a": rng.integers(0, 4, 54).astype(float), "b": rng.normal(size=54), "y": rng.normal(size=54)})
    frame.loc[::7, "a"] = None
    frame.loc[frame.week == 4, "b"] = None
    frame.loc[(frame.week == 5) & (frame.key > 1), "y"] = None  # two outcomes: no row
    rows = spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in frame.astype({"week": int, "key": int}).itertuples(index=False)], "week int, key int, a double, b double, y double")
    return frame, rows.repartition(3)


def test_weekly_order(weeks):
    frame, rows = weeks
    got = baselines.weekly_order(rows, "week", "key", ["a", "b"], "y", (2, 20)).toPandas().set_index(["week", "score"])
    assert set(got.index) == {(w, s) for w in range(5) for s in "ab"}
    for (week, score), r in got.iterrows():
        own = frame[(frame.week == week) & frame.y.notna()]
        assert r.securities == len(own) and np.isclose(r.every, own.y.mean())
        best = own[own[score].notna()].sort_values([score, "key"], ascending=[False, True])
        if len(best) < 2:
            assert np.isnan(r.best2) and np.isnan(r.spearman)
            continue
        assert np.isclose(r.best2, best.y[:2].mean()) and np.isclose(r.best20, best.y.mean())
        assert np.isclose(r.spearman, best[score].rank().corr(best.y.rank()))


def test_order_summary_ties_go_to_the_first_name(spark):
    rows = spark.createDataFrame([(1, "b", 0.5, 1.0, 0.0), (1, "a", None, 1.0, 0.0), (2, "a", 0.25, 1.0, 1.0), (1, "c", None, None, 1.0)], "week int, score string, spearman double, best5 double, every double")
    got = {r.score: r for r in baselines.order_summary(rows, (5,)).collect()}
    assert got["a"].first5 and not got["b"].first5 and not got["c"].first5
    assert (got["a"].weeks, got["a"].spearman, got["a"].every) == (2, 0.25, 0.5)


def test_head_is_a_ridge(spark):
    x = np.random.default_rng(2).normal(size=(60, 2))
    y = 1 + x @ [2, -1]
    rows = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)] + [(None, 1.0, 2.0), (1.0, 1.0, None)], "a double, b double, y double")
    full = np.column_stack([np.ones(60), x])
    want = np.linalg.solve(full.T @ full + np.diag([0, 3.0, 3.0]), full.T @ y)
    assert np.allclose(baselines.head(rows, ["a", "b"], "y", 3.0), want)
    assert np.array_equal(baselines.head(rows.limit(0), ["a", "b"], "y"), np.zeros(3))


def test_run_metrics_and_nested_means(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame([("x" if a else "z", m, s, t, rng.normal() / 50) for a in range(2) for m in "pq" for s in range(2 + a) for t in range(30)], columns=["arm", "market", "seed", "session", "v"])
    frame.loc[(frame.arm == "z") & (frame.market == "q"), "v"] = 0.01
    runs = baselines.run_metrics(spark.createDataFrame(frame), ["arm", "market", "seed"], "v")
    want = []
    for key, own in frame.groupby(["arm", "market", "seed"]):
        level = (1 + own.v).cumprod()
        flat = own.v.std(ddof=0) <= 1e-8
        want.append((*key, 30, 0 if flat else own.v.mean() / (own.v.std(ddof=0) + 1e-9) * 252**0.5, np.log(level.iloc[-1]) * 252 / 30, (level / level.cummax() - 1).min(), (own.v > 0).mean()))
    want = pd.DataFrame(want, columns=["arm", "market", "seed", "sessions", "sharpe", "growth", "drawdown", "win_rate"])
    got = runs.toPandas().sort_values(["arm", "market", "seed"])
    assert np.allclose(got[want.columns[3:]], want[want.columns[3:]])
    nested = baselines.nested_means(runs, ["arm"], "market", "seed", ["sharpe", "growth"], "growth").toPandas().set_index("arm")
    for arm, own in want.groupby("arm"):
        assert np.isclose(nested.sharpe[arm], own.groupby("market").sharpe.mean().mean())
        assert np.isclose(nested.dispersion[arm], own.groupby("seed").growth.mean().std())
        assert (nested.realizations[arm], nested.markets[arm]) == (len(own), 2)


def test_trials(spark):
    rows = spark.createDataFrame([(s, k) for s in range(3) for k in range(7)], "session int, key int")
    got = {(r.trial, r.session, r.key) for r in baselines.random_trials(rows, "session", "key", 2, 4).collect()}
    draw = lambda t, s, k: hashlib.sha256(f"{t}:{k}:{s}".encode()).hexdigest()
    assert got == {(t, s, k) for t in range(4) for s in range(3) for k in sorted(range(7), key=lambda k: draw(t, s, k))[-2:]}
    trials = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 2, 5, 2])], "trial int, sharpe double")
    one = baselines.trial_summary(trials, spark.createDataFrame([(2.0,)], "sharpe double")).first()
    assert (one.trial, one.sharpe) == (2, 2.0) and np.isclose(one.beating, 0.8) and np.isclose([one.sharpe_p05, one.sharpe_p95], np.quantile([3, 1, 2, 5, 2], [0.05, 0.95])).all()


@pytest.mark.parametrize("spare", [32, -7])
def test_trials_pick_from_all_rows_of_large_sessions(spark, spare):
    """All rows of all trials are never laid out; with few spare hashes many sessions are picked a second time."""
    rows = spark.createDataFrame([(s, k) for s, size in enumerate((3000, 700, 1)) for k in range(size)], "session int, key int").repartition(3)
    out = baselines.random_trials(rows, "session", "key", 2, 5, spare=spare)
    got = {(r.trial, r.session, r.key) for r in out.collect()}
    draw = lambda t, s, k: hashlib.sha256(f"{t}:{k}:{s}".encode()).hexdigest()
    assert got == {(t, s, k) for t in range(5) for s, size in enumerate((3000, 700, 1)) for k in sorted(range(size), key=lambda k: draw(t, s, k))[-2:]}
    if spare == 32:
        assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_reliability_frame(spark):
    signals = [(1, 10, "a", 0.2, 0.1, 0.3, True), (1, 10, "b", 0.4, 0.1, 0.5, False), (1, 11, "a", -0.1, -0.3, 0.1, True), (2, 10, "a", 0.1, 0.05, 0.2, False), (2, 10, "b", 0.1, 0.05, 0.2, False)]
    outcomes = spark.createDataFrame([(1, 10, 0.4), (1, 11, 0.05)], "session int, security int, future double")
    frame = baselines.reliability_frame(spark.createDataFrame(signals, "session int, security int, seed string, score double, low double, high double, ok boolean"), ["session", "security"], "session", ["score", "low", "high"], "score", "low", "high", "score", outcomes, "future", 0.002, "ok")
    got = {(r.session, r.security): r for r in frame.collect()}
    a, b, c = got[1, 10], got[1, 11], got[2, 10]
    assert (a.seeds, b.seeds, a.breadth, b.breadth, c.breadth) == (2, 1, 0.5, 0.5, 0.0)  # the last one's seeds don't pass
    assert np.isclose([a.score, a.score_spread, a.width, a.dispersion, a.error], [0.3, 0.1, 0.3, np.std([0.3, -0.1], ddof=1), 0.1]).all()
    assert (a.direction_correct, a.useful, a.covered) == (1, 1, 1) and (b.direction_correct, b.useful, b.covered) == (0, 1, 1)  # 0.4 is the mean interval's end
    assert c.dispersion == 0 and (c.error, c.covered, c.useful, c.direction_correct) == (None,) * 4


def test_empty(spark):
    rows = spark.createDataFrame([], "week int, key int, session int, a double, y double, market string, seed int, arm string")
    assert baselines.weekly_order(rows, "week", "key", ["a"], "y", (5,)).count() == 0
    runs = baselines.run_metrics(rows, ["arm", "market", "seed"], "y")
    assert baselines.nested_means(runs, ["arm"], "market", "seed", ["sharpe"], "growth").count() == 0
    assert baselines.picked(rows, ["session"], F.col("a"), "key", 2).count() == 0
