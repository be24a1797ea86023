"""How two scores order the securities of a session, against all pairs."""

import numpy as np
import pytest

from retroscope.operators import ranking


def signs(x, y):
    return sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i))


@pytest.mark.parametrize("values", [1, 2, 5, 10_000])
def test_pairs_in_order_are_counted_from_sorts(values):
    rng = np.random.default_rng(values)
    sizes = [0, 1, 2, 60, 0, 33, 3]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    x, y = (rng.integers(-values, values, cuts[-1]).astype(float) for _ in "xy")
    x[cuts[3] : cuts[3] + 5] = -0.0
    assert ranking._concord(cuts, x, y).tolist() == [signs(x[a:b], y[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    x[1] = np.inf
    assert np.isnan(ranking._concord(cuts, x, y)).tolist() == [False, False, True, False, False, False, False]


def test_agreement_of_a_large_session(spark):
    """Kendall without walking through the pairs of a session; a session that lacks a score has none."""
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 300, 1500).astype(float), rng.normal(size=1500)
    rows = [("m", 1, i, float(p), float(q)) for i, (p, q) in enumerate(zip(a, b, strict=True))] + [("m", 2, i, float(i), float(-i)) for i in range(4)] + [("m", 3, i, None if i else 1.0, 2.0) for i in range(3)] + [("m", 4, 1, 1.0, 1.0)]
    out = ranking.agreement(spark.createDataFrame(rows, "market string, session int, security int, a double, b double").repartition(3), "a", "b")
    assert "signum" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = out.first()
    large = (np.sign(a[:, None] - a) * np.sign(b[:, None] - b)).sum() / (1500 * 1499)
    assert (got.sessions, len(out.collect())) == (3, 1) and np.isclose(got.kendall, (large - 1) / 2)
