"""The fitted projection: slopes against differences, steps against plain Python, principal directions against a decomposition."""

import numpy as np
import pytest

from retroscope.operators import metric

SIZE, RANK, NEAR = 6, 2, 5


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(3)
    return [(i, rng.normal(size=SIZE), rng.normal(size=3), rng.normal(size=(NEAR, SIZE)), rng.normal(size=(NEAR, 3))) for i in range(12)]


@pytest.fixture(scope="module")
def rows(spark, made):
    whole = [(i, *(x.tolist() for x in r)) for i, *r in made]
    return spark.createDataFrame(whole, "query_id int, vector array<double>, own array<double>, near array<array<double>>, theirs array<array<double>>").repartition(3).cache()


def start():
    return np.random.default_rng(4).normal(size=(SIZE, RANK))


def test_slope_is_the_limit_of_differences(made):
    p = start()
    for _, *example in made[:4]:
        _, slope = metric.low_rank_loss(p, *example, 0.5, 0.1, 0.2)
        for at in np.ndindex(p.shape):
            up, down = p.copy(), p.copy()
            up[at] += 1e-6
            down[at] -= 1e-6
            by = (metric.low_rank_loss(up, *example, 0.5, 0.1, 0.2)[0] - metric.low_rank_loss(down, *example, 0.5, 0.1, 0.2)[0]) / 2e-6
            assert abs(by - slope[at]) < 1e-5


def test_steps_equal_plain_adam(rows, made):
    fitted = metric.fit_low_rank(rows, start(), 4, 0.05, 0.5, 0.1, 0.2, 0.01, 0.5)
    p, m, v, losses = start(), 0.0, 0.0, []
    for step in range(1, 5):
        got = [metric.low_rank_loss(p, *example, 0.5, 0.1, 0.2) for _, *example in made]
        losses.append(np.mean([x for x, _ in got]))
        g = np.mean([s for _, s in got], axis=0)
        g = g * min(1.0, 0.5 / (np.linalg.norm(g) + 1e-6)) + 0.01 * p
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(fitted.weights, p) and np.allclose(fitted.losses, losses)


def test_many_steps_lower_the_loss(rows):
    losses = metric.fit_low_rank(rows, start(), 15).losses
    assert losses[-1] < losses[0]


def test_no_query_leaves_the_start(rows):
    fitted = metric.fit_low_rank(rows.limit(0), start(), 3)
    assert np.array_equal(fitted.weights, start()) and fitted.losses == []


def test_projected_to_nothing_is_finite(made):
    loss, slope = metric.low_rank_loss(np.zeros((SIZE, RANK)), *made[0][1:], 0.5, 0.1, 0.1)
    assert np.isfinite(loss) and np.isfinite(slope).all()


def test_principal_directions(spark):
    x = np.random.default_rng(5).normal(size=(200, SIZE)) * [5, 1, 3, 0.5, 0.2, 2]
    rows = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "x array<float>").repartition(3)
    got = metric.principal(rows, "x", SIZE, 3)
    want = np.linalg.svd(x, full_matrices=False)[2][:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-4) and (np.abs(got).max(axis=0) == got.max(axis=0)).all()
    assert not np.isnan(metric.principal(rows.limit(0), "x", SIZE, 3)).any()
