"""Fitted models against optimality conditions, plain Python and missing values; clusters against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from retroscope.operators import decisions, models, states

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = 0.5 + x @ [1.5, -2.0] + rng.normal(size=400) * 0.3
    y[::17] += 25
    return spark.createDataFrame([(float(a), float(b), float(v), i % 4) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))], "a double, b double, y double, fold int").repartition(3).cache()


def matrix(rows):
    t = rows.toPandas()
    return np.column_stack([np.ones(len(t)), t[["a", "b"]]]), t["y"].to_numpy(), t["fold"].to_numpy()


def test_logistic_is_stationary(rows):
    w = models.logistic(rows, FEATURES, F.col("y") > 0, F.lit(2.0), 3.0, 12)
    x, y, _ = matrix(rows)
    p = 1 / (1 + np.exp(-x @ w))
    slope = x.T @ (2 * (p - (y > 0))) + 3.0 * w * [0, 1, 1]
    assert np.abs(slope).max() < 1e-6


def test_huber_is_stationary_in_weights_and_scale(rows):
    w, scale = models.huber(rows, FEATURES, "y", 1.0, 1.35, 60)
    x, y, _ = matrix(rows)
    z = (y - x @ w) / scale
    out = np.abs(z) > 1.35
    assert 10 < out.sum() < 200
    slope = -2 * x.T @ np.where(out, 1.35 * np.sign(z), z) + 2 * w * [0, 1, 1]
    assert np.abs(slope).max() < 1e-4
    assert abs(len(y) - (z[~out] ** 2).sum() - 1.35**2 * out.sum()) < 1e-3
    assert np.abs(w - [0.5, 1.5, -2.0]).max() < 0.15  # outliers hardly count


def test_fold_scores_leave_the_own_fold_out(rows):
    got = models.fold_scores(rows, FEATURES, {"up": F.col("y") > 0, "far": F.col("y") > 3}, "fold", 2.0).toPandas()
    x, y, fold = matrix(rows)
    for k, cut in enumerate((0, 3)):
        want = np.empty(len(y))
        for f in range(4):
            own = fold != f
            w = np.linalg.solve(x[own].T @ x[own] + np.diag([0, 2.0, 2.0]), x[own].T @ (y[own] > cut))
            want[fold == f] = x[fold == f] @ w
        assert np.allclose([s[k] for s in got["scores"]], want)


def test_added_fit(rows):
    r = models.added_fit(rows.withColumn("one", F.lit("x")), "one", ["a"], "b", "y", 1e-9).first()
    x, y, _ = matrix(rows)
    fit = lambda m: 1 - ((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert r.rows == 400 and np.allclose([r.base_r2, r.full_r2, r.added_r2], [fit(x[:, :2]), fit(x), fit(x) - fit(x[:, :2])])


def plain_trees(x, y, trees, depth, bins, rate, least, ridge):
    place = np.column_stack([[(np.quantile(col[~np.isnan(col)], [i / bins for i in range(1, bins)]) < v).sum() if v == v else 0 for v in col] for col in x.T])
    pred = np.full(len(y), y.mean())
    for _ in range(trees):
        r, node = y - pred, np.zeros(len(y), int)
        for _ in range(depth):
            after = node * 2
            for k in np.unique(node):
                own, best = node == k, None
                for f, b in itertools.product(range(x.shape[1]), range(bins)):
                    left = own & (place[:, f] <= b)
                    n, m = left.sum(), own.sum()
                    if n < least or m - n < least:
                        continue
                    gain = r[left].sum() ** 2 / (n + ridge) + r[own & ~left].sum() ** 2 / (m - n + ridge) - r[own].sum() ** 2 / (m + ridge)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, b
                if best:
                    after += own & (place[:, best[1]] > best[2])
            node = after
        for k in np.unique(node):
            pred[node == k] += rate * r[node == k].sum() / ((node == k).sum() + ridge)
    return pred


@pytest.mark.parametrize("depth, least", [(2, 20), (3, 5), (2, 300)])
def test_boosted_trees_equal_plain_ones(spark, rows, depth, least):
    some = rows.withColumns({"b": F.when(F.col("fold") == 3, None).otherwise(F.col("b")), "k": F.monotonically_increasing_id()})
    some = spark.createDataFrame(some.toPandas().where(lambda t: t.notna(), None), "a double, b double, y double, fold int, k long")
    some = some.withColumn("b", F.when(F.isnan("b"), None).otherwise(F.col("b")))
    _, got = models.boosted(some, FEATURES, "y", 4, depth, 8, 0.3, least, 1.0, store_every=2)
    t = got.orderBy("k").toPandas()
    want = plain_trees(t[["a", "b"]].to_numpy(float), t["y"].to_numpy(), 4, depth, 8, 0.3, least, 1.0)
    assert np.allclose(t["prediction"], want)


def test_monotone_blocks_equal_the_least_of_largest_means(spark):
    rng = np.random.default_rng(2)
    mean, weight = rng.normal(size=30).round(1), rng.integers(1, 9, 30)
    points = spark.createDataFrame([(i - 5, float(m), int(w)) for i, (m, w) in enumerate(zip(mean, weight, strict=True))], "bin int, mean double, weight bigint").repartition(4)
    got = {r.bin: r.value for r in decisions.monotone_blocks(points).collect()}
    average = lambda a, b: (mean[a : b + 1] * weight[a : b + 1]).sum() / weight[a : b + 1].sum()
    for i in range(30):
        assert np.isclose(got[i - 5], max(min(average(a, b) for b in range(i, 30)) for a in range(i + 1)))
    assert decisions.monotone_blocks(points.limit(0)).count() == 0


def test_missing_features_are_filled_and_far_rows_stand_out(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (2.0, None), (3.0, 7.0), (None, None), (100.0, 6.0)], "a double, b double")
    spread = models.spreads(rows.where("a < 50 or a is null"), FEATURES)
    assert spread["a"] == [1.5, 2.0, 2.5] and spread["b"] == [5.5, 6.0, 6.5]
    assert [r.s for r in rows.select(models.shift_score(FEATURES, spread).alias("s")).collect()] == [1.0, 0.0, 1.0, 10.0, 5.0]
    assert [tuple(r) for r in models.imputed(rows, FEATURES, spread).collect()][3] == (2.0, 6.0)


def test_silhouette_and_rand_against_pairs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(30, 3)), rng.normal(size=(20, 3)) + 4, [[50.0, 0, 0]]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key int, x array<double>")
    centres = np.array([[0.0, 0, 0], [4, 4, 4], [50, 0, 0], [-99, 0, 0]])
    got = states.assign(rows, centres)
    label = np.array([r.state for r in got.orderBy("key").collect()])
    s = {r.key: r.silhouette for r in states.silhouette(got, states.Sums.of(got, 4, 3)).collect()}
    d = ((x[:, None] - x) ** 2).sum(axis=2)
    for i in range(len(x)):
        own = label == label[i]
        a = d[i, own].sum() / max(own.sum() - 1, 1)
        b = min(d[i, label == k].mean() for k in set(label) - {label[i]})
        assert np.isclose(s[i], (b - a) / max(a, b) if own.sum() > 1 else 0)
    other = got.withColumn("state", (F.col("key") % 2))
    pairs = list(itertools.combinations(range(len(x)), 2))
    same = lambda v: np.array([v[i] == v[j] for i, j in pairs])
    p, q = same(label), same(np.arange(len(x)) % 2)
    chance = p.sum() * q.sum() / len(pairs)
    assert np.isclose(states.adjusted_rand(got, other, "key").first()[0], ((p & q).sum() - chance) / ((p.sum() + q.sum()) / 2 - chance))


@pytest.mark.parametrize("n, bits", [(1, 10), (7, 2), (40, 10)])
def test_draws_take_the_smallest_hashes(spark, n, bits):
    import hashlib

    rows = spark.createDataFrame([(i, float(i * i % 13)) for i in range(40)], "key int, v double")
    got = {r.draw: r.mean for r in states.smallest_draws(rows, "key", "v", n, 6, 5, bits).collect()}
    for d in range(6):
        order = sorted(range(40), key=lambda i: (hashlib.sha256(f"5:{d}:{i}".encode()).hexdigest()[:8], i))[:n]
        assert np.isclose(got[d], np.mean([i * i % 13 for i in order]))


@pytest.mark.parametrize("width", [0.0, 0.5, 8.0])
def test_draws_shuffle_only_what_lies_near_the_last_hash(spark, width):
    """However narrow the band of hashes that is put in order, each draw takes its n rows; with the default it is a few rows."""
    import hashlib

    rows = spark.createDataFrame([(i, float(i * i % 13)) for i in range(3000)], "key int, v double").repartition(3)
    out = states.smallest_draws(rows, "key", "v", 700, 5, 9, width=width)
    got = {r.draw: r.mean for r in out.collect()}
    assert len(got) == 5
    for d in range(5):
        order = sorted(range(3000), key=lambda i: (hashlib.sha256(f"9:{d}:{i}".encode()).hexdigest()[:8], i))[:700]
        assert np.isclose(got[d], np.mean([i * i % 13 for i in order]))
    if width == 8.0:  # the table of all rows and draws is joined with nothing
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Generate" not in plan


def test_metric_gradient_is_that_of_the_loss(spark):
    """The loss falls as the gradient says, and more steps bring it down."""
    import pyarrow as pa

    from retroscope.operators import metric

    rng = np.random.default_rng(5)
    data = [(q, rng.normal(size=2).tolist(), (rng.normal(size=(7, 3)) ** 2).tolist(), rng.normal(size=(7, 2)).tolist()) for q in range(6)]
    batch = pa.RecordBatch.from_pylist([{"own": o, "apart": d, "theirs": y} for _, o, d, y in data])
    at = lambda w: next(metric._gradient(np.array(w), 0.5, 0.1)(iter([batch]))).to_pylist()[0]
    w = [0.7, 1.2, 1.1]
    for i in range(3):
        up, down = list(w), list(w)
        up[i] += 1e-6
        down[i] -= 1e-6
        assert np.isclose(at(w)["grad"][i], (at(up)["loss"] - at(down)["loss"]) / 2e-6, atol=1e-5)
    rows = spark.createDataFrame(data, "query_id int, own array<double>, apart array<array<double>>, theirs array<array<double>>")
    fitted = metric.fit_diagonal(rows, 3, 30)
    assert fitted.losses[-1] < fitted.losses[0] and np.isclose(fitted.weights.mean(), 1)
    assert (metric.fit_diagonal(rows.limit(0), 3, 3).weights == 1).all()


def test_normal_share(spark):
    from math import erf, sqrt

    from retroscope.operators.metric import normal_share

    xs = [-6.0, -1.3, -0.2, 0.0, 0.1, 0.9, 2.5, 7.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_share(F.col("x")).alias("p")).collect()]
    assert np.allclose(got, [(1 + erf(x / sqrt(2))) / 2 for x in xs], atol=1e-7)


def test_projected_vectors_have_length_one(spark):
    from retroscope.operators import metric

    rows = spark.createDataFrame([([1.0, 2.0, 3.0],), ([3.0, 2.0, 1.0],)], "v array<double>")
    mean, scale = metric.scales(rows, "v", 3)
    assert mean.tolist() == [2, 2, 2] and scale.tolist() == [1, 1, 1]
    p = np.array([[3.0, 0], [0, 1], [-1, 0]])
    got = [r.v for r in metric.transformed(rows, "v", mean, scale, projection=p).collect()]
    assert np.allclose(got, [[-1, 0], [1, 0]])
