"""The candidates' scorer against numpy."""

from math import erf

import numpy as np
import pytest
from pyspark.sql import functions as F

from retroscope.operators import cycles


def test_network_equals_numpy(spark):
    rng = np.random.default_rng(1)
    sizes, x = (3, 5, 2, 1), rng.normal(size=(20, 3))
    layers = [(rng.normal(size=(b, a)), rng.normal(size=b)) for a, b in zip(sizes, sizes[1:])]
    table = [(i, u, w[u].tolist(), float(b[u])) for i, (w, b) in enumerate(layers) for u in reversed(range(len(b)))]
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(20, None, 1.0, 2.0)], "id int, a double, b double, c double")
    units = spark.createDataFrame(table, "layer int, unit int, weights array<double>, bias double")
    got = cycles.learned_scores(rows, [F.col(c) for c in "abc"], units).orderBy("id").collect()
    h = np.vstack([x, [0.0, 1.0, 2.0]])
    for i, (w, b) in enumerate(layers):
        h = h @ w.T + b
        h = h * (1 + np.vectorize(erf)(h / 2**0.5)) / 2 if i < 2 else h
    assert np.allclose([r.score for r in got], (1 / (1 + np.exp(-h)))[:, 0], atol=1e-6)
    assert cycles.learned_scores(rows.limit(0), [F.col("a")], units.where("layer = 0")).count() == 0
    with pytest.raises(ValueError, match="layers"):
        cycles.learned_scores(rows, [F.col("a")], units.limit(0))


def test_dominated_spans_change_nothing(spark):
    rng = np.random.default_rng(2)
    spans = [(s, int(a), int(a + d), int(v) / 8) for s in range(6) for a, d, v in zip(rng.integers(0, 40, 150), rng.integers(0, 12, 150), rng.integers(0, 9, 150))]
    rows = spark.createDataFrame(spans, "security int, start_idx int, end_idx int, score double")
    want = set()
    for security in range(6):
        taken = []
        for _, a, b, v in sorted((r for r in spans if r[0] == security), key=lambda r: (-r[3], r[1], r[2])):
            if all(b < x or y < a for x, y, _ in taken):
                taken.append((a, b, v))
        want |= {(security, *t) for t in taken}
    kept = cycles.undominated(rows)
    assert {tuple(r) for r in cycles.without_overlap(kept).collect()} == want == {tuple(r) for r in cycles.without_overlap(rows).collect()}
    assert kept.count() < rows.count() / 2
