"""Queries that return a row per bar or candidate, against plain replicas, so that no row is summed away."""

import math
import statistics
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from retroscope.plans import registry
from retroscope.plans.common import returns
from retroscope.plans.cycles import walk


def whole(spark, sf_dir, name, keys):
    """A query's rows by their keys, none twice."""
    rows = registry.QUERIES[name](spark, sf_dir).collect()
    out = {tuple(r[k] for k in keys): r for r in rows}
    assert len(out) == len(rows) > 0
    return out


def test_every_bar_is_scaled_by_the_training_bars(spark, sf_dir):
    bars = returns(spark, sf_dir).where("momentum is not null").select("security", "session", "momentum", "volume", (F.year("session") < 1997).alias("train")).toPandas()
    got = whole(spark, sf_dir, "frozen_scaler", ["security", "session"])
    assert set(got) == set(zip(bars["security"], bars["session"], strict=True))
    for c in ("momentum", "volume"):
        train = bars.loc[bars["train"], c].to_numpy()
        z = np.clip((bars[c] - train.mean()) / max(train.std(), 1e-4), -5, 5)
        std = (bars[c] - train.mean()) / train.std(ddof=1)
        rows = [got[k] for k in zip(bars["security"], bars["session"], strict=True)]
        assert [r[f"{c}_z"] for r in rows] == pytest.approx(list(z), abs=2e-6)
        assert [r[f"{c}_std"] for r in rows] == pytest.approx(list(std), abs=2e-6)


def test_every_bar_is_joined_and_filled(spark, sf_dir):
    bars = returns(spark, sf_dir).select("security", "session", "ordinal", "close", "volume", "sector").collect()
    want = {}
    for r in bars:
        there = r.ordinal % 3 == 0
        volume = r.volume if r.ordinal % 5 or there else None
        want[r.security, r.session] = (r.close, volume, r.sector if there else None, there)
    assert {(v, s, m) for _, v, s, m in want.values() if v is None} == {(None, None, False)}
    got = whole(spark, sf_dir, "coalesced_join", ["security", "session"])
    assert {k: (r.close, r.volume, r.sector, r.matched) for k, r in got.items()} == want


def test_every_candidate_cycle_is_there(spark, sf_dir):
    prices = walk(spark, sf_dir).select("security", "ordinal", "price").toPandas()
    want = {}
    for security, rows in prices.groupby("security"):
        p = rows.sort_values("ordinal")["price"].tolist()
        moves = [b / a - 1 for a, b in pairwise(p)]
        for s in range(len(p) - 21):
            near = moves[max(0, s - 21) : s]
            near = near if len(near) >= 7 else moves
            spread, size = statistics.stdev(near), statistics.fmean(map(abs, near))
            last, low, top = min(s + 252, len(p) - 1), 1.0, 1.0
            for e in range(s + 1, last + 1):
                gain = p[e] / p[s]
                low = min(low, gain)
                if e - s < 21:
                    continue
                enough = gain - 1 >= max(0.10, (1.5 * size + 0.75 * spread) * math.sqrt(e - s))
                if gain >= top and enough and low - 1 >= -max(0.12, 1.75 * max(0.05, 2 * spread)):
                    end = next((x for x in range(e + 1, last + 1) if p[x] / p[e] - 1 <= -max(0.12, 2 * spread)), e)
                    want[security, s, e] = (end, gain - 1, p[end] / p[s] - 1, low - 1, spread)
                top = max(top, gain)
    got = whole(spark, sf_dir, "cycle_candidates", ["security", "start_idx", "peak_idx"])
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert (r.end_idx, r.peak_return, r.end_return, r.drawdown, r.volatility) == pytest.approx(want[k], abs=2e-6)
