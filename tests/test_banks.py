"""Growing banks, sealed labels, reconciled accounts, filled cycles and resampled survival on small tables."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from retroscope.operators import audits, banks, cycles, inference, selection


def test_later_batches_win_and_may_lack_columns(spark):
    first = spark.createDataFrame([("a", 1, 5, "x"), ("b", 2, 6, "y")], "key string, at int, v int, extra string")
    second = spark.createDataFrame([("a", 0, 7), ("c", 3, 8), ("c", 4, None)], "key string, at int, v int")
    got = {r.key: (r.at, r.v, r.extra) for r in banks.grown(first, [second], ["key"], "at").collect()}
    assert got == {"a": (0, 7, None), "b": (2, 6, "y"), "c": (4, None, None)}


def test_intervals_show_one_row_of_a_key_at_a_time(spark):
    rows = spark.createDataFrame([("a", 3, 1), ("a", 9, 2), ("a", 9, 3), ("b", None, 4), ("b", 5, 5)], "key string, since int, id int")
    kept = banks.intervals(rows, ["key"], "since")
    at = lambda t: sorted(r.id for r in banks.as_of(kept, "since", F.lit(t)).collect())
    assert [at(t) for t in (2, 3, 5, 8, 9, 99)] == [[], [1], [1, 5], [1, 5], [3, 5], [3, 5]]


def test_labels_stay_sealed_until_all_predictions_are_there(spark):
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "g int, id string")
    made = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (1, "b", 0.2), (2, "c", None), (9, "d", 0.3)], "g int, id string, prediction double")
    labels = spark.createDataFrame([(1, "a", 1.0), (2, "c", 2.0), (3, "d", 3.0), (4, "e", 4.0)], "g int, id string, y double")
    assert [r.id for r in audits.sealed(labels, expected, made, ["g"]).collect()] == ["a"]


def test_every_broken_rule_is_named(spark):
    keys = "year int, "
    expected = spark.createDataFrame([(1,), (2,), (3,)], "year int")
    coverage = spark.createDataFrame([(1, 5, 5, 3, 3, 6.0), (2, 4, 3, 4, 3, 1.0), (2, 4, 3, 4, 3, 1.0), (7, 0, 0, 0, 0, 0.0)], keys + "candidates int, decisions int, admitted int, expected int, stated double")
    exclusions = spark.createDataFrame([(1, "OK", 2), (2, "BAD", 1)], keys + "reason string, excluded int")
    forecasts = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "c", 3.0), (2, "a", 1.0), (2, "a", 1.0)], keys + "id string, value double")
    rows = audits.reconciled(expected, coverage, exclusions, forecasts, ["OK"]).where("broken").collect()
    got = {(r.year, r.rule): (r.found, r.wanted) for r in rows}
    assert got == {(2, "reports"): (2, 1), (3, "reports"): (0, 1), (7, "reports"): (1, 0), (2, "decisions"): (3, 4), (2, "candidates"): (5, 4), (2, "forbidden_reasons"): (1, 0), (2, "expected"): (3, 4), (2, "sealed"): (1, 3), (2, "repeated_forecasts"): (1, 0)}


def test_cycles_without_metadata_are_rebuilt(spark):
    rows = [(1, o, [5.0, 9.0, 9.0, 4.0][o % 4], 0 if 2 <= o <= 5 else -1, 1 if o == 2 else 0, -1, None, -1) for o in range(8)]
    rows += [(2, o, 1.0, 3, 0, 4 if o == 11 else None, 20 if o == 12 else -1, None) for o in range(10, 13)]
    df = spark.createDataFrame(rows, "security int, ordinal int, price double, cycle int, action int, start_idx int, end_idx int, peak_idx int").repartition(3)
    got = {(r.security, r.ordinal): (r.start_idx, r.end_idx, r.peak_idx, r.duration, round(r.progress, 3), r.lead_to_peak) for r in cycles.backfill(df).collect()}
    assert got[1, 0] == (-1, -1, -1, 0, 0.0, None)
    assert [got[1, o] for o in (2, 5)] == [(2, 5, 2, 4, 0.0, 0), (2, 5, 2, 4, 1.0, -3)]
    assert [got[2, o] for o in (10, 11, 12)] == [(4, 20, 10, 17, 0.0, 0), (4, 20, 10, 17, 0.5, -1), (4, 20, 10, 17, 1.0, -2)]


def test_rmst_by_clusters(spark):
    rng = np.random.default_rng(1)
    spells = [(int(d), bool(e), int(c)) for d, e, c in zip(rng.integers(1, 9, 90), rng.random(90) < 0.7, rng.integers(0, 6, 90), strict=True)]
    got = inference.cluster_rmst(spark.createDataFrame(spells, "duration int, ended boolean, cluster int"), "cluster", 5, 30, 2).first()

    def rmst(rows):
        alive, out = 1.0, 0.0
        for t in range(1, 6):
            risk = sum(d >= t for d, _, _ in rows)
            alive *= 1 - (sum(d == t and e for d, e, _ in rows) / risk if risk else 0)
            out += alive
        return out

    names = sorted({c for _, _, c in spells})
    draws = []
    for b in range(30):
        picked = [names[int(hashlib.sha256(f"2:{b}:{p}".encode()).hexdigest()[:8], 16) % len(names)] for p in range(len(names))]
        draws.append(rmst([s for c in picked for s in spells if s[2] == c]))
    assert np.allclose([got.rmst, got.error, got.low, got.high], [rmst(spells), np.std(draws), *np.percentile(draws, [2.5, 97.5])])


def test_the_fold_itself_has_no_say(spark):
    rng = np.random.default_rng(3)
    daily = [(c, f, s, float(rng.normal(0.001 * (c == "good") + (0.05 if (c, f) == ("odd", "z") else 0), 0.01))) for c in ("good", "odd", "base") for f in "xyz" for s in range(60) if (s + ord(f)) % 7]
    df = spark.createDataFrame(daily, "candidate string, fold string, session int, value double")
    rows = {r.heldout: r for r in selection.leave_one_fold_out(df, selection.runs(df), "base").collect()}
    sharpe = lambda v: np.mean(v) / np.std(v, ddof=1) * 252**0.5
    of = lambda c, f: [v for cc, ff, _, v in daily if (cc, ff) == (c, f)]
    gain = lambda c, f: np.prod(1 + np.array(of(c, f))) - 1

    def fall(c, f):
        curve = np.cumprod([1.0, *(1 + np.array(of(c, f)))])
        return (curve / np.maximum.accumulate(curve) - 1).min()

    for held in "xyz":
        others = [f for f in "xyz" if f != held]
        scores = {}
        for c in ("good", "odd", "base"):
            days = {s for cc, ff, s, _ in daily if cc == c and ff != held}
            pooled = [np.mean([v for cc, ff, ss, v in daily if (cc, ss) == (c, s) and ff != held]) for s in days]
            scores[c] = sharpe(pooled) + 0.5 * min(sharpe(of(c, f)) for f in others) + np.mean([gain(c, f) - gain("base", f) for f in others]) - 0.5 * abs(min(fall(c, f) for f in others))
        best = max(scores, key=scores.get)
        assert rows[held].selected == best and np.isclose(rows[held].score, scores[best]) and np.isclose(rows[held].heldout_sharpe, sharpe(of(best, held)))
