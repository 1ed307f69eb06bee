"""Diagnostics on small hand-made replicates."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import diagnostics, nulls, switches


def states(spark, rows, observed=4, **kw):
    """``two_states`` of (n, high, label statistic) rows, one per replicate."""
    calls = spark.createDataFrame([(1.0, i, n) for i, (n, _, _) in enumerate(rows)], "threshold double, replicate int, n long")
    labels = spark.createDataFrame([(i, h, x) for i, (_, h, x) in enumerate(rows)], "replicate int, high boolean, label_statistic double")
    seen = spark.createDataFrame([(1.0, observed)], "threshold double, n_observed long")
    return diagnostics.two_states(calls, labels, seen, **kw).collect()


def test_two_states_apart(spark):
    (r,) = states(spark, [(1, False, 1.0), (2, False, 1.1), (2, False, 1.3), (8, True, 9.0), (10, True, 9.2), (50, None, 5.0)])
    assert (r["n_high"], r["n_low"], r["mean_high"], r["share"]) == (2, 3, 9.0, 0.4)
    assert r["sd_high"] == pytest.approx(math.sqrt(2)) and r["mean_low"] == pytest.approx(5 / 3)
    assert (r["share_low"], r["share_high"]) == pytest.approx((0.0527449505263169, 0.8533672005401346))
    assert r["fdp"] == pytest.approx((0.6 * 5 / 3 + 0.4 * 9) / 4) and r["fdp_high"] == pytest.approx((5 / 3 + r["share_high"] * (9 - 5 / 3)) / 4)
    assert not (r["low_exceeds_high"] or r["high_below_2"] or r["gap_not_dominant"] or r["cut_not_at_largest_gap"])
    assert r["largest_gap"] == pytest.approx(7.7) and r["gap_ratio"] == pytest.approx(7.7 / 0.2)


def test_two_states_spoken_against(spark):
    # a low replicate reaches the high ones, gaps are alike, the cut lies elsewhere
    (r,) = states(spark, [(9, False, 1.0), (2, False, 2.0), (8, True, 3.0), (3, True, 4.5)])
    assert r["low_exceeds_high"] and r["gap_not_dominant"] and r["cut_not_at_largest_gap"] and r["gap_ratio"] == pytest.approx(1.5)
    (r,) = states(spark, [(9, False, 1.0), (2, False, 2.0), (8, True, 3.0), (3, True, 4.5)], dominance=1.4)
    assert not r["gap_not_dominant"]
    # one state alone, no statistic, one replicate, no observed call
    (r,) = states(spark, [(1, False, None), (3, False, 2.0)], observed=0)
    assert r["high_below_2"] and r["fdp"] is None and r["gap_ratio"] is None and r["gap_not_dominant"] is None and r["share_low"] == 0.0
    (r,) = states(spark, [(1, True, 2.0)])
    assert r["largest_gap"] is None and not r["gap_not_dominant"] and r["sd_high"] is None and r["share_high"] == 1.0
    (r,) = states(spark, [(1, True, 2.0), (1, False, 2.0), (1, False, 2.0)])
    assert r["largest_gap"] == 0 and r["gap_ratio"] == math.inf and not r["cut_not_at_largest_gap"]
    assert states(spark, []) == []
    labels = spark.createDataFrame([("a", True), ("a", False), (None, True), ("b", None)], "run string, high boolean")
    assert sorted(map(tuple, diagnostics.group_composition(labels, "run").collect()), key=str) == [("a", 2, 1), (None, 1, 1)]


def test_null_on_null(spark):
    rng = random.Random(2)
    rows = [(r, rng.gauss(0, 1)) for r in range(20) for _ in range(300)] + [(None, 9.0), (3, None), (4, math.nan)]
    null = spark.createDataFrame(rows, "replicate int, s double")
    held = {r["replicate"]: r["held"] for r in diagnostics.held_out(null, 0.3, 5).collect()}
    assert len(held) == 20 and sum(held.values()) == 6
    assert held == {r["replicate"]: r["held"] for r in diagnostics.held_out(null.repartition(7), 0.3, 5).collect()}
    n = {r: sum(x is not None and not math.isnan(x) and x >= 1.0 for q, x in rows if q == r) for r in range(20)}
    expected = np.mean([n[r] for r in range(20) if not held[r]])
    got = diagnostics.null_on_null(null, "s", 1.0, 0.3, 5).collect()
    assert {(r["replicate"], r["n_calls"]) for r in got} == {(r, n[r]) for r in range(20) if held[r]}
    assert all(r["expected"] == pytest.approx(expected) and r["fdp"] == pytest.approx(expected / n[r["replicate"]]) for r in got)
    assert diagnostics.null_on_null(null.where("replicate = 1"), "s", 1.0, 0.3, 5).collect() == []


def test_control_and_rules(spark):
    o = spark.createDataFrame([(1, 1.0), (1, 2.0), (-1, 50.0), (None, 60.0), (1, None), (1, math.nan)], "ac int, s double")
    n = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 3.0), (-1, 70.0)], "ac int, s double")
    r = diagnostics.control(o, n, "s", "ac", 2.0).first()
    assert (r["n_observed"], r["n_null"], r["observed_mean"], r["observed_rate"]) == (2, 3, 1.5, 0.5)
    assert r["null_deviation"] == pytest.approx(np.std([0, 1, 3])) and r["null_q90"] == pytest.approx(2.6) and r["ks"] == pytest.approx(1 / 3)
    r = diagnostics.control(o, n.limit(0), "s", "ac", 2.0).first()
    assert r["n_null"] == 0 and r["ks"] is None and r["ks_p"] is None and r["null_q50"] is None and r["observed_q50"] == 1.5
    calls = spark.createDataFrame([(True, True), (True, None), (False, False)], "p boolean, c boolean")
    got = sorted(map(tuple, diagnostics.head_to_head(calls, F.col("p"), F.col("c")).collect()))
    assert got == [(False, False, 1), (False, True, 0), (True, False, 1), (True, True, 1)]


def test_flatness_bins_and_missing_values(spark):
    rows = [(i, r, float(i), i % 3, None if r == 0 else float(i + r)) for i in range(40) for r in range(4)]
    null = spark.createDataFrame(rows, "t int, replicate int, x double, k int, s double")
    bins = diagnostics.covariate_bins(null, ["x", "k"], bins=4)
    got = {(r["covariate"], r["bin"]): (r["n_tests"], r["rate"]) for r in diagnostics.exceedance_rates(null, ["t"], "s", 21.0, bins).collect()}
    # the missing statistic of replicate 0 is one of four that don't reach the threshold
    rate = lambda i: sum(i + r >= 21 for r in (1, 2, 3)) / 4
    for k in range(3):
        assert got["k", str(k)] == (len(range(k, 40, 3)), pytest.approx(np.mean([rate(i) for i in range(k, 40, 3)])))
    edges = np.quantile(np.arange(40), [0, 0.25, 0.5, 0.75, 1])
    for b in range(4):
        inside = [i for i in range(40) if (b == 0 or i > edges[b]) and i <= edges[b + 1]]
        assert got["x", str(b)] == (len(inside), pytest.approx(np.mean([rate(i) for i in inside])))
    assert len(got) == 7


def test_jackknife_of_cells_that_replicates_miss(spark):
    rng = random.Random(9)
    rows = [(r, c, t, rng.randint(0, t)) for r in range(7) for c in ("a", "b", "c", None) if rng.random() < 0.6 for t in [rng.randint(1, 9)]] + [(0, "empty", 5, 0)]
    got = {r["c"]: r for r in nulls.multipliers(spark.createDataFrame(rows, "replicate int, c string, n_trials long, n_exceed long"), ["c"]).collect()}

    def a(rows, c):
        e, t, E, T = sum(x[3] for x in rows if x[1] == c), sum(x[2] for x in rows if x[1] == c), sum(x[3] for x in rows), sum(x[2] for x in rows)
        return e / t / (E / T) if t and e and E else 1.0

    reps = sorted({x[0] for x in rows})
    for c in {x[1] for x in rows}:
        logs = [math.log(a([x for x in rows if x[0] != r], c)) for r in reps]
        assert got[c]["multiplier"] == pytest.approx(a(rows, c))
        assert got[c]["se_log"] == pytest.approx(math.sqrt((len(reps) - 1) * np.var(logs)), abs=1e-9)


def test_siblings_swap(spark):
    df = spark.createDataFrame([(1, 0.5, 2.0, 3.0, 10, 100), (2, 0.1, None, 1.0, 0, 7)], "position int, depth double, score_left double, score_right double, clade_left int, clade_right int")
    got = {(r["position"], r["branch"]): (r["score"], r["log_own"], r["log_sib"]) for r in switches.branch_covariates(df).collect()}
    assert got[1, "left"] == (2.0, pytest.approx(math.log(10)), pytest.approx(math.log(100))) and got[1, "right"] == (3.0, pytest.approx(math.log(100)), pytest.approx(math.log(10)))
    assert got[2, "left"] == (None, None, pytest.approx(math.log(7)))
