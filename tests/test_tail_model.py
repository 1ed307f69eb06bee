"""Spline basis, penalised Poisson fit, folds and the z scale against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import nulls, tail_model as tm


def basis(x, knots):
    x, knots = np.asarray(x, float), np.asarray(knots, float)
    d = np.stack([(np.maximum(x - k, 0) ** 3 - np.maximum(x - knots[-1], 0) ** 3) / (knots[-1] - k) for k in knots[:-1]], 1)
    return np.concatenate([x[:, None], d[:, :-1] - d[:, -1:]], 1)


def test_basis_and_knots(spark):
    xs = np.linspace(-4, 9, 60)
    for knots in ([0.0, 5.0], [0.0, 1.0, 2.5, 5.0]):
        df = spark.createDataFrame([(float(x),) for x in xs], "x double")
        got = df.select(F.array(*tm.spline_basis(F.col("x"), knots)).alias("b"), "x").collect()
        assert np.array([r["b"] for r in got]) == pytest.approx(basis([r["x"] for r in got], knots))
        ends = basis([-3, -2, -1, 7, 8, 9], knots)  # linear beyond the ends
        assert ends[0] - 2 * ends[1] + ends[2] == pytest.approx(0) and ends[3] - 2 * ends[4] + ends[5] == pytest.approx(0)
    assert tm.spline_knots(df, "x", 4) == pytest.approx(np.quantile(xs, [0, 0.25, 0.5, 0.75, 1]).tolist())
    for bad in (lambda: tm.spline_knots(df.withColumn("x", F.lit(1.0)), "x", 2), lambda: tm.spline_knots(df, "x", 0), lambda: tm.spline_basis(F.col("x"), [1.0, 1.0])):
        with pytest.raises(ValueError):
            bad()
    dev = spark.createDataFrame([(0, 2.0), (3, 3.0), (5, 2.0)], "k int, mu double").select(tm.deviance(F.col("k"), F.col("mu")).alias("d"))
    assert [r["d"] for r in dev.collect()] == pytest.approx([4.0, 0.0, 2 * (5 * math.log(2.5) - 3)])


ALPHA, P = 0.02, 12
KNOTS = {"own": [0.0, 1.0, 2.0, 3.0], "sib": [0.0, 1.5, 3.0]}


@pytest.fixture(scope="module")
def made(spark):
    """Replicates of cells whose rates follow a plane, a position effect and two covariates."""
    rng = np.random.default_rng(3)
    z = rng.normal(size=(P, 2))
    a = 0.3 + z @ [0.5, -0.4] + rng.normal(0, 0.1, P)
    rows = []
    for fold in range(4):
        for p in range(P):
            for own in (0.3, 1.1, 1.9, 2.8):
                for sib in (0.4, 1.2, 2.6):
                    n = int(rng.integers(200, 900))
                    mu = ALPHA * n * np.exp(a[p] + 0.4 * own - 0.2 * sib)
                    rows.append((p, own, sib, fold, n, int(rng.poisson(mu))))
    cells = spark.createDataFrame(rows, "position int, own_repr double, sib_repr double, fold int, n_trials long, n_exceed long").cache()
    plane = spark.createDataFrame([(p, z[p].tolist()) for p in range(P + 1) if p < P], "position int, z array<double>")
    return cells, plane, rows, z, a


def newton(rows, z, penalty):
    """The same objective over dense arrays; also its slope."""
    r = np.array(rows, float)
    pos, n, k = r[:, 0].astype(int), r[:, 4], r[:, 5]
    x = np.concatenate([np.eye(P)[pos], basis(r[:, 1], KNOTS["own"]), basis(r[:, 2], KNOTS["sib"]), np.zeros((len(r), 3))], 1)
    plane = np.concatenate([np.eye(P), np.zeros((P, x.shape[1] - P - 3)), -np.column_stack([np.ones(P), z])], 1)
    theta = np.zeros(x.shape[1])
    for _ in range(60):
        mu = np.exp(np.clip(np.log(ALPHA * n) + x @ theta, -50, 50))
        g = x.T @ (mu - k) + 2 * penalty * plane.T @ (plane @ theta)
        theta -= np.linalg.lstsq((x * mu[:, None]).T @ x + 2 * penalty * plane.T @ plane, g, rcond=1e-13)[0]
    eta = np.log(ALPHA * n) + x @ theta
    return theta, (np.exp(eta) - k * eta).sum() + penalty * ((plane @ theta) ** 2).sum()


def merged(rows, keep):
    out = {}
    for p, o, s, f, n, k in rows:
        if keep(f):
            a, b = out.get((p, o, s), (0, 0))
            out[p, o, s] = a + n, b + k
    return [(*key, 0, *v) for key, v in out.items()]


def test_fit_reaches_the_minimum(made):
    cells, plane, rows, z, a = made
    models = [(0.5, None), (50.0, None), (5.0, 1), (5.0, 3), (1e6, None)]
    fits, states = tm.fit_all(cells, plane, KNOTS, ALPHA, models)
    for i, (penalty, fold) in enumerate(models[:4]):
        theta, objective = newton(merged(rows, lambda f: f != fold), z, penalty)
        m = fits[i]
        got = {r["position"]: r["a"] for r in m.positions.collect()}
        assert m.converged and m.steps < 40 and m.objective == pytest.approx(objective, rel=1e-9)
        assert [got[p] for p in range(P)] == pytest.approx(theta[:P], abs=1e-5)
        assert m.beta == pytest.approx(theta[P : P + 5], abs=1e-5) and m.c == pytest.approx(theta[-3:], abs=1e-5)
    # a strong penalty puts every position on its plane
    off = [r["a"] - np.dot([1, *z[r["position"]]], fits[4].c) for r in fits[4].positions.collect()]
    assert max(map(abs, off)) < 1e-2


def test_folds_choose_the_penalty(made):
    cells, plane, rows, z, a = made
    model = tm.fit(cells, plane, KNOTS, ALPHA, [0.01, 10.0, 1e5], folds=4)
    assert len(model.scores) == 12 and model.penalty in (0.01, 10.0, 1e5)
    want = {}
    for penalty in (0.01, 10.0, 1e5):
        for fold in range(4):
            theta, _ = newton(merged(rows, lambda f: f != fold), z, penalty)
            r = np.array([x for x in rows if x[3] == fold], float)
            mu = np.exp(np.log(ALPHA * r[:, 4]) + theta[r[:, 0].astype(int)] + basis(r[:, 1], KNOTS["own"]) @ theta[P : P + 3] + basis(r[:, 2], KNOTS["sib"]) @ theta[P + 3 : P + 5])
            k = r[:, 5]
            want[penalty, fold] = 2 * (np.where(k > 0, k * np.log(np.maximum(k, 1) / mu), 0) - (k - mu)).sum()
    assert {(p, f): d for p, f, d, _ in model.scores} == pytest.approx(want, rel=1e-6)
    total = {p: sum(v for (q, _), v in want.items() if q == p) for p in (0.01, 10.0, 1e5)}
    assert model.penalty == min(total, key=total.get)
    # the fitted rates follow the made ones
    got = model.log_rate(cells.select("position", F.col("own_repr").alias("own"), F.col("sib_repr").alias("sib")).distinct()).collect()
    true = [a[r["position"]] + 0.4 * r["own"] - 0.2 * r["sib"] for r in got]
    assert np.corrcoef([r["log_rate"] for r in got], true)[0, 1] > 0.95


def test_cells_of_branches(spark):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(3)), int(rng.integers(20)), float(rng.uniform(0, 4)), float(s) if rng.random() > 0.05 else None) for s in rng.normal(size=2000)]
    df = tm.quantile_bins(spark.createDataFrame(rows, "position int, replicate int, own double, s double"), {"own": 4})
    own = np.array([r[2] for r in rows])
    edges = np.quantile(own, np.linspace(0, 1, 5))
    at = np.clip(np.searchsorted(edges, own, "right") - 1, 0, 3)
    means = [own[at == b].mean() for b in range(4)]
    assert sorted({r["own_repr"] for r in df.select("own_repr").distinct().collect()}) == pytest.approx(means)
    t = tm.cell_table(df, "s", 1.0, ["own"], folds=3, seed=5)
    total = t.agg(F.sum("n_trials"), F.sum("n_exceed"), F.count_distinct("fold")).first()
    assert tuple(total) == (sum(r[3] is not None for r in rows), sum(r[3] is not None and r[3] >= 1 for r in rows), 3)


def test_z_and_back(spark):
    """z falls back to the pooled tail below the anchor, and its inverse is the threshold."""
    null = spark.createDataFrame([(float(i),) for i in range(1000)], "s double")
    tail = nulls.tail(null, "s")
    df = spark.createDataFrame([(5.0, 1.0), (995.0, 0.0), (995.0, math.log(2)), (None, 0.0)], "s double, a double")
    out = tm.with_z(nulls.with_survival(df, tail, "s"), "s", "survival", "a", 990.0).collect()
    got = {(r["s"], r["a"]): r["z"] for r in out}
    assert got[5.0, 1.0] == pytest.approx(-math.log10(996 / 1001)) and got[None, 0.0] is None
    assert got[995.0, 0.0] == pytest.approx(-math.log10(6 / 1001)) and got[995.0, math.log(2)] == pytest.approx(-math.log10(12 / 1001))
    back = nulls.with_quantile(df.withColumn("q", tm.pooled_survival("a", -math.log10(6 / 1001), 0.01)), tail, "q").collect()
    assert {r["a"]: r["t"] for r in back if r["s"] == 995.0} == {0.0: 995.0, math.log(2): 998.0}
    with pytest.raises(ValueError):
        tm.pooled_survival("a", 1.0, 0.01)
