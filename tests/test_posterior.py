"""Merges in order, grid quantiles and the posterior correction against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import nulls, posterior, ranks


@pytest.mark.parametrize("rows", [10_000_000, 20])
def test_as_of(spark, monkeypatch, rows):
    monkeypatch.setattr(ranks, "RANGE_ROWS", rows)
    rng = np.random.default_rng(1)
    left = [(int(g) if g < 3 else None, float(x)) for g, x in zip(rng.integers(0, 4, 300), rng.integers(-5, 60, 300))] + [(1, None)]
    right = [(int(g) if g < 3 else None, float(x), i) for i, (g, x) in enumerate(zip(rng.integers(0, 4, 120), rng.integers(0, 50, 120)))] + [(2, None, 999)]
    a, b = spark.createDataFrame(left, "g int, x double"), spark.createDataFrame(right, "g int, t double, v int")
    for strict in (False, True):
        got = ranks.as_of(a, b, "x", "t", ["g"], strict).collect()
        assert len(got) == len(left)
        for r in got:
            fit = [(t, v) for g, t, v in right if g == r["g"] and t is not None and r["x"] is not None and (t < r["x"] if strict else t <= r["x"])]
            assert (r["found"] and (r["found"]["t"], r["found"]["v"])) == max(fit, default=None)
    assert ranks.as_of(a, b.limit(0), "x", "t", ["g"]).where("found is not null").count() == 0


def test_grid_quantiles_and_survival(spark):
    rng = np.random.default_rng(2)
    v = {g: np.round(rng.normal(g, 1, n), 1) for g, n in ((0, 400), (1, 37), (2, 1))}
    df = spark.createDataFrame([(g, float(x)) for g, xs in v.items() for x in xs] + [(5, None)], "g int, v double")
    got = {(r["g"], r["i"]): r["quantile"] for r in ranks.grid_quantiles(df, "v", 101, ["g"]).collect()}
    assert len(got) == 303
    for g, xs in v.items():
        assert [got[g, i] for i in range(101)] == pytest.approx(np.quantile(xs, np.linspace(0, 1, 101)).tolist())
    tail = nulls.tail(df.where("g = 0").withColumnRenamed("v", "s"), "s")
    x = np.append(np.linspace(-5, 5, 41), v[0][:5])
    out = nulls.with_survival(spark.createDataFrame([(float(i),) for i in x] + [(None,)], "x double"), tail, "x").collect()
    for r in out:
        want = None if r["x"] is None else ((v[0] >= r["x"]).sum() + 1) / (len(v[0]) + 1)
        assert r["survival"] == (pytest.approx(want) if want else None)
    back = nulls.with_quantile(spark.createDataFrame([(0.5,), (0.05,), (1.0,), (1e-9,)], "q double"), tail, "q").collect()
    for r in back:
        fit = [t for t in v[0] if ((v[0] >= t).sum() + 1) / (len(v[0]) + 1) <= r["q"]]
        assert r["t"] == min(fit, default=v[0].max())


@pytest.fixture(scope="module")
def drawn(spark):
    """Null values with an atom at 1 of 0.6, observed ones of 0.2, gap in every bin."""
    rng = np.random.default_rng(4)

    def side(n, atom, lift):
        rc = rng.uniform(0, 1, n)
        p = np.where(rng.random(n) < atom, 1.0, np.clip(rng.beta(2, 2, n) * 0.8 + lift, 0, 1))
        return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rc, p))], "k long, rc double, p double").cache()

    return side(9000, 0.6, 0.1), side(9000, 0.2, 0.0)


def gap(a, b):
    g = np.linspace(0.01, 0.99, 99)
    return np.abs(np.quantile(a, g) - np.quantile(b, g)).mean()


def test_correction_closes_the_gap(spark, drawn):
    null, observed = drawn
    c = posterior.fit(null, observed, "rc", "p", grid=1001)
    assert 4 <= len(c.fitted) <= 6 and max(c.fitted) < 6 and len(c.edges) == 9
    out = c.apply(null, "rc", "p", ["k"], 7).withColumn("bin", posterior.bin_of(F.col("rc"), c.edges)).toPandas()
    seen = observed.withColumn("bin", posterior.bin_of(F.col("rc"), c.edges)).toPandas()
    for b in range(10):
        a, o = out[out.bin == b], seen[seen.bin == b]
        before, after = gap(a.p, o.p), gap(a.corrected, o.p)
        assert after < before / 4 if b in c.fitted else after < before / 2
        if b in c.fitted:  # the atom is split, not moved as one
            assert abs((a.corrected == 1.0).mean() - (o.p == 1.0).mean()) < 0.05
    again = c.apply(null.repartition(7), "rc", "p", ["k"], 7).toPandas().sort_values("k")
    other = c.apply(null, "rc", "p", ["k"], 8).toPandas().sort_values("k")
    out = out.sort_values("k")
    assert (again.corrected.values == out.corrected.values).all() and (other.corrected.values != out.corrected.values).any()
    # order is kept but for the draws inside one value
    one = out[(out.bin == 0) & (out.p < 1)].sort_values("p")
    assert (np.diff(one.corrected) >= -1e-9).mean() > 0.95


def test_held_out_bins_and_edges(spark, drawn):
    null, observed = drawn
    base = posterior.fit(null, observed, "rc", "p", fit_bins=[0, 1, 2], grid=201)
    spoilt = observed.withColumn("p", F.when(F.col("rc") > 0.5, 0.0).otherwise(F.col("p")))
    other = posterior.fit(null, spoilt, "rc", "p", fit_bins=[0, 1, 2], grid=201)
    rows = lambda c: sorted(map(tuple, c.table.collect()))
    assert rows(base) == rows(other) and set(base.fitted) == {0, 1, 2}
    t = base.table.toPandas().sort_values(["bin", "i"])
    shift = t[t.bin < 3].assign(d=t.target - t.source).groupby("i").d.mean().values
    for b in range(3, 10):
        x = t[t.bin == b]
        assert x.target.values == pytest.approx(np.maximum.accumulate(np.clip(x.source.values + shift, 0, 1)))
    line = posterior.fit(null, observed, "rc", "p", fit_bins=[0, 1, 2, 3], grid=201, extrapolation="linear")
    assert line.table.count() == 2010 and line.table.where("target < 0 or target > 1").count() == 0
    hard = spark.createDataFrame([(1, None, 0.5), (2, 0.5, None), (3, 0.2, 1.0)], "k long, rc double, p double")
    got = {r["k"]: r["corrected"] for r in base.apply(hard, "rc", "p", ["k"], 1).collect()}
    assert got[1] == 0.5 and got[2] is None and 0 <= got[3] <= 1
    score = posterior.corrected_score(hard.withColumn("ac", F.when(F.col("k") == 3, -1).otherwise(1)).where("k <> 2"), base, "rc", "ac", "p", ["k"], 1).collect()
    assert {r["k"]: r["score"] for r in score} == {1: None, 3: pytest.approx(0.2 + got[3])}
    # conservation with most rows at one value: edges that no row can reach go
    assert posterior.bin_edges(spark.createDataFrame([(1.0,)] * 50 + [(0.5,)] * 3, "rc double"), "rc", 10) == [1.0]
    for bad in ({"least": 10_000}, {"extrapolation": "cubic"}, {"signal_free": 0.0}):
        with pytest.raises(ValueError):
            posterior.fit(null, observed, "rc", "p", grid=11, **bad)
