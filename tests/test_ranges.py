"""Ranges of values, and what is read from null rows by them, against plain counts."""

import random

import pytest

from sparkloom.operators import nulls, ranks


def _longest_method(df):
    """Bytes of the longest compiled method of a plan: beyond 8,000 the JVM interprets it."""
    conf, jvm = df.sparkSession.conf, df.sparkSession._jvm
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
        found = getattr(jvm.org.apache.spark.sql.execution.debug, "package").codegenStringSeq(plan)
        return max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size()))
    finally:
        conf.unset("spark.sql.adaptive.enabled")


def test_merge_compiles(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 1)
    a = spark.createDataFrame([(float(i), i) for i in range(300)], "x double, id int")
    b = spark.createDataFrame([(float(i), 0.5) for i in range(300)], "t double, s double")
    assert _longest_method(ranks.as_of(a, b, "x", "t")) < 8000


@pytest.mark.parametrize("equal", [False, True])
@pytest.mark.parametrize("n", [0, 1, 2, 5, 16, 255])
def test_in_ranges(spark, n, equal):
    r = random.Random(n)
    edges = sorted(float(r.randrange(100)) for _ in range(n))
    rows = spark.createDataFrame([(float(i),) for i in range(-2, 103)] + [(None,)], "x double").crossJoin(spark.createDataFrame([(edges,)], "e array<double>"))
    got = ranks.in_ranges(rows, rows["x"], "e", "r", max(n, 1), equal).collect()
    assert len(got) == 106
    for x in got:
        assert x["r"] == (None if x["x"] is None else sum(e <= x["x"] if equal else e < x["x"] for e in edges))


@pytest.mark.parametrize("size", [10_000_000, 20])
def test_survival_and_quantile_among_null_rows(spark, monkeypatch, size):
    """Many equal values, single ones, missing ones; the tail's merges agree."""
    monkeypatch.setattr(ranks, "RANGE_ROWS", size)
    r = random.Random(size)
    v = [7.0] * 200 + [float(r.randrange(30)) for _ in range(200)] + [r.random() * 30 for _ in range(100)] + [1e6]
    null = spark.createDataFrame([(x,) for x in [*v, None, float("nan")]], "s double")
    xs = [None, -1.0, 7.0, 7.0, 1e6, 2e6, *(float(i) for i in range(31)), *v[-60:]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, x double")
    got = {x["id"]: x for x in nulls.survival_among(df, null, "s", "x").collect()}
    assert len(got) == len(xs) and got[0]["x"] is None and got[0]["survival"] is None
    for i, x in enumerate(xs[1:], 1):
        assert got[i]["x"] == x and got[i]["survival"] == (sum(y >= x for y in v) + 1) / (len(v) + 1)
    over = sorted({(sum(y >= x for y in v) + 1) / (len(v) + 1) for x in v})
    qs = [None, 0.0, 1e-9, 1.0, 2.0, 0.5, *over, *(q * (1 - 1e-12) for q in over), *(r.random() for _ in range(40))]
    want = spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "id int, q double")
    cut = {x["id"]: x["t"] for x in nulls.quantile_among(want, null, "s", "q").collect()}
    assert len(cut) == len(qs) and cut[0] is None
    for i, q in enumerate(qs[1:], 1):
        assert cut[i] == min((x for x in v if (sum(y >= x for y in v) + 1) / (len(v) + 1) <= q), default=1e6)
    assert cut == {x["id"]: x["t"] for x in nulls.with_quantile(want, nulls.tail(null, "s"), "q").collect()}


def test_survival_and_quantile_of_few_null_rows(spark):
    df = spark.createDataFrame([(0.5, 1.0), (2.0, 0.4)], "q double, x double")
    none = spark.createDataFrame([], "s double")
    assert {x["survival"] for x in nulls.survival_among(df, none, "s", "x").collect()} == {1.0}
    assert {x["t"] for x in nulls.quantile_among(df, none, "s", "q").collect()} == {None}
    same = spark.createDataFrame([(3.0,)] * 4, "s double")
    assert {(x["x"], x["survival"]) for x in nulls.survival_among(df.limit(0).unionByName(spark.createDataFrame([(0.1, 3.0), (0.1, 4.0)], "q double, x double")), same, "s", "x").collect()} == {(3.0, 1.0), (4.0, 0.2)}
    assert {x["t"] for x in nulls.quantile_among(df, same, "s", "q").collect()} == {3.0}
