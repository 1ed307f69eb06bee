"""Jumps, tours, clade sums and common ancestors against walks over dicts."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom.operators import intervals


def made(seed, n, shape):
    r = random.Random(seed)
    parent = {"n0": None}
    for i in range(1, n):
        parent[f"n{i}"] = {"random": f"n{r.randrange(i)}", "comb": f"n{i - 1 if i % 2 else max(0, i - 2)}", "star": "n0", "path": f"n{i - 1}"}[shape]
    return parent, {k: (None if k == "n0" else round(r.uniform(0, 2), 3)) for k in parent}


def up(parent, x):
    out = []
    while x is not None:
        out.append(x)
        x = parent[x]
    return out


@pytest.mark.parametrize(("shape", "n"), [("random", 60), ("comb", 121), ("star", 30), ("path", 33), ("path", 1)])
def test_against_walks(spark, shape, n):
    parent, length = made(n, n, shape)
    nodes = spark.createDataFrame([(k, p, length[k]) for k, p in parent.items()], "node string, parent string, length double").cache()
    deep = {r["node"]: (r["depth"], r["distance"]) for r in intervals.levels(nodes).collect()}
    assert deep == {k: (len(up(parent, k)) - 1, pytest.approx(sum(length[x] or 0 for x in up(parent, k)))) for k in parent}

    toured = intervals.tour(nodes)
    t = {r["node"]: r for r in toured.collect()}
    assert sorted(r["pre"] for r in t.values()) == list(range(n))
    below = {k: {x for x in parent if k in up(parent, x)} for k in parent}
    leaves = {k for k in parent if len(below[k]) == 1}
    for k, r in t.items():
        assert r["size"] == len(below[k]) and {x for x in parent if r["pre"] <= t[x]["pre"] < r["pre"] + r["size"]} == below[k]
        under = below[k] & leaves
        assert r["n_leaves"] == len(under) and {x for x in leaves if r["first_leaf"] <= t[x]["first_leaf"] < r["first_leaf"] + r["n_leaves"]} == under

    rng = random.Random(1)
    value = {x: rng.randrange(100) for x in leaves if rng.random() < 0.8}
    sums = intervals.clade_sums(toured, spark.createDataFrame(list(value.items()), "leaf string, v long"), ["v"])
    assert {r["node"]: r["v"] for r in sums.collect()} == {k: sum(value.get(x, 0) for x in below[k] & leaves) for k in parent}

    sets = [(g, rng.choice(list(parent))) for g in range(25) for _ in range(rng.randint(1, 4))] + [(99, None), (None, "n0"), (98, "nowhere")]
    got = {r["g"]: (r["lca"], r["n_members"]) for r in intervals.lowest_common(toured, spark.createDataFrame(sets, "g int, m string"), "g", "m").collect()}
    for g in range(25):
        members = {m for h, m in sets if h == g}
        shared = set.intersection(*(set(up(parent, m)) for m in members))
        assert got[g] == (max(shared, key=lambda x: len(up(parent, x))), len(members))
    assert set(got) == set(range(25))

    marks = [(t, k) for t in (1, 2) for k in parent if rng.random() < 0.2 * t]
    if marks:
        near = intervals.nearest(nodes, spark.createDataFrame([*marks, marks[0]], "t int, node string"), ["t"])
        want = {(t, k): next(((x, i) for i, x in enumerate(up(parent, k)) if (t, x) in marks), (None, None)) for t in {t for t, _ in marks} for k in parent}
        assert {(r["t"], r["node"]): (r["found"], r["steps"]) for r in near.collect()} == want


def test_no_tree(spark):
    for rows in ([("a", "b"), ("b", "a"), ("c", None)], [("a", None), ("b", None)]):
        df = spark.createDataFrame([(*r, 1.0) for r in rows], "node string, parent string, length double")
        with pytest.raises((ValueError, PySparkException)):
            intervals.tour(df).collect()
    assert intervals.levels(spark.createDataFrame([("a", None, 1.0), ("b", None, 1.0)], "node string, parent string, length double")).where("depth = 0").count() == 2
