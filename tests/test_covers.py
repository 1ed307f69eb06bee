"""Set cover and sweeps of partitions against plain procedures."""

import random

import numpy as np
import pytest

from sparkloom.operators import covers, intervals


def plain_cover(rows):
    """One member at a time."""
    sets, taken = {}, {}
    for c, m in rows:
        sets.setdefault(c, set()).add(m)
    while True:
        have = {}
        for c, s in sets.items():
            for m in s:
                have.setdefault(m, set()).add(c)
        if alone := {min(s) for s in sets.values() if len(s) == 1}:
            taken |= dict.fromkeys(alone, "essential")
            sets = {c: s for c, s in sets.items() if not s & alone}
        elif fewer := {a for a in have for b in have if have[a] < have[b]}:
            sets = {c: s - fewer for c, s in sets.items()}
        elif larger := {d for c in sets for d in sets if sets[c] < sets[d]}:
            sets = {c: s for c, s in sets.items() if c not in larger}
        else:
            break
    while sets:
        count = {}
        for s in sets.values():
            for m in s:
                count[m] = count.get(m, 0) + 1
        best = min(count, key=lambda m: (-count[m], m))
        taken[best] = "greedy"
        sets = {c: s for c, s in sets.items() if best not in s}
    return taken


@pytest.mark.parametrize(("seed", "clusters", "members", "size"), [(1, 25, 12, 4), (2, 40, 30, 3), (3, 12, 6, 2)])
def test_set_cover(spark, seed, clusters, members, size):
    r = random.Random(seed)
    rows = [(c, r.randrange(members)) for c in range(clusters) for _ in range(r.randint(2, size))]
    df = spark.createDataFrame([*rows, rows[0], (None, 3), (99, None)], "cluster int, member int")
    got = {x["member"]: x["by"] for x in covers.set_cover(df).collect()}
    assert got == plain_cover(rows) and all(any(m in got for d, m in rows if d == c) for c, _ in rows)


def test_cover_of_cycles_and_nothing(spark):
    ring = [(i, m) for i in range(7) for m in (i, (i + 1) % 7)]  # nothing to reduce
    got = {x["member"]: x["by"] for x in covers.set_cover(spark.createDataFrame(ring, "cluster int, member int")).collect()}
    assert got == plain_cover(ring) and set(got.values()) == {"greedy"}
    assert covers.set_cover(spark.createDataFrame([], "cluster int, member int")).count() == 0


def test_partition_sweep(spark):
    r = random.Random(4)
    parent = {"n0": None} | {f"n{i}": f"n{r.randrange(max(1, i // 2))}" for i in range(1, 80)}
    score = {f"n{i}": r.randrange(1000) for i in range(80) if r.random() < 0.7} | {"absent": 999}
    nodes = spark.createDataFrame([(k, p, 1.0) for k, p in parent.items()], "node string, parent string, length double")
    out = intervals.partition_sweep(nodes, spark.createDataFrame(list(score.items()), "node string, score int"), [0.5, 0.9]).collect()
    assert len(out) == 2
    for row in out:
        cut = np.quantile(list(score.values()), row["share"])
        marked = {k for k, s in score.items() if s >= cut}
        leaves = set(parent) - set(parent.values())
        sizes = {}
        for x in leaves:
            y = x
            while y is not None and y not in marked:
                y = parent[y]
            sizes[y] = sizes.get(y, 0) + 1
        assert row["cutoff"] == pytest.approx(cut) and row["n_marked"] == len(marked) and row["n_clades"] == len(marked & set(parent)) + 1
        assert (row["n_leaves"], row["root_leaves"], row["n_multiple"], row["n_single"]) == (len(leaves), sizes.get(None, 0), sum(v > 1 for v in sizes.values()), sum(v == 1 for v in sizes.values()))
        assert (row["largest"], row["median_size"]) == (max(sizes.values()), np.median(list(sizes.values())))
        assert row["other_share"] == pytest.approx(1 - sizes.get(None, 0) / len(leaves))


def test_cover_takes_many_in_a_round(spark):
    r = random.Random(8)
    rows = [(c, m) for c in range(600) for m in r.sample(range(60), 4)]
    df = spark.createDataFrame(rows, "cluster int, member int")
    spark.sparkContext.setJobGroup("cover", "set cover")
    try:
        got = {x["member"]: x["by"] for x in covers.set_cover(df).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == plain_cover(rows) and len(got) > 20
    # a round for each member taken or two made hundreds
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("cover")) < 100


@pytest.mark.parametrize("block", [12, 160])
def test_cover_by_blocks(spark, monkeypatch, block):
    """Blocks smaller than parts, than levels, and parts that share one."""
    monkeypatch.setattr(covers, "BLOCK", block)
    r = random.Random(block)
    rows = [(100 * g + c, f"{g}-{m}") for g in range(4) for c in range(30) for m in r.sample(range(12), 3)]
    rows += [(1000 + i, f"r{m:02}") for i in range(9) for m in (i, (i + 1) % 9)]
    got = {x["member"]: x["by"] for x in covers.set_cover(spark.createDataFrame(rows, "cluster int, member string")).collect()}
    assert got == plain_cover(rows)
