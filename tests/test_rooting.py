"""Rooting, pruning and resolving against walks over dicts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import rooting
from sparkloom.session import materialize

SCHEMA = "node string, parent string, length double"


def forest(seed, n, trees=1, shape="random"):
    r, rows = random.Random(seed), []
    for t in range(trees):
        rows.append((f"t{t}n0", None, None))
        for i in range(1, n):
            p = {"random": r.randrange(i), "comb": i - 1 if i % 2 else max(0, i - 2), "star": 0, "binary": (i - 1) // 2}[shape]
            rows.append((f"t{t}n{i}", f"t{t}n{p}", r.choice([None, 0.0, *(k / 8 for k in range(1, 30))])))
    return rows


def ways(rows):
    """Distances between all nodes of a tree given by its branches."""
    near = {}
    for node, parent, length in rows:
        near.setdefault(node, {})
        if parent is not None:
            near.setdefault(parent, {})
            near[node][parent] = near[parent][node] = length or 0.0
    out = {}
    for a in near:
        todo = [(a, None, 0.0)]
        while todo:
            x, before, d = todo.pop()
            out[a, x] = d
            todo += [(y, x, d + w) for y, w in near[x].items() if y != before]
    return out


def tips(rows):
    return {r[0] for r in rows} - {r[1] for r in rows}


def collected(df):
    return [(r["node"], r["parent"], r["length"]) for r in df.collect()]


@pytest.mark.parametrize(("shape", "n", "trees"), [("random", 40, 3), ("comb", 61, 1), ("star", 20, 2), ("binary", 31, 2)])
def test_midpoint(spark, shape, n, trees):
    rows = forest(n, n, trees, shape)
    got = collected(rooting.midpoint_rooted(spark.createDataFrame(rows, SCHEMA)))
    old, new, leaves = ways(rows), ways(got), tips(rows)
    assert len({r[0] for r in got}) == len(got) and tips(got) == leaves
    # the way between any two nodes that are left is what it was
    for a, b in itertools.combinations(sorted({r[0] for r in got} & {r[0] for r in rows}), 2):
        assert old.get((a, b)) == pytest.approx(new[a, b]) if (a, b) in old else (a, b) not in new
    for t in range(trees):
        root = f"t{t}n0/mid"
        kids = [r[0] for r in got if r[1] == root]
        mine = [x for x in leaves if x.startswith(f"t{t}n")]
        widest = max(old[a, b] for a in mine for b in mine)
        assert [r for r in got if r[0] == root] == [(root, None, None)] and len(kids) == 2
        sides = [max(new[root, x] for x in mine if new[root, x] == pytest.approx(new[root, k] + new[k, x])) for k in kids]
        assert sides == [pytest.approx(widest / 2)] * 2


def test_midpoint_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    # a known one: 9 and 1 apart from the root, so the root moves 4 along the longer
    assert sorted(collected(rooting.midpoint_rooted(make([("r", None, None), ("a", "r", 9.0), ("b", "r", 1.0)])))) == [("a", "r/mid", 5.0), ("b", "r/mid", 5.0), ("r/mid", None, None)]
    # a root with one child is no leaf
    assert sorted(collected(rooting.midpoint_rooted(make([("q", None, None), ("r", "q", 7.0), ("a", "r", 9.0), ("b", "r", 1.0)])))) == [("a", "r/mid", 5.0), ("b", "r/mid", 5.0), ("r/mid", None, None)]
    for same in ([("r", None, None)], [("r", None, None), ("a", "r", 0.0), ("b", "r", None)]):
        assert sorted((a, b, c or None) for a, b, c in collected(rooting.midpoint_rooted(make(same)))) == sorted((a, b, c or None) for a, b, c in same)
    assert collected(rooting.midpoint_rooted(make([]))) == []
    with pytest.raises(ValueError, match="negative"):
        rooting.midpoint_rooted(make([("r", None, None), ("a", "r", -1.0)]))
    with pytest.raises(ValueError, match="parent"):
        rooting.midpoint_rooted(make([("r", None, None), ("a", "x", 1.0), ("b", "r", 1.0), ("c", "r", 1.0)]))


@pytest.mark.parametrize(("shape", "n"), [("random", 50), ("comb", 41), ("star", 12), ("binary", 63)])
def test_pruned_and_resolved(spark, shape, n):
    rows = forest(n + 1, n, 1, shape)
    r = random.Random(3)
    leaves = sorted(tips(rows))
    keep = r.sample(leaves, max(2, len(leaves) // 2))
    nodes = spark.createDataFrame(rows, SCHEMA)
    got = collected(rooting.pruned(nodes, spark.createDataFrame([(k,) for k in [*keep, keep[0], "nowhere"]], "node string")))
    old, new = ways(rows), ways(got)
    assert tips(got) == set(keep)
    kids = [sum(x[1] == node for x in got) for node, _, _ in got]
    assert 1 not in kids and [p for _, p, _ in got].count(None) == 1
    assert all(new[a, b] == pytest.approx(old[a, b]) for a in keep for b in keep)

    two = collected(rooting.resolved(nodes))
    after = ways(two)
    assert len({x[0] for x in two}) == len(two) and tips(two) == set(leaves)
    assert max(sum(x[1] == node for x in two) for node, _, _ in two) <= 2
    names = {x[0] for x in rows}
    assert all(after[a, b] == pytest.approx(old[a, b]) for a in names for b in names)
    single = {node for node, _, _ in rows if sum(x[1] == node for x in rows) == 1}
    assert {x[0] for x in collected(rooting.without_unary(nodes))} == names - single


def test_species_tree(spark):
    rows = [("r", None, None, ""), ("x", "r", 1.0, ""), ("a", "x", 1.0, "Homo sapiens"), ("b", "x", 2.0, "10090"), ("c", "r", 3.0, "Unknown thing"), ("d", "r", 4.0, "7227"), ("e", "r", 5.0, "562")]
    nodes = spark.createDataFrame(rows, SCHEMA + ", name string")
    names = spark.createDataFrame([("Homo sapiens", 9606), ("Pan", 9598)], "name string, id long")
    seen = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    got = {(r["node"], r["parent"], r["length"], r["name"]) for r in rooting.species_tree(nodes, seen(9606, 10090, 7227, 1), names).collect()}
    assert got == {("r", None, None, None), ("x", "r", 1.0, None), ("a", "x", 1.0, "9606"), ("b", "x", 2.0, "10090"), ("d", "r", 4.0, "7227")}
    # three at the root: one new node
    got = rooting.species_tree(nodes, seen(9606, 10090, 7227, 562), names).collect()
    assert len(got) == 7 and {r["name"] for r in got} == {None, "9606", "10090", "7227", "562"} and [r["length"] for r in got if r["node"] == "r/2"] == [0.0]
    # one survivor: the taxonomy stands in, observed inner nodes with it
    taxonomy = spark.createDataFrame([("1", None), ("2", "1"), ("562", "2"), ("83333", "562"), ("3", "1"), ("9606", "3"), ("4", "1")], "node string, parent string")
    got = {(r["node"], r["parent"], r["length"], r["name"]) for r in rooting.species_tree(nodes, seen(562, 83333, 9606), None, taxonomy).collect()}
    assert got == {("1", None, None, None), ("562", "1", 2.0, "562"), ("83333", "562", 1.0, "83333"), ("9606", "1", 2.0, "9606")}
    with pytest.raises(ValueError, match="fewer than two"):
        rooting.species_tree(nodes, seen(562), names)
    with pytest.raises(ValueError, match="fewer than two"):
        rooting.species_tree(nodes, seen(), names, taxonomy)


def test_order_is_not_asked_of_roots(spark):
    # the root in one file with others, so that no statistics of a file leave it out
    rows = spark.createDataFrame([("root", None, None), *((f"n{i}", "root", 1.0) for i in range(5))], SCHEMA).coalesce(1)
    got = collected(rooting.resolved(materialize(rows), F.substring("node", 2, 9).cast("long")))
    places = {"n0": "root/2", "n1": "root/3", "n2": "root/3", "n3": "root/4", "n4": "root/4", "root": None, "root/2": "root", "root/3": "root", "root/4": "root/2"}
    assert {a: b for a, b, _ in got} == places
