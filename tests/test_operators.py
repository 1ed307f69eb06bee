"""Operators on small fixtures with values worked out by hand or by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import columns, nulls, ranks, scoring, stats, summaries, trees
from sparkloom.sources import readers, writers


def tail(k, n, K, N):
    return sum(math.comb(K, i) * math.comb(N - K, n - i) for i in range(k, min(n, K) + 1)) / math.comb(N, n)


def test_hypergeometric_and_fisher_at_any_size(spark):
    cases = [(0, 0, 0, 0), (3, 5, 10, 50), (8, 20, 40, 169), (30, 60, 120, 500), (7, 100, 3000, 90000), (5, 4, 9, 20), (0, 7, 3, 169)]
    df = spark.createDataFrame([*cases, (None, 1, 1, 2)], "k long, n long, m long, t long")
    for r in stats.hypergeometric_tail(df, "k", "n", "m", "t").collect():
        want = None if r["k"] is None else tail(r["k"], r["n"], r["m"], r["t"]) if r["k"] <= r["n"] else 0.0
        assert r["p"] == pytest.approx(want, rel=1e-9, abs=1e-12) if want is not None else r["p"] is None
    f = stats.fisher(spark.createDataFrame([(8, 2, 1, 5), (3, 0, 2, 2), (0, 0, 1, 1)], "a long, b long, c long, d long"), "a", "b", "c", "d").collect()
    assert f[0]["odds_ratio"] == 20 and f[0]["p"] == pytest.approx(tail(8, 10, 9, 16)) and f[1]["odds_ratio"] == math.inf and f[2]["odds_ratio"] is None


@pytest.mark.parametrize("n_positions", [169, 500])
def test_enrichment_and_binomial_have_rows_on_long_grids(spark, n_positions):
    rows = [(i, f"d{i * 6 // n_positions}", i % 7 == 0 or i < 30) for i in range(n_positions)]
    out = {r["d"]: r for r in summaries.enrichment(spark.createDataFrame(rows, "i int, d string, hot boolean"), "d", "hot").collect()}
    assert len(out) == 6
    K = sum(r[2] for r in rows)
    for d, r in out.items():
        n, k = sum(x[1] == d for x in rows), sum(x[1] == d and x[2] for x in rows)
        assert (r["n"], r["k"]) == (n, k) and r["p"] == pytest.approx(tail(k, n, K, n_positions), rel=1e-8)
        assert r["fold"] == pytest.approx(k / n / (K / n_positions))
    ps = sorted(r["p"] for r in out.values())
    for r in out.values():
        assert r["q"] == pytest.approx(min(1.0, min(p * 6 / (i + 1) for i, p in enumerate(ps) if p >= r["p"])))
    b = stats.binomial_critical(spark.createDataFrame([(n_positions, 0.1), (n_positions, 0.0)], "n long, p double"), "n", "p", F.lit(0.05), "k").collect()
    sf = lambda k: sum(math.comb(n_positions, i) * 0.1**i * 0.9 ** (n_positions - i) for i in range(k, n_positions + 1))
    assert b[0]["k"] == next(k for k in range(n_positions + 2) if sf(k) < 0.05) and b[1]["k"] is None


def test_clopper_pearson():
    assert stats.clopper_pearson(0, 10) == pytest.approx((0, 0.3084971), abs=1e-6)
    assert stats.clopper_pearson(3, 10) == pytest.approx((0.0667395, 0.6524529), abs=1e-6)


def test_percentiles_and_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), float(rng.choice([rng.randint(0, 5), rng.random()]))) for _ in range(700)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["share"]): r["percentile"] for r in ranks.percentiles(df, "v", [0.0, 0.3, 0.99, 1.0], ["g"]).collect()}
    want = {(g, s): float(np.quantile([v for h, v in rows if h == g and v is not None], s)) for g in ("a", "b", None, "c") for s in (0.0, 0.3, 0.99, 1.0)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    r = stats.two_samples(df, "v", F.col("g") == "a").first()
    x, y = [v for g, v in rows if g == "a"], [v for g, v in rows if g not in ("a", None) and v is not None]
    assert r["u"] == sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    grid = sorted(set(x + y))
    assert r["ks"] == pytest.approx(max(abs(np.mean(np.array(x) <= t) - np.mean(np.array(y) <= t)) for t in grid))
    assert 0 <= r["u_p"] <= 1


def test_sweep_against_brute_force(spark):
    rng = np.random.default_rng(5)
    obs = np.round(rng.normal(0.3, 1, 300), 1)
    null = np.round(rng.normal(0, 1, (7, 300)), 1)
    o = spark.createDataFrame([(float(x),) for x in obs] + [(None,), (float("nan"),)], "stat double")
    n = spark.createDataFrame([(r, float(x)) for r in range(7) for x in null[r]] + [(7, None)], "replicate int, stat double")
    got = {r["t"]: r for r in nulls.sweep(o, n, "stat").collect()}
    assert sorted(got) == sorted(set(obs.tolist()))
    for t, r in got.items():
        c, v = (obs >= t).sum(), np.append((null >= t).sum(axis=1), 0)
        assert (r["n_observed"], r["n_null"]) == (c, v.sum())
        assert r["fdp"] == pytest.approx(np.quantile(v / c, 0.9)) and r["fdp_mean"] == pytest.approx((v / c).mean())
    swept = spark.createDataFrame(list(got.values()))
    cut = {r["q"]: r for r in nulls.threshold_at(swept, spark.createDataFrame([(1e-9,), (5.0,)], "q double")).collect()}
    assert cut[5.0]["threshold"] == min(t for t, r in got.items() if r["fdp"] <= 5) and (cut[1e-9]["threshold"] is None or cut[1e-9]["fdp"] == 0)
    assert nulls.sweep(o.where("false"), n, "stat").count() == 0
    e = {(r["threshold"], r["replicate"]): r["n"] for r in nulls.exceedances(n, "stat", spark.createDataFrame([(0.0,), (1.0,), (9.0,)], "threshold double")).collect()}
    assert e == {(t, r): int((null[r] >= t).sum()) if r < 7 else 0 for t in (0.0, 1.0, 9.0) for r in range(8)}


def test_tail_interpolates(spark):
    t = nulls.thinned(nulls.tail(spark.createDataFrame([(float(i),) for i in range(100)], "s double"), "s"), 40)
    anchors = sorted((r["t"], r["survival"]) for r in t.collect())
    assert len(anchors) <= 40 and anchors[0][0] == 0 and anchors[-1][0] == 99
    xs = [-5.0, 0.0, 3.3, 50.0, 98.7, 99.0, 500.0]
    got = {r["x"]: r["s"] for r in nulls.interpolated(spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double"), t, "x", "t", "survival", "s", log=True).collect()}
    want = np.exp(np.interp(xs, [a for a, _ in anchors], np.log([s for _, s in anchors])))
    assert [got[x] for x in xs] == pytest.approx(want.tolist()) and got[None] is None


def test_replicates_that_do_not_match(spark, tmp_path):
    o = spark.createDataFrame([("a", 1), ("b", 2)], "node string, position int")
    n = spark.createDataFrame([(r, *k, 0.5) for r in (0, 1) for k in (("a", 1), ("b", 2))], "replicate int, node string, position int, s double")
    assert {tuple(r) for r in nulls.check_replicates(o, n, ["node", "position"]).collect()} == {(0, 2, 0, 0, 0), (1, 2, 0, 0, 0)}
    for bad in (n.where("node = 'a' or replicate = 0"), n.union(n.limit(1)), n.withColumn("node", F.lit("z"))):
        with pytest.raises(ValueError, match="match"):
            nulls.check_replicates(o, bad, ["node", "position"])
    writers.replicates(n, f"{tmp_path}/r", ["node", "position"], o)
    assert readers.replicates(spark, f"{tmp_path}/r", ["s"], 2).count() == 4
    with pytest.raises(ValueError, match="length"):
        readers.replicates(spark, f"{tmp_path}/r", ["s"], 3)


NEWICK = "(((L1:1,L2:1)Node2:0.5,L3:1)Node1:0.25,((R1:1,R2:1)Node4:0.1,(R3:1,R4:1)Node5:2)Node3:0.25)Node0;"


@pytest.fixture(scope="module")
def tree(spark):
    return readers.trees(spark.createDataFrame([(1, NEWICK)], "tree int, value string"), "tree", "value").cache()


def test_trees(spark, tree):
    names = {r["node"]: r["name"] for r in tree.collect()}
    ids = {v: k for k, v in names.items()}
    paths = trees.ancestors(tree)
    deep = {names[r["node"]]: (r["depth"], r["distance"]) for r in trees.depths(paths).collect()}
    assert deep["Node0"] == (0, 0) and deep["Node3"] == (1, 0.25) and deep["L1"] == (3, 1.75)
    closure = trees.leaf_closure(tree, paths)
    sizes = trees.clade_sizes(closure)
    assert {names[r["node"]]: r["clade_size"] for r in sizes.collect() if r["clade_size"] > 1} == {"Node0": 7, "Node1": 3, "Node2": 2, "Node3": 4, "Node4": 2, "Node5": 2}
    sets = spark.createDataFrame([("x", ids["L1"]), ("x", ids["L3"]), ("y", ids["R1"]), ("y", ids["L2"]), ("z", ids["R3"])], "g string, m long")
    assert {r["g"]: names[r["lca"]] for r in trees.lowest_common(paths, sets, "g", "m").collect()} == {"x": "Node1", "y": "Node0", "z": "R3"}
    event = tree.withColumn("event", F.when(F.col("name").isin("Node0", "Node3"), "D"))
    status = {names[r["node"]]: (r["size_left"], r["size_right"], r["size_total"], r["status"]) for r in trees.scoring_status(trees.splits(event, sizes), ["S", "D", "T"], 3).collect()}
    assert status["Node0"] == (3, 4, 7, "scored") and status["Node3"] == (2, 2, 4, "small") and status["Node2"][3] == "unresolved"
    part = trees.clade_partition(paths, tree.where("name in ('Node3', 'Node4')"))
    assert {names[r["node"]]: names.get(r["clade"]) for r in part.collect() if names[r["node"]] in ("R1", "R3", "Node4", "L1")} == {"R1": "Node4", "R3": "Node3", "Node4": "Node4", "L1": None}
    kept = trees.pruned(tree, paths, tree.where("name in ('L1', 'R1', 'R2')"))
    assert {names[r["node"]]: (names.get(r["parent"]), r["length"]) for r in kept.collect()} == {"Node0": (None, None), "L1": ("Node0", 1.75), "Node4": ("Node0", 0.35), "R1": ("Node4", 1.0), "R2": ("Node4", 1.0)}
    assert {names[r["node"]] for r in trees.swappable(tree).collect()} == {"Node1", "Node2", "Node3", "Node4", "Node5"}
    assert 0.25 < trees.depth_cut(trees.depths(paths), tree, 4) <= 0.75 and trees.depth_cut(trees.depths(paths), tree, 99) == math.inf
    text = writers.newick(tree).first()["text"]
    assert text == NEWICK


def test_deep_chain_and_cycle(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, 1.0) for i in range(300)], "node long, parent long, length double")
    deep = {r["node"]: r["distance"] for r in trees.depths(trees.ancestors(chain)).collect()}
    assert deep == {i: float(i) for i in range(300)}
    with pytest.raises(ValueError, match="cycle"):
        trees.ancestors(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "node long, parent long, length double"))


def test_signatures_and_complements(spark, tree):
    other = readers.trees(spark.createDataFrame([(1, "(L3,((L2,L1)A,(R4,(R3,(R1,R2)B)C)D)E)Z;")], "tree int, value string"), "tree", "value")
    signed = []
    for t in (tree, other):
        c = trees.leaf_closure(t, trees.ancestors(t))
        signed.append(trees.signatures(c, t.select(F.col("node").alias("leaf"), "name")))
    names = [{r["node"]: r["name"] for r in t.collect()} for t in (tree, other)]
    got = {(names[0][r["node"]], names[1][r["match"]], r["by"]) for r in trees.match_signatures(*signed, complements=True).collect()}
    assert {("Node2", "A", "same"), ("Node4", "B", "same"), ("Node3", "D", "same"), ("Node0", "Z", "same")} <= got
    assert ("Node1", "D", "complement") in got and not any(a == "Node5" for a, _, _ in got)


def rc_loop(column, value):
    w = [x.upper() for x in column if x not in "-."]
    if len(w) < 2:
        return float(len(w))
    v = [value(a, b) for i, a in enumerate(w) for b in w[:i]]
    return min(1.0, max(0.0, (sum(v) / len(v) + 4) / 15))


def test_recent_conservation_against_the_pair_loop(spark):
    rng = random.Random(4)
    letters = scoring.ALPHABET + scoring.ALPHABET.lower() + "Xx-."
    # a rule in place of a published matrix: M with itself 5, other equal letters 4, else by distance in the alphabet
    value = lambda a, b: 0.0 if "X" in (a, b) else 5.0 if a == b == "M" else 4.0 if a == b else 1.0 - (scoring.ALPHABET.index(a) + scoring.ALPHABET.index(b)) % 4
    matrix = spark.createDataFrame([(a, b, value(a, b)) for i, a in enumerate(scoring.ALPHABET) for b in scoring.ALPHABET[: i + 1]], "a string, b string, value double")
    cols = [[rng.choice(letters) for _ in range(rng.randint(0, 10))] for _ in range(60)] + [list("MMM"), ["-"], ["A"]]
    rows = [(j, p, x) for p, c in enumerate(cols) for j, x in enumerate(c)]
    closure = spark.createDataFrame([("n", j) for j in range(10)], "node string, leaf int")
    counts = scoring.column_counts(closure, spark.createDataFrame(rows, "leaf int, position int, residue string"))
    got = {r["position"]: r["rc"] for r in scoring.recent_conservation(counts, matrix).collect()}
    for p, c in enumerate(cols):
        assert got.get(p, 0.0) == pytest.approx(rc_loop(c, value), abs=1e-9)
    assert got[60] == pytest.approx(0.6)


def test_fact_table(spark, tree):
    names = {r["node"]: r["name"] for r in tree.collect()}
    ids = {v: k for k, v in names.items()}
    probs = lambda **p: [p.get(a, 0.0) for a in scoring.ALPHABET]
    states = spark.createDataFrame([(ids["Node1"], 1, "A", probs(A=0.7, R=0.3)), (ids["Node3"], 1, "a", probs(A=0.9, R=0.1)), (ids["Node1"], 2, "R", probs(R=0.6)), (ids["Node3"], 2, "G", probs(G=0.8, R=0.2)), (ids["Node1"], 3, "-", probs()), (ids["Node3"], 3, "G", probs(G=1.0))], "node long, position int, state string, probs array<double>")
    leaves = [i for n, i in ids.items() if n[0] in "LR"]
    residues = spark.createDataFrame([(i, p, "M") for i in leaves for p in (1, 2)], "leaf long, position int, residue string")
    paths = trees.ancestors(tree)
    closure = trees.leaf_closure(tree, paths)
    split = trees.scoring_status(trees.splits(tree.withColumn("event", F.lit("D")), trees.clade_sizes(closure)), ["D"], 3, states)
    matrix = spark.createDataFrame([("M", "M", 5.0)], "a string, b string, value double")
    out = {r["position"]: r for r in scoring.fact_table(tree, closure, residues, states, split, trees.depths(paths), matrix).collect()}
    assert set(out) == {1, 2}
    r = out[1]
    assert (r["ac"], r["p_ac_left"], r["p_ac_right"], r["score_left"], r["clade_total"], r["distance_from_root"]) == (1, 0.9, 0.7, pytest.approx(0.6 - 0.9), 7, 0.0)
    r = out[2]
    assert (r["ac"], r["p_ac_left"], r["p_ac_right"], r["score_right"]) == (-1, 0.8, 1.0, pytest.approx(1.6))
    with pytest.raises(ValueError, match="no states"):
        scoring.require_states(spark.createDataFrame([(ids["Node1"], ids["Node5"])], "left long, right long"), states)
    seq = {r["node"]: r["sequence"] for r in scoring.rebuilt_sequences(states, 4).collect()}
    assert seq[ids["Node1"]] == "AR-X"


def test_column_statistics(spark):
    rows = [(s, p + 1, c) for s, t in enumerate(["AC-", "AG.", "aTx"]) for p, c in enumerate(t)]
    df = spark.createDataFrame(rows, "leaf int, position int, residue string")
    assert {r["position"]: round(r["occupancy"], 6) for r in columns.gap_occupancy(df).collect()} == {1: 1.0, 2: 1.0, 3: 0.333333}
    counts = df.groupBy("position", "residue").agg(F.count("*").alias("n"))
    e = {r["position"]: r for r in columns.entropies(counts, ["position"], scoring.ALPHABET).collect()}
    assert e[1]["nats"] == pytest.approx(0) and e[2]["bits"] == pytest.approx(math.log2(3)) and e[2]["relative"] == pytest.approx(math.log(3) / math.log(20)) and 3 not in e
    ref = spark.createDataFrame([("A", 0.5), ("C", 0.5)], "residue string, frequency double")
    f = {(r["position"], r["residue"]): r["frequency"] for r in columns.shrunk_frequencies(counts, ref, 0.2, 2).collect()}
    assert f[1, "A"] == pytest.approx(0.9) and f[1, "C"] == pytest.approx(0.1) and f[3, "A"] == 0.5


def test_state_files(spark, tmp_path):
    head = "\t".join(readers.STATE_COLUMNS)
    row = lambda n, s, c: "\t".join([n, str(s), c, *["0.05"] * 20])
    (tmp_path / "a.state").write_text("# made by a test\n" + "\n".join([head, row("Node1", 1, "A"), row("Node1", 2, "G"), row("Node2", 1, "R")]) + "\n")
    df = readers.states(spark, str(tmp_path / "a.state"), spark.createDataFrame([("Node1",)], "node string"))
    assert [(r["node"], r["position"], r["state"], len(r["probs"])) for r in df.orderBy("position").collect()] == [("Node1", 1, "A", 20), ("Node1", 2, "G", 20)]
    (tmp_path / "b.state").write_text(head.replace("p_A", "p_B") + "\n")
    with pytest.raises(ValueError, match="columns"):
        readers.states(spark, str(tmp_path / "b.state"))


def test_text_formats(spark, tmp_path):
    w = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    f = readers.fasta(spark, w("a.fa", ">seqA one OX=7 GN=g\nMK\nT\n>seqB\nMK-\n>seqC\nMXT\n"))
    assert {(r["id"], r["sequence"]) for r in f.collect()} == {("seqA", "MKT"), ("seqB", "MK-"), ("seqC", "MXT")}
    a = readers.alignment(f)
    assert {(r["residue"], r["count"]) for r in a.where("position = 3").groupBy("residue").count().collect()} == {("T", 2), ("-", 1)}
    for bad, what in ((f.union(f), "repeated"), (f.withColumn("sequence", F.concat("sequence", "id")).where("id <> 'x'").withColumn("sequence", F.when(F.col("id") == "seqA", "M").otherwise(F.col("sequence"))), "ragged"), (f.where("false"), "empty")):
        with pytest.raises(ValueError, match=what):
            readers.alignment(bad)
    h = readers.header_fields(spark.createDataFrame([("sp|A0A1|SEQ_A Some protein OS=Homo sapiens OX=1111 GN=abc PE=1",), ("plain",)], "header string")).collect()
    assert (h[0]["accession"], h[0]["name"], h[0]["organism"], h[0]["taxon"], h[0]["gene"]) == ("A0A1", "Some protein", "Homo sapiens", "1111", "abc") and h[1]["accession"] == "plain"
    c = readers.clusters(spark, w("a.clstr", ">Cluster 0\n0\t10aa, >x1... *\n1\t9aa, >x2... at 90%\n>Cluster 1\n0\t5aa, >y... *\n"))
    assert {tuple(r) for r in c.collect()} == {(0, "x1"), (0, "x2"), (1, "y")}
    for s, v in (("s1", "S:40\nD:10\nT:50\n"), ("s2", "S:42\nD:8\n")):
        w(s, v)
    k = readers.key_values(spark, str(tmp_path / "s*"), ["S", "D", "T"])
    assert {r["event"]: r["mean"] for r in readers.event_summary(k, ["S", "D", "T"]).collect()} == {"S": 41, "D": 9, "T": 25}
    r = readers.rates(spark, w("r.tsv", "SITE\tRate\n1\t0.5\n2\t1.5\n"))
    assert [tuple(x) for x in r.orderBy("position").collect()] == [(1, 0.5), (2, 1.5)]
    pdb = "ATOM      1  N   ALA A   5      11.000   1.000   2.000\nATOM      2  CA  ALA A   5      12.000   3.000   4.500\nENDMDL\nATOM      3  CA  ALA A   6      12.000   3.000   4.500\n"
    p = readers.alpha_carbons(spark, w("a.pdb", pdb)).collect()
    assert [(x["chain"], x["residue"], x["name"], x["x"], x["z"]) for x in p] == [("A", 5, "ALA", 12.0, 4.5)]
    t = readers.fields(spark, w("t.txt", "# c\na  b 0.5\nbad\n"), {"donor": "string", "recipient": "string", "frequency": "double"})
    assert [tuple(x) for x in t.collect()] == [("a", "b", 0.5)]
    m = readers.parameters(spark, w("p.txt", "alpha beta\n1.5 2\n")).first()["parameters"]
    assert m == {"alpha": "1.5", "beta": "2"}
    leaf = spark.createDataFrame([("(A:1,(B,C)x[c]:2);",)], "t string").select(readers.leaf_names(F.col("t")).alias("l")).first()["l"]
    assert leaf == ["A", "B", "C"]
    bad = spark.createDataFrame([(1, "(a,b"), (2, "(a,b);")], "k int, t string")
    assert readers.trees(bad, "k", "t", tolerant=True).count() == 3
    writers.reports(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "a int, b double"), str(tmp_path / "j"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()} == {'{"a":1,"b":null}', '{"a":2,"b":0.5}'}
    lines = [r["line"] for r in writers.markdown(spark.createDataFrame([("x", 1), ("y", None)], "a string, b int"), "T").collect()]
    assert lines == ["# T", "", "| a | b |", "| - | - |", "| x | 1 |", "| y |  |"]
