"""Results that were wrong once, each on the layout that showed it."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom.operators import nulls, residues, scoring, stats, summaries, trees
from sparkloom.sources import readers

LOSS = """<recPhylo xmlns="http://www.recg.org"><spTree/><recGeneTree><phylogeny rooted="true">
<clade><name>r</name><eventsRec><speciation speciesLocation="S0"/></eventsRec>
  <clade><name>loss</name><eventsRec><loss speciesLocation="S1"/></eventsRec></clade>
  <clade><name>NULL</name><eventsRec><branchingOut speciesLocation="S2"/></eventsRec>
    <clade><name>NULL</name><eventsRec><speciation/></eventsRec>
      <clade><name>g2</name></clade><clade><name>g1</name></clade></clade>
    <clade><name>loss</name></clade></clade></clade></phylogeny></recGeneTree></recPhylo>"""


def test_losses_lie_beside_their_survivors(spark, tmp_path):
    for name, text in (("a.xml", LOSS), ("b.xml", LOSS), ("c.xml", "<broken"), ("d.xml", "<recPhylo><recGeneTree><clade><name>g1</name></clade></recGeneTree></recPhylo>")):
        (tmp_path / name).write_text(text)
    found = readers.losses(spark, str(tmp_path))
    rows = sorted((r["file"], r["kind"] or "", tuple(r["survivors"] or ())) for r in found.collect())
    both = [("SL", ("g1", "g2")), ("TL", ("g1", "g2"))]
    assert rows == [(f, *x) for f in ("a.xml", "b.xml") for x in both] + [("c.xml", "", ()), ("d.xml", "", ())]
    branches = spark.createDataFrame([("n1", ["g1", "g2"]), ("n2", ["g1"])], "node string, survivors array<string>")
    got = readers.loss_frequencies(found, branches).collect()
    # three files could be read
    assert [tuple(r) for r in got] == [("n1", 2, 2, 4, pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(4 / 3))]


def test_fasta_headers_and_repeats(spark, tmp_path):
    def w(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    for i, text in enumerate((">\nQQQ\n", ">a\nMK\n>\nQQQ\n", "MKT\n>a\nMK\n", "MKT\n")):
        with pytest.raises((ValueError, PySparkException)):
            readers.fasta(spark, w(f"bad{i}.fa", text)).collect()
    blank = readers.fasta(spark, w("blank.fa", "\n\n>a one\nM K\n\nT\n>b\n")).collect()
    assert [tuple(r) for r in blank] == [("a", "a one", "MKT"), ("b", "b", "")]
    w("x1.fa", ">a\nMMMM\n>b\nMK\n>a\nKKK\n")
    w("x2.fa", ">b\nT\n")
    twice = readers.last_wins(readers.fasta(spark, str(tmp_path / "x*.fa"), places=True))
    assert {r["id"]: r["sequence"] for r in twice.collect()} == {"a": "KKK", "b": "T"}


def plain_cut(nodes, k):
    """Every distinct depth, by a walk from the root."""
    kids, length = {}, {}
    for n, p, x in nodes:
        kids.setdefault(p, []).append(n)
        length[n] = x

    def count(t):
        n, todo = 0, [(kids[None][0], 0.0)]
        while todo:
            x, up = todo.pop()
            d = up + length[x]
            if up < t <= d or (x not in kids and up < t):
                n += 1
            else:
                todo += [(c, d) for c in kids.get(x, [])]
        return n

    at, todo = set(), [(kids[None][0], 0.0)]
    while todo:
        x, up = todo.pop()
        at.add(up + length[x])
        todo += [(c, up + length[x]) for c in kids.get(x, [])]
    return min((t for t in at if count(t) >= k), default=math.inf)


def test_depth_cut(spark):
    star = [("r", None, 0.0), *((f"x{i}", "r", 0.5) for i in range(50)), ("far", "r", 100.0)]
    deep = [("r", None, 0.0), ("a", "r", 1.0), ("b", "r", 3.0), ("c", "a", 1.0), ("d", "a", 4.0), ("e", "c", 0.25), ("f", "c", 2.0), ("g", "b", 1.0), ("h", "b", 0.5)]
    for nodes, ks in ((star, (1, 51, 52)), (deep, (1, 2, 3, 4, 5, 6))):
        df = spark.createDataFrame(nodes, "node string, parent string, length double")
        d = trees.depths(trees.ancestors(df))
        for k in ks:
            assert trees.depth_cut(d, df, k) == plain_cut(nodes, k), k


def test_empty_samples_and_null_groups(spark):
    rows = spark.createDataFrame([(1.0, True), (2.0, True)], "v double, g boolean")
    r = stats.two_samples(rows, "v", F.col("g")).first()
    assert (r["n1"], r["n0"]) == (2, 0) and r["ks"] is None and r["u_p"] is None and r["delta"] is None and r["u"] is None
    assert stats.two_samples(rows.limit(0), "v", F.col("g")).first()["ks"] is None
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 5.0), ("x", 900.0), ("x", 6.0), ("x", 7.0)], "g string, v double")
    assert {r["g"]: (r["n"], r["median"]) for r in summaries.described(df, "v", ["g"]).collect()} == {None: (2, 2.0), "x": (4, 6.5)}
    assert sorted(r["v"] for r in summaries.without_outliers(df, "v", ["g"]).collect()) == [1.0, 3.0, 5.0, 6.0, 7.0]
    assert {r["g"]: r["n"] for r in summaries.flat_and_adjusted(df, "v", 0.5, "g").collect()} == {None: 2, "x": 4}
    calls = spark.createDataFrame([("e", "D", None, True)], "era string, event string, node string, hit boolean")
    assert all(r["rate"] is None for r in summaries.temporal_rates(calls, "hit", "node", "era", "event").collect())
    maps = df.select("g", "v", F.create_map(F.lit("k"), "v").alias("m"))
    assert sorted(r["m"]["k"] for r in summaries.first_rows(maps, ["g"], [F.col("v")]).collect()) == [1.0, 5.0]


def test_alphas_come_back_as_given(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("s"))
    assert sorted(r["alpha"] for r in nulls.expected_ratio(df, df, "s", [0.1, 0.05, 0.3]).collect()) == [0.05, 0.1, 0.3]


def test_distances_by_a_table(spark):
    df = spark.createDataFrame([("a", "S"), ("S", "A"), ("A", "A"), ("A", "W"), (None, "A")], "x string, y string")
    got = [r["distance"] for r in residues.annotate_shifts(df, "x", "y", {("A", "S"): 58}).collect()]
    assert got == [58.0, 58.0, 0.0, 0.0, None]


def test_legacy_scores_take_the_whole_matrix(spark):
    """A matrix with thousands of pairs of other letters, the ones needed last."""
    other = spark.range(3000).select(F.concat(F.lit("z"), "id").alias("a"), F.lit("q").alias("b"), F.lit(9.0).alias("value"))
    matrix = other.unionByName(spark.createDataFrame([("A", "C", -2.0), ("A", "A", 4.0)], "a string, b string, value double"))
    states = spark.createDataFrame([("l", 1, [1.0, 0.0]), ("r", 1, [0.0, 1.0])], "node string, position int, probs array<double>")
    rc = spark.createDataFrame([("l", 1, 0.5), ("r", 1, 0.5)], "node string, position int, rc double")
    pairs = spark.createDataFrame([("l", "r")], "left string, right string")
    assert scoring.legacy_scores(pairs, states, rc, matrix, "AC").first()["score"] == pytest.approx(0.5)
    twice = matrix.unionByName(spark.createDataFrame([("a", "c", 1.0)], "a string, b string, value double"))
    with pytest.raises(ValueError):
        scoring.legacy_scores(pairs, states, rc, twice, "AC")


def test_bootstrap_of_clusters(spark):
    values = [float(i % 17) for i in range(120)]
    df = spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(values)] + [("none", None)], "k string, v double")
    a, b = (nulls.bootstrap(x, "v", "k", 400, 5).first() for x in (df, df.repartition(9)))
    mean = sum(values) / 120
    error = (sum((v - mean) ** 2 for v in values) / 120) ** 0.5 / 120**0.5
    assert a["n"] == 120 and abs(a["mean"] - mean) < 0.3 * error
    assert 3.2 * error < a["hi"] - a["lo"] < 4.7 * error and a["lo"] < mean < a["hi"]
    assert tuple(a) == pytest.approx(tuple(b)) and nulls.bootstrap(df, "v", "k", 400, 6).first()["lo"] != a["lo"]
    one = nulls.bootstrap(df.where("k = 'k3'"), "v", "k", 10, 1).first()
    assert (one["mean"], one["lo"], one["hi"], one["n"]) == (3.0, 3.0, 3.0, 1)
    assert nulls.bootstrap(df.limit(0), "v", "k", 10, 1).count() == 0
