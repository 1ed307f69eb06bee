"""Work that must grow no faster than the tables: rows shuffled are counted."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.jobs import analysis, calibration, divergence
from sparkloom.operators import columns, covers, nulls, ranks, residues, structures, trees


def shuffled(spark, work, broadcast=False):
    """Rows written to shuffles by ``work``; none are broadcast unless allowed."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def total():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    if not broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        work()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return total() - before


def test_contained_sets_compare_equal_ones_once(spark):
    rng = random.Random(1)
    sets = [set(rng.sample(range(12), 3)) for _ in range(1200)]
    sets += [rng.choice(sets) | {12 + i % 3} for i in range(60)]
    df = spark.createDataFrame([(i, m) for i, s in enumerate(sets) for m in s], "k int, m int")
    got = []
    n = shuffled(spark, lambda: got.extend(residues.contained_sets(df, "k", "m").collect()))
    assert sorted(map(tuple, got)) == [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a < b]
    assert n < 60_000


def test_cover_verifies_few_candidates(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(c, m) for c in range(600) for m in rng.sample(range(40), rng.randint(8, 12))], "c int, m int")
    assert shuffled(spark, lambda: [x.count() for x in covers._contained(df, "c", "m")]) < 100_000


def test_percentiles_shuffle_few_values(spark):
    # values spread evenly, or one far away from all others
    for far in (0.0, 1e12):
        rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 1.5 + F.when(F.col("id") == 7, far).otherwise(0)).alias("x")).localCheckpoint()
        got = []
        n = shuffled(spark, lambda: got.extend(ranks.percentiles(rows, "x", [0.25, 0.9], ["g"]).collect()), broadcast=True)  # noqa: B023
        held = rows.toPandas()
        want = {(g, s): float(np.quantile(x["x"], s)) for g, x in held.groupby("g") for s in (0.25, 0.9)}
        assert {(r["g"], r["share"]): round(r["percentile"], 6) for r in got} == {k: round(v, 6) for k, v in want.items()}
        assert far or n < 100_000


def test_percentiles_of_endless_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("inf"),), (float("-inf"),)], "x double")
    assert ranks.percentiles(df, "x", [0.5]).first()["percentile"] == 2.0


def test_sweep_makes_no_row_for_a_value_and_a_replicate(spark):
    seen = spark.range(2000).select((F.col("id") * 1.0).alias("s"))
    null = spark.range(2000).select((F.col("id") * 1.0).alias("s"), (F.col("id") % 40).alias("replicate"))
    got = []
    n = shuffled(spark, lambda: got.extend(nulls.sweep(seen, null, "s").collect()))
    assert len(got) == 2000 and n < 40_000
    one = next(r for r in got if r["t"] == 1000.0)
    assert (one["n_observed"], one["n_null"], round(one["fdp_mean"], 9)) == (1000, 1000, 0.025)


def test_threshold_keeps_one_row_a_target(spark):
    swept = spark.createDataFrame([(1.0, 9, 0.5), (2.0, 5, 0.2), (3.0, 2, 0.3)], "t double, n_observed long, fdp double")
    goals = spark.createDataFrame([(0.1,), (0.2,), (0.35,), (0.5,), (None,)], "q double")
    got = {r["q"]: tuple(r)[1:] for r in nulls.threshold_at(swept, goals).collect()}
    assert got == {0.1: (None, None, None), 0.2: (2.0, 5, 0.2), 0.35: (2.0, 5, 0.2), 0.5: (1.0, 9, 0.5), None: (None, None, None)}


def test_counted_labels(spark):
    closure = spark.createDataFrame([("r", "a"), ("r", "b")], "node string, leaf string")
    labels = spark.createDataFrame([("a", "x", 3), ("b", "y", 2), ("b", "x", 1), ("b", "Unknown", 9)], "leaf string, label string, n long")
    assert [tuple(r) for r in trees.dominant(closure, labels).collect()] == [("r", "x", 4)]


def test_equal_pairs_are_aligned_once(spark, monkeypatch):
    df = spark.createDataFrame([(i, "ACGTA" * (1 + i % 2), None if i % 3 == 0 else "ACTA") for i in range(600)], "i int, a string, b string")
    handed, plain = spark.sparkContext.accumulator(0), structures.align
    got = structures.aligned(df)
    assert sorted((r["i"], r["score"]) for r in got.collect()) == [(r["i"], plain(r["a"], r["b"] or "")[0]) for r in df.orderBy("i").collect()]
    monkeypatch.setattr(structures, "align", lambda a, b, scores: (handed.add(1), (0.0, []))[1])
    structures.aligned(df).count()
    assert handed.value == 4


def test_characters_are_counted_without_a_row_for_each(spark, monkeypatch):
    texts = [(g, t) for g in ("x", None, "y") for t in ("ab", "aB\n", "é😀", "", None, "a" * 50)]
    df = spark.createDataFrame(texts, "g string, t string")
    want = Counter((g, i, c) for g, t in texts for i, c in enumerate(t or "", 1))
    got = columns.residue_counts(df, "g", "t")
    assert {tuple(r)[:3]: r["n"] for r in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().toString()
    # parts handed on in between add up
    monkeypatch.setattr(columns, "HELD", 20)
    batches = [pa.record_batch({"g": [g], "_text": [t.encode()]}) for g, t in texts if t]
    held = Counter()
    for b in columns._counted(iter(batches)):
        held.update({(r["g"], r["position"], r["residue"]): r["n"] for r in b.to_pylist()})
    assert held == want


def test_texts_are_read_once(spark, monkeypatch):
    read, plain = [], columns.residue_counts
    monkeypatch.setattr(columns, "residue_counts", lambda *a: (read.append(1), plain(*a))[1])
    monkeypatch.setattr(analysis, "table", lambda *a: spark.createDataFrame([("x", "Dab"), ("y", "EaK")], "lang string, text string"))
    assert analysis.property_shifts(spark, "").count() == 6 and len(read) == 1
    assert calibration.score_table(spark, "").count() == 2 and len(read) == 2


def test_highways_count_per_order(spark, monkeypatch):
    # keys that come twice, null keys and nations
    held = {
        "lineitem": spark.createDataFrame([(k % 9 if k % 7 else None, k % 4) for k in range(60)], "l_orderkey long, l_suppkey long"),
        "orders": spark.createDataFrame([(k % 8, k % 5) for k in range(12)], "o_orderkey long, o_custkey long"),
        "supplier": spark.createDataFrame([(0, 1), (1, 2), (2, None), (3, 1), (3, 3)], "s_suppkey long, s_nationkey int"),
        "customer": spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, None), (4, 2)], "c_custkey long, c_nationkey int"),
    }
    want = spark.sql(divergence.SHARED["transfer_highways"], **held)
    monkeypatch.setattr(divergence, "TASK_ITEMS", 6, raising=False)
    monkeypatch.setattr(divergence, "table", lambda s, d, name: held[name])
    got = divergence.queries()["transfer_highways"](spark, "")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().toString()
    assert "distinct" not in plan and ", 11), REPARTITION_BY_NUM" in plan
