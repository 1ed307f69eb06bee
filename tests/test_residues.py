"""Residue shifts, motifs, contained sets and quantile methods on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ranks, residues


def test_shifts(spark):
    rows = [("A", "C"), ("k", "R"), ("D", "D"), ("X", "K"), (None, "A"), ("A", None)]
    out = [tuple(r)[2:] for r in residues.annotate_shifts(spark.createDataFrame(rows, "a string, t string"), "a", "t").collect()]
    assert out[0] == pytest.approx((195, 0, 0.7, 19.9)) and out[1] == pytest.approx((26, 0, -0.6, 4.8))
    assert out[2] == (0, 0, 0, 0) and out[3] == pytest.approx((0, 1, -3.9, 168.6))
    assert out[4] == out[5] == (None,) * 4


def test_motif_hits(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 3, 5, 6, 40, 3000)] + ["ACGTXACGTTATCAA", None, "TATCAA", "TATCAA"]
    got = sorted(tuple(r) for r in residues.motif_hits(spark.createDataFrame(list(enumerate(seqs)), "i int, s string"), "s", "TATNAA", 1).collect())
    want = []
    for i, s in enumerate(seqs):
        if s and set(s) <= set("ACGT"):
            for p in range(len(s) - 5):
                n = sum(a != b for a, b in zip("TATNAA", s[p : p + 6]) if a != "N")
                want += [(i, p, s[p : p + 6], n)] if n <= 1 else []
    assert got == sorted(want) and want


def test_matrix_distances(spark):
    motifs = {"a": "TAWNR", "b": "TATC", "c": "?GB"}
    df = spark.createDataFrame([(m, i, x) for m, s in motifs.items() for i, x in enumerate(s)], "motif string, position int, letter string")
    got = {(r[0], r[1]): r[2:] for r in residues.matrix_distances(residues.weight_matrices(df)).collect()}
    col = lambda x: (lambda v: v / v.sum())(np.array([1.0 if b in residues.IUPAC.get(x, "") else 0.1 for b in "ACGT"]))
    for (a, b), (n, frobenius, divergence) in got.items():
        k = min(len(motifs[a]), len(motifs[b]))
        p, q = (np.array([col(x) for x in motifs[m][:k]]) for m in (a, b))
        e, f = p + 1e-10, q + 1e-10
        assert n == k and frobenius == pytest.approx(np.linalg.norm(p - q) / k)
        assert divergence == pytest.approx(((e * np.log(e / f)).sum() + (f * np.log(f / e)).sum()) / 2 / k)
    assert len(got) == 3


def test_contained_sets(spark):
    rng = random.Random(8)
    sets = {i: {rng.randint(0, 9) for _ in range(rng.randint(1, 7))} for i in range(60)}
    rows = [(i, m) for i, s in sets.items() for m in s for _ in range(rng.randint(1, 2))] + [(99, None), (None, 3)]
    got = {tuple(r) for r in residues.contained_sets(spark.createDataFrame(rows, "k int, m int"), "k", "m").collect()}
    assert got == {(a, b) for a in sets for b in sets if sets[a] < sets[b]}
    assert residues.contained_sets(spark.createDataFrame([], "k int, m int"), "k", "m").count() == 0


def test_quantile_methods(spark):
    methods = [*ranks.BETWEEN, "lower", "higher", "nearest", "midpoint", "inverted_cdf", "averaged_inverted_cdf"]
    values = {n: sorted(random.Random(n).sample(range(100), n)) for n in (1, 2, 5, 8)}
    cases = spark.createDataFrame([(n, s) for n in values for s in (0.0, 0.125, 0.25, 0.5, 0.75, 0.9, 1.0)], "n long, s double")
    for r in cases.select("n", "s", *(ranks.quantile_rank(F.col("s"), F.col("n"), m).alias(m) for m in methods)).collect():
        v = values[r["n"]]
        for m in methods:
            lo = v[math.floor(r[m])]
            assert lo + (v[math.ceil(r[m])] - lo) * (r[m] % 1) == pytest.approx(float(np.quantile(v, r["s"], method=m))), (m, r["n"], r["s"])
    with pytest.raises(ValueError):
        ranks.quantile_rank(F.lit(0.5), F.lit(2), "other")
