"""Tails, intervals and p-values against plain sums and published figures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import stats


def two_sided(a, b, c, d):
    n, K, N = a + b, a + c, a + b + c + d
    ways = {i: math.comb(K, i) * math.comb(N - K, n - i) for i in range(max(0, n + K - N), min(n, K) + 1)}
    return sum(v for v in ways.values() if v <= ways[a] * (1 + 1e-7)) / math.comb(N, n)


def test_fisher_two_sided(spark):
    rng = random.Random(4)
    rows = [(8, 2, 1, 5), (3, 0, 2, 2), (0, 0, 1, 1), (0, 0, 0, 0), (0, 50, 0, 50), (400, 100, 10, 900)] + [tuple(rng.randint(0, 40) for _ in range(4)) for _ in range(40)]
    df = spark.createDataFrame([*rows, (None, 1, 1, 1)], "a long, b long, c long, d long")
    for r in stats.fisher(df, "a", "b", "c", "d", two_sided=True).collect():
        assert r["p"] is None if r["a"] is None else r["p"] == pytest.approx(two_sided(r["a"], r["b"], r["c"], r["d"]), rel=1e-7)


def test_enrichment_table(spark):
    df = spark.createDataFrame([("m", 8, 3, 20, 7.0), ("over", 2, 90, 10, 7.0), ("none", 0, 0, 0, 7.0), ("all", 10, 0, 10, 7.0), ("null", None, 1, 5, 7.0)], "id string, o long, e long, t long, p double")
    out = {r["id"]: r for r in stats.enrichment_table(df, "o", "e", "t").collect()}
    assert out["m"]["fold_enrichment"] == pytest.approx(8 / 3) and out["m"]["pvalue"] == pytest.approx(two_sided(8, 12, 3, 17))
    assert out["m"]["log2_odds_ratio"] == pytest.approx(math.log2(8 * 17 / (12 * 3)))
    # expected hits are at most the total, an empty table says nothing, a ratio of 0 is taken as 0.01
    assert out["over"]["pvalue"] == pytest.approx(two_sided(2, 8, 10, 0)) and out["over"]["log2_odds_ratio"] == pytest.approx(math.log2(0.01))
    assert (out["none"]["pvalue"], out["none"]["log2_odds_ratio"]) == (1.0, 0.0) and out["all"]["log2_odds_ratio"] == math.inf
    assert out["null"]["pvalue"] is None and all(r["p"] == 7.0 for r in out.values())


def test_counts_in_the_millions(spark):
    k = stats.binomial_critical(spark.createDataFrame([(1_000_000, 0.3), (2_000_000_000, 0.001), (0, 0.5), (3, 0.9)], "n long, p double"), "n", "p", F.lit(0.05), "k").collect()
    # normal approximation with a correction for continuity lies within two counts
    for r in k[:2]:
        sd = math.sqrt(r["n"] * r["p"] * (1 - r["p"]))
        assert abs(r["k"] - (r["n"] * r["p"] + 1.6448536 * sd + 0.5)) < 3
    assert [r["k"] for r in k[2:]] == [1, 4]
    h = stats.hypergeometric_tail(spark.createDataFrame([(501_000, 1_000_000, 2_000_000, 4_000_000)], "k long, n long, m long, t long"), "k", "n", "m", "t").first()["p"]
    sd = math.sqrt(1_000_000 * 0.25 * 0.75)
    assert h == pytest.approx(0.5 * math.erfc((1000 - 0.5) / sd / math.sqrt(2)), rel=1e-3)


def test_interval_and_p_values(spark):
    assert stats.clopper_pearson(3, 10) == pytest.approx((0.0667395111780, 0.6524528500599), abs=1e-10)
    assert stats.clopper_pearson(10, 10) == pytest.approx((0.6915028921812392, 1.0), abs=1e-10)
    row = spark.range(1).select(
        # published quantiles of Student's t: 5 % at 2.228139 of 10 degrees, 1 % at 2.575829 of very many
        stats.student_two_sided(F.lit(2.2281388519649385), F.lit(10.0)).alias("t10"), stats.student_two_sided(F.lit(2.5758293), F.lit(1e7)).alias("many"),
        stats.student_two_sided(F.lit(0.0), F.lit(4.0)).alias("zero"), stats.correlation_p(F.lit(1.0), F.lit(5)).alias("one"), stats.correlation_p(F.lit(0.5), F.lit(2)).alias("two"),
        # 1.358099 is the 5 % point of the Kolmogorov distribution
        stats.ks_p(F.lit(1.3580986393225505) / F.sqrt(F.lit(50.0)), F.lit(100.0), F.lit(100.0)).alias("ks"), stats.ks_p(F.lit(0.0), F.lit(9.0), F.lit(9.0)).alias("same"),
    ).first()
    assert row["t10"] == pytest.approx(0.05, abs=1e-9) and row["many"] == pytest.approx(0.01, abs=1e-6) and row["zero"] == pytest.approx(1.0)
    assert row["one"] == 0.0 and row["two"] is None and row["ks"] == pytest.approx(0.05, abs=1e-9) and row["same"] == 1.0
