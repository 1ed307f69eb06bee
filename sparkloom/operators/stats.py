"""Tests and tails as Spark expressions: no table of factorials, any n."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import ranks


def ln_factorial(n: Column) -> Column:
    """ln(n!) of n >= 0, by Stirling's series after nine steps of n! = (n+1)!/(n+1):
    exact to about 1e-13 of its size for every n."""
    x = n.cast("double") + F.lit(10.0)
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x) - 1 / (1680 * x * x * x * x * x * x * x)
    product = F.lit(1.0)
    for i in range(1, 10):
        product = product * (n.cast("double") + float(i))
    return series - F.ln(product)


def ln_choose(n: Column, k: Column) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta I_x(a, b) of a, b > 0, by its continued
    fraction, on the side where it converges fast; its steps grow with the
    square root of the larger parameter. Null where an argument is null."""
    one, tiny = F.lit(1.0), 1e300
    inverse = lambda y: F.coalesce(F.try_divide(one, y), F.lit(tiny))

    def half(s: Column, e: Column) -> Column:
        # c and d of the modified Lentz step with numerator e, and their product
        d, c = inverse(1 + e * s["d"]), 1 + e * inverse(s["c"])
        return _let(F.struct(c.alias("c"), d.alias("d"), s["h"].alias("h")), lambda t: F.struct(t["c"].alias("c"), t["d"].alias("d"), (t["h"] * t["c"] * t["d"]).alias("h")))

    def fraction(v: Column) -> Column:
        x, a, b = v["x"], v["a"], v["b"]

        def step(s: Column, m: Column) -> Column:
            even = half(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
            return _let(even, lambda t: half(t, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))))

        d = inverse(1 - (a + b) * x / (a + 1))
        start = F.struct(one.alias("c"), d.alias("d"), d.alias("h"))
        steps = F.sequence(F.lit(1), (60 + 5 * F.sqrt(F.greatest(a, b))).cast("int"))
        front = ln_factorial(a + b - 1) - ln_factorial(a) - ln_factorial(b - 1) + a * F.ln(x) + b * F.log1p(-x)
        return F.exp(front) * F.aggregate(steps, start, step)["h"]

    def value(v: Column) -> Column:
        swap = v["x"] > (v["a"] + 1) / (v["a"] + v["b"] + 2)
        other = F.when(swap, F.struct((1 - v["x"]).alias("x"), v["b"].alias("a"), v["a"].alias("b"))).otherwise(v)
        inside = _let(other, fraction)
        return F.when(v["x"] <= 0, 0.0).when(v["x"] >= 1, 1.0).when(swap, 1 - inside).otherwise(inside)

    parts = F.struct(x.cast("double").alias("x"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    return F.when(x.isNotNull() & a.isNotNull() & b.isNotNull(), _let(parts, value))


def student_two_sided(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t."""
    return incomplete_beta(dof / (dof + t * t), dof / 2.0, F.lit(0.5))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of ``n`` pairs; null below three pairs."""
    dof = n.cast("double") - 2
    return F.when((n > 2) & (F.abs(r) < 1), student_two_sided(r * F.sqrt(dof / F.nullif(1 - r * r, F.lit(0.0))), dof)).when((n > 2) & r.isNotNull(), 0.0)


def ks_p(statistic: Column, n1: Column, n0: Column) -> Column:
    """Asymptotic p of the two-sample Kolmogorov-Smirnov statistic."""
    lam = statistic * F.sqrt(n1 * n0 / F.nullif(n1 + n0, F.lit(0.0)))
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * lam * lam))
    # below this the series needs more terms and p is 1 to twelve digits
    return F.when(lam < 0.2, 1.0).when(lam.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))))


#: Standard deviations on each side of a mean, and counts beyond them, whose terms are summed.
SPREAD, MORE = 40.0, 64


def _hypergeometric_terms(lo: Column, n: Column, K: Column, N: Column) -> tuple[Column, Callable[[Column], Column]]:
    """Logarithm of the chance of ``lo`` marked ones, and what the step from i
    to i + 1 adds to it."""
    first = ln_choose(K, lo) + ln_choose(N - K, n - lo) - ln_choose(N, n)
    up = lambda i: F.ln((K - i).cast("double")) + F.ln((n - i).cast("double")) - F.ln((i + 1).cast("double")) - F.ln((N - K - n + i + 1).cast("double"))
    return first, up


def _window(lo: Column, hi: Column, mean: Column, sd: Column) -> tuple[Column, Column]:
    """The part of [lo, hi] within ``SPREAD`` deviations of the mean; beyond
    the mean's reach, as many counts from the near end. All that is left out
    is below 1e-300 of the whole, or of the nearest end."""
    reach = F.ceil(sd * SPREAD).cast("long") + MORE
    low = F.greatest(lo, F.floor(mean).cast("long") - reach)
    return low, F.least(hi, F.greatest(low, F.ceil(mean).cast("long")) + reach)


def _hypergeometric_moments(n: Column, K: Column, N: Column) -> tuple[Column, Column]:
    total = F.nullif(N.cast("double"), F.lit(0.0))
    share = K / total
    mean = F.coalesce(n * share, F.lit(0.0))
    return mean, F.sqrt(F.greatest(mean * (1 - F.coalesce(share, F.lit(0.0))), F.lit(0.0)))


def _sum_up(low: Column, high: Column, n: Column, K: Column, N: Column, most: Column | None = None) -> Column:
    """Sum of the chances of low to high marked ones; with ``most`` only of
    those whose logarithm is not above it."""
    first, up = _hypergeometric_terms(low, n, K, N)
    add = lambda ln: F.exp(ln) if most is None else F.when(ln <= most, F.exp(ln)).otherwise(0.0)
    start = F.struct(first.alias("ln"), add(first).alias("sum"))
    step = lambda s, i: _let(s["ln"] + up(i - 1), lambda ln: F.struct(ln.alias("ln"), (s["sum"] + add(ln)).alias("sum")))
    rest = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(rest, start, step)["sum"]


def hypergeometric_tail(df: DataFrame, k: str, drawn: str, marked: str, total: str, name: str = "p") -> DataFrame:
    """``df`` with ``name``: the chance of ``k`` or more marked ones among
    ``drawn`` out of ``total``, of which ``marked`` are marked. Terms are
    summed inside the row, a number that grows with the standard deviation of
    the count and not with the counts; a null count gives null."""
    K, n, N = (F.col(c).cast("long") for c in (marked, drawn, total))
    lo = F.greatest(F.col(k).cast("long"), n + K - N, F.lit(0).cast("long"))
    hi = F.least(n, K)
    low, high = _window(lo, hi, *_hypergeometric_moments(n, K, N))
    some = F.col(k).isNotNull() & K.isNotNull() & n.isNotNull() & N.isNotNull()
    return df.withColumn(name, F.when(some, F.when(lo > hi, 0.0).otherwise(F.least(F.lit(1.0), _sum_up(low, high, n, K, N)))))


def fisher(df: DataFrame, a: str, b: str, c: str, d: str, two_sided: bool = False) -> DataFrame:
    """``df`` with ``odds_ratio`` (infinity if b or c is 0, null if undefined)
    and ``p`` of the table [[a, b], [c, d]]: of as many or more in a
    (one-sided), or of all tables no likelier than this one."""
    x = df.withColumn("_drawn", F.col(a) + F.col(b)).withColumn("_marked", F.col(a) + F.col(c)).withColumn("_total", F.col(a) + F.col(b) + F.col(c) + F.col(d))
    if two_sided:
        k, n, K, N = (F.col(i).cast("long") for i in (a, "_drawn", "_marked", "_total"))
        lo, hi = F.greatest(n + K - N, F.lit(0).cast("long")), F.least(n, K)
        low, high = _window(lo, hi, *_hypergeometric_moments(n, K, N))
        # a table beyond the window: from it on
        low, high = F.least(low, k), F.greatest(high, k)
        # as likely as this one but for rounding
        most = ln_choose(K, k) + ln_choose(N - K, n - k) - ln_choose(N, n) + 1e-7
        some = k.isNotNull() & n.isNotNull() & K.isNotNull() & N.isNotNull()
        x = x.withColumn("p", F.when(some, F.least(F.lit(1.0), _sum_up(low, high, n, K, N, most)))).drop("_drawn", "_marked", "_total")
    else:
        x = hypergeometric_tail(x, a, "_drawn", "_marked", "_total").drop("_drawn", "_marked", "_total")
    top, low = F.col(a).cast("double") * F.col(d), F.col(b).cast("double") * F.col(c)
    return x.withColumn("odds_ratio", F.when(low > 0, top / F.nullif(low, F.lit(0.0))).when(top > 0, F.lit(float("inf"))))


def enrichment_table(df: DataFrame, observed: str, expected: str, total: str) -> DataFrame:
    """``df`` with ``fold_enrichment``, ``pvalue`` (two-sided, Fisher) and
    ``log2_odds_ratio`` of observed hits against expected ones among ``total``
    each. More expected than ``total`` count as ``total``, counts below 0 as
    0; without any count on one side p and the ratio are 1. The ratio is never
    taken below 0.01, an undefined one counts as 0.01."""
    zero = F.lit(0).cast("long")
    o, t = F.col(observed).cast("long"), F.col(total).cast("long")
    e = F.least(F.col(expected).cast("long"), t)
    x = df.withColumns({"_a": F.greatest(zero, o), "_b": F.greatest(zero, t - o), "_c": F.greatest(zero, e), "_d": F.greatest(zero, t - e)})
    x = fisher(x.withColumns({f"_user_{c}": F.col(c) for c in ("p", "odds_ratio") if c in df.columns}), "_a", "_b", "_c", "_d", two_sided=True)
    both = (F.col("_a") + F.col("_b") > 0) & (F.col("_c") + F.col("_d") > 0)
    ratio = F.when(both, F.greatest(F.lit(0.01), F.coalesce("odds_ratio", F.lit(0.01)))).otherwise(1.0)
    some = o.isNotNull() & e.isNotNull() & t.isNotNull()
    x = x.withColumns({"fold_enrichment": o / F.greatest(F.lit(1).cast("long"), e), "pvalue": F.when(some, F.when(both, F.col("p")).otherwise(1.0)), "log2_odds_ratio": F.when(some, F.log2(ratio))})
    keep = [F.col(f"_user_{c}").alias(c) if c in ("p", "odds_ratio") else F.col(c) for c in df.columns if c not in ("fold_enrichment", "pvalue", "log2_odds_ratio")]
    return x.select(*keep, "fold_enrichment", "pvalue", "log2_odds_ratio")


def binomial_critical(df: DataFrame, n: str, p: str, alpha: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the least k with P(X >= k) < alpha of a binomial;
    n + 1 if no k up to n gets there; null where p is not inside (0, 1). The
    terms are summed down from ``SPREAD`` deviations above the mean to as many
    below it, so their number grows with the deviation (alpha above 1e-300)."""
    N, q = F.col(n).cast("long"), F.col(p)
    mean, zero = N * q, F.lit(0).cast("long")
    low, high = _window(zero, N, mean, F.sqrt(F.greatest(mean * (1 - q), F.lit(0.0))))
    odds = F.log1p(-q) - F.ln(q)
    first = ln_choose(N, high) + high * F.ln(q) + (N - high) * F.log1p(-q)
    at = lambda ln, tail, k, before: F.struct(ln.alias("ln"), tail.alias("tail"), F.when(tail < alpha, k).otherwise(before).alias("k"))
    down = lambda s, k: _let(s["ln"] + F.ln((k + 1).cast("double")) - F.ln((N - k).cast("double")) + odds, lambda ln: at(ln, s["tail"] + F.exp(ln), k, s["k"]))
    ks = F.when(high > low, F.sequence(high - 1, low, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(name, F.when((q > 0) & (q < 1), F.aggregate(ks, at(first, F.exp(first), high, high + 1), down)["k"]))


def bh(df: DataFrame, p: str, key: list[str], name: str = "q") -> DataFrame:
    """``df`` with ``name``: Benjamini-Hochberg q-values. Equal p share one q;
    null p give null q and don't count. Ranks come from running sums of
    counts, not from a window over all tests."""
    some = df.where(F.col(p).isNotNull())
    upto = ranks.running_sums(some.groupBy(p).agg(F.count("*").alias("n")), p, ["n"])
    m = some.agg(F.count("*").alias("_m"))
    raw = upto.crossJoin(F.broadcast(m)).select(F.col(p).alias("_p"), (F.col(p) * F.col("_m") / F.col("n_upto")).alias("_raw"), (-F.col(p)).alias("_down"))
    # the least raw value of this p and all larger ones, by ranges again
    edges = raw.agg(F.percentile_approx("_down", [i / 64 for i in range(1, 64)], 10_000).alias("_edges"))
    rows = raw.crossJoin(F.broadcast(edges)).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col("_down")))).drop("_edges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    part = rows.groupBy("_range").agg(F.min("_raw").alias("_least")).select("_range", F.min("_least").over(before).alias("_least"))
    inside = Window.partitionBy("_range").orderBy("_down").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = rows.withColumn("_here", F.min("_raw").over(inside)).join(F.broadcast(part), "_range").select("_p", F.least(F.lit(1.0), "_here", F.coalesce("_least", "_here")).alias(name))
    return df.join(q, df[p] == q["_p"], "left").drop("_p")


def normal_two_sided(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) by the continued fraction or series of erfc, good to 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    # fixed values: coefficients of a published rational Chebyshev fit of erfc, highest power first
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = poly * t + c
    return t * F.exp(-x * x - 1.26551223 + t * poly)


def two_samples(df: DataFrame, value: str, group: Column) -> DataFrame:
    """One row of two samples (``group`` true or false; null values and groups
    left out): n1, n0, Kolmogorov-Smirnov ``ks``, Mann-Whitney ``u`` of the
    first with tie-corrected normal ``u_p``, Cliff's delta, asymptotic ``ks_p``. An empty sample
    gives nulls. Values are counted first."""
    rows = df.select(F.col(value).alias("v"), group.alias("g")).where("v is not null and g is not null")
    counts = rows.groupBy("v").agg(F.count_if("g").alias("a"), F.count_if(~F.col("g")).alias("b"))
    total = counts.agg(F.sum("a").cast("double").alias("n1"), F.sum("b").cast("double").alias("n0"))
    upto = ranks.running_sums(counts, "v", ["a", "b"]).crossJoin(F.broadcast(total))
    below = F.col("b_upto") - F.col("b")
    n = F.col("a") + F.col("b")
    out = upto.agg(
        F.max("n1").alias("n1"), F.max("n0").alias("n0"),
        F.max(F.abs(F.col("a_upto") / F.nullif(F.col("n1"), F.lit(0.0)) - F.col("b_upto") / F.nullif(F.col("n0"), F.lit(0.0)))).alias("ks"),
        F.sum(F.col("a") * (below + F.col("b") / 2.0)).alias("u"),
        F.sum(n.cast("double") * n * n - n).alias("_ties"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    all_n = n1 + n0
    sd = F.sqrt(n1 * n0 / 12 * (all_n + 1 - F.col("_ties") / F.nullif(all_n * (all_n - 1), F.lit(0.0))))
    gap = F.abs(F.col("u") - n1 * n0 / 2)
    z = F.greatest(gap - 0.5, F.lit(0.0)) / F.nullif(sd, F.lit(0.0))
    return out.select(n1.cast("long").alias("n1"), n0.cast("long").alias("n0"), "ks", F.when(n1 * n0 > 0, F.col("u")).alias("u"), normal_two_sided(z).alias("u_p"), (2 * F.col("u") / F.nullif(n1 * n0, F.lit(0.0)) - 1).alias("delta"), ks_p(F.col("ks"), n1, n0).alias("ks_p"))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, pearson, spearman (average ranks) of rows with both values,
    and their two-sided p."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    cells = rows.groupBy("x", "y").agg(F.count("*").alias("n"))
    rx = ranks.average_ranks(cells, "x", "n").select("x", F.col("average_rank").alias("rx"))
    ry = ranks.average_ranks(cells, "y", "n").select("y", F.col("average_rank").alias("ry"))
    both = cells.join(rx, "x").join(ry, "y")

    def weighted(a: str, b: str) -> Column:
        n, sa, sb = F.sum("n"), F.sum(F.col("n") * F.col(a)), F.sum(F.col("n") * F.col(b))
        cov = F.sum(F.col("n") * F.col(a) * F.col(b)) - sa * sb / n
        va = F.sum(F.col("n") * F.col(a) * F.col(a)) - sa * sa / n
        vb = F.sum(F.col("n") * F.col(b) * F.col(b)) - sb * sb / n
        return cov / F.nullif(F.sqrt(F.greatest(va * vb, F.lit(0.0))), F.lit(0.0))

    out = both.agg(F.sum("n").alias("n"), weighted("x", "y").alias("pearson"), weighted("rx", "ry").alias("spearman"))
    return out.withColumns({f"{c}_p": correlation_p(F.col(c), F.col("n")) for c in ("pearson", "spearman")})


def pair_associations(marks: DataFrame, item: str, place: str) -> DataFrame:
    """(place_a, place_b, both, jaccard, phi) of places marked in common items.

    ``marks``: (item, place) rows, repeats do no harm. Only pairs that meet
    have a row; phi is 0 where a place is marked everywhere. Places are few
    (alignment columns); an item's pairs are bounded by their number."""
    m = marks.select(F.col(item).alias("i"), F.col(place).alias("p")).where("i is not null and p is not null").distinct()
    n_items = m.agg(F.count_distinct("i").cast("double").alias("n"))
    size = m.groupBy("p").agg(F.count("*").cast("double").alias("s"))
    pairs = m.alias("a").join(m.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.p") < F.col("b.p"))).groupBy(F.col("a.p").alias("place_a"), F.col("b.p").alias("place_b")).agg(F.count("*").alias("both"))
    j = pairs.join(size.toDF("place_a", "sa"), "place_a").join(size.toDF("place_b", "sb"), "place_b").crossJoin(F.broadcast(n_items))
    spread = F.sqrt(F.col("sa") * F.col("sb") * (F.col("n") - F.col("sa")) * (F.col("n") - F.col("sb")))
    phi = F.when(spread > 0, (F.col("n") * F.col("both") - F.col("sa") * F.col("sb")) / F.nullif(spread, F.lit(0.0))).otherwise(0.0)
    return j.select("place_a", "place_b", "both", (F.col("both") / (F.col("sa") + F.col("sb") - F.col("both"))).alias("jaccard"), phi.alias("phi"))


def concordance(both: DataFrame, a: str, b: str, all_a: DataFrame | None = None, all_b: DataFrame | None = None) -> DataFrame:
    """One row: n, agreement, kappa over any number of classes. The marginals
    come from ``all_a`` and ``all_b`` (all nodes of a run, column ``a``/``b``)
    where given, else from the shared rows; kappa is null at full chance."""
    shared = both.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    same = shared.agg(F.count("*").cast("double").alias("n"), F.count_if(F.col(a) == F.col(b)).cast("double").alias("same"))

    def share(df: DataFrame, c: str, name: str) -> DataFrame:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("class")).agg(F.count("*").cast("double").alias("k"))
        return counts.crossJoin(F.broadcast(counts.agg(F.sum("k").alias("t")))).select("class", (F.col("k") / F.col("t")).alias(name))

    chance = share(all_a or shared, a, "pa").join(share(all_b or shared, b, "pb"), "class").agg(F.coalesce(F.sum(F.col("pa") * F.col("pb")), F.lit(0.0)).alias("chance"))
    agree = F.col("same") / F.nullif(F.col("n"), F.lit(0.0))
    return same.crossJoin(chance).select(F.col("n").cast("long").alias("n"), agree.alias("agreement"), ((agree - F.col("chance")) / F.nullif(1 - F.col("chance"), F.lit(0.0))).alias("kappa"))


def recalls(both: DataFrame, truth: str, guess: str) -> DataFrame:
    """(class, n_truth, n_guess, n_both, recall, precision) by class."""
    t, g = F.col(truth).cast("string"), F.col(guess).cast("string")
    sides = both.select(F.explode(F.array(F.struct(t.alias("class"), F.lit(1).alias("t"), F.lit(0).alias("g"), F.lit(0).alias("b")), F.struct(g.alias("class"), F.lit(0).alias("t"), F.lit(1).alias("g"), F.coalesce((t == g).cast("int"), F.lit(0)).alias("b")))).alias("x")).select("x.*").where("class is not null")
    out = sides.groupBy("class").agg(F.sum("t").alias("n_truth"), F.sum("g").alias("n_guess"), F.sum("b").alias("n_both"))
    return out.withColumn("recall", F.col("n_both") / F.nullif("n_truth", F.lit(0))).withColumn("precision", F.col("n_both") / F.nullif("n_guess", F.lit(0)))


def clopper_pearson_bounds(k: Column, n: Column, level: float = 0.95) -> Column:
    """Struct (low, high): the exact binomial interval of ``k`` out of ``n``,
    by bisection on the incomplete beta function; null without trials."""
    half = (1 - level) / 2

    def bound(below: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
        cut = lambda s, _: _let((s["a"] + s["b"]) / 2, lambda m: F.when(below(m), F.struct(m.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), m.alias("b"))))
        return _let(F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, cut), lambda s: (s["a"] + s["b"]) / 2)

    low = F.when(k <= 0, 0.0).otherwise(bound(lambda m: incomplete_beta(m, k, n - k + 1) < half))
    high = F.when(k >= n, 1.0).otherwise(bound(lambda m: incomplete_beta(m, k + 1, n - k) < 1 - half))
    return F.when((n > 0) & k.isNotNull(), F.struct(low.alias("low"), high.alias("high")))


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """``clopper_pearson_bounds`` of two counts."""
    from pyspark.sql import SparkSession

    row = SparkSession.active().range(1).select(clopper_pearson_bounds(F.lit(k), F.lit(n), level).alias("x")).first()["x"]
    return row["low"], row["high"]
