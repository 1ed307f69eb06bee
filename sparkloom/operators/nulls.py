"""Observed statistics against null replicates: sweeps, tails, p-values.

Observed rows have one statistic per test; null rows have a replicate as well.
Nulls (missing statistics) never count, NaN is made null first. Everything
that grows with the rows is counted per value before it is summed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from . import ranks


def statistic(left: Column, right: Column) -> Column:
    """The larger of two branches; NaN counts as missing, one value suffices."""
    return F.greatest(F.nanvl(left, F.lit(None)), F.nanvl(right, F.lit(None)))


def _counts(rows: DataFrame, stat: str, by: list[str]) -> DataFrame:
    return rows.where(F.col(stat).isNotNull() & ~F.isnan(F.col(stat).cast("double"))).groupBy(*by, F.col(stat).cast("double").alias("t")).agg(F.count("*").alias("n"))


#: Counts of points and replicates held at once in a task.
BLOCK = 4_000_000


def sweep(observed: DataFrame, null: DataFrame, stat: str, replicate: str = "replicate", share: float = 0.9) -> DataFrame:
    """(t, n_observed, n_null, fdp_mean, fdp) at every distinct observed
    statistic: observed and null counts at or above it, the mean over
    replicates of the share of false ones, and its quantile ``share``.

    The grid is split into ranges. Each takes the observed values and the
    counted null ones inside it and each replicate's total of the ranges
    above, so no row is made for a value and a replicate: a range works out
    its replicates' counts for a block of values at a time. Replicates
    without any statistic count as zeros; without replicates, or without
    observed statistics, the table is empty."""
    grid = _counts(observed, stat, [])
    down = grid.withColumn("_d", -F.col("t"))
    obs = materialize(ranks.running_sums(down, "_d", ["n"]).select("t", F.col("n_upto").alias("n_observed")))
    reps = null.select(F.col(replicate).cast("string").alias("r")).where("r is not null").distinct()
    cells = materialize(_counts(null.where(F.col(replicate).isNotNull()), stat, [replicate]).select(F.col(replicate).cast("string").alias("r"), "t", "n"))
    shares = ranks.range_shares(obs.count() + cells.count())
    edges = obs.agg(F.percentile_approx("t", shares, 10_000).alias("_e"))
    at = lambda df: ranks.in_ranges(df.crossJoin(F.broadcast(edges)), F.col("t"), "_e", "_range", len(shares), equal=True)
    # a null value counts for all grid points of its range at or below it, and for all lower ranges
    cells, points = at(cells), at(obs)
    part = cells.groupBy("r", "_range").agg(F.sum("n").alias("_n"))
    frame = points.select("_range").distinct().crossJoin(F.broadcast(reps)).unionByName(part.select("_range", "r")).distinct().join(part, ["r", "_range"], "left").na.fill(0, ["_n"])
    above = Window.partitionBy("r").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    frame = frame.select("_range", "r", F.lit(None).cast("double").alias("t"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("n"), F.lit(None).cast("long").alias("n_observed"))
    both = frame.unionByName(cells.select("_range", "r", "t", "n", F.lit(None).cast("long").alias("n_observed")))
    both = both.unionByName(points.select("_range", F.lit(None).cast("string").alias("r"), "t", F.lit(None).cast("long").alias("n"), "n_observed"))

    def work(part: pd.DataFrame) -> pd.DataFrame:
        is_point = part["n_observed"].notna().to_numpy()
        points, own = part[is_point], part[~is_point]
        base, held = own[own["t"].isna()], own[own["t"].notna()]
        place = {r: i for i, r in enumerate(base["r"])}
        upper, which = base["n"].to_numpy(np.int64), held["r"].map(place).to_numpy(np.int64)
        ts, ns = held["t"].to_numpy(float), held["n"].to_numpy(np.int64)
        order = np.argsort(ts, kind="stable")
        steps = []
        for i in range(len(upper)):
            mine = order[which[order] == i]
            steps.append((ts[mine], np.concatenate((np.cumsum(ns[mine][::-1])[::-1], [0])) + upper[i]))
        t, n = points["t"].to_numpy(float), points["n_observed"].to_numpy(np.int64)
        total, fdp = np.zeros(len(t), np.int64), np.zeros(len(t))
        size = max(1, BLOCK // max(1, len(upper)))
        for a in range(0, len(t), size) if steps else ():
            v = np.stack([c[np.searchsorted(x, t[a : a + size])] for x, c in steps])
            total[a : a + size] = v.sum(axis=0)
            v = np.sort(v / np.maximum(n[a : a + size], 1), axis=0)
            # linear between neighbours, as Spark's percentile
            rank = (len(v) - 1) * share
            lo, hi = int(np.floor(rank)), int(np.ceil(rank))
            fdp[a : a + size] = v[lo] if lo == hi else (hi - rank) * v[lo] + (rank - lo) * v[hi]
        out = pd.DataFrame({"t": t, "n_observed": n, "n_null": total, "fdp_mean": total / max(1, len(upper)) / np.maximum(n, 1), "fdp": fdp})
        return out if steps else out[:0]

    return both.groupBy("_range").applyInPandas(work, "t double, n_observed long, n_null long, fdp_mean double, fdp double")


def threshold_at(swept: DataFrame, targets: DataFrame, q: str = "q") -> DataFrame:
    """(q, threshold, n_calls, fdp): the least t of ``sweep`` whose false
    share is at most q; null where none is, which is a result of its own.

    Each row of ``swept`` counts for the least target that it meets, which
    leaves one row a target; larger targets take over from smaller ones."""
    goals = targets.select(q).distinct()
    lists = goals.where(F.col(q).isNotNull()).agg(F.array_sort(F.collect_list(F.col(q).cast("double"))).alias("_qs"))
    met = swept.crossJoin(F.broadcast(lists)).withColumn("_k", F.size(F.filter("_qs", lambda x: x < F.col("fdp")))).where(F.col("_k") < F.size("_qs"))
    first = met.groupBy("_k").agg(F.min(F.struct("t", "n_observed", "fdp")).alias("_b"))
    at = goals.crossJoin(F.broadcast(lists)).withColumn("_k", F.array_position("_qs", F.col(q).cast("double")) - 1).select(q, "_k").join(first, "_k", "left")
    best = F.min("_b").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = at.withColumn("_b", F.when(F.col(q).isNotNull(), best))
    return found.select(q, F.col("_b.t").alias("threshold"), F.col("_b.n_observed").alias("n_calls"), F.col("_b.fdp").alias("fdp"))


def exceedances(null: DataFrame, stat: str, thresholds: DataFrame, replicate: str = "replicate") -> DataFrame:
    """(threshold, replicate, n): counts at or above each threshold, zeros
    too, of counted values, not of rows times thresholds."""
    cells = _counts(null, stat, [replicate])
    t = thresholds.select("threshold").distinct()
    lists = t.agg(F.array_sort(F.collect_list("threshold")).alias("_ts"))
    slot = cells.crossJoin(F.broadcast(lists)).withColumn("_k", F.size(F.filter("_ts", lambda x: x <= F.col("t")))).groupBy(replicate, "_k").agg(F.sum("n").alias("n"))
    grid = t.crossJoin(F.broadcast(lists)).withColumn("_k", F.array_position("_ts", F.col("threshold"))).drop("_ts")
    reps = null.select(replicate).where(F.col(replicate).isNotNull()).distinct()
    full = grid.crossJoin(F.broadcast(reps)).join(slot, [replicate, "_k"], "left").na.fill(0, ["n"])
    w = Window.partitionBy(replicate).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return full.select("threshold", replicate, F.sum("n").over(w).alias("n"))


def describe(observed: DataFrame, null: DataFrame, stat: str, thresholds: DataFrame, replicate: str = "replicate", share: float = 0.9) -> DataFrame:
    """A row per threshold: n_observed, expected_false, least and most false,
    fdp mean, median, min, max and quantile, and the Monte Carlo p of as many
    calls: (1 + replicates with as many) / (1 + replicates)."""
    o = exceedances(observed.withColumn("_one", F.lit(0)), stat, thresholds, "_one").select("threshold", F.col("n").alias("o"))
    v = exceedances(null, stat, thresholds, replicate).join(F.broadcast(o), "threshold")
    ratio = F.col("n") / F.greatest(F.col("o"), F.lit(1))
    return v.groupBy("threshold").agg(
        F.max("o").alias("n_observed"), F.avg("n").alias("expected_false"), F.min("n").alias("least_false"), F.max("n").alias("most_false"),
        F.avg(ratio).alias("fdp_mean"), F.percentile(ratio, 0.5).alias("fdp_median"), F.min(ratio).alias("fdp_min"), F.max(ratio).alias("fdp_max"), F.percentile(ratio, share).alias("fdp"),
        ((1 + F.count_if(F.col("n") >= F.col("o"))) / (1 + F.count("*"))).alias("p"),
    )


def bootstrap(values: DataFrame, value: str, key: str, draws: int, seed: int, share: float = 0.95) -> DataFrame:
    """(mean, lo, hi, n): a seeded bootstrap of the mean over clusters, one
    value for each key, null ones left out; without values no row.

    A draw takes as many clusters as there are, the i-th by a hash of (seed,
    draw, i). How often it takes each one is counted, and these counts weigh
    the values, so a draw is a sum over rows and no row holds all values."""
    held = values.where(F.col(value).isNotNull()).groupBy(key).agg(F.avg(F.col(value).cast("double")).alias("v"))
    # a place for each key: by its hash, keys of one hash by themselves
    same = F.transform(F.array_sort(F.collect_list(F.struct(key, "v"))), lambda x: x["v"])
    hashed = held.groupBy(F.xxhash64(key).alias("h")).agg(F.count("*").alias("n"), same.alias("vs"))
    placed = ranks.running_sums(hashed, "h", ["n"]).select((F.col("n_upto") - F.col("n")).alias("at"), F.posexplode("vs").alias("i", "v"))
    slots = materialize(placed.select((F.col("at") + F.col("i")).alias("slot"), "v"))
    total = slots.agg(F.count("*").alias("_n"))
    picks = slots.crossJoin(F.broadcast(total)).select("_n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"), "slot")
    picks = picks.select("draw", "_n", F.pmod(F.xxhash64(F.lit(seed), "draw", "slot"), F.col("_n")).alias("slot"))
    times = picks.groupBy("draw", "_n", "slot").agg(F.count("*").alias("times"))
    each = times.join(slots.select("slot", "v"), "slot").groupBy("draw", "_n").agg((F.sum(F.col("times") * F.col("v")) / F.col("_n")).alias("m"))
    half = (1 - share) / 2
    out = each.agg(F.avg("m").alias("mean"), F.percentile("m", half).alias("lo"), F.percentile("m", 1 - half).alias("hi"), F.max("_n").alias("n"))
    return out.where("n is not null")


def max_t(null: DataFrame, stat: str, alpha: float, replicate: str = "replicate", by: str | None = None) -> DataFrame:
    """The 1 - alpha quantile of the replicates' largest statistics: (level,
    threshold, n_replicates), level 'all', and with ``by`` one for each of its
    values as well."""
    ok = null.where(F.col(stat).isNotNull() & ~F.isnan(F.col(stat).cast("double")))
    each = ok.groupBy(replicate).agg(F.max(stat).alias("top")).withColumn("level", F.lit("all"))
    if by:
        each = each.unionByName(ok.groupBy(replicate, F.col(by).cast("string").alias("level")).agg(F.max(stat).alias("top")))
    return each.groupBy("level").agg(F.percentile("top", 1 - alpha).alias("threshold"), F.count("*").alias("n_replicates"))


def empirical_p(observed: DataFrame, null: DataFrame, test: str, stat: str, replicate: str = "replicate") -> DataFrame:
    """(test, stat, n_over, p): add-one p of every test against the replicates
    of the same test; p is null where the statistic is missing."""
    r = null.agg(F.count_distinct(replicate).alias("_r"))
    o = observed.select(F.col(test), F.nanvl(F.col(stat).cast("double"), F.lit(None)).alias("stat"))
    n = null.select(F.col(test).alias("_t"), F.nanvl(F.col(stat).cast("double"), F.lit(None)).alias("_s"))
    over = o.join(n, (o[test] == n["_t"]) & (n["_s"] >= o["stat"]), "left").groupBy(test, "stat").agg(F.count("_s").alias("n_over"))
    return over.crossJoin(F.broadcast(r)).select(test, "stat", "n_over", F.when(F.col("stat").isNotNull(), (1 + F.col("n_over")) / (1 + F.col("_r"))).alias("p"))


def flatness(null: DataFrame, test: str, stat: str, threshold: float, bins: dict[str, Column]) -> DataFrame:
    """(covariate, bin, n_tests, n, rate): exceedance rates averaged first
    over a test's replicates, then over the tests of a bin, per covariate."""
    hit = F.when(F.col(stat) >= threshold, 1.0).otherwise(0.0)
    each = null.where(F.col(stat).isNotNull()).select(test, hit.alias("h"), F.explode(F.array(*(F.struct(F.lit(c).alias("covariate"), b.cast("string").alias("bin")) for c, b in bins.items()))).alias("x")).select(test, "h", "x.*")
    tests = each.groupBy("covariate", "bin", test).agg(F.avg("h").alias("rate"), F.count("*").alias("n"))
    return tests.groupBy("covariate", "bin").agg(F.count("*").alias("n_tests"), F.sum("n").alias("n"), F.avg("rate").alias("rate"))


def tail(null: DataFrame, stat: str) -> DataFrame:
    """(t, n_below, n_null, survival): add-one survival at each distinct null
    value, with the number of null values below it and in all."""
    upto = ranks.running_sums(_counts(null, stat, []), "t", ["n"])
    n = upto.agg(F.max("n_upto").alias("_n"))
    below = F.col("n_upto") - F.col("n")
    return upto.crossJoin(F.broadcast(n)).select("t", below.alias("n_below"), F.col("_n").alias("n_null"), ((F.col("_n") - below + 1) / (F.col("_n") + 1)).alias("survival"))


def with_survival(df: DataFrame, tailed: DataFrame, x: str, name: str = "survival") -> DataFrame:
    """``df`` with the add-one survival of ``tail`` at ``x``: one more than
    the null values at or above it, over one more than all. Both tables are
    merged (``ranks.as_of``), so neither is broadcast. Null stays null."""
    n = tailed.agg(F.max("n_null").alias("_n"))
    upto = tailed.select("t", "survival")
    found = ranks.as_of(df.withColumn("_minus", -F.col(x)), upto.withColumn("_t", -F.col("t")), "_minus", "_t", name="_f")
    # above every null value only the added one is left
    return found.crossJoin(F.broadcast(n)).withColumn(name, F.when(F.col(x).isNotNull(), F.coalesce("_f.survival", 1 / (F.col("_n") + 1)))).drop("_minus", "_f", "_n")


def with_quantile(df: DataFrame, tailed: DataFrame, survival: str, name: str = "t") -> DataFrame:
    """``df`` with the least null value whose survival is not above the column
    ``survival``; the largest null value where none is. Merged likewise."""
    top = tailed.agg(F.max("t").alias("_top"))
    found = ranks.as_of(df, tailed.select("t", F.col("survival").alias("_s")), survival, "_s", name="_f")
    return found.crossJoin(F.broadcast(top)).withColumn(name, F.when(F.col(survival).isNotNull(), F.coalesce("_f.t", "_top"))).drop("_f", "_top")


def _values(null: DataFrame, stat: str) -> DataFrame:
    return null.where(F.col(stat).isNotNull() & ~F.isnan(F.col(stat).cast("double"))).select(F.col(stat).cast("double").alias("t"))


def survival_among(df: DataFrame, null: DataFrame, stat: str, x: str, name: str = "survival") -> DataFrame:
    """``with_survival`` straight from the null rows, without a table of their
    distinct values: both tables are split into ranges, and a range counts
    null values as it is read in order. A value that many rows share is the
    upper edge of its range, and these rows are counted without an order."""
    values = _values(null, stat).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields), F.col("t").alias("_x"), F.lit(1).alias("_null"))
    both = df.withColumns({"_x": F.col(x).cast("double"), "_null": F.lit(0)}).unionByName(values)
    shares = ranks.range_shares(both.count())
    edges = both.agg(F.percentile_approx("_x", shares, 10_000).alias("_edges"))
    rows = both.crossJoin(F.broadcast(materialize(edges))).withColumn("_tops", F.col("_edges"))
    rows = ranks.in_ranges(rows, F.col("_x"), "_edges", "_range", len(shares))
    # written, as a filter on these columns would be pushed below them, their whole expressions in it
    rows = materialize(rows.withColumn("_top", F.coalesce(F.get("_tops", F.col("_range")) == F.col("_x"), F.lit(False))).drop("_tops"))
    part = rows.where("_range is not null").groupBy("_range").agg(F.sum("_null").alias("_in"), F.sum(F.when(F.col("_top"), F.col("_null")).otherwise(0)).alias("_at"))
    above = F.sum("_in").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))
    part = materialize(part.select(F.col("_range").alias("_of"), (F.coalesce(above, F.lit(0)) + F.col("_at")).alias("_more"), F.sum("_in").over(Window.partitionBy()).alias("_n")))
    down = Window.partitionBy("_range").orderBy(F.desc("_x")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = rows.where("_x is not null and not _top").withColumn("_own", F.sum("_null").over(down)).where("_null = 0")
    rest = rows.where("_null = 0 and (_x is null or _top)").withColumn("_own", F.lit(0).cast("long"))
    out = ordered.unionByName(rest).join(F.broadcast(part), F.col("_range") == F.col("_of"), "left")
    return out.select(*df.columns, F.when(F.col("_x").isNotNull(), (F.col("_more") + F.col("_own") + 1) / (F.col("_n") + 1)).alias(name))


def quantile_among(df: DataFrame, null: DataFrame, stat: str, survival: str, name: str = "t") -> DataFrame:
    """``with_quantile`` straight from the null rows, for a ``df`` of few
    rows: null values are counted in cells of equal width, and only those in
    a cell that may hold the value of a row are ordered."""
    values = _values(null, stat)
    ends = materialize(values.agg(F.min("t").alias("_least"), F.max("t").alias("_most"), F.count("*").alias("_n")))
    placed = values.crossJoin(F.broadcast(ends)).select("t", ranks.cell_of(F.col("t"), F.col("_least"), F.col("_most") - F.col("_least")).alias("_cell"))
    down = Window.orderBy(F.desc("_cell"))
    cells = materialize(placed.groupBy("_cell").agg(F.count("*").alias("_in"), F.min("t").alias("_low"))).crossJoin(F.broadcast(ends.select("_n")))
    cells = cells.withColumns({"_above": F.coalesce(F.sum("_in").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_next": F.lag("_low").over(down)})
    # the largest value of a cell has one more at or above it than the cells above, at least
    first = materialize(ranks.as_of(df, cells.withColumn("_s", (F.col("_above") + 2) / (F.col("_n") + 1)), survival, "_s", name="_c"))
    held = first.where("_c is not null").select("_c._cell", "_c._in", "_c._above", "_c._n").distinct()
    counts = ranks.joined(placed, held, ["_cell"]).groupBy("_cell", "_in", "_above", "_n", "t").agg(F.count("*").alias("n"))
    upto = ranks.running_sums(counts, "t", ["n"], ["_cell"])
    reached = F.col("_above") + F.col("_in") - (F.col("n_upto") - F.col("n"))
    exact = upto.select("_cell", "t", ((reached + 1) / (F.col("_n") + 1)).alias("_s"))
    found = ranks.as_of(first.withColumn("_cell", F.col("_c._cell")), exact, survival, "_s", ["_cell"], name="_f")
    # where no value of the cell will do, the least one above it does
    value = F.coalesce("_f.t", "_c._next", "_most")
    return found.crossJoin(F.broadcast(ends.select("_most"))).select(*df.columns, F.when(F.col(survival).isNotNull(), value).alias(name))


def thinned(tailed: DataFrame, most: int = 4000) -> DataFrame:
    """At most about ``most`` anchors of ``tail``, evenly spaced in the
    logarithm of survival: the least value of each step, and both ends."""
    ends = tailed.agg(F.min(F.ln("survival")).alias("_lo"), F.max(F.ln("survival")).alias("_hi"), F.max("t").alias("_last"))
    step = F.floor((F.ln("survival") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * (most - 2))
    rows = tailed.crossJoin(F.broadcast(ends)).withColumn("_step", F.coalesce(step, F.lit(0)))
    first = rows.groupBy("_step").agg(F.min_by(F.struct("t", "survival"), "t").alias("x")).select("x.*")
    return first.unionByName(rows.where("t = _last").select("t", "survival")).distinct()


def interpolated(df: DataFrame, anchors: DataFrame, x: str, xs: str, ys: str, name: str, log: bool = False) -> DataFrame:
    """``df`` with ``name``: linear interpolation of ``ys`` (or of its
    logarithm) at ``x`` between anchors, flat beyond the ends. The anchors are
    few (``thinned``), so they travel as one row of two sorted arrays."""
    y = F.ln(ys) if log else F.col(ys).cast("double")
    table = anchors.select(F.struct(F.col(xs).cast("double").alias("x"), y.alias("y")).alias("p")).agg(F.array_sort(F.collect_list("p")).alias("_a"))
    n, v = F.size("_a"), F.col(x).cast("double")
    # binary search: the number of anchors not above the value
    halve = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.when(F.get("_a", F.floor((s["lo"] + s["hi"]) / 2).cast("int"))["x"] <= v, F.struct((F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi"))))
    at = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve)["lo"]
    rows = df.crossJoin(F.broadcast(table)).withColumn("_k", at)
    a, b = F.get("_a", F.col("_k") - 1), F.get("_a", F.col("_k"))
    value = F.when(F.col("_k") == 0, F.get("_a", F.lit(0))["y"]).when(F.col("_k") >= n, F.get("_a", n - 1)["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (v - a["x"]) / (b["x"] - a["x"]))
    return rows.withColumn(name, F.when(v.isNotNull(), F.exp(value) if log else value)).drop("_a", "_k")


def cells(branches: DataFrame, stat: str, threshold: float, keys: list[str]) -> DataFrame:
    """(keys, n_trials, n_exceed): sums of null trials and exceedances."""
    return branches.where(F.col(stat).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n_trials"), F.count_if(F.col(stat) >= threshold).alias("n_exceed"))


def multipliers(table: DataFrame, keys: list[str], replicate: str = "replicate") -> DataFrame:
    """(keys, n_trials, n_exceed, multiplier, se_log): rate of a cell over the
    pooled rate, 1 where it is empty, with a jackknife error of its logarithm
    over replicates (total minus own, in one pass).

    A replicate without trials in a cell leaves the cell's rate as it is and
    only changes the pooled one; the sums over such replicates follow from
    the sums over all, so no row is made for a cell and a replicate that do
    not meet. One replicate gives a null error."""
    whole = table.groupBy(*keys).agg(F.sum("n_trials").alias("n_trials"), F.sum("n_exceed").alias("n_exceed"))
    rep = materialize(table.groupBy(replicate).agg(F.sum("n_trials").alias("_rt"), F.sum("n_exceed").alias("_re")))
    pooled = rep.agg(F.sum("_rt").alias("_t"), F.sum("_re").alias("_e"), F.count("*").alias("_r"))
    ratio = lambda e, t: F.nullif(e / F.nullif(t, F.lit(0)), F.lit(0.0))
    # g: logarithm of the pooled rate without a replicate, less that of all; null where nothing is left
    rep = rep.crossJoin(F.broadcast(pooled)).select(replicate, "_rt", "_re", (F.ln(ratio(F.col("_e") - F.col("_re"), F.col("_t") - F.col("_rt"))) - F.ln(ratio(F.col("_e"), F.col("_t")))).alias("_g"))
    sums = lambda c: (F.count(c), F.coalesce(F.sum(c), F.lit(0.0)), F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0.0)))
    pooled = pooled.crossJoin(rep.agg(*(x.alias(f"_g{i}") for i, x in enumerate(sums("_g")))))
    base = whole.crossJoin(F.broadcast(pooled)).withColumn("_l", F.ln(ratio(F.col("n_exceed"), F.col("n_trials"))) - F.ln(ratio(F.col("_e"), F.col("_t"))))
    own = table.groupBy(*keys, replicate).agg(F.sum("n_trials").alias("_ot"), F.sum("n_exceed").alias("_oe")).join(rep.select(replicate, "_g"), replicate)
    met = ranks.joined(own, base.select(*keys, "n_trials", "n_exceed", "_e", "_t"), keys)
    x = F.coalesce(F.ln(ratio(F.col("n_exceed") - F.col("_oe"), F.col("n_trials") - F.col("_ot"))) - F.ln(ratio(F.col("_e"), F.col("_t"))) - F.col("_g"), F.lit(0.0))
    met = met.withColumn("_x", x).groupBy(*keys).agg(F.count("*").alias("_m"), F.sum("_x").alias("_sx"), F.sum(F.col("_x") * F.col("_x")).alias("_sxx"), *(c.alias(f"_o{i}") for i, c in enumerate(sums("_g"))))
    out = ranks.joined(base, met, keys)
    # over the replicates that do not meet the cell: n values l - g, or all 0 in an empty cell
    n, g, gg = (F.col(f"_g{i}") - F.col(f"_o{i}") for i in range(3))
    s = F.col("_sx") + F.coalesce(n * F.col("_l") - g, F.lit(0.0))
    ss = F.col("_sxx") + F.coalesce(n * F.col("_l") * F.col("_l") - 2 * F.col("_l") * g + gg, F.lit(0.0))
    r = F.col("_r")
    se = F.when(r > 1, F.sqrt(F.greatest((r - 1) * (ss / r - s * s / (r * r)), F.lit(0.0))))
    return out.select(*keys, "n_trials", "n_exceed", F.coalesce(F.exp("_l"), F.lit(1.0)).alias("multiplier"), se.alias("se_log"))


def run_comparability(null: DataFrame, run: str, stat: str, threshold: float, replicate: str = "replicate", least: int = 30) -> DataFrame:
    """(run_a, run_b, ratio, verdict) of every two runs: ratio of their mean
    exceedances, 'disjoint' where the replicates' ranges don't meet,
    'undetermined' with fewer than ``least`` in one of them."""
    each = null.groupBy(run, replicate).agg(F.count_if(F.col(stat) >= threshold).alias("n"))
    u = each.groupBy(run).agg(F.avg("n").alias("mean"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("total"))
    a, b = u.alias("a"), u.alias("b")
    verdict = F.when((F.col("a.total") < least) | (F.col("b.total") < least), "undetermined").when((F.col("a.hi") < F.col("b.lo")) | (F.col("b.hi") < F.col("a.lo")), "disjoint").otherwise("comparable")
    return a.join(b, F.col(f"a.{run}") < F.col(f"b.{run}")).select(F.col(f"a.{run}").alias("run_a"), F.col(f"b.{run}").alias("run_b"), (F.col("a.mean") / F.nullif(F.col("b.mean"), F.lit(0.0))).alias("ratio"), verdict.alias("verdict"))


def check_replicates(observed: DataFrame, null: DataFrame, keys: list[str], replicate: str = "replicate", most_missing: float = 0.0) -> DataFrame:
    """(replicate, n, n_missing, n_unknown, n_repeated) of each replicate
    against the observed keys; an error if one has repeated or unknown keys or
    lacks more than the share ``most_missing``."""
    o = observed.select(*keys)
    total = o.count()
    if o.distinct().count() != total:
        raise ValueError("the observed keys are not unique")
    n = null.groupBy(replicate, *keys).agg(F.count("*").alias("_n")).join(o.withColumn("_known", F.lit(1)), keys, "left")
    out = n.groupBy(replicate).agg(F.sum("_n").alias("n"), (F.lit(total) - F.count("_known")).alias("n_missing"), F.count_if(F.col("_known").isNull()).alias("n_unknown"), F.count_if(F.col("_n") > 1).alias("n_repeated"))
    bad = out.where((F.col("n_unknown") > 0) | (F.col("n_repeated") > 0) | (F.col("n_missing") > most_missing * total)).orderBy(replicate).limit(3).collect()
    if bad:
        raise ValueError(f"replicates that don't match: {[r[replicate] for r in bad]}")
    return out


def ac_rate(observed: DataFrame, null: DataFrame, ac: str = "ac", replicate: str = "replicate") -> DataFrame:
    """One row: the observed share of ac = -1, the replicates' mean and
    population deviation of it, and the pooled share."""
    hit = F.avg(F.when(F.col(ac) == -1, 1.0).when(F.col(ac).isNotNull(), 0.0))
    o, p = observed.agg(hit.alias("observed")), null.agg(hit.alias("pooled"))
    r = null.groupBy(replicate).agg(hit.alias("h")).agg(F.avg("h").alias("mean"), F.stddev_pop("h").alias("deviation"), F.count("*").alias("n_replicates"))
    return o.crossJoin(r).crossJoin(p)


def self_calibration(null: DataFrame, stat: str, held: Column, share: float, replicate: str = "replicate") -> DataFrame:
    """(replicate, n, n_over, rate) of the held replicates at the quantile
    ``share`` of the others: on pure noise the rate is 1 - share."""
    cut = ranks.percentiles(null.where(~held), stat, [share]).select(F.col("percentile").alias("_cut"))
    return null.where(held & F.col(stat).isNotNull()).crossJoin(F.broadcast(cut)).groupBy(replicate).agg(F.count("*").alias("n"), F.count_if(F.col(stat) >= F.col("_cut")).alias("n_over")).withColumn("rate", F.col("n_over") / F.col("n"))


def expected_ratio(observed: DataFrame, null: DataFrame, stat: str, alphas: list[float]) -> DataFrame:
    """(alpha, threshold, rate, ratio): observed exceedances of the null's
    upper quantiles over what the null says."""
    of = F.create_map(*(F.lit(x) for a in alphas for x in (1 - a, a)))
    cuts = ranks.percentiles(null, stat, [1 - a for a in alphas]).select(of[F.col("share")].alias("alpha"), F.col("percentile").alias("threshold"))
    o = observed.where(F.col(stat).isNotNull()).crossJoin(F.broadcast(cuts)).groupBy("alpha", "threshold").agg(F.avg(F.when(F.col(stat) >= F.col("threshold"), 1.0).otherwise(0.0)).alias("rate"))
    return o.withColumn("ratio", F.col("rate") / F.col("alpha"))
