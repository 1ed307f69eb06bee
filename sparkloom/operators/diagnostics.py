"""What a calibrated threshold is worth: two states of the replicates and what
speaks against them, null against null, controls, flatness by covariate, and
the rule of percentiles beside it.

Null rows have a test, a replicate and a statistic; a missing or NaN statistic
never exceeds a threshold. Tables of replicates have one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from ..session import materialize
from . import nulls, ranks, stats, switches


def two_states(calls: DataFrame, labels: DataFrame, observed: DataFrame, level: float = 0.95, dominance: float = 3.0) -> DataFrame:
    """A row per threshold: the replicates as a mixture of a low and a high
    state, and whether the data speak against it.

    ``calls``: (threshold, replicate, n) as of ``nulls.exceedances``;
    ``labels``: (replicate, high, label_statistic), the last may be null;
    ``observed``: (threshold, n_observed). Columns: n_high, n_low, mean and
    sample deviation of n by state (null below one, two replicates), share of
    high ones with its exact interval, the false share at these three, and the
    falsifiers: ``low_exceeds_high`` (a low replicate has as many calls as the
    least high one), ``high_below_2``, ``gap_not_dominant`` (the largest gap of
    the label statistic is less than ``dominance`` times the second largest)
    and ``cut_not_at_largest_gap``. The two of the gap are null where the
    statistic of a replicate is missing; one state alone leaves means and
    false shares null and its falsifiers false. Replicates without a label
    are left out."""
    marked = labels.where("replicate is not null and high is not null")
    v = calls.join(marked.select("replicate", "high"), "replicate")
    h = F.col("high")
    by = lambda f, state: f(F.when(state, F.col("n")))
    state = v.groupBy("threshold").agg(
        F.count_if(h).alias("n_high"), F.count_if(~h).alias("n_low"),
        by(F.avg, h).alias("mean_high"), by(F.stddev_samp, h).alias("sd_high"), by(F.avg, ~h).alias("mean_low"), by(F.stddev_samp, ~h).alias("sd_low"),
        F.coalesce(by(F.max, ~h) >= by(F.min, h), F.lit(False)).alias("low_exceeds_high"),
    )
    o = F.greatest(F.col("n_observed"), F.lit(1))
    total = F.col("n_high") + F.col("n_low")
    state = state.join(observed.select("threshold", "n_observed"), "threshold").withColumn("_ci", stats.clopper_pearson_bounds(F.col("n_high"), total, level))
    state = state.withColumns({"share": F.col("n_high") / total, "share_low": F.col("_ci.low"), "share_high": F.col("_ci.high")})
    at = lambda pi: ((1 - F.col(pi)) * F.col("mean_low") + F.col(pi) * F.col("mean_high")) / o
    state = state.withColumns({"fdp": at("share"), "fdp_low": at("share_low"), "fdp_high": at("share_high"), "high_below_2": F.col("n_high") < 2})
    return state.drop("_ci").crossJoin(F.broadcast(_gaps(marked, dominance)))


def _gaps(marked: DataFrame, dominance: float) -> DataFrame:
    """One row of the label statistic's gaps. Ties are a gap of 0 each."""
    x, h = F.col("label_statistic").cast("double"), F.col("high")
    ends = marked.agg(
        F.count("*").alias("_n"), F.count(x).alias("_known"), F.max(x).alias("_any"),
        F.max(F.when(~h, x)).alias("_below"), F.min(F.when(h, x)).alias("_above"),
    )
    two = ranks.largest_gaps(marked.withColumn("_x", x), "_x", 2)
    top = two.agg(F.max(F.struct("gap", "lower", "upper")).alias("_top"), F.min("gap").alias("_second"), F.count("*").alias("_gaps"))
    row = ends.crossJoin(top)
    # a third value somewhere else makes a second gap, equal values make one of 0
    second = F.when(F.col("_gaps") == 2, F.col("_second")).when(F.col("_n") > 2, 0.0)
    gap, lower, upper = F.coalesce("_top.gap", F.lit(0.0)), F.coalesce("_top.lower", "_any"), F.coalesce("_top.upper", "_any")
    ratio = F.when(F.col("_n") > 1, F.coalesce(gap / F.nullif(second, F.lit(0.0)), F.lit(float("inf"))))
    known = (F.col("_n") > 0) & (F.col("_n") == F.col("_known"))
    near = lambda a, b: F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)
    away = ~F.coalesce(near(F.col("_below"), lower) & near(F.col("_above"), upper), F.lit(False))
    both = F.col("_below").isNotNull() & F.col("_above").isNotNull()
    return row.select(
        F.when(known & (F.col("_n") > 1), gap).alias("largest_gap"), F.when(known, ratio).alias("gap_ratio"),
        F.when(known, F.coalesce((ratio < dominance), F.lit(False))).alias("gap_not_dominant"),
        F.when(known, both & away).alias("cut_not_at_largest_gap"),
    )


def group_composition(labels: DataFrame, group: str) -> DataFrame:
    """(group, n, n_high) of labelled replicates; a null group is one."""
    return labels.where("high is not null").groupBy(group).agg(F.count("*").alias("n"), F.count_if("high").alias("n_high"))


def held_out(null: DataFrame, share: float, seed: int, replicate: str = "replicate") -> DataFrame:
    """(replicate, held): about ``share`` of the replicates, at least one and
    never all, by the order of a keyed hash, so the same ones on any cluster.
    One replicate alone is not held out. A table of replicates is small."""
    reps = null.select(replicate).where(F.col(replicate).isNotNull()).distinct()
    keyed = materialize(reps.withColumn("_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(replicate).cast("string")))))
    n = F.col("_n")
    size = keyed.agg(F.count("*").alias("_n")).select(F.least(F.greatest(F.lit(1), F.bround(n * share, 0).cast("int")), n - 1).alias("_held"))
    place = keyed.agg(F.array_sort(F.collect_list("_key")).alias("_keys")).crossJoin(size)
    return keyed.crossJoin(F.broadcast(place)).select(replicate, (F.array_position("_keys", F.col("_key")) <= F.col("_held")).alias("held"))


def null_on_null(null: DataFrame, stat: str, threshold: float, share: float, seed: int, replicate: str = "replicate") -> DataFrame:
    """(replicate, n_calls, expected, fdp) of each held-out replicate: its
    exceedances of the threshold, the mean of the other replicates', and their
    ratio, about 1 where the threshold is fair. Fewer than two replicates give
    no row."""
    t = null.sparkSession.range(1).select(F.lit(float(threshold)).alias("threshold"))
    n = materialize(nulls.exceedances(null, stat, t, replicate).join(held_out(null, share, seed, replicate), replicate))
    build = n.where(~F.col("held")).agg(F.avg("n").alias("expected"))
    return n.where("held").crossJoin(F.broadcast(build)).select(replicate, F.col("n").alias("n_calls"), "expected", (F.col("expected") / F.greatest(F.col("n"), F.lit(1))).alias("fdp"))


def control(observed: DataFrame, null: DataFrame, stat: str, ac: str, threshold: float) -> DataFrame:
    """One row: observed and null statistics where the state did not change
    (``ac`` is 1), each side by its own ``ac``: n, mean, deviation (of the
    population), median, 90 and 99 % quantile, share at or above the
    threshold, and their Kolmogorov-Smirnov distance with p. All null rows
    count, none is sampled. A side without rows has nulls."""
    x = F.nanvl(F.col(stat).cast("double"), F.lit(None)).alias("x")
    side = lambda df, g: df.where(F.col(ac) == 1).select(x, F.lit(g).alias("seen"))
    both = materialize(side(observed, True).unionByName(side(null, False)).where("x is not null"))
    cuts = materialize(ranks.percentiles(both, "x", [0.5, 0.9, 0.99], ["seen"]))
    one = lambda s, g, q: F.max(F.when((F.col("seen") == g) & (F.col("share") == q), F.col("percentile"))).alias(s)
    quantiles = cuts.agg(*(one(f"{s}_q{round(100 * q)}", g, q) for s, g in (("observed", True), ("null", False)) for q in (0.5, 0.9, 0.99)))
    sums = []
    for s, g in (("observed", True), ("null", False)):
        v = F.when(F.col("seen") == g, F.col("x"))
        sums += [F.avg(v).alias(f"{s}_mean"), F.stddev_pop(v).alias(f"{s}_deviation"), F.avg(F.when(v >= threshold, 1.0).when(v.isNotNull(), 0.0)).alias(f"{s}_rate")]
    return stats.two_samples(both, "x", F.col("seen")).select(F.col("n1").alias("n_observed"), F.col("n0").alias("n_null"), "ks", "ks_p").crossJoin(both.agg(*sums)).crossJoin(quantiles)


def head_to_head(calls: DataFrame, percentile: Column, calibrated: Column) -> DataFrame:
    """(percentile, calibrated, n): how often two rules call, each alone, both
    and neither, all four always present. A null call is none."""
    grid = calls.sparkSession.createDataFrame([(a, b) for a in (False, True) for b in (False, True)], "percentile boolean, calibrated boolean")
    n = calls.groupBy(F.coalesce(percentile, F.lit(False)).alias("percentile"), F.coalesce(calibrated, F.lit(False)).alias("calibrated")).agg(F.count("*").alias("n"))
    return grid.join(n, ["percentile", "calibrated"], "left").na.fill(0, ["n"])


def covariate_bins(tests: DataFrame, covariates: list[str], bins: int = 10, categories: int = 20) -> dict[str, Column]:
    """Each covariate as a column of bins for ``exceedance_rates``: a number of
    more than ``categories`` distinct values by its quantiles (right-closed,
    equal edges once), everything else as it is. Only the edges, at most
    ``bins`` + 1 of each covariate, come to the driver."""
    numbers = {f.name for f in tests.schema.fields if isinstance(f.dataType, NumericType)}
    many = tests.agg(*(F.count_distinct(c).alias(c) for c in covariates)).first() if covariates else {}
    out = {}
    for c in covariates:
        if c in numbers and many[c] > categories:
            edges = switches.quantile_edges(tests, c, bins).first()["edges"]
            out[c] = F.when(F.col(c).isNotNull(), switches.bin_of(F.col(c), F.array(*map(F.lit, edges)))).cast("string")
        else:
            out[c] = F.col(c).cast("string")
    return out


def exceedance_rates(null: DataFrame, test: list[str], stat: str, threshold: float, bins: dict[str, Column]) -> DataFrame:
    """(covariate, bin, n_tests, rate): the share of a test's replicates at or
    above the threshold, a missing one among those below, averaged over the
    tests of a bin. ``bins`` may use any column that a test's rows agree on; a
    test whose covariate is null is in none of its bins."""
    hit = F.when(F.nanvl(F.col(stat).cast("double"), F.lit(None)) >= threshold, 1.0).otherwise(0.0)
    rates = null.groupBy(*test, *(b.alias(f"_bin{i}") for i, b in enumerate(bins.values()))).agg(F.avg(hit).alias("_rate"))
    places = F.explode(F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(f"_bin{i}").alias("bin")) for i, c in enumerate(bins))))
    return rates.select("_rate", places.alias("_x")).select("_rate", "_x.*").where("bin is not null").groupBy("covariate", "bin").agg(F.count("*").alias("n_tests"), F.avg("_rate").alias("rate"))


def hot_positions(null: DataFrame, stat: str, anchor: float, most: int, position: str = "position") -> DataFrame:
    """(position): the ``most`` positions with most null values at or above
    ``anchor``, ties by position: what makes a position hot comes from null
    rows alone."""
    n = null.where(F.col(position).isNotNull()).groupBy(position).agg(F.count_if(F.nanvl(F.col(stat).cast("double"), F.lit(None)) >= anchor).alias("_n"))
    return n.orderBy(F.desc("_n"), position).limit(most).select(position)


def in_cells(branches: DataFrame, hot: DataFrame, edges: DataFrame, size: str = "clade", position: str = "position") -> DataFrame:
    """``branches`` with ``hot`` and ``size_bin``, the two keys of a cell.
    Hot positions are at most as many as asked for, edges are one row."""
    marked = branches.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), position, "left").crossJoin(F.broadcast(edges))
    return marked.withColumn("hot", F.coalesce("_hot", F.lit(False))).withColumn("size_bin", F.when(F.col(size).isNotNull(), switches.bin_of(F.col(size), F.col("edges")))).drop("_hot", "edges")


def bin_projection(sizes: DataFrame, cells: DataFrame, edges: DataFrame, null: DataFrame, stat: str, z: float, bins: int, size: str = "clade") -> DataFrame:
    """(bin, lower, upper, median_size, threshold) of each quantile bin of the
    branch sizes: the statistic that its median size needs for ``z`` at a
    position that is not hot. A projection that loses the positions: the rule
    itself asks more at hot ones.

    ``cells``: (hot, size_bin, multiplier); a cell not there counts as 1.
    ``null``: rows with the statistic ``stat``."""
    outer = materialize(switches.quantile_edges(sizes, size, bins))
    binned = sizes.where(F.col(size).isNotNull()).crossJoin(F.broadcast(outer)).withColumn("bin", switches.bin_of(F.col(size), F.col("edges")))
    ends = F.element_at("edges", F.col("bin") + 1).alias("lower"), F.element_at("edges", F.col("bin") + 2).alias("upper")
    ends = binned.select("bin", *ends).distinct()
    middle = ranks.percentiles(binned, size, [0.5], ["bin"]).select("bin", F.col("percentile").alias("median_size"))
    placed = middle.crossJoin(F.broadcast(edges)).withColumn("size_bin", switches.bin_of(F.col("median_size"), F.col("edges"))).drop("edges")
    cold = cells.where(~F.col("hot")).select("size_bin", "multiplier")
    want = placed.join(cold, "size_bin", "left").withColumn("_q", F.lit(10.0 ** -z) / F.coalesce("multiplier", F.lit(1.0)))
    return nulls.quantile_among(want.select("bin", "median_size", "_q"), null, stat, "_q", "threshold").join(ends, "bin").select("bin", "lower", "upper", "median_size", "threshold")
