"""Tables of calls by position, domain, time, node and set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import ranks, stats


def threshold_stats(df: DataFrame, stat: str, shares: list[float], position: str, depth: str) -> DataFrame:
    """(share, threshold, n, n_positions, mean_depth, median_depth) of the rows
    at or above each percentile of the statistic."""
    cuts = ranks.percentiles(df, stat, shares).select("share", F.col("percentile").alias("threshold"))
    rows = df.join(F.broadcast(cuts), F.col(stat) >= F.col("threshold"))
    out = rows.groupBy("share", "threshold").agg(F.count("*").alias("n"), F.count_distinct(position).alias("n_positions"), F.avg(depth).alias("mean_depth"))
    mid = ranks.percentiles(rows, depth, [0.5], ["threshold"]).select("threshold", F.col("percentile").alias("median_depth"))
    return out.join(F.broadcast(mid), "threshold")


def described(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, mean, deviation, q25, median, q75) of each group."""
    q = ranks.percentiles(df, value, [0.25, 0.5, 0.75], by).groupBy(*by).agg(*(F.max(F.when(F.col("share") == s, F.col("percentile"))).alias(n) for s, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))))
    a = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))
    return ranks.joined(a, q, by)


def filtered_and_not(df: DataFrame, keep: Column, value: str, by: str) -> DataFrame:
    """``described`` per bin of all rows and of the kept ones, by ``filtered``."""
    two = df.where(keep).withColumn("filtered", F.lit(True)).unionByName(df.withColumn("filtered", F.lit(False)))
    return described(two, value, [by, "filtered"])


def occupancy_filter(df: DataFrame, occupancy: DataFrame, least: float, position: str = "position") -> DataFrame:
    """Rows at positions whose occupancy reaches ``least``."""
    return df.join(occupancy.where(F.col("occupancy") >= least).select(position), position, "left_semi")


def in_domains(df: DataFrame, domains: DataFrame, position: str, other: str = "Unassigned") -> DataFrame:
    """``df`` with ``domain``: the first (by first position, then name) that
    holds the position, else ``other``. The domains are few and bounded by the
    alignment, so they go along as one array and no row is repeated."""
    table = domains.agg(F.array_sort(F.collect_list(F.struct("first", "last", "domain"))).alias("_d"))
    hit = F.get(F.filter("_d", lambda d: F.col(position).between(d["first"], d["last"])), F.lit(0))["domain"]
    return df.crossJoin(F.broadcast(table)).withColumn("domain", F.coalesce(hit, F.lit(other))).drop("_d")


def domain_rates(calls: DataFrame, domains: DataFrame, position: str, flag: str) -> DataFrame:
    """(domain, n_sites, n_active, n_calls, density, proportion, enrichment):
    calls over all sites of the domain, its share of all calls, its rate over
    active sites against the rate over all active sites."""
    rows = in_domains(calls, domains, position)
    per = rows.groupBy("domain", position).agg(F.count_if(flag).alias("c"))
    d = per.groupBy("domain").agg(F.count("*").alias("n_active"), F.sum("c").alias("n_calls"))
    size = domains.select("domain", (F.col("last") - F.col("first") + 1).alias("n_sites"))
    total = d.agg(F.sum("n_calls").alias("_c"), F.sum("n_active").alias("_a"))
    rate = F.col("n_calls") / F.nullif(F.col("n_active"), F.lit(0))
    j = size.join(d, "domain", "left").na.fill(0, ["n_active", "n_calls"]).crossJoin(F.broadcast(total))
    return j.select("domain", "n_sites", "n_active", "n_calls", (F.col("n_calls") / F.col("n_sites")).alias("density"), (F.col("n_calls") / F.nullif(F.col("_c"), F.lit(0))).alias("proportion"), (rate / F.nullif(F.col("_c") / F.nullif(F.col("_a"), F.lit(0)), F.lit(0.0))).alias("enrichment"))


def enrichment(items: DataFrame, group: str, marked: str) -> DataFrame:
    """(group, n, k, fold, p, q): hypergeometric over-representation of marked
    items (true) in each group against all items, with BH q-values. Any number
    of items: no table bounds it."""
    g = items.groupBy(group).agg(F.count("*").alias("n"), F.count_if(marked).alias("k"))
    t = g.agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))
    x = stats.hypergeometric_tail(g.crossJoin(F.broadcast(t)), "k", "n", "_k", "_n")
    fold = (F.col("k") / F.col("n")) / F.nullif(F.col("_k") / F.col("_n"), F.lit(0.0))
    x = x.withColumn("fold", fold).select(group, "n", "k", "fold", "p")
    return stats.bh(x, "p", [group])


def temporal_rates(calls: DataFrame, flag: str, node: str, era: str, event: str) -> DataFrame:
    """(era, event, n_calls, n_nodes, rate): calls over distinct nodes, per
    event and 'Overall'."""
    both = calls.withColumn(event, F.explode(F.array(F.col(event), F.lit("Overall"))))
    out = both.groupBy(era, event).agg(F.count_if(flag).alias("n_calls"), F.count_distinct(node).alias("n_nodes"))
    return out.withColumn("rate", F.col("n_calls") / F.nullif(F.col("n_nodes"), F.lit(0)))


def labelled_tertiles(df: DataFrame, value: str, labels: list[str], name: str = "era") -> DataFrame:
    """``df`` with equal-count bins of ``value`` by right-closed quantile
    edges; edges that fall together leave fewer bins, the first labels stay."""
    k = len(labels)
    edges = ranks.percentiles(df, value, [i / k for i in range(k + 1)]).agg(F.array_sort(F.collect_set("percentile")).alias("_e"))
    b = ranks.bin_right_closed(F.col(value), F.col("_e"))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), F.get(F.array(*map(F.lit, labels)), F.least(b, F.lit(k - 1)).cast("int")))).drop("_e")


def markers(calls: DataFrame, node: str, position: str, least: int = 1) -> DataFrame:
    """(node, n_markers, markers): distinct positions in order, comma-joined.
    A node has no more positions than the alignment."""
    m = calls.groupBy(node).agg(F.array_sort(F.collect_set(position)).alias("_m"))
    return m.where(F.size("_m") >= least).select(node, F.size("_m").cast("long").alias("n_markers"), F.array_join(F.transform("_m", lambda x: x.cast("string")), ",").alias("markers"))


def set_regions(members: DataFrame, item: str, group: str, names: list[str]) -> DataFrame:
    """(one flag per name, n_items): how many items lie in exactly these sets."""
    flags = [F.max(F.when(F.col(group) == n, 1).otherwise(0)).alias(n) for n in names]
    return members.where(F.col(group).isin(*names)).groupBy(item).agg(*flags).groupBy(*names).agg(F.count("*").alias("n_items"))


def ratio_curve(counts: DataFrame, key: str, top: str, low: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n, n_reached, share) of the ratio top / low over keys with
    low > 0."""
    r = counts.where(F.col(low) > 0).select((F.col(top) / F.col(low)).alias("_r"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    out = r.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(F.col("_r") >= F.col("threshold")).alias("n_reached"))
    return out.withColumn("share", F.col("n_reached") / F.col("n"))


def flows(edges: DataFrame, donor: str, recipient: str, weight: str, unknown: str = "Unknown", top: int | None = None) -> DataFrame:
    """(donor, recipient, weight) summed, without self-loops and unknown ends,
    heaviest first; ``top`` keeps the first few, a report."""
    ok = edges.where((F.coalesce(donor, F.lit(unknown)) != unknown) & (F.coalesce(recipient, F.lit(unknown)) != unknown) & (F.col(donor) != F.col(recipient)))
    out = ok.groupBy(donor, recipient).agg(F.sum(weight).alias("weight"))
    return out.orderBy(F.desc("weight"), donor, recipient).limit(top) if top else out


def with_taxa(df: DataFrame, taxa: DataFrame, key: str, name: str, unknown: str = "Unknown") -> DataFrame:
    """``df`` with ``name`` from a lookup (key, name), ``unknown`` where it lacks one."""
    one = taxa.groupBy(key).agg(F.min(name).alias(name))
    return df.join(one, key, "left").na.fill(unknown, [name])


def islands(positions: DataFrame, position: str) -> DataFrame:
    """(first, last, size) of runs of consecutive positions."""
    p = positions.select(F.col(position).alias("p")).distinct()
    return p.select("p", (F.col("p") - F.row_number().over(Window.orderBy("p"))).alias("_i")).groupBy("_i").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.count("*").alias("size")).drop("_i")


def smoothed(counts: DataFrame, position: str, value: str, half: int = 2) -> DataFrame:
    """``counts`` with ``smooth``, the mean over up to ``half`` neighbours on
    either side; positions are as few as the alignment's."""
    return counts.withColumn("smooth", F.avg(value).over(Window.orderBy(position).rowsBetween(-half, half)))


def event_levels(levels: dict[str, DataFrame], event: str = "event") -> DataFrame:
    """(level, event, n, proportion) of several tables of events."""
    out = None
    for name, df in levels.items():
        n = df.where(F.col(event).isNotNull()).groupBy(event).agg(F.count("*").alias("n")).withColumn("level", F.lit(name))
        out = n if out is None else out.unionByName(n)
    total = out.groupBy("level").agg(F.sum("n").alias("_t"))
    return out.join(F.broadcast(total), "level").select("level", event, "n", (F.col("n") / F.col("_t")).alias("proportion"))


def flat_and_adjusted(df: DataFrame, stat: str, share: float, event: str) -> DataFrame:
    """(event, n, flat_threshold, adjusted_threshold, n_flat, n_adjusted):
    calls by one percentile for all and by each event's own."""
    flat = ranks.percentiles(df, stat, [share]).select(F.col("percentile").alias("flat_threshold"))
    own = ranks.percentiles(df, stat, [share], [event]).select(event, F.col("percentile").alias("adjusted_threshold"))
    j = ranks.joined(df, own, [event]).crossJoin(F.broadcast(flat))
    return j.groupBy(event, "flat_threshold", "adjusted_threshold").agg(F.count("*").alias("n"), F.count_if(F.col(stat) >= F.col("flat_threshold")).alias("n_flat"), F.count_if(F.col(stat) >= F.col("adjusted_threshold")).alias("n_adjusted"))


def without_outliers(df: DataFrame, value: str, by: list[str], reach: float = 1.5) -> DataFrame:
    """Rows within ``reach`` interquartile ranges of the quartiles of their group."""
    q = described(df, value, by).select(*by, (F.col("q25") - reach * (F.col("q75") - F.col("q25"))).alias("_lo"), (F.col("q75") + reach * (F.col("q75") - F.col("q25"))).alias("_hi"))
    j = ranks.joined(df, q, by)
    return j.where(F.col(value).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def first_rows(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first by ``order``; a grouped minimum."""
    place = F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)))
    return df.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key))).agg(F.min_by(F.struct(*df.columns), place).alias("_row")).select("_row.*")


def pairwise_distances(points: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """(a, b, distance) of every two of a few points (residues of a structure)."""
    p = points.select(F.col(key).alias("k"), *axes).where(F.greatest(*(F.col(c) for c in axes)).isNotNull())
    d = F.sqrt(sum((F.pow(F.col(f"x.{c}") - F.col(f"y.{c}"), 2) for c in axes), F.lit(0.0)))
    return p.alias("x").join(p.alias("y"), F.col("x.k") < F.col("y.k")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), d.alias("distance"))


def nearest_distance(points: DataFrame, targets: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """(key, distance) of each point to the nearest of a few targets."""
    t = targets.agg(F.collect_list(F.struct(*axes)).alias("_t"))
    d = F.array_min(F.transform("_t", lambda t: F.sqrt(sum((F.pow(F.col(c) - t[c], 2) for c in axes), F.lit(0.0)))))
    return points.crossJoin(F.broadcast(t)).select(key, d.alias("distance"))
