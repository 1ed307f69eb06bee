"""Thresholds and switch calls over paired-branch score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from . import ranks

LEFT, RIGHT = ("score_left", "clade_left"), ("score_right", "clade_right")


def melt_branches(facts: DataFrame, keep: tuple[str, ...] = ("node", "position", "event_type"), left: tuple[str, str] = LEFT, right: tuple[str, str] = RIGHT) -> DataFrame:
    """Each row as two, one per branch, with ``branch``, ``score``, ``clade``."""
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("branch"), F.col(s).alias("score"), F.col(c).alias("clade")) for n, (s, c) in (("left", left), ("right", right)))))
    return facts.select(*keep, sides.alias("_b")).select(*keep, "_b.*")


def branch_covariates(facts: DataFrame, keep: tuple[str, ...] = ("position", "depth"), left: tuple[str, str] = LEFT, right: tuple[str, str] = RIGHT) -> DataFrame:
    """Each row as two, one per branch, with ``branch``, ``score``, ``log_own``
    and ``log_sib``: the logarithms of its own and of its sibling's clade size,
    which swap sides; null where a size is null or not above 0."""
    size = lambda c: F.when(F.col(c) > 0, F.ln(F.col(c).cast("double")))
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("branch"), F.col(s).alias("score"), size(own).alias("log_own"), size(sib).alias("log_sib")) for n, (s, own), (_, sib) in (("left", left, right), ("right", right, left)))))
    return facts.select(*keep, sides.alias("_b")).select(*keep, "_b.*")


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """One row: ``edges``, the distinct inner and outer quantile edges."""
    edges = ranks.percentiles(df, value, [i / bins for i in range(bins + 1)])
    return edges.agg(F.array_sort(F.collect_set("percentile")).alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """Right-closed bin from 0; the lowest edge belongs to bin 0."""
    return F.greatest(F.size(F.filter(edges, lambda e: e < value)), F.lit(1)) - 1


def bin_thresholds(branches: DataFrame, edges: DataFrame, share: float, event: str = "event_type") -> DataFrame:
    """(event, bin, threshold, n): percentile of the score inside each clade
    bin, by event and overall ('overall'); no group's values are held in one
    place, and few of them are shuffled."""
    binned = branches.crossJoin(F.broadcast(edges)).withColumn("bin", bin_of(F.col("clade"), F.col("edges")))
    rows = binned.select("bin", "score", F.explode(F.array(F.col(event), F.lit("overall"))).alias(event))
    out = ranks.percentiles(rows, "score", [share], [event, "bin"])
    return out.select(event, "bin", F.col("percentile").alias("threshold"), "n")


def adaptive_calls(facts: DataFrame, bins: int = 10, share: float = 0.99, left: tuple[str, str] = LEFT, right: tuple[str, str] = RIGHT) -> DataFrame:
    """``facts`` with ``is_switch``: whether either branch reaches the overall
    threshold of its clade bin. The edges are one row and the thresholds at
    most ``bins`` rows, so both are broadcast; no fact row is shuffled twice."""
    branches = melt_branches(facts, ("event_type",), left, right)
    edges = materialize(quantile_edges(branches, "clade", bins))
    binned = branches.crossJoin(F.broadcast(edges)).withColumn("bin", bin_of(F.col("clade"), F.col("edges")))
    cut = ranks.percentiles(binned, "score", [share], ["bin"]).select("bin", F.col("percentile").alias("threshold"))
    lookup = cut.agg(F.map_from_entries(F.collect_list(F.struct("bin", "threshold"))).alias("cuts")).crossJoin(edges)
    joined = facts.crossJoin(F.broadcast(lookup))
    hit = [F.coalesce(F.col(s) >= F.element_at("cuts", bin_of(F.col(c), F.col("edges"))), F.lit(False)) for s, c in (left, right)]
    return joined.withColumn("is_switch", hit[0] | hit[1]).drop("cuts", "edges")


def dense_tally(calls: DataFrame, first: int, last: int, position: str = "position") -> DataFrame:
    """(position, n_switches) for every position of the grid, also empty ones."""
    grid = calls.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(position))
    return grid.join(calls.where("is_switch").groupBy(position).agg(F.count("*").alias("n")), position, "left").select(position, F.coalesce("n", F.lit(0)).cast("long").alias("n_switches"))


def threshold_sweep(facts: DataFrame, thresholds: list[float], left: str = "score_left", right: str = "score_right") -> DataFrame:
    """(threshold, n_calls, n_nodes) for each hard cutoff, in one aggregation."""
    top = F.greatest(left, right)
    rows = facts.select("node", top.alias("top"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return rows.where("top >= threshold").groupBy("threshold").agg(F.count("*").alias("n_calls"), F.countDistinct("node").alias("n_nodes"))
