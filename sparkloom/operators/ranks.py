"""Running sums, exact percentiles and ranks without a window over all rows.

Rows are first counted per value; the values are split into ranges, each range
is summed by itself and the totals of the ranges before it are added. So no
task orders more than a range, however many rows a group has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

#: Ranges that the values of a running sum are split into, at most, and rows of one.
RANGES, RANGE_ROWS = 256, 200_000


def range_shares(rows: int, ranges: int = RANGES) -> list[float]:
    """Shares at which so many rows are cut into ranges."""
    n = max(2, min(ranges, rows // RANGE_ROWS))
    return [i / n for i in range(1, n)]


def in_ranges(df: DataFrame, value: Column, edges: str, name: str, most: int = RANGES, equal: bool = False) -> DataFrame:
    """``df`` with ``name`` for its column ``edges`` of at most ``most`` sorted
    values: how many of them are below ``value``, or, with ``equal``, not
    above it; null for null.

    First the block of edges, then the place in it, by plain comparisons: two
    roots of their number, none of them a lambda. They are two columns, as
    one expression repeats the first in each comparison of the second, which
    can make code too long to be compiled."""
    step = max(2, math.isqrt(max(1, most) - 1) + 1)
    less = lambda i: F.coalesce((F.get(edges, i) <= value) if equal else (F.get(edges, i) < value), F.lit(False)).cast("int")
    df = df.withColumn("_block", sum((less(F.lit(step * j - 1)) for j in range(1, step)), F.lit(0)) * step)
    place = F.col("_block") + sum((less(F.col("_block") + i) for i in range(step)), F.lit(0))
    return df.withColumn(name, F.when(value.isNotNull(), place)).drop("_block", edges)


def running_sums(counts: DataFrame, value: str, sums: list[str], by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """``counts`` with ``<sum>_upto`` for each of ``sums``: the sum over rows
    of the same group with this value or a smaller one.

    ``counts`` holds one row per group and value; null values are left out.
    The edges of the ranges are approximate quantiles: they shape the work,
    not the result.
    """
    by = by or []
    counts = materialize(counts.where(F.col(value).isNotNull()))
    shares = range_shares(counts.count(), ranges)
    edges = counts.agg(F.percentile_approx(value, shares, 10_000).alias("_edges"))
    rows = in_ranges(counts.crossJoin(F.broadcast(edges)), F.col(value), "_edges", "_range", len(shares))
    part = rows.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_all_{c}") for c in sums))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_range"]
    part = part.select(*(F.col(c).alias(f"_part{i}") for i, c in enumerate(keys)), *(F.coalesce(F.sum(f"_all_{c}").over(before), F.lit(0)).alias(f"_all_{c}") for c in sums))
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"_in_{c}": F.sum(c).over(inside) for c in sums})
    joined = rows.join(part, _same(keys, "_part"))
    return joined.select(*counts.columns, *((F.col(f"_in_{c}") + F.col(f"_all_{c}")).alias(f"{c}_upto") for c in sums))


def _same(keys: list[str], other: str = "_key") -> Column:
    """Columns equal to _key0, _key1, ...; a null group meets itself."""
    out = F.lit(True)
    for i, c in enumerate(keys):
        out = out & F.col(c).eqNullSafe(F.col(f"{other}{i}"))
    return out


def joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, one row for each of its
    groups ``by``; a null group meets itself. Spark chooses how to join."""
    keyed = right.select(*(F.col(c).alias(f"_joined{i}") for i, c in enumerate(by)), *(c for c in right.columns if c not in by))
    return left.join(keyed, _same(by, "_joined")).drop(*(f"_joined{i}" for i in range(len(by))))


#: Plotting positions (alpha, beta) of the methods that go linearly between ranks.
BETWEEN = {"linear": (1, 1), "weibull": (0, 0), "hazen": (0.5, 0.5), "interpolated_inverted_cdf": (0, 1), "median_unbiased": (1 / 3, 1 / 3), "normal_unbiased": (3 / 8, 3 / 8)}


def quantile_rank(share: Column, total: Column, method: str = "linear") -> Column:
    """Rank from 0, perhaps between two, of a share of ``total`` values;
    ``ValueError`` for an unknown method."""
    even, np_ = (total - 1) * share, total * share
    at = {
        "lower": lambda: F.floor(even),
        "higher": lambda: F.ceil(even),
        "nearest": lambda: F.bround(even, 0),
        "midpoint": lambda: (F.floor(even) + F.ceil(even)) / 2,
        "inverted_cdf": lambda: F.ceil(np_) - 1,
        "averaged_inverted_cdf": lambda: F.when(np_ == F.floor(np_), np_ - 0.5).otherwise(F.floor(np_)),
    }
    if method in BETWEEN:
        a, b = BETWEEN[method]
        rank = np_ + (a + share * (1 - a - b)) - 1 if method != "linear" else even
    elif method in at:
        rank = at[method]()
    else:
        raise ValueError(f"{method} is none of {sorted([*BETWEEN, *at])}")
    return F.least(F.greatest(rank.cast("double"), F.lit(0.0)), (total - 1).cast("double"))


#: Cells of equal width that a group's values are counted in.
CELLS = 4096


def cell_of(value: Column, least: Column, width: Column) -> Column:
    """Cell from 0 of a value at most ``width`` above ``least``; 0 without a finite width."""
    return F.when((width > 0) & (width < float("inf")), F.floor((value - least) / width * CELLS)).otherwise(0)


def percentiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None, weight: str | None = None, method: str = "linear") -> DataFrame:
    """(by, share, percentile, n): exact, by default linear between
    neighbours (see ``quantile_rank``); rows count ``weight`` times.

    Nulls are left out; a group without values has no row. A group's values
    are first counted in cells of equal width between its least and its
    greatest one, and only the values of cells that hold a wanted rank are
    shuffled and ordered, by running sums, as a cell may hold nearly all.
    """
    by = by or []
    keys = [f"_key{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).alias("_v"), (F.col(weight) if weight else F.lit(1).cast("long")).alias("_n"))
    groups = materialize(rows.groupBy(*keys).agg(F.min("_v").cast("double").alias("_least"), F.max("_v").cast("double").alias("_most"), F.sum("_n").alias("_total")).where("_total > 0"))
    ends = groups.select(*keys, "_least", (F.col("_most") - F.col("_least")).alias("_width"))
    rows = joined(rows, ends, keys) if keys else rows.crossJoin(F.broadcast(ends))
    # the same value is in the same cell, a larger one in no lower cell; without a finite width all are in one
    rows = rows.select(*keys, "_v", "_n", cell_of(F.col("_v").cast("double"), F.col("_least"), F.col("_width")).alias("_cell"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(rows.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_in"))).withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    wanted = groups.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("_rank", quantile_rank(F.col("share"), F.col("_total"), method))
    wanted = wanted.withColumn("_lo", F.floor("_rank")).withColumn("_hi", F.ceil("_rank"))
    wanted = wanted.select(*(F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)), "share", "_total", "_rank", "_lo", "_hi")
    same = _same(keys, "_of")
    held = materialize(cells.join(wanted, same & (F.col("_before") <= F.col("_hi")) & (F.col("_before") + F.col("_in") > F.col("_lo"))).select(*keys, "_cell", "_before").distinct())
    some = joined(rows, held, [*keys, "_cell"]).groupBy(*keys, "_cell", "_before", "_v").agg(F.sum("_n").alias("_n"))
    upto = running_sums(some, "_v", ["_n"], [*keys, "_cell"]).withColumn("_upto", F.col("_before") + F.col("_n_upto"))
    # the value of rank r (from 0) is the least one with _upto > r
    near = upto.join(wanted, same & (F.col("_upto") - F.col("_n") <= F.col("_hi")) & (F.col("_upto") > F.col("_lo")))
    ends = near.groupBy(*keys, "share", "_total", "_rank", "_lo").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    at = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - F.col("_lo"))
    return ends.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), "share", at.cast("double").alias("percentile"), F.col("_total").alias("n"))


def as_of(left: DataFrame, right: DataFrame, x: str, at: str, by: list[str] | None = None, strict: bool = False, name: str = "found") -> DataFrame:
    """``left`` with ``name``: a struct of all columns of ``right``'s last row
    of the same group whose ``at`` is not above ``x`` (``strict``: below it);
    null if there is none, or ``x`` is null.

    Both tables are merged in order of the value, range by range, and each
    range hands its last row of ``right`` on to the ranges after it: no side
    is broadcast, no group is ordered in one task. Rows of ``right`` without
    ``at`` are left out; of several at one value the greatest row counts.
    """
    by = by or []
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    none = right.schema.simpleString()
    a = left.select(*keys, F.col(x).cast("double").alias("_x"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(none).alias("_r"))
    b = right.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("double").alias("_x"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(left.schema.simpleString()).alias("_l"), F.struct(*right.columns).alias("_r"))
    both = materialize(a.unionByName(b))
    shares = range_shares(both.count())
    edges = both.agg(F.percentile_approx("_x", shares, 10_000).alias("_edges"))
    rows = in_ranges(both.crossJoin(F.broadcast(edges)), F.col("_x"), "_edges", "_range", len(shares))
    groups = [f"_g{i}" for i in range(len(by))]
    here = Window.partitionBy(*groups, "_range").orderBy("_x", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_here", F.last("_r", ignorenulls=True).over(here))
    ends = rows.where("_range is not null").groupBy(*groups, "_range").agg(F.max(F.when(F.col("_r").isNotNull(), F.struct("_x", "_r"))).alias("_end"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*(F.col(c).alias(f"_key{i}") for i, c in enumerate([*groups, "_range"])), F.last("_end", ignorenulls=True).over(before).alias("_end"))
    out = rows.where("_l is not null").join(ends, _same([*groups, "_range"]), "left")
    return out.select("_l.*", F.when(F.col("_x").isNotNull(), F.coalesce("_here", "_end._r")).alias(name))


def grid_quantiles(df: DataFrame, value: str, points: int, by: list[str] | None = None) -> DataFrame:
    """(by, i, share, quantile, n): of each group the exact quantiles at
    ``points`` even shares from 0 to 1, linear between neighbours. The ranks
    wanted are merged with the counted values, so many points cost no more
    than the values they are read from."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("n"))
    upto = materialize(running_sums(counts, "_v", ["n"], by))
    total = upto.groupBy(*by).agg(F.max("n_upto").alias("_total"))
    wanted = total.where("_total > 0").select(*by, "_total", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    wanted = wanted.withColumn("share", F.col("i") / (points - 1)).withColumn("_rank", F.col("share") * (F.col("_total") - 1))
    wanted = wanted.withColumn("_at", F.explode(F.array(F.floor("_rank"), F.ceil("_rank"))))
    first = upto.select(*by, "_v", (F.col("n_upto") - F.col("n")).alias("_first"))
    ends = as_of(wanted, first, "_at", "_first", by).groupBy(*by, "i", "share", "_total", "_rank").agg(F.min("found._v").alias("_a"), F.max("found._v").alias("_b"))
    return ends.select(*by, "i", "share", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - F.floor("_rank"))).alias("quantile"), F.col("_total").alias("n"))


def average_ranks(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """(value, n, average_rank): the mean rank (from 1) of each value's ties."""
    n = F.sum(weight) if weight else F.count("*")
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(n.alias("n"))
    return running_sums(counts, value, ["n"]).select(value, "n", (F.col("n_upto") - (F.col("n") - 1) / 2).alias("average_rank"))


def bin_right_closed(value: Column, edges: Column) -> Column:
    """Bin from 0 of sorted edges; the lowest edge belongs to bin 0."""
    return F.greatest(F.size(F.filter(edges, lambda e: e < value)), F.lit(1)) - 1


def bin_left_closed(value: Column, inner: list[float]) -> Column:
    """Bin from 0 by inner edges: as many as do not exceed the value."""
    out = F.lit(0)
    for e in sorted(inner):
        out = out + F.when(value >= F.lit(float(e)), 1).otherwise(0)
    return F.when(value.isNotNull(), out)


def largest_gaps(df: DataFrame, value: str, most: int = 2) -> DataFrame:
    """The ``most`` largest gaps between neighbouring distinct values:
    (lower, upper, gap), largest first; few rows are expected (one per
    replicate), they are ordered in one task."""
    rows = df.where(F.col(value).isNotNull()).select(value).distinct()
    w = Window.orderBy(value)
    gaps = rows.select(F.lag(value).over(w).alias("lower"), F.col(value).alias("upper")).where("lower is not null")
    return gaps.withColumn("gap", F.col("upper") - F.col("lower")).orderBy(F.desc("gap"), "lower").limit(most)
