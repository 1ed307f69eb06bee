"""Posterior correction: null probabilities moved onto the observed scale.

Within a bin of conservation a null value is sent through its own
distribution to a share and through the observed one to a value. Where the
null has an atom the share is drawn within the atom's jump, so one value may
go to many; the draw hangs on the row's key and a seed, not on the order in
which rows are met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from . import ranks

#: Shares at which a bin's distribution is kept; an atom is a plateau of it.
GRID = 4001


def bin_edges(observed: DataFrame, rc: str, bins: int) -> list[float]:
    """Inner edges of bins of equal counts; equal ones, and those at the least
    value, go, so that every bin can be reached."""
    got = ranks.percentiles(observed, rc, [i / bins for i in range(1, bins)]).collect()
    least = observed.agg(F.min(rc)).first()[0]
    return sorted({r["percentile"] for r in got if r["percentile"] > least})


def bin_of(rc: Column, edges: list[float]) -> Column:
    """Bin from 0: how many edges are not above the value; null for null."""
    return ranks.bin_left_closed(rc, edges)


def draw(seed: int, *keys: Column | str) -> Column:
    """A number from 0 to below 1 by seed and key: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


@dataclass
class Correction:
    """``table``: (bin, i, source, target) for each bin that the null reaches,
    ``grid`` rows each; ``fitted``: the bins read from data, with the number
    of null and observed values; the others have their own source and borrow
    the shift."""

    edges: list[float]
    grid: int
    table: DataFrame
    fitted: dict[int, tuple[int, int]]

    def apply(self, df: DataFrame, rc: str, p: str, keys: list[str], seed: int, name: str = "corrected") -> DataFrame:
        """``df`` with ``name``: its value ``p`` on the observed scale. Rows
        without ``p`` or ``rc``, and bins that the null never reached, keep
        what they have. The table that travels has bins times ``grid`` rows,
        whatever the data."""
        rows = self.table.orderBy("bin", "i").collect()
        maps = {b: np.array([(r["source"], r["target"]) for r in rows if r["bin"] == b]).T for b in {r["bin"] for r in rows}}
        shared = df.sparkSession.sparkContext.broadcast(maps)
        share = np.linspace(0, 1, self.grid)

        @F.pandas_udf("double")
        def moved(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for bins, value, u in parts:
                out = value.to_numpy(float, copy=True)
                for b, (source, target) in shared.value.items():
                    on = ((bins == b) & value.notna()).to_numpy()
                    v = out[on]
                    lo = np.minimum(np.searchsorted(source, v, "left"), self_last)
                    hi = np.clip(np.searchsorted(source, v, "right") - 1, 0, self_last)
                    a = share[lo]
                    out[on] = np.interp(a + u.to_numpy()[on] * (np.maximum(share[hi], a) - a), share, target)
                yield pd.Series(out).where(value.notna().to_numpy(), None)

        self_last = self.grid - 1
        return df.withColumn(name, moved(bin_of(F.col(rc), self.edges), F.col(p).cast("double"), draw(seed, *keys)))


def fit(null: DataFrame, observed: DataFrame, rc: str, p: str, bins: int = 10, signal_free: float = 0.5, fit_bins: list[int] | None = None, grid: int = GRID, least: int = 200, extrapolation: str = "constant") -> Correction:
    """The correction of null rows towards observed ones (both: ``rc``, ``p``;
    rows without one of them are left out).

    Bins come from the observed conservation. Read from data are those up to
    its share ``signal_free``, or ``fit_bins``, that have ``least`` rows on
    both sides; an error if there is none. Every other bin keeps its own null
    quantiles and borrows the shift, quantile by quantile: the mean over the
    fitted bins ('constant'), or a line over the bins' median conservation
    ('linear', with three fitted bins or more), cut to 0 to 1 and kept rising.
    """
    if extrapolation not in ("constant", "linear"):
        raise ValueError(f"extrapolation is constant or linear, not {extrapolation}")
    if not 0 < signal_free <= 1:
        raise ValueError("signal_free lies above 0 and up to 1")
    have = F.col(rc).isNotNull() & F.col(p).isNotNull()
    null, observed = null.where(have), observed.where(have)
    edges = bin_edges(observed, rc, bins)
    placed = lambda df: materialize(df.select(bin_of(F.col(rc), edges).alias("bin"), F.col(rc).alias("rc"), F.col(p).cast("double").alias("p")))
    null, observed = placed(null), placed(observed)
    if fit_bins is None:
        cut = ranks.percentiles(observed, "rc", [signal_free]).select("percentile").first()
        top = sum(e <= cut[0] for e in edges) if cut else -1
        fit_bins = list(range(top + 1))
    counts = {r["bin"]: (r["a"], r["b"]) for r in null.groupBy("bin").agg(F.count("*").alias("a")).join(observed.groupBy("bin").agg(F.count("*").alias("b")), "bin").collect()}
    fitted = {b: counts[b] for b in sorted(set(fit_bins)) if b in counts and min(counts[b]) >= least}
    if not fitted:
        raise ValueError(f"no bin has {least} rows on both sides")
    source = materialize(ranks.grid_quantiles(null, "p", grid, ["bin"]).select("bin", "i", F.col("quantile").alias("source")))
    target = materialize(ranks.grid_quantiles(observed.where(F.col("bin").isin(*fitted)), "p", grid, ["bin"]).select("bin", "i", F.col("quantile").alias("target")))
    middle = ranks.percentiles(null, "rc", [0.5], ["bin"]).select("bin", F.col("percentile").alias("x"))
    shift = source.join(target, ["bin", "i"]).join(middle, "bin").withColumn("shift", F.col("target") - F.col("source"))
    slope = F.coalesce(F.regr_slope("shift", "x"), F.lit(0.0)) if extrapolation == "linear" and len(fitted) > 2 else F.lit(0.0)
    line = shift.groupBy("i").agg(slope.alias("slope"), F.avg("shift").alias("mean"), F.avg("x").alias("at"))
    rest = source.where(~F.col("bin").isin(*fitted)).join(line, "i").join(middle, "bin")
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("source") + F.col("mean") + F.col("slope") * (F.col("x") - F.col("at"))))
    # one bin's grid is ``grid`` rows
    rising = Window.partitionBy("bin").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = rest.withColumn("_t", moved).select("bin", "i", "source", F.max("_t").over(rising).alias("target"))
    table = materialize(source.join(target, ["bin", "i"]).select("bin", "i", "source", "target").unionByName(rest))
    return Correction(edges, grid, table, fitted)


def corrected_score(df: DataFrame, correction: Correction, rc: str, ac: str, p: str, keys: list[str], seed: int, name: str = "score") -> DataFrame:
    """``df`` with ``name``: rc - ac * p, p corrected where ac is -1 and as it
    is elsewhere, where no score comes near a threshold."""
    out = correction.apply(df, rc, p, keys, seed, "_corrected")
    return out.withColumn(name, F.col(rc) - F.col(ac) * F.when(F.col(ac) == -1, F.col("_corrected")).otherwise(F.col(p))).drop("_corrected")
