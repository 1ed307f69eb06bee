"""A tail model over cells: how exceedance rates depend on position and covariates.

log E[exceedances] = log alpha0 + log trials + a(position) + x . beta, x the
natural cubic splines of the covariates, with the penalty lambda times the
squared distance of a(position) from a plane c0 + c1 z1 + ... in the
position's own covariates. Newton steps fit any number of models at once, for
every penalty and held-out fold: Spark sums curvature and slope over the cells
of each position and takes the positions out (each touches only itself, beta
and c), so the driver solves one system of the size of beta and c per model.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from . import ranks

#: Log rates are held within this, far outside what a fit can mean.
CLIP = 50.0
#: Counted statistics of a fold: trials and exceedances.
_PAIR = ("n_trials", "n_exceed")


def spline_knots(df: DataFrame, x: str, columns: int) -> list[float]:
    """Knots at even quantiles, both ends included, for so many basis columns;
    an error if the values don't tell them apart."""
    if columns < 1:
        raise ValueError("a spline has one column at least")
    got = sorted({r["percentile"] for r in ranks.percentiles(df.where(~F.isnan(F.col(x).cast("double"))), x, [i / columns for i in range(columns + 1)]).collect()})
    if len(got) < columns + 1:
        raise ValueError(f"{x} has {len(got)} different quantiles, {columns + 1} knots are needed")
    return got


def spline_basis(x: Column, knots: list[float]) -> list[Column]:
    """The natural cubic spline's columns but for the constant: x itself, then
    one per inner knot; linear beyond the ends. Plain expressions."""
    if len(knots) < 2 or any(b <= a for a, b in zip(knots, knots[1:])):
        raise ValueError("knots rise, and there are two at least")
    x, last = x.cast("double"), knots[-1]
    cube = lambda k: F.pow(F.greatest(x - F.lit(float(k)), F.lit(0.0)), F.lit(3.0))
    part = [(cube(k) - cube(last)) / F.lit(float(last - k)) for k in knots[:-1]]
    return [x, *(p - part[-1] for p in part[:-1])]


def deviance(k: Column, mu: Column) -> Column:
    """Poisson deviance of one count; k log k is 0 at 0."""
    k = k.cast("double")
    return 2 * (F.when(k > 0, k * F.ln(k / mu)).otherwise(0.0) - (k - mu))


def quantile_bins(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """``df`` with ``<column>_repr``: the mean of all values that share the
    row's bin, of so many bins of equal counts (fewer where quantiles meet).
    The edges and means of a column are as many as its bins."""
    for c, n in columns.items():
        edges = sorted({r["percentile"] for r in ranks.percentiles(df, c, [i / n for i in range(n + 1)]).collect()})
        if len(edges) < 2:
            raise ValueError(f"the values of {c} fill no bin")
        df = df.withColumn("_bin", ranks.bin_left_closed(F.col(c), edges[1:-1]))
        df = ranks.joined(df, df.groupBy("_bin").agg(F.avg(c).alias(f"{c}_repr")), ["_bin"]).drop("_bin")
    return df


def fold_of(replicate: Column | str, folds: int, seed: int) -> Column:
    """Fold from 0 of a replicate, by a hash of it and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), replicate), F.lit(folds)).cast("int")


def cell_table(branches: DataFrame, stat: str, threshold: float, covariates: list[str], position: str = "position", replicate: str = "replicate", folds: int = 5, seed: int = 0) -> DataFrame:
    """(position, <covariate>_repr, fold, n_trials, n_exceed): the statistics
    of each fold of replicates in each cell; null and NaN statistics are no
    trials. Folds add up, so every training set is a total less one fold."""
    ok = branches.where(F.col(stat).isNotNull() & ~F.isnan(F.col(stat).cast("double")))
    keys = [F.col(position).alias("position"), *(f"{c}_repr" for c in covariates), fold_of(F.col(replicate), folds, seed).alias("fold")]
    return ok.groupBy(*keys).agg(F.count("*").alias("n_trials"), F.count_if(F.col(stat) >= threshold).alias("n_exceed"))


@dataclass
class Model:
    """One fit: ``positions`` (position, a), ``beta`` of the basis in order of
    the covariates, ``c`` of the plane, and how the fit ended."""

    alpha0: float
    knots: dict[str, list[float]]
    positions: DataFrame
    beta: list[float]
    c: list[float]
    penalty: float
    objective: float
    converged: bool
    steps: int
    scores: list[tuple] = field(default_factory=list)

    def log_rate(self, df: DataFrame, position: str = "position", name: str = "log_rate", suffix: str = "") -> DataFrame:
        """``df`` with a(position) + x . beta; null for a position that the
        fit has not seen. Covariates are ``<name><suffix>`` of ``df``."""
        x = [b for c, k in self.knots.items() for b in spline_basis(F.col(f"{c}{suffix}"), k)]
        smooth = sum((F.lit(float(b)) * col for b, col in zip(self.beta, x, strict=True)), F.lit(0.0))
        a = self.positions.select(F.col("position").alias("_p"), F.col("a").alias("_a"))
        return df.join(a, F.col(position) == F.col("_p"), "left").withColumn(name, F.col("_a") + smooth).drop("_p", "_a")


def fit_all(cells: DataFrame, plane: DataFrame, knots: dict[str, list[float]], alpha0: float, models: list[tuple[float, int | None]], most: int = 40, close: float = 1e-9) -> tuple[list[Model], DataFrame]:
    """A fit for each of ``models`` (penalty, fold to leave out or None), and
    (model, position, a) of all of them.

    ``cells``: of ``cell_table``. ``plane``: (position, z) with the position's
    covariates as an array of one length, one row for each position at least.
    A step is one job over cells times models; a step that makes a model worse
    is halved. Ends when every slope is at most ``close`` of the exceedances.
    """
    spark = cells.sparkSession
    z_size = len(plane.select("z").first()[0]) + 1
    reprs = [f"{c}_repr" for c in knots]
    x = F.array(*(b for c, k in knots.items() for b in spline_basis(F.col(f"{c}_repr"), k)))
    d = sum(len(k) - 1 for k in knots.values())
    by_fold = F.map_from_entries(F.collect_list(F.struct("fold", F.struct(*_PAIR))))
    whole = materialize(cells.groupBy("position", *reprs).agg(*(F.sum(c).alias(c) for c in _PAIR), by_fold.alias("folds")).select("position", x.alias("x"), *_PAIR, "folds"))
    table = spark.createDataFrame([(i, float(p), f) for i, (p, f) in enumerate(models)], "model int, penalty double, held int")
    own = lambda c: F.coalesce(F.try_element_at("folds", F.col("held"))[c], F.lit(0))
    work = whole.crossJoin(F.broadcast(table)).select("model", "penalty", "position", "x", *((F.col(c) - own(c)).cast("double").alias(c) for c in _PAIR)).where("n_trials > 0")
    plane = plane.select("position", F.concat(F.array(F.lit(1.0)), "z").alias("z"))
    state = materialize(work.select("model", "penalty", "position").distinct().join(plane, "position").withColumns({"a": F.lit(0.0), "_old": F.lit(0.0)}))
    n = len(models)
    beta, old_beta = np.zeros((n, d)), np.zeros((n, d))
    c, old_c = np.zeros((n, z_size)), np.zeros((n, z_size))
    best, done, steps = np.full(n, np.inf), np.zeros(n, bool), 0
    for steps in range(1, most + 1):
        now = F.broadcast(spark.createDataFrame([(i, beta[i].tolist(), c[i].tolist()) for i in range(n)], "model int, beta array<double>, c array<double>"))
        sums = _position_sums(work, state, now, alpha0, d, z_size)
        sums = materialize(sums)
        got = {r["model"]: r for r in _model_sums(sums, d, z_size).collect()}
        delta, worse, left = np.zeros((n, d + z_size)), np.zeros(n, bool), np.zeros(n, bool)
        for i, r in got.items():
            if r["objective"] > best[i] + 1e-10 * (1 + abs(best[i])) and not done[i]:
                worse[i] = True
                continue
            best[i] = r["objective"]
            if r["slope"] <= close * (1 + r["events"]) or done[i]:
                done[i] = True
                continue
            left[i] = True
            m = d + z_size
            curve = np.zeros((m, m))
            curve[np.tril_indices(m)] = r["curve"]
            curve = curve + np.tril(curve, -1).T
            scale = 1 / np.sqrt(np.maximum(np.diag(curve), 1e-300))
            delta[i] = -scale * np.linalg.lstsq(curve * np.outer(scale, scale), np.array(r["pull"]) * scale, rcond=1e-12)[0]
        if not worse.any() and not left.any():
            break
        for i in range(n):
            if worse[i]:
                beta[i], c[i] = (beta[i] + old_beta[i]) / 2, (c[i] + old_c[i]) / 2
            elif left[i]:
                old_beta[i], old_c[i] = beta[i], c[i]
                beta[i], c[i] = beta[i] + delta[i, :d], c[i] + delta[i, d:]
        step = F.broadcast(spark.createDataFrame([(i, "worse" if worse[i] else "step" if left[i] else "stay", delta[i].tolist()) for i in range(n)], "model int, what string, delta array<double>"))
        dot = F.aggregate(F.arrays_zip(F.col("w"), F.col("delta")), F.lit(0.0), lambda s, v: s + v["w"] * v["delta"])
        moved = F.when(F.col("what") == "worse", (F.col("a") + F.col("_old")) / 2).when(F.col("what") == "step", F.col("a") - (F.col("g") + dot) / F.col("h")).otherwise(F.col("a"))
        state = materialize(sums.join(step, "model").select("model", "penalty", "position", "z", moved.alias("a"), F.when(F.col("what") == "step", F.col("a")).otherwise(F.col("_old")).alias("_old")))
    out = [Model(alpha0, knots, state.where(F.col("model") == i).select("position", "a"), beta[i].tolist(), c[i].tolist(), models[i][0], float(best[i]), bool(done[i]), steps) for i in range(n)]
    return out, state.select("model", "position", "a")


def _log_mu(alpha0: float) -> Column:
    dot = F.aggregate(F.arrays_zip(F.col("x"), F.col("beta")), F.lit(0.0), lambda s, v: s + v["x"] * v["beta"])
    return F.lit(float(np.log(alpha0))) + F.ln("n_trials") + F.col("a") + dot


def _position_sums(work: DataFrame, state: DataFrame, now: DataFrame, alpha0: float, d: int, z_size: int) -> DataFrame:
    """Of each model and position: slope ``g`` and curvature ``h`` in its own
    a, ``w`` the mixed curvature with beta and c, and what its cells and its
    penalty add to the rest."""
    rows = work.join(state.select("model", "position", "a"), ["model", "position"]).join(now.select("model", "beta"), "model")
    eta = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), _log_mu(alpha0)))
    rows = rows.withColumn("eta", eta).withColumn("mu", F.exp("eta")).withColumn("r", F.col("mu") - F.col("n_exceed"))
    each = lambda what, *of: F.expr(f"array({', '.join(f'sum({what.format(*i)})' for i in of)})")
    one, two_of = [(i,) for i in range(d)], [(i, j) for i in range(d) for j in range(i + 1)]
    cells = rows.groupBy("model", "position").agg(
        F.expr("sum(mu - n_exceed * eta)").alias("loss"), F.sum("n_exceed").alias("events"), F.sum("mu").alias("mu"), F.sum("r").alias("r"),
        each("mu * x[{}]", *one).alias("mx"), each("r * x[{}]", *one).alias("rx"), each("mu * x[{}] * x[{}]", *two_of).alias("mxx"),
    )
    both = state.join(cells, ["model", "position"]).join(now.select("model", "c"), "model")
    gap = F.col("a") - F.aggregate(F.arrays_zip(F.col("z"), F.col("c")), F.lit(0.0), lambda s, v: s + v["z"] * v["c"])
    two = 2 * F.col("penalty")
    out = both.withColumn("gap", gap).withColumns({"g": F.col("r") + two * F.col("gap"), "h": F.col("mu") + two, "w": F.concat("mx", F.transform("z", lambda v: -two * v)), "pull": F.concat("rx", F.transform("z", lambda v: -two * F.col("gap") * v))})
    return out.withColumn("loss", F.col("loss") + F.col("penalty") * F.col("gap") * F.col("gap")).select("model", "penalty", "position", "z", "a", "_old", "loss", "events", "g", "h", "w", "pull", "mxx")


def _model_sums(sums: DataFrame, d: int, z_size: int) -> DataFrame:
    """Of each model the objective, the largest slope, and the system in beta
    and c once every position is taken out: curvature (lower triangle) less
    w w' / h, pull less w g / h."""
    own = lambda i, j: f"mxx[{i * (i + 1) // 2 + j}]" if i < d else f"2 * penalty * z[{i - d}] * z[{j - d}]" if j >= d else "0"
    m = d + z_size
    curve = ", ".join(f"sum({own(i, j)} - w[{i}] * w[{j}] / h)" for i in range(m) for j in range(i + 1))
    pull = ", ".join(f"sum(pull[{i}] - w[{i}] * g / h)" for i in range(m))
    slope = ", ".join(["max(abs(g))", *(f"abs(sum(pull[{i}]))" for i in range(m))])
    return sums.groupBy("model").agg(F.sum("loss").alias("objective"), F.sum("events").alias("events"), F.expr(f"greatest({slope})").alias("slope"), F.expr(f"array({curve})").alias("curve"), F.expr(f"array({pull})").alias("pull"))


def held_out(cells: DataFrame, fits: list[Model], states: DataFrame, models: list[tuple[float, int | None]]) -> DataFrame:
    """(penalty, fold, held_out_deviance, n_cells): each fold's cells under the
    model that was fitted without it; positions that the model has not seen
    are left out."""
    spark = cells.sparkSession
    knots, alpha0 = fits[0].knots, fits[0].alpha0
    x = F.array(*(b for c, k in knots.items() for b in spline_basis(F.col(f"{c}_repr"), k)))
    now = F.broadcast(spark.createDataFrame([(i, float(p), f, m.beta) for i, ((p, f), m) in enumerate(zip(models, fits, strict=True)) if f is not None], "model int, penalty double, fold int, beta array<double>"))
    rows = cells.withColumn("x", x).join(now, "fold").join(states, ["model", "position"])
    mu = F.exp(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), _log_mu(alpha0))))
    return rows.groupBy("penalty", "fold").agg(F.sum(deviance(F.col("n_exceed"), mu)).alias("held_out_deviance"), F.count("*").alias("n_cells"))


def fit(cells: DataFrame, plane: DataFrame, knots: dict[str, list[float]], alpha0: float, penalties: list[float], folds: int = 5) -> Model:
    """The model of all cells at the penalty with the least deviance of cells
    held out by fold (of equals the smallest); ``scores`` has what
    ``held_out`` gives. All folds and penalties are fitted in one go."""
    trials = [(p, f) for p in sorted(penalties) for f in range(folds)]
    fits, states = fit_all(cells, plane, knots, alpha0, trials)
    scores = [tuple(r) for r in held_out(cells, fits, states, trials).orderBy("penalty", "fold").collect()]
    if not scores:
        raise ValueError("no fold has cells that a model of the others can score")
    total: dict[float, float] = {}
    for p, _, dev, _ in scores:
        total[p] = total.get(p, 0.0) + dev
    best = min(total, key=lambda p: (total[p], p))
    (model,), _ = fit_all(cells, plane, knots, alpha0, [(best, None)])
    model.scores = scores
    return model


def with_z(df: DataFrame, stat: str, survival: str, log_rate: str, threshold: float, name: str = "z") -> DataFrame:
    """``df`` with -log10 of the chance of a null statistic as large: the
    pooled ``survival``, times the modelled rate from ``threshold`` up."""
    rate = F.when(F.col(stat) >= threshold, F.exp(log_rate)).otherwise(1.0)
    chance = F.least(F.lit(1.0), F.greatest(F.lit(2.2250738585072014e-308), rate * F.col(survival)))
    return df.withColumn(name, F.when(F.col(stat).isNotNull(), -F.log10(chance)))


def pooled_survival(log_rate: str, z: float, alpha0: float) -> Column:
    """The pooled survival at which a row of this rate reaches ``z``, no more
    than ``alpha0``, below which the model says nothing; an error for a z that
    asks for more. ``nulls.with_quantile`` turns it into a threshold."""
    if 10.0**-z > alpha0 * (1 + 1e-9):
        raise ValueError(f"z {z} lies below the model's anchor {alpha0}")
    return F.least(F.lit(10.0**-z) / F.exp(log_rate), F.lit(float(alpha0)))
