"""Diagnostics of a calibrated threshold over the given tables, with DuckDB SQL
written apart. Stand-ins as in ``calibration``; in the control, rows of event A
are those whose state did not change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import diagnostics, nulls, stats, summaries, switches
from ..session import materialize
from . import analysis
from .divergence import _CALLS, facts

Query = Callable[[SparkSession, str], DataFrame]
Q: dict[str, Query] = {}
SQL: dict[str, str] = {}

_AT, _HOT, _SIZES, _Z, _SEED = (60000.0, 80000.0), 5, 6, 2.0, 11
_O = f"{analysis._S}, o AS (SELECT * FROM s WHERE side = 'F'), n AS (SELECT * FROM s WHERE side = 'O')"


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        Q[f.__name__], SQL[f.__name__] = f, sql.replace("count_if(", "count(*) FILTER (")
        return f

    return register


def _sides(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    f = analysis._facts(spark, sf_dir, "side", *columns)
    return f.where("side = 'F'"), f.where("side = 'O'")


_PMF = "exp(lgamma(CAST(n + 1 AS double)) - lgamma(CAST(i + 1 AS double)) - lgamma(CAST(n - i + 1 AS double)) + i * ln((a + b) / 2) + (n - i) * ln(1 - (a + b) / 2))"


def _bisect(name: str, which: str, first: str, last: str, keep: str) -> str:
    """Recursive table of a bound of the binomial interval, by sums of the binomial's own terms."""
    return f"{name} AS (SELECT t AS t_{which}, k AS k, n, 0 AS step, 0.0::double AS a, 1.0::double AS b FROM m UNION ALL SELECT t_{which}, k, n, step + 1, CASE WHEN {keep} THEN (a + b) / 2 ELSE a END, CASE WHEN {keep} THEN b ELSE (a + b) / 2 END FROM (SELECT *, list_sum(list_transform(range({first}, {last}), lambda i: {_PMF})) AS tail FROM {name}) WHERE step < 50)"


@query(f"""WITH RECURSIVE {_O}, th AS (SELECT unnest([{_AT[0]}, {_AT[1]}])::double AS t),
v AS (SELECT t, replicate, count_if(top >= t) AS v FROM n, th GROUP BY ALL), z AS (SELECT t, count_if(top >= t) AS o FROM o, th GROUP BY t),
l AS (SELECT replicate, max(top) AS x FROM n GROUP BY replicate), h AS (SELECT replicate, x, x >= (SELECT quantile_cont(x, 0.7) FROM l) AS high FROM l),
m AS (SELECT t, count_if(high) AS k, count(*) AS n, avg(v) FILTER (high) AS mh, stddev_samp(v) FILTER (high) AS dh, avg(v) FILTER (NOT high) AS ml, stddev_samp(v) FILTER (NOT high) AS dl, coalesce(max(v) FILTER (NOT high) >= min(v) FILTER (high), false) AS over FROM v JOIN h USING (replicate) GROUP BY t),
{_bisect("lo", "lo", "k", "n + 1", "tail < 0.025")}, {_bisect("hi", "hi", "0", "k + 1", "tail > 0.025")},
g AS (SELECT x, lead(x) OVER (ORDER BY x) AS y, lead(x) OVER (ORDER BY x) - x AS gap FROM h), gg AS (SELECT max(gap) AS top, list_sort(list(gap) FILTER (gap IS NOT NULL), 'DESC')[2] AS second FROM g),
e AS (SELECT max(x) FILTER (NOT high) AS below, min(x) FILTER (high) AS above FROM h),
b AS (SELECT m.*, k / CAST(n AS double) AS share, (SELECT (a + b) / 2 FROM lo WHERE step = 50 AND t_lo = m.t) AS sl, (SELECT (a + b) / 2 FROM hi WHERE step = 50 AND t_hi = m.t) AS sh FROM m)
SELECT t AS threshold, k AS n_high, n - k AS n_low, round(mh, 6) AS mean_high, round(dh, 6) AS sd_high, round(ml, 6) AS mean_low, round(dl, 6) AS sd_low, over AS low_exceeds_high, o AS n_observed,
  round(share, 9) AS share, round(sl, 7) AS share_low, round(sh, 7) AS share_high, round(((1 - share) * ml + share * mh) / greatest(o, 1), 7) AS fdp, round(((1 - sl) * ml + sl * mh) / greatest(o, 1), 7) AS fdp_low, round(((1 - sh) * ml + sh * mh) / greatest(o, 1), 7) AS fdp_high, k < 2 AS high_below_2,
  round(top, 4) AS largest_gap, round(top / second, 5) AS gap_ratio, top / second < 3 AS gap_not_dominant, NOT EXISTS (SELECT 1 FROM g WHERE g.x = below AND g.y = above AND gap = top) AS cut_not_at_largest_gap
FROM b JOIN z USING (t), gg, e""")
def replicate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicates in a high and a low state by their largest statistic, at two
    thresholds, with what speaks against two states."""
    o, n = _sides(spark, sf_dir, "replicate", "top")
    t = spark.createDataFrame([(x,) for x in _AT], "threshold double")
    top = materialize(n.groupBy("replicate").agg(F.max("top").alias("label_statistic")))
    cut = top.agg(F.percentile("label_statistic", 0.7).alias("cut"))
    labels = materialize(top.crossJoin(F.broadcast(cut)).select("replicate", (F.col("label_statistic") >= F.col("cut")).alias("high"), "label_statistic"))
    seen = nulls.exceedances(o.withColumn("replicate", F.lit(0)), "top", t).select("threshold", F.col("n").alias("n_observed"))
    out = diagnostics.two_states(nulls.exceedances(n, "top", t), labels, seen)
    digits = dict.fromkeys(("mean_high", "sd_high", "mean_low", "sd_low"), 6) | dict.fromkeys(("share_low", "share_high", "fdp", "fdp_low", "fdp_high"), 7) | {"share": 9, "largest_gap": 4, "gap_ratio": 5}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(f"""WITH {_O}, v AS (SELECT replicate, count_if(top >= {_AT[1]}) AS v FROM n GROUP BY replicate), k AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '{_SEED}', replicate))) AS r, count(*) OVER () AS n FROM v),
h AS (SELECT *, r <= least(greatest(1, CAST(round_even(n * 0.3::double, 0) AS int)), n - 1) AS held FROM k), e AS (SELECT avg(v) AS expected FROM h WHERE NOT held)
SELECT replicate, v AS n_calls, round(expected, 6) AS expected, round(expected / greatest(v, 1), 6) AS fdp FROM h, e WHERE held""")
def null_on_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out replicates called at a threshold as if they were observed."""
    out = diagnostics.null_on_null(_sides(spark, sf_dir, "replicate", "top")[1], "top", _AT[1], 0.3, _SEED)
    return out.withColumns({c: F.round(c, 6) for c in ("expected", "fdp")})


_SIDE = ", ".join(f"round(avg(top) FILTER ({g}), 5) AS {s}_mean, round(stddev_pop(top) FILTER ({g}), 4) AS {s}_deviation, round(avg(CASE WHEN top >= {_AT[1]} THEN 1.0::double ELSE 0 END) FILTER ({g}), 9) AS {s}_rate, " + ", ".join(f"round(quantile_cont(top, {q}) FILTER ({g}), 6) AS {s}_q{round(100 * q)}" for q in (0.5, 0.9, 0.99)) for s, g in (("observed", "side = 'F'"), ("null", "side = 'O'")))


@query(f"""WITH {analysis._S}, c AS (SELECT * FROM s WHERE event_type = 'A'), u AS (SELECT top, count_if(side = 'F') AS a, count_if(side = 'O') AS b FROM c GROUP BY top), t AS (SELECT CAST(sum(a) AS double) AS na, CAST(sum(b) AS double) AS nb FROM u),
f AS (SELECT sum(a) OVER (ORDER BY top) / na - sum(b) OVER (ORDER BY top) / nb AS d FROM u, t), k AS (SELECT max(abs(d)) AS ks FROM f),
p AS (SELECT ks, CASE WHEN ks * sqrt(na * nb / (na + nb)) < 0.2 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0::double ELSE -2.0::double END) * exp(-2.0::double * j * j * ks * ks * na * nb / (na + nb)))))) END AS ks_p FROM k, t)
SELECT CAST(na AS bigint) AS n_observed, CAST(nb AS bigint) AS n_null, round(ks, 9) AS ks, round(ks_p, 7) AS ks_p, r.* FROM t, p, (SELECT {_SIDE} FROM c) r""")
def unchanged_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed and null statistics of rows that cannot hold a switch."""
    o, n = (df.withColumn("ac", F.when(F.col("event_type") == "A", 1).otherwise(-1)) for df in _sides(spark, sf_dir, "event_type", "top"))
    out = diagnostics.control(o, n, "top", "ac", _AT[1])
    digits = {"ks": 9, "ks_p": 7, "observed_mean": 5, "null_mean": 5, "observed_deviation": 4, "null_deviation": 4, "observed_rate": 9, "null_rate": 9}
    return out.select(*(F.round(c, digits.get(c, 6)).alias(c) if c not in ("n_observed", "n_null") else F.col(c) for c in out.columns))


@query(f"{_CALLS.format(lineitem='lineitem', part='part', orders='orders')}, x AS (SELECT coalesce(is_switch, false) AS percentile, greatest(score_left, score_right) >= {_AT[1]} AS calibrated FROM c), g AS (SELECT * FROM (VALUES (false), (true)) a(percentile), (VALUES (false), (true)) b(calibrated)) SELECT percentile, calibrated, count(x.percentile) AS n FROM g LEFT JOIN x USING (percentile, calibrated) GROUP BY ALL")
def rule_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the percentile rule beside those of one threshold."""
    calls = switches.adaptive_calls(materialize(facts(spark, sf_dir).select("event_type", "score_left", "score_right", "clade_left", "clade_right")))
    return diagnostics.head_to_head(calls, F.col("is_switch"), nulls.statistic(F.col("score_left"), F.col("score_right")) >= _AT[1])


_QCUT = "greatest(len(list_filter((SELECT list_sort(list_distinct(quantile_cont({0}, [" + ", ".join(f"{i / 10!r}" for i in range(11)) + "]))) FROM n), lambda e: e < {0})), 1) - 1"


@query(f"""WITH {_O}, r AS (SELECT node, position, event_type, avg(CASE WHEN top >= {_AT[1]} THEN 1.0::double ELSE 0 END) AS rate FROM n GROUP BY ALL),
x AS (SELECT 'node' AS covariate, CASE WHEN (SELECT count(DISTINCT node) FROM n) > 20 THEN CAST({_QCUT.format("node")} AS varchar) ELSE CAST(node AS varchar) END AS bin, rate FROM r
UNION ALL SELECT 'position', CASE WHEN (SELECT count(DISTINCT position) FROM n) > 20 THEN CAST({_QCUT.format("position")} AS varchar) ELSE CAST(position AS varchar) END, rate FROM r UNION ALL SELECT 'event_type', event_type, rate FROM r)
SELECT covariate, bin, count(*) AS n_tests, round(avg(rate), 9) AS rate FROM x GROUP BY ALL""")
def covariate_flatness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null exceedance rates by covariates, in quantiles where they have many values."""
    n = _sides(spark, sf_dir, "node", "position", "event_type", "top")[1]
    bins = diagnostics.covariate_bins(n, ["node", "position", "event_type"])
    return diagnostics.exceedance_rates(n, ["node", "position", "event_type"], "top", _AT[1], bins).withColumn("rate", F.round("rate", 9))


_SIZE = "greatest(len(list_filter(edges, lambda x: x < {0})), 1) - 1"
_QS = "[" + ", ".join(f"{i / _SIZES!r}" for i in range(_SIZES + 1)) + "]"
_MODEL = f"""{_O}, w AS (SELECT position, replicate, score_left AS score, clade_left AS clade FROM n UNION ALL SELECT position, replicate, score_right, clade_right FROM n),
k AS (SELECT list_sort(list_distinct(quantile_cont(clade, {_QS}))) AS edges FROM w), hot AS (SELECT position FROM w GROUP BY position ORDER BY count_if(score >= {_AT[1]}) DESC, position LIMIT {_HOT}),
c AS (SELECT replicate, position IN (SELECT position FROM hot) AS hot, {_SIZE.format("clade")} AS size_bin, count(*) AS t, count_if(score >= {_AT[1]}) AS e FROM w, k GROUP BY ALL),
a AS (SELECT hot, size_bin, sum(t) AS t, sum(e) AS e FROM c GROUP BY ALL), p AS (SELECT sum(t) AS pt, sum(e) AS pe FROM c), rp AS (SELECT replicate, sum(t) AS rt, sum(e) AS re FROM c GROUP BY replicate),
j AS (SELECT a.hot, a.size_bin, a.t - coalesce(c.t, 0) AS t, a.e - coalesce(c.e, 0) AS e, pt - rt AS pt, pe - re AS pe FROM a CROSS JOIN rp CROSS JOIN p LEFT JOIN c ON c.hot = a.hot AND c.size_bin = a.size_bin AND c.replicate = rp.replicate),
l AS (SELECT hot, size_bin, CASE WHEN t > 0 AND e > 0 AND pe > 0 THEN ln((e / CAST(t AS double)) / (pe / CAST(pt AS double))) ELSE 0 END AS x FROM j),
se AS (SELECT hot, size_bin, sqrt((count(*) - 1) * var_pop(x)) AS se FROM l GROUP BY ALL),
model AS (SELECT a.hot, CAST(a.size_bin AS int) AS size_bin, CAST(t AS bigint) AS n_trials, CAST(e AS bigint) AS n_exceed, CASE WHEN e = 0 THEN 1 ELSE (e / CAST(t AS double)) / (pe / CAST(pt AS double)) END AS multiplier, se FROM a JOIN se USING (hot, size_bin), p)"""


def _cell_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Null branches, edges of their sizes, and the multipliers of the cells."""
    null = facts(spark, sf_dir).where("side = 'O'")
    b = materialize(switches.melt_branches(null, ("position", "replicate")))
    edges = materialize(switches.quantile_edges(b, "clade", _SIZES))
    placed = diagnostics.in_cells(b, diagnostics.hot_positions(b, "score", _AT[1], _HOT), edges)
    cells = materialize(nulls.cells(placed, "score", _AT[1], ["replicate", "hot", "size_bin"]))
    return b, edges, nulls.multipliers(cells, ["hot", "size_bin"])


@query(f"WITH {_MODEL} SELECT hot, size_bin, n_trials, n_exceed, round(multiplier, 9) AS multiplier, round(se, 7) AS se_log FROM model")
def hot_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null exceedances of hot and cold positions by clade size, over the
    pooled rate, with the error that replicates give."""
    return _cell_model(spark, sf_dir)[2].withColumns({"multiplier": F.round("multiplier", 9), "se_log": F.round("se_log", 7)})


@query(f"""WITH {_MODEL}, u AS (SELECT score AS t, count(*) AS k FROM w GROUP BY score), tail AS (SELECT t, (sum(k) OVER (ORDER BY t DESC) + 1) / CAST((SELECT count(*) FROM w) + 1 AS double) AS survival FROM u),
d AS (SELECT list_sort(list_distinct(quantile_cont(clade, {[i / 10 for i in range(11)]}))) AS edges FROM w), y AS (SELECT CAST({_SIZE.format("clade")} AS int) AS bin, clade, edges FROM w, d),
m AS (SELECT bin, edges[bin + 1] AS lower, edges[bin + 2] AS upper, quantile_cont(clade, 0.5) AS med FROM y GROUP BY ALL),
q AS (SELECT m.*, {_SIZE.format("med")} AS size_bin FROM m, k), r AS (SELECT q.*, 0.01::double / coalesce(multiplier, 1) AS s FROM q LEFT JOIN model ON NOT hot AND model.size_bin = q.size_bin)
SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper, round(med, 6) AS median_size, round(coalesce(min(t) FILTER (survival <= s), max(t)), 6) AS threshold FROM r, tail GROUP BY bin, lower, upper, med""")
def bin_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistic that each decile of clade sizes needs at a cold position."""
    b, edges, cells = _cell_model(spark, sf_dir)
    out = diagnostics.bin_projection(b, materialize(cells), edges, b, "score", _Z, 10)
    return out.withColumns({c: F.round(c, 6) for c in ("lower", "upper", "median_size", "threshold")})


_LC = "lgamma(CAST({0} + 1 AS double)) - lgamma(CAST({1} + 1 AS double)) - lgamma(CAST({0} - {1} + 1 AS double))"


@query(f"""WITH {_O}, {analysis._DOM}, g AS (SELECT domain, count_if(side = 'F' AND top >= {_AT[1]}) AS a, count_if(side = 'O' AND top >= {_AT[1]}) AS e, count_if(side = 'F') AS t FROM s JOIN dom ON position BETWEEN lo AND hi GROUP BY domain),
x AS (SELECT domain, a, e, t, a + least(e, t) AS kk, unnest(range(greatest(0, a + least(e, t) - t), least(t, a + least(e, t)) + 1)) AS i FROM g),
y AS (SELECT *, {_LC.format("kk", "i")} + {_LC.format("(2 * t - kk)", "(t - i)")} - ({_LC.format("(2 * t)", "t")}) AS l FROM x), o1 AS (SELECT domain, l AS la FROM y WHERE i = a)
SELECT domain, a AS observed_hits, e AS expected_hits, t AS total, round(a / CAST(greatest(1, e) AS double), 9) AS fold_enrichment, round(least(1, sum(exp(l)) FILTER (l <= la + 1e-7)), 7) AS pvalue,
  round(log2(greatest(0.01::double, CAST(a AS double) * (t - least(e, t)) / (CAST(t - a AS double) * least(e, t)))), 9) AS log2_odds_ratio FROM y JOIN o1 USING (domain) GROUP BY domain, a, e, t""")
def two_sided_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed calls of each domain against the null's."""
    f = summaries.in_domains(analysis._facts(spark, sf_dir, "side", "position", "top"), analysis._domains(spark), "position")
    seen, hit = F.col("side") == "F", F.col("top") >= _AT[1]
    g = f.groupBy("domain").agg(F.count_if(seen & hit).alias("observed_hits"), F.count_if(~seen & hit).alias("expected_hits"), F.count_if(seen).alias("total"))
    return stats.enrichment_table(g, "observed_hits", "expected_hits", "total").withColumns({"fold_enrichment": F.round("fold_enrichment", 9), "pvalue": F.round("pvalue", 7), "log2_odds_ratio": F.round("log2_odds_ratio", 9)})


def queries() -> dict[str, Query]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
