"""Scores, calibration and corrections over the given tables, with DuckDB SQL
written apart. Stand-ins as in ``analysis``: rows of line status F are
observed, those of O null; languages are the nodes of an alignment of whole
texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import covers, intervals, nulls, posterior, scoring, switches, tail_model
from ..session import materialize, table
from . import analysis
from .divergence import facts

Query = Callable[[SparkSession, str], DataFrame]
Q: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("count_if(", "count(*) FILTER (")
        return f

    return register


_RC = "n AS (SELECT node, position, sum(n) AS n FROM c GROUP BY ALL), v AS (SELECT x.node, x.position, sum(CASE WHEN NOT (x.residue BETWEEN 'A' AND 'Z' AND y.residue BETWEEN 'A' AND 'Z') THEN 0 WHEN x.residue = y.residue THEN 4.0::double * x.n * (x.n - 1) WHEN x.residue IN ('A','E','I','O','U') AND y.residue IN ('A','E','I','O','U') THEN 1.0::double * x.n * y.n ELSE -1.0::double * x.n * y.n END) AS v FROM c x JOIN c y ON x.node = y.node AND x.position = y.position GROUP BY ALL), rc AS (SELECT node, position, CASE WHEN n = 1 THEN 1 ELSE greatest(0, least(1, (v / (CAST(n AS double) * (n - 1)) + 4) / 15)) END AS rc FROM n JOIN v USING (node, position))"


@query(f"""WITH {analysis._STATES}, {_RC}, f AS (
  SELECT l, r, e.position, al, ar, ac, coalesce(a.rc, 0) AS rl, coalesce(b.rc, 0) AS rr,
    CASE WHEN ac = 1 THEN coalesce(ql, 0) ELSE 1 - coalesce(ql, 0) END AS pl, CASE WHEN ac = 1 THEN coalesce(qr, 0) ELSE 1 - coalesce(qr, 0) END AS pr
  FROM e LEFT JOIN rc a ON a.node = l AND a.position = e.position LEFT JOIN rc b ON b.node = r AND b.position = e.position)
SELECT l AS "left", r AS "right", position, al AS aa_left, ar AS aa_right, ac, round(rl, 9) AS rc_left, round(rr, 9) AS rc_right, round(pl, 9) AS p_ac_left, round(pr, 9) AS p_ac_right, round(rl - ac * pl, 9) AS score_left, round(rr - ac * pr, 9) AS score_right FROM f""")
def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table of every two languages: conservation, agreement, its
    probability and the score of both sides at every place of the texts."""
    residues = analysis._alignment(spark, sf_dir)
    s = analysis._states(residues)
    n = s.select("node").distinct()
    pairs = n.toDF("left").join(n.toDF("right"), F.col("left") < F.col("right"))
    rc = materialize(scoring.recent_conservation(residues, analysis._matrix(spark)))
    out = scoring.score_pairs(pairs, s, rc, digits=9)
    return out.select("left", "right", "position", "aa_left", "aa_right", "ac", *(f"{c}_{x}" for c in ("rc", "p_ac", "score") for x in ("left", "right")))


_CUT = 80000


@query(f"""WITH {analysis._S}, n AS (SELECT * FROM s WHERE side = 'O'), u AS (SELECT top AS t, count(*) AS k FROM n GROUP BY top),
tail AS (SELECT t, (sum(k) OVER (ORDER BY t DESC) + 1) / CAST((SELECT count(*) FROM n) + 1 AS double) AS survival FROM u),
w AS (SELECT count(*) AS wt, count_if(top >= {_CUT}) AS we FROM n),
m AS (SELECT position, count(*) AS trials, count_if(top >= {_CUT}) AS exceed FROM n GROUP BY position),
a AS (SELECT position, CASE WHEN exceed = 0 THEN 1.0 ELSE (exceed / CAST(trials AS double)) / (we / CAST(wt AS double)) END AS multiplier FROM m, w),
o AS (SELECT position, top FROM s WHERE side = 'F'),
z AS (SELECT o.position, multiplier, -log10(multiplier * coalesce(survival, 1 / CAST(wt + 1 AS double))) AS z FROM o JOIN a USING (position) CROSS JOIN w ASOF LEFT JOIN tail ON o.top <= tail.t),
b AS (SELECT position, coalesce(min(t) FILTER (survival <= 0.01::double / multiplier), max(t)) AS threshold FROM a, tail GROUP BY position)
SELECT position, round(multiplier, 9) AS multiplier, count(*) AS n, round(avg(z), 6) AS mean_z, round(max(z), 6) AS top_z, round(threshold, 6) AS threshold FROM z JOIN b USING (position) GROUP BY position, multiplier, threshold""")
def cell_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed statistics on the z scale of their position's null, and the
    statistic that each position needs to reach z = 2."""
    f = materialize(facts(spark, sf_dir).withColumn("top", nulls.statistic(F.col("score_left"), F.col("score_right"))).select("position", "side", "replicate", "top"))
    null = f.where("side = 'O'")
    a = materialize(nulls.multipliers(materialize(nulls.cells(null, "top", _CUT, ["position", "replicate"])), ["position"]).select("position", "multiplier"))
    seen = nulls.survival_among(f.where("side = 'F'").select("position", "top"), null, "top", "top").join(a, "position")
    z = seen.withColumn("z", -F.log10(F.col("multiplier") * F.col("survival")))
    need = nulls.quantile_among(a.withColumn("_q", F.lit(0.01) / F.col("multiplier")), null, "top", "_q", "threshold").select("position", "threshold")
    out = z.groupBy("position", "multiplier").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"), F.max("z").alias("top_z")).join(need, "position")
    return out.select("position", F.round("multiplier", 9).alias("multiplier"), "n", *(F.round(c, 6).alias(c) for c in ("mean_z", "top_z", "threshold")))


_POINTS, _SEED = 101, 3
_SHARES = "[" + ", ".join(f"{i / (_POINTS - 1)!r}" for i in range(_POINTS)) + "]"
_ROWS = "SELECT l_orderkey, l_linenumber, (1 + l_partkey % 50) / CAST(50 AS double) AS rc, least(1.0::double, l_quantity / CAST({0} AS double)) AS p FROM lineitem WHERE l_linestatus = '{1}'"
_AT = "len(list_filter(edges, lambda x: x <= rc))"


@query(f"""WITH n0 AS ({_ROWS.format(25, "O")}), o0 AS ({_ROWS.format(30, "F")}),
q AS (SELECT list_sort(list_distinct(quantile_cont(rc, [0.2, 0.4, 0.6, 0.8]))) AS xs, min(rc) AS least, quantile_cont(rc, 0.5) AS half FROM o0),
e AS (SELECT list_filter(xs, lambda x: x > least) AS edges, half FROM q),
n AS (SELECT n0.*, {_AT} AS bin FROM n0, e), o AS (SELECT o0.*, {_AT} AS bin FROM o0, e),
fit AS (SELECT bin FROM (SELECT bin, count(*) AS a FROM n GROUP BY bin) JOIN (SELECT bin, count(*) AS b FROM o GROUP BY bin) USING (bin), e WHERE a >= 200 AND b >= 200 AND bin <= len(list_filter(edges, lambda x: x <= half))),
src AS (SELECT bin, quantile_cont(p, {_SHARES}) AS s FROM n GROUP BY bin), tgt AS (SELECT bin, quantile_cont(p, {_SHARES}) AS t FROM o JOIN fit USING (bin) GROUP BY bin),
i AS (SELECT unnest(range(1, {_POINTS + 1})) AS i), shift AS (SELECT i, avg(t[i] - s[i]) AS d FROM src JOIN tgt USING (bin), i GROUP BY i),
rest AS (SELECT bin, i, max(greatest(0, least(1, s[i] + d))) OVER (PARTITION BY bin ORDER BY i) AS v FROM src, shift WHERE bin NOT IN (SELECT bin FROM fit)),
map AS (SELECT bin, s, t FROM src JOIN tgt USING (bin) UNION ALL SELECT bin, s, t FROM src JOIN (SELECT bin, list(v ORDER BY i) AS t FROM rest GROUP BY bin) USING (bin)),
a AS (SELECT bin, p, t, least(len(list_filter(s, lambda x: x < p)), {_POINTS - 1}) AS lo, greatest(len(list_filter(s, lambda x: x <= p)) - 1, 0) AS hi, CAST('0x' || substr(md5(concat_ws('|', '{_SEED}', l_orderkey, l_linenumber)), 1, 13) AS bigint) / CAST(4503599627370496 AS double) AS u FROM n JOIN map USING (bin)),
b AS (SELECT bin, p, t, lo + u * greatest(hi - lo, 0) AS r FROM a),
c AS (SELECT bin, p, t[CAST(floor(r) AS int) + 1] + (t[least(CAST(floor(r) AS int) + 2, {_POINTS})] - t[CAST(floor(r) AS int) + 1]) * (r - floor(r)) AS v FROM b)
SELECT CAST(bin AS int) AS bin, count(*) AS n, round(avg(p), 6) AS mean_before, round(avg(v), 6) AS mean_after, count_if(p = 1) AS at_one_before, count_if(v > 1 - 1e-9) AS at_one_after FROM c GROUP BY bin""")
def posterior_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null probabilities with a large atom moved onto the observed scale,
    fitted below the median of conservation, by bin."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", ((1 + F.col("l_partkey") % 50) / F.lit(50.0)).alias("rc"), "l_quantity")
    side = lambda status, over: rows.where(F.col("l_linestatus") == status).withColumn("p", F.least(F.lit(1.0), F.col("l_quantity") / F.lit(float(over))))
    null = side("O", 25)
    c = posterior.fit(null, side("F", 30), "rc", "p", bins=5, grid=_POINTS)
    out = c.apply(null, "rc", "p", ["l_orderkey", "l_linenumber"], _SEED).withColumn("bin", posterior.bin_of(F.col("rc"), c.edges))
    return out.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_before"), F.round(F.avg("corrected"), 6).alias("mean_after"), F.count_if(F.col("p") == 1).alias("at_one_before"), F.count_if(F.col("corrected") > 1 - 1e-9).alias("at_one_after"))


_CUBE = "(pow(greatest(depth - k[{0}], 0), 3) - pow(greatest(depth - k[5], 0), 3)) / (k[5] - k[{0}])"


@query(f"WITH {analysis._S}, d AS (SELECT node, position, depth / CAST(100000 AS double) AS depth FROM s), k AS (SELECT quantile_cont(depth, [0.0, 0.25, 0.5, 0.75, 1.0]) AS k FROM d), b AS (SELECT position, depth AS b1, " + ", ".join(f"{_CUBE.format(i)} - {_CUBE.format(4)} AS b{i + 1}" for i in (1, 2, 3)) + " FROM d, k) SELECT position, count(*) AS n, round(avg(b1), 6) AS b1, round(avg(b2), 6) AS b2, round(avg(b3), 6) AS b3, round(avg(b4), 6) AS b4 FROM b GROUP BY position")
def spline_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = materialize(facts(spark, sf_dir).select("position", (F.col("depth") / F.lit(100000.0)).alias("depth")))
    b = tail_model.spline_basis(F.col("depth"), tail_model.spline_knots(d, "depth", 4))
    return d.select("position", *(c.alias(f"b{i}") for i, c in enumerate(b, 1))).groupBy("position").agg(F.count("*").alias("n"), *(F.round(F.avg(f"b{i}"), 6).alias(f"b{i}") for i in range(1, 5)))


@query(f"""WITH {analysis._UP}, sc AS (SELECT 's' || s_suppkey AS node, s_acctbal AS score FROM supplier UNION ALL SELECT 'n' || c_nationkey, max(c_acctbal) FROM customer GROUP BY 1),
cut AS (SELECT unnest([0.5, 0.75, 0.9])::double AS share), c AS (SELECT share, (SELECT quantile_cont(score, [0.5, 0.75, 0.9]) FROM sc)[CASE share WHEN 0.5 THEN 1 WHEN 0.75 THEN 2 ELSE 3 END] AS cutoff FROM cut),
m AS (SELECT share, cutoff, node FROM sc, c WHERE score >= cutoff),
tips AS (SELECT node AS leaf, node AS a0, parent AS a1 FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree x WHERE x.parent = t.node)),
f AS (SELECT c.share, leaf, coalesce(x.node, y.node) AS found FROM tips CROSS JOIN c LEFT JOIN m x ON x.share = c.share AND x.node = a0 LEFT JOIN m y ON y.share = c.share AND y.node = a1),
z AS (SELECT share, found, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT share, any_value(cutoff) AS cutoff, count(*) AS n_marked FROM m GROUP BY share)
SELECT share, round(any_value(cutoff), 6) AS cutoff, any_value(n_marked) AS n_marked, any_value(n_marked) + 1 AS n_clades, CAST(sum(n) AS bigint) AS n_leaves, CAST(coalesce(sum(n) FILTER (found IS NULL), 0) AS bigint) AS root_leaves, count_if(n > 1) AS n_multiple, count_if(n = 1) AS n_single, max(n) AS largest, round(max(n) / CAST(sum(n) AS double), 9) AS largest_share, round(median(n), 6) AS median_size FROM z JOIN k USING (share) GROUP BY share""")
def partition_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the tree of suppliers at three cutoffs of their balances."""
    scores = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_acctbal").alias("score"))
    scores = materialize(scores.unionByName(table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("node")).agg(F.max("c_acctbal").alias("score"))))
    out = intervals.partition_sweep(materialize(analysis._tree(spark, sf_dir)), scores, [0.5, 0.75, 0.9])
    return out.drop("other_leaves", "other_share").withColumns({c: F.round(c, n) for c, n in (("cutoff", 6), ("largest_share", 9), ("median_size", 6))})


@query()
def set_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that together sell every part; iterative, so beyond SQL:
    tests hold the operator against the plain procedure."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return covers.set_cover(rows, "l_partkey", "l_suppkey")


@query()
def tail_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position effects of null exceedances, given both clades' sizes, at the
    penalty that held-out replicates choose. A fit is beyond SQL: tests hold
    it against Newton steps over dense arrays."""
    both = facts(spark, sf_dir).where("side = 'O'").withColumns({"own": F.ln("clade_left"), "other": F.ln("clade_right")})
    branches = switches.melt_branches(both, ("position", "replicate", "own", "other"))
    size = F.ln("clade")
    b = materialize(branches.select("position", "replicate", "score", size.alias("own"), (F.col("own") + F.col("other") - size).alias("sib")))
    knots = {"own": tail_model.spline_knots(b, "own", 3), "sib": tail_model.spline_knots(b, "sib", 2)}
    cells = materialize(tail_model.cell_table(tail_model.quantile_bins(b, {"own": 6, "sib": 4}), "score", 60000.0, ["own", "sib"], folds=3))
    plane = b.select("position").distinct().select("position", F.array(F.col("position") / F.lit(50.0)).alias("z"))
    rate = cells.agg((F.sum("n_exceed") / F.sum("n_trials")).alias("r")).first()["r"]
    m = tail_model.fit(cells, plane, knots, rate, [0.1, 10.0, 1000.0], folds=3)
    n = cells.groupBy("position").agg(F.sum("n_trials").alias("n_trials"), F.sum("n_exceed").alias("n_exceed"))
    return m.positions.join(n, "position").select("position", "n_trials", "n_exceed", F.round("a", 6).alias("a"), F.lit(m.penalty).alias("penalty"), F.lit(m.converged).alias("converged"))


def queries() -> dict[str, Query]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
