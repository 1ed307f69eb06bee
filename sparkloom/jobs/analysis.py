"""The operators over the given tables, each with DuckDB SQL written apart.

Stand-ins: the score table is read from line items, parts and orders; rows of
line status F are observed, those of status O null replicates; documents are
an alignment by language; regions, nations and suppliers are a tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import columns, intervals, nulls, ranks, residues, scoring, stats, summaries, trees
from ..session import materialize, table
from .divergence import FACTS, facts

Query = Callable[[SparkSession, str], DataFrame]

DOMAINS = [("d1", 1, 5), ("d2", 6, 15), ("d3", 16, 25), ("d4", 26, 35), ("d5", 36, 45), ("d6", 46, 50)]
CUT = 80000.0
Q: dict[str, Query] = {}
SQL: dict[str, str] = {}

_S = f"d1 AS ({FACTS}), s AS (SELECT *, greatest(score_left, score_right) AS top FROM d1)".format(lineitem="lineitem", part="part", orders="orders")
_DOM = "dom AS (SELECT * FROM (VALUES " + ", ".join(str(d) for d in DOMAINS) + ") v(domain, lo, hi))"
_LF = "lgamma(CAST({0} AS double) + 1)"
_TREE = "tree AS (SELECT 'root' AS node, CAST(NULL AS varchar) AS parent, 0.0::double AS len UNION ALL SELECT 'r' || r_regionkey, 'root', CAST(r_regionkey + 1 AS double) FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CAST(n_nationkey + 1 AS double) FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, CAST(s_suppkey % 7 + 1 AS double) FROM supplier)"
_UP = f"{_TREE}, up AS (SELECT s.node AS leaf, s.node AS a0, n.node AS a1, r.node AS a2, 'root' AS a3, s.len AS l0, n.len AS l1, r.len AS l2 FROM tree s JOIN tree n ON s.parent = n.node JOIN tree r ON n.parent = r.node WHERE s.node LIKE 's%')"


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        Q[f.__name__], SQL[f.__name__] = f, sql.replace("count_if(", "count(*) FILTER (")
        return f

    return register


def _facts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns a query needs of the score table, joined and written once."""
    df = facts(spark, sf_dir).withColumn("top", nulls.statistic(F.col("score_left"), F.col("score_right")))
    return materialize(df.select(*columns))


def _domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOMAINS, "domain string, first int, last int")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda name, node, parent, length: table(spark, sf_dir, name).select(node.alias("node"), parent.alias("parent"), length.cast("double").alias("length"))
    c, k = F.col, lambda p, x: F.concat(F.lit(p), F.col(x))
    root = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("length"))
    return root.unionByName(rows("region", k("r", "r_regionkey"), F.lit("root"), c("r_regionkey") + 1)).unionByName(rows("nation", k("n", "n_nationkey"), k("r", "n_regionkey"), c("n_nationkey") + 1)).unionByName(rows("supplier", k("s", "s_suppkey"), k("n", "s_nationkey"), c("s_suppkey") % 7 + 1))


@query(f"WITH {_S}, c AS (SELECT unnest([0.95, 0.97, 0.99])::double AS share), t AS (SELECT share, (SELECT quantile_cont(top, [0.95, 0.97, 0.99]) FROM s)[CASE share WHEN 0.95 THEN 1 WHEN 0.97 THEN 2 ELSE 3 END] AS threshold FROM c) SELECT share, round(threshold, 6) AS threshold, count(*) AS n, count(DISTINCT position) AS n_positions, round(avg(depth), 4) AS mean_depth, round(median(depth), 6) AS median_depth FROM s JOIN t ON top >= threshold GROUP BY share, threshold")
def percentile_threshold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.threshold_stats(_facts(spark, sf_dir, "top", "position", "depth"), "top", [0.95, 0.97, 0.99], "position", "depth")
    return out.select("share", F.round("threshold", 6).alias("threshold"), "n", "n_positions", F.round("mean_depth", 4).alias("mean_depth"), F.round("median_depth", 6).alias("median_depth"))


@query(f"WITH {_S} SELECT event_type, count(*) AS n, round(avg(top), 4) AS mean, round(stddev_samp(top), 4) AS deviation, round(quantile_cont(top, 0.25), 6) AS q25, round(median(top), 6) AS median, round(quantile_cont(top, 0.75), 6) AS q75 FROM s GROUP BY event_type")
def event_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = summaries.described(_facts(spark, sf_dir, "top", "event_type"), "top", ["event_type"])
    return d.select("event_type", "n", *(F.round(c, 4).alias(c) for c in ("mean", "deviation")), *(F.round(c, 6).alias(c) for c in ("q25", "median", "q75")))


@query(f"WITH {_S}, n AS (SELECT * FROM s WHERE side = 'O'), m AS (SELECT 'all' AS level, replicate, max(top) AS top FROM n GROUP BY replicate UNION ALL SELECT CAST(position AS varchar), replicate, max(top) FROM n GROUP BY position, replicate), t AS (SELECT level, quantile_cont(top, 0.95) AS threshold, count(*) AS n_replicates FROM m GROUP BY level) SELECT level, round(t.threshold, 6) AS threshold, n_replicates, (SELECT count(*) FROM s WHERE side = 'F' AND (t.level = 'all' OR CAST(position AS varchar) = t.level) AND top >= t.threshold) AS n_calls FROM t")
def maxt_fwer(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir, "side", "replicate", "position", "top")
    cut = nulls.max_t(f.where("side = 'O'"), "top", 0.05, by="position")
    seen = f.where("side = 'F'").select("top", F.explode(F.array(F.lit("all"), F.col("position").cast("string"))).alias("level"))
    n = seen.join(F.broadcast(cut), "level").groupBy("level").agg(F.count_if(F.col("top") >= F.col("threshold")).alias("n_calls"))
    return cut.join(n, "level", "left").select("level", F.round("threshold", 6).alias("threshold"), "n_replicates", F.coalesce("n_calls", F.lit(0)).alias("n_calls"))


@query(f"WITH {_S}, m AS (SELECT position, replicate, max(top) AS top FROM s WHERE side = 'O' GROUP BY ALL) SELECT position, count(*) AS n_replicates, round(quantile_cont(top, 0.95), 8) AS threshold FROM m GROUP BY position")
def maxt_position_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir, "side", "replicate", "position", "top").where("side = 'O'")
    return nulls.max_t(f, "top", 0.05, by="position").where("level <> 'all'").select(F.col("level").cast("int").alias("position"), "n_replicates", F.round("threshold", 8).alias("threshold"))


@query(f"WITH {_S}, t AS (SELECT DISTINCT CAST(p_size * 2000 AS double) AS threshold FROM part), r AS (SELECT DISTINCT replicate FROM s WHERE side = 'O') SELECT threshold, r.replicate, count(s.top) AS n FROM t CROSS JOIN r LEFT JOIN s ON s.side = 'O' AND s.replicate = r.replicate AND s.top >= t.threshold GROUP BY ALL")
def null_exceedances(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = table(spark, sf_dir, "part").select((F.col("p_size") * 2000).cast("double").alias("threshold"))
    return nulls.exceedances(_facts(spark, sf_dir, "side", "replicate", "top").where("side = 'O'"), "top", cuts)


_SWEEP = f"{_S}, o AS (SELECT top AS t, count(*) AS n FROM s WHERE side = 'F' GROUP BY top), g AS (SELECT t, CAST(sum(n) OVER (ORDER BY t DESC) AS bigint) AS o FROM o), r AS (SELECT DISTINCT replicate FROM s WHERE side = 'O'), c AS (SELECT replicate, top, CAST(sum(n) OVER (PARTITION BY replicate ORDER BY top DESC) AS bigint) AS v FROM (SELECT replicate, top, count(*) AS n FROM s WHERE side = 'O' GROUP BY ALL)), x AS (SELECT g.t, g.o, r.replicate FROM g CROSS JOIN r), w AS (SELECT x.t, x.o, coalesce(c.v, 0) AS v FROM x ASOF LEFT JOIN c ON x.replicate = c.replicate AND x.t <= c.top), f AS (SELECT t, max(o) AS n_observed, CAST(sum(v) AS bigint) AS n_null, CAST(sum(v) AS double) / count(*) / max(o) AS fdp_mean, quantile_cont(v / CAST(o AS double), 0.9) AS fdp FROM w GROUP BY t)"


def _swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir, "side", "replicate", "top")
    return nulls.sweep(f.where("side = 'F'"), f.where("side = 'O'"), "top")


@query(f"WITH {_SWEEP} SELECT t, n_observed, n_null, round(fdp_mean, 9) AS fdp_mean, round(fdp, 9) AS fdp FROM f")
def fdp_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _swept(spark, sf_dir).select("t", "n_observed", "n_null", F.round("fdp_mean", 9).alias("fdp_mean"), F.round("fdp", 9).alias("fdp"))


@query(f"WITH {_SWEEP}, q AS (SELECT DISTINCT CAST(p_size AS double) / 40 AS q FROM part) SELECT q.q, min(f.t) AS threshold, arg_min(f.n_observed, f.t) AS n_calls, round(arg_min(f.fdp, f.t), 9) AS fdp FROM q LEFT JOIN f ON f.fdp <= q.q GROUP BY q.q")
def threshold_at_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = table(spark, sf_dir, "part").select((F.col("p_size").cast("double") / 40).alias("q"))
    return nulls.threshold_at(materialize(_swept(spark, sf_dir)), goals).withColumn("fdp", F.round("fdp", 9))


@query(f"WITH {_S}, t AS (SELECT unnest([20000, 60000, 80000, 95000])::double AS threshold), r AS (SELECT DISTINCT replicate FROM s WHERE side = 'O'), o AS (SELECT threshold, count(s.top) AS o FROM t LEFT JOIN s ON side = 'F' AND top >= threshold GROUP BY threshold), v AS (SELECT t.threshold, r.replicate, count(s.top) AS v FROM t CROSS JOIN r LEFT JOIN s ON side = 'O' AND s.replicate = r.replicate AND top >= threshold GROUP BY ALL), w AS (SELECT *, v / CAST(greatest(o, 1) AS double) AS x FROM v JOIN o USING (threshold)) SELECT threshold, max(o) AS n_observed, round(avg(v), 9) AS expected_false, min(v) AS least_false, max(v) AS most_false, round(avg(x), 9) AS fdp_mean, round(median(x), 9) AS fdp_median, round(min(x), 9) AS fdp_min, round(max(x), 9) AS fdp_max, round(quantile_cont(x, 0.9), 9) AS fdp, round((1 + count_if(v >= o)) / CAST(1 + count(*) AS double), 9) AS p FROM w GROUP BY threshold")
def describe_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir, "side", "replicate", "top")
    cuts = spark.createDataFrame([(20000.0,), (60000.0,), (80000.0,), (95000.0,)], "threshold double")
    d = nulls.describe(f.where("side = 'F'"), f.where("side = 'O'"), "top", cuts)
    return d.select(*(F.round(c, 9).alias(c) if t == "double" and c != "threshold" else c for c, t in d.dtypes))


@query(f"WITH {_S}, n AS (SELECT replicate, position, max(top) AS top FROM s WHERE side = 'O' GROUP BY ALL), o AS (SELECT position, max(top) AS top FROM s WHERE side = 'F' GROUP BY ALL), e AS (SELECT o.position, count(n.top) AS n_over FROM o LEFT JOIN n ON o.position = n.position AND n.top >= o.top GROUP BY ALL), p AS (SELECT position, n_over, (1 + n_over) / CAST(1 + (SELECT count(DISTINCT replicate) FROM n) AS double) AS p FROM e) SELECT position, n_over, round(p, 9) AS p, round((SELECT min(least(1.0::double, b.p * (SELECT count(*) FROM p) / (SELECT count(*) FROM p c WHERE c.p <= b.p))) FROM p b WHERE b.p >= a.p), 9) AS q FROM p a")
def empirical_p_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir, "side", "replicate", "position", "top")
    top = F.max("top").alias("top")
    p = nulls.empirical_p(f.where("side = 'F'").groupBy("position").agg(top), f.where("side = 'O'").groupBy("replicate", "position").agg(top), "position", "top")
    return stats.bh(materialize(p), "p", ["position"]).select("position", "n_over", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query(f"WITH {_S}, z AS (SELECT top AS t, count(*) AS n FROM s WHERE side = 'O' GROUP BY top), k AS (SELECT t, sum(n) OVER () AS m, sum(n) OVER (ORDER BY t) - n AS below FROM z) SELECT t, CAST(below AS bigint) AS n_below, round((m - below + 1) / CAST(m + 1 AS double), 9) AS survival FROM k")
def pooled_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = nulls.tail(_facts(spark, sf_dir, "side", "top").where("side = 'O'"), "top")
    return t.select("t", "n_below", F.round("survival", 9).alias("survival"))


_HOTS = f"{_S}, c AS (SELECT position, count_if(side = 'F' AND top >= {CUT}) AS n FROM s GROUP BY position), h AS (SELECT position, n >= (SELECT avg(n) FROM c) AS hot FROM c), {_DOM}"


def _hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _facts(spark, sf_dir, "side", "position", "top").groupBy("position").agg(F.count_if((F.col("side") == "F") & (F.col("top") >= CUT)).alias("n"))
    mean = c.agg(F.avg("n").alias("m"))
    return summaries.in_domains(c.crossJoin(F.broadcast(mean)).withColumn("hot", F.col("n") >= F.col("m")), _domains(spark), "position")


@query(f"WITH {_HOTS}, a AS (SELECT domain, count(*) AS n, CAST(count_if(hot) AS bigint) AS k FROM h JOIN dom ON position BETWEEN lo AND hi GROUP BY domain), t AS (SELECT CAST(sum(n) AS bigint) AS nn, CAST(sum(k) AS bigint) AS kk FROM a), x AS (SELECT a.*, t.*, unnest(range(k, CAST(least(n, kk) AS bigint) + 1)) AS i FROM a, t), y AS (SELECT domain, n, k, (k / CAST(n AS double)) / (kk / CAST(nn AS double)) AS fold, least(1.0::double, sum(CASE WHEN n - i <= nn - kk THEN exp({_LF.format('kk')} - {_LF.format('i')} - {_LF.format('(kk - i)')} + {_LF.format('(nn - kk)')} - {_LF.format('(n - i)')} - {_LF.format('(nn - kk - n + i)')} - {_LF.format('nn')} + {_LF.format('n')} + {_LF.format('(nn - n)')}) ELSE 0 END)) AS p FROM x GROUP BY ALL) SELECT domain, n, k, round(fold, 9) AS fold, round(p, 9) AS p, round((SELECT min(least(1.0::double, b.p * (SELECT count(*) FROM y) / (SELECT count(*) FROM y c WHERE c.p <= b.p))) FROM y b WHERE b.p >= y.p), 8) AS q FROM y")
def hypergeom_domain_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = summaries.enrichment(materialize(_hot(spark, sf_dir)), "domain", "hot")
    return e.select("domain", "n", "k", F.round("fold", 9).alias("fold"), F.round("p", 9).alias("p"), F.round("q", 8).alias("q"))


@query(f"WITH {_S}, {_DOM}, a AS (SELECT domain, count_if(top >= {CUT}) AS a, count_if(top < {CUT}) AS b FROM s JOIN dom ON position BETWEEN lo AND hi WHERE side = 'F' AND event_type = 'A' GROUP BY domain), t AS (SELECT CAST(sum(a) AS bigint) AS ta, CAST(sum(b) AS bigint) AS tb FROM a), f AS (SELECT domain, CAST(a AS bigint) AS a, CAST(b AS bigint) AS b, CAST(ta - a AS bigint) AS c, CAST(tb - b AS bigint) AS d FROM a, t), x AS (SELECT *, unnest(range(a, least(a + b, a + c) + 1)) AS i FROM f) SELECT domain, a, b, c, d, round((CAST(a AS double) * d) / (CAST(b AS double) * c), 9) AS odds_ratio, round(least(1.0::double, sum(exp({_LF.format('(a + c)')} - {_LF.format('i')} - {_LF.format('(a + c - i)')} + {_LF.format('(b + d)')} - {_LF.format('(a + b - i)')} - {_LF.format('(b + d - (a + b - i))')} - {_LF.format('(a + b + c + d)')} + {_LF.format('(a + b)')} + {_LF.format('(c + d)')}))), 7) AS p FROM x WHERE a + b - i <= b + d GROUP BY domain, a, b, c, d")
def fisher_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir, "side", "event_type", "position", "top").where("side = 'F' AND event_type = 'A'")
    a = summaries.in_domains(f, _domains(spark), "position").groupBy("domain").agg(F.count_if(F.col("top") >= CUT).alias("a"), F.count_if(F.col("top") < CUT).alias("b"))
    t = a.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    x = a.crossJoin(F.broadcast(t)).select("domain", "a", "b", (F.col("ta") - F.col("a")).alias("c"), (F.col("tb") - F.col("b")).alias("d"))
    return stats.fisher(x, "a", "b", "c", "d").select("domain", "a", "b", "c", "d", F.round("odds_ratio", 9).alias("odds_ratio"), F.round("p", 7).alias("p"))


@query(f"WITH {_S}, e AS (SELECT event_type, count(DISTINCT position) AS n, count_if(top >= {CUT}) / CAST(count(*) AS double) AS p FROM s GROUP BY event_type), x AS (SELECT *, unnest(range(0, n + 1)) AS k FROM e), m AS (SELECT *, exp({_LF.format('n')} - {_LF.format('k')} - {_LF.format('(n - k)')} + k * ln(p) + (n - k) * ln(1 - p)) AS pmf FROM x), t AS (SELECT event_type, n, k, sum(pmf) OVER (PARTITION BY event_type ORDER BY k DESC) AS tail FROM m) SELECT event_type, n, coalesce(min(k) FILTER (tail < 0.05), n + 1) AS critical_k, coalesce(min(k) FILTER (tail < 0.05 / n), n + 1) AS bonferroni_k FROM t GROUP BY event_type, n")
def binomial_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _facts(spark, sf_dir, "event_type", "position", "top").groupBy("event_type").agg(F.count_distinct("position").alias("n"), (F.count_if(F.col("top") >= CUT) / F.count("*")).alias("p"))
    x = stats.binomial_critical(e, "n", "p", F.lit(0.05), "critical_k")
    return stats.binomial_critical(x, "n", "p", F.lit(0.05) / F.col("n"), "bonferroni_k").drop("p")


_TWO = "v AS (SELECT n_chars AS x, quality AS g FROM documents JOIN labels USING (doc_id)), u AS (SELECT x, count_if(g = 1) AS a, count_if(g = 0) AS b FROM v GROUP BY x), t AS (SELECT CAST(sum(a) AS double) AS na, CAST(sum(b) AS double) AS nb FROM u), f AS (SELECT a, b, sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb FROM u)"


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = materialize(table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").select("n_chars", "quality"))
    return stats.two_samples(both, "n_chars", F.col("quality") == 1)


@query(f"WITH {_TWO} SELECT CAST(max(na) AS bigint) AS n1, CAST(max(nb) AS bigint) AS n0, round(max(abs(ca / na - cb / nb)), 9) AS ks FROM f, t")
def ks_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir).select("n1", "n0", F.round("ks", 9).alias("ks"))


@query(f"WITH {_TWO} SELECT CAST(max(na) AS bigint) AS n1, CAST(max(nb) AS bigint) AS n0, round(sum(a * (cb - b + b / 2.0::double)), 6) AS u, round(2 * sum(a * (cb - b + b / 2.0::double)) / max(na * nb) - 1, 9) AS delta FROM f, t")
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir).select("n1", "n0", F.round("u", 6).alias("u"), F.round("delta", 9).alias("delta"))


@query(f"WITH {_S}, v AS (SELECT node, count(*) AS x, count_if(top >= 60000) AS y FROM s GROUP BY node), k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::double AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::double AS ry FROM v) SELECT count(*) AS n, round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM k")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = materialize(_facts(spark, sf_dir, "node", "top").groupBy("node").agg(F.count("*").alias("x"), F.count_if(F.col("top") >= 60000).alias("y")))
    return stats.correlations(v, "x", "y").select("n", F.round("pearson", 9).alias("pearson"), F.round("spearman", 9).alias("spearman"))


@query("WITH v AS (SELECT o_orderstatus AS a, CASE WHEN o_totalprice > 150000 THEN 'F' WHEN o_totalprice > 60000 THEN 'O' ELSE 'P' END AS b FROM orders), n AS (SELECT CAST(count(*) AS double) AS n, count_if(a = b) / CAST(count(*) AS double) AS g FROM v), c AS (SELECT sum(x.k * y.k) AS e FROM (SELECT a, CAST(count(*) AS double) AS k FROM v GROUP BY a) x JOIN (SELECT b, CAST(count(*) AS double) AS k FROM v GROUP BY b) y ON x.a = y.b) SELECT CAST(n AS bigint) AS n, round(g, 9) AS agreement, round((g - e / (n * n)) / (1 - e / (n * n)), 9) AS kappa FROM n, c")
def confusion_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = stats.concordance(_classes(spark, sf_dir), "a", "b")
    return k.select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@query("WITH v AS (SELECT o_orderstatus AS a, CASE WHEN o_totalprice > 150000 THEN 'F' WHEN o_totalprice > 60000 THEN 'O' ELSE 'P' END AS b FROM orders) SELECT c.class, (SELECT count(*) FROM v WHERE a = c.class) AS n_truth, (SELECT count(*) FROM v WHERE b = c.class) AS n_guess, (SELECT count(*) FROM v WHERE a = c.class AND b = c.class) AS n_both FROM (SELECT a AS class FROM v UNION SELECT b FROM v) c")
def class_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.recalls(_classes(spark, sf_dir), "a", "b").select("class", *(F.col(c).cast("long").alias(c) for c in ("n_truth", "n_guess", "n_both")))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("a"), F.when(price > 150000, "F").when(price > 60000, "O").otherwise("P").alias("b"))


@query(f"WITH {_S}, m AS (SELECT DISTINCT node, position FROM s WHERE top >= 85000), n AS (SELECT CAST(count(DISTINCT node) AS double) AS n FROM m), c AS (SELECT position, CAST(count(*) AS double) AS k FROM m GROUP BY position), x AS (SELECT a.position AS p1, b.position AS p2, count(*) AS k FROM m a JOIN m b ON a.node = b.node AND a.position < b.position GROUP BY ALL) SELECT p1 AS place_a, p2 AS place_b, x.k AS \"both\", round(x.k / (c1.k + c2.k - x.k), 9) AS jaccard, CASE WHEN c1.k * c2.k * (n - c1.k) * (n - c2.k) > 0 THEN round((n * x.k - c1.k * c2.k) / sqrt(c1.k * c2.k * (n - c1.k) * (n - c2.k)), 9) ELSE 0 END AS phi FROM x JOIN c c1 ON c1.position = p1 JOIN c c2 ON c2.position = p2, n")
def co_switch_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir, "node", "position", "top").where("top >= 85000")
    return stats.pair_associations(f, "node", "position").select("place_a", "place_b", "both", F.round("jaccard", 9).alias("jaccard"), F.round("phi", 9).alias("phi"))


@query(f"WITH {_UP}, d AS (SELECT leaf AS node, 3 AS depth, l0 + l1 + l2 AS distance FROM up UNION ALL SELECT n.node, 2, n.len + r.len FROM tree n JOIN tree r ON n.parent = r.node WHERE n.node LIKE 'n%' UNION ALL SELECT node, 1, len FROM tree WHERE parent = 'root' UNION ALL SELECT 'root', 0, 0) SELECT * FROM d")
def root_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.levels(_tree(spark, sf_dir))


@query(f"WITH {_UP}, p AS (SELECT unnest([a0, a1, a2, a3]) AS node, leaf FROM up) SELECT node, count(*) AS clade_size, min(leaf) AS first_leaf, max(leaf) AS last_leaf FROM (SELECT * FROM p UNION ALL SELECT unnest([node, parent, 'root']), node FROM tree t WHERE node LIKE 'n%' AND NOT EXISTS (SELECT 1 FROM tree c WHERE c.parent = t.node)) GROUP BY node")
def tree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, paths = _with_suppliers(spark, sf_dir)
    return trees.clade_sizes(trees.leaf_closure(nodes, paths))


def _with_suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = materialize(_tree(spark, sf_dir))
    return nodes, trees.ancestors(nodes)


@query(f"WITH {_UP}, g AS (SELECT DISTINCT l_partkey AS part, 's' || l_suppkey AS leaf FROM lineitem), j AS (SELECT part, count(*) AS n_members, count(DISTINCT a0) AS c0, count(DISTINCT a1) AS c1, count(DISTINCT a2) AS c2, min(a0) AS m0, min(a1) AS m1, min(a2) AS m2 FROM g JOIN up USING (leaf) GROUP BY part) SELECT part, CASE WHEN c0 = 1 THEN m0 WHEN c1 = 1 THEN m1 WHEN c2 = 1 THEN m2 ELSE 'root' END AS lca, n_members FROM j")
def lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    toured = intervals.tour(_tree(spark, sf_dir))
    sets = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.concat(F.lit("s"), "l_suppkey").alias("leaf"))
    return intervals.lowest_common(toured, sets, "part", "leaf")


@query(f"WITH {_UP}, m AS (SELECT 'n' || n_nationkey AS node FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'r' || r_regionkey FROM region WHERE r_regionkey % 2 = 0), a AS (SELECT node, 1 AS k, node AS up FROM tree UNION ALL SELECT node, 2, parent FROM tree WHERE parent IS NOT NULL UNION ALL SELECT t.node, 3, p.parent FROM tree t JOIN tree p ON t.parent = p.node WHERE p.parent IS NOT NULL UNION ALL SELECT t.node, 4, g.parent FROM tree t JOIN tree p ON t.parent = p.node JOIN tree g ON p.parent = g.node WHERE g.parent IS NOT NULL) SELECT t.node, arg_min(a.up, a.k) FILTER (a.up IN (SELECT node FROM m)) AS clade FROM tree t JOIN a ON a.node = t.node GROUP BY t.node")
def clade_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = materialize(_tree(spark, sf_dir))
    key = F.substring("node", 2, 9).try_cast("int")
    found = intervals.nearest(nodes, nodes.where(F.substring("node", 1, 1).isin("n", "r") & (key % 2 == 0)))
    return found.select("node", F.col("found").alias("clade"))


@query(f"WITH {_UP}, p AS (SELECT unnest([a1, a2, a3]) AS node, c_mktsegment AS label FROM up JOIN customer ON 'n' || c_nationkey = a1), n AS (SELECT node, label, count(*) AS n FROM p WHERE label <> 'MACHINERY' GROUP BY ALL) SELECT node, label, n FROM n QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, label) = 1")
def dominant_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, paths = _with_suppliers(spark, sf_dir)
    closure = trees.leaf_closure(nodes, paths)
    # counted before they meet the suppliers: a nation has as many pairs as both multiplied
    seg = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("nation"), F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n"))
    labels = nodes.where(F.col("node").startswith("s")).select(F.col("node").alias("leaf"), F.col("parent").alias("nation")).join(seg, "nation").select("leaf", "label", "n")
    return trees.dominant(closure.where(~F.col("node").startswith("s")), labels, "MACHINERY")


@query(f"WITH {_UP}, a AS (SELECT node, string_agg(leaf, ',' ORDER BY leaf) AS sig FROM (SELECT unnest([a0, a1, a2, a3]) AS node, leaf FROM up) GROUP BY node), b AS (SELECT node, string_agg(leaf, ',' ORDER BY leaf) AS sig FROM (SELECT unnest([a0, 'x' || CAST(CAST(substr(a1, 2) AS bigint) // 2 AS varchar), a3]) AS node, leaf FROM up) GROUP BY node) SELECT a.node, b.node AS match, 'same' AS \"by\" FROM a JOIN b USING (sig)")
def leaf_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = materialize(_tree(spark, sf_dir))
    names = nodes.where(F.col("node").startswith("s")).select(F.col("node").alias("leaf"), F.col("node").alias("name"))
    one = intervals.signatures(intervals.tour(nodes), names)
    sup = nodes.where(F.col("node").startswith("s"))
    pair = F.concat(F.lit("x"), F.floor(F.substring("parent", 2, 9).cast("long") / 2).cast("long").cast("string"))
    other = sup.select("node", pair.alias("parent"), "length").unionByName(sup.select(pair.alias("node"), F.lit("root").alias("parent"), F.lit(1.0).alias("length")).distinct()).unionByName(nodes.where("parent is null"))
    other = materialize(other)
    two = intervals.signatures(intervals.tour(other), names)
    return trees.match_signatures(one, two)


@query("WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL) SELECT user_id, event_type, n FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) = 1")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.majority(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


_LETTERS = "texts AS (SELECT lang AS node, regexp_extract_all(text, '(?s).') AS xs FROM documents), chars AS (SELECT node, unnest(xs) AS x, CAST(generate_subscripts(xs, 1) AS integer) AS position FROM texts), c AS (SELECT node, position, CASE WHEN x BETWEEN 'a' AND 'z' THEN upper(x) ELSE x END AS residue, count(*) AS n FROM chars WHERE regexp_matches(x, '^\\p{L}$') GROUP BY ALL)"
VOWELS = "AEIOU"


def _alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, position, residue, n): letters of the whole texts by language,
    A to Z in either case, others as they are."""
    letter = F.when(F.col("residue").rlike(columns.LETTER), F.when(F.col("residue").between("a", "z"), F.upper("residue")).otherwise(F.col("residue")))
    return materialize(columns.residue_counts(table(spark, sf_dir, "documents"), "lang", "text", letter).withColumnRenamed("lang", "node"))


def _matrix(spark: SparkSession) -> DataFrame:
    """A substitution matrix by a rule: 4 for equal letters, 1 for two vowels, else -1."""
    a = spark.range(26).select(F.chr(F.col("id") + 65).alias("a"))
    v = lambda c: F.col(c).isin(*VOWELS)
    return a.crossJoin(a.toDF("b")).withColumn("value", F.when(F.col("a") == F.col("b"), 4.0).when(v("a") & v("b"), 1.0).otherwise(-1.0))


@query(f"WITH {_LETTERS}, s AS (SELECT node, position, sum(n) AS n FROM c GROUP BY ALL), p AS (SELECT x.node, x.position, sum(CASE WHEN NOT (x.residue BETWEEN 'A' AND 'Z' AND y.residue BETWEEN 'A' AND 'Z') THEN 0 WHEN x.residue = y.residue THEN 4.0::double * x.n * (x.n - 1) WHEN x.residue IN ('A','E','I','O','U') AND y.residue IN ('A','E','I','O','U') THEN 1.0::double * x.n * y.n ELSE -1.0::double * x.n * y.n END) AS v FROM c x JOIN c y ON x.node = y.node AND x.position = y.position GROUP BY ALL) SELECT node, position, CAST(n AS bigint) AS n, round(CASE WHEN n = 1 THEN 1 ELSE greatest(0, least(1, (v / (CAST(n AS double) * (n - 1)) + 4) / 15)) END, 9) AS rc FROM s JOIN p USING (node, position)")
def recent_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rc = scoring.recent_conservation(_alignment(spark, sf_dir), _matrix(spark))
    return rc.select("node", "position", "n", F.round("rc", 9).alias("rc"))


_STATES = f"{_LETTERS}, a AS (SELECT * FROM c WHERE position(residue IN '{scoring.ALPHABET}') > 0), t AS (SELECT node, position, sum(n) AS tot, arg_min(residue, (-n, residue)) AS state FROM a GROUP BY ALL), pr AS (SELECT a.node, a.position, a.residue, a.n / CAST(t.tot AS double) AS p FROM a JOIN t USING (node, position)), pairs AS (SELECT x.node AS l, y.node AS r FROM (SELECT DISTINCT node FROM t) x JOIN (SELECT DISTINCT node FROM t) y ON x.node < y.node), b AS (SELECT l, r, tl.position, tl.state AS al, tr.state AS ar FROM pairs JOIN t tl ON tl.node = l JOIN t tr ON tr.node = r AND tr.position = tl.position), e AS (SELECT b.*, CASE WHEN al = ar THEN 1 ELSE -1 END AS ac, (SELECT p FROM pr WHERE pr.node = r AND pr.position = b.position AND pr.residue = CASE WHEN al = ar THEN ar ELSE al END) AS ql, (SELECT p FROM pr WHERE pr.node = l AND pr.position = b.position AND pr.residue = CASE WHEN al = ar THEN al ELSE ar END) AS qr FROM b)"


def _states(counts: DataFrame) -> DataFrame:
    """(node, position, state, probs) of an alignment's ``counts``."""
    c = counts.where(F.instr(F.lit(scoring.ALPHABET), F.col("residue")) > 0)
    m = c.groupBy("node", "position").agg(F.sum("n").alias("t"), F.map_from_entries(F.collect_list(F.struct("residue", "n"))).alias("m"), F.min(F.struct((-F.col("n")).alias("_"), "residue")).alias("s"))
    probs = F.array(*(F.coalesce(F.try_element_at("m", F.lit(a)), F.lit(0)) / F.col("t") for a in scoring.ALPHABET))
    return materialize(m.select("node", "position", F.col("s.residue").alias("state"), probs.alias("probs")))


@query(f"WITH {_STATES} SELECT l AS \"left\", r AS \"right\", position, al AS aa_left, ar AS aa_right, ac, round(CASE WHEN ac = 1 THEN coalesce(ql, 0) ELSE 1 - coalesce(ql, 0) END, 9) AS p_ac_left, round(CASE WHEN ac = 1 THEN coalesce(qr, 0) ELSE 1 - coalesce(qr, 0) END, 9) AS p_ac_right FROM e")
def ancestral_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(_alignment(spark, sf_dir))
    n = s.select("node").distinct()
    pairs = n.toDF("left").join(n.toDF("right"), F.col("left") < F.col("right"))
    none = s.select("node", "position").where("false").withColumn("rc", F.lit(0.0))
    out = scoring.score_pairs(pairs, s, none, digits=None)
    return out.select("left", "right", "position", "aa_left", "aa_right", "ac", F.round("p_ac_left", 9).alias("p_ac_left"), F.round("p_ac_right", 9).alias("p_ac_right"))


@query(f"WITH {_S}, {_DOM}, c AS (SELECT domain, position, count_if(top >= {CUT}) AS c FROM s JOIN dom ON position BETWEEN lo AND hi GROUP BY ALL), d AS (SELECT domain, count(*) AS a, sum(c) AS k FROM c GROUP BY domain), t AS (SELECT CAST(sum(a) AS double) AS ta, CAST(sum(k) AS double) AS tk FROM d) SELECT dom.domain, hi - lo + 1 AS n_sites, coalesce(a, 0) AS n_active, CAST(coalesce(k, 0) AS bigint) AS n_calls, round(coalesce(k, 0) / CAST(hi - lo + 1 AS double), 9) AS density, round(coalesce(k, 0) / tk, 9) AS proportion, round((k / CAST(a AS double)) / (tk / ta), 9) AS enrichment FROM dom LEFT JOIN d USING (domain), t")
def domain_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _facts(spark, sf_dir, "position", "top").withColumn("hit", F.col("top") >= CUT)
    d = summaries.domain_rates(calls, _domains(spark), "position", "hit")
    return d.select("domain", "n_sites", "n_active", "n_calls", *(F.round(c, 9).alias(c) for c in ("density", "proportion", "enrichment")))


@query(f"WITH {_S}, e AS (SELECT quantile_cont(depth, [1 / 3.0::double, 2 / 3.0::double]) AS q FROM s), z AS (SELECT *, CASE WHEN depth <= q[1] THEN 'Deep' WHEN depth <= q[2] THEN 'Mid' ELSE 'Recent' END AS era FROM s, e), u AS (SELECT era, unnest([event_type, 'Overall']) AS event_type, top, node FROM z) SELECT era, event_type, count_if(top >= {CUT}) AS n_calls, count(DISTINCT node) AS n_nodes, round(count_if(top >= {CUT}) / CAST(count(DISTINCT node) AS double), 9) AS rate FROM u GROUP BY ALL")
def temporal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir, "depth", "event_type", "node", "top").withColumn("hit", F.col("top") >= CUT)
    r = summaries.temporal_rates(summaries.labelled_tertiles(f, "depth", ["Deep", "Mid", "Recent"]), "hit", "node", "era", "event_type")
    return r.withColumn("rate", F.round("rate", 9))


@query(f"WITH {_S}, k AS (SELECT DISTINCT node, position FROM s WHERE top >= 90000) SELECT node, count(*) AS n_markers, string_agg(CAST(position AS varchar), ',' ORDER BY position) AS markers FROM k GROUP BY node")
def clade_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.markers(_facts(spark, sf_dir, "node", "position", "top").where("top >= 90000"), "node", "position")


@query(f"WITH {_S}, x AS (SELECT node, CAST(max(CASE WHEN event_type = 'A' THEN 1 ELSE 0 END) AS integer) AS a, CAST(max(CASE WHEN event_type = 'N' THEN 1 ELSE 0 END) AS integer) AS n_, CAST(max(CASE WHEN event_type = 'R' THEN 1 ELSE 0 END) AS integer) AS r FROM s WHERE top >= 97000 GROUP BY node) SELECT a AS \"A\", n_ AS \"N\", r AS \"R\", count(*) AS n_items FROM x GROUP BY ALL")
def upset_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.set_regions(_facts(spark, sf_dir, "node", "event_type", "top").where("top >= 97000"), "node", "event_type", ["A", "N", "R"])


@query(f"WITH {_S}, c AS (SELECT node, count_if(event_type = 'A') AS a, count_if(event_type = 'N') AS b FROM s GROUP BY node HAVING count_if(event_type = 'N') > 0), t AS (SELECT unnest([0.5, 0.9, 1.0, 1.1, 2.0])::double AS threshold) SELECT threshold, count(*) AS n, count_if(a / CAST(b AS double) >= threshold) AS n_reached, round(count_if(a / CAST(b AS double) >= threshold) / CAST(count(*) AS double), 9) AS share FROM c, t GROUP BY threshold")
def ratio_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts(spark, sf_dir).groupBy("node").agg(F.count_if(F.col("event_type") == "A").alias("a"), F.count_if(F.col("event_type") == "N").alias("b"))
    return summaries.ratio_curve(c, "node", "a", "b", [0.5, 0.9, 1.0, 1.1, 2.0]).withColumn("share", F.round("share", 9))


@query(f"WITH {_S}, f AS (SELECT quantile_cont(top, 0.97) AS f FROM s), a AS (SELECT event_type, quantile_cont(top, 0.97) AS a FROM s GROUP BY event_type) SELECT event_type, round(f, 6) AS flat_threshold, round(a, 6) AS adjusted_threshold, count(*) AS n, count_if(top >= f) AS n_flat, count_if(top >= a) AS n_adjusted FROM s JOIN a USING (event_type), f GROUP BY event_type, f, a")
def flat_and_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = summaries.flat_and_adjusted(_facts(spark, sf_dir, "event_type", "top"), "top", 0.97, "event_type")
    return d.withColumn("flat_threshold", F.round("flat_threshold", 6)).withColumn("adjusted_threshold", F.round("adjusted_threshold", 6))


@query(f"WITH {_S}, q AS (SELECT event_type, quantile_cont(depth, 0.25) AS a, quantile_cont(depth, 0.75) AS b FROM s GROUP BY event_type) SELECT event_type, count(*) AS n_kept, round(min(depth), 4) AS least, round(max(depth), 4) AS most FROM s JOIN q USING (event_type) WHERE depth BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a) GROUP BY event_type")
def iqr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = summaries.without_outliers(_facts(spark, sf_dir, "event_type", "depth"), "depth", ["event_type"], 0.5)
    return kept.groupBy("event_type").agg(F.count("*").alias("n_kept"), F.round(F.min("depth"), 4).alias("least"), F.round(F.max("depth"), 4).alias("most"))


@query(f"WITH {_S} SELECT CAST(len(list_filter([5, 10, 20, 40], lambda e: e <= clade_left)) AS integer) AS bin, count(*) AS n, min(clade_left) AS lo, max(clade_left) AS hi FROM s GROUP BY 1")
def digitize_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ranks.bin_left_closed(F.col("clade_left"), [5, 10, 20, 40])
    return facts(spark, sf_dir).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.min("clade_left").alias("lo"), F.max("clade_left").alias("hi"))


@query(f"WITH {_S}, n AS (SELECT *, CAST(floor(clade_left / 10) AS bigint) AS own, CAST(floor(clade_right / 10) AS bigint) AS sib FROM s WHERE side = 'O'), g AS (SELECT own, sib, count(*) AS t, count_if(top >= {CUT}) AS e FROM n GROUP BY ALL), a AS (SELECT CAST(sum(t) AS double) AS ta, CAST(sum(e) AS double) AS ea FROM g) SELECT own, sib, t AS n_trials, e AS n_exceed, CASE WHEN e = 0 THEN 1 ELSE round((e / CAST(t AS double)) / (ea / ta), 9) END AS multiplier FROM g, a")
def cell_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir, "side", "replicate", "clade_left", "clade_right", "top").where("side = 'O'")
    f = f.withColumn("own", F.floor(F.col("clade_left") / 10)).withColumn("sib", F.floor(F.col("clade_right") / 10))
    m = nulls.multipliers(materialize(nulls.cells(f, "top", CUT, ["replicate", "own", "sib"])), ["own", "sib"])
    return m.select("own", "sib", "n_trials", "n_exceed", F.round("multiplier", 9).alias("multiplier"))


@query(f"WITH {_S}, n AS (SELECT position, unnest([{{'c': 'event', 'b': event_type}}, {{'c': 'clade', 'b': CAST(CAST(floor(clade_left / 10) AS bigint) AS varchar)}}]) AS x, top FROM s WHERE side = 'O'), t AS (SELECT x.c AS covariate, x.b AS bin, position, avg(CASE WHEN top >= 60000 THEN 1.0::double ELSE 0 END) AS rate, count(*) AS n FROM n GROUP BY ALL) SELECT covariate, bin, count(*) AS n_tests, CAST(sum(n) AS bigint) AS n, round(avg(rate), 9) AS rate FROM t GROUP BY ALL")
def exceedance_flatness(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir, "side", "position", "event_type", "clade_left", "top").where("side = 'O'")
    out = nulls.flatness(f, "position", "top", 60000, {"event": F.col("event_type"), "clade": F.floor(F.col("clade_left") / 10)})
    return out.withColumn("rate", F.round("rate", 9))


@query(f"WITH {_S}, v AS (SELECT replicate % 4 AS run, replicate, count_if(top >= {CUT}) AS n FROM s WHERE side = 'O' GROUP BY ALL), u AS (SELECT run, avg(n) AS m, min(n) AS lo, max(n) AS hi, sum(n) AS tot FROM v GROUP BY run) SELECT a.run AS run_a, b.run AS run_b, CASE WHEN a.tot < 30 OR b.tot < 30 THEN 'undetermined' WHEN a.hi < b.lo OR b.hi < a.lo THEN 'disjoint' ELSE 'comparable' END AS verdict, round(a.m / nullif(b.m, 0), 9) AS ratio FROM u a JOIN u b ON a.run < b.run")
def tail_comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir, "side", "replicate", "top").where("side = 'O'").withColumn("run", F.col("replicate") % 4)
    return nulls.run_comparability(f, "run", "top", CUT).withColumn("ratio", F.round("ratio", 9))


@query("WITH o AS (SELECT o_orderstatus AS event, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT l_returnflag AS event, count(*) AS n FROM lineitem GROUP BY 1), u AS (SELECT 'orders' AS level, * FROM o UNION ALL SELECT 'items', * FROM l) SELECT level, event, n, round(n / CAST(sum(n) OVER (PARTITION BY level) AS double), 9) AS proportion FROM u")
def event_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("event"))
    return summaries.event_levels({"orders": e("orders", "o_orderstatus"), "items": e("lineitem", "l_returnflag")}).withColumn("proportion", F.round("proportion", 9))


@query(f"WITH {_UP}, h AS (SELECT 'n' || c_nationkey AS node, min(c_custkey) AS v FROM customer WHERE c_acctbal < 0 GROUP BY 1 UNION ALL SELECT 'r' || r_regionkey, -r_regionkey FROM region) SELECT u.leaf AS node, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NULL THEN 2 ELSE 1 END AS steps FROM up u LEFT JOIN h a ON a.node = u.a1 LEFT JOIN h b ON b.node = u.a2")
def lineage_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = materialize(_tree(spark, sf_dir))
    held = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("n"), "c_nationkey").alias("node"), F.col("c_custkey").alias("value"))
    held = held.unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), (-F.col("r_regionkey")).cast("long").alias("value")))
    held = materialize(held.groupBy("node").agg(F.min("value").alias("value")))
    near = intervals.nearest(nodes, held).where(F.col("node").startswith("s") & F.col("found").isNotNull())
    return near.join(held.withColumnRenamed("node", "found"), "found").select("node", "value", F.col("steps").cast("int").alias("steps"))

MOTIF = "TATNAA"


@query("WITH q AS (SELECT doc_id, string_split(upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')), '') AS x FROM documents), p AS (SELECT doc_id, x, unnest(range(0, greatest(len(x) - 5, 0)))::int AS hit_position FROM q), h AS (SELECT doc_id, hit_position, array_to_string(x[hit_position + 1:hit_position + 6], '') AS hit_sequence, (x[hit_position + 1] <> 'T')::int + (x[hit_position + 2] <> 'A')::int + (x[hit_position + 3] <> 'T')::int + (x[hit_position + 5] <> 'A')::int + (x[hit_position + 6] <> 'A')::int AS mismatches FROM p) SELECT * FROM h WHERE mismatches <= 1 AND length(hit_sequence) = 6")
def motif_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^ACGTacgt]", "")).alias("sequence"))
    return residues.motif_hits(d, "sequence", MOTIF, 1)


def _consensus(counts: DataFrame) -> DataFrame:
    """(node, position, letter): the most frequent letter by language, of an
    alignment's ``counts``."""
    top = F.min(F.struct((-F.col("n")).alias("_"), "residue"))["residue"]
    return counts.groupBy("node", "position").agg(top.alias("letter"))


_IUPAC = "iu AS (SELECT * FROM (VALUES " + ", ".join(str(x) for x in residues.IUPAC.items()) + ") v(letter, allowed))"


@query(f"WITH {_LETTERS}, t AS (SELECT node, position, arg_min(residue, (-n, residue)) AS letter FROM c GROUP BY ALL), {_IUPAC}, w AS (SELECT node, position, unnest(['A', 'C', 'G', 'T']) AS base, coalesce(allowed, '') AS al FROM t LEFT JOIN iu USING (letter)), m AS (SELECT node, position, base, (CASE WHEN contains(al, base) THEN 1.0::double ELSE 0.1::double END) / (length(al) + (4 - length(al)) * 0.1::double) AS p FROM w) SELECT a.node AS motif_a, b.node AS motif_b, count(DISTINCT position) AS n, round(sqrt(sum((a.p - b.p) ** 2)) / count(DISTINCT position), 9) AS frobenius, round(sum((a.p - b.p) * (ln(a.p + 1e-10) - ln(b.p + 1e-10))) / 2 / count(DISTINCT position), 9) AS divergence FROM m a JOIN m b USING (position, base) WHERE a.node < b.node GROUP BY ALL")
def motif_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = residues.matrix_distances(residues.weight_matrices(_consensus(_alignment(spark, sf_dir)), "node"), "node")
    return out.withColumns({c: F.round(c, 9) for c in ("frobenius", "divergence")})


_SCALES = "sc AS (SELECT * FROM (VALUES " + ", ".join(str((k, h, residues.CHARGE.get(k, 0.0), residues.VOLUME[k], *residues.GRANTHAM[k])) for k, h in residues.HYDROPATHY.items()) + ") v(aa, h, q, vol, gc, gp, gv))"


@query(f"WITH {_LETTERS}, t AS (SELECT node, position, arg_min(residue, (-n, residue)) AS a FROM c GROUP BY ALL), {_SCALES}, pr AS (SELECT t.node, t.position, t.a AS ancestral, c.residue AS target, c.n FROM t JOIN c USING (node, position)) SELECT node, position, ancestral, target, n, coalesce(round(sqrt(1.833::double * (x.gc::double - y.gc) ** 2 + 0.1018::double * (x.gp::double - y.gp) ** 2 + 0.000399::double * (x.gv::double - y.gv) ** 2) * 50.723::double), 0) AS distance, round(coalesce(y.q::double, 0) - coalesce(x.q::double, 0), 6) AS charge_shift, round(coalesce(y.h::double, 0) - coalesce(x.h::double, 0), 6) AS hydropathy_shift, round(coalesce(y.vol::double, 0) - coalesce(x.vol::double, 0), 6) AS volume_shift FROM pr LEFT JOIN sc x ON x.aa = ancestral LEFT JOIN sc y ON y.aa = target")
def property_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _alignment(spark, sf_dir)
    rows = a.join(_consensus(a).withColumnRenamed("letter", "ancestral"), ["node", "position"]).withColumnRenamed("residue", "target")
    out = residues.annotate_shifts(rows, "ancestral", "target")
    return out.select("node", "position", "ancestral", "target", "n", "distance", *(F.round(f"{c}_shift", 6).alias(f"{c}_shift") for c in ("charge", "hydropathy", "volume")))


@query(f"WITH {_S}, m AS (SELECT DISTINCT node, position FROM s WHERE top >= 100000), z AS (SELECT node, count(*) AS size FROM m GROUP BY 1), i AS (SELECT a.node AS x, b.node AS y, count(*) AS met FROM m a JOIN m b ON a.position = b.position AND a.node <> b.node GROUP BY ALL) SELECT i.x AS inner_node, i.y AS outer_node FROM i JOIN z p ON p.node = i.x JOIN z q ON q.node = i.y WHERE met = p.size AND p.size < q.size")
def contained_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir, "node", "position", "top").where("top >= 100000")
    return residues.contained_sets(f, "node", "position").select(F.col("inner").alias("inner_node"), F.col("outer").alias("outer_node"))


METHODS = ("inverted_cdf", "linear")


@query(f"WITH {_S} SELECT event_type, 'inverted_cdf' AS method, round(quantile_disc(top, 0.95), 6) AS q FROM s GROUP BY 1 UNION ALL SELECT event_type, 'linear', round(quantile_cont(top, 0.95), 6) FROM s GROUP BY 1")
def quantile_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir, "event_type", "top")
    outs = [ranks.percentiles(f, "top", [0.95], ["event_type"], method=m).select("event_type", F.lit(m).alias("method"), F.round("percentile", 6).alias("q")) for m in METHODS]
    return outs[0].unionByName(outs[1])



def queries() -> dict[str, Query]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
