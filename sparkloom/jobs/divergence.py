"""Queries over the given tables: a score table is read from line items,
parts and orders, a character matrix from documents, a tree from regions,
nations and suppliers, replicates from the other line status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import columns, switches
from ..session import materialize, table

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FACTS = """SELECT l_suppkey AS node, p_size AS position, l_returnflag AS event_type, l_linestatus AS side, l_orderkey % 20 AS replicate,
  l_extendedprice * (1 - l_discount) AS score_left, l_extendedprice * (1 + l_tax) * CAST(0.9 AS double) AS score_right,
  l_quantity AS clade_left, CAST(1 + l_partkey % 50 AS double) AS clade_right, o_totalprice AS depth
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey"""
GRID_LAST = 55
SHARE, BINS = 0.99, 10


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FACTS, **{t: table(spark, sf_dir, t) for t in ("lineitem", "part", "orders")})


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What calls need of the score table, joined once and written, as
    thresholds and calls read it several times."""
    return materialize(facts(spark, sf_dir).select("node", "position", "event_type", "score_left", "score_right", "clade_left", "clade_right"))


def melt_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return switches.melt_branches(facts(spark, sf_dir)).groupBy("branch", "event_type", "position").agg(F.count("*").alias("n"), F.max("score").alias("top_score"), F.min("clade").alias("least_clade"))


def qcut_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = switches.melt_branches(_written(spark, sf_dir))
    edges = switches.quantile_edges(branches, "clade", BINS)
    binned = branches.crossJoin(F.broadcast(edges)).withColumn("bin", switches.bin_of(F.col("clade"), F.col("edges")).cast("long"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.min("clade").alias("lo"), F.max("clade").alias("hi"))


def bin_event_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = switches.melt_branches(_written(spark, sf_dir))
    out = switches.bin_thresholds(branches, switches.quantile_edges(branches, "clade", BINS), SHARE)
    return out.select("event_type", F.col("bin").cast("long").alias("bin"), F.round("threshold", 4).alias("threshold"), "n")


def adaptive_switch_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = switches.adaptive_calls(_written(spark, sf_dir), BINS, SHARE)
    return calls.groupBy("event_type").agg(F.count_if("is_switch").alias("n_switches"), F.count("*").alias("n"))


def dense_position_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return switches.dense_tally(switches.adaptive_calls(_written(spark, sf_dir), BINS, SHARE), 1, GRID_LAST)


def column_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.occupancy(_residues(spark, sf_dir), "lang")


def top_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.top_residue(_residues(spark, sf_dir), "lang")


def column_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.entropy(_residues(spark, sf_dir), "lang")


def _residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.residue_counts(table(spark, sf_dir, "documents"), "lang", "text")


#: Line items that one task of ``transfer_highways`` meets, about.
TASK_ITEMS = 1_000_000


def transfer_highways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and orders from each nation to another. Both sides are counted
    per order before they meet, so no order is kept to be told from others,
    and there are as many tasks as the line items need."""
    t = {x: table(spark, sf_dir, x) for x in ("lineitem", "orders", "supplier", "customer")}
    items = t["lineitem"].select(F.col("l_orderkey").alias("key"), "l_suppkey")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), items.count() // TASK_ITEMS + 1)
    sent = items.join(t["supplier"].select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("donor")), "l_suppkey")
    sent = sent.repartition(parts, "key").groupBy("key", "donor").agg(F.count("*").alias("n"))
    got = t["orders"].select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("c_custkey")).join(t["customer"].select("c_custkey", F.col("c_nationkey").alias("recipient")), "c_custkey")
    got = got.repartition(parts, "key").groupBy("key", "recipient").agg(F.count("*").alias("m"))
    return sent.join(got, "key").where("donor <> recipient").groupBy("donor", "recipient").agg(F.sum(F.col("n") * F.col("m")).alias("n"), F.count("*").alias("n_orders"))


CUTOFFS = [20000.0, 40000.0, 60000.0, 80000.0, 90000.0]


def hard_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return switches.threshold_sweep(facts(spark, sf_dir), CUTOFFS)


_D1 = f"d1 AS ({FACTS})"
_B = "b AS (SELECT event_type, position, score_left AS score, clade_left AS clade, 'left' AS branch FROM d1 UNION ALL SELECT event_type, position, score_right, clade_right, 'right' FROM d1)"
_EDGES = "e AS (SELECT list_sort(list_distinct(quantile_cont(clade, [" + ", ".join(str(i / BINS) for i in range(BINS + 1)) + "]))) AS edges FROM b)"
_BIN = "greatest(len(list_filter(edges, lambda x: x < {0})), 1) - 1"
_CALLS = f"""WITH {_D1}, {_B}, {_EDGES}, t AS (SELECT {_BIN.format('clade')} AS bin, quantile_cont(score, {SHARE}) AS threshold FROM b, e GROUP BY 1),
c AS (SELECT d1.*, (score_left >= tl.threshold OR score_right >= tr.threshold) AS is_switch FROM d1 CROSS JOIN e JOIN t tl ON tl.bin = {_BIN.format('clade_left')} JOIN t tr ON tr.bin = {_BIN.format('clade_right')}) """

_RESIDUES = "x AS (SELECT lang, regexp_extract_all(text, '(?s).') AS xs FROM documents), m AS (SELECT lang, unnest(xs) AS residue, CAST(generate_subscripts(xs, 1) AS integer) AS position FROM x), c AS (SELECT lang, position, residue, count(*) AS n FROM m GROUP BY ALL)"

ORACLE = {
    "column_residues": f"WITH {_RESIDUES} SELECT lang, position, CAST(sum(n) AS bigint) AS n, CAST(coalesce(sum(n) FILTER (regexp_matches(residue, '[letter]')), 0) AS bigint) AS n_occupied, count(*) AS n_residues FROM c GROUP BY ALL",
    "top_residue": f"WITH {_RESIDUES} SELECT lang, position, residue, n FROM c WHERE regexp_matches(residue, '[letter]') QUALIFY row_number() OVER (PARTITION BY lang, position ORDER BY n DESC, residue) = 1",
    "column_entropy": f"WITH {_RESIDUES}, s AS (SELECT lang, position, n / CAST(sum(n) OVER (PARTITION BY lang, position) AS double) AS p FROM c WHERE regexp_matches(residue, '[letter]')) SELECT lang, position, round(0 - sum(p * log2(p)), 6) AS entropy FROM s GROUP BY ALL",
    "melt_branches": f"WITH {_D1}, {_B} SELECT branch, event_type, position, count(*) AS n, max(score) AS top_score, min(clade) AS least_clade FROM b GROUP BY 1, 2, 3",
    "qcut_deciles": f"WITH {_D1}, {_B}, {_EDGES} SELECT {_BIN.format('clade')} AS bin, count(*) AS n, min(clade) AS lo, max(clade) AS hi FROM b, e GROUP BY 1",
    "bin_event_thresholds": f"WITH {_D1}, {_B}, {_EDGES}, x AS (SELECT unnest([event_type, 'overall']) AS event_type, {_BIN.format('clade')} AS bin, score FROM b, e) SELECT event_type, bin, round(quantile_cont(score, {SHARE}), 4) AS threshold, count(*) AS n FROM x GROUP BY 1, 2",
    "adaptive_switch_calls": _CALLS + "SELECT event_type, CAST(count_if(is_switch) AS bigint) AS n_switches, count(*) AS n FROM c GROUP BY 1",
    "dense_position_tally": _CALLS + f"SELECT CAST(g.p AS integer) AS position, CAST(coalesce(count_if(c.is_switch), 0) AS bigint) AS n_switches FROM range(1, {GRID_LAST + 1}) g(p) LEFT JOIN c ON c.position = g.p GROUP BY 1",
    "hard_threshold_sweep": f"WITH {_D1}, t AS (SELECT CAST(unnest({CUTOFFS}) AS double) AS threshold) SELECT threshold, count(*) AS n_calls, count(DISTINCT node) AS n_nodes FROM d1 JOIN t ON greatest(score_left, score_right) >= threshold GROUP BY 1",
}

#: Queries whose text both engines run, but for transfer_highways; {table} names a table.
_POS = "p AS (SELECT position, count(*) AS n FROM d1 WHERE greatest(score_left, score_right) >= 80000 GROUP BY position)"
_TREE = "tree AS (SELECT 'root' AS parent, concat('r', CAST(r_regionkey AS string)) AS node, CAST(r_regionkey + 1 AS double) AS len FROM {region} UNION ALL SELECT concat('r', CAST(n_regionkey AS string)), concat('n', CAST(n_nationkey AS string)), CAST(n_nationkey + 1 AS double) FROM {nation} UNION ALL SELECT concat('n', CAST(s_nationkey AS string)), concat('s', CAST(s_suppkey AS string)), CAST(s_suppkey % 7 + 1 AS double) FROM {supplier})"
SHARED = {
    "pivot_event_position": f"WITH {_D1} SELECT position, count(CASE WHEN event_type = 'A' THEN 1 END) AS n_a, count(CASE WHEN event_type = 'N' THEN 1 END) AS n_n, count(CASE WHEN event_type = 'R' THEN 1 END) AS n_r FROM d1 GROUP BY position",
    "node_tally_topk": f"WITH {_D1}, t AS (SELECT node, count(*) AS n_calls FROM d1 WHERE greatest(score_left, score_right) >= 80000 GROUP BY node) SELECT node, n_calls, rk FROM (SELECT node, n_calls, CAST(row_number() OVER (ORDER BY n_calls DESC, node) AS bigint) AS rk FROM t) r WHERE rk <= 20",
    "moving_average_5": f"WITH {_D1}, {_POS} SELECT position, n, CAST(sum(n) OVER w AS bigint) AS window_sum, count(*) OVER w AS window_n FROM p WINDOW w AS (ORDER BY position ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "contiguous_regions": f"WITH {_D1}, {_POS}, hot AS (SELECT position, position - row_number() OVER (ORDER BY position) AS island FROM p WHERE n >= (SELECT avg(n) FROM p)) SELECT min(position) AS first_position, max(position) AS last_position, count(*) AS size FROM hot GROUP BY island",
    "transfer_highways": "SELECT s.s_nationkey AS donor, c.c_nationkey AS recipient, count(*) AS n, count(DISTINCT o.o_orderkey) AS n_orders FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE s.s_nationkey <> c.c_nationkey GROUP BY s.s_nationkey, c.c_nationkey",
    "header_parse": "SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, split_part(url, '://', 1) AS scheme, CASE WHEN url LIKE '%?%' THEN 1 ELSE 0 END AS has_query FROM {pages}",
}


def shared(sql: str) -> Query:
    used = [t for t in TABLES if "{" + t + "}" in sql]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})

    return run


def shared_oracle(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES}).replace("[letter]", columns.LETTER)


def queries() -> dict[str, Query]:
    own = [transfer_highways, column_residues, top_residue, column_entropy, melt_branches, qcut_deciles, bin_event_thresholds, adaptive_switch_calls, dense_position_tally, hard_threshold_sweep]
    return {f.__name__: f for f in own} | {k: shared(s) for k, s in SHARED.items() if k != "transfer_highways"}


def oracle_sql() -> dict[str, str]:
    return {k: shared_oracle(s) for k, s in {**ORACLE, **SHARED}.items()}
