"""Trees rooted and cut anew, replicates traced and columns placed over the
given tables, with DuckDB SQL written apart where SQL can say it. The tree has
the orders as leaves, below customers, nations and regions; each order is also
a replicate of one of seven runs, most of which were merged from others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import provenance, rooting, structures
from ..session import materialize, table

Query = Callable[[SparkSession, str], DataFrame]
Q: dict[str, Query] = {}
SQL: dict[str, str] = {}

_TREE = """tree AS (SELECT 'root' AS node, CAST(NULL AS varchar) AS parent, CAST(0 AS double) AS len
  UNION ALL SELECT 'r' || r_regionkey, 'root', CAST(r_regionkey * 30 + 1 AS double) FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CAST(n_nationkey + 1 AS double) FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CAST(c_custkey % 11 AS double) FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CAST(o_orderkey % 97 + 1 AS double) FROM orders),
p AS (SELECT node AS x, node AS a, 0 AS k FROM tree UNION ALL SELECT p.x, t.parent, p.k + 1 FROM p JOIN tree t ON t.node = p.a WHERE t.parent IS NOT NULL),
d AS (SELECT x AS node, sum(len) AS d FROM p JOIN tree ON node = a GROUP BY x)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent, length, name); orders with an odd key are named by words."""
    out = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("length"), F.lit(None).cast("string").alias("name"))
    key = F.col("o_orderkey")
    name = F.when(key % 2 == 0, key.cast("string")).otherwise(F.concat(F.lit("order "), key))
    levels = [("region", "r", "r_regionkey", F.lit("root"), F.col("r_regionkey") * 30 + 1, None), ("nation", "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey") + 1, None), ("customer", "c", "c_custkey", F.concat(F.lit("n"), "c_nationkey"), F.col("c_custkey") % 11, None), ("orders", "o", "o_orderkey", F.concat(F.lit("c"), "o_custkey"), key % 97 + 1, name)]
    for source, prefix, own, parent, length, named in levels:
        out = out.unionByName(table(spark, sf_dir, source).select(F.concat(F.lit(prefix), own).alias("node"), parent.alias("parent"), length.cast("double").alias("length"), (F.lit(None).cast("string") if named is None else named).alias("name")))
    return materialize(out)


@query(f"""WITH RECURSIVE {_TREE},
tip AS (SELECT node, d FROM d WHERE node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)),
e AS (SELECT node, d FROM tip ORDER BY d DESC, node LIMIT 1),
pa AS (SELECT a AS node, k, d.d FROM p JOIN d ON d.node = p.a WHERE x = (SELECT node FROM e)),
s AS (SELECT p.x, max(pa.d) AS shared FROM p JOIN pa ON pa.node = p.a GROUP BY p.x),
h AS (SELECT max(e.d + tip.d - 2 * shared) / 2 AS half FROM s JOIN tip ON tip.node = x CROSS JOIN e),
v AS (SELECT pa.node, half - (e.d - pa.d) AS short FROM pa, h, e WHERE e.d - pa.d < half ORDER BY k DESC LIMIT 1),
g AS (SELECT t.node AS a, t.parent AS b, t.len FROM tree t, v WHERE t.parent IS NOT NULL AND t.node <> v.node UNION ALL SELECT v.node, 'root/mid', short FROM v UNION ALL SELECT t.parent, 'root/mid', t.len - short FROM tree t JOIN v USING (node)),
g2 AS (SELECT * FROM g UNION ALL SELECT b, a, len FROM g),
walk AS (SELECT 'root/mid' AS node, CAST(NULL AS varchar) AS parent, CAST(NULL AS double) AS length UNION ALL SELECT g2.b, g2.a, g2.len FROM walk w JOIN g2 ON g2.a = w.node WHERE g2.b IS DISTINCT FROM w.parent)
SELECT node, parent, length FROM walk""")
def midpoint_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooting.midpoint_rooted(_tree(spark, sf_dir).drop("name"))


@query(f"""WITH RECURSIVE {_TREE},
seen AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 40),
kept AS (SELECT 'o' || o_orderkey AS node, CAST(o_orderkey AS varchar) AS name FROM orders JOIN seen ON id = o_orderkey WHERE o_orderkey % 2 = 0 OR o_orderpriority NOT LIKE '5%'),
alive AS (SELECT DISTINCT a AS node FROM p JOIN kept ON kept.node = x),
stay AS (SELECT parent AS node FROM tree JOIN alive USING (node) WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) > 1 UNION SELECT node FROM kept),
up AS (SELECT x AS node, arg_min(a, k) AS parent FROM p JOIN stay ON stay.node = a WHERE k > 0 GROUP BY x),
cut AS (SELECT stay.node, up.parent, d.d - u.d AS length FROM stay JOIN d USING (node) LEFT JOIN up USING (node) LEFT JOIN d u ON u.node = up.parent),
n AS (SELECT *, count(*) OVER (PARTITION BY parent) AS k, row_number() OVER (PARTITION BY parent ORDER BY CAST(substr(node, 2) AS bigint) * 8 + instr('rnco', substr(node, 1, 1))) - 1 AS r FROM cut WHERE parent IS NOT NULL),
r AS (SELECT node, CASE WHEN k < 3 OR (k + r) // 2 = 1 THEN parent ELSE parent || '/' || ((k + r) // 2) END AS parent, length FROM n
  UNION ALL SELECT parent || '/' || r, CASE WHEN r // 2 = 1 THEN parent ELSE parent || '/' || (r // 2) END, 0 FROM n WHERE k > 2 AND r > 1
  UNION ALL SELECT node, NULL, NULL FROM cut WHERE parent IS NULL)
SELECT r.node, parent, length, name FROM r LEFT JOIN kept USING (node)""")
def species_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(~F.col("o_orderpriority").startswith("5"))
    names = orders.select(F.concat(F.lit("order "), "o_orderkey").alias("name"), F.col("o_orderkey").alias("id"))
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("id"))
    number = F.substring("node", 2, 20).try_cast("long") * 8 + F.instr(F.lit("rnco"), F.substring("node", 1, 1))
    return rooting.species_tree(_tree(spark, sf_dir), seen, names, order=number)


@query("""WITH f AS (SELECT 'top' || (o_custkey % 7) AS run, 'rep_' || o_orderkey || '.npz' AS file, o_custkey % 7 AS t, o_custkey % 5 AS s, o_orderkey % 2 AS e, o_orderpriority AS staged, CAST(year(o_orderdate) AS varchar) AS batch,
  bool_and(o_orderstatus = 'F') OVER (PARTITION BY o_custkey % 7) AS all_top, bool_and(o_orderstatus = 'F') OVER (PARTITION BY o_custkey % 7, o_custkey % 5) AS all_src FROM orders)
SELECT run, file,
  CASE WHEN t < 3 THEN CASE s WHEN 0 THEN 'src0:' || staged WHEN 1 THEN 'src1:' || batch WHEN 2 THEN CASE e WHEN 0 THEN 'src2:deep0:' || batch ELSE 'src2:deep1' END WHEN 3 THEN 'src3' ELSE CASE WHEN all_src THEN 'src4:' || staged ELSE 'src4' END END
    WHEN t = 3 THEN staged WHEN t = 5 AND all_top THEN staged ELSE batch END AS label,
  CASE WHEN t < 3 THEN CASE s WHEN 0 THEN 'staged' WHEN 1 THEN 'progress' WHEN 2 THEN CASE e WHEN 0 THEN 'progress' ELSE 'name' END WHEN 3 THEN 'name' ELSE CASE WHEN all_src THEN 'staged' ELSE 'name' END END
    WHEN t = 3 OR (t = 5 AND all_top) THEN 'staged' ELSE 'progress' END AS route,
  CASE WHEN t > 2 THEN run WHEN s = 2 THEN 'deep' || e ELSE 'src' || s END AS source FROM f""")
def replicate_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s, k = F.col("o_custkey") % 7, F.col("o_custkey") % 5, F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    run = lambda prefix, n: F.concat(F.lit(prefix), n)
    file = F.concat(F.lit("rep_"), k, F.lit(".npz"))
    files = o.select(run("top", t).alias("run"), file.alias("file"))
    above = o.where(t < 3).select(run("top", t).alias("run"), k.alias("merged_index"), run("src", s).alias("source_run"), file.alias("source_file"))
    below = o.where((t < 3) & (s == 2)).select(F.lit("src2").alias("run"), k.alias("merged_index"), run("deep", k % 2).alias("source_run"), file.alias("source_file"))
    written = lambda of: F.concat(F.lit("rep_"), k).alias("rep_id") if of else k.alias("replicate")
    priority, year = F.col("o_orderpriority").alias("invocation"), F.year("o_orderdate").cast("string").alias("batch")
    staged = o.where((t == 3) | ((t == 5) & (F.col("o_orderstatus") == "F"))).select(run("top", t).alias("run"), written(True), priority)
    staged = staged.unionByName(o.where((t < 3) & ((s == 0) | ((s == 4) & (F.col("o_orderstatus") == "F")))).select(run("src", s).alias("run"), written(True), priority))
    progress = o.where(t > 3).select(run("top", t).alias("run"), written(False), year)
    progress = progress.unionByName(o.where((t < 3) & (s == 1)).select(F.lit("src1").alias("run"), written(False), year))
    progress = progress.unionByName(o.where((t < 3) & (s == 2) & (k % 2 == 0)).select(F.lit("deep0").alias("run"), written(False), year))
    return provenance.invocations(files, above.unionByName(below), staged, progress)


@query()
def structure_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name and brand, blanks as gaps, on its type and name."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string").alias("structure")
    rows = part.select(key, F.translate(F.upper(F.concat_ws(" ", "p_name", "p_brand")), " ", "-").alias("sequence"))
    chains = part.select(key, F.explode(F.map_from_arrays(F.array(F.lit("A"), F.lit("B")), F.array(F.upper("p_name"), F.concat_ws("", F.upper("p_type"), F.upper("p_name"))))).alias("chain", "text"), "p_size")
    residues = chains.select("structure", "chain", "p_size", F.posexplode(F.split("text", "")).alias("ord", "residue")).where("residue <> ''").select("structure", "chain", "ord", "residue", (F.col("p_size") + F.col("ord")).alias("number"))
    return structures.column_residues(rows, residues)


def queries() -> dict[str, Query]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
