"""Trees of any depth as edge tables, joined level by level.

A node table has ``node``, ``parent`` (null at the root), ``length`` and maybe
``name`` and ``event``; names of these columns are fixed, other columns pass
by. A forest is a tree table with several roots.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from . import ranks


def ancestors(nodes: DataFrame, most: int = 64) -> DataFrame:
    """(node, ancestor, steps, distance): every node with itself and each of
    its ancestors. Doubles the paths each round, so a tree of depth d needs
    log2(d) joins. A cycle or a depth beyond 2 ** ``most`` is an error."""
    up = materialize(nodes.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("steps"), F.coalesce(F.col("length").cast("double"), F.lit(0.0)).alias("distance")))
    known, reach = up, 1
    for _ in range(most):
        # all paths of up to ``reach`` steps are known; those of exactly that many lead on
        far = known.where(F.col("steps") == reach).select("node", F.col("ancestor").alias("_mid"), F.col("distance").alias("_d"))
        more = far.join(known.select(F.col("node").alias("_mid"), "ancestor", "steps", "distance"), "_mid").select("node", "ancestor", (F.col("steps") + reach).alias("steps"), (F.col("distance") + F.col("_d")).alias("distance"))
        more = materialize(more)
        if more.isEmpty():
            own = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps"), F.lit(0.0).alias("distance"))
            return own.unionByName(known)
        if more.where("node = ancestor").limit(1).count():
            raise ValueError("the tree has a cycle")
        known, reach = materialize(known.unionByName(more)), reach * 2
    raise ValueError("the tree is too deep")


def depths(paths: DataFrame) -> DataFrame:
    """(node, depth, distance) from the root, of ``ancestors``."""
    return paths.groupBy("node").agg(F.max("steps").alias("depth"), F.max_by("distance", "steps").alias("distance"))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are no one's parent."""
    return nodes.join(nodes.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")


def leaf_closure(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, leaf): every node with the leaves below it, a leaf with itself."""
    return paths.join(leaves(nodes).select("node"), "node").select(F.col("ancestor").alias("node"), F.col("node").alias("leaf"))


def clade_sizes(closure: DataFrame) -> DataFrame:
    return closure.groupBy("node").agg(F.count("*").alias("clade_size"), F.min("leaf").alias("first_leaf"), F.max("leaf").alias("last_leaf"))


def signatures(closure: DataFrame, leaf_names: DataFrame | None = None) -> DataFrame:
    """(node, n_leaves, signature): a digest of the sorted set of leaf names
    below each node, equal for equal sets in whatever tree. With
    ``leaf_names`` (leaf, name) names stand for the leaves.

    Two independent sums of hashes make up the digest, so no node gathers its
    leaves in one row, and a complement's digest is a difference of sums."""
    named = closure.withColumn("name", F.col("leaf").cast("string")) if leaf_names is None else closure.join(leaf_names, "leaf")
    named = named.select("node", F.col("name").cast("string").alias("name")).distinct()
    parts = [F.sum(F.xxhash64(F.lit(s), "name").cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"_h{s}") for s in (1, 2)]
    return named.groupBy("node").agg(F.count("*").alias("n_leaves"), *parts).select("node", "n_leaves", F.struct(F.col("_h1").alias("h1"), F.col("_h2").alias("h2")).alias("signature"))


def match_signatures(left: DataFrame, right: DataFrame, complements: bool = False) -> DataFrame:
    """(node, match, by): nodes of ``left`` with the nodes of ``right`` that
    have the same leaves ('same'), or, if ``complements`` and there is none,
    all the other leaves of their tree ('complement')."""
    key = lambda s: [F.col(f"{s}.n_leaves"), F.col(f"{s}.signature.h1"), F.col(f"{s}.signature.h2")]
    a, b = left.alias("a"), right.alias("b")
    eq = lambda x, y: (x[0] == y[0]) & (x[1] == y[1]) & (x[2] == y[2])
    same = a.join(b, eq(key("a"), key("b"))).select(F.col("a.node").alias("node"), F.col("b.node").alias("match"), F.lit("same").alias("by"))
    if not complements:
        return same
    whole = right.orderBy(F.desc("n_leaves"), "node").limit(1).select(F.col("n_leaves").alias("_n"), F.col("signature.h1").alias("_h1"), F.col("signature.h2").alias("_h2"))
    rest = left.join(same, "node", "left_anti").crossJoin(F.broadcast(whole))
    rest = rest.select("node", (F.col("_n") - F.col("n_leaves")).alias("n_leaves"), F.struct((F.col("_h1") - F.col("signature.h1")).cast("decimal(38,0)").alias("h1"), (F.col("_h2") - F.col("signature.h2")).cast("decimal(38,0)").alias("h2")).alias("signature"))
    other = rest.alias("a").join(b, eq(key("a"), key("b"))).select(F.col("a.node").alias("node"), F.col("b.node").alias("match"), F.lit("complement").alias("by"))
    return same.unionByName(other)


def lowest_common(paths: DataFrame, sets: DataFrame, group: str, member: str) -> DataFrame:
    """(group, lca, n_members): the deepest node above or equal to all members
    of each group; groups of which no node is above all have none."""
    some = sets.select(F.col(group).alias("g"), F.col(member).alias("node")).where("g is not null and node is not null").distinct()
    size = some.groupBy("g").agg(F.count("*").alias("n_members"))
    met = some.join(paths, "node").groupBy("g", "ancestor").agg(F.count("*").alias("n_members"))
    deep = depths(paths).select(F.col("node").alias("ancestor"), "depth")
    over = met.join(size, ["g", "n_members"]).join(deep, "ancestor")
    return over.groupBy("g", "n_members").agg(F.max_by("ancestor", "depth").alias("lca")).select(F.col("g").alias(group), "lca", "n_members")


def splits(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, event, left, right, size_left, size_right, size_total, n_children, n_named)
    of every inner node; left and right are its first two children by ``ord``
    (or by id, without that column)."""
    by = "ord" if "ord" in nodes.columns else "node"
    kids = nodes.where("parent is not null").join(sizes.select("node", "clade_size"), "node", "left")
    one = F.struct(F.col(by).alias("o"), F.col("node").alias("node"), F.col("clade_size").alias("size"))
    named = F.count_if(F.length(F.trim(F.coalesce("name", F.lit("")))) > 0) if "name" in nodes.columns else F.count("*")
    # a polytomy of any width keeps two children only
    first = kids.groupBy("parent").agg(F.min(one).alias("l"), F.count("*").alias("n_children"), named.alias("n_named"), F.sum("clade_size").alias("size_total"))
    later = kids.join(first.select("parent", F.col("l.node").alias("_l")), "parent").where(F.col("node") != F.col("_l")).groupBy("parent").agg(F.min(one).alias("r"))
    event = nodes.select(F.col("node").alias("parent"), F.col("event") if "event" in nodes.columns else F.lit(None).cast("string").alias("event"))
    return first.join(later, "parent", "left").join(event, "parent").select(F.col("parent").alias("node"), "event", F.col("l.node").alias("left"), F.col("r.node").alias("right"), F.col("l.size").alias("size_left"), F.col("r.size").alias("size_right"), "size_total", "n_children", "n_named")


def scoring_status(split: DataFrame, events: list[str], least_clade: int, states: DataFrame | None = None) -> DataFrame:
    """``split`` with ``status``, the first that holds: polytomy, unnamed,
    unresolved, small, no_states, scored. ``states``: nodes with states."""
    if states is not None:
        have = states.select(F.col("node").alias("_s")).distinct()
        split = split.join(have.withColumnRenamed("_s", "left").withColumn("_l", F.lit(True)), "left", "left").join(have.withColumnRenamed("_s", "right").withColumn("_r", F.lit(True)), "right", "left")
    else:
        split = split.withColumns({"_l": F.lit(True), "_r": F.lit(True)})
    status = (
        F.when(F.col("n_children") != 2, "polytomy").when(F.col("n_named") < 2, "unnamed")
        .when(~F.coalesce(F.col("event").isin(*events), F.lit(False)), "unresolved")
        .when(F.least("size_left", "size_right") < least_clade, "small")
        .when(F.coalesce("_l", F.lit(False)) & F.coalesce("_r", F.lit(False)), "scored").otherwise("no_states")
    )
    return split.withColumn("status", status).drop("_l", "_r")


def clade_partition(paths: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, clade): the nearest marked node above or equal; null if none."""
    m = marked.select(F.col("node").alias("ancestor")).distinct()
    near = paths.join(m, "ancestor").groupBy("node").agg(F.min_by("ancestor", "steps").alias("clade"))
    return paths.select("node").distinct().join(near, "node", "left")


def nearest_with(paths: DataFrame, holders: DataFrame, key: str = "node", value: str = "value") -> DataFrame:
    """(node, value, steps): what the nearest ancestor (or the node itself)
    that has a value holds; nodes without one have no row. Of several values
    of one holder the smallest."""
    held = holders.select(F.col(key).alias("ancestor"), F.col(value).alias("value")).where("value is not null").groupBy("ancestor").agg(F.min("value").alias("value"))
    return paths.join(held, "ancestor").groupBy("node").agg(F.min_by("value", "steps").alias("value"), F.min("steps").alias("steps"))


def dominant(closure: DataFrame, labels: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """(node, label, n): the commonest label (leaf, label) among a node's
    leaves, ``unknown`` and null left out; of ties the first by name. With a
    column ``n`` in ``labels`` a row counts so many times."""
    n = F.sum("n") if "n" in labels.columns else F.count("*")
    n = closure.join(labels.where(F.col("label").isNotNull() & (F.col("label") != unknown)), "leaf").groupBy("node", "label").agg(n.alias("n"))
    return n.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("_"), "label", "n")).alias("b")).select("node", "b.label", "b.n")


def mixed_nodes(closure: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node, n_clusters): nodes whose leaves lie in several (leaf, cluster)."""
    return closure.join(clusters, "leaf").groupBy("node").agg(F.count_distinct("cluster").alias("n_clusters")).where("n_clusters > 1")


def pruned(nodes: DataFrame, paths: DataFrame, keep: DataFrame) -> DataFrame:
    """The tree of the kept leaves (node): nodes with two or more children that
    have some, and the leaves; lengths of passed nodes add up."""
    kept = leaves(nodes).select("node").join(keep.select("node"), "node", "left_semi")
    above = paths.join(kept, "node").select(F.col("ancestor").alias("node")).distinct()
    arms = nodes.join(above, "node", "left_semi").where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("arms"))
    stay = materialize(arms.where("arms > 1").select("node").union(kept).distinct())
    near = paths.where("steps > 0").join(stay, "node", "left_semi").join(stay.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi")
    up = near.groupBy("node").agg(F.min_by("ancestor", "steps").alias("parent"), F.min_by("distance", "steps").alias("length"))
    return stay.join(up, "node", "left")


def swappable(nodes: DataFrame) -> DataFrame:
    """Inner nodes, not the root, that a nearest-neighbour swap can use: they
    and their parents have two children or more."""
    arms = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n")).where("n > 1")
    a = arms.select(F.col("parent").alias("node"))
    return nodes.where("parent is not null").join(a, "node", "left_semi").join(a.withColumnRenamed("node", "parent"), "parent", "left_semi").select("node", "parent")


def depth_cut(deep: DataFrame, nodes: DataFrame, k: int) -> float:
    """The least depth of a node at which a cut leaves at least ``k`` clades;
    infinity if the tree has fewer leaves.

    A cut at t leaves a clade for each branch that starts above t and ends at
    t or below, and for each leaf above t. So between two depths the number
    changes by what starts and ends at the upper one, and all cuts come from
    one running sum over the depths; one number reaches the driver."""
    arms = nodes.where("parent is not null").join(deep.select(F.col("node").alias("parent"), F.col("distance").alias("_up")), "parent").join(deep.select("node", "distance"), "node")
    ends = leaves(nodes).select("node").join(deep.select("node", "distance"), "node")
    steps = arms.select(F.col("_up").alias("depth"), F.lit(1).alias("n")).unionByName(arms.select(F.col("distance").alias("depth"), F.lit(-1).alias("n"))).unionByName(ends.select(F.col("distance").alias("depth"), F.lit(1).alias("n")))
    upto = ranks.running_sums(steps.groupBy("depth").agg(F.sum("n").alias("n")), "depth", ["n"])
    found = upto.agg(F.min(F.when(F.col("n_upto") - F.col("n") >= k, F.col("depth"))).alias("at"), F.max("depth").alias("last"), F.max_by("n_upto", "depth").alias("n_leaves")).first()
    if found["at"] is not None:
        return found["at"]
    return math.nextafter(found["last"], math.inf) if found["n_leaves"] is not None and found["n_leaves"] >= k else math.inf


def majority(votes: DataFrame, key: str, label: str, order: Column | str) -> DataFrame:
    """(key, label, n): the commonest label; of ties the one seen first."""
    order = F.col(order) if isinstance(order, str) else order
    n = votes.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"), F.min(order).alias("_seen"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("_"), "_seen", label, "n")).alias("b")).select(key, F.col(f"b.{label}").alias(label), "b.n")


def with_fallback(voted: DataFrame, tagged: DataFrame, key: str, label: str) -> DataFrame:
    """``tagged`` (key, label) with the voted label where there is one."""
    v = voted.select(key, F.col(label).alias("_v"))
    return tagged.join(v, key, "left").withColumn(label, F.coalesce("_v", label)).drop("_v")


def level_order(nodes: DataFrame, deep: DataFrame) -> DataFrame:
    """(node, number) of the inner nodes from 0 by depth, then id: numbers are
    given inside each depth and shifted by the counts of those above."""
    inner = deep.join(leaves(nodes).select("node"), "node", "left_anti")
    size = inner.groupBy("depth").agg(F.count("*").alias("n"))
    w = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    shift = size.select("depth", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_shift"))
    here = Window.partitionBy("depth").orderBy("node")
    return inner.join(F.broadcast(shift), "depth").select("node", (F.row_number().over(here) - 1 + F.col("_shift")).alias("number"))
