"""Trees rooted anew, cut down to chosen nodes and made binary, as table steps.

Node tables are those of ``trees`` (node, parent, length, others), with names
of nodes as strings, unique over all trees of a forest; all trees are worked
on at once. Every step is a jump over n rows (see ``intervals``), so neither a
deep tree nor a node with very many children is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from . import intervals, ranks, trees


def _length(c: str = "length") -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, parent, length, depth, distance, root, leaf) and tables (node,
    up): every node with its parent, then, for each power of two up to the
    depth, those that are parents with the node so many steps above. A parent
    that is no node is an error."""
    parents = materialize(nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct())
    if not parents.join(nodes.select("node"), "node", "left_anti").isEmpty():
        raise ValueError("a parent is not in the table of nodes")
    below = F.col("parent").isNotNull()
    start = nodes.select("node", "parent", _length().alias("length"), F.col("parent").alias("up"), below.cast("int").alias("depth"), F.when(below, _length()).otherwise(0.0).alias("distance"), F.coalesce("parent", "node").alias("root"))
    start = materialize(start.join(parents.withColumn("_in", F.lit(True)), "node", "left").withColumn("leaf", F.col("_in").isNull()).drop("_in"))
    sums = {"depth": F.col("depth") + F.col("_depth"), "distance": F.col("distance") + F.col("_distance"), "root": F.col("_root")}
    inner, points = start.where("not leaf"), F.col("up").isNotNull()
    tables = [t for _, t in intervals._jumps(inner, sums)]
    tips = start.where("leaf")
    deep = tables[-1].unionByName(tips.where(~points)).unionByName(intervals._moved(tips.where(points), tables[-1], sums))
    return materialize(deep.drop("up")), [start.where(points).select("node", "up"), *(t.select("node", "up").where(points) for t in tables[:-1])]


def _above(some: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(node): ``some`` nodes and all above them, each once. ``tables`` as of
    ``_climb``: only what is above takes the jumps."""
    reached = materialize(some.select("node").join(tables[0], "node").select(F.col("up").alias("node")).distinct())
    for table in tables[1:]:
        higher = reached.join(table, "node").select(F.col("up").alias("node"))
        reached = materialize(reached.union(higher).distinct())
    return materialize(some.select("node").union(reached).distinct())


def _onto(nodes: DataFrame, stay: DataFrame) -> DataFrame:
    """``nodes`` that ``stay`` (node), each below the nearest such node above
    it, lengths of the passed ones added; one with none above is a root."""
    mark = stay.select(F.col("node").alias("parent"), F.lit(True).alias("_stays"))
    rows = nodes.select("node", "parent", F.when(F.col("parent").isNotNull(), _length()).alias("length")).join(mark, "parent", "left")
    stays = F.coalesce("_stays", F.lit(False))
    start = rows.select("node", F.when(~stays, F.col("parent")).alias("up"), F.when(stays, F.col("parent")).alias("found"), "length")
    now = intervals._followed(start, {"found": F.col("_found"), "length": F.col("length") + F.col("_length")})
    near = now.join(stay.select("node"), "node", "left_semi").select("node", F.col("found").alias("parent"), F.when(F.col("found").isNotNull(), F.col("length")).alias("length"))
    return nodes.drop("parent", "length").join(near, "node").select(*nodes.columns)


def without_unary(nodes: DataFrame) -> DataFrame:
    """``nodes`` without those that have exactly one child; lengths add up."""
    single = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n")).where("n = 1")
    return _onto(nodes, materialize(nodes.join(single, "node", "left_anti").select("node")))


def pruned(nodes: DataFrame, keep: DataFrame) -> DataFrame:
    """The trees of the kept nodes (node): these, and the nodes with two or
    more children that are or have kept ones; lengths of passed nodes add up.
    As ``trees.pruned``, without paths; kept nodes may be inner ones."""
    kept = nodes.select("node").join(keep.select("node").distinct(), "node", "left_semi")
    alive = materialize(nodes.join(_above(kept, _climb(nodes)[1]), "node", "left_semi"))
    arms = alive.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n")).where("n > 1")
    return _onto(alive, materialize(arms.select("node").union(kept).distinct()))


def resolved(nodes: DataFrame, order: Column | None = None) -> DataFrame:
    """``nodes`` with no more than two children each. The k children of a node,
    in ``order`` (a number; a hash of their names if not given), become the
    leaves of a balanced binary tree below it, whose k - 2 new inner nodes
    <node>/2, <node>/3, ... have branches of length 0. Their places are those
    of a heap, so they follow from each child's number alone."""
    order = F.xxhash64("node") if order is None else order
    # a root has no place in the order, and Spark may compute it before the filter
    kids = nodes.where("parent is not null").select("parent", "node", F.when(F.col("parent").isNotNull(), order).alias("_order"), F.lit(1).alias("n"))
    wide = materialize(kids.groupBy("parent").agg(F.count("*").alias("k")).where("k > 2"))
    placed = ranks.running_sums(kids.join(wide, "parent", "left_semi"), "_order", ["n"], ["parent"])
    placed = materialize(placed.join(wide, "parent").select(F.col("parent").alias("_over"), "node", "k", (F.col("n_upto") - 1).alias("_r")))
    half = lambda i: F.floor(i / 2).cast("long")
    name = lambda i: F.when(i == 1, F.col("_over")).otherwise(F.concat("_over", F.lit("/"), i.cast("string")))
    r = F.col("_r").cast("long")
    moved = placed.select("node", name(half(F.col("k") + r)).alias("_to"))
    out = nodes.join(moved, "node", "left").withColumn("parent", F.coalesce("_to", "parent")).select(*nodes.columns)
    # child number j also makes the heap's inner node j
    new = placed.where("_r > 1 and _r < k").select(name(r).alias("node"), name(half(r)).alias("parent"), F.lit(0.0).alias("length"))
    return out.unionByName(new, allowMissingColumns=True)


def species_tree(nodes: DataFrame, observed: DataFrame, names: DataFrame | None = None, taxonomy: DataFrame | None = None, order: Column | None = None) -> DataFrame:
    """(node, parent, length, name): the binary tree of the ``observed`` (id).

    A leaf's token (``name``, or ``node`` without that column) of digits is an
    id; others are looked up in ``names`` (name, id), of several ids the
    least. Leaves of observed ids stay, named by the id, of several with one
    id the least node. Below two such leaves the observed nodes of
    ``taxonomy`` (node: id) take their place, inner ones too; without it, or
    without observed ids, that is an error.
    """
    ids = observed.select(F.col("id").cast("string").alias("id")).where("id is not null").distinct()
    token = F.col("name" if "name" in nodes.columns else "node")
    tips = trees.leaves(nodes).select("node", F.trim(token).alias("name"))
    # what is no number is looked up
    known = tips.where(F.col("name").rlike(r"^\d+$")).select("node", F.col("name").alias("id"))
    if names is not None:
        book = names.select(F.trim("name").alias("name"), F.col("id").cast("string").alias("id")).groupBy("name").agg(F.min(F.struct(F.length("id").alias("_"), "id"))["id"].alias("id"))
        known = known.unionByName(tips.where(~F.col("name").rlike(r"^\d+$")).join(book, "name").select("node", "id"))
    kept = materialize(known.join(ids, "id", "left_semi").groupBy("id").agg(F.min("node").alias("node")))
    if kept.limit(2).count() == 2:
        cut = pruned(nodes.select("node", "parent", "length"), kept)
    elif taxonomy is None or ids.isEmpty():
        raise ValueError("fewer than two leaves of the tree are observed, and nothing stands in for it")
    else:
        plain = taxonomy.select(F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent"), F.col("length").cast("double").alias("length") if "length" in taxonomy.columns else F.lit(1.0).alias("length"))
        kept = plain.join(ids.withColumnRenamed("id", "node"), "node", "left_semi").select(F.col("node").alias("id"), "node")
        cut = pruned(plain, kept)
    return resolved(materialize(cut), order).join(kept.withColumnRenamed("id", "name"), "node", "left").select("node", "parent", "length", "name")


def _leaving(deep: DataFrame, path: DataFrame) -> DataFrame:
    """(node, farthest): for each node of ``path`` the greatest distance from
    the root of those leaves whose nearest node on the path it is. Leaves are
    counted by their parent before the jumps, which only inner nodes take."""
    on = path.withColumn("_on", F.lit(True))
    tips = deep.where("leaf").join(on, "node", "left").groupBy(F.when(F.col("_on"), F.col("node")).otherwise(F.col("parent")).alias("node"), F.col("_on").isNotNull().alias("here")).agg(F.max("distance").alias("farthest"))
    tips = materialize(tips)
    inner = deep.where("not leaf").join(on, "node", "left").select("node", F.when(F.col("_on").isNull(), F.col("parent")).alias("up"), F.when(F.col("_on"), F.col("node")).alias("found"))
    found = intervals._followed(inner, {"found": F.col("_found")}).select("node", "found")
    away = tips.where("not here").join(found, "node").select(F.col("found").alias("node"), "farthest")
    return tips.where("here").select("node", "farthest").unionByName(away).groupBy("node").agg(F.max("farthest").alias("farthest"))


def midpoint_rooted(nodes: DataFrame, suffix: str = "/mid") -> DataFrame:
    """Every tree rooted halfway along its longest path between two leaves.

    The leaf farthest from the root, by name of ties, is one end of such a
    path; how far a leaf is from it follows from the nearest node above that
    leaf which is also above the end. The new root <old root><suffix> parts
    the branch that holds the middle, branches from there to the old root turn
    round, and an old root left with one child goes. Other columns stay with
    their nodes, lengths follow the branches, a null one is 0. Trees without
    length or with one leaf stay as they are; a negative length is an error.
    """
    if not nodes.where((F.col("length") < 0) & F.col("parent").isNotNull()).isEmpty():
        raise ValueError("a branch of negative length")
    n_kids = materialize(nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_kids")))
    if not nodes.where("parent is null").join(n_kids.where("n_kids = 1"), "node").isEmpty():
        return midpoint_rooted(materialize(without_unary(nodes)), suffix)
    deep, tables = _climb(nodes)
    end = materialize(deep.where("leaf").groupBy("root").agg(F.min(F.struct((-F.col("distance")).alias("d"), "node")).alias("e")).select("root", F.col("e.node").alias("node"), (-F.col("e.d")).alias("reach")))
    path = materialize(deep.join(_above(end, tables), "node", "left_semi"))
    # the farthest leaf of those that leave the path at each of its nodes
    farthest = materialize(_leaving(deep, path.select("node")))
    met = farthest.join(path.select("node", "root", F.col("distance").alias("_shared")), "node")
    span = met.join(end.select("root", "reach"), "root").groupBy("root", "reach").agg((F.max(F.col("reach") + F.col("farthest") - 2 * F.col("_shared")) / 2).alias("half")).where("half > 0")
    # the last node before the middle, going up from the end
    walk = materialize(path.join(span, "root").withColumn("short", F.col("half") - (F.col("reach") - F.col("distance"))))
    split = walk.where("short > 0").groupBy("root").agg(F.min_by(F.struct("node", "short", "depth"), "depth").alias("v")).select("root", "v.*")
    cut = materialize(split.join(path.select("node", F.col("parent").alias("over"), "length"), "node"))
    top = F.concat("root", F.lit(suffix))
    turned = walk.join(cut.select("root", F.col("depth").alias("_depth")), "root").where("depth < _depth and node <> root").select(F.col("parent").alias("node"), F.col("node").alias("_to"), F.col("length").alias("_length"))
    moved = turned.unionByName(cut.select("node", top.alias("_to"), F.col("short").alias("_length"))).unionByName(cut.select(F.col("over").alias("node"), top.alias("_to"), (F.col("length") - F.col("short")).alias("_length")))
    moved = materialize(moved)
    gone = materialize(moved.join(cut.select(F.col("root").alias("node")), "node").join(n_kids.where("n_kids = 2"), "node").select("node", "_to", "_length"))
    out = nodes.join(moved, "node", "left").join(gone.select("node"), "node", "left_anti")
    out = out.select(*(F.coalesce("_to", "parent").alias("parent") if c == "parent" else F.coalesce("_length", "length").alias("length") if c == "length" else F.col(c) for c in nodes.columns))
    lone = gone.select(F.col("node").alias("parent"), "_to", "_length")
    out = out.join(lone, "parent", "left").select(*(F.coalesce("_to", "parent").alias("parent") if c == "parent" else (F.coalesce("_length", F.lit(0.0)) + _length()).alias("length") if c == "length" else F.col(c) for c in nodes.columns))
    new = cut.select(top.alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("double").alias("length"))
    return out.withColumn("length", F.when(F.col("parent").isNotNull(), F.col("length"))).unionByName(new, allowMissingColumns=True)
