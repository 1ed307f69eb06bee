"""Trees without paths: jumps and intervals, as many rows as nodes.

Nothing here writes a node with each of its ancestors. A jump doubles how far
every node sees, so a tree of depth d takes log2(d) rounds over n rows. An
Euler tour, ranked in the same way, numbers the nodes so that the ones below
a node are one interval: what is asked of clades becomes a difference of
running sums, and a common ancestor a few look-ups. Node tables are those of
``trees``; node names are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from . import ranks


def levels(nodes: DataFrame) -> DataFrame:
    """(node, depth, distance) from the root: branches and their lengths, a
    null one 0. A cycle is an error."""
    start = nodes.select("node", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("int").alias("depth"), F.when(F.col("parent").isNotNull(), F.coalesce(F.col("length").cast("double"), F.lit(0.0))).otherwise(0.0).alias("distance"))
    return _followed(start, {"depth": F.col("depth") + F.col("_depth"), "distance": F.col("distance") + F.col("_distance")}).select("node", "depth", "distance")


def _jumps(start: DataFrame, sums: dict[str, Column], keys: tuple[str, ...] = ("node",), to: tuple[str, ...] = ("up",)):
    """(round, table) from ``start`` on, each round with every pointer ``to``
    moved on to where the row it shows points, and ``sums`` taken over both
    rows (the other's columns with an underscore). Rows that point nowhere
    are done and aren't joined again, so no key gathers them."""
    now = materialize(start)
    # after k rounds every way of fewer than 2 ** k steps has come to its end
    for k in range(now.count().bit_length() + 2):
        yield k, now
        left = now.where(F.col(to[0]).isNotNull())
        if left.isEmpty():
            return
        now = materialize(now.where(F.col(to[0]).isNull()).unionByName(_moved(left, now, sums, keys, to)))
    raise ValueError("the tree has a cycle")


def _inner_and_outer(start: DataFrame, keys: tuple[str, ...] = ("node",), to: tuple[str, ...] = ("up",)) -> tuple[DataFrame, DataFrame]:
    """The rows of ``start`` that others point to, and the rest, which is
    most of a tree."""
    shown = start.where(F.col(to[0]).isNotNull()).select(*(F.col(a).alias(f"_{b}") for a, b in zip(to, keys, strict=True))).distinct().withColumn("_shown", F.lit(True))
    flagged = materialize(start.join(shown, [F.col(b) == F.col(f"_{b}") for b in keys], "left").select(*start.columns, F.coalesce("_shown", F.lit(False)).alias("_shown")))
    return flagged.where("_shown").drop("_shown"), flagged.where("not _shown").drop("_shown")


def _moved(left: DataFrame, now: DataFrame, sums: dict[str, Column], keys: tuple[str, ...] = ("node",), to: tuple[str, ...] = ("up",)) -> DataFrame:
    """``left`` with every pointer moved on to where its row in ``now`` points."""
    other = now.select(*(F.col(c).alias(f"_{c}") for c in now.columns))
    on = [F.col(a) == F.col(f"_{b}") for a, b in zip(to, keys, strict=True)]
    return left.join(other, on).select(*(sums[c].alias(c) if c in sums else F.col(f"_{c}").alias(c) if c in to else F.col(c) for c in left.columns))


def _followed(start: DataFrame, sums: dict[str, Column], keys: tuple[str, ...] = ("node",), to: tuple[str, ...] = ("up",)) -> DataFrame:
    """``start`` with all pointers followed to the end, as the last table of
    ``_jumps``. Only rows that others point to take the jumps; the rest joins
    them once, at the end."""
    inner, outer = _inner_and_outer(start, keys, to)
    for _, now in _jumps(inner, sums, keys, to):
        pass
    points = F.col(to[0]).isNotNull()
    return materialize(now.unionByName(outer.where(~points)).unionByName(_moved(outer.where(points), now, sums, keys, to)))


def nearest(nodes: DataFrame, marked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, node, found, steps): the nearest marked node above or equal to
    each node, and how far up; null where none is. ``marked``: (by, node).
    With ``by`` (a threshold, say) all its values are followed at once, each
    over the whole tree."""
    by = by or []
    m = marked.select(*by, "node").distinct()
    rows = nodes.select("node", "parent")
    if by:
        rows = rows.crossJoin(F.broadcast(m.select(*by).distinct()))
    start = rows.join(m.withColumn("_marked", F.lit(True)), [*by, "node"], "left")
    # a marked node, and a root without a mark, point nowhere
    start = start.select(*by, "node", F.when(F.col("_marked").isNull(), F.col("parent")).alias("up"), F.when(F.col("_marked"), F.col("node")).alias("found"), F.when(F.col("_marked").isNull() & F.col("parent").isNotNull(), 1).otherwise(0).alias("steps"))
    sums = {"found": F.col("_found"), "steps": F.col("steps") + F.col("_steps")}
    now = _followed(start, sums, ("node", *by), ("up", *by))
    return now.select(*by, "node", "found", F.when(F.col("found").isNotNull(), F.col("steps")).alias("steps"))


def partition_sweep(nodes: DataFrame, scores: DataFrame, shares: list[float], node: str = "node", score: str = "score") -> DataFrame:
    """A row for each share: the scores' percentile as cutoff, the nodes that
    reach it, and what the tree's leaves fall into if each belongs to the
    nearest such node above or equal to it, else to the root's part: share,
    cutoff, n_marked, n_clades, n_leaves, root_leaves, other_leaves,
    other_share, n_multiple, n_single, largest, largest_share, median_size.
    All shares go down the tree at once."""
    cuts = ranks.percentiles(scores, score, shares).select("share", F.col("percentile").alias("cutoff"))
    some = scores.select(F.col(node).alias("node"), F.col(score).alias("s")).crossJoin(F.broadcast(cuts)).where("s >= cutoff").select("share", "node").distinct()
    marked = materialize(some)
    parents = nodes.select(F.col("parent").alias("node")).where("node is not null").distinct()
    tips = nearest(nodes, marked, ["share"]).join(parents, "node", "left_anti")
    sizes = materialize(tips.groupBy("share", "found").agg(F.count("*").alias("n")))
    # ``percentiles`` has columns share and n of its own
    middle = ranks.percentiles(sizes.select(F.col("share").alias("_of"), F.col("n").alias("size")), "size", [0.5], ["_of"]).select(F.col("_of").alias("share"), F.col("percentile").alias("median_size"))
    root = F.coalesce(F.sum(F.when(F.col("found").isNull(), F.col("n"))), F.lit(0))
    out = sizes.groupBy("share").agg(F.sum("n").alias("n_leaves"), root.alias("root_leaves"), F.count_if(F.col("n") > 1).alias("n_multiple"), F.count_if(F.col("n") == 1).alias("n_single"), F.max("n").alias("largest"))
    held = marked.join(nodes.select("node"), "node", "left_semi").groupBy("share").agg((F.count("*") + 1).alias("n_clades"))
    out = out.join(cuts, "share").join(marked.groupBy("share").agg(F.count("*").alias("n_marked")), "share").join(held, "share", "left").join(middle, "share")
    other = F.col("n_leaves") - F.col("root_leaves")
    return out.select("share", "cutoff", "n_marked", F.coalesce("n_clades", F.lit(1)).alias("n_clades"), "n_leaves", "root_leaves", other.alias("other_leaves"), (other / F.col("n_leaves")).alias("other_share"), "n_multiple", "n_single", "largest", (F.col("largest") / F.col("n_leaves")).alias("largest_share"), "median_size")


def tour(nodes: DataFrame) -> DataFrame:
    """(node, parent, pre, size, first_leaf, n_leaves): the place of each node
    in a walk that goes down before it goes on, how many nodes it and those
    below it are (places pre to pre + size - 1), and likewise for leaves.

    Siblings are put in an order by running sums, so a node with very many
    children is no single task; then every way in and out of a node points to
    the next one, and doubling counts what follows. An error if the table is
    not one tree.
    """
    rows = materialize(nodes.select("node", "parent"))
    order = F.xxhash64("node")
    kids = rows.where("parent is not null").select("parent", order.alias("h"), "node", F.lit(1).alias("n"))
    placed = materialize(ranks.running_sums(kids, "h", ["n"], ["parent"]).select("parent", "node", F.col("n_upto").alias("at")))
    first = placed.where("at = 1").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    after = placed.select("parent", (F.col("at") - 1).alias("at"), F.col("node").alias("sibling"))
    go = rows.join(first, "node", "left")
    inward = go.select("node", F.lit(0).alias("side"), F.coalesce("child", "node").alias("to"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("to_side"), F.lit(1).cast("long").alias("nodes"), F.when(F.col("child").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    back = rows.join(placed, ["node", "parent"], "left").join(after, ["parent", "at"], "left")
    outward = back.select("node", F.lit(1).alias("side"), F.coalesce("sibling", "parent").alias("to"), F.when(F.col("sibling").isNull(), 1).otherwise(0).alias("to_side"), F.lit(0).cast("long").alias("nodes"), F.lit(0).cast("long").alias("leaves"))
    sums = {c: F.col(c) + F.col(f"_{c}") for c in ("nodes", "leaves")}
    for _, now in _jumps(inward.unionByName(outward), sums, ("node", "side"), ("to", "to_side")):
        pass
    # what follows the way in, less what follows the way out, lies below
    both = now.groupBy("node").agg(*(F.sum(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in ("nodes", "leaves")))
    n = both.agg(F.max("nodes0").alias("_n"), F.max("leaves0").alias("_l"), F.count("*").alias("_rows"))
    out = both.crossJoin(F.broadcast(n)).join(rows, "node").select("node", "parent", (F.col("_n") - F.col("nodes0")).alias("pre"), (F.col("nodes0") - F.col("nodes1")).alias("size"), (F.col("_l") - F.col("leaves0")).alias("first_leaf"), (F.col("leaves0") - F.col("leaves1")).alias("n_leaves"), "_n", "_rows")
    broken = F.when(F.col("_n") != F.col("_rows"), F.raise_error(F.lit("the nodes are not one tree")).cast("boolean")).otherwise(True)
    return materialize(out.where(broken).drop("_n", "_rows"))


def clade_sums(toured: DataFrame, values: DataFrame, sums: list[str], leaf: str = "leaf") -> DataFrame:
    """(node, n_leaves, sums): of ``values`` (leaf, sums) over the leaves below
    each node, or itself; a leaf without a row adds 0. A running sum over the
    leaves, read at both ends of each clade."""
    leaves = toured.where("size = 1").select(F.col("node").alias(leaf), F.col("first_leaf").alias("_at"))
    total = values.groupBy(leaf).agg(*(F.sum(c).alias(c) for c in sums))
    filled = leaves.join(total, leaf, "left").na.fill(0, sums).select("_at", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums))
    upto = materialize(ranks.running_sums(filled, "_at", sums).select("_at", *(f"{c}_upto" for c in sums)))
    ends = toured.select("node", "n_leaves", (F.col("first_leaf") + F.col("n_leaves") - 1).alias("_last"), (F.col("first_leaf") - 1).alias("_before"))
    hi = upto.select(F.col("_at").alias("_last"), *(F.col(f"{c}_upto").alias(f"_hi_{c}") for c in sums))
    lo = upto.select(F.col("_at").alias("_before"), *(F.col(f"{c}_upto").alias(f"_lo_{c}") for c in sums))
    return ends.join(hi, "_last").join(lo, "_before", "left").select("node", "n_leaves", *((F.col(f"_hi_{c}") - F.coalesce(F.col(f"_lo_{c}"), F.lit(0))).alias(c) for c in sums))


def signatures(toured: DataFrame, names: DataFrame) -> DataFrame:
    """(node, n_leaves, signature) as ``trees.signatures`` gives them, of the
    leaves in ``names`` (leaf, name), each name once, without a closure."""
    named = names.select("leaf", F.col("name").cast("string").alias("name")).distinct()
    hashed = named.select("leaf", F.lit(1).cast("long").alias("n"), *(F.xxhash64(F.lit(s), "name").cast("decimal(38,0)").alias(f"h{s}") for s in (1, 2)))
    got = clade_sums(toured, hashed, ["n", "h1", "h2"]).where("n > 0")
    return got.select("node", F.col("n").alias("n_leaves"), F.struct(*(F.col(f"h{s}").cast("decimal(38,0)").alias(f"h{s}") for s in (1, 2))).alias("signature"))


def lowest_common(toured: DataFrame, sets: DataFrame, group: str, member: str) -> DataFrame:
    """(group, lca, n_members): the deepest node above or equal to all members
    of each group. It is above the member with the least place and reaches the
    one with the largest; from the former each group climbs by halving jumps,
    one join of the groups for each power of two up to the tree's depth."""
    some = sets.select(F.col(group).alias("_g"), F.col(member).alias("node")).where("_g is not null and node is not null").distinct().join(toured.select("node", "pre"), "node")
    groups = materialize(some.groupBy("_g").agg(F.min_by("node", "pre").alias("at"), F.max("pre").alias("hi"), F.count("*").alias("n_members")))
    where = toured.select("node", (F.col("pre") + F.col("size") - 1).alias("end"))
    tables = [t.select(F.col("node").alias("at"), "up") for _, t in _jumps(toured.select("node", F.col("parent").alias("up")), {})]
    for table in reversed(tables):
        # go up as long as that doesn't reach the last member
        ahead = groups.join(table.where("up is not null"), "at", "left").join(where.withColumnRenamed("node", "up"), "up", "left")
        groups = materialize(ahead.select("_g", F.when(F.col("end") < F.col("hi"), F.col("up")).otherwise(F.col("at")).alias("at"), "hi", "n_members"))
    here = groups.join(toured.select(F.col("node").alias("at"), "parent", (F.col("pre") + F.col("size") - 1).alias("end")), "at")
    return here.select(F.col("_g").alias(group), F.when(F.col("end") >= F.col("hi"), F.col("at")).otherwise(F.col("parent")).alias("lca"), "n_members")
