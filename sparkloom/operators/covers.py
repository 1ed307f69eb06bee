"""A small set of members that meets every cluster: reductions, then greedy.

Every step is a join or a grouped sum over the table of memberships, or works
out many greedy steps on a block of bounded size; no pairs of a cluster's
members are made.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from ..session import materialize
from . import residues

#: Memberships that the greedy step gives to a task, at most.
BLOCK = 1_000_000


def _contained(rows: DataFrame, item: str, of: str) -> tuple[DataFrame, DataFrame]:
    """Items whose ``of``s are all among those of another item, which has
    more, and the items that hold another one's so."""
    pairs, sets = residues.contained_classes(rows, item, of)
    pairs = materialize(pairs)
    sides = (sets.join(pairs.select(F.col(side).alias("class")).distinct(), "class", "left_semi").select(F.col("key").alias(item)) for side in ("inner", "outer"))
    return tuple(materialize(s) for s in sides)


def _without(rows: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    return materialize(rows.join(gone.select(on).distinct(), on, "left_anti"))


def _parts(rows: DataFrame) -> DataFrame:
    """(m, part): members that clusters link, also through others, share a
    part, named by the least of them. Parts have no say in each other."""
    low = rows.groupBy("c").agg(F.min("m").alias("to"))
    links = rows.join(low, "c").where("m <> to").select("m", "to").distinct()
    links = materialize(links.unionByName(links.select(F.col("to").alias("m"), F.col("m").alias("to"))))
    now = materialize(rows.select("m", F.col("m").alias("part")).distinct())
    while True:
        near = links.join(now.select(F.col("m").alias("to"), "part"), "to").select("m", "part")
        step = materialize(near.unionByName(now).groupBy("m").agg(F.min("part").alias("part")))
        # a part's name is a member, which may be in a smaller one by now
        up = step.select(F.col("m").alias("part"), F.col("part").alias("up"))
        after = materialize(step.join(up, "part").select("m", F.col("up").alias("part")))
        if after.join(now, ["m", "part"], "left_anti").isEmpty():
            return after
        now = after


def _firsts(rows: DataFrame, n: DataFrame) -> DataFrame:
    """Members with most clusters, of equals the smallest, in each of theirs."""
    first = rows.join(n, "m").groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("less"), "m")).alias("b")).groupBy(F.col("b.m").alias("m")).agg(F.count("*").alias("best"))
    return first.join(n, "m").where("best = n").select("m")


def _greedy(rows: DataFrame) -> list[DataFrame]:
    """Tables of members (m) that the greedy step takes, until none is left.

    In a round, each part takes the members with most clusters, as many as
    fill a block. Greedy steps among them are final while the best one meets
    more than anyone outside did when the round began, as that only falls. A
    part whose equal first members don't fit in a block takes those that are
    first in all their clusters."""

    def work(block: pd.DataFrame) -> pd.DataFrame:
        """Members of a block that the greedy step takes while they meet more
        clusters than any member of their part outside of it, ``rest``."""
        names, who = np.unique(block["m"].to_numpy(), return_inverse=True)
        where = pd.factorize(block["c"])[0]
        count, size = np.bincount(who), np.bincount(where)
        rest = np.zeros(len(names), np.int64)
        rest[who] = block["rest"].to_numpy()
        clusters, first = where[np.argsort(who, kind="stable")], np.concatenate(([0], np.cumsum(count)))
        members, begin = who[np.argsort(where, kind="stable")], np.concatenate(([0], np.cumsum(size)))
        met, out = np.zeros(len(size), bool), []
        heap = [(-int(n), i) for i, n in enumerate(count)]
        heapq.heapify(heap)
        while heap:
            less, i = heapq.heappop(heap)
            if count[i] <= rest[i]:
                continue
            if -less > count[i]:
                heapq.heappush(heap, (-int(count[i]), i))
                continue
            out.append(i)
            own = clusters[first[i] : first[i + 1]]
            own = own[~met[own]]
            met[own] = True
            for c in own:
                count[members[begin[c] : begin[c + 1]]] -= 1
        return pd.DataFrame({"m": names[out]})

    taken, total = [], rows.count()
    rows = rows.withColumn("part", F.lit(0)) if total <= BLOCK else materialize(rows.join(_parts(rows), "m"))
    while total:
        n = materialize(rows.groupBy("part", "m").agg(F.count("*").alias("n")))
        down = Window.partitionBy("part").orderBy(F.desc("n"))
        level = n.groupBy("part", "n").agg(F.sum("n").alias("_in")).withColumn("_upto", F.sum("_in").over(down))
        over = F.col("_upto") > BLOCK
        cut = level.groupBy("part").agg(F.coalesce(F.max(F.when(over, F.col("n"))), F.lit(0)).alias("rest"), F.coalesce(F.max(F.when(~over, F.col("_upto"))), F.lit(0)).alias("_held"))
        # small parts share a task; large ones have their own
        small = F.col("_held") <= BLOCK // 16
        cut = materialize(cut.withColumns({"_own": F.when(~small, F.col("part")), "_shared": F.when(small, F.pmod(F.xxhash64("part"), F.lit(4 * total // BLOCK + 1)))}))
        best = n.join(cut, "part").where("n > rest").select("m", "rest", "_own", "_shared")
        block = rows.select("c", "m").join(best, "m")
        now = block.groupBy("_own", "_shared").applyInPandas(work, StructType([StructField("m", rows.schema["m"].dataType)]))
        slow = cut.where("_held = 0").select("part")
        if not slow.isEmpty():
            now = now.unionByName(_firsts(rows.join(slow, "part", "left_semi").select("c", "m"), n.select("m", "n")))
        taken.append(materialize(now))
        if cut.where("rest > 0").isEmpty():
            break
        rows = _without(rows, rows.join(taken[-1], "m", "left_semi"), "c")
        total = rows.count()
    return taken


def set_cover(memberships: DataFrame, cluster: str = "cluster", member: str = "member") -> DataFrame:
    """(member, by): members that together meet every cluster, and whether a
    cluster had no other ('essential') or the greedy step took it ('greedy').

    Until nothing changes: members that are a cluster's only one are taken and
    their clusters met; else members whose clusters another one also has, and
    more, go; else clusters that hold all of another cluster, and more, go.
    Then the member with most clusters is taken, of equals the smallest, again
    and again (``_greedy``: many at a time, with the same result). Null
    clusters and members are left out, so a cluster without members is met by
    none and ignored.
    """
    rows = materialize(memberships.select(F.col(cluster).alias("c"), F.col(member).alias("m")).where("c is not null and m is not null").distinct())
    taken = []
    while True:
        alone = materialize(rows.groupBy("c").agg(F.count("*").alias("n"), F.min("m").alias("m")).where("n = 1").select("m").distinct())
        if not alone.isEmpty():
            taken.append(alone.withColumn("by", F.lit("essential")))
            rows = _without(rows, rows.join(alone, "m", "left_semi"), "c")
            continue
        fewer, _ = _contained(rows, "m", "c")
        if not fewer.isEmpty():
            rows = _without(rows, fewer, "m")
            continue
        # what meets a cluster meets those that it lies within
        _, larger = _contained(rows, "c", "m")
        if larger.isEmpty():
            break
        rows = _without(rows, larger, "c")
    taken += [t.withColumn("by", F.lit("greedy")) for t in _greedy(rows)]
    out = taken[0] if taken else rows.select("m", F.lit("").alias("by")).limit(0)
    for t in taken[1:]:
        out = out.unionByName(t)
    return out.select(F.col("m").alias(member), "by")

