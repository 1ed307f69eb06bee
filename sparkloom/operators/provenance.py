"""Which run made each replicate, from what the runs have written down.

A merged run lists the files it was made of, so its replicates are looked up
where they came from, and so on down; each step is one join of all files of
all runs with the records. A route counts for a group of files only if it
covers them all, and what no route covers is an error: nothing is guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from . import ranks


def _number(file: Column) -> Column:
    """The number in rep_<digits>.<suffix>; null for other names."""
    digits = F.regexp_extract(file, r"^rep_(\d+)(\.[^.]*)?$", 1)
    return F.when(digits != "", digits).try_cast("long")


def _last(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A row for each of ``keys``: the last by ``place``, if there is such a
    column, else the greatest."""
    order = F.struct("place", *values) if "place" in rows.columns else F.struct(*values)
    return rows.groupBy(*keys).agg(F.max(order).alias("_")).select(*keys, *(F.col(f"_.{v}").alias(v) for v in values))


def _whole(rows: DataFrame, key: str, *needed: str) -> DataFrame:
    """``rows`` of the runs none of whose rows lacks one of ``needed``."""
    lacks = F.lit(False)
    for c in needed:
        lacks = lacks | F.col(c).isNull()
    return rows.join(rows.where(lacks).select(key).distinct(), key, "left_anti")


def invocations(files: DataFrame, merged: DataFrame, staged: DataFrame, progress: DataFrame, per_invocation: int | None = None, own_name: bool = False) -> DataFrame:
    """(run, file, label, route, source): for each of ``files`` (run, file) the
    invocation that made it, how that is known and of which run.

    Of each run the first that covers all its files asked for: ``merged``
    (run, merged_index, source_run, source_file), whose sources are resolved
    in the same way, run by run, their names put before the label; ``staged``
    (run, rep_id, invocation); ``progress`` (run, replicate, batch, perhaps
    place, of which the last holds). A run in whose ``merged`` or ``staged``
    any row lacks a value has none.

    A source without any has its name as label; with ``per_invocation``
    numbers of files are divided by it instead, and files without a number are
    an error. A run of ``files`` that stays without is an error, and so are
    merged runs that come back to themselves. Runs are paths, the last part is
    their name; ``own_name`` puts the run's own before its labels.
    """
    m = _last(_whole(merged, "run", "merged_index", "source_run", "source_file"), ["run", "merged_index"], ["source_run", "source_file"]).withColumnRenamed("merged_index", "_i")
    s = _last(_whole(staged, "run", "rep_id", "invocation"), ["run", "rep_id"], ["invocation"]).withColumnRenamed("rep_id", "_stem")
    p = _last(progress.where("replicate is not null and batch is not null"), ["run", "replicate"], ["batch"]).withColumnRenamed("replicate", "_i")
    m, s, p = (materialize(t) for t in (m, s, p))
    name = lambda run: F.substring_index(F.rtrim(run, F.lit("/")), "/", -1)
    distinct = files.select("run", "file").distinct()
    todo = materialize(distinct.select("run", "file", F.col("run").alias("_run"), F.col("file").alias("_file"), F.array("run").alias("_chain")))
    done = []
    while not todo.isEmpty():
        rows = todo.withColumns({"_i": _number(F.col("_file")), "_stem": F.regexp_replace("_file", r"(?<=.)\.[^.]*$", "")})
        for t, keys in ((m, ["_i"]), (s, ["_stem"]), (p, ["_i"])):
            rows = rows.join(t.withColumnRenamed("run", "_run"), ["_run", *keys], "left")
        rows = materialize(rows)
        known = rows.groupBy("_chain").agg(*(F.bool_and(F.col(c).isNotNull()).alias(a) for c, a in (("source_run", "_m"), ("invocation", "_s"), ("batch", "_p"), ("_i", "_n"))))
        rows = ranks.joined(rows, known, ["_chain"])
        route = F.when(F.col("_m"), "merged").when(F.col("_s"), "staged").when(F.col("_p"), "progress")
        if per_invocation is not None:
            route = route.when(F.col("_n"), "number")
        rows = materialize(rows.withColumn("route", route))
        nothing = F.col("route").isNull() & (F.lit(per_invocation is not None) | (F.size("_chain") == 1))
        open_ = rows.where(nothing).select("_run").distinct().limit(3).collect()
        if open_:
            raise ValueError(f"nothing says which invocation made the files of {', '.join(r['_run'] for r in open_)}")
        again = F.array_contains("_chain", F.col("source_run")) & F.col("_m")
        if not rows.where(again).isEmpty():
            raise ValueError("a merged run is a source of itself")
        here = F.when(F.col("route") == "staged", F.col("invocation").cast("string")).when(F.col("route") == "progress", F.col("batch").cast("string"))
        if per_invocation is not None:
            here = here.when(F.col("route") == "number", F.floor(F.col("_i") / per_invocation).cast("string"))
        path = F.transform("_chain" if own_name else F.slice("_chain", 2, 1_000_000), name)
        label = F.concat_ws(":", path, here)
        done.append(rows.where("route is null or route <> 'merged'").select("run", "file", label.alias("label"), F.coalesce("route", F.lit("name")).alias("route"), F.col("_run").alias("source")))
        todo = materialize(rows.where("route = 'merged'").select("run", "file", F.col("source_run").alias("_run"), F.col("source_file").alias("_file"), F.concat("_chain", F.array("source_run")).alias("_chain")))
    if not done:
        return distinct.select("run", "file", *(F.lit(None).cast("string").alias(c) for c in ("label", "route", "source")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def given(files: DataFrame, labels: DataFrame) -> DataFrame:
    """(file, label): labels (rep_file, invocation) that a table gives for each
    of ``files`` (file), by the last part of the path; rows of other files are
    passed over. A file without one, or with several, is an error."""
    base = lambda c: F.substring_index(c, "/", -1)
    book = labels.groupBy(base(F.col("rep_file")).alias("_name")).agg(F.min(F.col("invocation").cast("string")).alias("label"), F.max(F.col("invocation").cast("string")).alias("_other"))
    rows = materialize(files.select("file", base(F.col("file")).alias("_name")).join(book, "_name", "left"))
    bad = rows.where("label is null or label <> _other").select("_name").distinct()
    some = [r["_name"] for r in bad.orderBy("_name").limit(5).collect()]
    if some:
        raise ValueError(f"{bad.count()} files have no label of their own, such as {', '.join(some)}")
    return rows.select("file", "label")
