"""Fact table of conservation and divergence scores over node pairs.

Inputs are tables of any size: residues of leaves by position, states of inner
nodes by site with a probability for each residue of ``alphabet``, pairs of
nodes to compare, and a substitution matrix (a, b, value) as a parameter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

GAPS = ("-", ".")
#: The order of the residues in a state's probabilities.
ALPHABET = "ARNDCQEGHILKMFPSTWYV"


def is_gap(residue: Column) -> Column:
    return residue.isNull() | residue.isin(*GAPS)


def column_counts(closure: DataFrame, residues: DataFrame) -> DataFrame:
    """(node, position, residue, n) over a node's leaves, gaps left out, in
    upper case. ``closure``: (node, leaf); ``residues``: (leaf, position, residue)."""
    some = residues.where(~is_gap(F.col("residue"))).withColumn("residue", F.upper("residue"))
    return closure.join(some, "leaf").groupBy("node", "position", "residue").agg(F.count("*").alias("n"))


def recent_conservation(counts: DataFrame, matrix: DataFrame, shift: float = 4.0, scale: float = 15.0) -> DataFrame:
    """(node, position, rc, n): the mean matrix value over pairs of a column's
    residues, shifted and scaled into [0, 1]; 1 for a single residue.

    A column with counts c has the pair sum (sum c_i c_j B_ij - sum c_i B_ii) / 2,
    so residues are counted before they meet, and a batch of columns is one
    product with the matrix. A pair the matrix lacks counts 0. What travels is
    the matrix: the square of its letters."""
    b = matrix.select(F.upper("a").alias("a"), F.upper("b").alias("b"), F.col("value").cast("double").alias("value"))
    b = b.union(b.where("a <> b").select("b", "a", "value")).groupBy("a", "b").agg(F.min("value").alias("value")).collect()
    letters = sorted({r["a"] for r in b})
    place = {x: i for i, x in enumerate(letters)}
    square = np.zeros((len(letters), len(letters)))
    for r in b:
        square[place[r["a"]], place[r["b"]]] = r["value"]
    shared = counts.sparkSession.sparkContext.broadcast((place, square))

    @F.pandas_udf("double")
    def pair_sum(residues: pd.Series, numbers: pd.Series) -> pd.Series:
        place, square = shared.value
        row = np.repeat(np.arange(len(residues)), residues.map(len))
        if not len(row):
            return pd.Series(np.zeros(len(residues)))
        at = pd.Series(np.concatenate(residues.to_numpy())).map(place).to_numpy(float)
        n, known = np.concatenate(numbers.to_numpy()).astype(float), ~np.isnan(at)
        dense = np.zeros((len(residues), len(place)))
        np.add.at(dense, (row[known], at[known].astype(int)), n[known])
        return pd.Series(((dense @ square) * dense).sum(axis=1) - dense @ np.diag(square))

    # one row a column: its residues and counts, at most as many as the alphabet
    rows = counts.groupBy("node", "position").agg(F.collect_list("residue").alias("r"), F.collect_list("n").alias("k"), F.sum("n").alias("n"))
    rows = rows.withColumn("pairs", pair_sum("r", "k"))
    mean = F.col("pairs") / (F.col("n") * (F.col("n") - 1))
    rc = F.when(F.col("n") == 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean + shift) / scale)))
    return rows.select("node", "position", rc.alias("rc"), "n")


def posterior(probs: Column, residue: Column, alphabet: str = ALPHABET) -> Column:
    """The probability of a residue in a state; 0 for an unknown residue."""
    at = F.locate(F.upper(residue), F.lit(alphabet)) if isinstance(residue, str) else F.instr(F.lit(alphabet), F.upper(residue))
    return F.when((F.length(residue) == 1) & (at > 0), F.coalesce(F.try_element_at(probs, at), F.lit(0.0))).otherwise(0.0)


def agreement(a: Column, b: Column) -> Column:
    """1 if both are the same residue (in any case) and no gap, else -1."""
    return F.when(~is_gap(a) & ~is_gap(b) & (F.upper(a) == F.upper(b)), 1).otherwise(-1)


def require_states(pairs: DataFrame, states: DataFrame) -> None:
    """An error that names up to five nodes of ``pairs`` without states."""
    wanted = pairs.select(F.explode(F.array("left", "right")).alias("node")).distinct()
    gone = [r["node"] for r in wanted.join(states.select("node").distinct(), "node", "left_anti").orderBy("node").limit(5).collect()]
    if gone:
        raise ValueError(f"no states for {', '.join(map(str, gone))}")


def score_pairs(pairs: DataFrame, states: DataFrame, rc: DataFrame, alphabet: str = ALPHABET, digits: int | None = 4) -> DataFrame:
    """The fact table: for each pair of nodes (left, right, more columns) and
    position aa, rc, ac, p_ac and score of both sides.

    ``states``: (node, position, state, probs). With agreement, p_ac of a side
    is its probability of its sister's residue at the sister ... that is, the
    sister's probability of the sister's own residue; without, one minus the
    sister's probability of this side's residue. score = rc - ac * p_ac.
    Positions where a state is a gap or missing have no row; a node without a
    column (no residues) has rc 0. ``digits`` rounds, None leaves as is.
    """
    require_states(pairs, states)
    side = lambda x: states.select(F.col("node").alias(x), "position", F.col("state").alias(f"aa_{x}"), F.col("probs").alias(f"_p_{x}"))
    both = pairs.join(side("left"), "left").join(side("right"), ["right", "position"])
    both = both.where(~is_gap(F.col("aa_left")) & ~is_gap(F.col("aa_right")))
    for x in ("left", "right"):
        both = both.join(rc.select(F.col("node").alias(x), "position", F.col("rc").alias(f"rc_{x}")), [x, "position"], "left").na.fill(0.0, [f"rc_{x}"])
    both = both.withColumn("ac", agreement(F.col("aa_left"), F.col("aa_right")))
    for x, y in (("left", "right"), ("right", "left")):
        same, other = posterior(F.col(f"_p_{y}"), F.col(f"aa_{y}"), alphabet), posterior(F.col(f"_p_{y}"), F.col(f"aa_{x}"), alphabet)
        both = both.withColumn(f"p_ac_{x}", F.when(F.col("ac") == 1, same).otherwise(1 - other))
    for x in ("left", "right"):
        both = both.withColumn(f"score_{x}", F.col(f"rc_{x}") - F.col("ac") * F.col(f"p_ac_{x}"))
    out = both.drop("_p_left", "_p_right")
    if digits is not None:
        out = out.withColumns({c: F.round(c, digits) for c in ("rc_left", "rc_right", "p_ac_left", "p_ac_right", "score_left", "score_right")})
    return out


def rebuilt_sequences(states: DataFrame, n_sites: int) -> DataFrame:
    """(node, sequence) from (node, position, state); a missing site is X."""
    held = states.where(F.col("position").between(1, n_sites)).groupBy("node").agg(F.map_from_entries(F.collect_set(F.struct("position", "state"))).alias("m"))
    return held.select("node", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n_sites)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("X"))), "").alias("sequence"))


def legacy_scores(pairs: DataFrame, states: DataFrame, entropy_rc: DataFrame, matrix: DataFrame, alphabet: str = ALPHABET) -> DataFrame:
    """(left, right, position, score): rc * ac * p_ac of the older rule, with
    ac = max(0, -p1' B p2) and p_ac the product of the largest probabilities.
    Of ``matrix`` (a, b, value) the pairs of the alphabet count, at most its
    square; a pair that is there one way round only counts both ways."""
    pos = {c: i for i, c in enumerate(alphabet)}
    known = F.col("a").isin(*alphabet) & F.col("b").isin(*alphabet)
    some = matrix.select(F.upper("a").alias("a"), F.upper("b").alias("b"), F.col("value").cast("double").alias("value")).where(known)
    table = some.groupBy("a", "b").agg(F.min("value").alias("value"), F.max("value").alias("other")).collect()
    if any(r["value"] != r["other"] for r in table):
        raise ValueError("a pair of the matrix has several values")
    cells = {(r["a"], r["b"]): r["value"] for r in table}
    flat = [cells.get((a, b), cells.get((b, a), 0.0)) for a in pos for b in pos]
    side = lambda x: states.select(F.col("node").alias(x), "position", F.col("probs").alias(f"_{x}"))
    n = len(alphabet)
    table = F.array(*map(F.lit, flat))
    dot = F.aggregate(F.sequence(F.lit(0), F.lit(n * n - 1)), F.lit(0.0), lambda s, i: s + F.get("_left", F.floor(i / n).cast("int")) * F.get("_right", (i % n).cast("int")) * F.get(table, i))
    rows = pairs.join(side("left"), "left").join(side("right"), ["right", "position"])
    rows = rows.join(entropy_rc.select(F.col("node").alias("left"), "position", F.col("rc").alias("_a")), ["left", "position"]).join(entropy_rc.select(F.col("node").alias("right"), "position", F.col("rc").alias("_b")), ["right", "position"])
    return rows.select("left", "right", "position", (F.col("_a") * F.col("_b") * F.greatest(F.lit(0.0), -dot) * F.array_max("_left") * F.array_max("_right")).alias("score"))


def fact_table(nodes: DataFrame, closure: DataFrame, residues: DataFrame, states: DataFrame, split: DataFrame, deep: DataFrame, matrix: DataFrame, alphabet: str = ALPHABET) -> DataFrame:
    """From a tree to its fact table: the scored ones of ``split`` (with
    ``status``), conservation of both children's clades, states of both,
    scores, distance from the root rounded to six digits."""
    pairs = materialize(split.where("status = 'scored'").join(deep.select("node", F.round("distance", 6).alias("distance_from_root")), "node").select("node", "event", "left", "right", F.col("size_left").alias("clade_left"), F.col("size_right").alias("clade_right"), F.col("size_total").alias("clade_total"), "distance_from_root"))
    wanted = pairs.select(F.explode(F.array("left", "right")).alias("node")).distinct()
    need = states.join(wanted, "node", "left_semi")
    rc = recent_conservation(column_counts(closure.join(wanted, "node", "left_semi"), residues), matrix)
    return score_pairs(pairs, need, rc, alphabet)
