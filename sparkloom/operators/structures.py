"""Alignment columns placed on the residues of structures.

Spark deals the pairs of a row and a chain; one task aligns one pair at a
time, in memory of its longer side times the root of the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

#: Scores of a match, a mismatch, a gap's first place and each further one.
MATCH, MISMATCH, OPEN, EXTEND = 2.0, -1.0, -5.0, -0.5

_IS_GAP, _DOWN, _DOWN_OPENS, _GAP_OPENS = 1, 2, 4, 8


def _row(best, down, letter, b, scores, along):
    """The next row of best scores, of those that end in a gap of ``b``, and
    each place's way back; a gap of ``a`` is a running maximum along the row."""
    match, mismatch, opens, extends = scores
    opened, longer = best + opens, down + extends
    down = np.maximum(opened, longer)
    met = np.empty_like(best)
    met[0] = -np.inf
    met[1:] = best[:-1] + np.where(b == letter, match, mismatch)
    ways = np.where(down > met, _DOWN, 0) | np.where(opened >= longer, _DOWN_OPENS, 0)
    best = np.maximum(met, down)
    level = best - along
    top = np.maximum.accumulate(level)
    gap = np.full_like(best, -np.inf)
    gap[1:] = top[:-1] + along[:-1] + opens
    ways[1:] |= np.where(level[:-1] == top[:-1], _GAP_OPENS, 0)
    ways |= np.where(gap > best, _IS_GAP, 0)
    return np.maximum(best, gap), down, ways.astype(np.uint8)


def align(a: str, b: str, scores: tuple[float, float, float, float] = (MATCH, MISMATCH, OPEN, EXTEND)) -> tuple[float, list[tuple[int, int, int]]]:
    """The best global score and the blocks (start in a, in b, length) of an
    alignment that has it. Of equal ones, read from the ends, a pair goes
    before a gap and a gap of ``b`` before one of ``a``. Only every so many
    rows are kept; the ways between two of them are found again going back."""
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    along = scores[3] * np.arange(len(y) + 1)
    best = np.where(np.arange(len(y) + 1) > 0, scores[2] + along - scores[3], 0.0)
    down = np.full(len(y) + 1, -np.inf)
    step = max(1, isqrt(16 * len(x)))
    kept = []
    for i, letter in enumerate(x):
        if i % step == 0:
            kept.append((best, down))
        best, down, _ = _row(best, down, letter, y, scores, along)
    score, blocks = float(best[-1]), []
    i, j, state = len(x), len(y), "any"
    while kept and i and j:
        best, down = kept.pop()
        first, ways = len(kept) * step, []
        for letter in x[first:i]:
            best, down, w = _row(best, down, letter, y, scores, along)
            ways.append(w)
        while i > first and j:
            w = ways[i - first - 1][j]
            if state == "gap" or (state == "any" and w & _IS_GAP):
                state = "pair or down" if w & _GAP_OPENS else "gap"
                j -= 1
            elif state == "down" or w & _DOWN:
                state = "any" if w & _DOWN_OPENS else "down"
                i -= 1
            else:
                i, j, state = i - 1, j - 1, "any"
                if blocks and blocks[-1][0] == i + 1 and blocks[-1][1] == j + 1:
                    blocks[-1] = (i, j, blocks[-1][2] + 1)
                else:
                    blocks.append((i, j, 1))
    return score, blocks[::-1]


def aligned(pairs: DataFrame, a: str = "a", b: str = "b", scores: tuple[float, float, float, float] = (MATCH, MISMATCH, OPEN, EXTEND)) -> DataFrame:
    """``pairs`` with ``score`` and ``blocks`` of the texts in ``a`` and ``b``;
    a null text is empty. A row is as heavy as both lengths multiplied, rows
    with the same two texts are aligned once."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [align(p or "", q or "", scores) for p, q in zip(part["_a"], part["_b"], strict=True)]
            yield part.assign(score=[s for s, _ in found], blocks=[[dict(zip(("a", "b", "n"), x)) for x in z] for _, z in found])

    # equal pairs of texts are aligned once; other columns stay where they are
    keyed = materialize(pairs.withColumns({"_a": F.coalesce(a, F.lit("")), "_b": F.coalesce(b, F.lit(""))}))
    two = keyed.select("_a", "_b").distinct()
    got = materialize(two.mapInPandas(work, "_a string, _b string, score double, blocks array<struct<a: int, b: int, n: int>>"))
    return keyed.join(got, ["_a", "_b"]).select(*(c for c in pairs.columns), "score", "blocks")


def representative(records: DataFrame, chain: str, accessions: list[str] | None = None, least: float = 0.4, place: str = "place") -> DataFrame:
    """The one of ``records`` (id, sequence, place) that stands for a chain's
    residues: of those whose id holds one of ``accessions`` the one with the
    fewest gaps; without any, the one with most places equal to the chain's,
    counted from the start without gaps, as a share of the longer, if that is
    above ``least``; else that with the fewest gaps. Of ties the first."""
    plain = F.regexp_replace("sequence", "-", "")
    letters = F.zip_with(F.split(plain, ""), F.split(F.lit(chain), ""), lambda x, y: x.eqNullSafe(y))
    longer = F.greatest(F.length(plain), F.lit(len(chain)))
    alike = F.when((F.length(plain) > 0) & F.lit(chain != ""), F.size(F.filter(letters, lambda x: x)) / longer).otherwise(0.0)
    named = F.lit(False)
    for x in accessions or []:
        named = named | F.contains("id", F.lit(x))
    gaps = F.length("sequence") - F.length(plain)
    rows = records.withColumns({"_named": named, "_gaps": gaps, "_alike": F.when(alike > least, alike)})
    # named ones first, then the likest, then the fewest gaps
    best = F.struct((~F.col("_named")).alias("a"), F.when(F.col("_named"), F.col("_gaps")).alias("b"), F.coalesce(F.when(~F.col("_named"), -F.col("_alike")), F.lit(1.0)).alias("c"), F.when(F.col("_alike").isNull(), F.col("_gaps")).alias("d"), F.col(place).alias("e"))
    return rows.groupBy().agg(F.min_by(F.struct(*records.columns), best).alias("r")).where("r is not null").select("r.*")


def column_residues(rows: DataFrame, chains: DataFrame, scores: tuple[float, float, float, float] = (MATCH, MISMATCH, OPEN, EXTEND)) -> DataFrame:
    """(structure, chain, column, letter, number, residue): which residue of
    each chain each column of a row stands on, columns from 1. ``rows``
    (structure, sequence with '-' at gaps), ``chains`` (structure, chain, ord,
    residue, number), residues as single letters. Gap columns, and letters
    that the best alignment leaves alone, have none."""
    texts = chains.groupBy("structure", "chain").agg(F.array_sort(F.collect_list(F.struct("ord", "residue", "number"))).alias("_residues"))
    texts = texts.withColumn("_b", F.array_join(F.transform("_residues", lambda r: r["residue"]), ""))
    letters = F.filter(F.transform(F.split("sequence", ""), lambda c, i: F.struct((i + 1).alias("column"), c.alias("letter"))), lambda x: (x["letter"] != "-") & (x["letter"] != ""))
    own = rows.select("structure", letters.alias("_letters"), F.regexp_replace("sequence", "-", "").alias("_a"))
    met = aligned(own.join(texts, "structure"), "_a", "_b", scores)
    one = met.select("structure", "chain", "_letters", "_residues", F.explode("blocks").alias("k"))
    one = one.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k.n") - 1)))
    x, y = F.get("_letters", F.col("k.a") + F.col("o")), F.get("_residues", F.col("k.b") + F.col("o"))
    return one.select("structure", "chain", x["column"].alias("column"), x["letter"].alias("letter"), y["number"].alias("number"), y["residue"].alias("residue"))
