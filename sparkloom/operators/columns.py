"""Columns of an alignment: the characters that whole texts hold at each place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


#: Distinct characters at places that a task counts before it hands rows on.
HELD = 2_000_000


def residue_counts(texts: DataFrame, by: str, text: str, residue: Column | None = None) -> DataFrame:
    """(by, position, residue, n): how many texts of a group hold a character
    at a place, from 1. Characters are counted batch by batch before they are
    shuffled, so no row is made for a character of a text, and what is shuffled
    grows with the longest text, not with the number of texts. Null and empty
    texts hold none; a null group is one of its own. ``residue`` maps the
    characters that were counted (column ``residue``), null ones are left out."""
    kind = texts.schema[by].dataType.simpleString()
    rows = texts.where(F.length(text) > 0).select(F.col(by), F.col(text).cast("binary").alias("_text"))
    some = rows.mapInArrow(_counted, f"`{by}` {kind}, position int, residue string, n long")
    if residue is not None:
        some = some.select(by, "position", residue.alias("residue"), "n").where("residue is not null")
    return some.groupBy(by, "position", "residue").agg(F.sum("n").alias("n"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (group, place, character), of one task's texts. A group, a
    place and a code point are one number; sorted runs of numbers are counted
    and merged, and handed on once more than ``HELD`` are there."""
    groups: dict = {}
    keys, counts, names, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], []

    def merged() -> None:
        nonlocal keys, counts
        at = np.concatenate([keys, *(k for k, _ in waiting)])
        n = np.concatenate([counts, *(c for _, c in waiting)])
        waiting.clear()
        order = np.argsort(at, kind="stable")
        at, n = at[order], n[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        keys, counts = at[first], np.add.reduceat(n, first) if len(first) else n

    def rows() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 200_000):
            k = keys[i : i + 200_000]
            codes, inverse = np.unique(k & 0x1FFFFF, return_inverse=True)
            letters = pa.array([chr(c) for c in codes.tolist()], pa.string()).take(pa.array(inverse))
            own = pa.array(names, kind).take(pa.array(k >> 52))
            yield pa.RecordBatch.from_arrays([own, pa.array(((k >> 21) & 0x7FFFFFFF).astype(np.int32)), letters, pa.array(counts[i : i + 200_000])], schema=schema)

    kind, schema = None, None
    for batch in batches:
        if schema is None:
            kind = batch.schema.field(0).type
            schema = pa.schema([(batch.schema.field(0).name, kind), ("position", pa.int32()), ("residue", pa.string()), ("n", pa.int64())])
        part, size = [], 0
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if name not in groups:
                if len(names) == 1 << 11:
                    # no number is left for a new group
                    if size:
                        waiting.append(np.unique(np.concatenate(part), return_counts=True))
                        part, size = [], 0
                    merged()
                    yield from rows()
                    keys, counts, names = keys[:0], counts[:0], []
                    groups.clear()
                groups[name] = len(names)
                names.append(name)
            codes = np.frombuffer(text.as_py().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
            part.append((groups[name] << 52) | (np.arange(1, len(codes) + 1, dtype=np.int64) << 21) | codes)
            size += len(codes)
            if size > HELD:
                waiting.append(np.unique(np.concatenate(part), return_counts=True))
                part, size = [], 0
        if size:
            waiting.append(np.unique(np.concatenate(part), return_counts=True))
        if sum(len(k) for k, _ in waiting) > HELD:
            merged()
            if len(keys) > HELD:
                yield from rows()
                keys, counts = keys[:0], counts[:0]
    if waiting:
        merged()
    if schema is not None:
        yield from rows()


#: What counts as a residue: a letter of any script, in either case.
LETTER = r"^\p{L}$"


def _letters(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("residue").rlike(LETTER))


def occupancy(counts: DataFrame, by: str) -> DataFrame:
    """(by, position, n, n_occupied, n_residues): texts that reach the place,
    those with a letter there, and distinct characters."""
    letter = F.when(F.col("residue").rlike(LETTER), F.col("n")).otherwise(0)
    return counts.groupBy(by, "position").agg(F.sum("n").alias("n"), F.sum(letter).alias("n_occupied"), F.count("*").alias("n_residues"))


def top_residue(counts: DataFrame, by: str) -> DataFrame:
    """(by, position, residue, n) of the commonest letter; of ties the first.
    A grouped minimum: no place's letters are sorted."""
    best = F.min(F.struct((-F.col("n")).alias("less"), "residue")).alias("best")
    return _letters(counts).groupBy(by, "position").agg(best).select(by, "position", "best.residue", (-F.col("best.less")).alias("n"))


def entropy(counts: DataFrame, by: str) -> DataFrame:
    """(by, position, entropy) in bits of the letters at a place: with total t
    of counts n, log2(t) - sum(n log2 n) / t, in one aggregation."""
    total = F.sum("n").cast("double")
    bits = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    return _letters(counts).groupBy(by, "position").agg((F.round(bits, 6) + 0.0).alias("entropy"))


def gap_occupancy(residues: DataFrame, position: str = "position", gaps: tuple[str, ...] = ("-", ".")) -> DataFrame:
    """(position, occupancy): the share of sequences without a gap at a place,
    of (sequence, position, residue) rows; a null residue is a gap."""
    full = F.when(F.col("residue").isNull() | F.col("residue").isin(*gaps), 0.0).otherwise(1.0)
    return residues.groupBy(position).agg(F.avg(full).alias("occupancy"))


def entropies(counts: DataFrame, by: list[str], alphabet: str) -> DataFrame:
    """(by, nats, bits, relative, top_share) of the residues of ``alphabet``:
    Shannon entropy in nats and bits, over its largest value, and the share of
    the commonest residue."""
    some = counts.where(F.instr(F.lit(alphabet), F.upper("residue")) > 0).groupBy(*by, F.upper("residue").alias("r")).agg(F.sum("n").cast("double").alias("n"))
    t = F.sum("n")
    nats = F.ln(t) - F.sum(F.col("n") * F.ln("n")) / t
    return some.groupBy(*by).agg((nats + 0.0).alias("nats"), (nats / F.ln(F.lit(2.0))).alias("bits"), (nats / F.ln(F.lit(float(len(alphabet))))).alias("relative"), (F.max("n") / t).alias("top_share"))


def shrunk_frequencies(counts: DataFrame, reference: DataFrame, strength: float, least: int, position: str = "position") -> DataFrame:
    """(position, residue, frequency): (1 - strength) times a place's own
    shares plus strength times the reference (residue, frequency), adding up
    to 1; the reference alone where fewer than ``least`` residues stand."""
    own = counts.join(F.broadcast(reference.select("residue")), "residue", "left_semi")
    total = own.groupBy(position).agg(F.sum("n").alias("_t"))
    places = counts.select(position).distinct().join(total, position, "left").na.fill(0, ["_t"])
    grid = places.crossJoin(F.broadcast(reference)).join(own.select(position, "residue", "n"), [position, "residue"], "left").na.fill(0, ["n"])
    mixed = F.when(F.col("_t") >= least, (1 - strength) * F.col("n") / F.nullif(F.col("_t"), F.lit(0)) + strength * F.col("frequency")).otherwise(F.col("frequency"))
    mixed_rows = grid.select(position, "residue", mixed.alias("f"))
    whole = mixed_rows.groupBy(position).agg(F.sum("f").alias("_s"))
    return mixed_rows.join(whole, position).select(position, "residue", (F.col("f") / F.col("_s")).alias("frequency"))
