"""Property shifts between residues, motif scans, weight matrices of motifs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

# Kyte-Doolittle hydropathy, net charge, volume in cubic angstrom.
HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
CHARGE = {"D": -1.0, "E": -1.0, "H": 1.0, "K": 1.0, "R": 1.0}
VOLUME = {"A": 88.6, "C": 108.5, "D": 111.1, "E": 138.4, "F": 189.9, "G": 60.1, "H": 153.2, "I": 166.7, "K": 168.6, "L": 166.7, "M": 162.9, "N": 114.1, "P": 112.7, "Q": 143.8, "R": 173.4, "S": 89.0, "T": 116.1, "V": 140.0, "W": 227.8, "Y": 193.6}
# Grantham's composition, polarity and volume, and the weights of
# their squared differences.
GRANTHAM = {"A": (0.0, 8.1, 31.0), "C": (2.75, 5.5, 55.0), "D": (1.38, 13.0, 54.0), "E": (0.92, 12.3, 83.0), "F": (0.0, 5.2, 132.0), "G": (0.74, 9.0, 3.0), "H": (0.58, 10.4, 96.0), "I": (0.0, 5.2, 111.0), "K": (0.33, 11.3, 119.0), "L": (0.0, 4.9, 111.0), "M": (0.0, 5.7, 105.0), "N": (1.33, 11.6, 56.0), "P": (0.39, 8.0, 32.5), "Q": (0.89, 10.5, 85.0), "R": (0.65, 10.5, 124.0), "S": (1.42, 9.2, 32.0), "T": (0.71, 8.6, 61.0), "V": (0.0, 5.9, 84.0), "W": (0.13, 5.4, 170.0), "Y": (0.2, 6.2, 136.0)}
GRANTHAM_WEIGHTS, GRANTHAM_SCALE = (1.833, 0.1018, 0.000399), 50.723
# Bases that each letter of a consensus allows, and the letters
# that a scan takes for any base.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "W": "AT", "S": "CG", "M": "AC", "K": "GT", "R": "AG", "Y": "CT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
BASES, WILD = "ACGT", "NWSYRK"


def _scale(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def property_shift(ancestral: Column, target: Column, scale: dict[str, float]) -> Column:
    """Target minus ancestral; letters of either case, 0 for unknown ones,
    null if either residue is null."""
    value = lambda c: F.coalesce(F.try_element_at(_scale(scale), F.upper(c)), F.lit(0.0))
    return F.when(ancestral.isNotNull() & target.isNotNull(), value(target) - value(ancestral))


def grantham_distance(ancestral: Column, target: Column, table: dict[tuple[str, str], float] | None = None) -> Column:
    """Distance of two residues; 0 for equal or unknown ones, null if either
    is null. By ``table`` (pair -> distance, either way round), as printed
    tables differ from each other and from the formula; without one by
    Grantham's formula, rounded."""
    if table is not None:
        both = {a + b: float(v) for (x, y), v in table.items() for a, b in ((y.upper(), x.upper()), (x.upper(), y.upper()))}
        at = F.coalesce(F.try_element_at(_scale(both), F.upper(F.concat(ancestral, target))), F.lit(0.0))
        return F.when(ancestral.isNotNull() & target.isNotNull(), F.when(F.upper(ancestral) == F.upper(target), 0.0).otherwise(at))
    total = F.lit(0.0)
    for i, w in enumerate(GRANTHAM_WEIGHTS):
        at = lambda c: F.try_element_at(_scale({k: v[i] for k, v in GRANTHAM.items()}), F.upper(c))  # noqa: E731, B023
        total = total + F.lit(w) * F.pow(at(ancestral) - at(target), F.lit(2.0))
    known = F.coalesce(F.round(F.sqrt(total) * GRANTHAM_SCALE), F.lit(0.0))
    return F.when(ancestral.isNotNull() & target.isNotNull(), known)


def annotate_shifts(df: DataFrame, ancestral: str, target: str, table: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """``df`` with ``distance`` (by ``table``, see ``grantham_distance``),
    ``charge_shift``, ``hydropathy_shift`` and ``volume_shift``; a projection,
    nothing is shuffled."""
    a, t = F.col(ancestral), F.col(target)
    shifts = {f"{name}_shift": property_shift(a, t, s) for name, s in (("charge", CHARGE), ("hydropathy", HYDROPATHY), ("volume", VOLUME))}
    return df.withColumns({"distance": grantham_distance(a, t, table), **shifts})


def motif_hits(df: DataFrame, sequence: str, motif: str, mismatches: int = 2, wild: str = WILD, bases: str = BASES) -> DataFrame:
    """Rows of ``df`` without ``sequence``, one per hit: ``hit_position`` (from
    0), ``hit_sequence``, ``mismatches``.

    Letters of ``wild`` in the motif match anything. Sequences that are null,
    shorter than the motif or hold other letters than ``bases`` have no hits.
    A sequence is split into letters once, so work is linear in its length.
    """
    keep = [c for c in df.columns if c != sequence]
    m = len(motif)
    rows = df.where(F.col(sequence).rlike(f"^[{bases}]*$") & (F.length(sequence) >= m))
    rows = rows.select(*keep, F.split(sequence, "").alias("_x")).withColumn("_x", F.filter("_x", lambda x: x != ""))

    def misses(p: Column) -> Column:
        out = F.lit(0)
        for i, letter in enumerate(motif):
            if letter not in wild:
                out = out + F.when(F.get("_x", p + i) == letter, 0).otherwise(1)
        return out

    places = F.transform(F.sequence(F.lit(0), F.size("_x") - m), lambda p: F.struct(p.alias("hit_position"), misses(p).alias("mismatches")))
    hits = F.filter(places, lambda h: h["mismatches"] <= mismatches)
    named = F.transform(hits, lambda h: F.struct(h["hit_position"].alias("hit_position"), F.array_join(F.slice("_x", h["hit_position"] + 1, m), "").alias("hit_sequence"), h["mismatches"].alias("mismatches")))
    return rows.select(*keep, F.explode(named).alias("_h")).select(*keep, "_h.*")


def weight_matrices(letters: DataFrame, motif: str = "motif", position: str = "position", letter: str = "letter", pseudocount: float = 0.1) -> DataFrame:
    """(motif, position, base, p) of consensus letters, one row each; an
    unknown letter gives equal shares."""
    allowed = F.coalesce(F.try_element_at(_scale(IUPAC), F.upper(letter)), F.lit(""))
    total = F.length(allowed) + (len(BASES) - F.length(allowed)) * F.lit(pseudocount)
    rows = letters.select(motif, position, allowed.alias("_allowed"), total.alias("_total"), F.explode(F.array(*map(F.lit, BASES))).alias("base"))
    return rows.select(motif, position, "base", (F.when(F.contains("_allowed", "base"), F.lit(1.0)).otherwise(F.lit(pseudocount)) / F.col("_total")).alias("p"))


def matrix_distances(matrices: DataFrame, motif: str = "motif", position: str = "position", epsilon: float = 1e-10) -> DataFrame:
    """(motif_a, motif_b, n, frobenius, divergence) of every two motifs over
    the positions both have: the norm of the difference and the symmetric
    divergence, each over n. Pairs of a catalogue are the result itself."""
    side = lambda s: matrices.select(F.col(motif).alias(f"motif_{s}"), F.col(position).alias("_at"), "base", F.col("p").alias(f"_{s}"))
    pairs = side("a").join(side("b"), ["_at", "base"]).where("motif_a < motif_b")
    a, b = F.col("_a") + epsilon, F.col("_b") + epsilon
    out = pairs.groupBy("motif_a", "motif_b").agg(F.countDistinct("_at").alias("n"), F.sum(F.pow(F.col("_a") - F.col("_b"), F.lit(2.0))).alias("_s"), F.sum((a - b) * (F.log(a) - F.log(b))).alias("_k"))
    return out.select("motif_a", "motif_b", "n", (F.sqrt("_s") / F.col("n")).alias("frobenius"), (F.col("_k") / 2 / F.col("n")).alias("divergence"))


#: Words of 64 bits in a set's signature.
WORDS = 4


def contained_classes(members: DataFrame, key: str, member: str) -> tuple[DataFrame, DataFrame]:
    """(inner, outer): classes of equal sets, the former inside the latter,
    and (class, key): the sets of each class, which bears its least key.

    Whatever holds a set holds its rarest member too, so only sets that share
    that one are candidates. Of these only pairs in whose signatures (a bit
    for each member's hash) the inner one's bits are all set leave the join;
    each of them is verified by counting. Rows with null do not count,
    repeated ones count once, equal sets hold neither.
    """
    rows = materialize(members.select(F.col(key).alias("_k"), F.col(member).alias("_m")).dropna().distinct())
    often = rows.groupBy("_m").agg(F.count("*").alias("_n"))
    bit = F.pmod(F.xxhash64(F.lit(3), "_m"), F.lit(64 * WORDS)).cast("int")
    words = [F.bit_or(F.when(F.floor(F.col("_bit") / 64) == i, F.expr("shiftleft(1L, _bit % 64)")).otherwise(F.lit(0).cast("long"))).alias(f"_w{i}") for i in range(WORDS)]
    digest = [F.bit_xor(F.xxhash64(F.lit(i), "_m")).alias(f"_d{i}") for i in (1, 2)]
    sets = materialize(rows.join(often, "_m").withColumn("_bit", bit).groupBy("_k").agg(F.count("*").alias("_size"), F.min(F.struct("_n", "_m"))["_m"].alias("_rare"), *digest, *words))
    same = ["_size", "_d1", "_d2"]
    classes = materialize(sets.groupBy(*same).agg(F.min("_k").alias("_class"), F.first("_rare").alias("_rare"), *(F.first(f"_w{i}").alias(f"_w{i}") for i in range(WORDS))))
    own = rows.join(classes.select(F.col("_class").alias("_k")), "_k", "left_semi")
    inner = classes.select(F.col("_class").alias("inner"), F.col("_size").alias("_least"), F.col("_rare").alias("_m"), *(F.col(f"_w{i}").alias(f"_v{i}") for i in range(WORDS)))
    outer = own.join(classes.withColumnRenamed("_class", "_k"), "_k").select(F.col("_k").alias("outer"), "_m", "_size", *(f"_w{i}" for i in range(WORDS)))
    a, b = inner.alias("a"), outer.alias("b")
    fits = (F.col("a._m") == F.col("b._m")) & (F.col("_size") > F.col("_least"))
    for i in range(WORDS):
        fits = fits & (F.col(f"_v{i}").bitwiseAND(F.col(f"_w{i}")) == F.col(f"_v{i}"))
    near = materialize(a.join(b, fits).select("inner", "outer", "_least"))
    wanted = near.join(own.withColumnRenamed("_k", "inner"), "inner")
    met = wanted.join(own.withColumnRenamed("_k", "outer"), ["outer", "_m"]).groupBy("inner", "outer", "_least").agg(F.count("*").alias("_met"))
    return met.where("_met = _least").select("inner", "outer"), sets.join(classes.select(*same, "_class"), same).select(F.col("_class").alias("class"), F.col("_k").alias("key"))


def contained_sets(members: DataFrame, key: str, member: str) -> DataFrame:
    """(inner, outer): sets that lie inside a larger one, every pair of them.
    Equal sets are compared once (see ``contained_classes``)."""
    pairs, sets = contained_classes(members, key, member)
    side = lambda s: sets.select(F.col("class").alias(s), F.col("key").alias(f"_{s}"))
    return pairs.join(side("inner"), "inner").join(side("outer"), "outer").select(F.col("_inner").alias("inner"), F.col("_outer").alias("outer"))
