"""Operator 1, n-gram Jaccard join: parity sketches.

Each document is the set of its word shingles. Per size band every shingle
flips one bit of a sketch, cut into segments of 2**32 bits; the Hamming
distance of two sketches never exceeds the symmetric difference of their
sets. Sets that are similar enough differ in at most d elements, so of more
than d segments some are equal: an equi-join on segments finds every pair.
A segment has few bits set, so it is held as the XOR of the hashes of their
places. Shingle sets are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import kernel
from .components import components

BAND = 1.3
#: Keys that a task gathers before it writes them, and about how many a bucket of the shuffle holds.
BLOCK_KEYS, BUCKET_KEYS, LEAST_BUCKETS = 300_000, 500_000, 64
#: Sketches that a task compares, in one or several groups.
GROUP_SETS = 10_000
#: Sets and shingles of a block whose links are counted in one task; distinct shingles taken at once.
COUNT_SETS, COUNT_SHINGLES, COUNT_COLUMNS = 1024, 1_000_000, 1 << 14


def shingles(docs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each distinct shingle, sorted. ASCII letters are
    lower-cased; fewer than k words are one shingle of them all."""
    t = kernel.Texts([x.lower() for x in docs])
    words = t.word_hashes()
    at = t.gram_starts(k)
    doc, h = [t.doc[at]], [kernel.grams(words, at, k)]
    for n in range(1, k):
        short = np.flatnonzero(t.count == n)
        doc.append(short)
        h.append(kernel.mix(kernel.grams(words, t.offset[short], n) + np.uint64(n)))
    return kernel.distinct_per_doc(np.concatenate(doc), np.concatenate(h))


def prints(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes and two 64-bit fingerprints; equal sets have equal ones."""
    size = np.bincount(doc, minlength=n_docs)
    cut = np.append(0, np.cumsum(size))
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(kernel.mix(h ^ np.uint64(salt)), out=total[1:])
        out.append(kernel.mix(total[cut[1:]] - total[cut[:-1]] + np.uint64(salt)))
    return size, *out


@cache
def bands(most: int) -> np.ndarray:
    """Lower ends of the size bands up to ``most``, and two beyond."""
    lows = [1]
    while lows[-1] <= most:
        lows.append(max(lows[-1] + 1, int(lows[-1] * BAND)))
    lows.append(max(lows[-1] + 1, int(lows[-1] * BAND)))
    lows.append(max(lows[-1] + 1, int(lows[-1] * BAND)))
    return np.array(lows, np.int64)


@cache
def spare(num: int, den: int) -> float:
    """Segments added to each of d + 1 so that empty ones can stay out: their
    expected share at a band's lower end, twice."""
    q = 0.0
    for _ in range(50):
        q = min(0.5, 2 * float(np.exp(-(den + num) / (2 * (den - num)) / BAND / (1 + q))) * (1 + q))
    return q


def segment_keys(doc: np.ndarray, h: np.ndarray, size: np.ndarray, num: int, den: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of every sketch segment to join on.

    Similarity num / den allows d = floor(2 hi (den - num) / (den + num))
    elements of difference for sets of at most hi; a level with d = 0 joins
    nothing but equal sets. A set near the top of its band enters the next
    band's level too.

    ``common`` (sorted hashes) are shingles that many documents share. Any
    part of the universe may be left out of all sets: the difference only
    shrinks. So a sketch is made without them, of d + 1 + e segments, of
    which e + 1 are equal at least; if one of the two sets leaves at most e
    segments empty, an equal one that is not empty joins them. Sets that
    leave more empty also emit the segments of a sketch with all shingles,
    and where that has many empty segments, these too.
    """
    if not len(doc):
        return doc, h
    lows = bands(1 << int(size.max()).bit_length())
    band = np.searchsorted(lows, size, side="right") - 1
    rare = np.ones(len(h), bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h
    out_doc, out_key = [], []
    for up in (0, 1):
        level = band + up
        hi = lows[level + 1] - 1
        d = 2 * hi * (den - num) // (den + num)
        here = (size > 0) & (d > 0)
        if up:
            here &= den * size >= num * lows[level]
        e = np.ceil(spare(num, den) * (d + 1)).astype(np.int64)
        for full in (False, True):
            m = np.where(here, d + 1 + e, 0)
            base = np.append(0, np.cumsum(m))
            on = here[doc] if full else here[doc] & rare
            who, x = doc[on], kernel.mix(h[on] + kernel.mix(level[doc[on]].astype(np.uint64) + np.uint64(77)))
            segment = base[who] + ((x >> np.uint64(32)) * m[who].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            sketch = np.zeros(base[-1], np.uint64)
            np.bitwise_xor.at(sketch, segment, kernel.mix(x & np.uint64(0xFFFFFFFF)))
            owner = np.repeat(np.arange(len(size)), m)
            empty = sketch == 0
            poor = np.bincount(owner[empty], minlength=len(size)) > e
            emit = ~empty | poor[owner] if full else ~empty
            place = (np.arange(base[-1]) - base[owner]).astype(np.uint64)
            tag = kernel.mix((level[owner].astype(np.uint64) << np.uint64(40)) + place * np.uint64(2) + np.uint64(full))
            out_doc.append(owner[emit])
            out_key.append(kernel.mix(sketch ^ tag)[emit])
            here = here & poor
    return np.concatenate(out_doc), np.concatenate(out_key)


def sketches(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A parity bit sketch of each set, of the next power of two of four times
    its size in bits (64 at least), so that few differences cancel out; halves
    fold onto each other by XOR: a place's low six bits are the bit of its
    word at every width, the next ones the word."""
    bits = 64 << np.maximum(0, np.ceil(np.log2(np.maximum(4 * size, 1))).astype(np.int64) - 6)
    base = np.append(0, np.cumsum(bits >> 6))
    place = (kernel.mix(h + np.uint64(0x3C6EF372FE94F82B)) & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    words = np.zeros(base[-1], np.uint64)
    np.bitwise_xor.at(words, base[doc] + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    return [words[i:j].tobytes() for i, j in zip(base[:-1], base[1:], strict=True)]


def folded(sketch: bytes, words: int) -> np.ndarray:
    """A sketch folded to so many words."""
    x = np.frombuffer(sketch, np.uint64)
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)


def _common(docs: DataFrame, text: str, k: int, sample: int, least: int, most: int) -> np.ndarray:
    """Shingles that at least ``least`` of about ``sample`` documents hold, at
    most ``most``: which ones affects the work, never the result."""
    every = max(1, docs.count() // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, text):
            _, h = shingles(kernel.raw(batch.column(text)), k)
            x, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n)], names=["h", "n"])

    some = docs.where(F.pmod(F.xxhash64(text), F.lit(every)) == 0).select(text)
    found = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = found.orderBy(F.desc("n"), "h").limit(most).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy().astype(np.int64).view(np.uint64))


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _buckets(docs: DataFrame, text: str, k: int, num: int, den: int, n_buckets: int, common: np.ndarray) -> DataFrame:
    """(key, member, hub): sets, by fingerprint, that share a segment with
    another, and the smallest such. A task sends one set per key to the key's
    bucket; the others it has met under that key go, with that one as hub,
    wherever there is room, so no key gathers its sets in one task."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(common)
    names = ["bucket", "keys", "sets", "near_keys", "near", "near_hubs"]
    binary = [pa.int64(), *[pa.binary()] * 5]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, held = [], [], 0

        def flush() -> pa.RecordBatch:
            key, fp = np.concatenate(keys), np.concatenate(sets)
            keys.clear()
            sets.clear()
            order = np.lexsort((fp, key))
            key, fp = key[order], fp[order]
            new = np.append(True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]))
            key, fp = key[new], fp[new]
            first = np.append(True, key[1:] != key[:-1])
            hub = fp[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
            to = (key % np.uint64(n_buckets)).astype(np.int64)
            far = (kernel.mix(key ^ fp) % np.uint64(n_buckets)).astype(np.int64)
            parts = []
            for on, where in ((first, to), (~first, far)):
                o = np.flatnonzero(on)
                o = o[np.argsort(where[o], kind="stable")]
                parts.append((o, np.searchsorted(where[o], np.arange(n_buckets + 1))))
            (a, ca), (b, cb) = parts
            out = [(i, key[a[ca[i] : ca[i + 1]]].tobytes(), fp[a[ca[i] : ca[i + 1]]].tobytes(), key[b[cb[i] : cb[i + 1]]].tobytes(), fp[b[cb[i] : cb[i + 1]]].tobytes(), hub[b[cb[i] : cb[i + 1]]].tobytes()) for i in range(n_buckets) if ca[i] < ca[i + 1] or cb[i] < cb[i + 1]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), binary, strict=True)], names=names)

        for batch in kernel.slices(batches, text):
            raw = kernel.raw(batch.column(text))
            doc, h = shingles(raw, k)
            size, fp, _ = prints(doc, h, len(raw))
            owner, key = segment_keys(doc, h, size, num, den, known.value)
            keys.append(key)
            sets.append(fp[owner])
            held += len(key)
            if held >= BLOCK_KEYS:
                held = 0
                yield flush()
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        def joined(name: str) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint64)

        key, fp = joined("keys"), joined("sets")
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        first = np.append(True, key[1:] != key[:-1])[: len(key)]
        hub = fp[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))] if len(key) else fp
        on = fp != hub
        return pa.table({"key": _as_long(np.concatenate([key[on], joined("near_keys")])), "member": _as_long(np.concatenate([fp[on], joined("near")])), "hub": _as_long(np.concatenate([hub[on], joined("near_hubs")]))})

    packed = docs.select(text).mapInArrow(emit, "bucket long, keys binary, sets binary, near_keys binary, near binary, near_hubs binary")
    return packed.groupBy("bucket").applyInArrow(meet, "key long, member long, hub long")


def close_enough(na, nb, sa: bytes, sb: bytes, num: int, den: int) -> bool:
    """Whether sizes and sketches leave room for the similarity."""
    if den * min(na, nb) < num * max(na, nb):
        return False
    w = min(len(sa), len(sb)) // 8
    return int(np.bitwise_count(folded(sa, w) ^ folded(sb, w)).sum()) <= (na + nb) * (den - num) // (den + num)


def _sketch_filter(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs (a, b, na, nb, sa, sb) that sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            wa, wb = (pc.binary_length(batch.column(c)).to_numpy() // 8 for c in ("sa", "sb"))
            keep = den * np.minimum(na, nb) >= num * np.maximum(na, nb)
            # pairs of equal widths at once
            for a, b in sorted(set(zip(wa[keep].tolist(), wb[keep].tolist(), strict=True))):
                at = np.flatnonzero(keep & (wa == a) & (wb == b))
                sa, sb = (np.frombuffer(b"".join(batch.column(c).take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1, min(a, b)) for c in ("sa", "sb"))
                gap = np.bitwise_count(np.bitwise_xor.reduce(sa, axis=1) ^ np.bitwise_xor.reduce(sb, axis=1)).sum(axis=1)
                keep[at] = gap <= (na[at] + nb[at]) * (den - num) // (den + num)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int, text: str, key: str) -> DataFrame:
    """The pairs (a, b) of document ids whose shingle sets are similar."""
    pairs = materialize(pairs)
    ids = materialize(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct())
    cand = materialize(docs.select(F.col(key).alias("_id"), F.col(text).alias("_t")).join(ids, "_id", "left_semi"))
    both = pairs.join(cand.toDF("a", "ta"), "a").join(cand.toDF("b", "tb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(kernel.slices(batches, "ta"), "tb"):
            n = batch.num_rows
            doc, h = shingles(kernel.raw(batch.column("ta")) + kernel.raw(batch.column("tb")), k)
            size = np.bincount(doc, minlength=2 * n)
            _, later = kernel.repeats(doc % n, h)
            both = np.bincount(doc[later] % n, minlength=n)
            keep = den * both >= num * (size[:n] + size[n:] - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return materialize(both.mapInArrow(run, "a long, b long"))


def _with_sketches(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """(a, b, na, nb, sa, sb) of the pairs (member, hub) of fingerprints."""
    both = pairs.join(side.toDF("member", "a", "na", "sa"), "member")
    return both.join(side.toDF("hub", "b", "nb", "sb"), "hub")


def _labels(reps: DataFrame, comp: DataFrame) -> DataFrame:
    """``reps`` with ``comp``, the component so far; without one, the set itself."""
    known = comp.select(F.col("id").alias("rep"), F.col("component").alias("_c"))
    return reps.join(known, "rep", "left").withColumn("comp", F.coalesce("_c", "rep")).drop("_c")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of ``pairs`` whose member and hub are in different components."""
    member, hub = (label.select(F.col("fp").alias(c), F.col("comp").alias(f"{c}_comp")) for c in ("member", "hub"))
    return pairs.join(member, "member").join(hub, "hub").where("member_comp <> hub_comp").select(*pairs.columns)


def _rest(buckets: DataFrame, reps: DataFrame, comp: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Pairs (a, b) in different components that share a segment and pass the
    sketch filter. Buckets whose sets are one component by now need nothing
    more. Of the others, those with the same smallest set are taken as one,
    so that a sketch is sent there once, and all their sets meet, in blocks if
    they are many."""
    label = _labels(reps, comp)
    apart = _apart(buckets, label)
    open_keys = apart.select("key").distinct()
    rows = buckets.select("key", F.col("member").alias("fp")).union(buckets.select("key", "hub")).distinct()
    rows = rows.join(open_keys, "key", "left_semi")
    least = rows.groupBy("key").agg(F.min("fp").alias("least"))
    rows = materialize(rows.join(least, "key").select("least", "fp").distinct())
    size = rows.groupBy("least").agg(F.count("*").alias("_size")).where("_size > 2").withColumn("_blocks", F.ceil(F.col("_size") / block))
    size = materialize(size)
    n_groups = LEAST_BUCKETS + int(size.agg(F.sum(F.col("_size") * F.col("_blocks"))).first()[0] or 0) // GROUP_SETS
    rows = rows.join(size, "least").withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("_blocks")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    rows = rows.join(label, "fp").select("least", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"), (F.col("_own") <= F.col("_other")).alias("left"), "rep", "n", "sketch", "comp")

    def meet(table: pa.Table) -> pa.Table:
        order = [("least", "ascending"), ("x", "ascending"), ("y", "ascending"), ("n", "ascending"), ("rep", "ascending")]
        table = table.sort_by(order)
        key, x, y, left, rep, n, sketch, comp = (table.column(c).to_pylist() for c in table.column_names)
        n_, rep_, comp_, left_ = np.array(n), np.array(rep), np.array(comp), np.array(left, bool)
        out: set[tuple[int, int]] = set()
        at = 0
        while at < len(key):
            end = at
            while end < len(key) and (key[end], x[end], y[end]) == (key[at], x[at], y[at]):
                end += 1
            width = min(len(s) for s in sketch[at:end]) // 8
            bits = np.stack([folded(s, width) for s in sketch[at:end]])
            lo = np.arange(at, end)
            for i in range(at, end):
                if x[i] != y[i] and not left[i]:
                    continue
                j = lo[i - at + 1 :] if x[i] == y[i] else lo[~left_[lo]]
                j = j[(comp_[j] != comp_[i]) & (den * np.minimum(n_[j], n_[i]) >= num * np.maximum(n_[j], n_[i]))]
                if len(j):
                    gap = np.bitwise_count(bits[j - at] ^ bits[i - at]).sum(axis=1)
                    for r in rep_[j[gap <= (n_[j] + n_[i]) * (den - num) // (den + num)]].tolist():
                        out.add((max(r, rep[i]), min(r, rep[i])))
            at = end
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    groups = F.pmod(F.xxhash64("least", "x", "y"), F.lit(n_groups)).alias("_group")
    return rows.groupBy(groups).applyInArrow(meet, "a long, b long").distinct()


def link_counts(sets: list[np.ndarray], left: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many of the other sets (distinct hashes each) each one links with;
    if any is not ``left``, only pairs of one ``left`` and one that isn't."""
    size = np.array([len(x) for x in sets])
    who = np.repeat(np.arange(len(sets)), size)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # a shingle that one set holds adds to no intersection
    place = np.cumsum(held > 1) - 1
    on = held[column] > 1
    who, column = who[on], place[column[on]]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    a, b = (np.flatnonzero(left), np.flatnonzero(~left)) if not left.all() else (np.arange(len(sets)),) * 2
    both = np.zeros((len(a), len(b)), np.int64)
    n = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, n, COUNT_COLUMNS):
        i, j = np.searchsorted(column, (lo, lo + COUNT_COLUMNS))
        dense = np.zeros((len(sets), -(-min(COUNT_COLUMNS, n - lo) // 64) * 64), bool)
        dense[who[i:j], column[i:j] - lo] = True
        bits = np.packbits(dense, axis=1).view(np.uint64)
        other = bits[b]
        for row, x in enumerate(a):
            both[row] += np.bitwise_count(other & bits[x]).sum(axis=1, dtype=np.int64)
    linked = den * both >= num * (size[a][:, None] + size[b][None, :] - both)
    out = np.zeros(len(sets), np.int64)
    if left.all():
        np.fill_diagonal(linked, False)
        return linked.sum(axis=1)
    out[a], out[b] = linked.sum(axis=1), linked.sum(axis=0)
    return out


def _degrees(docs: DataFrame, reps: DataFrame, comp: DataFrame, k: int, num: int, den: int, text: str, key: str) -> DataFrame:
    """(fp, fp2, n, n_links): all links of each class. Linked classes are in
    one component, so all pairs of a component are compared exactly, in
    blocks if they are many; a block gives each of its sets one row."""
    label = _labels(reps.select("fp", "fp2", "n", "rep"), comp)
    many = label.groupBy("comp").agg(F.count("*").alias("_sets"), F.sum("n").alias("_shingles")).where("_sets > 1")
    many = many.withColumn("_blocks", F.ceil(F.greatest(F.col("_sets") / COUNT_SETS, F.col("_shingles") / COUNT_SHINGLES)))
    many = materialize(many)
    n_groups = LEAST_BUCKETS + int(many.agg(F.sum(F.col("_shingles") * F.col("_blocks"))).first()[0] or 0) // COUNT_SHINGLES
    wanted = label.join(many, "comp").select("fp", "fp2", "n", "rep", "comp", "_blocks")
    some = docs.withColumn(key, F.col(key).cast("long")).join(wanted.select(F.col("rep").alias(key)).distinct(), key, "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, text):
            doc, h = shingles(kernel.raw(batch.column(text)), k)
            size, fp, fp2 = prints(doc, h, batch.num_rows)
            cut = np.append(0, np.cumsum(size))
            held = [h[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(size), _as_long(fp), _as_long(fp2), pa.array(held, pa.binary())], names=["rep", "n", "fp", "fp2", "h"])

    held = some.select(key, text).mapInArrow(run, "rep long, n long, fp long, fp2 long, h binary")
    rows = held.join(wanted, ["rep", "n", "fp", "fp2"]).withColumn("_own", F.pmod(F.xxhash64("fp", "fp2"), F.col("_blocks")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    rows = rows.select("comp", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"), (F.col("_own") <= F.col("_other")).alias("left"), "fp", "fp2", "n", "h")

    def count(table: pa.Table) -> pa.Table:
        order = ["comp", "x", "y", "fp", "fp2", "n"]
        table = table.sort_by([(c, "ascending") for c in order])
        ids = [table.column(c).to_numpy() for c in order]
        # rows of one document repeat their set
        new = np.append(True, np.any([x[1:] != x[:-1] for x in ids], axis=0))
        ids, left, h = [x[new] for x in ids], table.column("left").to_numpy()[new], table.column("h").filter(pa.array(new))
        cut = np.append(np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in ids[:3]], axis=0))), len(left))
        links = [np.zeros(0, np.int64)]
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            x = ids[1][i] != ids[2][i]
            if x and (left[i:j].all() or not left[i:j].any()):
                links.append(np.zeros(j - i, np.int64))
                continue
            sets = [np.frombuffer(v, np.uint64) for v in h.slice(i, j - i).to_pylist()]
            links.append(link_counts(sets, left[i:j], num, den))
        return pa.table({"fp": ids[3], "fp2": ids[4], "n": ids[5], "n_links": np.concatenate(links)})

    groups = F.pmod(F.xxhash64("comp", "x", "y"), F.lit(n_groups)).alias("_group")
    parts = rows.groupBy(groups).applyInArrow(count, "fp long, fp2 long, n long, n_links long")
    return parts.groupBy("fp", "fp2", "n").agg(F.sum("n_links").alias("n_links"))


def similar_classes(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, text: str = "text", key: str = "doc_id", block: int = 4096, sample: int = 20_000, least: int = 4, most: int = 100_000, count_links: bool = True) -> DataFrame:
    """(key, n_shingles, component_id, class_id, n_links), a row for each of
    ``docs``; n_links only if ``count_links``.

    Documents link when den * |intersection| >= num * |union| of their sets of
    distinct k-word shingles; class_id is the smallest key with the same set,
    component_id the smallest reachable by links, n_links the number of other
    classes that link with it, all counted. Null or empty texts have no
    shingle and link with nothing; so every key stands for itself there.
    Repeated rows each get a row; other columns are ignored; an empty table
    gives an empty one. For components, sets that are joined already are not
    compared again, all others are: first each set with
    the hub that it shares most segments with, then with its other hubs in
    other components, then the sets of buckets that are not one component yet.
    """
    docs = docs.select(key, text)
    common = _common(docs, text, k, sample, least, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, text):
            doc, h = shingles(kernel.raw(batch.column(text)), k)
            size, fp, fp2 = prints(doc, h, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(size), _as_long(fp), _as_long(fp2), pa.array(sketches(doc, h, size), pa.binary())], names=[key, "n", "fp", "fp2", "sketch"])

    sets = materialize(docs.withColumn(key, F.col(key).cast("long")).mapInArrow(run, f"`{key}` long, n long, fp long, fp2 long, sketch binary"))
    full = sets.where("n > 0")
    reps = materialize(full.groupBy("fp", "fp2", "n").agg(F.min(key).alias("rep"), F.first("sketch").alias("sketch")))
    total = sets.agg(F.sum("n")).first()[0] or 0
    n_buckets = LEAST_BUCKETS + int(total * 2 * (den - num) / (den + num)) // BUCKET_KEYS
    buckets = materialize(_buckets(docs, text, k, num, den, n_buckets, common))
    side = reps.select("fp", "rep", "n", "sketch")
    pairs = materialize(buckets.groupBy("member", "hub").agg(F.count("*").alias("shared")))
    nearest = pairs.groupBy("member").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub"))
    links = verified(_sketch_filter(_with_sketches(nearest, side), num, den), docs, k, num, den, text, key)
    apart = _apart(pairs.select("member", "hub"), _labels(side.drop("sketch"), components(links)))
    links = links.union(verified(_sketch_filter(_with_sketches(apart, side), num, den), docs, k, num, den, text, key))
    comp = components(links)
    more = verified(_rest(buckets, side, comp, num, den, block), docs, k, num, den, text, key)
    if not more.isEmpty():
        links = links.union(more)
        comp = components(links)
    names = ["fp", "fp2", "n"]
    classes = reps.select(*names, "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    out = sets.drop("sketch").join(classes, names, "left")
    known = [key, F.col("n").alias("n_shingles"), F.coalesce("component", "rep", key).alias("component_id"), F.coalesce("rep", key).alias("class_id")]
    if not count_links:
        return out.select(*known)
    out = out.join(_degrees(docs, reps, comp, k, num, den, text, key), names, "left")
    return out.select(*known, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
