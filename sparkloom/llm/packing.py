"""Operator 3, best-fit packing.

The pieces' length histogram (at most ``capacity`` numbers, whatever the
input) gives a configuration linear program: how often to use each multiset
of lengths that fits a sequence. Multiplicative weights solve it, a knapsack
dynamic programme prices configurations, whole copies are placed round by
round; what rounding leaves, at most as many pieces as there are lengths, is
packed best fit. Spark then deals every piece, by its rank within its length,
to a place in the plan.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from . import kernel

CAPACITY = 1024
END_ID = 2
SPECIAL = "<|endoftext|>"
ROWS_PER_BUCKET, LEAST_BUCKETS = 200_000, 64


@cache
def encoder(vocabulary: str):
    """text -> ids of the byte-level BPE vocabulary at ``vocabulary`` (json).

    The ranks beside it (.tiktoken) hold the same vocabulary for a faster
    encoder, equal in ids; texts with the special token's string, and those
    that the faster encoder gives up on (a million spaces in a row), go
    through the json file's own tokenizer.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import public_tokenizers

    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if SPECIAL in text:
            return slow.encode(text, add_special_tokens=False).ids
        try:
            return fast.encode_ordinary(text)
        except BaseException as e:
            # the encoder's panic is no Exception; anything else goes on
            if type(e).__name__ != "PanicException":
                raise
            return slow.encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first is shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every row of ``docs``.

    A null text is empty: one piece with the end id alone. Texts of any
    length are encoded whole; repeated rows each give their pieces; other
    columns are ignored, of whatever name; an empty table gives no piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in kernel.slices(batches, text):
            out: list[tuple[int, int, int, int, int]] = []
            for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                ids = np.array([*encode(t or ""), END_ID], "<u4")
                out += [(k, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[key, "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"`{key}` long, piece int, start long, length long, ids_crc32 long")


def priced(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: the best value for each capacity."""
    best = np.zeros(capacity + 1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            best[c] = max(best[c], float((best[c - lengths[:k]] + weights[:k]).max()))
    return best


def priced_configurations(weights: np.ndarray, lengths: np.ndarray, have: np.ndarray, budget: np.ndarray, capacity: int, slack: float) -> Iterator[tuple[dict[int, int], int]]:
    """Configurations (length number -> copies) whose value lies within the
    share ``slack`` of the best, with how many copies of each the budget
    allows; ``budget`` shrinks accordingly. Longest pieces first, and the
    longest that keep the value, so that short ones stay for later."""
    best = priced(weights, lengths, capacity)
    least = (1 - slack) * best[capacity]
    value = weights + best[capacity - lengths]
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for i in np.flatnonzero(value >= least)[::-1].tolist():
        while budget[i] > 0:
            used, c, spare = {i: 1}, capacity - int(lengths[i]), value[i] - least
            while k := fits[c]:
                v = weights[:k] + best[c - lengths[:k]]
                free = budget[:k] > 0
                for j, n in used.items():
                    if j < k:
                        free[j] = budget[j] > n
                good = np.flatnonzero(free & (v >= best[c] - spare))
                if not len(good):
                    break
                j = int(good[-1])
                spare -= best[c] - v[j]
                used[j] = used.get(j, 0) + 1
                c -= int(lengths[j])
            if sum(weights[j] * n for j, n in used.items()) < least - 1e-9:
                break
            copies = int(min(budget[j] // n for j, n in used.items()))
            for j, n in used.items():
                budget[j] -= n * copies
            yield used, copies


def rounds(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = 3, rate: float = 0.3, slack: float = 0.001, slow: float = 0.1) -> Iterator[tuple[Counter, Counter]]:
    """(configuration -> how often, lengths left over) before the first round
    and after each: the configuration program by multiplicative weights,
    rounded to whole sequences.

    A length's weight is its size times exp(-rate * share placed), so that
    lengths that lag behind gain weight; each round prices configurations by
    a knapsack dynamic programme over the weights and places whole copies of
    all within ``slack`` of the best, at most a ``steps``-th of what is left
    of a length. A round that places less than the share ``slow`` widens the
    slack. It ends once no more pieces are left than the histogram has
    lengths: rounds grow with the logarithm of the pieces, memory with the
    number of lengths, whatever the counts.
    """
    need = Counter({x: n for x, n in histogram.items() if n > 0})
    left, out = Counter(need), Counter()
    yield Counter(), Counter(need)
    while left.total() > len(need):
        lengths = np.array(sorted(left), np.int64)
        have = np.array([left[x] for x in lengths.tolist()], np.int64)
        share = 1 - have / np.array([need[x] for x in lengths.tolist()], float)
        weights = lengths * np.exp(-rate * (share - share.min()))
        budget = -(-have // steps)
        for used, copies in priced_configurations(weights, lengths, have, budget, capacity, slack):
            config = tuple(int(lengths[j]) for j, n in used.items() for _ in range(n))
            out[tuple(sorted(config, reverse=True))] += copies
            for j, n in used.items():
                left[int(lengths[j])] -= n * copies
        left = +left
        if have.sum() - left.total() < slow * have.sum():
            slack = min(1.0, slack * 1.4)
        yield Counter(out), Counter(left)


def programme(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[Counter, Counter]:
    """What the last of the rounds has placed and left."""
    *_, last = rounds(histogram, capacity)
    return last


def best_fit(left: Counter, capacity: int) -> Counter:
    """Best fit, longest first (length -> how many), over groups of equal
    sequences: work follows the different lengths and configurations, not
    the pieces."""
    room: list[int] = []
    open_at: dict[int, Counter] = {}

    def add(r: int, config: tuple[int, ...], n: int) -> None:
        if r not in open_at:
            insort(room, r)
            open_at[r] = Counter()
        open_at[r][config] += n

    for x, n in sorted(left.items(), reverse=True):
        while n > 0:
            i = bisect_left(room, x)
            if i < len(room):
                r = room[i]
                config, copies = next(iter(open_at[r].items()))
                k, used = min(n, copies), 1
                if k == copies:
                    del open_at[r][config]
                    if not open_at[r]:
                        del open_at[r], room[i]
                else:
                    open_at[r][config] -= k
            else:
                used = min(n, capacity // x)
                r, config, k = capacity, (), n // used
            add(r - used * x, (*config, *(x,) * used), k)
            n -= used * k
    return Counter({c: n for at in open_at.values() for c, n in at.items()})


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, how often) for exactly the pieces of the histogram:
    sequences of the program, and best fit for what its rounding leaves. How
    much that is follows from the pieces: of all rounds, the program stops
    after the one with which both together need fewest sequences."""
    best = None
    for out, left in rounds(histogram, capacity):
        whole = out + best_fit(left, capacity)
        if best is None or whole.total() <= best.total():
            best = whole
    return sorted(best.items())


def slots(configs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as arrays: for each (length, configuration) where its places
    begin among all places of the length, how many a sequence has, the first
    sequence, the first offset."""
    rows, seq = [], 0
    for config, n in configs:
        at = 0
        for x, k in sorted(Counter(config).items(), reverse=True):
            rows.append((x, n * k, k, seq, at))
            at += x * k
        seq += n
    rows.sort(key=lambda r: (r[0], r[3]))
    length, size, each, first, offset = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    base = np.zeros((int(length.max()) if len(length) else 0) + 2, np.int64)
    for x, b in zip(length[::-1].tolist(), begin[::-1].tolist(), strict=True):
        base[x] = b
    return {"begin": begin, "each": each, "first": first, "offset": offset, "base": base}


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """``cut_pieces`` with ``sequence_id`` and ``offset`` (gapless from 0).

    Works on the pieces' lengths alone. The driver sees the histogram, at
    most ``capacity`` numbers. A length that holds most pieces is split over
    hash buckets to rank its pieces. No piece is cut, dropped or moved. Ties
    between pieces of one length go by key, then piece; an empty table gives
    an empty one.
    """
    spark = cut_pieces.sparkSession
    rows = materialize(cut_pieces)
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    buckets = LEAST_BUCKETS + total // ROWS_PER_BUCKET
    places = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    counts = rows.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_n").na.fill(0, ["_before"])
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(key, "piece", "start")) - 1).join(before, ["length", "_bucket"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            at = p["base"][length] + batch.column("_at").to_numpy()
            i = np.searchsorted(p["begin"], at, side="right") - 1
            copy, j = np.divmod(at - p["begin"][i], p["each"][i])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p["first"][i] + copy), pa.array(p["offset"][i] + j * length)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    out = ranked.select(*cut_pieces.columns, (F.col("_before") + F.col("_rank")).alias("_at"))
    return out.mapInArrow(deal, kernel.extended(cut_pieces.schema, sequence_id="long", offset="long"))
