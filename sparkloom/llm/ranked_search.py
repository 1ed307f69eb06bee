"""Operator 11, ranked lexical search: hybrid TAAT-DAAT.

Documents become index segments: postings in order of document, bounded in
text, each built by the task that reads the text. A query meets a segment in
two steps. The lists of its rare terms are short: they are summed term at a
time into accumulators, whose k-th best score is a first threshold. Those
accumulators then take part as one more bounded list in a document-at-a-time
walk over the long lists, which passes over every block of documents whose
bounds add up to less than the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from . import kernel

#: Documents of a block, for which each long list keeps its largest contribution.
BLOCK = 64
#: Blocks that one step of the walk scores together.
STEP = 32
#: A query's shortest lists are summed first, while together they hold no more than this share of a segment's documents.
SHORT_SHARE = 0.25
#: Documents and bytes of text at which a segment is closed.
SEGMENT_DOCS, SEGMENT_BYTES = 1 << 16, 1 << 25
#: Bytes of item text that one pass over the documents searches for; more items make more passes.
ITEM_BYTES = 4_000_000

#: Stands for a null doc_id inside segments; sorts last.
_NO_ID = np.iinfo(np.int64).max
#: Bytes of terms: digits, letters (A-Z lower-cased) and all beyond ASCII.
_TERMS = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))

_SEGMENT = "n_docs long, n_terms long, ids binary, sizes binary, terms binary, starts binary, docs binary, tf binary"


def terms_of(docs: list[bytes]) -> tuple[kernel.Texts, np.ndarray]:
    """The terms of whole texts, and each one's hash."""
    t = kernel.Texts([x.translate(_TERMS) for x in docs])
    return t, t.word_hashes()


class _Builder:
    """Gathers the postings of some terms until a segment is full."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = wanted
        self.clear()

    def clear(self) -> None:
        self.ids, self.sizes, self.keys, self.tf, self.bytes, self.n = [], [], [], [], 0, 0

    def add(self, ids: np.ndarray, docs: list[bytes]) -> None:
        t, h = terms_of(docs)
        if len(self.wanted) and len(h):
            at = np.minimum(np.searchsorted(self.wanted, h), len(self.wanted) - 1)
            hit = np.flatnonzero(self.wanted[at] == h)
            key, tf = np.unique((at[hit].astype(np.int64) << 32) | (t.doc[hit] + self.n), return_counts=True)
            self.keys.append(key)
            self.tf.append(tf)
        self.ids.append(ids)
        self.sizes.append(t.count)
        self.n += len(docs)
        self.bytes += len(t.buf)

    def full(self) -> bool:
        return self.n >= SEGMENT_DOCS or self.bytes >= SEGMENT_BYTES

    def segment(self) -> pa.RecordBatch:
        ids, sizes = np.concatenate(self.ids), np.concatenate(self.sizes).astype(np.int64)
        key = np.concatenate([np.zeros(0, np.int64), *self.keys])
        tf = np.concatenate([np.zeros(0, np.int64), *self.tf])
        order = np.argsort(ids, kind="stable")
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        key = (key & ~np.int64(0xFFFFFFFF)) | place[key & 0xFFFFFFFF]
        by = np.argsort(key)
        key, tf = key[by], tf[by]
        term = key >> 32
        first = np.flatnonzero(np.diff(term, prepend=-1))
        parts = [ids[order], sizes[order], self.wanted[term[first]], np.append(first, len(key)), (key & 0xFFFFFFFF).astype(np.int32), tf.astype(np.int32)]
        n_docs, n_terms = int((sizes > 0).sum()), int(sizes.sum())
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=[x.split()[0] for x in _SEGMENT.split(", ")])


def segments(docs: DataFrame, wanted: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Index segments over every row of ``docs``, with postings of the terms
    whose sorted hashes are ``wanted``; sizes and counts are those of the
    whole texts. No shuffle: a task closes a segment whenever it is full."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Builder(shared.value)
        for batch in kernel.slices(batches, "t"):
            held.add(batch.column("i").fill_null(_NO_ID).to_numpy(), kernel.raw(batch.column("t")))
            if held.full():
                yield held.segment()
        if held.n:
            yield held.segment()

    return docs.select(F.col(key).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(run, _SEGMENT)


@dataclass
class Statistics:
    """Documents with a term, all their terms, and by hash how many hold it."""

    n_docs: int
    n_terms: int
    df: dict[int, int]

    def weight(self, term: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * self.df[term] + 1)))


def statistics(index: DataFrame) -> Statistics:
    """Over all segments; the driver gets one row for each term that they
    index, as many as the query terms of one pass at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.diff(np.frombuffer(starts, np.int64)))], names=["h", "n"])

    total = index.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
    df = index.select("terms", "starts").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toArrow()
    return Statistics(total["d"] or 0, total["t"] or 0, dict(zip(df.column("h").to_pylist(), df.column("n").to_pylist(), strict=True)))


class Segment:
    """One segment as arrays, with the contribution of every posting."""

    def __init__(self, row: dict, stats: Statistics, weights: dict[int, int]):
        read = lambda k, kind: np.frombuffer(row[k], kind)
        self.ids, sizes = read("ids", np.int64), read("sizes", np.int64)
        self.n = len(self.ids)
        self.blocks = -(-self.n // BLOCK)
        terms, self.start = read("terms", np.int64), read("starts", np.int64)
        self.row = {h: i for i, h in enumerate(terms.tolist())}
        self.doc, tf = read("docs", np.int32), read("tf", np.int32).astype(np.int64)
        norm = 10 + 90 * sizes * stats.n_docs // max(1, stats.n_terms)
        w = np.repeat(np.array([weights[h] for h in terms.tolist()], np.int64), np.diff(self.start))
        self.gain = w * (1_000_000_000 * tf // (1000 * tf + 8 * norm[self.doc]))
        self.sums = np.zeros(self.blocks * BLOCK, np.int64)
        self._long: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def long(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a long list: where each block starts, and its largest gain."""
        if r not in self._long:
            a, b = self.start[r], self.start[r + 1]
            at = a + np.searchsorted(self.doc[a:b], np.arange(self.blocks + 1) * BLOCK)
            top = np.zeros(self.blocks, np.int64)
            some = np.flatnonzero(at[1:] > at[:-1])
            top[some] = np.maximum.reduceat(self.gain[a:b], at[some] - a)
            self._long[r] = at, top
        return self._long[r]

    def search(self, query: list[int], best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """``best`` (scores and ids, best first), with the documents of this
        segment that are among the k best."""
        rows = sorted((r for r in map(self.row.get, query) if r is not None), key=lambda r: (self.start[r + 1] - self.start[r], r))
        if not rows:
            return best
        size = np.cumsum([self.start[r + 1] - self.start[r] for r in rows])
        cut = int(np.searchsorted(size, SHORT_SHARE * self.n, side="right"))
        sums = self.sums
        sums[:] = 0
        for r in rows[:cut]:  # term at a time
            a, b = self.start[r], self.start[r + 1]
            sums[self.doc[a:b]] += self.gain[a:b]
        least = int(best[0][k - 1]) if len(best[0]) == k else 1
        if cut and k <= self.n:
            least = max(least, int(np.partition(sums[: self.n], self.n - k)[self.n - k]))
        long = [self.long(r) for r in rows[cut:]]
        bound = sums.reshape(self.blocks, BLOCK).max(axis=1)
        for _, top in long:
            bound += top
        left = np.flatnonzero(bound >= least)
        while len(left):  # document at a time, over blocks that may hold one of the best
            some, left = left[:STEP], left[STEP:]
            score = sums.reshape(self.blocks, BLOCK)[some]
            for at, _ in long:
                n = at[some + 1] - at[some]
                post = np.repeat(at[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
                score[np.repeat(np.arange(len(some)), n), self.doc[post] % BLOCK] += self.gain[post]
            i, j = np.nonzero(score >= least)
            if len(i):
                best = _better(best, score[i, j], self.ids[some[i] * BLOCK + j], k)
                if len(best[0]) == k and best[0][-1] > least:
                    least = int(best[0][-1])
                    left = left[bound[left] >= least]
        return best


def _better(best: tuple[np.ndarray, np.ndarray], score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    score, ids = np.concatenate([best[0], score]), np.concatenate([best[1], ids])
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def _search(index: DataFrame, queries: list[tuple[int | None, list[int]]], stats: Statistics, k: int) -> DataFrame:
    """(q, item_id, doc_id, score): the k best of each query and task."""
    weights = {h: stats.weight(h) for h in stats.df}
    shared = index.sparkSession.sparkContext.broadcast((queries, stats, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, stats, weights = shared.value
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(queries)
        for batch in batches:
            for i in range(batch.num_rows):
                at = Segment(batch.slice(i, 1).to_pylist()[0], stats, weights)
                best = [at.search(q, b, k) for (_, q), b in zip(queries, best, strict=True)]
        n = [len(s) for s, _ in best]
        number = np.repeat(np.arange(len(best)), n)
        ids = np.concatenate([none, *(i for _, i in best)])
        items = pa.array([x for x, _ in queries], pa.int64()).take(pa.array(number))
        yield pa.RecordBatch.from_arrays([pa.array(number), items, pa.array(ids, mask=ids == _NO_ID), pa.array(np.concatenate([none, *(s for s, _ in best)]))], names=["q", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "q long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the ``k`` best documents.

    Null texts and texts without a term are never found and don't count; an
    item without terms has no rows. Items equal in id and text count once,
    different texts under one id are ranked apart. Repeated rows of ``docs``
    are documents of their own; equal scores go by doc_id, a null one last.
    Other columns of either table play no part, whatever their names; an
    empty table gives an empty result. Items are searched in passes of about
    ``ITEM_BYTES`` of their text, each over all documents: what is broadcast
    follows that bound, and what is shuffled are k rows for each item and task.
    """
    spark = docs.sparkSession
    some: Column = F.col(item_text)
    items = materialize(items.select(F.col(item_key).cast("long").alias("i"), some.alias("t")).where("t is not null").distinct())
    passes = 1 + int(items.agg(F.sum(F.octet_length("t")).cast("long")).first()[0] or 0) // ITEM_BYTES
    out = spark.createDataFrame([], "q long, item_id long, doc_id long, score long, pass int")
    for p in range(passes):
        asked = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == p).collect()
        t, h = terms_of([r["t"].encode() for r in asked])
        if not len(h):
            continue
        queries = [(r["i"], sorted(set(h[a:b].view(np.int64).tolist()))) for r, a, b in zip(asked, t.offset[:-1], t.offset[1:], strict=True)]
        index = materialize(segments(docs, np.unique(h), key, text))
        out = out.unionByName(_search(index, queries, statistics(index), k).withColumn("pass", F.lit(p)))
    order = Window.partitionBy("pass", "q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
