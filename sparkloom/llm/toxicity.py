"""Operator 8, toxicity: multiple-instance learning.

A document is a bag of sentences. Sentence probabilities, combined by
noisy-or, are fitted to document labels alone; the same probabilities then
say which sentences offend. Features are hashed lower-case words and their
first bytes, so that inflected or derived forms share weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from . import kernel

BITS = 18
PREFIXES = (4, 5, 6, 7, 8)
#: The largest number of labelled documents that a model is fitted on, of their bytes, and of features that it keeps.
SAMPLE, SAMPLE_BYTES, FEATURES = 20_000, 128_000_000, 6_000
FOLDS = 5

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n\x00")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), 39, *range(128, 256)]] = True


def sentences(docs: list[bytes]) -> tuple[kernel.Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of lower-cased texts and their features: the texts, starts
    and ends of sentences in the buffer (each document has one at least),
    each one's document, and pairs (sentence, feature) without repeats."""
    t = kernel.Texts([x.decode("utf-8", "replace").lower().encode() for x in docs])
    stop = np.flatnonzero(_ENDS[t.buf])
    start = np.append(0, stop[:-1] + 1)
    doc = np.searchsorted(t.doc_end, stop, side="left")
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _LETTER[t.buf], [False])).view(np.int8)))
    a, b = edge[0::2], edge[1::2]
    home = np.searchsorted(stop, a, side="left")
    rows, ids = [home], [t.hashes(a, b)]
    for k in PREFIXES:
        long = b - a > k
        rows.append(home[long])
        ids.append(kernel.mix(t.hashes(a[long], a[long] + k) + np.uint64(k)))
    row = np.concatenate(rows)
    feature = np.concatenate(ids) >> np.uint64(64 - BITS)
    pair = np.unique((row.astype(np.uint64) << np.uint64(BITS)) | feature)
    return t, start, stop, doc, (pair >> np.uint64(BITS)).astype(np.int64), (pair & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    """Weights by hashed feature, and the bias of a sentence."""

    weights: np.ndarray
    bias: float

    def instances(self, docs: list[bytes]):
        t, start, stop, doc, row, feature = sentences(docs)
        logit = np.full(len(stop), self.bias)
        logit += np.bincount(row, self.weights[feature], minlength=len(stop))
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        return t, start, stop, doc, p

    def scores(self, docs: list[bytes]) -> tuple[np.ndarray, list[list[dict]]]:
        """Noisy-or of each document, and its sentences of 0.5 and more."""
        t, start, stop, doc, p = self.instances(docs)
        out = 1 - np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=t.n_docs))
        found: list[list[dict]] = [[] for _ in docs]
        points = np.zeros(len(t.buf) + 1, np.int64)
        np.cumsum((t.buf & 0xC0) != 0x80, out=points[1:])
        hit = np.flatnonzero(p >= 0.5)
        first = points[t.doc_start[doc[hit]]]
        for d, a, b, x in zip(doc[hit].tolist(), (points[np.maximum(start[hit], t.doc_start[doc[hit]])] - first).tolist(), (points[stop[hit]] - first).tolist(), p[hit].tolist(), strict=True):
            found[d].append({"start": a, "end": b, "score": x})
        return np.clip(out, 0.0, 1.0), found


def held_out(key: str = "doc_id") -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, text: str = "text") -> DataFrame:
    """(text, toxic) of labelled documents outside the held-out fold, in the
    order of a hash of their id: at most ``most`` of them and of ``most_bytes``
    bytes in all, each text whole. The ids' size is bounded by ``most``, so
    they are broadcast and no text is shuffled. Null labels are no labels;
    of several for one id the largest counts; a null text is empty."""
    ids = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    some = materialize(docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id"))
    # one row for each of at most ``most`` ids: the window is as bounded as they are
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = some.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("_bytes")).withColumn("_upto", F.sum("_bytes").over(order)).where(F.col("_upto") <= most_bytes)
    return some.join(F.broadcast(fits.select("doc_id")), "doc_id").select("text", F.col("_toxic").cast("int").alias("toxic"))


def fit(sample: DataFrame, features: int = FEATURES, steps: int = 160, rate: float = 0.15, decay: float = 2e-4) -> Model:
    """Fit on the rows of ``sample`` (text, toxic). Spark counts in how many
    documents of either label each feature stands; the driver gets the
    ``features`` that differ most and, of each document, only where those
    stand. Without rows of both labels the score is the bias everywhere."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for batch in kernel.slices(batches):
            label = batch.column("toxic").to_numpy()
            _, _, _, doc, row, feature = sentences(kernel.raw(batch.column("text")))
            pair = np.unique((doc[row].astype(np.uint64) << np.uint64(BITS)) | feature.astype(np.uint64))
            for y in (0, 1):
                seen[y] += np.bincount((pair[label[(pair >> np.uint64(BITS)).astype(np.int64)] == y] & np.uint64((1 << BITS) - 1)).astype(np.int64), minlength=1 << BITS)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["feature", "clean", "toxic"])

    total = {int(r["toxic"]): r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    model = Model(np.zeros(1 << BITS, np.float64), float(np.log((n1 + 1) / (n0 + 1)) - 3))
    if not n0 or not n1:
        return model
    counts = sample.mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    a, b = F.col("clean") / n0, F.col("toxic") / n1
    gap = F.abs(b - a) / F.sqrt((F.col("clean") + F.col("toxic") + 1) / (n0 + n1) * (1 / n0 + 1 / n1))
    best = counts.withColumn("gap", gap).orderBy(F.desc("gap"), "feature").limit(features).collect()
    kept = np.array(sorted(r["feature"] for r in best), np.int64)
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches):
            _, _, stop, doc, row, feature = sentences(kernel.raw(batch.column("text")))
            on = place[feature] >= 0
            row, at = row[on], place[feature[on]].astype(np.int32)
            size = np.bincount(row, minlength=len(stop)).astype(np.int32)
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            ptr = np.append(0, np.cumsum(size))
            plain = [int((size[i:j] == 0).sum()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(plain, pa.int32()), pa.array([size[i:j][size[i:j] > 0].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([at[ptr[i] : ptr[j]].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["toxic", "plain", "sizes", "features"])

    rows = sample.mapInArrow(reduce, "toxic int, plain int, sizes binary, features binary").toArrow()
    label = rows.column("toxic").to_numpy()
    plain = rows.column("plain").to_numpy().astype(float)
    sizes = [np.frombuffer(x, np.int32) for x in rows.column("sizes").to_pylist()]
    feature = np.frombuffer(b"".join(rows.column("features").to_pylist()), np.int32)
    home = np.repeat(np.arange(len(sizes)), [len(x) for x in sizes])
    size = np.concatenate(sizes)
    row = np.repeat(np.arange(len(size)), size)
    w = np.zeros(len(kept))
    share = {r["feature"]: np.log((r["toxic"] + 0.5) / (n1 + 1)) - np.log((r["clean"] + 0.5) / (n0 + 1)) for r in best}
    w[:] = [0.3 * share[x] for x in kept.tolist()]
    bias = model.bias
    cost = np.where(label == 1, 0.5 * len(label) / n1, 0.5 * len(label) / n0) ** 0.5
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        logit = np.clip(bias + np.bincount(row, w[feature], minlength=len(size)), -30, 30)
        p = 1 / (1 + np.exp(-logit))
        p0 = 1 / (1 + np.exp(-np.clip(bias, -30, 30)))
        none = np.bincount(home, np.logaddexp(0, logit), minlength=len(label)) + plain * np.logaddexp(0, bias)
        # d loss / d logit of a sentence is p for a clean document, -p (1 - P) / P for a toxic one
        slope = cost * np.where(label == 1, -np.exp(-none) / np.maximum(-np.expm1(-none), 1e-9), 1.0)
        each = slope[home] * p
        g = np.append(np.bincount(feature, each[row], minlength=len(w)), each.sum() + (slope * plain).sum() * p0) / len(label)
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        w -= d[:-1]
        bias -= float(d[-1])
    model.weights[kept] = w
    model.bias = bias
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``offending``: the sentences of
    0.5 and more as (start, end, score), code points of the lower-cased text.

    A null or empty text is one sentence without features. Whole texts of any
    length; repeated rows one by one; columns of these names are replaced.
    The model (2 ** 18 weights) is broadcast; no shuffle.
    """
    base = docs.drop("score", "offending")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, text):
            s, found = shared.value.scores(kernel.raw(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(found, kind)], names=[*batch.schema.names, "score", "offending"])

    return base.mapInArrow(run, kernel.extended(base.schema, score="double", offending="array<struct<start:bigint,end:bigint,score:double>>"))
