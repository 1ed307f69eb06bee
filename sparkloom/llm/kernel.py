"""Vectorised text kernel used inside Arrow batches.

Spark partitions and shuffles; these helpers turn one bounded slice of a
batch into numpy arrays of words, lines and hashes. A word is a maximal run
of bytes outside ``\\x20\\x09-\\x0D``; every text counts whole, null as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256).astype(np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), wrapping."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd hash base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(20, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


class Texts:
    """Words of several documents in one buffer, as byte ranges."""

    def __init__(self, docs: list[bytes]):
        self.n_docs = len(docs)
        self.buf = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        self.doc_end = np.cumsum(sizes + 1) - 1
        self.doc_start = self.doc_end - sizes
        space = SPACE[self.buf]
        self.space = space
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.offset = np.append(np.searchsorted(self.start, self.doc_start), len(self.start))
        self.count = np.diff(self.offset)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)
        self._sum: np.ndarray | None = None

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range."""
        up, down = powers(len(self.buf) + 1)
        if self._sum is None:
            self._sum = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(_BYTE[self.buf] * up[: len(self.buf)], out=self._sum[1:])
        return mix((self._sum[end] - self._sum[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def gram_starts(self, k: int) -> np.ndarray:
        """Words at which a run of k words of one document starts."""
        if k <= 1:
            return np.arange(len(self.start))
        if len(self.start) < k:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self.start) - k + 1] == self.doc[k - 1 :])


def grams(words: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of the k words from each of ``starts``: differences of
    one prefix sum of a polynomial, so any k costs the same."""
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words) * up[: len(words)], out=total[1:])
    return mix((total[starts + k] - total[starts]) * down[starts] + np.uint64(k * int(_STEP) % 2**64))


def per_doc(values: np.ndarray, bounds_start: np.ndarray, bounds_end: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over half-open ranges."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds_end] - total[bounds_start]


def repeats(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys (doc, hash): which occur twice or more, and which of them are
    not the first of their kind; input order."""
    key = mix(h ^ mix(doc.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    many, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    return many, later


def covered(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    """Which of n words lie in a run of k words from any of ``starts``."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + k, -1)
    return np.cumsum(d[:n]) > 0


def distinct_per_doc(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) pairs without repeats, sorted by both."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds at most ``most`` bytes of text,
    or one row. Memory then follows the longest text, not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each lengthened until no column has it in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def extended(schema: T.StructType, **added: str) -> T.StructType:
    """``schema`` with more columns, itself left as it is."""
    return T.StructType([*schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in added.items())])


def with_columns(docs: DataFrame, text: str, measure: Callable[[list[bytes]], list[pa.Array]], **added: str) -> DataFrame:
    """``docs`` with the columns ``added`` (name and type), which ``measure``
    makes of the texts of a slice. Columns of these names are replaced; others
    stay, whatever their names (dots, equal names but for case)."""
    taken = {k.lower() for k in added}
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in taken or c == text]
    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns)))).select(*(f"_{i}" for i in kept))
    at = kept.index(docs.columns.index(text))
    names = [docs.columns[i] for i in kept if docs.columns[i].lower() not in taken]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, *measure(raw(batch.column(at)))], names=[*batch.schema.names, *added])

    out = plain.mapInArrow(run, extended(plain.schema, **added))
    return out.select(*(f"_{i}" for i in kept if docs.columns[i].lower() not in taken), *added).toDF(*names, *added)
