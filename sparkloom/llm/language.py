"""Operator 12, language ID: word-first backoff.

A word that some language knows is scored by its log frequency in each; a
word that none knows by its character n-grams, the longest length of which
any is known, shorter ones only where that fails. A text's score in a
language is the sum over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import kernel

#: Character n-grams, longest first; a word's edges count as a character each.
LENGTHS = (5, 4, 3, 2, 1)
#: Words seen less often are left to their n-grams.
LEAST_SEEN = 2
#: The model's size, whatever the corpus: so many words, n-grams, and cells (entries times languages) of either, the most frequent ones.
WORDS, GRAMS, CELLS = 1 << 17, 1 << 17, 1 << 21
#: Log frequency of what a language has never shown, below that of what it has shown once.
UNSEEN = 2.0
#: Sets apart n-grams of different lengths.
_SALT = 0x9E3779B97F4A7C15

#: Letters are kept, all else of ASCII parts words; bytes beyond it stand for letters here.
_LETTERS = bytes(c if chr(c).isalpha() else 32 for c in range(128)) + bytes(range(128, 256))
_ASCII_LETTER = np.array([c < 128 and chr(c).isalpha() for c in range(256)])

UNKNOWN = "und"


def _folded(docs: list[bytes]) -> tuple[kernel.Texts, np.ndarray]:
    """Words of the lower-cased texts, and which texts hold a letter."""
    text = [x.decode("utf-8", "replace") for x in docs]
    t = kernel.Texts([x.lower().encode().translate(_LETTERS) for x in text])
    letter = kernel.per_doc(_ASCII_LETTER[t.buf], t.doc_start, t.doc_end) > 0
    for i in np.flatnonzero(~letter & (t.count > 0)):
        letter[i] = any(map(str.isalpha, text[i]))
    return t, letter


def _types(t: kernel.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words: hash, one occurrence of each; and each word's number."""
    h, first, number = np.unique(t.word_hashes(), return_index=True, return_inverse=True)
    return h, first, number


def _grams(t: kernel.Texts, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ``words`` (numbers in ``t``): (place in ``words``, hash).

    A word's two edges count as one character each, but for n = 1, where an
    edge would say nothing; a word too short for n has no n-gram.
    """
    edge = np.append(np.flatnonzero((t.buf & 0xC0) != 0x80), len(t.buf))
    first, last = np.searchsorted(edge, t.start[words]), np.searchsorted(edge, t.end[words])
    pad = int(n > 1)
    count = np.maximum(last - first + 2 * pad - n + 1, 0)
    home = np.repeat(np.arange(len(words)), count)
    at = np.repeat(first - pad - np.cumsum(count) + count, count) + np.arange(count.sum())
    left, right = at < first[home], at + n > last[home]
    inside = t.hashes(edge[np.maximum(at, first[home])], edge[np.minimum(at + n, last[home])])
    return home, kernel.mix(inside + np.uint64(_SALT) * (4 * n + 2 * left + right).astype(np.uint64))


def _coded(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different strings of a column, and each row's number among them."""
    d = column.dictionary_encode()
    return d.dictionary.cast(pa.string()), d.indices.to_numpy()


def _batch(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else v for v in columns.values()], names=list(columns))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together until they have so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def word_counts(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n): how often each language shows each word, over all
    rows. Tasks count before anything is shuffled, so a language that holds
    most rows sends no more than its words from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "t", 1 << 22):
            t = kernel.Texts([x.decode("utf-8", "replace").lower().encode().translate(_LETTERS) for x in kernel.raw(batch.column("t"))])
            names, code = _coded(batch.column("l"))
            key = kernel.mix(t.word_hashes() + np.uint64(_SALT) * code[t.doc].astype(np.uint64))
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            whole = t.buf.tobytes()
            word = [whole[a:b] for a, b in zip(t.start[first].tolist(), t.end[first].tolist(), strict=True)]
            yield _batch(l=names.take(pa.array(code[t.doc[first]])), w=pa.array(word, pa.binary()), n=n)

    some = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    return some.mapInArrow(run, "l string, w binary, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, k, n) of the n-grams, from the word counts alone: every
    word is taken apart once, not at each of its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, 1 << 15):
            t = kernel.Texts(table.column("w").to_pylist())
            times = table.column("n").to_numpy()
            names, code = _coded(table.column("l").combine_chunks())
            key, home, size = [], [], []
            for n in LENGTHS:
                i, h = _grams(t, np.arange(len(t.start)), n)
                key.append(h)
                home.append(i)
                size.append(np.full(len(h), n))
            key, home, size = map(np.concatenate, (key, home, size))
            _, first, inverse = np.unique(kernel.mix(key + np.uint64(_SALT) * code[home].astype(np.uint64)), return_index=True, return_inverse=True)
            total = np.bincount(inverse, times[home], minlength=len(first)).astype(np.int64)
            yield _batch(l=names.take(pa.array(code[home[first]])), k=key[first].view(np.int64), size=size[first].astype(np.int32), n=total)

    return words.mapInArrow(run, "l string, k long, size int, n long").groupBy("l", "k", "size").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages in order, each one's log prior, and two tables of sorted
    hashes with a log frequency for every language."""

    languages: list[str]
    prior: np.ndarray
    words: tuple[np.ndarray, np.ndarray]
    grams: tuple[np.ndarray, np.ndarray]

    def scores(self, docs: list[bytes]) -> tuple[list[str], np.ndarray]:
        t, letter = _folded(docs)
        h, first, number = _types(t)
        each = np.zeros((len(h), len(self.languages)), np.float32)
        at, known = _found(self.words[0], h)
        each[known] = self.words[1][at[known]]
        rest = np.flatnonzero(~known)
        for n in LENGTHS:
            if not len(rest):
                break
            home, key = _grams(t, first[rest], n)
            at, hit = _found(self.grams[0], key)
            home, at = home[hit], at[hit]
            some, cut = np.unique(home, return_index=True)
            if len(some):
                total = np.add.reduceat(self.grams[1][at], cut, axis=0)
                each[rest[some]] = total / np.diff(np.append(cut, len(home)))[:, None]
                rest = np.delete(rest, some)
        total = np.empty((t.n_docs, len(self.languages)))
        for j, prior in enumerate(self.prior):
            total[:, j] = prior + _sums(each[number, j], t.offset)
        best = total.argmax(axis=1)
        share = np.exp(total - total.max(axis=1, keepdims=True))
        p = 1 / share.sum(axis=1)
        return [self.languages[i] if ok else UNKNOWN for i, ok in zip(best, letter, strict=True)], np.where(letter, p, 0.0)


def _sums(values: np.ndarray, offset: np.ndarray) -> np.ndarray:
    total = np.append(0.0, np.cumsum(values, dtype=np.float64))
    return total[offset[1:]] - total[offset[:-1]]


def _found(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


def _table(counts: DataFrame, languages: list[str], most: int, least: int, *key: str) -> tuple[pa.Table, np.ndarray]:
    """Entries and their counts by language: all that are seen as often as
    the rarest frequency at which no more than ``most`` are left."""
    each = counts.groupBy(*key).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("by"))
    seen = {r["total"]: r["entries"] for r in each.where(F.col("total") >= least).groupBy("total").agg(F.count("*").alias("entries")).collect()}
    left, cut = most, max(seen, default=0) + 1
    for total in sorted(seen, reverse=True):
        left -= seen[total]
        if left < 0:
            break
        cut = total
    got = each.where(F.col("total") >= cut).select(*key, *(F.coalesce(F.col("by")[x], F.lit(0)).alias(f"_{i}") for i, x in enumerate(languages))).toArrow()
    return got, np.stack([got.column(f"_{i}").to_numpy() for i in range(len(languages))], axis=1).astype(np.float64)


def _log(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    least = -np.log(np.maximum(total, 1)) - UNSEEN
    return np.where(n > 0, np.log(np.maximum(n, 1) / np.maximum(total, 1)), least).astype(np.float32)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", words: int = WORDS, grams: int = GRAMS, cells: int = CELLS) -> Model | None:
    """The model of all rows with a text and a language; None without any.

    All rows are counted, whatever their number; the model keeps the most
    frequent ``words`` and ``grams``, and fewer if ``cells`` over the number
    of languages is less. Rarer words are what the n-grams are for.
    """
    some = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = {r["l"]: r["n"] for r in some.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(rows)
    if not languages:
        return None
    counts = materialize(word_counts(some, text, lang))
    total = {r["l"]: r["n"] for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    most = max(1, cells // len(languages))
    got, n = _table(counts, languages, min(words, most), LEAST_SEEN, "w")
    h = kernel.Texts(got.column("w").to_pylist()).word_hashes() if len(n) else np.zeros(0, np.uint64)
    order = np.argsort(h)
    known = h[order], _log(n, np.array([total.get(x, 0) for x in languages], float))[order]
    parts = materialize(gram_counts(counts))
    by_size = {(r["size"], r["l"]): r["n"] for r in parts.groupBy("size", "l").agg(F.sum("n").alias("n")).collect()}
    got, n = _table(parts, languages, min(grams, most), 1, "k", "size")
    h = got.column("k").to_numpy().astype(np.int64).view(np.uint64)
    whole = np.array([[by_size.get((size, x), 0) for x in languages] for size in range(max(LENGTHS) + 1)], float)[got.column("size").to_numpy()]
    order = np.argsort(h)
    share = np.array([rows[x] for x in languages], float)
    return Model(languages, np.log(share / share.sum()), known, (h[order], _log(n, whole)[order]))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the share of the best
    language (0 to 1), from the whole text alone.

    A null text or one without a letter is ``und`` with score 0, and so is
    every text without a model. Texts of any length; repeated rows one by one;
    an empty table gives an empty one; columns of these names are replaced.
    The model's size is bounded (``WORDS``, ``GRAMS``, ``CELLS``) and it is
    broadcast; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(docs: list[bytes]) -> list[pa.Array]:
        found, score = shared.value.scores(docs) if shared.value else ([UNKNOWN] * len(docs), np.zeros(len(docs)))
        return [pa.array(found, pa.string()), pa.array(score, pa.float64())]

    return kernel.with_columns(docs, text, run, lang_pred="string", score="double")
