"""Operator 2, quality rules: repetition coverage.

Rolling hashes of several n-gram lengths measure how many characters of a
text lie inside n-grams and lines that the text has shown before; a share of
symbols beside them marks noise that never repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel

SYMBOLS = b"#*$%&|<>"
#: n-gram length -> largest share of characters inside its later occurrences.
NGRAM_LIMITS = {5: 0.20, 7: 0.18, 10: 0.15}
LINE_LIMIT = 0.20
SYMBOL_LIMIT = 0.10
MIN_WORDS = 50

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: list[bytes], lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of each text: the base ones, characters in lines seen before,
    and by n-gram length characters in n-grams seen before."""
    t = kernel.Texts(docs)
    words = t.word_hashes()
    n = len(words)
    point = (t.buf & 0xC0) != 0x80
    chars = kernel.per_doc(point, t.start, t.end)
    out = {"n_words": t.count, "word_chars": kernel.per_doc(point & ~t.space, t.doc_start, t.doc_end), "n_symbols": kernel.per_doc(_IS_SYMBOL[t.buf], t.doc_start, t.doc_end)}

    stop = np.flatnonzero(t.buf == 10)
    start = np.append(0, stop[:-1] + 1)
    full = kernel.per_doc(~t.space, start, stop) > 0
    start, stop = start[full], stop[full]
    line_doc = np.searchsorted(t.doc_end, start, side="left")
    _, later = kernel.repeats(line_doc, t.hashes(start, stop))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=t.n_docs)
    line_chars = kernel.per_doc(point & ~t.space, start, stop)
    out["dup_line_chars"] = np.bincount(line_doc[later], line_chars[later], minlength=t.n_docs).astype(np.int64)

    at = t.gram_starts(3)
    many, _ = kernel.repeats(t.doc[at], kernel.grams(words, at, 3))
    out["n_repeat_words"] = kernel.per_doc(kernel.covered(n, at[many], 3), t.offset[:-1], t.offset[1:])
    for k in lengths:
        at = t.gram_starts(k)
        _, later = kernel.repeats(t.doc[at], kernel.grams(words, at, k))
        inside = kernel.covered(n, at[later], k)
        out[f"dup_chars_{k}"] = kernel.per_doc(inside * chars, t.offset[:-1], t.offset[1:])
    return out


def quality_rules(docs: DataFrame, text: str = "text", ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, symbol_limit: float = SYMBOL_LIMIT, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``.

    A null or empty text has all measures 0 and fails (too few words). Texts
    of any length are measured whole. Repeated rows are judged one by one;
    an empty table gives an empty one. Columns of ``docs`` that bear the name
    of a measure are replaced. No shuffle: one pass over the rows.
    """
    limits = dict(NGRAM_LIMITS if ngram_limits is None else ngram_limits)
    lengths = tuple(sorted(limits))
    names = [*MEASURES, "dup_line_chars", *(f"dup_chars_{k}" for k in lengths)]
    base = docs.drop(*names, "base_failed", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, text):
            got = measure(kernel.raw(batch.column(text)), lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[x].astype(np.int64)) for x in names)], names=[*batch.schema.names, *names])

    out = base.mapInArrow(run, kernel.extended(base.schema, **dict.fromkeys(names, "long")))
    short = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("dup_line_chars") <= line_limit * F.col("word_chars")) & (F.col("n_symbols") <= symbol_limit * F.col("word_chars"))
    for k in lengths:
        fine = fine & (F.col(f"dup_chars_{k}") <= limits[k] * F.col("word_chars"))
    return out.withColumn("base_failed", short).withColumn("kept", ~short & fine)
