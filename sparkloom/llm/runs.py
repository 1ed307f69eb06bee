"""Operator 13, periodic run detection: suffix automaton, link-cut access.

A text's words are appended to a suffix automaton one by one. Its suffix
links are a tree in which the states of all suffixes up to the new word are
one path to the root; accessing that path in a link-cut forest recolours it
with the new end. Each segment of one old colour was a suffix with an earlier
last end: where the two ends lie no further apart than the segment's longest
suffix, that suffix and its earlier copy form a square, whose left end is
exact already; reading on to the right makes it a run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel

#: Words of the shortest run.
LEAST = 12


class Runs:
    """Appends words, and keeps every run of at least ``least`` words and two
    periods as (start, length, period). Amortised O(log n) a word.

    States: ``next``, ``link``, ``length``. Forest: ``left`` and ``right``
    are the children in the splay tree of a path, ordered by depth, ``up``
    the parent there or, from a tree's root, the state above its path;
    ``end`` is the colour of the path, kept at the tree's root. A run has
    ``least / 2`` words or more that repeat at its period, so states with
    shorter suffixes can show none and stay out of the forest.
    """

    def __init__(self, words: list[int], least: int = LEAST):
        self.words, self.least, self.short = words, least, least // 2
        self.next: list[dict[int, int]] = [{}, {}]
        self.link, self.length = [0, 0], [0, 0]
        self.left, self.right, self.up, self.end = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.found: list[tuple[int, int, int]] = []
        self.until: dict[int, int] = {}
        last = 1
        for i, w in enumerate(words):
            last = self._append(last, w, i)

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        for x in (self.left, self.right, self.up):
            x.append(0)
        self.end.append(-1)
        return len(self.next) - 1

    def _append(self, last: int, w: int, i: int) -> int:
        follow, link, length = self.next, self.link, self.length
        here = self._state(i + 1, 1, {})
        p = last
        while p and w not in follow[p]:
            follow[p][w] = here
            p = link[p]
        if p:
            q = follow[p][w]
            if length[q] != length[p] + 1:
                q = self._clone(p, w, q)
            link[here] = q
            if length[q] >= self.short:
                self.up[here] = q
                self._access(here, i)
        self.end[here if not self.up[here] else self._top] = i
        return here

    def _clone(self, p: int, w: int, q: int) -> int:
        """Split ``q``; the new state lies right above it on its path, as it
        has been read last where ``q`` has."""
        follow, link, length = self.next, self.link, self.length
        new = self._state(length[p] + 1, link[q], dict(follow[q]))
        link[q] = new
        while p and follow[p].get(w) == q:
            follow[p][w] = new
            p = link[p]
        if length[new] >= self.short:
            self._splay(q)
            above = self.left[q]
            self.left[new], self.left[q], self.up[new] = above, new, q
            if above:
                self.up[above] = new
        return new

    def _access(self, here: int, i: int) -> None:
        """Make the path from ``here`` to the root one, and look at each
        segment with an old colour that it meets."""
        up, right, end, length = self.up, self.right, self.end, self.length
        low, x = here, up[here]
        while x:
            self._splay(x)
            old = end[x]
            if i - old <= length[x] and self.until.get(i - old, -1) < i:
                self._extend(i, i - old, length[x])
            below = right[x]
            if below:
                end[below] = old
            right[x] = low
            low, x = x, up[x]
        self._top = low

    def _extend(self, i: int, period: int, same: int) -> None:
        words, stop = self.words, i + 1
        while stop < len(words) and words[stop] == words[stop - period]:
            stop += 1
        self.until[period] = stop - 1
        start = i - same - period + 1
        if stop - start >= max(self.least, 2 * period):
            self.found.append((start, stop - start, period))

    def _splay(self, x: int) -> None:
        left, right, up, rotate = self.left, self.right, self.up, self._rotate
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)

    def _rotate(self, x: int) -> None:
        """``x`` above its parent; a root hands its path's colour on."""
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[x] = up[p]
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:
            self.end[x] = self.end[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        up[p] = x


def stretches(doc: np.ndarray, words: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of words outside which no run lies.

    At every place of a run, k words repeat within the run, no more than half
    of it apart. So a run lies within one stretch of words that repeated
    k-grams cover, and of their repeats those within one stretch, half of it
    apart at most, cover it too; each round takes away what doesn't.
    """
    at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :]) if len(doc) >= k else np.zeros(0, np.int64)
    key = kernel.mix(kernel.grams(words, at, k) ^ kernel.mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    a, b = at[order[:-1][same]], at[order[1:][same]]
    start = stop = np.zeros(0, np.int64)
    for _ in range(rounds):
        on = kernel.covered(len(doc), np.concatenate([a, b]), k)
        first = on & np.append(True, ~on[:-1] | (doc[1:] != doc[:-1]))[: len(on)]
        start = np.flatnonzero(first)
        stop = start + kernel.per_doc(on, start, np.append(start[1:], len(on)))
        number = np.cumsum(first)
        size = (stop - start)[number[a] - 1] if len(a) else a
        fits = (number[a] == number[b]) & (b - a <= size // 2)
        if fits.all():
            break
        a, b = a[fits], b[fits]
    return start, stop


def find(doc: np.ndarray, words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """(document, start in all the words, length, period) of all runs."""
    out = []
    for a, b in zip(*stretches(doc, words, least // 2), strict=True):
        ids = np.unique(words[a:b], return_inverse=True)[1].tolist()
        out += [(int(doc[a]), int(a) + s, n, q) for s, n, q in Runs(ids, least).found]
    return out


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start,
    then period) and ``collapsed``: the words that are in no run after its
    first period, joined by one space.

    A run has ``least`` words and two periods at least, its period is its
    smallest, and no neighbouring word extends it. Null and empty texts have
    no words, no runs and an empty ``collapsed``. Whole texts of any length, a
    text in one task; repeated rows one by one; an empty table gives an empty
    one; columns of these names are replaced. No shuffle.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(docs: list[bytes]) -> list[pa.Array]:
        t = kernel.Texts(docs)
        gone = np.zeros(len(t.start) + 1, np.int64)
        by_doc: list[list[tuple[int, int, int]]] = [[] for _ in docs]
        for doc, start, length, period in find(t.doc, t.word_hashes(), least):
            by_doc[doc].append((start - int(t.offset[doc]), length, period))
            gone[start + period] += 1
            gone[start + length] -= 1
        kept = np.cumsum(gone[:-1]) == 0
        whole, out = t.buf.tobytes(), []
        for i, j in zip(t.offset[:-1], t.offset[1:], strict=True):
            on = kept[i:j]
            out.append(b" ".join([whole[a:b] for a, b in zip(t.start[i:j][on].tolist(), t.end[i:j][on].tolist(), strict=True)]))
        runs = [[{"start": s, "length": n, "period": q} for s, n, q in sorted(x, key=lambda r: (r[0], r[2]))] for x in by_doc]
        return [pa.array(t.count.astype(np.int64)), pa.array(runs, kind), pa.array(out, pa.binary()).cast(pa.string())]

    return kernel.with_columns(docs, text, run, n_words="long", runs=_RUNS, collapsed="string")
