"""Operator 10, substring dedup: suffix automata of reference shards.

A window of n words is a repeat if a document with a smaller id holds it too.
Each window names an anchor, the least hash among its g-grams, so equal
windows name equal anchors; a run of windows with one anchor is a cell. Cells
meet at their anchor. An equal cell of a smaller document settles a whole
cell. Where cells of one anchor differ, their words are the reference shard
of that anchor: a suffix automaton takes them in the order of their
documents, and each is streamed through it first; matching statistics of n
words and more mark the windows that smaller documents hold. An anchor with
very many different cells (a passage that stands in many surroundings) would
be one long automaton: its windows are dealt by their own hashes instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from . import kernel

WINDOW, GRAM = 13, 5
BLOCK_CELLS, BUCKET_CELLS, LEAST_BUCKETS = 400_000, 500_000, 64
#: Different cells of one anchor that still go through one automaton, and contested cells of a task.
HOT_CELLS, SHARD_CELLS = 512, 20_000
#: Documents sampled, by the hash of their id, to see which anchors stand in many surroundings, different cells that say so there, and the most anchors so marked: it affects the work, never the result.
SAMPLE, SAMPLE_CELLS, MOST_ANCHORS = 50_000, 24, 100_000


def cells(docs: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first word, windows, anchor, content hash) of each cell."""
    t = kernel.Texts(docs)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    n = len(t.start)
    if n < window:
        return none
    words = t.word_hashes()
    h = kernel.grams(words, np.arange(n - gram + 1), gram)
    wide = window - gram + 1
    at = t.gram_starts(window)
    if not len(at):
        return none
    anchor = np.lib.stride_tricks.sliding_window_view(h, wide)[at].argmin(axis=1) + at
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    a = at[first]
    b = a + size + window - 1
    up, down = kernel.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(kernel.mix(words) * up[:n], out=total[1:])
    content = kernel.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    return t.doc[a], a - t.offset[t.doc[a]], size, h[anchor[first]], content


def _u(x: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x), kind)


def _spread(docs: DataFrame, window: int, gram: int) -> np.ndarray:
    """Sorted anchors that many different cells of a sample name."""
    every = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "text"):
            _, _, _, anchor, content = cells(kernel.raw(batch.column("text")), window, gram)
            if len(anchor):
                anchor, content = kernel.distinct_per_doc(anchor, content)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (anchor, content)], names=["anchor", "content"])

    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("text")
    seen = some.mapInArrow(run, "anchor long, content long").distinct().groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_CELLS)
    rows = seen.orderBy(F.desc("n"), "anchor").limit(MOST_ANCHORS).select("anchor").toArrow()
    return np.sort(rows.column("anchor").to_numpy().astype(np.int64).view(np.uint64))


def _among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in sorted ``known``."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _settle(docs: DataFrame, window: int, gram: int, n_buckets: int, spread: np.ndarray) -> DataFrame:
    """(anchor, id, first, size, hot): a null anchor marks a covered cell, the
    others are cells whose anchor has other contents as well, each content by
    its smallest document, ``hot`` where there are many. Per task and content
    only the smallest document's cells go to the anchor's bucket (those of
    ``spread`` anchors to one of the anchor and content); the rest are covered
    by it already."""
    layout = ["bucket", "anchor", "content", "id", "first", "size"]
    types = [pa.int64(), *[pa.binary()] * 5]
    known = docs.sparkSession.sparkContext.broadcast(spread)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ident, first, size, anchor, content = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((ident, content, anchor))
            ident, first, size, anchor, content = (x[order] for x in (ident, first, size, anchor, content))
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]))
            least = ident[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            own = ident == least
            home = np.where(_among(known.value, anchor), kernel.mix(anchor ^ kernel.mix(content)), anchor)
            bucket = (np.where(own, home, kernel.mix(anchor + ident.view(np.uint64))) % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((~own, bucket))
            bucket, own, ident, first, size, anchor, content = (x[order] for x in (bucket, own, ident, first, size, anchor, content))
            cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
            mine = np.concatenate(([0], np.cumsum(own)))
            out = []
            for i in range(n_buckets):
                a, b = cut[i], cut[i + 1]
                if a < b:
                    c = a + mine[b] - mine[a]
                    out.append((i, anchor[a:c].tobytes(), content[a:c].tobytes(), ident[a:b].tobytes(), first[a:b].astype(np.uint32).tobytes(), size[a:b].astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types, strict=True)], names=layout)

        for batch in kernel.slices(batches, "text"):
            doc, first, size, anchor, content = cells(kernel.raw(batch.column("text")), window, gram)
            if len(doc):
                base = batch.column("base").to_numpy(zero_copy_only=False)[doc]
                held.append((batch.column("id").to_numpy(zero_copy_only=False)[doc], base + first, size, anchor, content))
                count += len(doc)
            if count >= BLOCK_CELLS:
                count = 0
                yield from flush()
        if held:
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in layout[1:]}
        n_own = [len(x) // 8 for x in columns["anchor"]]
        n_all = [len(x) // 8 for x in columns["id"]]
        own = np.concatenate([np.arange(b) < a for a, b in zip(n_own, n_all, strict=True)])
        ident, first, size = _u(columns["id"], np.int64), _u(columns["first"], np.uint32), _u(columns["size"], np.uint8)
        anchor, content = _u(columns["anchor"], np.uint64), _u(columns["content"], np.uint64)
        far = (ident[~own], first[~own], size[~own])
        ident, first, size = ident[own], first[own], size[own]
        order = np.lexsort((ident, content, anchor))
        ident, first, size, anchor, content = (x[order] for x in (ident, first, size, anchor, content))
        new_a = np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)]
        new = new_a | np.append(True, content[1:] != content[:-1])[: len(anchor)]
        least = ident[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(new) else ident
        group = np.cumsum(new_a) - 1
        contents = np.bincount(group, new) if len(group) else np.zeros(0)
        covered = ident > least
        many = _among(known.value, anchor)
        contested = ~covered & (many | (contents[group] > 1))
        hot = (many | (contents[group] > HOT_CELLS))[contested]
        done = [np.concatenate([x[covered], y]) for x, y in zip((ident, first, size), far, strict=True)]
        rows = [np.concatenate([x, y[contested]]).astype(np.int64) for x, y in zip(done, (ident, first, size), strict=True)]
        marks = pa.concat_arrays([pa.nulls(len(done[0]), pa.int64()), pa.array(anchor[contested].view(np.int64))])
        return pa.table({"anchor": marks, "id": rows[0], "first": rows[1], "size": rows[2], "hot": np.append(np.zeros(len(done[0]), bool), hot)})

    packed = docs.select("id", "base", "text").mapInArrow(emit, "bucket long, anchor binary, content binary, id binary, first binary, size binary")
    return packed.groupBy("bucket").applyInArrow(meet, "anchor long, id long, first long, size long, hot boolean")


class SuffixAutomaton:
    """Of several word sequences; each state knows no more than its links,
    its longest word count and its suffix link."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[bytes]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            if w in nxt[last]:
                q = nxt[last][w]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._split(last, w, q)
                continue
            here = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = here
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[here] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = here

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each word, how many words up to it match some sequence."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def spans_in_shard(rows: list[tuple[int, int, list[bytes]]], window: int) -> list[tuple[int, int, int]]:
    """``rows``: (id, first word, words) of cells with one anchor. Maximal
    runs of windows that a smaller id among them holds: (id, first, windows)."""
    out: list[tuple[int, int, int]] = []
    automaton = SuffixAutomaton()
    rows = sorted(rows, key=lambda r: r[0])
    at = 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end][0] == rows[at][0]:
            end += 1
        for ident, first, words in rows[at:end]:
            begin = None
            for i, n in enumerate([*automaton.statistics(words), 0]):
                if n >= window:
                    begin = i - window + 1 if begin is None else begin
                elif begin is not None:
                    out.append((ident, first + begin, i - window + 1 - begin))
                    begin = None
        for _, _, words in rows[at:end]:
            automaton.add(words)
        at = end
    return out


def _contested(settled: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """(anchor, h, id, first, words): the words of each contested cell, or,
    where its anchor is hot, without anchor and words, the hash of each of its
    windows. Of a task's equal windows only the smallest document's have one;
    the others are covered by them already. Texts are joined once for both."""
    lists = settled.where("anchor is not null").groupBy("id").agg(F.collect_list(F.struct("first", "size", "anchor", "hot")).alias("cells"))
    names, types = ["anchor", "h", "id", "first", "words"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "text"):
            cold, hot = [], []
            for ident, base, doc, own in zip(batch.column("id").to_pylist(), batch.column("base").to_pylist(), kernel.raw(batch.column("text")), batch.column("cells").to_pylist(), strict=True):
                held = doc.split()
                for c in own:
                    a = c["first"] - base
                    if 0 <= a < len(held):  # another text of this id has the other cells
                        content = b" ".join(held[a : a + c["size"] + window - 1])
                        if c["hot"]:
                            hot.append((ident, c["first"], c["size"], content))
                        else:
                            cold.append((c["anchor"], None, ident, c["first"], content))
            if cold:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cold), types, strict=True)], names=names)
            if hot:
                ident = np.repeat(np.array([x[0] for x in hot], np.int64), [x[2] for x in hot])
                first = np.concatenate([np.arange(x[1], x[1] + x[2]) for x in hot])
                t = kernel.Texts([x[3] for x in hot])
                h = kernel.grams(t.word_hashes(), t.gram_starts(window), window)
                order = np.lexsort((ident, h))
                h, ident, first = h[order], ident[order], first[order]
                new = np.append(True, h[1:] != h[:-1])
                least = ident[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int64()), pa.array(h.view(np.int64), mask=ident > least), pa.array(ident), pa.array(first), pa.nulls(len(h), pa.binary())], names=names)

    return materialize(docs.join(lists, "id").mapInArrow(split, "anchor long, h long, id long, first long, words binary"))


def _shards(rows: DataFrame, window: int) -> DataFrame:
    """(id, first, size) of the covered runs among cells that share an anchor."""
    cold = rows.where("anchor is not null").select("anchor", "id", "first", "words")
    n_groups = LEAST_BUCKETS + cold.count() // SHARD_CELLS

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("anchor", "ascending")])
        anchor = table.column("anchor").to_numpy()
        cut = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
        ident, first, content = (table.column(c).to_pylist() for c in ("id", "first", "words"))
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out += spans_in_shard([(ident[i], first[i], content[i].split(b" ")) for i in range(a, b)], window)
        x = list(zip(*out)) if out else [(), (), ()]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("id", "first", "size"), x, strict=True)})

    return cold.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(n_groups)).alias("_shard")).applyInArrow(shard, "id long, first long, size long")


def _windows(rows: DataFrame) -> DataFrame:
    """(id, first, size) of the covered windows among those that go by hash."""
    hot = rows.where("anchor is null").select("h", "id", "first")
    mine = hot.where("h is not null")
    least = mine.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("h", "least")
    later = mine.join(least, "h").where("id > least").select("id", "first")
    return hot.where("h is null").select("id", "first").union(later).withColumn("size", F.lit(1).cast("long"))


def _parts(rows: DataFrame) -> DataFrame | None:
    """(id, text_hash, base): where the words of each text begin among all
    words of its id, for ids that have several texts; None if none has."""
    several = rows.groupBy("id").agg(F.count_distinct("text_hash").alias("n")).where("n > 1").select("id")
    if several.isEmpty():
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "text"):
            n = [len(x.split()) for x in kernel.raw(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(n, pa.int64())], names=["id", "text_hash", "n"])

    sizes = rows.join(several, "id", "left_semi").mapInArrow(count, "id long, text_hash long, n long").groupBy("id", "text_hash").agg(F.max("n").alias("n"))
    before = Window.partitionBy("id").orderBy("text_hash").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(sizes.select("id", "text_hash", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``: its words
    that no repeated window covers, joined by one space.

    A window of ``window`` words is repeated if a document with a smaller key
    holds it; all are judged on the input. Null or empty texts have no words,
    texts of fewer words no window. Rows of one key are one document, its
    texts differ or not: a window that only they hold is no repeat, and no
    window spans two of them. A null key is never smaller and keeps all its
    words. Columns of these names are replaced, any others stay, whatever
    their name; an empty table gives an empty one.
    """
    if not gram <= window < gram + 255:
        raise ValueError(f"a window of {window} words and anchors of {gram} don't fit together")
    base = docs.drop("n_words", "n_removed", "kept_text")
    names = base.columns
    ident, hashed, start, runs = kernel.fresh([*names, "n_words", "n_removed", "kept_text"], "id_", "text_hash_", "base_", "runs_")
    base = base.withColumn(ident, F.col(f"`{key}`").cast("long")).withColumn(hashed, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    parts = _parts(base.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.col(f"`{text}`").alias("text"), F.col(hashed).alias("text_hash")))
    if parts is None:
        base = base.withColumn(start, F.lit(0).cast("long"))
    else:
        base = base.join(parts.toDF(ident, hashed, start), [ident, hashed], "left").withColumn(start, F.coalesce(start, F.lit(0)))
    known = base.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.col(start).alias("base"), F.col(f"`{text}`").alias("text"))
    total = known.agg(F.sum(F.length(F.coalesce("text", F.lit(""))))).first()[0] or 0
    settled = materialize(_settle(known, window, gram, LEAST_BUCKETS + int(total) // 25 // BUCKET_CELLS, _spread(known, window, gram)))
    covered = settled.where("anchor is null").select("id", "first", "size")
    rows = _contested(settled, known, window)
    found = covered.union(_shards(rows, window)).union(_windows(rows))
    lists = found.groupBy("id").agg(F.collect_list(F.struct("first", "size")).alias(runs)).withColumnRenamed("id", ident)
    joined = base.join(lists, ident, "left").select(*(F.col(f"`{c}`") for c in names), start, runs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, text):
            out = []
            for doc, at, run in zip(kernel.raw(batch.column(text)), batch.column(start).to_pylist(), batch.column(runs).to_pylist(), strict=True):
                words = doc.split()
                kept = words
                if run:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for r in run:
                        if 0 <= r["first"] - at < len(words):
                            edge[r["first"] - at] += 1
                            edge[r["first"] - at + r["size"] + window - 1] -= 1
                    keep = np.cumsum(edge[:-1]) == 0
                    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()), strict=True))], names=[*names, "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(cut, kernel.extended(docs.select(*(F.col(f"`{c}`") for c in names)).schema, n_words="long", n_removed="long", kept_text="string"))
