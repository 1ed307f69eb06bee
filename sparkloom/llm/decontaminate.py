"""Operator 7, benchmark decontamination: BM25 with block-max WAND.

Test items form an inverted index with the largest contribution of each term
per block of items. Every passage of every training text is a query; all
items above the threshold are retrieved, then checked for the overlap of
their question and of their answer with the text around the passage.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import kernel

K1, B = 1.2, 0.75
BLOCK, COARSE = 16, 64
#: Share of an item's score against itself that a passage must reach, and shares of question and answer 3-grams that must be there.
LEAST_SCORE, LEAST_QUESTION, LEAST_ANSWER = 0.5, 0.6, 0.5
SHINGLE = 3
LEAST_PASSAGE = 32
#: Bytes of item text in one index; more items make more indexes, broadcast one after the other.
INDEX_BYTES = 4_000_000
#: Items of at most so many words share an index, longer ones those of at most LONGER times as many, and so on: an index's longest item sets the size of its passages.
SHORT_ITEM, LONGER = 256, 8

#: Words are runs of ASCII letters, digits and all characters beyond ASCII, lower-cased.
_WORDS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))
_ANSWER = re.compile(rb"^(.*[.!?:][\x20\x09-\x0D]+)([^\x20\x09-\x0D].*)$", re.S)


def plain(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode().translate(_WORDS)


def parts(item: bytes) -> tuple[list[bytes], list[bytes]]:
    """Question and answer words: the last sentence answers; of a single
    sentence its last quarter does."""
    m = _ANSWER.match(item.strip())
    if m and plain(m[1]).split() and plain(m[2]).split():
        return plain(m[1]).split(), plain(m[2]).split()
    words = plain(item).split()
    cut = max(1, len(words) - max(1, len(words) // 4))
    return words[:cut], words[cut:]


def _shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class Index:
    """Items in order of id. ``terms``: sorted hashes; ``top``: largest
    contribution of each; ``postings``: (item numbers, contributions, block
    maxima by block number); ``coarse``: by term, maxima over at most
    ``COARSE`` ranges of items, to bound many passages at once. Contributions are shares of the item's score
    against itself, so one threshold fits all items."""

    ids: list[int]
    question: list[set]
    answer: list[set]
    sizes: list[int]
    terms: np.ndarray
    top: np.ndarray
    postings: list[tuple[list[int], list[float], dict[int, float]]]
    coarse: np.ndarray

    @property
    def passage(self) -> int:
        return max([LEAST_PASSAGE, *self.sizes])


@dataclass
class Corpus:
    """What BM25 takes from all items, however they are split: how many there
    are, their mean length, and by term hash how many hold the term."""

    n: int
    mean: float
    df: dict[int, int]


def corpus_of(items: list[tuple[int, bytes]]) -> Corpus:
    bags = [kernel.Texts([plain(x)]).word_hashes() for _, x in items]
    bags = [x for x in bags if len(x)]
    return Corpus(len(bags), sum(map(len, bags)) / max(1, len(bags)), Counter(x for b in bags for x in set(b.tolist())))


def build(items: list[tuple[int, bytes]], corpus: Corpus | None = None) -> Index:
    """The index of ``items``, a part of ``corpus`` (without one, all of it)."""
    corpus = corpus or corpus_of(items)
    items = sorted((i, t) for i, t in items if plain(t).split())
    words = [plain(t).split() for _, t in items]
    t = kernel.Texts([plain(x) for _, x in items]) if items else None
    hashes = t.word_hashes() if items else np.zeros(0, np.uint64)
    bags = [Counter(hashes[t.offset[i] : t.offset[i + 1]].tolist()) for i in range(len(items))]
    n_items, mean, df = corpus.n, corpus.mean, corpus.df
    raw: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for i, bag in enumerate(bags):
        each = {x: np.log(1 + (n_items - df[x] + 0.5) / (df[x] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words[i]) / mean)) for x, n in bag.items()}
        whole = sum(each.values())
        for x, s in each.items():
            raw[x].append((i, float(s / whole)))
    terms = sorted(raw)
    postings = []
    for x in terms:
        blocks: dict[int, float] = {}
        for i, s in raw[x]:
            blocks[i // BLOCK] = max(blocks.get(i // BLOCK, 0.0), s)
        postings.append(([i for i, _ in raw[x]], [s for _, s in raw[x]], blocks))
    width = 1 + len(items) // COARSE
    coarse = np.zeros((len(terms), 1 + len(items) // width), np.float32)
    for row, x in enumerate(terms):
        for i, v in raw[x]:
            coarse[row, i // width] = max(coarse[row, i // width], v)
    split = [parts(x) for _, x in items]
    return Index([i for i, _ in items], [_shingles(q) for q, _ in split], [_shingles(a) for _, a in split], list(map(len, words)), np.array(terms, np.uint64), np.array([max(p[1]) for p in postings]), postings, coarse)


def retrieve(index: Index, query: list[int], least: float) -> list[tuple[int, float]]:
    """All items of at least ``least``, by block-max WAND over the query's
    terms: cursors move past items and blocks whose bounds fall short."""
    cursors = [[0, index.postings[t][0], index.postings[t][1], index.postings[t][2], index.top[t]] for t in query]
    cursors = sorted(cursors, key=lambda c: c[1][0])
    out = []
    while cursors:
        total, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            total += c[4]
            if total >= least - 1e-9:
                pivot = i
                break
        if pivot < 0:
            break
        item = cursors[pivot][1][cursors[pivot][0]]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]] == item:
            pivot += 1
        block = item // BLOCK
        if sum(c[3].get(block, 0.0) for c in cursors[: pivot + 1]) >= least - 1e-9:
            score = 0.0
            for c in cursors[: pivot + 1]:
                at = bisect_left(c[1], item, c[0])
                if at < len(c[1]) and c[1][at] == item:
                    score += c[2][at]
                    at += 1
                c[0] = at
            if score >= least - 1e-9:
                out.append((item, score))
        else:
            # no item of this block qualifies with these terms; the next other term may add to it
            skip = (block + 1) * BLOCK
            if pivot + 1 < len(cursors):
                skip = min(skip, cursors[pivot + 1][1][cursors[pivot + 1][0]])
            for c in cursors[: pivot + 1]:
                c[0] = bisect_left(c[1], max(skip, item + 1), c[0])
        cursors = sorted((c for c in cursors if c[0] < len(c[1])), key=lambda c: c[1][c[0]])
    return out


def _worth(index: Index, terms: np.ndarray, cut: np.ndarray) -> list[int]:
    """Passages whose bound over some range of items reaches the threshold."""
    out, at = [], 0
    full = np.flatnonzero(cut[1:] > cut[:-1])
    while at < len(full):
        end = max(at + 1, int(np.searchsorted(cut[full], cut[full[at]] + 100_000)))
        some = full[at:end]
        a, b = cut[some[0]], cut[some[-1] + 1]
        bound = np.add.reduceat(index.coarse[terms[a:b]], cut[some] - a, axis=0).max(axis=1)
        out += some[bound >= LEAST_SCORE - 1e-4].tolist()
        at = end
    return out


def search(index: Index, docs: list[bytes]) -> list[list[dict]]:
    """Leaks of each text: item, score, question and answer overlap, the
    passage's first word; an item once, where its score is highest."""
    found: list[dict[int, dict]] = [{} for _ in docs]
    if len(index.terms):
        t = kernel.Texts([plain(x) for x in docs])
        h = t.word_hashes()
        term = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
        hit = np.flatnonzero(index.terms[term] == h)
        step = index.passage
        n_pass = np.maximum(1, -(-t.count // step))
        base = np.append(0, np.cumsum(n_pass))
        slot = base[t.doc[hit]] + (hit - t.offset[t.doc[hit]]) // step
        # passage p of a text is words p * step to (p + 2) * step: each word lies in its own and in the one before
        before = slot > base[t.doc[hit]]
        n_terms = np.uint64(len(index.terms))
        pair = np.unique(np.concatenate([slot, slot[before] - 1]).astype(np.uint64) * n_terms + np.concatenate([term[hit], term[hit[before]]]).astype(np.uint64))
        passage, terms = (pair // n_terms).astype(np.int64), (pair % n_terms).astype(np.int64)
        cut = np.searchsorted(passage, np.arange(base[-1] + 1))
        for p in _worth(index, terms, cut):
            doc = int(np.searchsorted(base, p, side="right")) - 1
            for item, score in retrieve(index, terms[cut[p] : cut[p + 1]].tolist(), LEAST_SCORE):
                if item in found[doc] and found[doc][item]["score"] >= score:
                    continue
                first = (p - int(base[doc])) * step
                a, b = max(0, first - step), min(int(t.count[doc]), first + 3 * step)
                i = int(t.offset[doc])
                around = bytes(t.buf[t.start[i + a] : t.end[i + b - 1]]).split()
                have = _shingles(around) if index.sizes[item] >= SHINGLE else {tuple(around[j : j + index.sizes[item]]) for j in range(len(around))}
                short = {tuple(around[j : j + n]) for n in (1, 2) for j in range(len(around))}
                q, w = index.question[item], index.answer[item]
                # an item of one word has no answer: a part without words is covered
                asked, answered = (len(x & (have | short)) / len(x) if x else 1.0 for x in (q, w))
                if asked >= LEAST_QUESTION and answered >= LEAST_ANSWER:
                    found[doc][item] = {"item_id": index.ids[item], "score": round(score, 9), "question": asked, "answer": answered, "first_word": first}
    return [sorted(x.values(), key=lambda r: r["item_id"]) for x in found]


_LEAK = "array<struct<item_id:bigint,score:double,question:double,answer:double,first_word:bigint>>"


def _measured(items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(i, t, n) of the items that have words: id, bytes, number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "t"):
            n = [len(plain(x).split()) for x in kernel.raw(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("t"), pa.array(n, pa.int64())], names=["i", "t", "n"])

    some = items.select(F.col(item_key).cast("long").alias("i"), F.encode(F.col(item_text), "utf-8").alias("t")).where("i is not null and t is not null")
    return some.mapInArrow(run, "i long, t binary, n long").where("n > 0")


def _frequencies(items: DataFrame) -> DataFrame:
    """(part, h, df): the terms of each part, and how many of all items hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "t"):
            t = kernel.Texts([plain(x) for x in kernel.raw(batch.column("t"))])
            doc, h = kernel.distinct_per_doc(t.doc, t.word_hashes())
            yield pa.RecordBatch.from_arrays([batch.column("part").take(pa.array(doc)), pa.array(h.view(np.int64))], names=["part", "h"])

    each = items.select("part", "t").mapInArrow(run, "part string, h long").groupBy("part", "h").agg(F.count("*").alias("n"))
    return each.join(each.groupBy("h").agg(F.sum("n").alias("df")), "h").select("part", "h", "df")


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``leaks``: the test items that each whole text contains.

    Items without words match nothing; repeated items are found under each
    id; null or empty texts hold none, null items are left out; repeated rows
    are searched one by one; empty tables give empty results; a column named
    ``leaks`` is replaced. Items are split by length and by hash into indexes
    of about ``INDEX_BYTES`` of text, whatever their number; the frequencies
    behind the scores are those of all items, so a score does not depend on
    the split. One index meets all texts in one pass without a shuffle; of
    several, each is broadcast, met and let go before the next.
    """
    spark = docs.sparkSession
    items = materialize(_measured(items, item_key, item_text))
    level = F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / SHORT_ITEM) / math.log(LONGER))).cast("int")
    sizes = items.groupBy(level.alias("level")).agg(F.sum(F.length("t")).alias("size"), F.count("*").alias("items"), F.sum("n").alias("words")).orderBy("level").collect()
    n, words = sum(r["items"] for r in sizes), sum(r["words"] for r in sizes)
    n_parts = {r["level"]: 1 + int(r["size"]) // INDEX_BYTES for r in sizes}
    split = F.element_at(F.create_map(*(F.lit(x) for p in n_parts.items() for x in p)), level) if n_parts else F.lit(1)
    items = items.withColumn("part", F.concat_ws("-", level, F.pmod(F.xxhash64("i"), split)))
    parts_ = [f"{k}-{j}" for k, m in n_parts.items() for j in range(m)]
    frequencies = materialize(_frequencies(items)) if parts_ else None
    out = docs.drop("leaks").withColumn("leaks", F.array().cast(_LEAK))
    schema = out.schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("first_word", pa.int64())]))
    held = None
    for k in parts_:
        if held is not None:
            out = materialize(out)
            held.unpersist()
        some = items.where(F.col("part") == k).collect()
        df = {r["h"] & 0xFFFFFFFFFFFFFFFF: r["df"] for r in frequencies.where(F.col("part") == k).collect()}
        held = index = spark.sparkContext.broadcast(build([(r["i"], bytes(r["t"])) for r in some], Corpus(n, words / n, df)))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in kernel.slices(batches, text):
                at = batch.schema.get_field_index("leaks")
                both = [a + b for a, b in zip(batch.column(at).to_pylist(), search(index.value, kernel.raw(batch.column(text))), strict=True)]
                yield batch.set_column(at, pa.field("leaks", kind), pa.array(both, kind))

        out = out.mapInArrow(run, schema)
    return out
