"""Near copies on both sides of a power of two, against brute force."""

import re

import numpy as np
import pytest

from sparkloom.llm import ngram_jaccard

RULES = [(3, 90, 100), (5, 80, 100)]


def shingle_set(text, k):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, num, den):
    """{id: (size, component, class, links)} of (id, text) rows with distinct ids."""
    sets = {d: shingle_set(t, k) for d, t in rows}
    first = {}
    for d in sorted(sets):
        first.setdefault(sets[d] or d, d)
    same = {d: first[s or d] for d, s in sets.items()}
    near = {d: set() for d in sets}
    classes = sorted(d for d in set(same.values()) if sets[d])
    for i, a in enumerate(classes):
        for b in classes[:i]:
            if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                near[a].add(b)
                near[b].add(a)
    comp = {}
    for d in sorted(set(same.values())):
        todo = [d]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = d
                todo += near[x]
    return {d: (len(s), comp[same[d]], same[d], len(near[same[d]])) for d, s in sets.items()}


def near_rows(k):
    """Texts whose set sizes lie around powers of two, a word longer each."""
    rows = []
    for base in (15, 31, 63, 255, 511):
        w = [f"w{base}x{i}" for i in range(base + k + 2)]
        rows += [(len(rows) + j, " ".join(w[: base + k - 1 + j])) for j in range(3)]
    return rows


@pytest.mark.parametrize("k,num,den", RULES)
def test_sketches_fold_across_widths(k, num, den):
    """The distance of folded sketches never exceeds the true difference."""
    rows = near_rows(k)
    doc, h = ngram_jaccard.shingles([t.encode() for _, t in rows], k)
    size, _, _ = ngram_jaccard.prints(doc, h, len(rows))
    sketch = ngram_jaccard.sketches(doc, h, size)
    sets = [shingle_set(t, k) for _, t in rows]
    assert {31, 32, 33, 256, 257} <= set(size.tolist())
    for a in range(len(rows)):
        for b in range(a):
            w = min(len(sketch[a]), len(sketch[b])) // 8
            gap = int(np.bitwise_count(ngram_jaccard.folded(sketch[a], w) ^ ngram_jaccard.folded(sketch[b], w)).sum())
            assert gap <= len(sets[a] ^ sets[b])
            if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                assert ngram_jaccard.close_enough(int(size[a]), int(size[b]), sketch[a], sketch[b], num, den)


@pytest.mark.parametrize("k,num,den", RULES)
def test_links_across_powers_of_two(spark, k, num, den):
    rows = near_rows(k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["class_id"]) for r in ngram_jaccard.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()}
    assert got == {d: x[:3] for d, x in brute(rows, k, num, den).items()}


def test_all_links_counted(spark, monkeypatch):
    """Near copies that all link with each other, in one block and in several."""
    w = [f"w{i}" for i in range(400)]
    rows = [(1 + j, " ".join(w[:j] + [f"x{j}"] + w[j + 1 :])) for j in range(0, 400, 40)] + near_rows(3)[:6]
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [(100, rows[0][1]), (101, None)]
    want = brute(rows, 3, 90, 100)
    assert want[0][3] == 9
    docs = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string")
    for block in (1024, 3):
        monkeypatch.setattr(ngram_jaccard, "COUNT_SETS", block)
        got = {tuple(r) for r in ngram_jaccard.similar_classes(docs).collect()}
        assert got == {(d, *x) for d, x in want.items()}


def test_link_counts_by_columns(monkeypatch):
    rng = np.random.default_rng(1)
    base = np.arange(300, dtype=np.uint64)
    sets = [np.unique(np.append(rng.choice(base, 290, replace=False), rng.integers(1000, 1010, 3).astype(np.uint64))) for _ in range(40)]
    link = np.array([[100 * len(np.intersect1d(x, y)) >= 92 * len(np.union1d(x, y)) for y in sets] for x in sets]) & ~np.eye(40, dtype=bool)
    monkeypatch.setattr(ngram_jaccard, "COUNT_COLUMNS", 64)
    assert 0 < link.sum() < 1560
    assert ngram_jaccard.link_counts(sets, np.ones(40, bool), 92, 100).tolist() == link.sum(axis=1).tolist()
    left = np.arange(40) % 3 == 0
    assert ngram_jaccard.link_counts(sets, left, 92, 100).tolist() == (link & (left[:, None] ^ left[None, :])).sum(axis=1).tolist()
