"""Repeated windows where anchors are hot, ids repeat and names clash."""

import re

import pytest

from sparkloom.llm import substring


def brute(rows, window):
    """{(id, text): (words, removed, kept)} of (id, text) rows."""
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, t in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d, t] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def passages():
    """A passage in many surroundings, two texts under one id, hard rows."""
    line = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"a{i} b{i % 3} {line} c{i % 5} d{i} e{i}") for i in range(60)]
    twin = " ".join(f"t{i}" for i in range(30))
    return [*rows, (100, twin), (100, twin + " more " + line), (100, line + " x"), (101, twin), (101, twin), (102, None), (103, ""), (None, line), (104, "z " * 40), (105, "z " * 50)]


@pytest.mark.parametrize("hot,spread", [(512, 24), (3, 24), (512, 2), (3, 2)])
def test_hot_anchors_and_twin_ids(spark, monkeypatch, hot, spread):
    monkeypatch.setattr(substring, "HOT_CELLS", hot)
    monkeypatch.setattr(substring, "SAMPLE_CELLS", spread)
    rows = passages()
    docs = spark.createDataFrame([(*r, "r", 7, "i", 8) for r in rows], "doc_id long, text string, `_runs` string, `_id` int, id string, base int")
    out = substring.remove_repeats(docs).collect()
    assert {r["_runs"] for r in out} == {"r"} and {r["_id"] for r in out} == {7} and {r["id"] for r in out} == {"i"}
    want = brute(rows, 13)
    assert len(out) == len(rows)
    for r in out:
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"], r["text"]] if r["text"] else r["n_words"] == 0
