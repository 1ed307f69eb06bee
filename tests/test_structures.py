"""Alignments against a plain programme over all places, and the column map."""

import random

import pytest

from sparkloom.operators import structures

SCORES = (structures.MATCH, structures.MISMATCH, structures.OPEN, structures.EXTEND)


def plain(a, b, scores):
    """The best score, by three tables filled place by place."""
    match, mismatch, opens, extends = scores
    low = float("-inf")
    m, x, y = ([[low] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in range(3))
    m[0][0] = 0.0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j:
                m[i][j] = max(t[i - 1][j - 1] for t in (m, x, y)) + (match if a[i - 1] == b[j - 1] else mismatch)
            if i:
                x[i][j] = max(m[i - 1][j] + opens, x[i - 1][j] + extends, y[i - 1][j] + opens)
            if j:
                y[i][j] = max(m[i][j - 1] + opens, y[i][j - 1] + extends, x[i][j - 1] + opens)
    return max(t[-1][-1] for t in (m, x, y))


def worth(a, b, blocks, scores):
    """The score of the alignment with these blocks."""
    match, mismatch, opens, extends = scores
    out, i, j = 0.0, 0, 0
    for p, q, n in [*blocks, (len(a), len(b), 0)]:
        assert p >= i and q >= j
        for gap in (p - i, q - j):
            out += opens + extends * (gap - 1) if gap else 0.0
        out += sum(match if s == t else mismatch for s, t in zip(a[p : p + n], b[q : q + n], strict=True))
        i, j = p + n, q + n
    return out


@pytest.mark.parametrize("scores", [SCORES, (1.0, -3.0, -1.0, -1.0), (5.0, -4.0, -10.0, -0.1)])
def test_align(scores):
    r = random.Random(5)
    cases = [("", ""), ("A", ""), ("", "AC"), ("A", "A"), ("ACGTACGT", "ACGT"), ("AAAA", "TTTTTTT"), ("é😀b", "é😀")]
    for _ in range(150):
        a = "".join(r.choice("ACDE") for _ in range(r.randrange(40)))
        b = list(a)
        for _ in range(r.randrange(6)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(8)] = [r.choice("ACDE") for _ in range(r.randrange(8))]
        cases.append((a, "".join(b)))
    for a, b in cases:
        score, blocks = structures.align(a, b, scores)
        assert score == pytest.approx(plain(a, b, scores)), (a, b)
        assert worth(a, b, blocks, scores) == pytest.approx(score), (a, b, blocks)
        assert all(u[0] + u[2] < v[0] or u[1] + u[2] < v[1] for u, v in zip(blocks, blocks[1:]))


def test_columns(spark):
    rows = spark.createDataFrame([("s", "MK-TAY--LV"), ("t", "---"), ("u", None)], "structure string, sequence string")
    chain = lambda s, c, letters, start: [(s, c, i, x, start + i) for i, x in enumerate(letters)]
    data = chain("s", "A", "MKTAYLV", 10) + chain("s", "B", "TAYL", -1) + chain("t", "A", "MK", 1) + chain("u", "A", "MK", 1) + chain("v", "A", "MK", 1)
    random.Random(1).shuffle(data)
    got = structures.column_residues(rows, spark.createDataFrame(data, "structure string, chain string, ord int, residue string, number int")).collect()
    of = lambda c: sorted((r["column"], r["letter"], r["number"], r["residue"]) for r in got if r["chain"] == c)
    columns = [(1, "M"), (2, "K"), (4, "T"), (5, "A"), (6, "Y"), (9, "L"), (10, "V")]
    assert {r["structure"] for r in got} == {"s"}
    assert of("A") == [(c, x, 10 + i, x) for i, (c, x) in enumerate(columns)]
    assert of("B") == [(c, x, i - 1, x) for i, (c, x) in enumerate(columns[2:6])]


def test_representative(spark):
    rows = [("x|P1", "MK--TAYLV", 0), ("y|Q1", "MKTAYLVMM", 1), ("z|P1", "WWWWWWW-", 2), ("w", "AAAAAAAAA", 3), ("e", "---------", 4)]
    records = spark.createDataFrame(rows, "id string, sequence string, place int")
    pick = lambda chain, **how: [r["id"] for r in structures.representative(records, chain, **how).collect()]
    assert pick("MKTAYLV") == ["x|P1"]
    assert pick("MKTAYLVMM") == ["y|Q1"]
    assert pick("MKTAYLV", accessions=["P1"]) == ["z|P1"]
    assert pick("MKTAYLV", accessions=["P9"]) == ["x|P1"]
    # nothing alike: the fewest gaps, the first of ties
    assert pick("CCCC") == pick("") == ["y|Q1"]
    assert structures.representative(records.where("false"), "MK").collect() == []
