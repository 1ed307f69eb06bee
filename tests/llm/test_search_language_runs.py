"""Ranked search, language ID and periodic runs against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import language, queries, ranked_search, runs

SF = "/root/testdata/sf0.001"
OWN = "`a.b` string, score string, Score_ string, runs string, n_words string, lang_pred string, i string, t string, rank string"
LONG = " ".join(f"w{i * i % 977}" for i in range(9000))
HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, "é ü " * 40 + "\n" + "é ü " * 40), (7, "... 12 --"), (8, "same line of words here\n" * 30), (None, "one two three"), (9, "One, ONE two"), (10, "one two three"), (10, "one two three"), (11, "日本語 漢字")]
LETTER = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return LETTER.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain_ranks(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(map(bool, sizes)), sum(sizes)
    df = Counter(x for _, b in bags for x in b)
    out = []
    for item, text in sorted(set(items)):
        asked = [x for x in set(terms(text)) if x in df]
        best = []
        for (d, bag), size in zip(bags, sizes, strict=True):
            m = 10 + 90 * size * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * bag[x] // (1000 * bag[x] + 8 * m)) for x in asked if bag[x])
            if s:
                best.append((-s, d is None, d or 0, d))
        best = sorted(best)[:k]
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(best, 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [*HARD, *((r["doc_id"] + 100, r["text"]) for r in real)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefghi") for r in rows], f"doc_id long, text string, {OWN}").repartition(5).cache()


@pytest.mark.parametrize(("block", "step", "short", "closed", "item_bytes"), [(64, 32, 0.25, 1 << 16, 4_000_000), (4, 2, 0.25, 40, 2000), (4, 1, 0.0, 1, 4_000_000), (8, 3, 9.0, 70, 4_000_000)])
def test_ranks(spark, monkeypatch, docs, rows, block, step, short, closed, item_bytes):
    for name, value in (("BLOCK", block), ("STEP", step), ("SHORT_SHARE", short), ("SEGMENT_DOCS", closed), ("ITEM_BYTES", item_bytes)):
        monkeypatch.setattr(ranked_search, name, value)
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    items = [*real, (-1, None), (-2, ""), (-3, "..."), (-4, "ONE"), (-4, "ONE"), (-5, "two"), (-5, "one one"), (-6, "日本語 nowhere"), (-7, LONG)]
    asked = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    got = sorted(map(tuple, ranked_search.search(docs, asked, k=7).collect()), key=repr)
    want = plain_ranks(rows, [x for x in items if x[1] is not None and x[0] != -5], 7)
    assert [x for x in got if x[0] != -5] == want
    both = plain_ranks(rows, [(-5, "two")], 7) + plain_ranks(rows, [(-5, "one one")], 7)
    assert [x for x in got if x[0] == -5] == sorted(both, key=repr)


def test_language(spark, docs):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(real.where("pmod(crc32(cast(doc_id as string)), 3) <> 1"))
    out = language.predict(docs, model).collect()
    by_id = {r["doc_id"]: r for r in out}
    assert len(out) == docs.count() and all(r["a.b"] == "a" and r["runs"] == "d" for r in out)
    assert {d: by_id[d]["lang_pred"] for d in (1, 2, 3, 7)} == dict.fromkeys((1, 2, 3, 7), "und")
    assert by_id[11]["lang_pred"] in model.languages and all(0 <= r["score"] <= 1 for r in out)
    held = language.predict(real.where("pmod(crc32(cast(doc_id as string)), 3) = 1"), model)
    right = held.selectExpr("avg(int(lang = lang_pred)) a", "count(*) n").first()
    assert right["n"] > 300 and right["a"] > 0.98


def test_language_backs_off(spark):
    """A word that a language knows, one that shares its endings, one that shares a letter."""
    rows = [("aa", "running jumping walking running jumping walking"), ("bb", "laufen gehen laufen gehen"), ("cc", None), (None, "running")]
    model = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == ["aa", "bb"]
    assert model.scores([b"running", b"talking", b"kaufen", b"kkk", b"RUNNING!"])[0] == ["aa", "aa", "bb", "aa", "aa"]
    small = language.fit(spark.createDataFrame(rows, "lang string, text string"), words=5, grams=3)
    assert len(small.words[0]) == 5 and len(small.grams[0]) <= 3
    assert len(language.fit(spark.createDataFrame(rows, "lang string, text string"), words=4).words[0]) == 0
    assert language.fit(spark.createDataFrame([], "lang string, text string")) is None


def plain_runs(x, least=12):
    out = []
    for q in range(1, len(x) // 2 + 1):
        k = q
        while k < len(x):
            if x[k] != x[k - q]:
                k += 1
                continue
            s = k - q
            while k < len(x) and x[k] == x[k - q]:
                k += 1
            n = k - s
            if n >= max(least, 2 * q) and not any(all(x[s + j] == x[s + j - d] for j in range(d, n)) for d in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    r = random.Random(5)
    doc, words, want = [], [], []
    for d in range(1500):
        x = [r.randrange(r.randint(1, 4)) for _ in range(r.randint(0, 60))]
        if x and r.random() < 0.5:
            s, p = r.randrange(len(x)), r.randint(1, 12)
            for i in range(s + p, len(x)):
                x[i] = x[i - p]
        assert sorted(runs.Runs(x).found) == sorted(plain_runs(x))
        want += [(d, len(words) + s, n, q) for s, n, q in plain_runs(x)]
        doc += [d] * len(x)
        words += x
    assert sorted(runs.find(np.array(doc), np.array(words, np.uint64) * np.uint64(7919))) == sorted(want)


def test_runs_stay_linear():
    """A long word, a Fibonacci word and one word over and over."""
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 5000:
        fib.append(fib[-1] + fib[-2])
    assert len(runs.Runs(fib[-1]).found) > 500
    assert runs.Runs([3] * 50_000).found == [(0, 50_000, 1)]


def test_periodic_runs(spark, docs, rows):
    looped = queries.looped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    changed = 0
    for (d, text), r in zip(sorted(rows, key=repr), sorted(looped, key=lambda r: repr((r["doc_id"], dict(rows).get(r["doc_id"])))), strict=True):
        w, h = (text or "").split(), zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            assert r["text"].split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            changed += 1
        else:
            assert (r["text"] or "") == (text or "")
    assert changed > 5
    out = runs.periodic_runs(docs.drop("text").join(spark.createDataFrame([r for r in looped if r["doc_id"]], "doc_id long, text string").distinct(), "doc_id")).collect()
    text = {r["doc_id"]: r["text"] for r in looped}
    assert len(out) == len(rows) - 1 and any(r["runs"] for r in out)
    for r in out:
        w = re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]] or "")
        want = plain_runs(w) if len(w) < 4000 else None
        got = [(x["start"], x["length"], x["period"]) for x in r["runs"]]
        assert r["n_words"] == len(w) and r["a.b"] == "a" and want in (None, got)
        gone = {i for s, n, q in got for i in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_query_of_runs(spark):
    """The digest columns, from plain runs of the plain text."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in queries.queries()["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, text in docs:
        w, h = text.split(), zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        if len(w) > 2000:
            continue
        found = plain_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        r = got[d]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert ranked_search.search(none, items).count() == 0 and ranked_search.search(some, items.limit(0)).count() == 0
    assert ranked_search.search(some, items).collect()[0]["rank"] == 1
    assert language.fit(none) is None and language.predict(none, None).count() == 0
    assert language.predict(some, language.fit(some)).first()["lang_pred"] == "und"
    assert runs.periodic_runs(none).count() == 0
