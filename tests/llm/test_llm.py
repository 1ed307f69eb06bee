"""Operators against brute force on small tables with hard rows."""

import hashlib
import re

import pytest

from sparkloom.llm import chat, decontaminate, html_extract, ngram_jaccard, packing, quality, queries, rollups, secret_scan, substring, toxicity

SF = "/root/testdata/sf0.001"
HARD = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, "one", "x"), (5, "A b c d", None), (6, "a B c d", "x"), (7, "w " * 3000 + "end", "x"), (7, "w " * 3000 + "end", "x"), (8, "é ü " * 40, None)]


@pytest.fixture()
def docs(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    return real.withColumn("doc_id", real.doc_id + 100).unionByName(spark.createDataFrame(HARD, "doc_id long, text string, source string"))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_ngram_jaccard(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.similar_classes(docs).collect()}
    sets = {}
    for r in docs.collect():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(r["text"])]
        sets[r["doc_id"]] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {d: (len(s), find(d)) for d, s in sets.items()}


def test_quality(docs):
    for r in quality.quality_rules(docs).collect():
        w = words(r["text"])
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        assert not (r["base_failed"] and r["kept"])


def test_packing(docs):
    rows = packing.pack(packing.pieces(docs.dropDuplicates(["doc_id"]), queries.vocabulary())).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seen.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    encode = packing.encoder(queries.vocabulary())
    total = sum(len(encode(r["text"] or "")) + 1 for r in docs.dropDuplicates(["doc_id"]).collect())
    assert sum(r["length"] for r in rows) == total
    assert len(seen) <= 1.02 * -(-total // 1024) + 1


def test_secrets(spark):
    body = "zQ" * 15
    token = f"ghp_{body}{secret_scan.base62_crc(body)}"
    text = f"é TOKEN = 'abcdefghijkl' AKIA{'Z9' * 8} {'0a' * 8} {token} ghp_{body}000000 token=short"
    found = secret_scan.scan([text.encode(), b""])
    assert [k for k, _, _ in found[0]] == ["assign", "access", "hex", "forge"] and found[1] == []
    out = secret_scan.mask_secrets(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert token not in out[0]["text"] and out[1]["text"] is None


def test_html():
    page = "<html><body><nav>menu, menu</nav><div class='ad'>buy</div><article><h1>T&amp;t</h1><p>one <b>two</b>\n three<p>four, five</article><div id='comments'><p>me, too</div><footer>f</footer>"
    assert html_extract.extract(page) == "T&t\none two three\nfour, five"
    assert html_extract.extract("") == ""


def test_chat(spark):
    log = [(1, 0, "message", 0, "user", "\\### hi: </turn>"), (1, 1, "message", 1, "assistant", "dra"), (1, 2, "delta", 1, None, "ft"), (1, 3, "regenerate", 1, None, None), (1, 4, "delta", 1, None, "final"), (1, 5, "edit", 0, None, "q#<:"), (2, 0, "message", 0, "user", None), (2, 1, "delete", 0, None, None)]
    turns = chat.format_turns(spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string"))
    whole = {r["conv_id"]: r["formatted"] for r in chat.assembled(turns).collect()}
    assert chat.read_back(whole[1]) == [("user", "q#<:"), ("assistant", "final")] and 2 not in whole
    r = chat.digests(turns).first()
    assert (r["loss_chars"], r["loss_sha256"]) == (5, hashlib.sha256(b"final").hexdigest())


def test_decontaminate(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], x["item_id"]) for r in decontaminate.leaks(docs, items).collect() for x in r["leaks"]}
    norm = lambda t: " " + " ".join(decontaminate.plain((t or "").encode()).decode().split()) + " "
    want = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if norm(i["text"]) in norm(d["text"])}
    assert want and want <= got
    index = decontaminate.build([(i["item_id"], i["text"].encode()) for i in items.collect()])
    for q in ([0, 5, 9, 40], list(range(0, 200, 3))):
        score = {}
        for t in q:
            for i, s in zip(*index.postings[t][:2], strict=True):
                score[i] = score.get(i, 0) + s
        for least in (0.05, 0.2):
            assert {i for i, _ in decontaminate.retrieve(index, q, least)} == {i for i, s in score.items() if s >= least - 1e-9}


def test_toxicity(spark):
    rows = [(i, f"plain words here {i}. more of it" + (". you idiot" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(df, df.select("doc_id", "toxic")))
    out = toxicity.score(df.select("doc_id", "text").union(spark.createDataFrame([(999, None)], "doc_id long, text string")), model).collect()
    for r in out:
        assert (r["score"] >= 0.5) == (r["doc_id"] % 4 == 0 and r["doc_id"] < 400)


def test_rollups(spark, tmp_path):
    kept = rollups.Rollup(spark, f"file://{tmp_path}/r")
    add = spark.createDataFrame([("a", None, "v", 1, 10), ("a", None, "v", 1, 5)], rollups.SCHEMA)
    assert kept.commit("b1", add) and not kept.commit("b1", add)
    assert kept.commit("b2", spark.createDataFrame([("a", None, "v", -1, -5)], rollups.SCHEMA))
    assert [tuple(r) for r in kept.totals().collect()] == [("a", None, "v", 1, 10)]


def test_substring(docs):
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(docs).collect()}
    held, first = {}, {}
    for r in docs.collect():
        held[r["doc_id"]] = (r["text"] or "").encode().split()
    for d in sorted(held):
        for i in range(len(held[d]) - 12):
            first.setdefault(tuple(held[d][i : i + 13]), d)
    want = set()
    for d, w in held.items():
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        want.add((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality_rules(none).count() == 0
    assert ngram_jaccard.similar_classes(none).count() == 0
    assert substring.remove_repeats(none).count() == 0
    assert packing.pack(packing.pieces(none, queries.vocabulary())).count() == 0
